"""Files that say of themselves that a tool wrote them (class 1j by content)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from siftline.functions import paths
from siftline.functions.text import any_of, ascii_lower

# Name, suffixes of the basename, whether case matters not, least number of lines before the test, and checks. A check is the lines
# it looks at (("first", n), ("at", i) from 0, ("end", n) from the end), how it looks (all, any, starts) and for what.
RULES = (
    ("net_docfile", ".xml", True, 3, ((("at", 1), "all", ("<doc>",)), (("at", 2), "all", ("<assembly>",)), (("end", 2), "all", ("</doc>",)))),
    ("cython", ".c .cpp", False, 1, ((("at", 0), "all", ("Generated by Cython",)),)),
    ("go", ".go", False, 1, ((("first", 40), "starts", ("// Code generated ",)),)),
    ("protobuf_from_go", ".proto", False, 1, ((("first", 20), "all", ("This file was autogenerated by go-to-protobuf",)),)),
    ("protobuf", ".py .java .h .cc .cpp .m .rb .php", False, 1, ((("first", 3), "all", ("Generated by the protocol buffer compiler.  DO NOT EDIT!",)),)),
    ("protobuf_javascript", ".js", False, 6, ((("at", 5), "all", ("GENERATED CODE -- DO NOT EDIT!",)),)),
    ("protobuf_typescript", ".ts", False, 4, ((("at", 0), "all", ("Code generated by protoc-gen-ts_proto. DO NOT EDIT.",)),)),
    ("twirp_ruby", ".rb", False, 1, ((("first", 3), "all", ("Code generated by protoc-gen-twirp_ruby", "DO NOT EDIT.")),)),
    ("thrift", ".rb .py .go .js .m .java .h .cc .cpp .php", False, 0, ((("first", 6), "all", ("Autogenerated by Thrift Compiler",)),)),
    ("jni_header", ".h", False, 2, ((("at", 0), "all", ("/* DO NOT EDIT THIS FILE - it is machine generated */",)), (("at", 1), "all", ("#include <jni.h>",)))),
    ("vcr_cassette", ".yml", False, 2, ((("end", 2), "all", ("recorded_with: VCR",)),)),
    ("antlr", ".g", False, 2, ((("at", 1), "all", ("generated by Xtest",)),)),
    ("module", ".mod", False, 1, ((("at", 0), "any", ("PCBNEW-LibModule-V", "GFORTRAN module version '")),)),
    ("unity3d_meta", ".meta", False, 1, ((("at", 0), "all", ("fileFormatVersion: ",)),)),
    ("racc", ".rb", False, 2, ((("at", 2), "starts", ("# This file is automatically generated by Racc",)),)),
    ("jflex", ".java", False, 1, ((("at", 0), "starts", ("/* The following code was generated by JFlex ",)),)),
    ("grammarkit", ".java", False, 1, ((("at", 0), "starts", ("// This is a generated file. Not intended for manual editing.",)),)),
    ("roxygen2", ".Rd", False, 1, ((("at", 0), "all", ("% Generated by roxygen2: do not edit by hand",)),)),
    ("jison", ".js", False, 1, ((("at", 0), "starts", ("/* parser generated by jison ", "/* generated by jison-lex ")),)),
    ("grpc_cpp", ".cpp .hpp .h .cc", False, 1, ((("at", 0), "starts", ("// Generated by the gRPC",)),)),
    ("perl_ppport_header", "ppport.h", False, 10, ((("at", 8), "all", ("Automatically created by Devel::PPPort",)),)),
    ("visualstudio6", ".dsp", True, 0, ((("first", 3), "all", ("# Microsoft Developer Studio Generated Build File",)),)),
    ("haxe", ".js .py .lua .cpp .h .java .cs .php", False, 0, ((("first", 3), "all", ("Generated by Haxe",)),)),
    ("jooq", ".java", True, 0, ((("first", 2), "all", ("This file is generated by jOOQ.",)),)),
    ("sorbet_rbi", ".rbi", True, 4, (
        (("at", 0), "starts", ("# typed:",)), (("at", 2), "all", ("DO NOT EDIT MANUALLY",)),
        (("at", 4), "starts", ("# Please run `bin/tapioca", "# Please instead update this file by running `bin/tapioca")),
    )),
    ("mysql_view", ".frm", True, 0, ((("at", 0), "starts", ("TYPE=VIEW",)),)),
)


def _hit(line: Column, how: str, needles: tuple[str, ...]) -> Column:
    if how == "starts":
        return any_of([F.startswith(line, F.lit(x)) for x in needles])
    tests = [F.contains(line, F.lit(x)) for x in needles]
    return reduce(lambda a, b: a | b if how == "any" else a & b, tests)


def generated(path: Column, text: Column, base: Column | None = None) -> Column:
    """The first rule that holds, null if none; a last empty line counts, as a file that ends with a line break has one. ``base`` is a column with the basename, if there is one."""
    lines = F.split(text, "\n", -1)
    base = paths.basename(path) if base is None else base
    low, n = ascii_lower(base), F.size(lines)

    def check(where: tuple[str, int], how: str, needles: tuple[str, ...]) -> Column:
        kind, k = where
        if kind == "first":
            return F.exists(F.slice(lines, F.lit(1), F.lit(k)), lambda x: _hit(x, how, needles))
        line = F.get(lines, F.lit(k)) if kind == "at" else F.get(lines, n - k)
        return F.coalesce(_hit(line, how, needles), F.lit(False))

    out = None
    for name, suffixes, ci, least, checks in RULES:
        named = any_of([F.endswith(low if ci else base, F.lit(s.lower() if ci else s)) for s in suffixes.split()])
        holds = reduce(lambda a, b: a & b, [check(*c) for c in checks], named & (n > least))
        out = F.when(holds, name) if out is None else out.when(holds, name)
    return out


def census() -> dict[str, int]:
    """How many rules there are, and how many suffixes they look at."""
    return {"rules": len(RULES), "suffixes": len({s for _, x, *_ in RULES for s in x.split()})}
