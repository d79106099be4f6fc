"""Roots that source files declare themselves: lines that a toolchain reads, told from text in string literals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.functions import paths

BLANKS = " \t\r\n\f\v"
ESCAPED = ('\\"', "\\n")  # what only the inside of a literal can hold
# The beginnings of Rust lines that declare what stands below them, and their rules; files that Python imports by name.
RUST = {
    "#[no_mangle]": "rust/no-mangle", "#[unsafe(no_mangle)]": "rust/no-mangle", "#[used]": "rust/used", "#[unsafe(used)]": "rust/used", "#[ctor]": "rust/ctor", "#[ctor::ctor]": "rust/ctor",
    "#[export_name": "rust/export-name", "#[unsafe(export_name": "rust/export-name",
}
BY_NAME = ("sitecustomize.py", "usercustomize.py")
ITEMS = ("fn ", "static ", "const ")


def _has(line: Column, text: str) -> Column:
    return F.contains(line, F.lit(text))


def _after(text: Column, start: Column) -> Column:
    """From a place (1: the first character) on."""
    return F.substring(text, start, F.length(text))


def opened(line: Column, is_go: Column) -> Column:
    """What closes the raw string that is still open at the end of a line of code, null if none is."""
    ticks = F.length(line) - F.length(F.replace(line, F.lit("`"), F.lit("")))
    at = F.coalesce(F.nullif(F.instr(line, 'r"'), F.lit(0)), F.nullif(F.instr(line, "r#"), F.lit(0)))
    rest = _after(line, at + 1)
    fence = F.regexp_extract(rest, "^(#*)", 1)
    inside = _after(rest, F.length(fence) + 1)
    closing = F.concat(F.lit('"'), fence)
    rust = F.when(F.startswith(inside, F.lit('"')) & ~F.contains(_after(inside, F.lit(2)), closing), closing)
    return F.when(is_go, F.when(ticks % 2 == 1, F.lit("`"))).otherwise(rust)


def raw_spans(lines: Column, is_go: Column) -> Column:
    """``array<struct<a, b>>``: after line a and up to line b (from 1) everything lies in a raw string.

    A line is a step between two states, code and a raw string with its closing. Only lines with a quote can take one, so all others are left out of the fold.
    """
    numbered = F.transform(lines, lambda x, i: F.struct((i + 1).alias("i"), x.alias("l")))
    events = F.filter(numbered, lambda e: F.when(is_go, _has(e["l"], "`")).otherwise(_has(e["l"], '"')))
    zero = F.struct(F.lit(None).cast("string").alias("closing"), F.lit(0).alias("since"), F.array().cast("array<struct<a:int,b:int>>").alias("spans"))

    def step(state: Column, e: Column) -> Column:
        line = e["l"]
        inside = state["closing"].isNotNull()
        leaves = inside & F.contains(line, state["closing"])
        enters = F.when(~inside & ~_has(line, ESCAPED[0]) & ~_has(line, ESCAPED[1]), opened(line, is_go))
        return F.struct(
            F.when(inside, F.when(~leaves, state["closing"])).otherwise(enters).alias("closing"),
            F.when(enters.isNotNull(), e["i"]).otherwise(state["since"]).alias("since"),
            F.when(leaves, F.array_append(state["spans"], F.struct(state["since"].alias("a"), e["i"].alias("b")))).otherwise(state["spans"]).alias("spans"),
        )

    def end(state: Column) -> Column:
        return F.when(state["closing"].isNotNull(), F.array_append(state["spans"], F.struct(state["since"].alias("a"), F.lit(2**31 - 1).alias("b")))).otherwise(state["spans"])

    return F.aggregate(events, zero, step, end)


def source_roots(files: DataFrame) -> DataFrame:
    """``rule, path, line, symbol, target`` of files (path, text; with ``repo`` of many trees): directives of Go, attributes of Rust with the item they stand above, and Python's start-up files.

    ``symbol`` is null where the file itself is the root. Lines inside raw strings, and lines with what only a literal can hold, are no code. An item lies on the first line after its
    attribute that is neither an attribute nor a comment; a blank line ends the search. Null texts were not read and declare nothing, but Python's two files count by name.
    """
    keys = ["repo"] if "repo" in files.columns else []
    ext, name = paths.extension(F.col("path")), paths.basename(F.col("path"))
    f = files.where(ext.isin("go", "rs", "pth") | name.isin(*BY_NAME)).select(*keys, "path", ext.alias("ext"), F.split("text", "\n").alias("lines"))
    code = f.where("ext in ('go', 'rs') and lines is not null")
    heads = {"go": ("//go:linkname", "//export "), "rs": tuple(RUST)}
    trimmed = lambda x: F.btrim(x, F.lit(BLANKS))
    begins = lambda t, some: F.array_contains(F.transform(F.array(*[F.lit(s) for s in some]), lambda s: F.startswith(t, s)), True)
    marks = F.filter(
        F.transform("lines", lambda x, i: F.struct((i + 1).alias("i"), trimmed(x).alias("t"), x.alias("l"))),
        lambda m: F.when(F.col("ext") == "go", begins(m["t"], heads["go"])).otherwise(begins(m["t"], heads["rs"])),
    )
    code = code.withColumn("marks", marks).where("size(marks) > 0").withColumn("spans", raw_spans(F.col("lines"), F.col("ext") == "go"))
    quoted = lambda line, i: _has(line, ESCAPED[0]) | _has(line, ESCAPED[1]) | F.exists("spans", lambda s: (s["a"] < i) & (i <= s["b"]))

    def item(m: Column) -> Column:
        below = F.transform(F.slice("lines", m["i"] + 1, F.size("lines")), lambda x, j: F.struct((m["i"] + 1 + j).alias("i"), F.when(quoted(x, m["i"] + 1 + j), "").otherwise(trimmed(x)).alias("t")))
        return F.try_element_at(F.filter(below, lambda b: ~F.startswith(b["t"], F.lit("#[")) & ~F.startswith(b["t"], F.lit("//"))), F.lit(1))

    shown = F.transform(F.filter("marks", lambda m: ~quoted(m["l"], m["i"])), lambda m: F.struct(m["i"].alias("i"), m["t"].alias("t"), F.when(F.col("ext") == "rs", item(m)).alias("item")))
    each = code.select(*keys, "path", "ext", F.explode(shown).alias("m")).select(*keys, "path", "ext", F.col("m.i").alias("i"), F.col("m.t").alias("t"), "m.item")
    row = lambda rule, line, symbol, target: F.struct(rule.alias("rule"), line.cast("long").alias("line"), symbol.alias("symbol"), target.alias("target"))

    words = F.filter(F.split(_after(F.col("t"), F.lit(len(heads["go"][0]) + 1)), r"\s+"), lambda w: w != "")
    linked = F.transform(F.slice(words, 1, 2), lambda w: row(F.lit("go/linkname"), F.col("i"), F.regexp_replace(w, r"(?s)^.*[./]", ""), w))
    exported = F.try_element_at(F.filter(F.split(_after(F.col("t"), F.lit(len(heads["go"][1]) + 1)), r"\s+"), lambda w: w != ""), F.lit(1))
    go = F.when(F.startswith("t", F.lit(heads["go"][0])), linked).when(exported.isNotNull(), F.array(row(F.lit("go/export"), F.col("i"), exported, exported)))

    rule = F.lit(None).cast("string")
    for start, said in RUST.items():
        rule = F.when(F.startswith("t", F.lit(start)), said).otherwise(rule)
    names = [F.nullif(F.regexp_extract(_after(F.col("item.t"), F.instr("item.t", k) + len(k)), r"^([\p{L}\p{N}_]*)", 1), F.lit("")) for k in ITEMS]
    found = F.coalesce(*[F.when(F.instr("item.t", k) > 0, n) for k, n in zip(ITEMS, names)])
    given = F.when(rule == "rust/export-name", F.regexp_extract("t", '"([^"]*)"', 1))
    has_given = (rule == "rust/export-name") & F.col("t").rlike('"[^"]*"')
    rust = F.array(F.when(has_given, row(rule, F.col("i"), given, given)), F.when(found.isNotNull(), row(rule, F.col("item.i"), found, found)))
    code_roots = each.select(*keys, "path", F.explode(F.when(F.col("ext") == "go", go).otherwise(rust)).alias("r")).where("r is not null").select(*keys, "r.rule", "path", "r.line", "r.symbol", "r.target")

    none = F.lit(None).cast("string")
    start_up = f.where("ext = 'pth' and lines is not null").select(*keys, "path", "lines")
    own = start_up.select(*keys, F.lit("python/pth").alias("rule"), "path", F.lit(1).cast("long").alias("line"), none.alias("symbol"), F.col("path").alias("target"))
    said = start_up.select(*keys, "path", F.posexplode("lines").alias("i", "x")).select(*keys, "path", "i", trimmed(F.col("x")).alias("t")).where("startswith(t, 'import ')")
    module = F.try_element_at(F.filter(F.split(F.substring("t", 8, 2**30), r"[;\s]+"), lambda w: w != ""), F.lit(1))
    imported = said.select(*keys, F.lit("python/pth").alias("rule"), "path", (F.col("i") + 1).cast("long").alias("line"), module.alias("symbol"), module.alias("target")).where("symbol is not null")
    by_name = f.where(paths.basename(F.col("path")).isin(*BY_NAME)).select(*keys, F.lit("python/sitecustomize").alias("rule"), "path", F.lit(1).cast("long").alias("line"), none.alias("symbol"), F.col("path").alias("target"))
    return code_roots.unionByName(own).unionByName(imported).unionByName(by_name).distinct()
