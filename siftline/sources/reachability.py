"""What manifests and directory listings in code root: rows for the reachability veto.

A file yields patterns (``path, kind_rank, pos, pattern, base, detail``) by a scanner that knows its format; everything about the tree
(which patterns are directories, what lies under them) is then joins.
"""

from __future__ import annotations

import json
import posixpath
import re
from collections.abc import Iterator
from itertools import takewhile

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.functions import paths
from siftline.operators.veto import enumerating_files, first_reason
from siftline.sources.lineage import large

# YAML keys that hold paths, and that hold commands.
PATH_KEYS = ("path", "paths")
COMMAND_KEYS = ("run", "script", "before_script", "after_script", "command", "entrypoint", "entry", "args", "cmd")
WILD = re.compile(r"[*?\[{]")


def string_literals(text: str) -> list[str]:
    """Quoted strings that end on their line; a backslash and what it escapes are left out."""
    found = re.findall(r"'((?:\\.|[^'\\\n])*)'|\"((?:\\.|[^\"\\\n])*)\"|`((?:\\.|[^`\\\n])*)`", text)
    return [x for x in (re.sub(r"\\.", "", a or b or c) for a, b, c in found) if x]


def path_tokens(text: str) -> list[str]:
    """Words with a slash that are neither URLs, options, absolute nor variables."""
    words = (w.strip("\"'();,") for w in text.split())
    return [w for w in words if "/" in w and "://" not in w and w[:1] not in ("-", "/", "$")]


def _yaml(text: str) -> list[str]:
    import yaml

    out: list[str] = []

    def scalars(node) -> list[str]:
        if isinstance(node, yaml.ScalarNode):
            return [node.value]
        children = [v for _, v in node.value] if isinstance(node, yaml.MappingNode) else node.value
        return [x for c in children for x in scalars(c)]

    def walk(node) -> None:
        if isinstance(node, yaml.MappingNode):
            for k, v in node.value:
                if k.value in PATH_KEYS:
                    out.extend(line.strip() for x in scalars(v) for line in x.splitlines() if line.strip())
                elif k.value in COMMAND_KEYS:
                    out.extend(t for x in scalars(v) for t in path_tokens(x))
                else:
                    walk(v)
        elif isinstance(node, yaml.SequenceNode):
            for v in node.value:
                walk(v)

    for doc in yaml.compose_all(text):
        if doc is not None:
            walk(doc)
    return out


def _dockerfile(text: str) -> list[str]:
    out = []
    for line in re.sub(r"\\\s*\n", " ", text).splitlines():
        m = re.match(r"\s*(?:COPY|ADD)\s+(.*)", line, re.I)
        if m:
            rest = m[1].strip()
            args = [a.strip().strip('"') for a in rest.strip("[]").split(",")] if rest.startswith("[") else rest.split()
            out += [a for a in args if not a.startswith("--")][:-1]
    return out


def _include(text: str) -> list[str]:
    out, inside = [], False
    for line in map(str.strip, text.splitlines()):
        if line.startswith("#") or not (inside or "include" in line.lower()):
            continue
        out += string_literals(line)
        inside = "]" not in line and (inside or "[" in line)
    return out


def _manifest_in(text: str) -> list[str]:
    out = []
    for words in (x.split() for x in text.splitlines() if x.strip() and not x.strip().startswith("#")):
        if words[0] in ("graft", "recursive-include"):
            out += words[1:2]
        elif words[0] in ("include", "global-include"):
            out += words[1:]
    return out


def _package(text: str) -> list[str]:
    doc = json.loads(text)
    files = doc.get("files") if isinstance(doc, dict) else None
    return [x for x in files if isinstance(x, str)] if isinstance(files, list) else []


def reader(path: str):
    name = posixpath.basename(path)
    if name.lower().endswith((".yml", ".yaml")):
        return _yaml
    if name in ("Dockerfile", "Containerfile") or name.startswith("Dockerfile.") or name.endswith(".Dockerfile"):
        return _dockerfile
    return {
        ".dockerignore": lambda t: [x.strip()[1:] for x in t.splitlines() if x.strip().startswith("!")],
        "MANIFEST.in": _manifest_in,
        "package.json": _package,
        "pyproject.toml": _include,
        "setup.cfg": _include,
        ".gitattributes": lambda t: [x.split()[0] for x in t.splitlines() if x.strip() and not x.strip().startswith("#") and "filter=lfs" in x],
    }.get(name)


#: What points out of the tree or cannot be resolved: a URL, a place from the root or home, a variable.
ELSEWHERE = re.compile(r"://|^[/~]|\$")


def rooted_pattern(pattern: str) -> tuple[str, str] | None:
    """("path", what it roots) or ("suffix", of names); None for what lies outside of the tree.

    A pattern roots what its steps before the first wild one name; one that is wild from the start roots names by suffix if its last step is a star and plain text,
    else everything.
    """
    said = pattern.strip().strip("\"'")
    steps = [x for x in said.split("/") if x not in ("", ".")]
    fixed = list(takewhile(lambda x: not WILD.search(x), steps))
    if not said or ELSEWHERE.search(said) or ".." in fixed:
        return None
    if fixed or said == ".":
        return "path", "/".join(fixed)
    if not steps:
        return None
    star = re.fullmatch(r"\*([^*?\[{]+)", said.rpartition("/")[2])
    return ("suffix", star[1]) if star else ("path", "")


def scan(path: str, text: str | None, status: str) -> list[tuple[str, str, str, int]]:
    """``kind (path, suffix, incomplete), value, detail, pos`` of one manifest."""
    read = reader(path)
    if read is None:
        return []
    if status != "completed" or text is None:
        return [("incomplete", path, status, 0)]
    try:
        patterns = read(text)
    except Exception as e:  # noqa: BLE001  an unreadable manifest makes the whole answer incomplete
        return [("incomplete", path, f"{type(e).__name__}: {e}"[:200], 0)]
    found = ((rooted_pattern(p), i) for i, p in enumerate(patterns))
    return [(*f, path, i) for f, i in found if f]


def tables(files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``rooted(path, reason)``, ``suffixes(suffix, reason)`` and ``incomplete(path, reason)`` of ``files(path, content, read_status)``, for ``reachability_verdicts``.

    Code that enumerates roots its own directory and each directory (or the parent of each file) that one of its literals resolves to, from its place
    or from the root. The first file in path order keeps a root, enumerations before manifests.
    """
    manifests = files.where(r"path rlike '(?i)\\.ya?ml$' or path rlike '(^|/)(Dockerfile[^/]*|[^/]*\\.Dockerfile|Containerfile|\\.dockerignore|MANIFEST\\.in|package\\.json|pyproject\\.toml|setup\\.cfg|\\.gitattributes)$'")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(p, *r) for p, t, s in zip(pdf["path"], pdf["content"], pdf["read_status"]) for r in scan(p, t, s)]
            yield pd.DataFrame(rows, columns=["file", "kind", "value", "detail", "pos"])

    found = manifests.select("path", "content", "read_status").mapInPandas(run, "file string, kind string, value string, detail string, pos int")

    def literals(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(p, c, x.strip(), i) for p, c, t in zip(pdf["path"], pdf["construct"], pdf["content"]) for i, x in enumerate(string_literals(t))]
            yield pd.DataFrame([r for r in rows if r[2] and "://" not in r[2] and not r[2].startswith("/")], columns=["file", "construct", "literal", "pos"])

    read = files.where("read_status = 'completed' and content is not null")
    listed = large(enumerating_files(read)).join(read.select("path", "content"), "path")
    asked = listed.select("path", "construct", "content").mapInPandas(literals, "file string, construct string, literal string, pos int")
    prefix = paths.literal_prefix(F.col("literal"))
    resolved = asked.select("file", "construct", "pos", F.explode(F.array(paths.join_rel(paths.parent(F.col("file")), prefix), paths.normalize(prefix))).alias("path")).where("path is not null and path <> ''")
    names = files.select("path").distinct()
    dirs = names.select(F.explode(paths.ancestors(paths.parent(F.col("path")))).alias("path")).distinct()
    as_dir = large(resolved).join(dirs, "path", "left_semi")
    as_file = large(resolved).join(names, "path", "left_semi").withColumn("path", paths.parent(F.col("path"))).where("path <> ''")
    own = listed.select(F.col("path").alias("file"), "construct", F.lit(-1).alias("pos"), paths.parent(F.col("path")).alias("path"))
    why = F.concat(F.lit("enumerated by "), "construct", F.lit(" in "), "file").alias("reason")
    by_code = own.unionByName(as_dir.select(*own.columns)).unionByName(as_file.select(*own.columns)).select("path", why, "file", F.lit(0).alias("kind_rank"), "pos")
    by_manifest = found.where("kind = 'path'").select(F.col("value").alias("path"), F.concat(F.lit("named in "), "file").alias("reason"), "file", F.lit(1).alias("kind_rank"), "pos")
    suffixes = found.where("kind = 'suffix'").groupBy(F.col("value").alias("suffix")).agg(F.min_by(F.concat(F.lit("named in "), "file"), F.struct("file", "pos")).alias("reason"))
    return first_reason(by_code.unionByName(by_manifest)), suffixes, found.where("kind = 'incomplete'").select(F.col("value").alias("path"), F.col("detail").alias("reason"))
