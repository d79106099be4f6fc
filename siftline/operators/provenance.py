"""Class 1j: content that is not the repository's own. Submodules, third parties' directories and generated files, by patterns that come as a table."""

from __future__ import annotations

import re
import warnings
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.functions import paths
from siftline.functions.text import ascii_lower
from siftline.operators import generated, veto
from siftline.sources.lineage import kept, large

#: Patterns from which no literal can be drawn are tested one by one on every path; there may be so many of them.
MOST_LOOSE = 1_000
#: Evidence in the order in which it counts.
EVIDENCE = ("attribute", "submodule", "vendored", "generated_path", "generated_content")


def required_literals(pattern: str | None) -> list[str]:
    """All runs of ASCII characters that every match of a regular expression holds, in lower case; none if none can be told.

    Only what is matched always counts: no alternatives, nothing optional. What this reader of expressions does not know gives nothing.
    """
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            parsed = re._parser.parse(pattern or "")
    except (re.error, OverflowError, RecursionError):
        return []
    runs: list[str] = []
    run = ""

    def end() -> None:
        nonlocal run
        if run and run not in runs:
            runs.append(run)
        run = ""

    def walk(items) -> None:
        nonlocal run
        for op, of in items:
            name = str(op)
            if name == "LITERAL" and of < 128:
                run += chr(of).lower()
            elif name == "SUBPATTERN":
                walk(of[3])
            elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
                end()
                if of[0] > 0:
                    walk(of[2])
                end()
            elif name != "AT":
                end()

    walk(parsed)
    end()
    return runs


def required_literal(pattern: str | None) -> str:
    """The longest of ``required_literals``, the first of several; empty if there is none."""
    return max(required_literals(pattern), key=len, default="")


def meetings(rules: DataFrame, few: DataFrame) -> DataFrame:
    """``path, kind, idx, pattern, rule``: of ``rules`` (no, kind, idx, pattern, rule, needles) those whose rarest literal a path of ``few`` holds."""
    each = rules.select("no", F.explode("needles").alias("needle"))
    held = kept(veto.containing(each, few.withColumn("content", ascii_lower(F.col("path")))).select("needle", "path"))
    counts = held.groupBy("needle").agg(F.count(F.lit(1)).alias("paths"))
    # A literal that no path holds is the rarest of all, and its patterns meet nothing.
    rarest = large(each).join(counts, "needle", "left").groupBy("no").agg(F.min(F.struct(F.coalesce("paths", F.lit(0)).alias("paths"), "needle")).alias("r")).where("r.paths > 0").select("no", "r.needle")
    ruled = large(rarest).join(rules.select("no", "kind", "idx", "pattern", "rule"), "no")
    return large(held).join(ruled, "needle").select("path", "kind", "idx", "pattern", "rule")


def all_matches(files: DataFrame, patterns: DataFrame) -> DataFrame:
    """``path, kind, idx, rule``: the ``patterns`` (kind, idx, pattern, rule) that find something in a path.

    Every path meets only patterns whose rarest required literal it holds (a host that many patterns and paths share says little beside a name of one): all literals are looked for in one pass over the
    paths, which counts them, too, and the expression itself decides after an equi-join. Patterns without one, at most ``MOST_LOOSE``, are tested on every path, without a join. Patterns are Java regular expressions.
    """
    literals = F.udf(lambda p: required_literals(p), "array<string>")
    rules = kept(patterns.select("kind", "idx", "pattern", "rule", literals("pattern").alias("needles")).withColumn("no", F.monotonically_increasing_id()))
    loose = rules.where("size(needles) = 0").select("kind", "idx", "pattern", "rule").limit(MOST_LOOSE + 1).collect()
    if len(loose) > MOST_LOOSE:
        raise ValueError(f"over {MOST_LOOSE} patterns without a literal")
    few = files.select("path").distinct()
    hit = meetings(rules, few).where(F.regexp_like("path", F.col("pattern"))).select("path", "kind", "idx", "rule")
    if loose:
        tests = [F.when(F.rlike(F.col("path"), F.lit(p)), F.struct(F.lit(k).alias("kind"), F.lit(i).cast(patterns.schema["idx"].dataType).alias("idx"), F.lit(r).alias("rule"))) for k, i, p, r in loose]
        found = few.select("path", F.explode(F.filter(F.array(*tests), lambda x: x.isNotNull())).alias("r"))
        hit = hit.unionByName(found.select("path", "r.*"))
    return hit


def pattern_matches(files: DataFrame, patterns: DataFrame) -> DataFrame:
    """``path, kind, idx, rule``: of ``all_matches`` the first by ``idx`` of each path and kind."""
    hit = all_matches(files, patterns)
    return hit.groupBy("path", "kind").agg(F.min(F.struct("idx", "rule")).alias("r")).select("path", "kind", "r.idx", "r.rule")


def submodules(files: DataFrame) -> DataFrame:
    """``declared``: the paths that the root's ``.gitmodules`` names. Comments and other keys say nothing."""
    line = F.btrim(F.col("line"), F.lit(" \t\r"))
    lines = files.where("path = '.gitmodules' and text is not null").select(F.explode(F.split("text", "\n")).alias("line")).select(line.alias("line"))
    said = lines.where(~F.startswith("line", F.lit("#")) & ~F.startswith("line", F.lit(";")) & (F.instr("line", "=") > 0))
    trim = lambda c: F.btrim(c, F.lit(" \t"))
    key, value = trim(F.substring_index("line", "=", 1)), trim(F.substring(F.col("line"), F.instr("line", "=") + 1, F.length("line")))
    return said.where((key == "path") & (value != "")).select(F.regexp_replace(value, "/+$", "").alias("declared")).distinct()


def provenance(files: DataFrame, patterns: DataFrame, attributes: DataFrame | None = None) -> DataFrame:
    """``path, evidence, rule`` of files (path, text) that are not the repository's own, by the first kind of ``EVIDENCE`` that holds.

    ``patterns`` are those of ``pattern_matches`` with the kinds ``vendored`` and ``generated_path``; ``attributes`` (path, attribute, is_set) are what ``rules.last_match`` says of linguist's attributes.
    A path lies under a submodule at a component boundary. A text that is null was not read, and only its path is judged.
    """
    rank = lambda name: F.lit(EVIDENCE.index(name)).alias("rank")
    up = files.select("path", F.explode(paths.ancestors(F.col("path"))).alias("declared"))
    inside = up.join(submodules(files), "declared").select("path", rank("submodule"), F.lit(0).cast("long").alias("idx"), F.lit(".gitmodules").alias("rule"))
    by_path = pattern_matches(files, patterns)
    named = by_path.select("path", F.when(F.col("kind") == "vendored", EVIDENCE.index("vendored")).otherwise(EVIDENCE.index("generated_path")).alias("rank"), F.col("idx").cast("long").alias("idx"), "rule")
    said = files.select("path", rank("generated_content"), F.lit(0).cast("long").alias("idx"), generated.generated(F.col("path"), F.col("text")).alias("rule")).where("rule is not null")
    every = [inside, named, said]
    if attributes is not None:
        own = attributes.where("is_set and attribute like 'linguist-%'")
        every.append(own.select("path", rank("attribute"), F.lit(0).cast("long").alias("idx"), F.col("attribute").alias("rule")))
    first = reduce(DataFrame.unionByName, every).groupBy("path").agg(F.min(F.struct("rank", "idx", "rule")).alias("r"))
    return first.select("path", F.element_at(F.array(*[F.lit(e) for e in EVIDENCE]), F.col("r.rank") + 1).alias("evidence"), "r.rule")
