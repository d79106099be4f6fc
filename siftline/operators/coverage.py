"""Coverage: what a test run called, with a positive control, used only to rescue claims."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.functions import paths
from siftline.functions.text import bare_suffixes, names_same_symbol
from siftline.sources import coverage as lcov
from siftline.sources.lineage import large


def merge(functions: DataFrame, lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Records of one source summed: ``source, name, start_line, calls`` and ``source, lines_found, lines_hit``.

    ``functions(source, seq, name, start_line, calls)`` with null calls for a declaration, ``lines(source, line, count)``. A function that was declared
    and never counted has zero calls; the first start line stays; a line is hit when its counts sum to more than zero.
    """
    f = functions.groupBy("source", "name").agg(F.min_by("start_line", F.when(F.col("start_line").isNotNull(), F.col("seq"))).alias("start_line"), F.sum(F.coalesce("calls", F.lit(0))).alias("calls"))
    per_line = lines.groupBy("source", "line").agg(F.sum("count").alias("count"))
    per_file = per_line.groupBy("source").agg(F.count(F.lit(1)).alias("lines_found"), F.count_if(F.col("count") > 0).alias("lines_hit"))
    return f, per_file


def executed_files(functions: DataFrame, files: DataFrame) -> DataFrame:
    """``source``: a line was hit or a function called."""
    called = functions.where("calls > 0").select("source")
    return files.where("lines_hit > 0").select("source").union(called).distinct()


def rescued_paths(claims: DataFrame, executed: DataFrame) -> DataFrame:
    """``claim, source``: executed sources that end with the claimed path; of several the shortest, then the first.

    The suffixes of a source are its keys: an equi-join, and not a comparison of all with all.
    """
    keyed = executed.select("source", F.explode(paths.suffixes(F.regexp_replace(F.replace(F.col("source"), F.lit("\\"), F.lit("/")), "^(?:\\./)+", ""))).alias("claim"))
    return claims.select("claim").distinct().join(large(keyed), "claim").groupBy("claim").agg(F.min_by("source", F.struct(F.length("source"), "source")).alias("source"))


def rescued_symbols(claims: DataFrame, functions: DataFrame) -> DataFrame:
    """``claim, source, name``: called functions that name the claimed symbol or are named by it; the first by (source, name)."""
    called = functions.where("calls > 0 and name <> ''").select("source", "name")
    by_bare = called.select("source", "name", F.explode(bare_suffixes(F.col("name"))).alias("key"))
    asked = claims.select("claim").distinct().where("claim <> ''").select("claim", F.explode(bare_suffixes(F.col("claim"))).alias("key"))
    # One of the two is a tail of the other, and that tail is a key of both.
    both = large(asked).join(by_bare, "key").where(names_same_symbol(F.col("claim"), F.col("name")))
    return both.groupBy("claim").agg(F.min(F.struct("source", "name")).alias("r")).select("claim", "r.source", "r.name")


def control(symbols: DataFrame, functions: DataFrame, floor: int | None = None) -> DataFrame:
    """One row ``declared, uncalled, called_functions, floor, passed``: every declared symbol called, and calls at or above the floor.

    A control without symbols asserts nothing and does not pass.
    """
    declared = symbols.select(F.col("symbol").alias("claim")).distinct()
    missing = declared.join(rescued_symbols(declared, functions), "claim", "left_anti").agg(F.count(F.lit(1)).alias("uncalled"))
    n = declared.agg(F.count(F.lit(1)).alias("declared"))
    called = functions.where("calls > 0").agg(F.count(F.lit(1)).alias("called_functions"))
    j = n.crossJoin(F.broadcast(missing)).crossJoin(F.broadcast(called))  # one row each
    least = F.col("declared") if floor is None else F.lit(floor)
    return j.select("declared", "uncalled", "called_functions", least.alias("floor"), ((F.col("declared") > 0) & (F.col("uncalled") == 0) & (F.col("called_functions") >= least)).alias("passed"))


def rescue(claims: DataFrame, functions: DataFrame, files: DataFrame, passed: DataFrame) -> DataFrame:
    """Claims that coverage rescues, ``kind, claim, source``; none if the control did not pass: silence proves nothing."""
    p = rescued_paths(claims.where("kind = 'path'"), executed_files(functions, files)).select(F.lit("path").alias("kind"), "claim", "source")
    s = rescued_symbols(claims.where("kind = 'symbol'"), functions).select(F.lit("symbol").alias("kind"), "claim", "source")
    return p.unionByName(s).crossJoin(F.broadcast(passed.select("passed"))).where("passed").drop("passed")  # one row


def load(asked: DataFrame, tracefiles: DataFrame, controls: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``artifact, gap, declared, uncalled, called_functions``; and the functions and lines of the artifacts without a gap.

    ``asked(artifact)`` names what is wanted, ``tracefiles`` and ``controls`` (artifact, text) are what is there. A gap is ``no_artifact``, ``no_control``, ``unreadable`` (the control, else the
    tracefile) or ``control_failed``, looked for in this order; the numbers are those of a control that ran. No artifact says anything before its control passed. All artifacts are judged in
    one plan, each for itself.
    """
    functions, lines, bad = lcov.parse(tracefiles)
    told, odd = lcov.control(controls)
    declared = told.where("symbol is not null").select("artifact", "symbol").distinct()
    calls = functions.where("calls > 0 and name <> ''").select("artifact", "source", "name").distinct()
    by_bare = calls.select("artifact", "name", F.explode(bare_suffixes(F.col("name"))).alias("key"))
    wanted = declared.select("artifact", "symbol", F.explode(bare_suffixes(F.col("symbol"))).alias("key"))
    met = wanted.join(by_bare, ["artifact", "key"]).where(names_same_symbol(F.col("symbol"), F.col("name"))).select("artifact", "symbol").distinct().withColumn("met", F.lit(True))
    sums = declared.join(met, ["artifact", "symbol"], "left").groupBy("artifact").agg(F.count(F.lit(1)).alias("declared"), F.count_if(F.col("met").isNull()).alias("uncalled"))
    floors = told.groupBy("artifact").agg(F.max("floor").alias("floor"))
    called = calls.groupBy("artifact").agg(F.count(F.lit(1)).alias("called_functions"))
    mark = lambda df, name: df.select("artifact").distinct().withColumn(name, F.lit(True))
    j = asked.select("artifact").distinct()
    for other in (mark(tracefiles, "there"), mark(controls, "controlled"), mark(odd, "odd"), mark(bad, "broken"), sums, floors, called):
        j = j.join(other, "artifact", "left")
    n = {c: F.coalesce(F.col(c), F.lit(0)) for c in ("declared", "uncalled", "called_functions")}
    passed = (n["declared"] > 0) & (n["uncalled"] == 0) & (n["called_functions"] >= F.coalesce("floor", n["declared"]))
    gap = (
        F.when(F.col("there").isNull(), "no_artifact").when(F.col("controlled").isNull(), "no_control").when(F.col("odd") | F.col("broken"), "unreadable").when(~passed, "control_failed")
    )
    ran = gap.isNull() | (gap == "control_failed")
    out = j.select("artifact", gap.alias("gap"), *[F.when(ran, c).alias(name) for name, c in n.items()])
    good = out.where("gap is null").select("artifact")
    return out, functions.join(good, "artifact"), lines.join(good, "artifact")
