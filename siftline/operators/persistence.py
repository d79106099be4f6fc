"""Gate 3f: names that live on in stored bytes, queued payloads or a binary interface."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.functions import paths
from siftline.functions.text import any_of, ascii_lower
from siftline.sources.lineage import large

# Markers and frameworks.
SERIALIZATION = (
    "serialVersionUID", "__reduce__", "__getstate__", "__setstate__", "readObject", "writeObject", "[Serializable]", "implements Serializable", "BinaryFormatter", "Marshal.load", "Marshal.dump",
    "pickle.load", "pickle.dump",
)
ABI = ("#[no_mangle]", "#[unsafe(no_mangle)]", "//export ", 'extern "C"', "JNIEXPORT", "__declspec(dllexport)", "@_cdecl", "@_spi(", "-fvisibility=default", "soname")
DERIVE = "a serde derive"
FRAMEWORKS = ("sidekiq", "celery", "activejob", "resque", "bull", "hangfire", "rq", "dramatiq", "temporal")
MANIFESTS = ("package.json", "requirements.txt", "pyproject.toml", "Pipfile", "Gemfile", "go.mod", "Cargo.toml", "composer.json", "build.gradle", "pom.xml")
NEAR = 3


def marker_matches(line: Column, marker: str) -> Column:
    """A marker of identifier characters stands as a word, any other anywhere."""
    if all(c.isalnum() and c.isascii() or c == "_" for c in marker):
        return line.rlike(rf"(?<![A-Za-z0-9_]){marker}(?![A-Za-z0-9_])")
    return F.contains(line, F.lit(marker))


def lines(files: DataFrame) -> DataFrame:
    """``path, line, text``: numbered from 1, without a carriage return and without an empty last line."""
    split = F.split(F.regexp_replace("text", r"\n$", ""), "\n", -1)
    return files.select("path", F.posexplode(split).alias("i", "raw")).select("path", (F.col("i") + 1).alias("line"), F.regexp_replace("raw", r"\r$", "").alias("text"))


def is_import(low: Column) -> Column:
    t = F.ltrim(low)
    return any_of([F.startswith(t, F.lit(x)) for x in ("import ", "from ", "use ", "require ", "#include", "gem ")]) | F.contains(t, F.lit("require("))


def is_binding(low: Column) -> Column:
    return F.startswith(F.ltrim(low), F.lit("@")) | any_of([F.contains(low, F.lit(x)) for x in ("class ", "extends ", "include ")])


def components(low: Column) -> Column:
    return F.split(low, "[^A-Za-z0-9]")


def frameworks(files: DataFrame) -> DataFrame:
    """``framework, found_in, line``: job frameworks that the tree declares, each at its first place by (path, line)."""
    rows = lines(files).withColumn("low", F.lower("text")).where(paths.basename(F.col("path")).isin(*MANIFESTS) | is_import(F.col("low")))
    named = rows.select("path", "line", F.explode(F.array_intersect(components(F.col("low")), F.array(*map(F.lit, FRAMEWORKS)))).alias("framework"))
    return named.groupBy("framework").agg(F.min(F.struct("path", "line")).alias("r")).select("framework", F.col("r.path").alias("found_in"), "r.line")


def queue_references(files: DataFrame, found: DataFrame) -> DataFrame:
    """``path, framework, found_in, line``: files whose imports or bindings name a declared framework; of several the one discovered first."""
    rows = lines(files).withColumn("low", F.lower("text")).where(is_import(F.col("low")) | is_binding(F.col("low")))
    named = rows.select("path", F.explode(components(F.col("low"))).alias("framework")).distinct()
    order = F.create_map(*[F.lit(x) for i, f in enumerate(FRAMEWORKS) for x in (f, i)])
    j = named.join(F.broadcast(found), "framework")  # at most as many rows as there are frameworks
    first = j.groupBy("path").agg(F.min(F.struct("found_in", "line", order[F.col("framework")].alias("o"), "framework")).alias("r"))
    return first.select("path", "r.framework", "r.found_in", "r.line")


def nearby(marked: DataFrame, all_lines: DataFrame, within: int = NEAR) -> DataFrame:
    """``marked(path, line, symbol, marker)`` whose symbol stands on the line or up to ``within`` lines below, before a blank one.

    A range join as equi-joins: a mark is exploded into the few lines it can reach.
    """
    reach = marked.select("path", "line", "marker", "symbol", F.explode(F.sequence(F.lit(0), F.lit(within))).alias("off")).withColumn("at", F.col("line") + F.col("off"))
    t = all_lines.select("path", F.col("line").alias("at"), "text")
    seen = large(reach).join(t, ["path", "at"]).withColumn("blank", (F.col("off") > 0) & (F.trim("text") == ""))
    bare = F.regexp_extract("symbol", r"([^.:/#]*)$", 1)
    word = F.regexp_like("text", F.concat(F.lit(r"(?<![A-Za-z0-9_])\Q"), bare, F.lit(r"\E(?![A-Za-z0-9_])"))) & (bare != "")
    g = seen.groupBy("path", "line", "marker", "symbol").agg(F.min(F.when(F.col("blank"), F.col("off"))).alias("stop"), F.min(F.when(word, F.col("off"))).alias("hit"))
    return g.where("hit is not null and (stop is null or hit < stop)").select("path", "line", "marker", "symbol")


def scan(candidates: DataFrame, files: DataFrame) -> DataFrame:
    """``candidate, condition, marker, found_in, line``: the first line of each (condition, marker).

    ``candidates(candidate, path, symbol)``; files that could not be read have no row in ``files`` and yield nothing here. A symbol
    without a declaration site has a null path and passes.
    """
    wanted = large(files).join(candidates.select("path").distinct(), "path", "left_semi")
    every = lines(wanted)
    marks = [F.when(marker_matches(F.col("text"), m), F.struct(F.lit("serializable").alias("condition"), F.lit(m).alias("marker"))) for m in SERIALIZATION]
    derive = F.contains("text", F.lit("#[derive(")) & (F.contains("text", F.lit("Serialize")) | F.contains("text", F.lit("Deserialize")))
    marks.append(F.when(derive, F.struct(F.lit("serializable").alias("condition"), F.lit(DERIVE).alias("marker"))))
    marks += [F.when(marker_matches(F.col("text"), m), F.struct(F.lit("abi_export").alias("condition"), F.lit(m).alias("marker"))) for m in ABI]
    hit = every.select("path", "line", F.explode(F.filter(F.array(*marks), lambda m: m.isNotNull())).alias("m")).select("path", "line", "m.*")
    c = candidates.select("candidate", "path", "symbol")
    of = large(hit).join(c, "path")
    whole = of.where("condition = 'serializable' or symbol is null").select("candidate", "condition", "marker", F.col("path").alias("found_in"), "line")
    asked = of.where("condition = 'abi_export' and symbol is not null").select("path", "line", "marker", "symbol").distinct()
    near = large(nearby(asked, every)).join(c, ["path", "symbol"]).select("candidate", F.lit("abi_export").alias("condition"), "marker", F.col("path").alias("found_in"), "line")
    queue = large(queue_references(wanted, frameworks(files))).join(c, "path").select("candidate", F.lit("queue_payload").alias("condition"), F.col("framework").alias("marker"), "found_in", "line")
    rows = whole.unionByName(near).unionByName(queue)
    return rows.groupBy("candidate", "condition", "marker").agg(F.min_by("found_in", "line").alias("found_in"), F.min("line").alias("line"))
