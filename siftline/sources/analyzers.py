"""Captured output of dead-code analyzers as claims: ``mutant, sut, kind, claim, declared_in`` and violations.

Each row of ``outputs(mutant, sut, text)`` is one run's whole output. One bad record fails its run: what an analyzer said is taken whole or not at all.
Empty output of a tool that always writes a document means it did not run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.operators.suite import dedup_by_name

# Which rules claim a file or a symbol.
SYMBOL_RULES = ("exports", "nsExports", "types", "nsTypes", "enumMembers", "namespaceMembers")
FILE_CODES = ("shear/unlinked_files", "shear/empty_files")
LINE = r"^(.+?):(\d+): (?:unused ([a-z_]+) '(.+)'|unreachable code after '(.+)'|unsatisfiable '(.+)' condition) \((\d+)% confidence(?:, \d+ lines?)?\)$"


def _whole(rows: DataFrame, bad: Column) -> tuple[DataFrame, DataFrame]:
    failed = rows.where(bad).groupBy("mutant", "sut").agg(F.count(F.lit(1)).alias("bad"))
    return rows.join(failed, ["mutant", "sut"], "left_anti"), failed


def line_findings(outputs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One finding a line, ``path:line: unused kind 'name' (n% confidence)``: symbols only."""
    lines = outputs.select("mutant", "sut", F.explode(F.split(F.coalesce("text", F.lit("")), r"\r?\n")).alias("line")).where("trim(line) <> ''")
    good, failed = _whole(lines, ~F.col("line").rlike(LINE) | (F.regexp_extract("line", LINE, 7).cast("int") > 100))
    part = lambda i: F.regexp_extract("line", LINE, i)
    claims = good.where(part(4) != "").select("mutant", "sut", F.lit("symbol").alias("kind"), part(4).alias("claim"), part(1).alias("declared_in"))
    return dedup_by_name(claims), failed


def package_findings(outputs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A JSON array of packages with unreachable functions (null: none found): symbols only, generated ones included."""
    v = F.try_parse_json("text")
    rows = outputs.select("mutant", "sut", "text", v.alias("v")).withColumn("all", F.try_variant_get("v", "$", "array<variant>"))
    null = F.trim("text") == "null"
    packages = rows.select("mutant", "sut", F.explode_outer("all").alias("p"), (F.col("v").isNull() | (F.col("all").isNull() & ~null)).alias("broken"))
    get = lambda c, path, kind: F.try_variant_get(c, path, kind)
    funcs = get(F.col("p"), "$.Funcs", "array<variant>")
    good, failed = _whole(packages, F.col("broken") | (F.col("p").isNotNull() & (funcs.isNull() | get(F.col("p"), "$.Path", "string").isNull())))
    each = good.select("mutant", "sut", F.explode(funcs).alias("f"))
    name, file = get(F.col("f"), "$.Name", "string"), get(F.col("f"), "$.Position.File", "string")
    whole, more = _whole(each, name.isNull() | file.isNull())
    claims = whole.select("mutant", "sut", F.lit("symbol").alias("kind"), name.alias("claim"), file.alias("declared_in"))
    return dedup_by_name(claims), failed.unionByName(more)


def log_findings(outputs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A log with exactly one run: files become paths, exports and members symbols; claims about manifests are neither."""
    v = F.try_parse_json("text")
    runs = F.try_variant_get("v", "$.runs", "array<variant>")
    rows = outputs.select("mutant", "sut", v.alias("v")).withColumn("n", F.coalesce(F.size(runs), F.lit(-1)))
    good, failed = _whole(rows, F.col("n") != 1)
    each = good.select("mutant", "sut", F.explode(F.coalesce(F.try_variant_get("v", "$.runs[0].results", "array<variant>"), F.array().cast("array<variant>"))).alias("r"))
    rule = F.regexp_extract(F.try_variant_get("r", "$.ruleId", "string"), "([^/]*)$", 1)
    message = F.try_variant_get("r", "$.message.text", "string")
    uri = F.try_variant_get("r", "$.locations[0].physicalLocation.artifactLocation.uri", "string")
    payload = F.regexp_replace(F.regexp_extract(message, r"(?s)^[^:]*: (.*)$", 1), r"\s*\([^()]*\)$", "")
    kind = F.when(rule == "files", "path").when(rule.isin(*SYMBOL_RULES), "symbol")
    named = each.select("mutant", "sut", kind.alias("kind"), F.when(kind == "path", uri).when(kind == "symbol", payload).alias("claim"), uri.alias("declared_in"), (rule.isNull() | message.isNull()).alias("broken"))
    whole, more = _whole(named, F.col("broken") | (F.col("kind").isNotNull() & (F.coalesce("claim", F.lit("")) == "")))
    claims = whole.where("kind is not null").select("mutant", "sut", "kind", "claim", F.when(F.col("kind") == "symbol", F.col("declared_in")).alias("declared_in"))
    return dedup_by_name(claims), failed.unionByName(more)


def summary_findings(outputs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A JSON object whose summary counts its findings: paths only. Counts that disagree, or a run that repaired anything, fail."""
    v = F.try_parse_json("text")
    rows = outputs.select("mutant", "sut", v.alias("v")).select(
        "mutant", "sut", F.try_variant_get("v", "$.findings", "array<variant>").alias("found"),
        *[F.try_variant_get("v", f"$.summary.{k}", "int").alias(k) for k in ("errors", "warnings", "fixed")],
    )
    bad = F.col("found").isNull() | F.col("errors").isNull() | F.col("warnings").isNull() | (F.coalesce("fixed", F.lit(0)) != 0) | (F.col("errors") + F.col("warnings") != F.size("found"))
    good, failed = _whole(rows, F.coalesce(bad, F.lit(True)))
    each = good.select("mutant", "sut", F.explode("found").alias("f"))
    code = F.try_variant_get("f", "$.code", "string")
    files = F.coalesce(F.try_variant_get("f", "$.files", "array<string>"), F.try_variant_get("f", "$.paths", "array<string>"), F.array(F.try_variant_get("f", "$.file", "string")))
    claims = each.where(code.isin(*FILE_CODES)).select("mutant", "sut", F.lit("path").alias("kind"), F.explode(files).alias("claim"), F.lit(None).cast("string").alias("declared_in")).where("claim is not null")
    return dedup_by_name(claims), failed
