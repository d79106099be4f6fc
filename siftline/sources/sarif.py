"""SARIF logs and baselines as DataFrames.

A log is one JSON text. It is parsed once into a VARIANT, exploded inside the engine, and every refusal is a row with a ``violation``:
a location that does not resolve is not dropped, because that would turn a finding about a file into one about the repository.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.functions import paths
from siftline.operators.ratchet import primary_uri

# Closed domains.
LEVELS, STATES = ("none", "note", "warning", "error"), ("new", "unchanged", "updated", "absent")
KINDS, STATUSES = ("inSource", "external"), ("accepted", "underReview", "rejected")
BASELINE = "fingerprint string, rule_id string, uri string, symbol string, first_seen string, expires string, justification string"


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """``log, text``: one row a file."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("log"), F.col("value").alias("text"))


def _get(v: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(v, path, kind)


def _each(v: Column, path: str) -> Column:
    return F.coalesce(_get(v, path, "array<variant>"), F.array().cast("array<variant>"))


def runs(logs: DataFrame) -> DataFrame:
    """``log, run, doc, wire, violation``: a row for each run; a log that is not JSON is one row with a violation."""
    parsed = logs.withColumn("v", F.try_parse_json("text")).withColumn("all", _each(F.col("v"), "$.runs"))
    wire = F.exists("all", lambda r: _get(r, "$.tool.driver", "variant").isNotNull())
    good = parsed.withColumn("wire", wire).select("log", "wire", F.posexplode("all").alias("run", "doc"))
    bad = F.when(F.col("wire") & _get(F.col("doc"), "$.tool.driver", "variant").isNull(), "tool has no driver")
    ok = good.select("log", "run", "doc", "wire", bad.alias("violation"))
    broken = parsed.where("v is null").select("log", F.lit(0).alias("run"), "v", F.lit(False).alias("wire"), F.lit("not JSON").alias("violation")).toDF("log", "run", "doc", "wire", "violation")
    return ok.unionByName(broken)


def tools(found: DataFrame) -> DataFrame:
    d = F.col("doc")
    return found.select("log", "run", F.when(F.col("wire"), _get(d, "$.tool.driver.name", "string")).otherwise(_get(d, "$.tool.name", "string")).alias("tool"))


def invocations(found: DataFrame) -> DataFrame:
    """``log, run, idx, execution_successful``: the one place where no answer counts as no."""
    v = F.col("i")
    rows = found.select("log", "run", "wire", F.posexplode(_each(F.col("doc"), "$.invocations")).alias("idx", "i"))
    bit = F.coalesce(_get(v, "$.executionSuccessful", "boolean"), _get(v, "$.execution_successful", "boolean"), F.lit(False))
    return rows.select("log", "run", "idx", bit.alias("execution_successful"), "i")


def notifications(found: DataFrame) -> DataFrame:
    """``log, run, idx, nth, level, message``; an absent level is a warning."""
    rows = invocations(found)
    both = F.concat(_each(F.col("i"), "$.toolExecutionNotifications"), _each(F.col("i"), "$.tool_execution_notifications"))
    n = rows.select("log", "run", "idx", F.posexplode(both).alias("nth", "n"))
    message = F.coalesce(_get(F.col("n"), "$.message.text", "string"), _get(F.col("n"), "$.message", "string"))
    return n.select("log", "run", "idx", "nth", F.coalesce(_get(F.col("n"), "$.level", "string"), F.lit("warning")).alias("level"), message.alias("message"))


def _uri(a: Column) -> Column:
    return F.coalesce(_get(a, "$.location.uri", "string"), _get(a, "$.location_uri", "string"))


def artifacts(found: DataFrame) -> DataFrame:
    rows = found.select("log", "run", F.posexplode(_each(F.col("doc"), "$.artifacts")).alias("idx", "a"))
    return rows.select("log", "run", "idx", _uri(F.col("a")).alias("uri"), F.coalesce(_get(F.col("a"), "$.roles", "array<string>"), F.array().cast("array<string>")).alias("roles"))


def _rule(r: Column) -> tuple[Column, Column]:
    return _get(r, "$.id", "string").alias("id"), _get(r, "$.defaultConfiguration.level", "string").alias("level")


def rules(found: DataFrame) -> DataFrame:
    rows = found.select("log", "run", F.posexplode(_each(F.col("doc"), "$.tool.driver.rules")).alias("idx", "r"))
    return rows.select("log", "run", "idx", *_rule(F.col("r")))


def findings(found: DataFrame) -> DataFrame:
    """``log, run, seq, rule_id, level, message, uri, locations, partial_fingerprints, baseline_state, suppressions, violation``: a row for each result.

    The rule is named by its id, else by its index; the level is the result's, the rule's by id, by index, or warning; a location's own uri
    beats its index into the artifacts. Whatever does not resolve or leaves its domain is said in ``violation``. A run's rules and artifacts stand in
    its own document and go along with its results, so nothing is joined or moved.
    """
    d, doc = F.col("r"), F.col("doc")
    own = found.where("violation is null").select(
        "log", "run", F.transform(_each(doc, "$.tool.driver.rules"), lambda r: F.struct(*_rule(r))).alias("rules"), F.transform(_each(doc, "$.artifacts"), _uri).alias("uris"), _each(doc, "$.results").alias("results")
    )
    res = own.select("log", "run", "rules", "uris", F.posexplode("results").alias("seq", "r"))
    j = res.select(
        "log", "run", "seq", "rules", "uris",
        F.coalesce(_get(d, "$.ruleId", "string"), _get(d, "$.rule_id", "string")).alias("own_rule"),
        _get(d, "$.ruleIndex", "long").alias("rule_index"),
        _get(d, "$.level", "string").alias("own_level"),
        F.coalesce(_get(d, "$.message.text", "string"), _get(d, "$.message", "string")).alias("message"),
        F.coalesce(_get(d, "$.partialFingerprints", "map<string,string>"), _get(d, "$.partial_fingerprints", "map<string,string>"), F.create_map().cast("map<string,string>")).alias("partial_fingerprints"),
        F.coalesce(_get(d, "$.baselineState", "string"), _get(d, "$.baseline_state", "string")).alias("baseline_state"),
        F.transform(_each(d, "$.suppressions"), lambda s: F.struct(_get(s, "$.kind", "string").alias("kind"), _get(s, "$.status", "string").alias("status"), _get(s, "$.justification", "string").alias("justification"))).alias("suppressions"),
        F.transform(_each(d, "$.locations"), lambda x: F.struct(
            F.coalesce(_get(x, "$.physicalLocation.artifactLocation.uri", "string"), _get(x, "$.uri", "string")).alias("uri"),
            _get(x, "$.physicalLocation.artifactLocation.index", "long").alias("index"),
            F.coalesce(_get(x, "$.physicalLocation.region.startLine", "long"), _get(x, "$.start_line", "long")).alias("start_line"),
        )).alias("given"),
    )
    by_index = F.get("rules", F.col("rule_index").cast("int"))
    rule = F.coalesce("own_rule", by_index["id"])
    by_id = F.get(F.filter("rules", lambda r: r["id"] == rule), F.lit(0))["level"]
    level = F.coalesce("own_level", by_id, by_index["level"], F.lit("warning"))
    places = F.transform("given", lambda x: F.struct(F.coalesce(x["uri"], F.get("uris", x["index"].cast("int"))).alias("uri"), x["start_line"].alias("start_line")))
    wrong = F.filter(
        F.array(
            F.when(F.col("rule_index").isNotNull() & by_index.isNull(), "ruleIndex names no rule"),
            F.when(rule.isNull(), "neither ruleId nor a rule with an id"),
            F.when(~level.isin(*LEVELS), "level outside its domain"),
            F.when(F.col("message").isNull(), "no message.text"),
            F.when(~F.col("baseline_state").isin(*STATES), "baselineState outside its domain"),
            F.when(F.exists("suppressions", lambda s: s["kind"].isNull() | ~s["kind"].isin(*KINDS)), "suppression kind outside its domain"),
            F.when(F.exists("suppressions", lambda s: s["status"].isNull() | ~s["status"].isin(*STATUSES)), "suppression without a status in its domain"),
            F.when(F.exists(places, lambda p: p["uri"].isNull()), "a location that names no file"),
            F.when(F.exists(places, lambda p: p["uri"].isNotNull() & ~paths.is_repo_relative(p["uri"])), "a uri that is not relative to the repository"),
        ),
        lambda x: x.isNotNull(),
    )
    out = j.select("log", "run", "seq", rule.alias("rule_id"), level.alias("level"), "message", places.alias("locations"), "partial_fingerprints", "baseline_state", "suppressions", F.nullif(F.array_join(wrong, "; "), F.lit("")).alias("violation"))
    return out.withColumn("uri", primary_uri(F.col("locations")))


def read_baseline(lines: DataFrame) -> DataFrame:
    """``seq, fingerprint, ..., violation`` of ``lines(seq, value)``: blank lines are skipped, a bad line or an empty fingerprint is a violation with its number."""
    rows = lines.where(F.trim("value") != "").select("seq", F.from_json("value", BASELINE + ", _bad string", {"columnNameOfCorruptRecord": "_bad"}).alias("e"))
    names = [c.split()[0] for c in BASELINE.split(", ")]
    wrong = F.when(F.col("e._bad").isNotNull(), "not a baseline entry").when(F.coalesce(F.col("e.fingerprint"), F.lit("")) == "", "no fingerprint")
    said = F.when(wrong.isNotNull(), F.concat(F.lit("line "), F.col("seq").cast("string"), F.lit(": "), wrong))
    return rows.select("seq", *[F.col(f"e.{n}").alias(n) for n in names], said.alias("violation"))


def baseline_lines(baseline: DataFrame) -> DataFrame:
    """``seq, value``: JSON lines in order; optional keys without a value are left out."""
    names = [c.split()[0] for c in BASELINE.split(", ")]
    return baseline.select("seq", F.to_json(F.struct(*names), {"ignoreNullFields": "true"}).alias("value")).orderBy("seq")
