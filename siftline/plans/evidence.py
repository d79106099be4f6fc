"""Whole questions: is the ratchet tight, what holds for one path, which claims survive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.operators import coverage, gates, ignore, ledger, persistence, ratchet, roots, rules, suite, veto
from siftline.sources import reachability, sarif
from siftline.sources.lineage import large


def tighten(logs: DataFrame, baseline: DataFrame, files: DataFrame, now: str, expected: int = 0) -> dict[str, DataFrame]:
    """The ratchet over SARIF logs: ``violations``, ``health``, ``rot``, ``new``, ``verdict``.

    Health is decided for each run, rot over all of them together; a violation in any log or a failed run refuses. ``expected`` is the number of
    targets a run should declare; 0 means that its coverage cannot be validated.
    """
    found = sarif.runs(logs)
    run = F.concat_ws("#", "log", F.col("run").cast("string")).alias("run")
    key = lambda df: df.select(run, *[c for c in df.columns if c not in ("log", "run", "i")])
    tools = key(sarif.tools(found)).withColumn("expected_targets", F.lit(expected))
    health = ratchet.run_health(tools, key(sarif.invocations(found)), key(sarif.notifications(found)), key(sarif.artifacts(found)))
    every = sarif.findings(found)
    findings = ratchet.with_fingerprint(every)
    bad = found.where("violation is not null").select("log", "violation").unionByName(every.where("violation is not null").select("log", "violation"))
    rot, new = ratchet.detect_rot(baseline, findings, files, now), ratchet.new_findings(findings, baseline)
    refused = health.select("run", "health").unionByName(bad.select(F.col("log").alias("run"), F.lit("failed").alias("health")))
    return {"violations": bad, "health": health, "rot": rot, "new": new, "verdict": ratchet.verdict(refused, rot, new)}


def survivors(claims: DataFrame, files: DataFrame, declared: DataFrame | None = None, cov: tuple[DataFrame, DataFrame, DataFrame] | None = None, strategy: str = "with_stem") -> tuple[DataFrame, DataFrame]:
    """Claims (``mutant, sut, kind, claim, declared_in``) through the five layers in their order, and what each dropped.

    ``files(path, kind, content, text, head, link_target, read_status)`` is one tree; ``cov`` is called functions, files and the control's outcome.
    A symbol without a place of declaration is refused by the never-touch rules and passes gate 3f.
    """
    key = ["mutant", "sut", "kind", "claim"]
    site = claims.select(*key, F.when(F.col("kind") == "path", F.col("claim")).otherwise(F.col("declared_in")).alias("path"))
    touched = rules.judge(files).groupBy("path").agg(F.min("class").alias("rule"))
    gate1 = large(site).join(touched, "path").select(*key, "rule").unionByName(site.where("path is null").select(*key, F.lit("1p").alias("rule")))
    ids = site.withColumn("candidate", F.concat_ws("\u0001", *key))
    asked = ids.select("candidate", "path", F.when(F.col("kind") == "symbol", F.col("claim")).alias("symbol"))
    held = persistence.scan(asked.where("path is not null"), files).select("candidate", F.col("condition").alias("rule"))
    gate3f = large(ids).join(held, "candidate").select(*key, "rule")
    layers = [("gate1", gate1), ("gate3f", gate3f)]
    if cov is not None:
        saved = coverage.rescue(claims, *cov).select("kind", "claim", F.lit("executed").alias("rule"))
        layers.append(("coverage", large(claims.select(*key)).join(saved, ["kind", "claim"])))
    rooted, _ = roots.materialize(files, declared)
    layers.append(("roots", large(claims.select(*key)).join(roots.rescues(claims, rooted), ["kind", "claim"])))
    literal = veto.literal_verdicts(asked.withColumn("path", F.coalesce("path", F.lit(""))), files, strategy)
    tables = reachability.tables(files)
    reach = veto.reachability_verdicts(asked.where("symbol is null").select("candidate", "path"), *tables)
    first = literal.select("candidate", "verdict", "reason").unionByName(reach).where("verdict = 'vetoed'").select("candidate", F.col("reason").alias("rule"))
    layers.append(("veto", large(ids).join(first, "candidate").select(*key, "rule")))
    return suite.apply_layers(claims, layers)


#: The classes that the never-touch rules know.
CLASSES = tuple("1" + c for c in "abcdefghijklmnop")


def trace(asked: DataFrame, files: DataFrame, ignored_by: DataFrame | None = None) -> DataFrame:
    """``path, class, says``: a row for each class of every path asked; ``says`` is null where the class has no objection, which is no permission.

    ``ignored_by`` (``ignore.deciding_rule``) adds the rule that takes a path back to class 1m, with its file and line.
    """
    every = asked.select("path").distinct().select("path", F.explode(F.array(*[F.lit(c) for c in CLASSES])).alias("class"))
    found = rules.judge(files.join(asked.select("path").distinct(), "path", "left_semi")).select("path", "class", F.col("evidence").alias("said"))
    if ignored_by is not None:
        back = ignored_by.where("not ignored and pattern is not null")
        found = found.unionByName(back.select("path", F.lit("1m").alias("class"), F.format_string("%s:%s %s", "source", "line", "pattern").alias("said")))
    one = found.groupBy("path", "class").agg(F.min("said").alias("says"))
    return every.join(one, ["path", "class"], "left")


def explain(path: str, files: DataFrame, status: DataFrame, head_on_remote: bool | None, ignore_files: DataFrame | None = None) -> dict[str, DataFrame]:
    """What holds for one path: its classes, each class' answer, the ignore rule that decides it, its recoverability and the tier that no evidence gives it, with every criterion.

    ``ignore_files`` are those of ``ignore.ignore_rules``; by default the ignore files among ``files``.
    """
    spark = files.sparkSession
    one = files.where(F.col("path") == path)
    candidate = spark.createDataFrame([(path, path)], "candidate string, path string")
    sums = ledger.family_sums(spark.createDataFrame([(path, "B", "none", 0.0, False, False, True)], "candidate string, family string, signal string, bans double, execution_successful boolean, positive_control_passed boolean, expired boolean"))
    gate = candidate.select("candidate", F.lit("NotEvaluable").alias("gates_0_to_2"), F.lit("NotEvaluable").alias("gate_3f"))
    decided = ignore.deciding_rule(candidate, ignore.ignore_rules(files if ignore_files is None else ignore_files))
    return {
        "classes": rules.judge(one), "trace": trace(candidate, files, decided), "ignore": decided, "recoverability": gates.recoverability(candidate, status, head_on_remote), "tier": ledger.assign(sums, gate)
    }
