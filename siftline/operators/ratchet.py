"""The ratchet: findings against a committed baseline.

Findings are rows ``seq, rule_id, message, uri, partial_fingerprints`` (and more); a baseline has
``seq, fingerprint, rule_id, uri, symbol, first_seen, expires, justification``. Baselines are compared on their distinct fingerprints,
by merging: the planner goes by compressed bytes, and what it would broadcast grows with the input and is many times as large in every task's memory.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.functions.text import ALGORITHM, fingerprint, has_expired
from siftline.sources.lineage import large

TARGET_ROLE, TARGET_FLOOR = "analysisTarget", 0.8  # fixed values


def result_fingerprint(partial: Column, rule: Column, uri: Column, message: Column, algorithm: str = ALGORITHM) -> Column:
    """What the analyzer stored under the algorithm's name, prefixed with it, else derived without symbol and blob."""
    stored = F.try_element_at(partial, F.lit(algorithm))
    none = F.lit(None).cast("string")
    return F.coalesce(F.concat(F.lit(algorithm + ":"), stored), fingerprint(rule, uri, none, none, message, algorithm))


def primary_uri(locations: Column) -> Column:
    return F.coalesce(F.get(locations, F.lit(0))["uri"], F.lit(""))


def with_fingerprint(findings: DataFrame, algorithm: str = ALGORITHM) -> DataFrame:
    f = F.col
    return findings.withColumn("fingerprint", result_fingerprint(f("partial_fingerprints"), f("rule_id"), f("uri"), f("message"), algorithm))


def known_fingerprints(baseline: DataFrame) -> DataFrame:
    return baseline.select("fingerprint").distinct()


def new_findings(findings: DataFrame, baseline: DataFrame) -> DataFrame:
    """Findings whose fingerprint the baseline does not know, each with its multiplicity."""
    return findings.join(large(known_fingerprints(baseline)), "fingerprint", "left_anti").withColumn("baseline_state", F.lit("new"))


def unchanged_findings(findings: DataFrame, baseline: DataFrame) -> DataFrame:
    return findings.join(large(known_fingerprints(baseline)), "fingerprint", "left_semi").withColumn("baseline_state", F.lit("unchanged"))


def with_baseline_state(findings: DataFrame, baseline: DataFrame) -> DataFrame:
    known = known_fingerprints(baseline).withColumn("__known", F.lit(True))
    state = F.when(F.col("__known"), "unchanged").otherwise("new")
    return findings.join(large(known), "fingerprint", "left").withColumn("baseline_state", state).drop("__known")


def distinct_first(findings: DataFrame, key: str = "fingerprint", order: str = "seq") -> DataFrame:
    """The first row of each key by ``order`` (a total order); keys meet as one row a task, not as a sorted window."""
    others = [c for c in findings.columns if c != key]
    first = findings.groupBy(key).agg(F.min_by(F.struct(*others), F.col(order)).alias("r"))
    return first.select(key, *[F.col("r")[c].alias(c) for c in others]).select(*findings.columns)


def detect_rot(baseline: DataFrame, findings: DataFrame, files: DataFrame, now: str) -> DataFrame:
    """``seq, fingerprint, uri, reason`` of baseline entries that no longer say anything: one reason an entry.

    referent_gone (its file is not among ``files.path``; an empty uri is exempt) beats expired, which beats never_matched.
    """
    seen = findings.select("fingerprint").distinct().withColumn("__seen", F.lit(True))
    present = files.select(F.col("path").alias("uri")).distinct().withColumn("__there", F.lit(True))
    reason = (
        F.when((F.col("uri") != "") & F.col("__there").isNull(), "referent_gone")
        .when(F.col("expires").isNotNull() & has_expired(F.col("expires"), F.lit(now)), "expired")
        .when(F.col("__seen").isNull(), "never_matched")
    )
    joined = baseline.join(large(seen), "fingerprint", "left").join(large(present), "uri", "left")
    return joined.select("seq", "fingerprint", "uri", "expires", reason.alias("reason")).where("reason is not null")


def run_health(runs: DataFrame, invocations: DataFrame, notifications: DataFrame, artifacts: DataFrame) -> DataFrame:
    """``run, health, reasons``: failed beats degraded beats healthy; reasons in order, failures first.

    ``runs(run, tool, expected_targets)``, ``invocations(run, idx, execution_successful)`` with an absent bit counted as false,
    ``notifications(run, idx, nth, level, message)``, ``artifacts(run, roles)``. A run without invocations never said that it succeeded.
    """
    failed = invocations.groupBy("run").agg(
        F.count(F.lit(1)).alias("n_invocations"),
        F.array_sort(F.collect_list(F.when(~F.coalesce("execution_successful", F.lit(False)), F.col("idx")))).alias("failed_idx"),
    )
    bad = notifications.where("level in ('error', 'warning')").groupBy("run").agg(F.array_sort(F.collect_list(F.struct("idx", "nth", "level", "message"))).alias("notes"))
    declared = artifacts.where(F.exists("roles", lambda r: r == TARGET_ROLE)).groupBy("run").agg(F.count(F.lit(1)).alias("declared"))
    j = runs.join(large(failed), "run", "left").join(large(bad), "run", "left").join(large(declared), "run", "left")
    n, want = F.coalesce("declared", F.lit(0)), F.col("expected_targets")
    none = F.array().cast("array<string>")
    failures = F.when(F.coalesce("n_invocations", F.lit(0)) == 0, F.array(F.concat(F.lit("no invocation: "), "tool"))).otherwise(
        F.transform(F.coalesce("failed_idx", F.array().cast("array<int>")), lambda i: F.concat(F.lit("invocation "), i.cast("string"), F.lit(" failed: "), F.col("tool")))
    )
    notes = F.coalesce(F.transform("notes", lambda x: F.concat(x["level"], F.lit(": "), x["message"])), none)
    targets = (
        F.when(want == 0, F.array(F.concat(F.lit("coverage cannot be validated: "), n.cast("string"), F.lit(" targets, none expected"))))
        .when(n < F.lit(TARGET_FLOOR) * want, F.array(F.concat(n.cast("string"), F.lit(" of "), want.cast("string"), F.lit(" expected targets"))))
        .otherwise(none)
    )
    soft = F.concat(notes, targets)
    health = F.when(F.size(failures) > 0, "failed").when(F.size(soft) > 0, "degraded").otherwise("healthy")
    return j.select("run", health.alias("health"), F.concat(failures, soft).alias("reasons"))


def verdict(health: DataFrame, rot: DataFrame, new: DataFrame, repos: DataFrame | None = None) -> DataFrame:
    """``verdict, degraded, n_rot, n_new, exit_code``: refused, rot, new_findings or clean, whatever is empty.

    One row; or with ``repos`` (repo) a row for each of them, all three tables then having that column. A repository without runs is refused.
    """
    keys = ["repo"] if repos is not None else []
    h = health.groupBy(*keys).agg(F.count_if(F.col("health") == "failed").alias("failed"), F.count_if(F.col("health") == "degraded").alias("soft"), F.count(F.lit(1)).alias("runs"))
    r, n = rot.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rot")), new.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_new"))
    if repos is None:
        one = h.crossJoin(F.broadcast(r)).crossJoin(F.broadcast(n))  # three rows of one row each
    else:
        one = repos.select("repo").distinct().join(large(h), keys, "left").join(large(r), keys, "left").join(large(n), keys, "left").fillna(0, ["failed", "soft", "runs", "n_rot", "n_new"])
    said = F.when((F.col("failed") > 0) | (F.col("runs") == 0), "refused").when(F.col("n_rot") > 0, "rot").when(F.col("n_new") > 0, "new_findings").otherwise("clean")
    code = F.when(said == "refused", 2).when(said == "clean", 0).otherwise(1)
    return one.select(*keys, said.alias("verdict"), (F.col("soft") > 0).alias("degraded"), "n_rot", "n_new", code.alias("exit_code"))


def update(findings: DataFrame, previous: DataFrame, now: str) -> tuple[DataFrame, DataFrame]:
    """The new baseline, and one row of counts: added, carried, dropped, still_expired.

    A known fingerprint carries first_seen, expires, justification and symbol of its first previous entry. Dropped counts entries of the
    previous baseline, duplicates too.
    """
    kept = distinct_first(previous).select("fingerprint", *[F.col(c).alias(f"p_{c}") for c in ("first_seen", "expires", "justification", "symbol")])
    fresh = distinct_first(findings.select("seq", "fingerprint", "rule_id", "uri"))
    joined = fresh.join(large(kept), "fingerprint", "left")
    entries = joined.select(
        "seq", "fingerprint", "rule_id", "uri", F.col("p_symbol").alias("symbol"), F.coalesce("p_first_seen", F.lit(now)).alias("first_seen"), F.col("p_expires").alias("expires"),
        F.col("p_justification").alias("justification"), F.col("p_first_seen").isNotNull().alias("carried"),
    )
    counts = entries.agg(
        F.count_if(~F.col("carried")).alias("added"),
        F.count_if("carried").alias("carried"),
        F.count_if(F.col("expires").isNotNull() & has_expired(F.col("expires"), F.lit(now))).alias("still_expired"),
    )
    gone = previous.join(large(fresh.select("fingerprint")), "fingerprint", "left_anti").agg(F.count(F.lit(1)).alias("dropped"))
    return entries.drop("carried"), counts.crossJoin(F.broadcast(gone))


def merge_runs(runs: list[DataFrame]) -> DataFrame:
    """All logs as one run, before rot is looked for; ``seq`` keeps the order of the logs and then their own."""
    if not runs:
        raise ValueError("no runs: nothing was read, which is not the same as nothing found")
    tagged = [r.withColumn("log", F.lit(i)) for i, r in enumerate(runs)]
    out = tagged[0]
    for r in tagged[1:]:
        out = out.unionByName(r, allowMissingColumns=True)
    return out


