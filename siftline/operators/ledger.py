"""The evidence ledger: the strongest signal within a family, the sum across families, and a tier.

Evidence rows: ``candidate, family (B, R, X, H), signal, bans, execution_successful, positive_control_passed, expired``. Only healthy evidence
counts; a family without any is null, which is not zero.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the scoring.
PRIOR, TIER0, TIER1, ACCUSE, CAP = -0.95, 3.95, 2.65, 0.5, 0.6
ACCUSERS = ("B", "R", "X")
NOT_EVALUABLE = (
    "all six Gate-3 conjuncts",
    "zero ABSTAINs from a LOAD-BEARING family",
    "scanned_universe_ratio >= 0.8",
    "ladder_rung >= R2",
    "held the deadness invariant for N runs",
    "under the per-run rate limit",
    "no has_external_effector",
    "not is_distributable",
)


def healthy() -> Column:
    return F.col("execution_successful") & F.col("positive_control_passed") & ~F.col("expired")


def family_sums(evidence: DataFrame) -> DataFrame:
    """A row a candidate: maxima, contributions, their sum, accusing families; one aggregation, no pivot shuffle."""
    ok, bans = healthy(), F.col("bans")
    when = lambda family, more=F.lit(True): F.when(ok & (F.col("family") == family) & more, bans)
    aggs = [F.max(when(f, bans > 0)).alias(f"max_{f.lower()}") for f in ("B", "R", "X", "H")]
    aggs += [F.max(when(f)).alias(f"raw_{f.lower()}") for f in ACCUSERS] + [F.min(when("H", bans < 0)).alias("raw_h")]
    g = evidence.groupBy("candidate").agg(*aggs)
    part = {f: F.coalesce(F.col(f"raw_{f.lower()}"), F.lit(0.0)) for f in ACCUSERS}
    h = F.least(F.greatest(F.coalesce("raw_h", F.lit(0.0)), F.lit(-CAP)), F.lit(CAP))
    total = part["B"] + part["R"] + part["X"] + h  # a fixed order: float sums depend on it
    accusing = F.filter(F.array(*[F.when(F.col(f"max_{f.lower()}") >= ACCUSE, f) for f in ACCUSERS]), lambda x: x.isNotNull())
    return g.select(
        "candidate", *[f"max_{f}" for f in "brxh"], *[part[f].alias(f"part_{f.lower()}") for f in ACCUSERS], h.alias("part_h"), total.alias("total_bans"),
        (F.lit(PRIOR) + total).alias("posterior"), accusing.alias("accusing"),
    )


def assign(sums: DataFrame, gates: DataFrame) -> DataFrame:
    """``candidate, tier, total_bans, n_accusing, blockers, not_evaluable``; ``gates(candidate, gates_0_to_2, gate_3f)`` hold
    Satisfied, Failed or NotEvaluable, and a candidate without a row has NotEvaluable gates. Unclosed criteria keep tiers 0 and 1 out of reach.
    """
    j = sums.join(gates, "candidate", "left")
    g02, g3f = (F.coalesce(c, F.lit("NotEvaluable")) for c in ("gates_0_to_2", "gate_3f"))
    quorum = F.when(F.size("accusing") >= 2, "Satisfied").otherwise("Failed")
    names = ["gates 0-2 pass", "3f never waivable", ">=2 of {B,R,X} accuse", *NOT_EVALUABLE]
    outcomes = [g02, g3f, quorum, *[F.lit("NotEvaluable") for _ in NOT_EVALUABLE]]
    criteria = F.array(*[F.struct(F.lit(n).alias("name"), o.alias("outcome")) for n, o in zip(names, outcomes)])
    all_hold = F.forall(criteria, lambda c: c["outcome"] == "Satisfied")
    tier = F.when(all_hold & (F.col("total_bans") >= TIER0), 0).when(all_hold & (F.col("total_bans") >= TIER1), 1).when(g02 == "Satisfied", 2).otherwise(3)
    blockers = F.transform(F.filter(criteria, lambda c: c["outcome"] != "Satisfied"), lambda c: c["name"])
    return j.select(
        "candidate", tier.alias("tier"), "total_bans", F.size("accusing").alias("n_accusing"), blockers.alias("blockers"),
        F.size(F.filter(criteria, lambda c: c["outcome"] == "NotEvaluable")).alias("not_evaluable"), criteria.alias("criteria"),
    )


def survivor_evidence(claims: DataFrame, signal: str = "survived every veto", bans: float = 1.0) -> DataFrame:
    """A claim that came through the vetoes is itself a signal of family R."""
    yes = F.lit(True)
    return claims.select(F.col("claim").alias("candidate"), F.lit("R").alias("family"), F.lit(signal).alias("signal"), F.lit(bans).alias("bans"), yes.alias("execution_successful"), yes.alias("positive_control_passed"), F.lit(False).alias("expired"))
