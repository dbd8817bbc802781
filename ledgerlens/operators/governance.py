"""Failure classes, review gates, failure roll-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens import constants as K


def classify_failures(df: DataFrame, stop: str = "blocking_only") -> DataFrame:
    """Adds failure_class, is_blocking, is_result and stop_scope.

    df: classification (nullable, explicit), code, blocking.  The first matching code prefix in
    table order decides when no class is given.
    """
    code = F.upper(F.coalesce("code", F.lit("")))
    from_code = F.coalesce(*[F.when(code.startswith(p), c) for p, c in K.FAILURE_CODE_PREFIXES], F.lit("execution_failure"))
    cls = F.coalesce("classification", from_code)
    d = df.withColumn("failure_class", cls)
    critical = F.col("failure_class").isin(*K.CRITICAL_FAILURES)
    result = F.col("failure_class").isin(*K.RESULT_FAILURES)
    d = d.withColumn("is_blocking", critical | F.coalesce("blocking", F.lit(True))).withColumn("is_result", result)
    scope = (
        F.when(critical | (F.col("failure_class") == "user_cancelled"), "workflow").when(result, "current_step")
        .when(F.lit(stop == "always") | (F.lit(stop == "blocking_only") & F.col("is_blocking")), "workflow").otherwise("current_step"))
    return d.withColumn("stop_scope", scope)


def failure_summary(df: DataFrame, stop: str = "blocking_only") -> DataFrame:
    return classify_failures(df, stop).groupBy("failure_class", "is_blocking", "stop_scope").agg(F.count(F.lit(1)).alias("n_failures"))


def evaluate_gates(decisions: DataFrame) -> DataFrame:
    """Eligibility of each run's claim from its review decisions.

    decisions: run_id, status, severity, reviewer_verdict, claim_type (one finding per row).
    """
    stuck = F.col("status").isin("blocked", "inconclusive")
    high = (F.col("severity") == "high") & F.col("claim_type").isin("publication", "comparative", "causal")
    n = lambda c: F.count(F.when(c, 1))
    g = decisions.groupBy("run_id").agg(
        n(F.col("severity") == "critical").alias("n_critical"), n(high).alias("n_high"), n(stuck).alias("n_stuck"),
        (F.bool_or(F.coalesce(F.col("reviewer_verdict") == "reject_claim", F.lit(False)))
         & F.bool_or(F.coalesce(F.col("reviewer_verdict") == "no_material_objection_found", F.lit(False)))).alias("verdicts_conflict"))
    return g.withColumn("eligible", (F.col("n_critical") + F.col("n_high") + F.col("n_stuck") == 0) & ~F.col("verdicts_conflict"))
