"""Comparing a batch with the one before it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values: (warning, critical). Rates are compared by difference, latencies by ratio.
RATE_LIMITS = (-0.02, -0.05)
LATENCY_LIMITS = (1.3, 1.5)
LEAST_SAMPLE = 20
#: Coefficients of the Abramowitz-Stegun approximation of the error function.
_ERF = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)
_ERF_P = 0.3275911


def normal_cdf(x: Column) -> Column:
    z = F.abs(x) / F.sqrt(F.lit(2.0))
    t = 1 / (1 + _ERF_P * z)
    poly = F.lit(0.0)
    for a in reversed(_ERF):
        poly = (poly + a) * t
    erf = 1 - poly * F.exp(-z * z)
    return 0.5 * (1 + F.signum(x) * erf)


def two_proportion_p(p1: Column, p2: Column, n1: Column, n2: Column) -> Column:
    """Two-sided pooled z-test; null with fewer than LEAST_SAMPLE on either side or a pooled rate of 0 or 1."""
    pooled = (p1 * n1 + p2 * n2) / (n1 + n2)
    se = F.sqrt(pooled * (1 - pooled) * (F.lit(1.0) / n1 + F.lit(1.0) / n2))
    ok = (n1 >= LEAST_SAMPLE) & (n2 >= LEAST_SAMPLE) & (pooled > 0) & (pooled < 1)
    return F.when(ok, 2 * (1 - normal_cdf(F.abs((p1 - p2) / se))))


def severity(now: Column, before: Column, limits: tuple[float, float], by_ratio: bool) -> Column:
    if by_ratio:
        change = F.when(before > 0, now / before).otherwise(1.0)
        return F.when(change >= limits[1], "critical").when(change >= limits[0], "warning")
    change = now - before
    return F.when(change <= limits[1], "critical").when(change <= limits[0], "warning")


def against_previous(batches: DataFrame, client: str) -> DataFrame:
    """batches: client, batch_id, ended_at, n, pass_rate, avg_score, avg_latency. Adds each batch's predecessor of the same client
    and, for each metric, the severity of a regression (null: none), and a p-value for a worse pass rate. The window runs
    over batches, of which there is one row each."""
    w = Window.partitionBy(client).orderBy("ended_at", "batch_id")
    last = {c: F.lag(c).over(w) for c in ("batch_id", "n", "pass_rate", "avg_score", "avg_latency")}
    joined = batches.select(client, "batch_id", "n", "pass_rate", "avg_score", "avg_latency", *[v.alias(f"prev_{k}") for k, v in last.items()])
    pass_severity = severity(F.col("pass_rate"), F.col("prev_pass_rate"), RATE_LIMITS, False)
    p = two_proportion_p(F.col("prev_pass_rate"), F.col("pass_rate"), F.col("prev_n"), F.col("n"))
    return joined.where("prev_batch_id IS NOT NULL").select(
        client, "batch_id", "prev_batch_id", "pass_rate", "prev_pass_rate", F.round(F.col("pass_rate") - F.col("prev_pass_rate"), 6).alias("delta"),
        pass_severity.alias("pass_severity"),
        severity(F.col("avg_score"), F.col("prev_avg_score"), RATE_LIMITS, False).alias("score_severity"),
        severity(F.col("avg_latency"), F.col("prev_avg_latency"), LATENCY_LIMITS, True).alias("latency_severity"),
        F.round(F.when(pass_severity.isNotNull(), p), 6).alias("p_value"),
    )
