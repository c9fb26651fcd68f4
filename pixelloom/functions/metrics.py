"""Regression metrics over measurement tables (set_id, branch, blend_id, source_id, metrics)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def box_stats(meas: DataFrame, metric: str, by: tuple[str, ...] = ("branch",), method: str = "linear") -> DataFrame:
    """q1, median, q3 and whiskers at 1.5 times their range, clipped to the data.

    ``linear`` interpolates percentiles; ``nearest_rank`` takes the sorted values at floor(n / 4), round(n / 2)
    and n - floor(n / 4), counted from 0 and kept inside the data.
    """
    k = list(by)
    if method == "linear":
        q = meas.groupBy(*k).agg(*[F.percentile(metric, F.lit(p)).alias(n) for n, p in (("q1", 0.25), ("med", 0.5), ("q3", 0.75))], F.min(metric).alias("lo"), F.max(metric).alias("hi"))
    else:
        w = Window.partitionBy(*k)
        ranked = meas.where(F.col(metric).isNotNull()).withColumn("i", F.row_number().over(w.orderBy(metric)) - 1).withColumn("n", F.count(F.lit(1)).over(w))
        at = lambda e: F.max(F.when(F.col("i") == F.least(F.expr(e), F.col("n") - 1), F.col(metric)))
        q = ranked.groupBy(*k).agg(at("n div 4").alias("q1"), at("CAST(floor(n / 2 + 0.5) AS BIGINT)").alias("med"), at("n - n div 4").alias("q3"), F.min(metric).alias("lo"), F.max(metric).alias("hi"))
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    return q.select(*k, "q1", F.col("med").alias("median"), "q3", F.greatest("lo", F.col("q1") - reach).alias("whisker_lo"), F.least("hi", F.col("q3") + reach).alias("whisker_hi"))


def outliers(meas: DataFrame, metric: str, by: tuple[str, ...] = ("branch",)) -> DataFrame:
    """Records beyond the whiskers of their group."""
    return meas.join(box_stats(meas, metric, by).select(*by, "whisker_lo", "whisker_hi"), list(by)).where((F.col(metric) < F.col("whisker_lo")) | (F.col(metric) > F.col("whisker_hi"))).drop("whisker_lo", "whisker_hi")


def latest_branches(meas: DataFrame, merged: DataFrame, n: int = 10) -> DataFrame:
    """Records of the last ``n`` merged branches (branch, merged_at)."""
    last = merged.join(merged.select("merged_at").distinct().orderBy(F.desc("merged_at")).limit(n), "merged_at", "left_semi").select("branch")
    return meas.join(last, "branch", "left_semi")


def magnitude_offsets(meas: DataFrame, bands: str = "grizy") -> DataFrame:
    """One row for each record and band that it has: true magnitude less the measured one."""
    have = [b for b in bands if f"{b}_truth" in meas.columns and f"{b}_mag" in meas.columns]
    entries = ", ".join(f"struct('{b}' AS band, {b}_truth - {b}_mag AS offset)" for b in have)
    return meas.selectExpr("set_id", "branch", "blend_id", "source_id", f"inline(array({entries}))")


def scatter_table(meas: DataFrame, metric: str, band: str = "g") -> DataFrame:
    """A metric against the true magnitude with the record's ids; rows without either are left out."""
    return meas.where(F.col(metric).isNotNull() & F.col(f"{band}_truth").isNotNull()).select("branch", "blend_id", "source_id", F.col(f"{band}_truth").alias("truth"), F.col(metric).alias("metric"))


def needs_log_scale(meas: DataFrame, metric: str, by: tuple[str, ...] = ("set_id",)) -> DataFrame:
    """``log_scale``: whether a metric's positive values span over two decades."""
    lit = F.when(F.col(metric) > 0, F.log10(metric))
    return meas.groupBy(*by).agg(F.coalesce(F.max(lit) - F.min(lit) > 2, F.lit(False)).alias("log_scale"))


def compare_branches(meas: DataFrame, a: str, b: str, metric: str, keys: tuple[str, ...] = ("set_id", "blend_id", "source_id")) -> DataFrame:
    """A metric in two branches side by side and its difference, for every record of either; one aggregation, no join."""
    at = lambda n: F.max(F.when(F.col("branch") == n, F.col(metric)))
    both = meas.where(F.col("branch").isin(a, b)).groupBy(*keys).agg(at(a).alias("a"), at(b).alias("b"))
    return both.withColumn("diff", F.col("b") - F.col("a"))


def run_summary(meas: DataFrame) -> DataFrame:
    """Sources, total runtime and runtime per source of each branch and set."""
    return meas.groupBy("branch", "set_id").agg(F.count(F.lit(1)).alias("n_sources"), F.sum("runtime").alias("total_runtime"), F.avg("runtime").alias("runtime"))
