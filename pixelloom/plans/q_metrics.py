"""Queries over regression metrics (group M)."""

from pyspark.sql import functions as F

from pixelloom.functions import metrics as M
from pixelloom.plans import fixtures as X
from pixelloom.plans.registry import over, query

Q = "q AS (SELECT branch, quantile_cont(runtime, 0.25) AS q1, quantile_cont(runtime, 0.5) AS med, quantile_cont(runtime, 0.75) AS q3, min(runtime) AS lo, max(runtime) AS hi FROM meas GROUP BY branch)"
BS = "bs AS (SELECT branch, q1, med AS median, q3, greatest(lo, q1 - 1.5 * (q3 - q1)) AS whisker_lo, least(hi, q3 + 1.5 * (q3 - q1)) AS whisker_hi FROM q)"


@query("m1_box_stats", over(X.MEAS, Q, BS, select="SELECT branch, round(q1, 3) AS q1, round(median, 3) AS median, round(q3, 3) AS q3, round(whisker_lo, 3) AS whisker_lo, round(whisker_hi, 3) AS whisker_hi FROM bs"))
def m1(s, d):
    return M.box_stats(X.measurements(s, d), "runtime").selectExpr("branch", *[f"round({c}, 3) AS {c}" for c in ("q1", "median", "q3", "whisker_lo", "whisker_hi")])


@query("m1_box_stats_rank", over(X.MEAS, "r AS (SELECT *, row_number() OVER (PARTITION BY set_id ORDER BY runtime) - 1 AS i, count(*) OVER (PARTITION BY set_id) AS n FROM meas)", "q AS (SELECT set_id, max(runtime) FILTER (i = n // 4) AS q1, max(runtime) FILTER (i = CAST(floor(n / 2.0 + 0.5) AS BIGINT)) AS med, max(runtime) FILTER (i = n - n // 4) AS q3, min(runtime) AS lo, max(runtime) AS hi FROM r GROUP BY set_id)",
    select="SELECT set_id, q1, med AS median, q3, CAST(greatest(lo, q1 - 1.5 * (q3 - q1)) AS DOUBLE) AS whisker_lo, CAST(least(hi, q3 + 1.5 * (q3 - q1)) AS DOUBLE) AS whisker_hi FROM q"))
def m1b(s, d):
    return M.box_stats(X.measurements(s, d), "runtime", ("set_id",), "nearest_rank").withColumn("whisker_lo", F.col("whisker_lo").cast("double")).withColumn("whisker_hi", F.col("whisker_hi").cast("double"))


SKEW = "meas2 AS (SELECT * REPLACE ((runtime // 100000) * (runtime // 100000) * (runtime // 100000) * (runtime // 100000) AS runtime) FROM meas)"


@query("m2_outliers", over(X.MEAS, SKEW, Q.replace("FROM meas ", "FROM meas2 "), BS, select="SELECT m.branch, m.blend_id, m.source_id, m.runtime FROM meas2 m JOIN bs USING (branch) WHERE runtime < whisker_lo OR runtime > whisker_hi"))
def m2(s, d):
    m = X.measurements(s, d).withColumn("runtime", F.expr("(runtime div 100000) * (runtime div 100000) * (runtime div 100000) * (runtime div 100000)"))
    return M.outliers(m, "runtime").select("branch", "blend_id", "source_id", "runtime")


@query("m3_latest_branches", over(X.MEAS, "g AS (SELECT branch FROM (SELECT branch, max(blend_id) AS m FROM meas GROUP BY branch) ORDER BY m DESC LIMIT 2)", select="SELECT branch, blend_id FROM meas WHERE branch IN (SELECT branch FROM g)"))
def m3(s, d):
    m = X.measurements(s, d)
    return M.latest_branches(m, m.groupBy("branch").agg(F.max("blend_id").alias("merged_at")), 2).select("branch", "blend_id")


@query("m4_magnitude_offsets", over(X.MEAS, select="SELECT set_id, branch, blend_id, source_id, 'g' AS band, g_truth - g_mag AS offset FROM meas"))
def m4(s, d):
    return M.magnitude_offsets(X.measurements(s, d))


@query("m5_scatter_table", over(X.MEAS, select="SELECT branch, blend_id, source_id, g_truth AS truth, runtime AS metric FROM meas"))
def m5(s, d):
    return M.scatter_table(X.measurements(s, d), "runtime")


@query("m6_needs_log_scale", over(X.MEAS, select="SELECT branch, log10(max(runtime)) - log10(min(runtime)) > 2 AS log_scale FROM meas GROUP BY branch"))
def m6(s, d):
    return M.needs_log_scale(X.measurements(s, d), "runtime", ("branch",))


@query("m7_compare_branches", over(X.MEAS, select="SELECT set_id, source_id, max(CASE WHEN branch = '1-URGENT' THEN runtime END) AS a, max(CASE WHEN branch = '2-HIGH' THEN runtime END) AS b, max(CASE WHEN branch = '2-HIGH' THEN runtime END) - max(CASE WHEN branch = '1-URGENT' THEN runtime END) AS diff FROM meas WHERE branch IN ('1-URGENT', '2-HIGH') GROUP BY set_id, source_id"))
def m7(s, d):
    return M.compare_branches(X.measurements(s, d), "1-URGENT", "2-HIGH", "runtime", ("set_id", "source_id"))


@query("m8_run_summary", over(X.MEAS, select="SELECT branch, set_id, count(*) AS n_sources, CAST(sum(runtime) AS BIGINT) AS total_runtime, round(avg(runtime), 3) AS runtime FROM meas GROUP BY branch, set_id"))
def m8(s, d):
    return M.run_summary(X.measurements(s, d)).withColumn("runtime", F.round("runtime", 3))
