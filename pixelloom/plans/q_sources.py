"""Queries over scans and sinks (group A)."""

from pyspark.sql import functions as F

from pixelloom.functions.grid import scratch
from pixelloom.plans import fixtures as X
from pixelloom.plans.registry import over, query
from pixelloom.sources import tables as S


@query("a1_load_pixels", over(X.E, select="SELECT image_id, band, y, x, value, set_id FROM e WHERE set_id = 2"))
def a1(s, d):
    path = scratch(s, "pixels")
    S.save_pixels(X.e(s, d), path)
    return S.load_pixels(s, path, 2).select("image_id", "band", "y", "x", "value", "set_id")


@query("a2_cube_to_pixels", over(X.V, select="SELECT image_id, CAST(dense_rank() OVER (ORDER BY band) - 1 AS INTEGER) AS band, y, x, value FROM v"))
def a2(s, d):
    return S.cube_to_pixels(S.pixels_to_cube(X.v(s, d)))


@query("a3_pixels_to_cube", over(X.V, "r AS (SELECT image_id, band, y, list(value ORDER BY x) AS r FROM v GROUP BY ALL)", "p AS (SELECT image_id, band, list(r ORDER BY y) AS p FROM r GROUP BY ALL)",
    select="SELECT image_id, replace(CAST(to_json(list(p ORDER BY band)) AS VARCHAR), ' ', '') AS cube FROM p GROUP BY image_id"))
def a3(s, d):
    return S.pixels_to_cube(X.v(s, d)).withColumn("cube", F.to_json("cube"))


@query("a4_list_blends", over(X.E, select="SELECT DISTINCT image_id FROM e WHERE set_id = 3"))
def a4(s, d):
    return S.list_blends(X.e(s, d), 3)


@query("a5_save_measurements", over(X.MEAS, select="SELECT set_id, branch, blend_id, source_id, CASE WHEN blend_id % 3 = 0 THEN -runtime ELSE runtime END AS runtime FROM meas WHERE blend_id % 2 = 0 OR blend_id % 3 = 0"))
def a5(s, d):
    path = scratch(s, "measurements")
    m = X.measurements(s, d).select("set_id", "branch", "blend_id", "source_id", "runtime")
    S.save_measurements(m.where("blend_id % 2 = 0"), path)
    S.save_measurements(m.where("blend_id % 3 = 0").withColumn("runtime", -F.col("runtime")), path)
    return s.read.parquet(path).select("set_id", "branch", "blend_id", "source_id", "runtime")


@query("a6_measurement_id", over(X.MEAS, select="SELECT CAST(blend_id AS VARCHAR) || ',' || CAST(source_id AS VARCHAR) AS meas_id, blend_id, source_id FROM meas"))
def a6(s, d):
    return S.parse_measurement_id(S.measurement_id(X.measurements(s, d)).select("meas_id"))


@query("a7_merged_branches", over(X.MEAS, "b AS (SELECT branch, max(blend_id) AS merged_at FROM meas GROUP BY branch)", select="SELECT branch, merged_at, CAST(row_number() OVER (ORDER BY merged_at DESC, branch) AS INTEGER) AS position FROM b WHERE branch <> '1-URGENT'"))
def a7(s, d):
    m = X.measurements(s, d)
    processed = S.register_branch(m.where("branch <> '1-URGENT'").select("branch"), "not merged")
    return S.merged_branches(processed, m.groupBy("branch").agg(F.max("blend_id").alias("merged_at")))


@query("a8_save_load_model", over(X.V, X.CATALOG, select="SELECT c.image_id, c.source_id, v.band, v.value AS sed FROM catalog c JOIN v USING (image_id, y, x)"))
def a8(s, d):
    c = X.catalog(s, d)
    seds = c.join(X.v(s, d), ["image_id", "y", "x"]).selectExpr("image_id", "source_id", "band", "value AS sed")
    path = scratch(s, "model")
    S.save_model(seds, c.selectExpr("image_id", "source_id", "y", "x", "1 AS m"), c.selectExpr("image_id", "source_id", "y AS y0", "y + 1 AS y1", "x AS x0", "x + 1 AS x1"), path)
    return S.load_model(s, path)[0]
