"""Queries over boxes (group C)."""

from pyspark.sql import functions as F

from pixelloom.functions.grid import explode_grid
from pixelloom.operators import boxes as B
from pixelloom.operators.pixels import sum_coadd
from pixelloom.operators import detect as D
from pixelloom.plans import fixtures as X
from pixelloom.plans.registry import over, query

BOX = "image_id, box_id, y0, y1, x0, x1"
ODD = "odd AS (SELECT image_id, box_id, y0, y1, x0, x1 FROM boxes WHERE box_id % 2 = 1)"
GROWN = "grown AS (SELECT image_id, box_id, y0 + 2 AS y0, y1 + 2 AS y1, x0 + 1 AS x0, x1 + 1 AS x1 FROM boxes)"
CELLS = "cell AS (SELECT image_id, box_id, y0, x0, gy, unnest(range(x0, x1)) AS gx FROM (SELECT *, unnest(range(y0, y1)) AS gy FROM boxes))"


@query("c1_box_from_data", over(X.L, select="""SELECT image_id, band, CAST(coalesce(min(y) FILTER (value > 2), 0) AS INTEGER) AS y0, CAST(coalesce(max(y) FILTER (value > 2) + 1, 0) AS INTEGER) AS y1,
 CAST(coalesce(min(x) FILTER (value > 2), 0) AS INTEGER) AS x0, CAST(coalesce(max(x) FILTER (value > 2) + 1, 0) AS INTEGER) AS x1 FROM l GROUP BY image_id, band"""))
def c1(s, d):
    return B.box_from_data(X.l(s, d), 2, by=("image_id", "band"))


@query("c2_box_from_bounds", over(X.BOXES, select=f"SELECT image_id, box_id, y0, greatest(y0, y1 - 4) AS y1, x0, greatest(x0, x1 - 3) AS x1 FROM boxes UNION ALL SELECT image_id, -box_id, y0, y1 + 1, x0, x1 + 1 FROM boxes"))
def c2(s, d):
    b = X.boxes(s, d)
    clamped = B.box_from_bounds(b.selectExpr("image_id", "box_id", "y0", "y1 - 4 AS y1", "x0", "x1 - 3 AS x1"))
    inclusive = B.box_from_inclusive(b.selectExpr("image_id", "-box_id AS box_id", "y0 AS ymin", "y1 AS ymax", "x0 AS xmin", "x1 AS xmax"))
    return clamped.unionByName(inclusive)


@query("c3_box_contains", over(X.BOXES, X.CATALOG, select="SELECT c.image_id, c.source_id, b.box_id FROM catalog c JOIN boxes b ON c.image_id = b.image_id AND c.y >= b.y0 AND c.y < b.y1 AND c.x >= b.x0 AND c.x < b.x1"))
def c3(s, d):
    return B.box_contains(X.catalog(s, d), X.boxes(s, d)).select("image_id", "source_id", "box_id")


@query("c4_box_extract", over(X.V, X.BOXES, CELLS, select="""SELECT c.image_id, c.box_id, v0.band, CAST(gy - y0 AS INTEGER) AS y, CAST(gx - x0 AS INTEGER) AS x, coalesce(v.value, 0) AS value
 FROM cell c JOIN (SELECT DISTINCT image_id, band FROM v) v0 USING (image_id) LEFT JOIN v ON v.image_id = c.image_id AND v.band = v0.band AND v.y = gy AND v.x = gx"""))
def c4(s, d):
    return B.box_extract(X.v(s, d), X.boxes(s, d), 0).withColumn("value", F.col("value").cast("long"))


@query("c5_box_insert", over(X.V, X.BOXES, select="""SELECT v.image_id, v.band, v.y, v.x, CAST(v.value + coalesce(n, 0) AS BIGINT) AS value FROM v LEFT JOIN (SELECT v.image_id, v.band, v.y, v.x, count(*) * max(v.value) AS n
 FROM v JOIN boxes b ON v.image_id = b.image_id AND v.y >= b.y0 AND v.y < b.y1 AND v.x >= b.x0 AND v.x < b.x1 GROUP BY ALL) s USING (image_id, band, y, x)"""))
def c5(s, d):
    v, b = X.v(s, d), X.boxes(s, d)
    return B.box_insert(v, B.box_extract(v, b, corners=True), b, how="add").select("image_id", "band", "y", "x", F.col("value").cast("long").alias("value"))


@query("c6_box_props", over(X.BOXES, select=f"SELECT {BOX}, y1 - y0 AS height, x1 - x0 AS width, CAST(y0 + (y1 - y0) // 2 AS BIGINT) AS cy, CAST(x0 + (x1 - x0) // 2 AS BIGINT) AS cx, CAST((y1 - y0) * (x1 - x0) AS BIGINT) AS area FROM boxes"))
def c6(s, d):
    return B.box_props(X.boxes(s, d))


@query("c7_box_grow_shift", over(X.BOXES, select="SELECT image_id, box_id, y0 - 2 + 5 AS y0, y1 + 2 + 5 AS y1, x0 - 1 - 3 AS x0, x1 + 1 - 3 AS x1 FROM boxes"))
def c7(s, d):
    return B.box_shift(B.box_grow(X.boxes(s, d), 2, 1), 5, -3)


@query("c8_box_union", over(X.BOXES, select="SELECT box_id, least(y0, x0) AS y0, greatest(y1, x1) AS y1, least(x0, y0) AS x0, greatest(x1, y1) AS x1 FROM boxes UNION ALL SELECT -1 - image_id, min(y0), max(y1), min(x0), max(x1) FROM boxes GROUP BY image_id"))
def c8(s, d):
    b = X.boxes(s, d)
    swapped = b.selectExpr("box_id", "x0 AS y0", "x1 AS y1", "y0 AS x0", "y1 AS x1")
    groups = B.box_union_agg(b, ["image_id"]).selectExpr("-1 - image_id AS box_id", "y0", "y1", "x0", "x1")
    return B.box_union(b.drop("image_id"), swapped, ["box_id"]).unionByName(groups)


@query("c9_box_intersect", over(X.BOXES, select="""SELECT box_id, greatest(y0, x0) AS y0, greatest(least(y1, x1), greatest(y0, x0)) AS y1, greatest(x0, y0) AS x0, greatest(least(x1, y1), greatest(x0, y0)) AS x1 FROM boxes
 UNION ALL SELECT -1 - image_id, max(y0), greatest(min(y1), max(y0)), max(x0), greatest(min(x1), max(x0)) FROM boxes GROUP BY image_id"""))
def c9(s, d):
    b = X.boxes(s, d)
    swapped = b.selectExpr("box_id", "x0 AS y0", "x1 AS y1", "y0 AS x0", "y1 AS x1")
    groups = B.box_intersect_agg(b, ["image_id"]).selectExpr("-1 - image_id AS box_id", "y0", "y1", "x0", "x1")
    return B.box_intersect(b.drop("image_id"), swapped, ["box_id"]).unionByName(groups)


@query("c10_box_compose_slice", over(X.BOXES, select="SELECT b.image_id, b.box_id, 0 AS c0, CAST(1 + b.image_id % 3 AS INTEGER) AS c1, y0, y1 FROM boxes b"))
def c10(s, d):
    b = X.boxes(s, d)
    spectral = b.select("image_id").distinct().selectExpr("image_id", "0 AS c0", "CAST(1 + image_id % 3 AS INT) AS c1")
    return B.box_slice(B.box_compose(spectral, b), ["c", "y"])


@query("c11_box_dedupe", over(X.BOXES, select="SELECT image_id, y0, y1, x0, x1, min(box_id) AS box_id FROM boxes GROUP BY image_id, y0, y1, x0, x1"))
def c11(s, d):
    return B.box_dedupe(X.boxes(s, d), ["image_id"])


@query("c12_overlapped_slices", over(X.BOXES, GROWN, select="""SELECT box_id, i0 - y0 AS y0_a, i1 - y0 AS y1_a, j0 - x0 AS x0_a, j1 - x0 AS x1_a, i0 - yb AS y0_b, i1 - yb AS y1_b, j0 - xb AS x0_b, j1 - xb AS x1_b FROM (
 SELECT b.box_id, b.y0, b.x0, g.y0 AS yb, g.x0 AS xb, greatest(b.y0, g.y0) AS i0, greatest(least(b.y1, g.y1), greatest(b.y0, g.y0)) AS i1, greatest(b.x0, g.x0) AS j0, greatest(least(b.x1, g.x1), greatest(b.x0, g.x0)) AS j1 FROM boxes b JOIN grown g USING (box_id))"""))
def c12(s, d):
    b = X.boxes(s, d).drop("image_id")
    return B.overlapped_slices(b, B.box_shift(b, 2, 1), ["box_id"])


@query("c13_box_overlap_join", over(X.BOXES, select="""SELECT a.image_id, a.box_id AS a_id, b.box_id AS b_id FROM boxes a JOIN boxes b ON a.image_id = b.image_id AND a.y0 < b.y1 AND b.y0 < a.y1 AND a.x0 < b.x1 AND b.x0 < a.x1
 WHERE a.box_id < b.box_id"""))
def c13(s, d):
    b = X.boxes(s, d)
    return B.box_overlap_join(b, b).where("a_id < b_id")


SHARED = "px AS (SELECT *, box_id % 2 AS side FROM cell)"


@query("c14_footprint_overlap_join", over(X.BOXES, CELLS, SHARED, select="SELECT a.image_id, a.box_id AS a_id, b.box_id AS b_id, count(*) AS n FROM px a JOIN px b ON a.image_id = b.image_id AND a.gy = b.gy AND a.gx = b.gx WHERE a.side = 0 AND b.side = 1 GROUP BY ALL"))
def c14(s, d):
    cells = explode_grid(X.boxes(s, d), "y0", "y1", "x0", "x1").select("image_id", F.col("box_id").alias("label"), "y", "x")
    return D.footprint_overlap_join(cells.where("label % 2 = 0"), cells.where("label % 2 = 1"))


@query("c15_minimal_boxsize", over(X.BOXES, select="SELECT box_id, CAST((y1 - y0) * (x1 - x0) AS INTEGER) AS size, CAST(21 + 10 * ceil(greatest(0, (y1 - y0) * (x1 - x0) - 21) / 10.0) AS INTEGER) AS boxsize FROM boxes"))
def c15(s, d):
    return B.minimal_boxsize(X.boxes(s, d).selectExpr("box_id", "CAST((y1 - y0) * (x1 - x0) AS INT) AS size"))


@query("c16_trim_and_center", over(X.V, X.CATALOG, f"""m AS (SELECT o.image_id, o.source_id, o.y AS cy, o.x AS cx, v.y, v.x, CAST(sum(v.value) AS BIGINT) AS value FROM catalog o JOIN v USING (image_id) GROUP BY ALL),
 r AS (SELECT image_id, source_id, cy, cx, max(CASE WHEN value > 30000 THEN greatest(abs(y - cy), abs(x - cx)) ELSE 0 END) AS reach FROM m GROUP BY ALL),
 z AS (SELECT *, CAST(21 + 10 * ceil(greatest(0, 2 * reach + 1 - 21) / 10.0) AS INTEGER) AS boxsize FROM r)""", select="""SELECT z.image_id, z.source_id, z.boxsize, CAST(gy AS INTEGER) AS y, CAST(gx AS INTEGER) AS x, CAST(coalesce(CASE WHEN m.value > 30000 THEN m.value END, 0) AS BIGINT) AS value
 FROM z CROSS JOIN range(-60, 90) a(gy) CROSS JOIN range(-60, 90) b(gx) LEFT JOIN m ON m.image_id = z.image_id AND m.source_id = z.source_id AND m.y = gy AND m.x = gx WHERE gy BETWEEN z.cy - z.boxsize // 2 AND z.cy + z.boxsize // 2 AND gx BETWEEN z.cx - z.boxsize // 2 AND z.cx + z.boxsize // 2"""))
def c16(s, d):
    one = X.catalog(s, d)
    m = sum_coadd(X.v(s, d)).join(one.select("image_id", "source_id"), "image_id").select("image_id", "source_id", "y", "x", "value")
    return B.trim_and_center(m, one, 30000).withColumn("value", F.col("value").cast("long"))


@query("c17_project_image", over(X.V, select="""SELECT g.image_id, g.band, CAST(gy AS INTEGER) AS y, CAST(gx AS INTEGER) AS x, coalesce(v.value, 0) AS value FROM (SELECT DISTINCT image_id, band FROM v) g CROSS JOIN range(21) a(gy) CROSS JOIN range(33) b(gx)
 LEFT JOIN v ON v.image_id = g.image_id AND v.band = g.band AND v.y = gy - 10 + 15 AND v.x = gx - 16 + 12"""))
def c17(s, d):
    return B.project_image(X.v(s, d), 21, 33).withColumn("value", F.col("value").cast("long"))


@query("c18_circle_mask", """SELECT n AS diameter, CAST(gy AS INTEGER) AS y, CAST(gx AS INTEGER) AS x, CASE WHEN pow(2 * gy - (n - 1), 2) + pow(2 * gx - (n - 1), 2) <= n * n THEN 1 ELSE 0 END AS value
 FROM (SELECT DISTINCT CAST(l_quantity AS INTEGER) % 12 + 1 AS n FROM lineitem) CROSS JOIN range(13) a(gy) CROSS JOIN range(13) b(gx) WHERE gy < n AND gx < n""")
def c18(s, d):
    return B.circle_mask(X.table(s, d, "lineitem").selectExpr("CAST(l_quantity AS INT) % 12 + 1 AS diameter").distinct())
