"""Queries over detection (group G)."""

from pyspark.sql import functions as F

from pixelloom.operators import detect as D
from pixelloom.operators import measure as M
from pixelloom.operators.pixels import sum_coadd
from pixelloom.operators.stencil import starlet_transform
from pixelloom.plans import fixtures as X
from pixelloom.plans.registry import over, query


def coadd(s, d):
    return D.mean_threshold(sum_coadd(X.v(s, d)))


NEAR = "(VALUES (0, 1), (1, 0), (0, -1), (-1, 0)) o(dy, dx)"
FG = "cd AS (SELECT image_id, y, x, CAST(sum(value) AS BIGINT) AS value FROM v GROUP BY ALL), fg AS (SELECT image_id, y, x, value FROM (SELECT *, avg(value) OVER (PARTITION BY image_id) AS t FROM cd) WHERE value > t)"


def labels_sql(fg: str = "fg", keys: str = "image_id", name: str = "lab") -> str:
    ks = [k.strip() for k in keys.split(",")]
    on = " AND ".join(f"f.{k} = r.{k}" for k in ks)
    return f"""{name}_r AS (SELECT {keys}, y, x, y AS ly, x AS lx FROM {fg} UNION SELECT {', '.join('r.' + k for k in ks)}, f.y, f.x, r.ly, r.lx FROM {name}_r r CROSS JOIN {NEAR} JOIN {fg} f ON {on} AND f.y = r.y + dy AND f.x = r.x + dx),
{name} AS (SELECT {keys}, y, x, value, label FROM (SELECT {keys}, y, x, min(ly * 65536 + lx) AS label FROM {name}_r GROUP BY ALL) JOIN {fg} USING ({keys}, y, x))"""


def recursive(*ctes: str, select: str) -> str:
    return over(*ctes, select=select).replace("WITH ", "WITH RECURSIVE ", 1)


FP = "fp AS (SELECT image_id, label, min(y) AS y0, max(y) + 1 AS y1, min(x) AS x0, max(x) + 1 AS x1, count(*) AS area FROM lab GROUP BY ALL HAVING (max(y) + 1 - min(y)) * (max(x) + 1 - min(x)) > 4 AND count(*) >= 4)"
FPP = "fpp AS (SELECT lab.* FROM lab JOIN fp USING (image_id, label))"
PEAKS = "pk AS (SELECT a.image_id, a.label, a.y, a.x, a.value AS flux, row_number() OVER (PARTITION BY a.image_id, a.label ORDER BY a.value DESC, a.y, a.x) AS rank FROM fpp a WHERE NOT EXISTS (SELECT 1 FROM fpp b WHERE b.image_id = a.image_id AND b.label = a.label AND b.value >= a.value AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1 AND (a.y, a.x) <> (b.y, b.x)))"


@query("g1_label_components", recursive(X.V, FG, labels_sql(), select="SELECT image_id, y, x, value, CAST(label AS BIGINT) AS label FROM lab"))
def g1(s, d):
    return D.label_components(coadd(s, d), "thresh")


@query("g2_footprints", recursive(X.V, FG, labels_sql(), FP, select="SELECT image_id, CAST(label AS BIGINT) AS label, y0, y1, x0, x1, area FROM fp"))
def g2(s, d):
    return D.footprints(coadd(s, d), "thresh")[0]


@query("g3_local_maxima", recursive(X.V, FG, labels_sql(), FP, FPP, PEAKS, select="SELECT image_id, CAST(label AS BIGINT) AS label, y, x, flux, CAST(rank AS INTEGER) AS rank FROM pk"))
def g3(s, d):
    return D.local_maxima(D.footprints(coadd(s, d), "thresh")[1])


@query("g4_suppress_close")
def g4(s, d):
    return D.suppress_close(D.local_maxima(D.footprints(coadd(s, d), "thresh")[1]), 3.0, ("image_id",))


def planes(s, d):
    c = sum_coadd(X.l(s, d)).withColumn("band", F.lit("sum"))
    return starlet_transform(c, 3)


@query("g5_scale_footprints")
def g5(s, d):
    return D.scale_footprints(planes(s, d), 3)[0]


@query("g6_blend_structures")
def g6(s, d):
    return D.blend_structures(*D.scale_footprints(planes(s, d), 3))


@query("g7_detect_peaks")
def g7(s, d):
    return D.detect_peaks(X.v(s, d), 3).withColumn("flux", F.round("flux", 3))


@query("g8_footprint_image", over(X.BOXES, "b AS (SELECT * FROM boxes)", select="SELECT image_id, CAST(gy AS INTEGER) AS y, CAST(gx AS INTEGER) AS x, (SELECT count(*) FROM b WHERE b.image_id = i.image_id AND gy >= y0 AND gy < y1 AND gx >= x0 AND gx < x1) AS n FROM (SELECT DISTINCT image_id FROM b) i CROSS JOIN range(30) t(gy) CROSS JOIN range(24) u(gx)"))
def g8(s, d):
    from pixelloom.functions.grid import explode_grid

    b = X.boxes(s, d)
    inside = explode_grid(b, "y0", "y1", "x0", "x1").select("image_id", "box_id", "y", "x")
    return D.footprint_image(inside, b.select("image_id").distinct().selectExpr("image_id", "0 AS y0", "30 AS y1", "0 AS x0", "24 AS x1"))


FLAG = recursive(X.V, FG, labels_sql(), FP, FPP, PEAKS, select="""SELECT image_id, CAST(label AS BIGINT) AS label, n_peaks, CAST(flux AS BIGINT) AS flux, round(cy, 6) AS cy, round(cx, 6) AS cx, area FROM fp
 JOIN (SELECT image_id, label, sum(value) AS flux, sum(y * value) / CAST(sum(value) AS DOUBLE) AS cy, sum(x * value) / CAST(sum(value) AS DOUBLE) AS cx FROM fpp GROUP BY ALL) USING (image_id, label) JOIN (SELECT image_id, label, count(*) AS n_peaks FROM pk GROUP BY ALL) USING (image_id, label)""")


@query("flagship", FLAG)
def flagship(s, d):
    """Where the sources are and how bright they are."""
    table, inside = D.footprints(coadd(s, d), "thresh")
    by = ("image_id", "label")
    peaks = D.local_maxima(inside).groupBy(*by).agg(F.count(F.lit(1)).alias("n_peaks"))
    where = M.centroid(inside, by).selectExpr(*by, "round(cy, 6) AS cy", "round(cx, 6) AS cx")
    return table.select(*by, "area").join(M.flux(inside, by), list(by)).join(where, list(by)).join(peaks, list(by))
