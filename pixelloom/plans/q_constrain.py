"""Queries over constraints (group K)."""

from pyspark.sql import functions as F

from pixelloom.operators import constrain as K
from pixelloom.operators.pixels import band_noise
from pixelloom.plans import fixtures as X
from pixelloom.plans.q_models import MORPHS, SEDS, seds
from pixelloom.plans.q_models import morphs as pyramids
from pixelloom.plans.registry import over, query

C = "image_id, source_id, comp_id"
# Stamps of grid E as components: signed values, centred at (4, 4).
ST = "st AS (SELECT image_id, CAST(label AS BIGINT) AS source_id, CAST(0 AS INTEGER) AS comp_id, y, x, value AS m FROM e JOIN embeddings ON vec_id = image_id)"
PARTS = [X.E, ST]


def stamps(s, d):
    e = X.e(s, d).drop("set_id")
    return e.join(X.table(s, d, "embeddings").selectExpr("vec_id AS image_id", "CAST(label AS BIGINT) AS source_id"), "image_id").selectExpr("image_id", "source_id", "0 AS comp_id", "y", "x", "value AS m")


def centers(df):
    return K.middle(df)


@query("k1_positivity", over(*PARTS, select=f"SELECT {C}, y, x, greatest(m, 5) AS m FROM st"))
def k1(s, d):
    return K.positivity(stamps(s, d), 5).withColumn("m", F.col("m").cast("long"))


@query("k2_thresholds", over(*PARTS, select=f"SELECT {C}, y, x, CAST(CASE WHEN abs(m) < 500 THEN 0 ELSE m END AS DOUBLE) AS hard, CAST(sign(m) * greatest(abs(m) - 250, 0) AS DOUBLE) AS soft, CAST(CASE WHEN m < 500 THEN 0 ELSE m END AS DOUBLE) AS plus FROM st"))
def k2(s, d):
    t = stamps(s, d).selectExpr("*", "CAST(m AS DOUBLE) AS hard", "CAST(m AS DOUBLE) AS soft", "CAST(m AS DOUBLE) AS plus")
    t = K.soft_threshold(K.hard_threshold(t, 500, col="hard"), 500, step=0.5, col="soft")
    return K.hard_threshold(t, 500, positive=True, col="plus").drop("m").withColumn("soft", F.col("soft") + 0.0)


@query("k3_histogram_threshold", over(*PARTS, "p AS (SELECT *, log10(m) AS l FROM st WHERE m > 0)", "g AS (SELECT image_id, min(l) AS lo, max(l) AS hi, greatest(count(*) // 10, 1) AS bins FROM p GROUP BY ALL)",
    "u AS (SELECT DISTINCT p.image_id, bins, lo, (hi - lo) / bins AS width, CAST(least(floor((l - lo) / ((hi - lo) / bins)), bins - 1) AS BIGINT) AS b FROM p JOIN g USING (image_id) WHERE bins > 1)",
    "z AS (SELECT i.image_id, max(pow(10, lo + i.k * width)) AS cutoff FROM (SELECT DISTINCT image_id, lo, width, unnest(range(bins)) AS k FROM u) i WHERE NOT EXISTS (SELECT 1 FROM u WHERE u.image_id = i.image_id AND u.b = i.k) GROUP BY ALL)",
    select=f"SELECT {C}, y, x, CAST(CASE WHEN m >= coalesce(cutoff, 0) THEN m ELSE 0 END AS DOUBLE) AS m FROM st LEFT JOIN z USING (image_id)"))
def k3(s, d):
    return K.histogram_threshold(stamps(s, d)).withColumn("m", F.col("m").cast("double"))


@query("k4_center_on", over(*PARTS, select=f"SELECT {C}, y, x, CAST(CASE WHEN y = 4 AND x = 4 THEN greatest(m, 100) ELSE m END AS DOUBLE) AS m FROM st"))
def k4(s, d):
    return K.center_on(stamps(s, d), 100.0).withColumn("m", F.col("m").cast("double"))


@query("k5_leaky_chain", over(*PARTS, select=f"SELECT {C}, y, x, round(0.25e0 * m + 0.75e0 * CASE WHEN greatest(m, 0) < 300 THEN 0 ELSE m END, 6) AS m FROM st"))
def k5(s, d):
    t = stamps(s, d).withColumn("m", F.col("m").cast("double"))
    return K.leaky(t, K.chain(t, [K.positivity, lambda x: K.hard_threshold(x, 300.0)], 2), 0.25).withColumn("m", F.round("m", 6))


STEPS = "(VALUES (-1,-1),(-1,0),(-1,1),(0,-1),(0,1),(1,-1),(1,0),(1,1)) s(dy, dx)"
NEI = f"nb AS (SELECT DISTINCT y, x, dy, dx, -(dy * (y - 4) + dx * (x - 4)) / sqrt(CAST((dy * dy + dx * dx) * ((y - 4) * (y - 4) + (x - 4) * (x - 4)) AS DOUBLE)) AS c FROM (SELECT DISTINCT y, x FROM st) CROSS JOIN {STEPS} WHERE (y + dy - 4) * (y + dy - 4) + (x + dx - 4) * (x + dx - 4) < (y - 4) * (y - 4) + (x - 4) * (x - 4))"
PARENT = "pa AS (SELECT y, x, y + arg_max(dy, c) AS py, x + arg_max(dx, c) AS px FROM nb GROUP BY y, x)"


@query("k6_monotonic_nearest", over(*PARTS, NEI, PARENT, f"walk AS (SELECT {C}, y, x, y AS ay, x AS ax, CAST(m AS DOUBLE) AS b, 1e0 AS f FROM st UNION ALL SELECT w.image_id, w.source_id, w.comp_id, w.y, w.x, py, px, s.m * w.f * 0.75e0, w.f * 0.75e0 FROM walk w JOIN pa ON pa.y = w.ay AND pa.x = w.ax JOIN st s ON s.image_id = w.image_id AND s.y = py AND s.x = px)",
    select=f"SELECT {C}, y, x, round(min(b), 6) AS m FROM walk GROUP BY ALL").replace("WITH ", "WITH RECURSIVE ", 1))
def k6(s, d):
    t = stamps(s, d).withColumn("m", F.col("m").cast("double"))
    return K.monotonic_nearest(t, centers(t), 0.25).withColumn("m", F.round("m", 6))


@query("k7_monotonic_weights", over(*PARTS, NEI, "t AS (SELECT y, x, dy, dx, c / sum(c) OVER (PARTITION BY y, x) AS w FROM nb WHERE abs(c) > 1e-12)", f"one AS (SELECT DISTINCT {C} FROM st)", select=f"SELECT {C}, y, x, dy, dx, round(w, 9) AS w FROM one CROSS JOIN t"))
def k7(s, d):
    t = stamps(s, d)
    return K.monotonic_weights(t, centers(t), "angle").withColumn("w", F.round("w", 9))


@query("k7_monotonic_weighted")
def k7b(s, d):
    t = stamps(s, d)
    return K.monotonic_weighted(t, centers(t), "angle").withColumn("m", F.round("m", 6))


@query("k7_moved_centers", over(*PARTS, f"r AS (SELECT {C}, y, x, row_number() OVER (PARTITION BY {C} ORDER BY m DESC, y, x) AS k FROM st WHERE abs(y - 4) <= 2 AND abs(x - 4) <= 2)", select=f"SELECT {C}, y AS cy, x AS cx FROM r WHERE k = 1"))
def k7c(s, d):
    t = stamps(s, d)
    return K.moved_centers(t, centers(t), 2)


@query("k7_monotonic_follow")
def k7d(s, d):
    t = stamps(s, d)
    return K.monotonic_weighted(t, centers(t), "angle", center_radius=2, use_mask=True).withColumn("m", F.round("m", 6))


@query("k8_monotonic_mask", over(*PARTS, f"r AS (SELECT {C}, y, x, m FROM st WHERE y = 4 AND x = 4 UNION SELECT s.image_id, s.source_id, s.comp_id, s.y, s.x, s.m FROM r CROSS JOIN (VALUES (0,1),(1,0),(0,-1),(-1,0)) o(dy, dx) JOIN st s ON s.image_id = r.image_id AND s.y = r.y + dy AND s.x = r.x + dx WHERE s.m < r.m + 200 AND s.m > 0)",
    select=f"SELECT {', '.join('st.' + c.strip() for c in C.split(','))}, st.y, st.x, coalesce(r.m, 0) AS m, r.m IS NOT NULL AS valid FROM st LEFT JOIN r ON r.image_id = st.image_id AND r.y = st.y AND r.x = st.x").replace("WITH ", "WITH RECURSIVE ", 1))
def k8(s, d):
    t = stamps(s, d)
    return K.monotonic_mask(t, centers(t), 200).withColumn("m", F.col("m").cast("long"))


@query("k8_monotonic_fill")
def k8b(s, d):
    t = stamps(s, d)
    return K.monotonic_mask(t, centers(t), 200, max_iter=2)


FLIP = "f AS (SELECT a.*, b.m AS flip FROM st a LEFT JOIN st b ON a.image_id = b.image_id AND b.y = 8 - a.y AND b.x = 8 - a.x)"


@query("k9_symmetry", over(*PARTS, FLIP, select=f"SELECT {C}, y, x, round(0.25e0 * (m + coalesce(flip, 0)) + 0.5e0 * m, 6) AS m FROM f"))
def k9(s, d):
    return K.symmetry(stamps(s, d), 0.5).withColumn("m", F.round("m", 6))


@query("k10_symmetry_min", over(*PARTS, FLIP, select=f"SELECT {C}, y, x, CASE WHEN flip IS NULL THEN m ELSE least(m, flip) END AS m FROM f"))
def k10(s, d):
    t = stamps(s, d)
    return K.symmetry_min(t, centers(t))


@query("k11_symmetry_subpixel")
def k11(s, d):
    v = X.v(s, d)
    return K.symmetry_subpixel(v, X.v_planes(s, d).select("image_id").distinct().selectExpr("image_id", "0.25D AS shift_y", "-0.4D AS shift_x")).withColumn("value", F.round("value", 3))


def two_seds(s, d):
    return seds(s, d).selectExpr("image_id", "source_id", "band", "sed + 10 * length(band) AS bulge", "sed % 977 AS disk")


def walk_sql(name: str, new: str, after: str) -> str:
    """One band after the other; a difference below the last one's is replaced."""
    low = "n.bulge - n.disk < p.diff AND n.i < n.last"
    return f"""{name} AS (SELECT image_id, source_id, i, CAST(disk AS DOUBLE) AS new, CAST(bulge - disk AS DOUBLE) AS diff FROM n WHERE i = 0
 UNION ALL SELECT n.image_id, n.source_id, n.i, CASE WHEN {low} THEN {new} ELSE n.disk END, CASE WHEN {low} THEN {after} ELSE n.bulge - n.disk END FROM {name} p JOIN n ON n.image_id = p.image_id AND n.source_id = p.source_id AND n.i = p.i + 1)"""


@query("k12_bluer_disk", over(X.V, X.CATALOG, SEDS, """n AS (SELECT *, (last_value(bulge - disk) OVER w - first) / CAST(last AS DOUBLE) AS slope FROM (SELECT image_id, source_id, band, sed + 10 * length(band) AS bulge, sed % 977 AS disk, row_number() OVER (PARTITION BY image_id, source_id ORDER BY band) - 1 AS i, count(*) OVER (PARTITION BY image_id, source_id) - 1 AS last,
 first_value(sed + 10 * length(band) - sed % 977) OVER (PARTITION BY image_id, source_id ORDER BY band) AS first FROM sd) WINDOW w AS (PARTITION BY image_id, source_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))""",
    walk_sql("a", "n.bulge - (n.slope * n.i + n.first)", "n.slope * n.i + n.first"), walk_sql("b", "n.disk + p.diff", "p.diff"),
    select="SELECT n.image_id, n.source_id, n.band, round(a.new, 6) AS mean, round(b.new, 6) AS previous FROM n JOIN a USING (image_id, source_id, i) JOIN b USING (image_id, source_id, i)").replace("WITH ", "WITH RECURSIVE ", 1))
def k12(s, d):
    t = two_seds(s, d)
    a = K.bluer_disk(t, "mean").withColumnRenamed("disk", "mean")
    both = a.join(K.bluer_disk(t, "previous").withColumnRenamed("disk", "previous"), ["image_id", "source_id", "band"])
    return both.withColumn("mean", F.round("mean", 6)).withColumn("previous", F.round("previous", 6))


@query("k13_clip_profile_params", over(X.CATALOG, "p AS (SELECT image_id, source_id, source_id % 3 - 1e0 AS r, source_id % 5 / 3e0 AS e1, source_id % 4 / 3e0 AS e2, source_id % 9 - 3e0 AS nu FROM catalog)", "q AS (SELECT *, CASE WHEN sqrt(e1 * e1 + e2 * e2) >= 1 THEN 1 / (1.1e0 * sqrt(e1 * e1 + e2 * e2)) ELSE 1 END AS f FROM p)",
    select="SELECT image_id, source_id, greatest(r, 0.01e0) AS radius, round(e1 * f, 9) AS e1, round(e2 * f, 9) AS e2, greatest(-0.85e0, least(4e0, nu)) AS nu FROM q"))
def k13(s, d):
    c = X.catalog(s, d).selectExpr("image_id", "source_id", "source_id % 3 - 1.0D AS radius", "source_id % 5 / 3.0D AS e1", "source_id % 4 / 3.0D AS e2", "source_id % 9 - 3.0D AS nu")
    return K.clip_profile_params(c).withColumn("e1", F.round("e1", 9)).withColumn("e2", F.round("e2", 9))


@query("k14_background_cut", over(X.V, X.CATALOG, SEDS, MORPHS, "n AS (SELECT image_id, band, avg(sqrt(variance)) AS rms FROM v GROUP BY ALL)", "t AS (SELECT image_id, source_id, min(CASE WHEN sed > 0 THEN 100 * rms / sed END) AS t FROM sd JOIN n USING (image_id, band) GROUP BY ALL)",
    "k AS (SELECT mo.image_id, mo.source_id, mo.comp_id, mo.y, mo.x, CASE WHEN mo.m >= coalesce(t, 1e300) THEN CAST(mo.m AS DOUBLE) ELSE 0 END AS m, mo.y = c.y AND mo.x = c.x AS mid FROM mo JOIN t USING (image_id, source_id) JOIN catalog c USING (image_id, source_id))", "w AS (SELECT *, CASE WHEN mid THEN greatest(m, 1e-20) ELSE m END AS q FROM k)",
    select="SELECT image_id, source_id, comp_id, y, x, round(q / max(q) OVER (PARTITION BY image_id, source_id), 9) AS m FROM w"))
def k14(s, d):
    v = X.v(s, d)
    return K.background_cut(seds(s, d), pyramids(s, d), band_noise(v), 100.0).withColumn("m", F.round("m", 9))


@query("k15_extended_constraints")
def k15(s, d):
    t = stamps(s, d).withColumn("m", F.col("m").cast("double"))
    return K.extended_constraints(t, centers(t), "angle", symmetric=True).withColumn("m", F.round("m", 6))
