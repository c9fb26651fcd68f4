"""Queries over source models (group I)."""

from pyspark.sql import functions as F

from pixelloom.operators import models as O
from pixelloom.operators.frames import frame_of
from pixelloom.plans import fixtures as X
from pixelloom.plans.registry import over, query

PYRAMID = ", ".join(f"({dy}, {dx}, {3 - max(abs(dy), abs(dx))})" for dy in range(-2, 3) for dx in range(-2, 3))
SEDS = "sd AS (SELECT c.image_id, source_id, CAST(0 AS INTEGER) AS comp_id, band, v.value AS sed FROM catalog c JOIN v USING (image_id, y, x))"
MORPHS = f"mo AS (SELECT image_id, source_id, CAST(0 AS INTEGER) AS comp_id, y + dy AS y, x + dx AS x, m FROM catalog CROSS JOIN (VALUES {PYRAMID}) p(dy, dx, m))"
PARTS = [X.V, X.CATALOG, SEDS, MORPHS]


def seds(s, d):
    return X.catalog(s, d).join(X.v(s, d), ["image_id", "y", "x"]).selectExpr("image_id", "source_id", "0 AS comp_id", "band", "value AS sed")


def morphs(s, d):
    return X.catalog(s, d).selectExpr("image_id", "source_id", "y AS cy", "x AS cx", f"inline(array({PYRAMID})) AS (dy, dx, m)").selectExpr("image_id", "source_id", "0 AS comp_id", "cy + dy AS y", "cx + dx AS x", "m")


@query("i1_component_model", over(*PARTS, select="SELECT sd.image_id, sd.source_id, sd.comp_id, band, y, x, sed * m AS value FROM sd JOIN mo USING (image_id, source_id)"))
def i1(s, d):
    return O.component_model(seds(s, d), morphs(s, d))


@query("i2_cube_model", over(X.V, X.CATALOG, select="SELECT c.image_id, source_id, band, v.y + c.y AS y, v.x + c.x AS x, v.value FROM catalog c JOIN v USING (image_id)"))
def i2(s, d):
    c = X.catalog(s, d)
    cubes = c.select("image_id", "source_id").join(X.v(s, d), "image_id").selectExpr("image_id", "source_id", "band", "y", "x", "value AS m")
    return O.cube_model(cubes, c.selectExpr("image_id", "source_id", "y AS y0", "x AS x0"))


@query("i3_combine", over(*PARTS, select="SELECT image_id, y, x, CAST(sum(m) AS BIGINT) AS added, CAST(product(m) AS DOUBLE) AS multiplied FROM mo GROUP BY ALL"))
def i3(s, d):
    m = morphs(s, d).withColumnRenamed("m", "value")
    by = ("image_id", "y", "x")
    return O.combine(m, "add", by).withColumnRenamed("value", "added").join(O.combine(m, "multiply", by).withColumnRenamed("value", "multiplied"), list(by))


@query("i4_source_model", over(*PARTS, select="SELECT sd.image_id, sd.source_id, band, y, x, CAST(sum(sed * m) AS BIGINT) AS value FROM sd JOIN mo USING (image_id, source_id) GROUP BY ALL"))
def i4(s, d):
    return O.source_model(seds(s, d), morphs(s, d))


@query("i4_blend_model", over(*PARTS, "t AS (SELECT sd.image_id, band, y, x, CAST(sum(sed * m) AS BIGINT) AS value FROM sd JOIN mo USING (image_id, source_id) GROUP BY ALL)", select="SELECT v.image_id, v.band, v.y, v.x, coalesce(t.value, 0) AS value FROM v LEFT JOIN t USING (image_id, band, y, x)"))
def i4b(s, d):
    return O.blend_model(seds(s, d), morphs(s, d), X.v(s, d))


def erf_sql(x: str) -> str:
    """The rational approximation of the error function as SQL."""
    t = f"(1 / (1 + 0.3275911e0 * abs({x})))"
    return f"(sign({x}) * (1 - {t} * (0.254829592e0 + {t} * (-0.284496736e0 + {t} * (1.421413741e0 + {t} * (-1.453152027e0 + {t} * 1.061405429e0)))) * exp(-({x}) * ({x}))))"


def part_sql(a: str, sigma: str) -> str:
    return f"({erf_sql(f'(({a}) + 0.5e0) / ({sigma} * sqrt(2e0))')} - {erf_sql(f'(({a}) - 0.5e0) / ({sigma} * sqrt(2e0))')})"


def sigmas(s, d):
    return X.v(s, d).select("image_id", "band").distinct().selectExpr("image_id", "band", "0.8D + length(band) / 10.0D AS sigma")


@query("i5_gaussian_psf", over(X.V, "g AS (SELECT image_id, band, CAST(dy AS INTEGER) AS dy, CAST(dx AS INTEGER) AS dx, exp(-(dy * dy + dx * dx) / (2 * sg * sg)) AS k FROM (SELECT DISTINCT image_id, band, 0.8e0 + length(band) / 10e0 AS sg FROM v) CROSS JOIN range(-5, 6) a(dy) CROSS JOIN range(-5, 6) b(dx))", select="SELECT image_id, band, dy, dx, round(k / sum(k) OVER (PARTITION BY image_id, band), 9) AS k FROM g"))
def i5(s, d):
    return O.gaussian_psf(sigmas(s, d), 11, integrated=False).withColumn("k", F.round("k", 9))


@query("i5_gaussian_psf_integrated", over(X.V, "g AS (SELECT image_id, band, CAST(dy AS INTEGER) AS dy, CAST(dx AS INTEGER) AS dx, " + part_sql("dy", "sg") + " * " + part_sql("dx", "sg") + " AS k FROM (SELECT DISTINCT image_id, band, 0.8e0 + length(band) / 10e0 AS sg FROM v) CROSS JOIN range(-9, 10) a(dy) CROSS JOIN range(-9, 10) b(dx) WHERE abs(dy) <= ceil(10 * sg) // 2 AND abs(dx) <= ceil(10 * sg) // 2)",
    select="SELECT image_id, band, dy, dx, round(k / sum(k) OVER (PARTITION BY image_id, band), 8) AS k FROM g"))
def i5b(s, d):
    return O.gaussian_psf(sigmas(s, d)).withColumn("k", F.round("k", 8))


@query("i6_moffat_psf", over(X.V, "g AS (SELECT image_id, band, CAST(dy AS INTEGER) AS dy, CAST(dx AS INTEGER) AS dx, pow(1 + (dy * dy + dx * dx) / (a * a), -2.5e0) AS k FROM (SELECT DISTINCT image_id, band, 1 + length(band) / 10e0 AS a FROM v) CROSS JOIN range(-4, 5) x(dy) CROSS JOIN range(-4, 5) y(dx))", select="SELECT image_id, band, dy, dx, round(k / sum(k) OVER (PARTITION BY image_id, band), 9) AS k FROM g"))
def i6(s, d):
    p = X.v(s, d).select("image_id", "band").distinct().selectExpr("image_id", "band", "1 + length(band) / 10.0D AS alpha", "2.5D AS beta")
    return O.moffat_psf(p, 9).withColumn("k", F.round("k", 9))


def shapes(s, d):
    return X.catalog(s, d).selectExpr("image_id", "source_id", "y + 0.25D AS cy", "x - 0.25D AS cx", "1.5D + source_id % 3 AS radius", "0.1D AS e1", "0.2D AS e2", "-0.5D + source_id % 4 AS nu")


@query("i7_gaussian_profile", over(X.CATALOG, "p AS (SELECT image_id, source_id, y + 0.25e0 AS cy, x - 0.25e0 AS cx, 1.5e0 + source_id % 3 AS r, c.y + dy AS y, c.x + dx AS x FROM catalog c CROSS JOIN range(-4, 5) a(dy) CROSS JOIN range(-4, 5) b(dx))",
    select="SELECT image_id, source_id, CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x, round(exp(-(pow(0.9e0 * (x - cx) - 0.2e0 * (y - cy), 2) + pow(1.1e0 * (y - cy) - 0.2e0 * (x - cx), 2)) / (0.95e0 * r * r) / 2), 9) AS value FROM p"))
def i7(s, d):
    return O.gaussian_profile(shapes(s, d), "9").withColumn("value", F.round("value", 9))


@query("i8_spergel_profile")
def i8(s, d):
    return O.spergel_profile(shapes(s, d), "9").withColumn("value", F.round("value", 6))


@query("i9_point_source_model", over(X.CATALOG, "p AS (SELECT image_id, source_id, y + 0.25e0 AS cy, x - 0.25e0 AS cx, CAST(c.y + dy AS INTEGER) AS y, CAST(c.x + dx AS INTEGER) AS x FROM catalog c CROSS JOIN range(-5, 6) a(dy) CROSS JOIN range(-5, 6) b(dx))",
    select="SELECT image_id, source_id, y, x, round(" + part_sql("y - cy", "1.2e0") + " * " + part_sql("x - cx", "1.2e0") + " / 4, 6) AS value FROM p"))
def i9(s, d):
    return O.point_source_model(shapes(s, d), 1.2, 11).withColumn("value", F.round("value", 6))


@query("i10_integrate_profile", over(X.CATALOG, "o AS (SELECT * FROM catalog)", "w(o, w) AS (VALUES (-0.5e0, 0.25e0), (0e0, 0.5e0), (0.5e0, 0.25e0))",
    select="SELECT image_id, source_id, y, x, sum((pow(y + a.o, 2) + 2 * pow(x + b.o, 2)) * a.w * b.w) AS value FROM o CROSS JOIN w a CROSS JOIN w b GROUP BY image_id, source_id, y, x"))
def i10(s, d):
    return O.integrate_profile(X.catalog(s, d), lambda y, x: y * y + 2 * x * x, 3)


@query("i11_random_components", over(X.V, select="SELECT DISTINCT image_id, CAST(0 AS BIGINT) AS source_id, CAST(0 AS INTEGER) AS comp_id, y, x, round((CAST('0x' || substr(sha256('3:m:' || image_id || ':' || y || ':' || x), 1, 12) AS BIGINT) + 0.5e0) / 281474976710656e0, 9) AS m FROM v"))
def i11(s, d):
    v = X.v(s, d)
    return O.random_components(frame_of(v), v.select("image_id", "band").distinct(), 3)[1].withColumn("m", F.round("m", 9))
