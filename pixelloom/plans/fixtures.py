"""Pixel tables derived from the driver's tables, for the registered queries; the same as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PIXEL = "image_id BIGINT, band STRING, y INT, x INT, value BIGINT, variance BIGINT, masked BOOLEAN"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def finished(df: DataFrame) -> DataFrame:
    return df.withColumn("value", F.coalesce("value", F.lit(0)).cast("long")).selectExpr("image_id", "band", "y", "x", "value", "1 + value AS variance", "(y + x) % 17 = 0 AS masked")


def dense(sums: DataFrame, ny: int, nx: int) -> DataFrame:
    """Planes of ny x nx pixels from sums (image_id, band, y, x, value): each image and band that has any, 0 where there is none.

    A plane's few sums come together as one row, so no table of pixels is shuffled. The cross joins let Spark
    expect as many rows as there are: after ``explode`` it takes the pixels for a small table and broadcasts them.
    """
    spark, plane = sums.sparkSession, ["image_id", "band"]
    listed = lambda k, *c: F.map_from_entries(F.collect_list(F.when(F.col(k).isNotNull(), F.struct(k, *c))))
    # As many tasks as other shuffles have: put together by the size of the sums, they would have too many pixels.
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = sums.repartition(parts, *plane).groupBy(*plane, "y").agg(listed("x", "value").alias("row"))
    planes = rows.groupBy(*plane).agg(listed("y", "row").alias("plane"))
    axis = lambda name, n: spark.range(n).select(F.col("id").cast("int").alias(name))
    lines = planes.crossJoin(axis("y", ny)).select(*plane, "y", F.try_element_at("plane", F.col("y")).alias("row"))
    cells = lines.crossJoin(axis("x", nx))
    at = F.try_element_at("row", F.col("x"))
    return cells.select(*plane, "y", "x", F.when(F.col("image_id").isNotNull() & F.col("band").isNotNull(), at).alias("value"))


def v_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """image_id and band of each plane of ``v``, without making its pixels."""
    return table(spark, sf_dir, "events").selectExpr("user_id div 6 AS image_id", "event_type AS band").distinct()


def v(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five-band cubes of 30 x 24 pixels from the events, dense."""
    e = table(spark, sf_dir, "events").selectExpr("user_id div 6 AS image_id", "event_type AS band", "CAST(datediff(CAST(ts AS DATE), DATE'2024-01-01') AS INT) AS y", "CAST(hour(ts) AS INT) AS x", "CAST(round(value * 100) AS BIGINT) AS v")
    return finished(dense(e.groupBy("image_id", "band", "y", "x").agg(F.sum("v").alias("value")), 30, 24))


V = """
ve AS (SELECT user_id // 6 AS image_id, event_type AS band, CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS INTEGER) AS y,
  CAST(hour(ts) AS INTEGER) AS x, CAST(round(value * 100) AS BIGINT) AS v FROM events),
v AS (SELECT g.image_id, g.band, CAST(gy AS INTEGER) AS y, CAST(gx AS INTEGER) AS x, CAST(coalesce(s.value, 0) AS BIGINT) AS value,
  CAST(1 + coalesce(s.value, 0) AS BIGINT) AS variance, (gy + gx) % 17 = 0 AS masked
  FROM (SELECT DISTINCT image_id, band FROM ve) g CROSS JOIN range(30) a(gy) CROSS JOIN range(24) b(gx)
  LEFT JOIN (SELECT image_id, band, y, x, sum(v) AS value FROM ve GROUP BY ALL) s ON s.image_id = g.image_id AND s.band = g.band AND s.y = gy AND s.x = gx)"""


def l(spark: SparkSession, sf_dir: str) -> DataFrame:  # noqa: E743
    """Three-band density images of 50 x 50 pixels from the line items, dense."""
    e = table(spark, sf_dir, "lineitem").selectExpr("l_suppkey div 5 AS image_id", "l_returnflag AS band", "CAST(l_quantity AS INT) - 1 AS y", "least(49, CAST(floor(l_extendedprice / 2100) AS INT)) AS x")
    return finished(dense(e.groupBy("image_id", "band", "y", "x").agg(F.count(F.lit(1)).alias("value")), 50, 50))


L = """
le AS (SELECT l_suppkey // 5 AS image_id, l_returnflag AS band, CAST(l_quantity AS INTEGER) - 1 AS y, least(49, CAST(floor(l_extendedprice / 2100) AS INTEGER)) AS x FROM lineitem),
l AS (SELECT g.image_id, g.band, CAST(gy AS INTEGER) AS y, CAST(gx AS INTEGER) AS x, CAST(coalesce(s.value, 0) AS BIGINT) AS value,
  CAST(1 + coalesce(s.value, 0) AS BIGINT) AS variance, (gy + gx) % 17 = 0 AS masked
  FROM (SELECT DISTINCT image_id, band FROM le) g CROSS JOIN range(50) a(gy) CROSS JOIN range(50) b(gx)
  LEFT JOIN (SELECT image_id, band, y, x, count(*) AS value FROM le GROUP BY ALL) s ON s.image_id = g.image_id AND s.band = g.band AND s.y = gy AND s.x = gx)"""


def e(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stamps of 8 x 8 pixels from the embeddings; set_id 1..3."""
    d = table(spark, sf_dir, "embeddings").selectExpr("vec_id AS image_id", "CAST(label % 3 + 1 AS INT) AS set_id", "posexplode(embedding) AS (i, v)")
    return d.selectExpr("image_id", "'e' AS band", "CAST(i div 8 AS INT) AS y", "CAST(i % 8 AS INT) AS x", "CAST(floor(CAST(v AS DOUBLE) * 10000) AS BIGINT) AS value", "CAST(1 AS BIGINT) AS variance", "false AS masked", "set_id")


E = """
ee AS (SELECT vec_id, label, unnest(embedding) AS v, unnest(range(len(embedding))) AS i FROM embeddings),
e AS (SELECT vec_id AS image_id, 'e' AS band, CAST(i // 8 AS INTEGER) AS y, CAST(i % 8 AS INTEGER) AS x, CAST(floor(CAST(v AS DOUBLE) * 10000) AS BIGINT) AS value,
  CAST(1 AS BIGINT) AS variance, false AS masked, CAST(label % 3 + 1 AS INTEGER) AS set_id FROM ee)"""


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source centres on grid V from the suppliers, four to an image: two pairs of close neighbours."""
    return table(spark, sf_dir, "supplier").selectExpr("s_suppkey div 4 AS image_id", "s_suppkey AS source_id", "CAST(17 * (s_suppkey div 2) % 28 + 2 * (s_suppkey % 2) AS INT) AS y", "CAST(7 * (s_suppkey div 2) % 22 + s_suppkey % 2 AS INT) AS x")


CATALOG = """
catalog AS (SELECT s_suppkey // 4 AS image_id, s_suppkey AS source_id, CAST(17 * (s_suppkey // 2) % 28 + 2 * (s_suppkey % 2) AS INTEGER) AS y,
  CAST(7 * (s_suppkey // 2) % 22 + s_suppkey % 2 AS INTEGER) AS x FROM supplier)"""


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes from the orders."""
    return table(spark, sf_dir, "orders").selectExpr("o_orderkey div 600 AS image_id", "o_orderkey AS box_id", "CAST(o_custkey % 40 AS INT) AS y0", "CAST(o_custkey % 40 + 1 + o_orderkey % 9 AS INT) AS y1", "CAST(CAST(floor(o_totalprice) AS BIGINT) % 40 AS INT) AS x0", "CAST(CAST(floor(o_totalprice) AS BIGINT) % 40 + 1 + o_custkey % 7 AS INT) AS x1")


BOXES = """
boxes AS (SELECT o_orderkey // 600 AS image_id, o_orderkey AS box_id, CAST(o_custkey % 40 AS INTEGER) AS y0, CAST(o_custkey % 40 + 1 + o_orderkey % 9 AS INTEGER) AS y1,
  CAST(CAST(floor(o_totalprice) AS BIGINT) % 40 AS INTEGER) AS x0, CAST(CAST(floor(o_totalprice) AS BIGINT) % 40 + 1 + o_custkey % 7 AS INTEGER) AS x1 FROM orders)"""


def measurements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measurement records from the orders."""
    return table(spark, sf_dir, "orders").selectExpr("CAST(o_custkey % 3 + 1 AS INT) AS set_id", "o_orderpriority AS branch", "o_orderkey AS blend_id", "o_custkey % 4 AS source_id", "CAST(round(o_totalprice * 100) AS BIGINT) AS runtime", "o_custkey % 10 AS g_truth", "o_orderkey % 10 AS g_mag")


MEAS = """
meas AS (SELECT CAST(o_custkey % 3 + 1 AS INTEGER) AS set_id, o_orderpriority AS branch, o_orderkey AS blend_id, o_custkey % 4 AS source_id,
  CAST(round(o_totalprice * 100) AS BIGINT) AS runtime, o_custkey % 10 AS g_truth, o_orderkey % 10 AS g_mag FROM orders)"""


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """True magnitudes of two thirds of the catalogue, in all bands of V."""
    bands = table(spark, sf_dir, "events").select(F.col("event_type").alias("band")).distinct()
    return catalog(spark, sf_dir).where("source_id % 3 <> 0").join(bands).selectExpr("image_id", "y", "x", "band", "20 + source_id % 7 AS mag")


TRUTH = """
truth AS (SELECT image_id, y, x, band, 20 + source_id % 7 AS mag FROM catalog CROSS JOIN (SELECT DISTINCT event_type AS band FROM events) WHERE source_id % 3 <> 0)"""

BINOMIAL3 = [(dy, dx, (2 - abs(dy)) * (2 - abs(dx))) for dy in (-1, 0, 1) for dx in (-1, 0, 1)]
ASYMMETRIC3 = [(dy, dx, 1 + (dy + 1) * 3 + (dx + 1)) for dy in (-1, 0, 1) for dx in (-1, 0, 1)]


def kernel(pixels: DataFrame, entries: list[tuple[int, int, int]]) -> DataFrame:
    """A kernel table with the same entries for each image and band of ``pixels``."""
    literal = ", ".join(f"({dy}, {dx}, CAST({k} AS BIGINT))" for dy, dx, k in entries)
    return pixels.select("image_id", "band").distinct().selectExpr("image_id", "band", f"inline(array({literal})) AS (dy, dx, k)")


def kernel_sql(source: str, entries: list[tuple[int, int, int]]) -> str:
    literal = ", ".join(f"({dy}, {dx}, {k})" for dy, dx, k in entries)
    return f"kern AS (SELECT image_id, band, dy, dx, k FROM (SELECT DISTINCT image_id, band FROM {source}) CROSS JOIN (VALUES {literal}) t(dy, dx, k))"


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An affine frame for each image of V: identity, doubled or rotated by image number."""
    ids = table(spark, sf_dir, "events").selectExpr("user_id div 6 AS image_id").distinct()
    return ids.selectExpr("image_id", "30 AS ny", "24 AS nx", *FRAME_COLUMNS)


FRAME_COLUMNS = [
    "CASE image_id % 3 WHEN 0 THEN 1.0D WHEN 1 THEN 2.0D ELSE 0.8D END AS pc11",
    "CASE image_id % 3 WHEN 2 THEN -0.6D ELSE 0.0D END AS pc12",
    "CASE image_id % 3 WHEN 2 THEN 0.6D ELSE 0.0D END AS pc21",
    "CASE image_id % 3 WHEN 0 THEN 1.0D WHEN 1 THEN 2.0D ELSE 0.8D END AS pc22",
    "CAST(12 AS DOUBLE) AS crpix1",
    "CAST(15 AS DOUBLE) AS crpix2",
    "CAST(100 + image_id % 200 AS DOUBLE) AS crval1",
    "CAST(10 AS DOUBLE) AS crval2",
]
FRAMES = "frames AS (SELECT image_id, 30 AS ny, 24 AS nx, " + ", ".join(c.replace("D WHEN", " WHEN").replace("D ELSE", " ELSE").replace("D END", " END").replace("CASE", "CAST(CASE").replace("END AS", "END AS DOUBLE) AS") for c in FRAME_COLUMNS) + " FROM (SELECT DISTINCT user_id // 6 AS image_id FROM events))"
