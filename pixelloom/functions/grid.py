"""Small building blocks of all operators: dense grids, checkpoints, scratch folders."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

IMAGE = "image_id"
PLACE = [IMAGE, "band", "y", "x"]


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder that the session names; a new one under /tmp only where all of Spark is one process, as in tests."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not context.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="spark-checkpoint-", dir="/tmp"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder and cut its lineage; survives lost executors."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path for a table inside the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def explode_grid(df: DataFrame, y0: str, y1: str, x0: str, x1: str, y: str = "y", x: str = "x") -> DataFrame:
    """One row for each pixel of the half-open boxes given by four SQL expressions; empty boxes give none.

    Spark expects no more rows after ``explode`` than before, so without the hint a join would broadcast the pixels.
    """
    rows = df.withColumn(y, F.expr(f"explode(CASE WHEN ({y1}) > ({y0}) THEN sequence(CAST({y0} AS INT), CAST({y1} AS INT) - 1) ELSE array() END)"))
    return rows.withColumn(x, F.expr(f"explode(CASE WHEN ({x1}) > ({x0}) THEN sequence(CAST({x0} AS INT), CAST({x1} AS INT) - 1) ELSE array() END)")).hint("merge")


def densify(pixels: DataFrame, fill: dict[str, object] | None = None) -> DataFrame:
    """Every (band, y, x) between 0 and an image's largest y and x; missing values become 0 or what ``fill`` says."""
    sizes = pixels.groupBy(IMAGE).agg(F.max("y").alias("y9"), F.max("x").alias("x9"))
    bands = pixels.select(IMAGE, "band").distinct()
    grid = explode_grid(bands.join(sizes, IMAGE), "0", "y9 + 1", "0", "x9 + 1").select(*PLACE)
    fill = {"value": 0} | (fill or {})
    joined = grid.join(pixels, PLACE, "left")
    return joined.select(*PLACE, *[F.coalesce(F.col(c), F.lit(fill.get(c))).alias(c) if c in fill else F.col(c) for c in pixels.columns if c not in PLACE])


def uniform(seed: int, salt: str, *columns: str) -> F.Column:
    """A number in (0, 1) that only depends on the seed, the salt and the row's columns, on any cluster and partitioning."""
    name = F.concat_ws(":", F.lit(f"{seed}:{salt}"), *[F.col(c).cast("string") for c in columns])
    return (F.conv(F.substring(F.sha2(name, 256), 1, 12), 16, 10).cast("double") + 0.5) / float(2**48)


def split_rank(by: list[str], order: list) -> F.Column:
    """row_number over a partition, as a column."""
    from pyspark.sql import Window

    return F.row_number().over(Window.partitionBy(*by).orderBy(*order))
