"""Scans and sinks: pixel tables, nested cubes, measurement records, models."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pixelloom.functions.grid import IMAGE, cut


def load_pixels(spark: SparkSession, path: str, set_id: int | None = None) -> DataFrame:
    """The pixel table at ``path``, which is partitioned by set_id; the filter prunes whole folders."""
    pixels = spark.read.parquet(path)
    return pixels if set_id is None else pixels.where(F.col("set_id") == set_id)


def save_pixels(pixels: DataFrame, path: str) -> None:
    """Write a pixel table partitioned by set_id."""
    pixels.write.partitionBy("set_id").parquet(path)


def cube_to_pixels(cubes: DataFrame, col: str = "cube") -> DataFrame:
    """Nested [band][y][x] arrays to pixel rows; ``band`` is the index."""
    bands = cubes.select(IMAGE, F.posexplode(col).alias("band", "rows"))
    rows = bands.select(IMAGE, "band", F.posexplode("rows").alias("y", "row"))
    return rows.select(IMAGE, "band", "y", F.posexplode("row").alias("x", "value"))


def pixels_to_cube(pixels: DataFrame) -> DataFrame:
    """Pixel rows to one dense [band][y][x] array for each image; bands in the order of their names, missing pixels 0."""
    size = pixels.groupBy(IMAGE).agg(F.max("y").alias("y9"), F.max("x").alias("x9"))
    cells = pixels.groupBy(IMAGE, "band", "y").agg(F.map_from_entries(F.collect_list(F.struct("x", "value"))).alias("cells"))
    rows = cells.join(size, IMAGE).select(IMAGE, "band", "y", "y9", "x9", F.transform(F.sequence(F.lit(0), F.col("x9")), lambda x: F.coalesce(F.try_element_at("cells", x), F.lit(0))).alias("row"))
    planes = rows.groupBy(IMAGE, "band", "y9", "x9").agg(F.map_from_entries(F.collect_list(F.struct("y", "row"))).alias("rows"))
    empty = F.transform(F.sequence(F.lit(0), F.col("x9")), lambda x: F.lit(0).cast(pixels.schema["value"].dataType))
    dense = planes.select(IMAGE, "band", F.transform(F.sequence(F.lit(0), F.col("y9")), lambda y: F.coalesce(F.try_element_at("rows", y), empty)).alias("plane"))
    return dense.groupBy(IMAGE).agg(F.transform(F.array_sort(F.collect_list(F.struct("band", "plane"))), lambda p: p["plane"]).alias("cube"))


def list_blends(blends: DataFrame, set_id: int | None = None) -> DataFrame:
    """The distinct image ids of one data set, or of all."""
    found = blends if set_id is None else blends.where(F.col("set_id") == set_id)
    return found.select(IMAGE).distinct()


def list_blend_files(spark: SparkSession, path: str, pattern: str = r"([^/]+)\.parquet$") -> DataFrame:
    """``blend_id``, the first group of ``pattern``, of each file in a folder, from the file index alone."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*").option("recursiveFileLookup", "true").load(path).select("path")
    return files.select(F.regexp_extract("path", pattern, 1).alias("blend_id")).where("blend_id <> ''").distinct()


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Old records without those that ``new`` has, and the new ones; of repeated new keys any one row that is greatest in column order."""
    rest = [c for c in new.columns if c not in keys]
    last = new.groupBy(*keys).agg(F.max(F.struct(*rest)).alias("r")).select(*keys, *[F.col(f"r.{c}").alias(c) for c in rest])
    return old.join(last.select(*keys), keys, "left_anti").select(*new.columns).unionByName(last.select(*new.columns))


def save_measurements(new: DataFrame, path: str, keys: tuple[str, ...] = ("set_id", "branch", "blend_id", "source_id")) -> None:
    """Upsert records into the table at ``path``, partitioned by set and branch; only touched partitions are written again."""
    try:
        there = new.sparkSession.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        merged = upsert(new.limit(0), new, list(keys))
    else:
        touched = new.select("set_id", "branch").distinct()
        merged = upsert(there.join(touched, ["set_id", "branch"], "left_semi"), new, list(keys))
    cut(merged).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("set_id", "branch").parquet(path)


def measurement_id(df: DataFrame) -> DataFrame:
    """``meas_id``: "blend_id,source_id"."""
    return df.withColumn("meas_id", F.concat_ws(",", F.col("blend_id").cast("string"), F.col("source_id").cast("string")))


def parse_measurement_id(df: DataFrame) -> DataFrame:
    """blend_id and source_id out of ``meas_id``."""
    parts = F.split("meas_id", ",")
    return df.withColumn("blend_id", parts[0].cast("long")).withColumn("source_id", parts[1].cast("long"))


def register_branch(branches: DataFrame, branch: str) -> DataFrame:
    """The branch list with one more name, once."""
    return branches.select("branch").union(branches.sparkSession.createDataFrame([(branch,)], "branch string")).distinct()


def merged_branches(branches: DataFrame, merged: DataFrame) -> DataFrame:
    """Merged branches (branch, merged_at) that have been processed, newest first with their number."""
    found = merged.join(branches.select("branch").distinct(), "branch", "left_semi")
    return found.withColumn("position", F.row_number().over(Window.orderBy(F.desc("merged_at"), "branch")))


def save_model(seds: DataFrame, morphs: DataFrame, boxes: DataFrame, path: str) -> None:
    """Write the sources of a fit, without its data, so that it can go on later."""
    for name, df in (("seds", seds), ("morphs", morphs), ("boxes", boxes)):
        df.repartition(IMAGE).sortWithinPartitions(IMAGE).write.parquet(f"{path}/{name}")


def save_state(state: DataFrame, path: str) -> None:
    """Write a fit's state (``blocks.started`` and on): components with moments, iteration and losses, so that the fit can go on or take more sources."""
    state.repartition(IMAGE).sortWithinPartitions(IMAGE).write.parquet(path)


def load_state(spark: SparkSession, path: str) -> DataFrame:
    """What ``save_state`` wrote."""
    return spark.read.parquet(path)


def load_model(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What ``save_model`` wrote: seds, morphs, boxes."""
    return tuple(spark.read.parquet(f"{path}/{name}") for name in ("seds", "morphs", "boxes"))
