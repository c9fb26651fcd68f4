"""Boxes: half-open ranges [y0, y1) x [x0, x1) as rows of a table, and their joins with pixels.

Empty boxes have y1 = y0 or x1 = x0. All columns but the four bounds pass through unless stated.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pixelloom.functions.grid import IMAGE, explode_grid

BOUNDS = ["y0", "y1", "x0", "x1"]


def others(df: DataFrame, *names: str) -> list[str]:
    return [c for c in df.columns if c not in names]


def box_from_data(pixels: DataFrame, min_value: float = 0, by: tuple[str, ...] = (IMAGE,)) -> DataFrame:
    """The tight box of the pixels above ``min_value`` of each group; (0, 0, 0, 0) where there is none."""
    lit = F.col("value") > min_value
    part = lambda f, c, add: F.coalesce(f(F.when(lit, F.col(c))) + add, F.lit(0)).cast("int")
    return pixels.groupBy(*by).agg(part(F.min, "y", 0).alias("y0"), part(F.max, "y", 1).alias("y1"), part(F.min, "x", 0).alias("x0"), part(F.max, "x", 1).alias("x1"))


def box_from_bounds(df: DataFrame) -> DataFrame:
    """Half-open bounds with negative extents clamped to nothing."""
    return df.withColumn("y1", F.greatest("y0", "y1")).withColumn("x1", F.greatest("x0", "x1"))


def box_from_inclusive(df: DataFrame, ymin: str = "ymin", ymax: str = "ymax", xmin: str = "xmin", xmax: str = "xmax") -> DataFrame:
    """Half-open bounds of boxes whose last row and column are included."""
    return df.select(*others(df, ymin, ymax, xmin, xmax), F.col(ymin).alias("y0"), (F.col(ymax) + 1).alias("y1"), F.col(xmin).alias("x0"), (F.col(xmax) + 1).alias("x1"))


def box_props(boxes: DataFrame) -> DataFrame:
    """Height, width, integer centre and area."""
    return boxes.selectExpr("*", "y1 - y0 AS height", "x1 - x0 AS width", "y0 + (y1 - y0) div 2 AS cy", "x0 + (x1 - x0) div 2 AS cx", "CAST((y1 - y0) * (x1 - x0) AS BIGINT) AS area")


def box_grow(boxes: DataFrame, ry: int, rx: int | None = None) -> DataFrame:
    """Boxes larger by ``ry`` rows and ``rx`` columns on each side."""
    return box_set(boxes, f"y0 - {ry}", f"y1 + {ry}", f"x0 - {ry if rx is None else rx}", f"x1 + {ry if rx is None else rx}")


def box_shift(boxes: DataFrame, dy: int, dx: int | None = None) -> DataFrame:
    """Boxes moved by a vector, or by one number in both directions."""
    return box_set(boxes, f"y0 + {dy}", f"y1 + {dy}", f"x0 + {dy if dx is None else dx}", f"x1 + {dy if dx is None else dx}")


def box_set(boxes: DataFrame, *expressions: str) -> DataFrame:
    new = dict(zip(BOUNDS, expressions, strict=True))
    return boxes.select(*[F.expr(new[c]).alias(c) if c in new else F.col(c) for c in boxes.columns])


def paired(a: DataFrame, b: DataFrame, by: list[str]) -> DataFrame:
    """Rows of two box tables side by side; the second's bounds end in _b."""
    return a.join(b.select(*by, *[F.col(c).alias(f"{c}_b") for c in b.columns if c not in by]), by)


def box_union(a: DataFrame, b: DataFrame, by: list[str]) -> DataFrame:
    """The smallest box that holds both boxes of each key."""
    return paired(a, b.select(*by, *BOUNDS), by).selectExpr(*by, "least(y0, y0_b) AS y0", "greatest(y1, y1_b) AS y1", "least(x0, x0_b) AS x0", "greatest(x1, x1_b) AS x1")


def box_union_agg(boxes: DataFrame, by: list[str]) -> DataFrame:
    """The smallest box that holds all boxes of each group."""
    return boxes.groupBy(*by).agg(F.min("y0").alias("y0"), F.max("y1").alias("y1"), F.min("x0").alias("x0"), F.max("x1").alias("x1"))


CLAMPED = ["greatest(y1, y0) AS y1", "greatest(x1, x0) AS x1"]


def box_intersect(a: DataFrame, b: DataFrame, by: list[str]) -> DataFrame:
    """The overlap of both boxes of each key; empty where there is none."""
    inner = paired(a, b.select(*by, *BOUNDS), by).selectExpr(*by, "greatest(y0, y0_b) AS y0", "least(y1, y1_b) AS y1", "greatest(x0, x0_b) AS x0", "least(x1, x1_b) AS x1")
    return inner.selectExpr(*by, "y0", "greatest(y1, y0) AS y1", "x0", "greatest(x1, x0) AS x1")


def box_intersect_agg(boxes: DataFrame, by: list[str]) -> DataFrame:
    """The overlap of all boxes of each group."""
    inner = boxes.groupBy(*by).agg(F.max("y0").alias("y0"), F.min("y1").alias("y1"), F.max("x0").alias("x0"), F.min("x1").alias("x1"))
    return inner.selectExpr(*by, "y0", "greatest(y1, y0) AS y1", "x0", "greatest(x1, x0) AS x1")


def box_compose(spectral: DataFrame, spatial: DataFrame) -> DataFrame:
    """Three-dimensional boxes: each range of bands (c0, c1) of an image with each of its spatial boxes."""
    return spatial.join(spectral.select(IMAGE, "c0", "c1"), IMAGE)


def box_slice(boxes: DataFrame, dims: list[str]) -> DataFrame:
    """Only the named dimensions (c, y, x) of boxes."""
    gone = [f"{d}{e}" for d in "cyx" if d not in dims for e in "01"]
    return boxes.select(*others(boxes, *gone))


def box_dedupe(boxes: DataFrame, by: list[str]) -> DataFrame:
    """One row for equal boxes of a group: the one with the least box_id."""
    return boxes.groupBy(*by, *BOUNDS).agg(F.min("box_id").alias("box_id"))


def overlapped_slices(a: DataFrame, b: DataFrame, by: list[str]) -> DataFrame:
    """The overlap of both boxes of each key, in the coordinates of either one's corner."""
    both = paired(a, b.select(*by, *BOUNDS), by)
    inner = box_intersect(a, b, by).selectExpr(*by, "y0 AS i0", "y1 AS i1", "x0 AS j0", "x1 AS j1")
    return both.join(inner, by).selectExpr(*by, *[f"{i} - {o}{s} AS {n}{t}" for s, t in (("", "_a"), ("_b", "_b")) for i, o, n in (("i0", "y0", "y0"), ("i1", "y0", "y1"), ("j0", "x0", "x0"), ("j1", "x0", "x1"))])


def tiled(boxes: DataFrame, tile: int) -> DataFrame:
    """A row for each tile of ``tile`` pixels that a box touches (ty, tx); empty boxes have none."""
    rows = boxes.where("y1 > y0 AND x1 > x0").withColumn("ty", F.expr(f"explode(sequence(CAST(floor(y0 / {tile}) AS INT), CAST(floor((y1 - 1) / {tile}) AS INT)))"))
    return rows.withColumn("tx", F.expr(f"explode(sequence(CAST(floor(x0 / {tile}) AS INT), CAST(floor((x1 - 1) / {tile}) AS INT)))"))


def box_contains(points: DataFrame, boxes: DataFrame, tile: int = 16) -> DataFrame:
    """Every point with every box of its image that holds it: an equi-join on tiles, then the exact test."""
    at = points.withColumn("ty", F.expr(f"CAST(floor(y / {tile}) AS INT)")).withColumn("tx", F.expr(f"CAST(floor(x / {tile}) AS INT)"))
    return at.join(tiled(boxes, tile), [IMAGE, "ty", "tx"]).where("y >= y0 AND y < y1 AND x >= x0 AND x < x1").drop("ty", "tx")


def box_overlap_join(a: DataFrame, b: DataFrame, tile: int = 16) -> DataFrame:
    """(image_id, a_id, b_id) of boxes that overlap, each pair once.

    Boxes meet in the tiles that both touch; a pair is kept only in the tile of its overlap's first
    pixel, so no distinct is needed.
    """
    left = tiled(a, tile).select(IMAGE, "ty", "tx", F.col("box_id").alias("a_id"), *BOUNDS)
    right = tiled(b, tile).select(IMAGE, "ty", "tx", F.col("box_id").alias("b_id"), *[F.col(c).alias(f"{c}_b") for c in BOUNDS])
    met = left.join(right, [IMAGE, "ty", "tx"]).where("y0 < y1_b AND y0_b < y1 AND x0 < x1_b AND x0_b < x1")
    return met.where(f"floor(greatest(y0, y0_b) / {tile}) = ty AND floor(greatest(x0, x0_b) / {tile}) = tx").select(IMAGE, "a_id", "b_id")


def box_extract(pixels: DataFrame, boxes: DataFrame, fill: float = 0, tile: int = 16, corners: bool = False) -> DataFrame:
    """A cut-out for each box in box-local y, x, with ``fill`` past the image's edge; with ``corners`` also the box's y0 and x0.

    Boxes meet the tiles that they touch, a row each with the pixels of all bands, so pixels and boxes are
    shuffled, but not the cut-outs, of which there are many more. An image's pixels are those of each y, x and band once.
    """
    meet = [IMAGE, "ty", "tx"]
    listed = lambda k, *c: F.map_from_entries(F.collect_list(F.when(F.col(k).isNotNull(), F.struct(k, *c))))
    at = lambda c: F.floor(F.col(c) / tile).cast("int")
    rows = pixels.select(IMAGE, "band", "y", "x", "value", at("y").alias("ty"), at("x").alias("tx")).repartition(*meet).groupBy(*meet, "band", "y").agg(listed("x", "value").alias("row"))
    tiles = rows.groupBy(*meet, "band").agg(listed("y", "row").alias("plane")).groupBy(*meet).agg(listed("band", "plane").alias("planes"))
    bands = pixels.select(IMAGE, "band").distinct().groupBy(IMAGE).agg(F.collect_list(F.struct("band")).alias("bands"))
    parts = tiled(boxes.select(IMAGE, "box_id", *BOUNDS).join(bands, IMAGE), tile).hint("merge").join(tiles, meet, "left").withColumn("b", F.explode("bands"))
    parts = parts.select(IMAGE, "box_id", *BOUNDS, "ty", "tx", F.col("b.band").alias("band"), F.try_element_at("planes", F.col("b.band")).alias("plane"))
    cells = explode_grid(parts, *[e for c in "yx" for e in (f"greatest({c}0, t{c} * {tile})", f"least({c}1, (t{c} + 1) * {tile})")])
    value = F.coalesce(F.try_element_at(F.try_element_at("plane", F.col("y")), F.col("x")), F.lit(fill))
    kept = [F.col(c) for c in ("y0", "x0") if corners]
    return cells.select(IMAGE, "box_id", "band", (F.col("y") - F.col("y0")).alias("y"), (F.col("x") - F.col("x0")).alias("x"), value.alias("value"), *kept)


def box_insert(pixels: DataFrame, sub: DataFrame, boxes: DataFrame, how: str = "add") -> DataFrame:
    """Write cut-outs into the image: ``add`` sums all cut-outs onto it, ``replace`` takes the one of the greatest box_id.

    Cut-outs that have their box's y0 and x0 (``box_extract`` with ``corners``) combine where they are, without a join with ``boxes``.
    """
    placed = sub if {"y0", "x0"} <= set(sub.columns) else sub.join(boxes.select(IMAGE, "box_id", "y0", "x0"), [IMAGE, "box_id"])
    there = placed.select(IMAGE, "box_id", "band", (F.col("y") + F.col("y0")).alias("y"), (F.col("x") + F.col("x0")).alias("x"), F.col("value").alias("sub"))
    by = [IMAGE, "band", "y", "x"]
    new = there.groupBy(*by).agg((F.sum("sub") if how == "add" else F.max_by("sub", "box_id")).alias("sub"))
    value = F.col("value") + F.coalesce("sub", F.lit(0)) if how == "add" else F.coalesce("sub", "value")
    return pixels.join(new, by, "left").select(*[value.alias("value") if c == "value" else F.col(c) for c in pixels.columns])


def minimal_boxsize(df: DataFrame, size: str = "size", min_size: int = 21, increment: int = 10) -> DataFrame:
    """``boxsize``: the first of min_size, min_size + increment, ... that isn't smaller than ``size``."""
    return df.withColumn("boxsize", F.expr(f"CAST({min_size} + {increment} * ceil(greatest(0, {size} - {min_size}) / {increment}) AS INT)"))


def trim_and_center(morphs: DataFrame, centers: DataFrame, bg_thresh: float = 0, boxsize: int | None = None) -> DataFrame:
    """Zero what isn't above ``bg_thresh`` and cut an odd square box around each source's centre.

    The box has the least ladder size that holds all that is left, or ``boxsize``. Both
    tables are keyed by image_id, source_id; y and x stay in the image's coordinates.
    """
    by = [IMAGE, "source_id"]
    at = centers.select(*by, F.col("y").alias("cy"), F.col("x").alias("cx"))
    kept = morphs.join(at, by).withColumn("value", F.when(F.col("value") > bg_thresh, F.col("value")).otherwise(F.lit(0)))
    reach = kept.groupBy(*by, "cy", "cx").agg(F.max(F.when(F.col("value") > 0, F.greatest(F.abs(F.col("y") - F.col("cy")), F.abs(F.col("x") - F.col("cx")))).otherwise(0)).alias("reach"))
    sized = minimal_boxsize(reach.withColumn("size", 2 * F.col("reach") + 1)) if boxsize is None else reach.withColumn("boxsize", F.lit(boxsize))
    cells = explode_grid(sized, "cy - boxsize div 2", "cy + boxsize div 2 + 1", "cx - boxsize div 2", "cx + boxsize div 2 + 1").select(*by, "boxsize", "y", "x")
    return cells.join(kept.select(*by, "y", "x", "value"), [*by, "y", "x"], "left").select(*by, "boxsize", "y", "x", F.coalesce("value", F.lit(0)).alias("value"))


def project_image(pixels: DataFrame, ny: int, nx: int, yx0: tuple[int, int] | None = None) -> DataFrame:
    """Pad or trim each image to ny x nx around its centre, or with its corner at ``yx0``.

    Centred images keep pixel (size div 2) at (new size div 2); what is missing becomes 0.
    """
    size = pixels.groupBy(IMAGE).agg((F.max("y") + 1).alias("sy"), (F.max("x") + 1).alias("sx"))
    shift = size.selectExpr(IMAGE, f"{ny} div 2 - sy div 2 AS dy", f"{nx} div 2 - sx div 2 AS dx") if yx0 is None else size.selectExpr(IMAGE, f"{yx0[0]} AS dy", f"{yx0[1]} AS dx")
    moved = pixels.join(shift, IMAGE).selectExpr(IMAGE, "band", "CAST(y + dy AS INT) AS y", "CAST(x + dx AS INT) AS x", "value").where(f"y BETWEEN 0 AND {ny - 1} AND x BETWEEN 0 AND {nx - 1}")
    grid = explode_grid(pixels.select(IMAGE, "band").distinct(), "0", str(ny), "0", str(nx))
    return grid.join(moved, [IMAGE, "band", "y", "x"], "left").select(IMAGE, "band", "y", "x", F.coalesce("value", F.lit(0)).alias("value"))


def common_size(a: DataFrame, b: DataFrame) -> DataFrame:
    """The larger height and width of two images of each image_id."""
    size = lambda d: d.groupBy(IMAGE).agg((F.max("y") + 1).alias("ny"), (F.max("x") + 1).alias("nx"))
    return size(a).unionByName(size(b)).groupBy(IMAGE).agg(F.max("ny").alias("ny"), F.max("nx").alias("nx"))


def circle_mask(df: DataFrame, diameter: str = "diameter") -> DataFrame:
    """A square of ones inside the circle and zeros outside for each row; for even diameters the centre lies between pixels."""
    cells = explode_grid(df, "0", diameter, "0", diameter)
    return cells.withColumn("value", F.expr(f"CASE WHEN pow(2 * y - ({diameter} - 1), 2) + pow(2 * x - ({diameter} - 1), 2) <= pow({diameter}, 2) THEN 1 ELSE 0 END"))


def last_of(df: DataFrame, by: list[str], order: list) -> DataFrame:
    """The last row of each group."""
    return df.withColumn("n_last", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("n_last = 1").drop("n_last")
