"""Constraints: projections applied to every component table (image_id, source_id, comp_id, y, x, m) at once."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pixelloom.functions import blend
from pixelloom.functions.grid import IMAGE, cut

BY = (IMAGE, "source_id", "comp_id")
TINY = 1e-20


def positivity(df: DataFrame, zero: float = 0, col: str = "m") -> DataFrame:
    """Values of at least ``zero``."""
    return df.withColumn(col, F.greatest(F.col(col), F.lit(zero)))


def hard_threshold(df: DataFrame, t: float, step: float | None = None, positive: bool = False, col: str = "m") -> DataFrame:
    """0 where the absolute value (for ``positive``: the value) is below t, or t x step for a relative threshold."""
    limit = t if step is None else t * step
    return df.withColumn(col, F.when((F.col(col) if positive else F.abs(col)) < limit, F.lit(0.0)).otherwise(F.col(col)))


def soft_threshold(df: DataFrame, t: float, step: float | None = None, col: str = "m") -> DataFrame:
    """Values drawn towards 0 by t, or t x step."""
    limit = t if step is None else t * step
    return df.withColumn(col, F.signum(col) * F.greatest(F.abs(col) - limit, F.lit(0.0)))


def histogram_threshold(df: DataFrame, by: tuple[str, ...] = BY, col: str = "m") -> DataFrame:
    """Zero everything below the last empty bin of the histogram of log10 of a component's positive values.

    50 bins, or a tenth of the number of values if they are fewer than 500; with one bin or no empty bin only
    negative values go. Empty bins are those that no value's bin number covers, found from
    the distinct bin numbers by a window, not by listing all bins.
    """
    k = list(by)
    ends = df.where(F.col(col) > 0).groupBy(*k).agg(F.min(F.log10(col)).alias("lo"), F.max(F.log10(col)).alias("hi"), F.count(F.lit(1)).alias("n"))
    bins = F.when(F.col("n") < 500, F.greatest(F.floor(F.col("n") / 10), F.lit(1))).otherwise(50)
    ends = ends.withColumn("bins", bins).withColumn("width", (F.col("hi") - F.col("lo")) / F.col("bins"))
    used = df.where(F.col(col) > 0).join(ends, k).select(*k, "bins", "lo", "width", F.least(F.floor((F.log10(col) - F.col("lo")) / F.nullif("width", F.lit(0.0))), F.col("bins") - 1).alias("b")).distinct()
    before = F.lag("b", 1, -1).over(Window.partitionBy(*k).orderBy("b"))
    gap = used.withColumn("before", before).where("b > before + 1 AND bins > 1").groupBy(*k).agg(F.max(F.pow(F.lit(10.0), F.col("lo") + (F.col("b") - 1) * F.col("width"))).alias("cutoff"))
    return df.join(gap, k, "left").withColumn(col, F.when(F.col(col) >= F.coalesce("cutoff", F.lit(0.0)), F.col(col)).otherwise(F.lit(0.0))).drop("cutoff")


def middle(df: DataFrame, by: tuple[str, ...] = BY) -> DataFrame:
    """keys, cy, cx: the middle pixel of each component's box."""
    return df.groupBy(*by).agg(F.expr("min(y) + (max(y) - min(y) + 1) div 2").alias("cy"), F.expr("min(x) + (max(x) - min(x) + 1) div 2").alias("cx"))


def center_on(df: DataFrame, tiny: float = 1e-6, by: tuple[str, ...] = BY, col: str = "m") -> DataFrame:
    """At least ``tiny`` at the middle of each component's box."""
    at = (F.col("y") == F.col("cy")) & (F.col("x") == F.col("cx"))
    return df.join(middle(df, by), list(by)).withColumn(col, F.when(at, F.greatest(F.col(col), F.lit(tiny))).otherwise(F.col(col))).drop("cy", "cx")


def leaky(before: DataFrame, after: DataFrame, leak: float = 0.05, by: tuple[str, ...] = BY, col: str = "m") -> DataFrame:
    """leak x before + (1 - leak) x after."""
    keys = [*by, "y", "x"]
    return after.join(before.select(*keys, F.col(col).alias("was")), keys).withColumn(col, leak * F.col("was") + (1 - leak) * F.col(col)).drop("was")


def chain(df: DataFrame, operations: list[Callable[[DataFrame], DataFrame]], repeat: int = 1) -> DataFrame:
    """Constraints one after the other, all of them ``repeat`` times."""
    for _ in range(repeat):
        for f in operations:
            df = df.transform(f)
    return df


NEIGHBOURS = [(dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if dy or dx]


def inner_neighbours(df: DataFrame, centers: DataFrame, by: tuple[str, ...] = BY) -> DataFrame:
    """keys, y, x, dy, dx, cos: the neighbours strictly closer to the centre and how well they lie towards it."""
    steps = ", ".join(f"({dy}, {dx})" for dy, dx in NEIGHBOURS)
    rel = df.join(centers.select(*by, "cy", "cx"), list(by)).selectExpr(*by, "y", "x", "y - cy AS ry", "x - cx AS rx", f"inline(array({steps})) AS (dy, dx)")
    closer = rel.where("pow(ry + dy, 2) + pow(rx + dx, 2) < ry * ry + rx * rx")
    return closer.selectExpr(*by, "y", "x", "dy", "dx", "-(dy * ry + dx * rx) / sqrt(CAST(dy * dy + dx * dx AS DOUBLE) * (ry * ry + rx * rx)) AS cos")


def monotonic_weights(df: DataFrame, centers: DataFrame, weight: str = "angle", by: tuple[str, ...] = BY) -> DataFrame:
    """keys, y, x, dy, dx, w: weights of each pixel's inner neighbours, of unit sum (nearest: the best aligned one has all)."""
    n = inner_neighbours(df, centers, by).where("abs(cos) > 1e-12")
    pixel = Window.partitionBy(*by, "y", "x")
    if weight == "nearest":
        return n.withColumn("k", F.row_number().over(pixel.orderBy(F.desc("cos"), "dy", "dx"))).where("k = 1").select(*by, "y", "x", "dy", "dx", F.lit(1.0).alias("w"))
    share = F.lit(1.0) if weight == "flat" else F.col("cos")
    return n.select(*by, "y", "x", "dy", "dx", (share / F.sum(share).over(pixel)).alias("w"))


def monotonic_nearest(df: DataFrame, centers: DataFrame, min_gradient: float = 0, by: tuple[str, ...] = BY, col: str = "m") -> DataFrame:
    """Each pixel at most (1 - g) times its best-aligned inner neighbour, all the way to the centre.

    The least of (1 - g)^k times the k-th ancestor, by pointer doubling: a number of self-joins
    logarithmic in the distance to the centre.
    """
    k = list(by)
    parent = monotonic_weights(df, centers, "nearest", by).select(*k, "y", "x", (F.col("y") + F.col("dy")).alias("ay"), (F.col("x") + F.col("dx")).alias("ax"))
    state = cut(df.join(parent, [*k, "y", "x"], "left").select(*k, "y", "x", F.col(col).alias("best"), "ay", "ax"))
    reach = df.join(centers.select(*k, "cy", "cx"), k).agg(F.max(F.abs(F.col("y") - F.col("cy")) + F.abs(F.col("x") - F.col("cx")))).first()[0] or 1
    for i in range(max(1, math.ceil(math.log2(reach + 1)))):
        up = state.select(*k, F.col("y").alias("ay"), F.col("x").alias("ax"), F.col("best").alias("top"), F.col("ay").alias("by2"), F.col("ax").alias("bx2"))
        joined = state.join(up, [*k, "ay", "ax"], "left")
        state = cut(joined.select(*k, "y", "x", F.least("best", F.col("top") * (1 - min_gradient) ** (2**i)).alias("best"), F.col("by2").alias("ay"), F.col("bx2").alias("ax")))
    return df.join(state.select(*k, "y", "x", "best"), [*k, "y", "x"]).withColumn(col, F.col("best")).drop("best")


def moved_centers(df: DataFrame, centers: DataFrame, radius: int, by: tuple[str, ...] = BY, col: str = "m") -> DataFrame:
    """keys, cy, cx: the brightest pixel within ``radius`` rows and columns of each centre; ties take the lowest y, then x; without a pixel there it stays."""
    at = centers.select(*by, "cy", "cx")
    near = df.join(at, list(by)).where((F.abs(F.col("y") - F.col("cy")) <= radius) & (F.abs(F.col("x") - F.col("cx")) <= radius))
    best = near.groupBy(*by).agg(F.max_by(F.struct("y", "x"), F.struct(F.col(col), -F.col("y"), -F.col("x"))).alias("best"))
    return at.join(best, list(by), "left").select(*by, F.coalesce("best.y", "cy").alias("cy"), F.coalesce("best.x", "cx").alias("cx"))


def monotonic_weighted(df: DataFrame, centers: DataFrame, weight: str = "angle", min_gradient: float = 0, by: tuple[str, ...] = BY, col: str = "m", center_radius: int = 0, use_mask: bool = False) -> DataFrame:
    """Each pixel at most (1 - g) times the weighted mean of its strictly closer neighbours, from the inside out.

    With ``center_radius`` a centre first moves to the brightest pixel near it; with ``use_mask`` pixels that 4-paths
    from the centre reach, each value below the one before, keep their value. Components are rows of lists, many to an Arrow batch; the rings and weights of a box are made once for
    each shape and centre.
    """
    k = list(by)
    if center_radius:
        centers = moved_centers(df, centers, center_radius, by, col)

    def shape(grid: np.ndarray, y: np.ndarray, x: np.ndarray, v: np.ndarray, cy: int, cx: int) -> np.ndarray:
        y0, x0 = int(y.min()), int(x.min())
        out = swept(y, x, v, cy, cx, weight, min_gradient) if np.isnan(grid).any() else blend.monotonic(grid, cy - y0, cx - x0, weight, min_gradient)[y - y0, x - x0]
        if use_mask and y0 <= cy <= y.max() and x0 <= cx <= x.max():
            out = np.where(blend.reached(np.nan_to_num(grid), cy - y0, cx - x0)[y - y0, x - x0], v, out)
        return out

    return by_lists(df, centers, shape, by, col)


def reached_part(df: DataFrame, centers: DataFrame, by: tuple[str, ...] = BY, col: str = "m") -> DataFrame:
    """``df`` with 0 for what 4-paths from the centre don't reach with each value below the one before, and above 0; a centre has to lie in its box."""

    def shape(grid: np.ndarray, y: np.ndarray, x: np.ndarray, v: np.ndarray, cy: int, cx: int) -> np.ndarray:
        return np.where(blend.reached(np.nan_to_num(grid), cy - int(y.min()), cx - int(x.min()))[y - y.min(), x - x.min()], v, 0.0)

    return by_lists(df, centers, shape, by, col)


def by_lists(df: DataFrame, centers: DataFrame, shape: Callable[..., np.ndarray], by: tuple[str, ...], col: str) -> DataFrame:
    """keys, y, x and the new ``col``: ``shape`` takes each component's box (NaN in gaps), its pixels and its centre; many components to an Arrow batch."""
    k = list(by)
    joined = df.join(centers.select(*k, "cy", "cx"), k).select(*k, "y", "x", F.col(col).cast("double").alias("v"), "cy", "cx")
    lists = joined.groupBy(*k, "cy", "cx").agg(*[F.collect_list(c).alias(c) for c in ("y", "x", "v")])
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in lists.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for r in range(batch.num_rows):
                y, x, v = (batch.column(c)[r].values.to_numpy(zero_copy_only=False) for c in ("y", "x", "v"))
                grid = np.full((int(y.max() - y.min()) + 1, int(x.max() - x.min()) + 1), np.nan)
                grid[y - y.min(), x - x.min()] = v
                made.append(shape(grid, y, x, v, int(batch.column("cy")[r].as_py()), int(batch.column("cx")[r].as_py())))
            columns = [pa.array(made, pa.list_(pa.float64())) if n == "v" else batch.column(n) for n in batch.schema.names]
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    out = lists.mapInArrow(run, kinds).select(*k, F.explode(F.arrays_zip("y", "x", "v")).alias("e"))
    return out.select(*k, "e.y", "e.x", F.col("e.v").alias(col))


def swept(y: np.ndarray, x: np.ndarray, v: np.ndarray, cy: int, cx: int, weight: str, min_gradient: float) -> np.ndarray:
    """The inside-out sweep over pixels with gaps: a missing neighbour's weight goes to the others."""
    y0, x0 = y.min() - 1, x.min() - 1
    grid = np.full((y.max() - y0 + 2, x.max() - x0 + 2), np.nan)
    grid[y - y0, x - x0] = v
    ry, rx = y - cy, x - cx
    d2 = ry**2 + rx**2
    for r in np.unique(d2)[1 if (d2 == 0).any() else 0 :]:
        at = np.flatnonzero(d2 == r)
        total, mean = np.zeros(len(at)), np.zeros(len(at))
        for dy, dx in NEIGHBOURS:
            cos = -(dy * ry[at] + dx * rx[at]) / math.sqrt(float(r * (dy * dy + dx * dx)))
            value = grid[y[at] + dy - y0, x[at] + dx - x0]
            fits = ((ry[at] + dy) ** 2 + (rx[at] + dx) ** 2 < r) & (np.abs(cos) > 1e-12) & ~np.isnan(value)
            w = np.where(fits, 1.0 if weight == "flat" else cos, 0.0)
            total += w
            mean += w * np.where(fits, value, 0.0)
        limit = np.where(total > 0, mean / np.where(total > 0, total, 1) * (1 - min_gradient), np.inf)
        spot = (y[at] - y0, x[at] - x0)
        grid[spot] = np.minimum(grid[spot], limit)
    return grid[y - y0, x - x0]


STEPS = "inline(array((-1, 0), (1, 0), (0, -1), (0, 1))) AS (dy, dx)"


def reached_from(values: DataFrame, centers: DataFrame, variance: float = 0, by: tuple[str, ...] = BY, shared: tuple[str, ...] | None = None) -> DataFrame:
    """keys, y, x, v: the centre and all pixels that 4-paths from it reach with each value below the one before plus ``variance``, and above 0.

    ``values`` (y, x, v) has the keys, or only those of ``shared``: then components walk over the pixels of one image.
    """
    k = list(by)
    place, on = [*k, "y", "x"], [*(shared or k), "y", "x"]
    front = values.join(centers.select(*k, F.col("cy").alias("y"), F.col("cx").alias("x")).distinct(), on).select(*place, "v")
    reached = cut(front)
    front = reached
    while True:
        grown = front
        for _ in range(4):
            near = front.selectExpr(*k, "y", "x", "v AS from_v", STEPS).selectExpr(*k, "y + dy AS y", "x + dx AS x", "from_v")
            front = near.join(values, on).where(f"v < from_v + {variance} AND v > 0").select(*place, "v").distinct().join(grown, place, "left_anti")
            grown = grown.unionByName(front)
        fresh = cut(grown.select(*place, "v").distinct().join(reached, place, "left_anti"))
        if fresh.isEmpty():
            return reached
        reached = cut(reached.unionByName(fresh))
        front = fresh


def monotonic_mask(df: DataFrame, centers: DataFrame, variance: float = 0, max_iter: int = 0, by: tuple[str, ...] = BY, col: str = "m") -> DataFrame:
    """``df`` with ``valid``: pixels that 4-paths from the centre reach with each value below the one before plus ``variance``, and above 0.

    The set grows by frontiers, several steps between two writes. With ``max_iter``
    rounds, orphans (invalid pixels beside a valid one) are filled from the
    gradient of valid pixel pairs that lie inwards of them, and become valid where that stays positive; other pixels get 0.
    """
    k = list(by)
    place = [*k, "y", "x"]
    values = cut(df.select(*place, F.col(col).alias("v")))
    reached = reached_from(values, centers, variance, by)
    for _ in range(max_iter):
        orphans = reached.selectExpr(*k, "y", "x", STEPS).selectExpr(*k, "y + dy AS y", "x + dx AS x").distinct().join(values.select(*place), place, "left_semi").join(reached, place, "left_anti")
        pair = orphans.selectExpr(*place, STEPS).selectExpr(*place, "y + dy AS y1", "x + dx AS x1", "y + 2 * dy AS y2", "x + 2 * dx AS x2")
        one = reached.select(*k, F.col("y").alias("y1"), F.col("x").alias("x1"), F.col("v").alias("v1"))
        two = reached.select(*k, F.col("y").alias("y2"), F.col("x").alias("x2"), F.col("v").alias("v2"))
        made = pair.join(one, [*k, "y1", "x1"]).join(two, [*k, "y2", "x2"]).where("v2 > v1").groupBy(*place).agg(F.avg(2 * F.col("v1") - F.col("v2")).alias("v")).where("v > 0")
        fresh = cut(made.withColumn("v", F.col("v").cast(reached.schema["v"].dataType)))
        if fresh.isEmpty():
            break
        reached = cut(reached.unionByName(fresh.select(*reached.columns)))
    out = df.join(reached.withColumn("valid", F.lit(True)), place, "left")
    return out.withColumn(col, F.coalesce("v", F.lit(0))).withColumn("valid", F.coalesce("valid", F.lit(False))).drop("v")


def mirrored(df: DataFrame, centers: DataFrame, by: tuple[str, ...], col: str) -> DataFrame:
    """``df`` with ``flip``, the value at the mirror position about the centre; null outside of the table."""
    k = list(by)
    at = df.join(centers.select(*k, "cy", "cx"), k).withColumn("my", 2 * F.col("cy") - F.col("y")).withColumn("mx", 2 * F.col("cx") - F.col("x"))
    other = df.select(*k, F.col("y").alias("my"), F.col("x").alias("mx"), F.col(col).alias("flip"))
    return at.join(other, [*k, "my", "mx"], "left").drop("my", "mx", "cy", "cx")


def symmetry(df: DataFrame, strength: float = 1, by: tuple[str, ...] = BY, col: str = "m") -> DataFrame:
    """s / 2 (x + flip) + (1 - s) x about the middle of each component; even sizes count as padded with zeros."""
    both = mirrored(df, middle(df, by), by, col)
    return both.withColumn(col, strength / 2 * (F.col(col) + F.coalesce("flip", F.lit(0))) + (1 - strength) * F.col(col)).drop("flip")


def symmetry_min(df: DataFrame, centers: DataFrame, fill: float | None = None, by: tuple[str, ...] = BY, col: str = "m") -> DataFrame:
    """The lesser of each pixel and its mirror about the source; pixels without a mirror stay, or become ``fill``."""
    both = mirrored(df, centers, by, col)
    alone = F.col(col) if fill is None else F.lit(fill)
    return both.withColumn(col, F.when(F.col("flip").isNull(), alone).otherwise(F.least(col, "flip"))).drop("flip")


def symmetry_subpixel(pixels: DataFrame, shifts: DataFrame) -> DataFrame:
    """Symmetry of whole images about a centre off the middle by shift_y, shift_x: shifted there, mirrored, shifted back.

    Zero where the input isn't positive.
    """
    from pixelloom.operators.stencil import shift_image

    back = shifts.select(IMAGE, (-F.col("shift_y")).alias("shift_y"), (-F.col("shift_x")).alias("shift_x"))
    centred = cut(shift_image(pixels, back, "fourier"))
    even = cut(symmetry(centred, 1, (IMAGE, "band"), "value"))
    again = shift_image(even, shifts, "fourier").withColumnRenamed("value", "made")
    joined = pixels.join(again, [IMAGE, "band", "y", "x"])
    return joined.select(IMAGE, "band", "y", "x", F.when(F.col("value") > 0, F.col("made")).otherwise(0.0).alias("value"))


def bluer_disk(seds: DataFrame, mode: str = "mean") -> DataFrame:
    """Force each source's disk to be bluer than its bulge along the bands' order.

    ``seds`` has image_id, source_id, band, bulge, disk. Inner bands whose difference falls below the
    last one's get the mean slope (``mean``) or move by the last difference (``previous``).
    """
    k = [IMAGE, "source_id"]
    a = seds.groupBy(*k).agg(F.array_sort(F.collect_list(F.struct("band", F.col("bulge").cast("double").alias("b"), F.col("disk").cast("double").alias("d")))).alias("s"))
    first = F.col("s")[0]["b"] - F.col("s")[0]["d"]
    n = F.size("s")
    last = F.element_at("s", -1)
    slope = (last["b"] - last["d"] - first) / (n - 1)

    def step(acc, i):
        e = F.element_at(F.col("s"), (i + 1).cast("int"))
        diff = e["b"] - e["d"]
        new = e["b"] - (slope * i + first) if mode == "mean" else e["d"] + acc["diff"]
        kept = F.least(diff, F.lit(float("inf")))
        low = (diff < acc["diff"]) & (i < n - 1)
        shown = F.when(low, new).otherwise(e["d"])
        after = F.when(low, e["b"] - new if mode == "mean" else acc["diff"]).otherwise(kept)
        return F.struct(after.alias("diff"), F.concat(acc["out"], F.array(F.struct(e["band"].alias("band"), shown.alias("disk")))).alias("out"))

    start = F.struct(first.alias("diff"), F.array(F.struct(F.col("s")[0]["band"].alias("band"), F.col("s")[0]["d"].alias("disk"))).alias("out"))
    made = F.aggregate(F.when(n > 1, F.sequence(F.lit(1), n - 1)).otherwise(F.array().cast("array<int>")), start, step)
    return a.select(*k, F.explode(made["out"]).alias("o")).select(*k, "o.band", "o.disk")


def clip_profile_params(catalog: DataFrame) -> DataFrame:
    """radius at least 0.01, ellipticities outside of the unit circle drawn to 1 / 1.1 of it, nu within -0.85 and 4."""
    size = F.sqrt(F.col("e1") * F.col("e1") + F.col("e2") * F.col("e2"))
    scale = F.when(size >= 1, 1 / (1.1 * size)).otherwise(1.0)
    out = catalog.withColumn("radius", F.greatest("radius", F.lit(0.01))).withColumn("scale", scale)
    out = out.withColumn("e1", F.col("e1") * F.col("scale")).withColumn("e2", F.col("e2") * F.col("scale")).drop("scale")
    return out.withColumn("nu", F.greatest(F.lit(-0.85), F.least(F.lit(4.0), F.col("nu")))) if "nu" in out.columns else out


def max_normalised(df: DataFrame, by: tuple[str, ...] = BY, col: str = "m") -> DataFrame:
    return df.withColumn(col, F.col(col) / F.nullif(F.max(col).over(Window.partitionBy(*by)), F.lit(0)))


def background_cut(seds: DataFrame, morphs: DataFrame, rms: DataFrame, bg_thresh: float, by: tuple[str, ...] = BY) -> DataFrame:
    """Zero pixels whose model is below thresh x rms in all bands, floor the middle, scale to a maximum of 1.

    A pixel passes in some band when m reaches the least of thresh rms / sed over bands with a positive sed: one
    number for each component, so pixels never meet bands.
    """
    least = seds.join(rms, [IMAGE, "band"]).groupBy(*by).agg(F.min(F.when(F.col("sed") > 0, bg_thresh * F.col("rms") / F.col("sed"))).alias("least"))
    kept = morphs.join(least, list(by)).withColumn("m", F.when(F.col("m") >= F.coalesce("least", F.lit(float("inf"))), F.col("m")).otherwise(F.lit(0.0))).drop("least")
    return max_normalised(center_on(kept, TINY, by), by)


def extended_constraints(df: DataFrame, centers: DataFrame, monotonic: str = "angle", symmetric: bool = False, min_grad: float = 0, by: tuple[str, ...] = BY) -> DataFrame:
    """The standard chain: monotonic, symmetric if asked for, positive, a floor at the centre, a maximum of 1."""
    steps = [(lambda d: monotonic_nearest(d, centers, min_grad, by)) if monotonic == "nearest" else (lambda d: monotonic_weighted(d, centers, monotonic, min_grad, by))]
    if symmetric:
        steps.append(lambda d: symmetry(d, 1, by))
    return chain(df, [*steps, positivity, lambda d: center_on(d, 1e-6, by), lambda d: max_normalised(d, by)])
