"""Detection: connected regions, footprints, peaks and structures."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pixelloom.functions.graph import components
from pixelloom.functions.grid import IMAGE, cut
from pixelloom.operators.boxes import box_overlap_join
from pixelloom.operators.tiles import CELLS, LEAD, SIDE, each_pixel, gathered, pieces

ROW = 65536  # a region is named by y * ROW + x of its first pixel, in wider images by y * (their largest x + 1) + x


def joined_runs(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The least of the numbers 0 to ``n`` - 1 that each is linked with by pairs (a, b)."""
    root = np.arange(n)
    while True:
        low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        if (low == high).all():
            return root
        np.minimum.at(root, high, low)
        while not np.array_equal(root, up := root[root]):
            root = up


def regions(tile: np.ndarray, ty: np.ndarray, tx: np.ndarray, y: np.ndarray, x: np.ndarray, fields: dict) -> tuple[np.ndarray, list[np.ndarray]]:
    """The first pixel (ly, lx) of each pixel's region within its tile, and whether the pixel touches a tile before or behind its own."""
    in_y, in_x = y + LEAD - ty * SIDE, x + LEAD - tx * SIDE
    place = (tile * (SIDE + 1) + in_y) * (SIDE + 1) + in_x  # one more than a tile's side, so rows and tiles never touch
    by = np.argsort(place, kind="stable")
    at = place[by]
    starts = np.concatenate(([True], np.diff(at) > 1))[: len(at)]
    run = np.cumsum(starts) - 1
    below = np.searchsorted(at, at + SIDE + 1)
    met = (below < len(at)) & (at[np.minimum(below, len(at) - 1)] == at + SIDE + 1) if len(at) else np.zeros(0, bool)
    first = np.flatnonzero(starts)
    head = by[first[joined_runs(run[met], run[below[met]], len(first))]][run]
    ly, lx = np.empty(len(by), np.int64), np.empty(len(by), np.int64)
    ly[by], lx[by] = y[head], x[head]
    return np.arange(len(by)), [ly, lx, (in_y == 0) | (in_y == SIDE - 1) | (in_x == 0) | (in_x == SIDE - 1)]


def label_components(pixels: DataFrame, thresh: float | str = 0, keys: tuple[str, ...] = (IMAGE,)) -> DataFrame:
    """keys, y, x, value, label: the 4-connected regions of pixels above ``thresh`` (a number or a column's name).

    Tiles of pixels find their own regions by runs of neighbouring columns; only where regions touch at the tiles' edges
    are they joined, as the connected components of the graph of those that touch. The result is written to the checkpoint folder.
    """
    k = list(keys)
    lit = pixels.where(F.col("value") > (F.col(thresh) if isinstance(thresh, str) else F.lit(thresh))).select(*k, "y", "x", "value").dropna(subset=[*k, "y", "x"])
    marked = cut(each_pixel(gathered(lit, keys, ["value"]), keys, regions, [("ly", "long"), ("lx", "long"), ("edge", "boolean")]))
    widest, edges = marked.agg(F.max("x"), F.max("edge")).first()
    row = F.lit(ROW).cast("long")
    if widest is not None and widest >= ROW:
        marked = marked.join(marked.groupBy(*k).agg(F.greatest(F.lit(ROW), F.max("x") + 1).cast("long").alias("row")), k)
        row = F.col("row")
    labelled = marked.select(*k, "y", "x", "value", (F.col("ly") * row + F.col("lx")).alias("run"), "edge")
    if not edges:
        return labelled.select(*k, "y", "x", "value", F.col("run").alias("label"))
    rim = labelled.where("edge")
    links = None
    for axis, other in (("y", "x"), ("x", "y")):
        side = F.pmod(F.col(axis) + LEAD, F.lit(SIDE))
        here = rim.where(side == SIDE - 1).select(*k, (F.col(axis) + 1).alias(axis), other, F.col("run").alias("a"))
        near = here.join(rim.where(side == 0).select(*k, axis, other, F.col("run").alias("b")), [*k, axis, other]).select(*k, "a", "b")
        links = near if links is None else links.unionByName(near)
    roots = components(links.distinct(), keys).withColumnRenamed("node", "run")
    return cut(labelled.join(roots, [*k, "run"], "left").select(*k, "y", "x", "value", F.coalesce("root", "run").alias("label")))


def footprints(pixels: DataFrame, thresh: float | str = 0, min_area: int = 4, keys: tuple[str, ...] = (IMAGE,)) -> tuple[DataFrame, DataFrame]:
    """Regions with a box area above ``min_area`` and at least ``min_area`` pixels: their table (label, half-open box, area) and their pixels."""
    labelled = label_components(pixels, thresh, keys)
    table = labelled.groupBy(*keys, "label").agg(F.min("y").alias("y0"), (F.max("y") + 1).alias("y1"), F.min("x").alias("x0"), (F.max("x") + 1).alias("x1"), F.count(F.lit(1)).alias("area"))
    table = table.where(f"(y1 - y0) * (x1 - x0) > {min_area} AND area >= {min_area}")
    return table, labelled.join(table.select(*keys, "label"), [*keys, "label"], "left_semi")


def strict_maxima(tile: np.ndarray, ty: np.ndarray, tx: np.ndarray, y: np.ndarray, x: np.ndarray, fields: dict) -> tuple[np.ndarray, list[np.ndarray]]:
    """Places of the tiles' own pixels above their 8 neighbours of the same label; nulls are no neighbours, NaN is above all numbers."""
    value = fields["value"]
    rank = np.full(len(tile), -1)
    if (known := value.is_valid().to_numpy(zero_copy_only=False)).any():
        rank[known] = np.unique(value.drop_null().to_numpy(zero_copy_only=False), return_inverse=True)[1]
    name = np.unique(fields["label"].to_numpy(zero_copy_only=False), return_inverse=True)[1]
    wide = SIDE + 4  # a tile with its halo, and an empty column and row
    group = np.unique(tile * (name.max(initial=0) + 1) + name, return_inverse=True)[1]
    place = (group * wide + y + LEAD - ty * SIDE + 1) * wide + x + LEAD - tx * SIDE + 1
    by = np.lexsort((rank, place))
    at = place[by]
    near = np.full(len(place), -1)
    for step in (dy * wide + dx for dy in (-1, 0, 1) for dx in (-1, 0, 1) if dy or dx):
        last = np.searchsorted(at, place + step, side="right") - 1  # of repeated pixels the highest
        met = (last >= 0) & (at[last] == place + step)
        near[met] = np.maximum(near[met], rank[by[last[met]]])
    own = ((y + LEAD) // SIDE == ty) & ((x + LEAD) // SIDE == tx)
    return np.flatnonzero(own & ((near < 0) | (rank > near))), []


def local_maxima(fp_pixels: DataFrame, keys: tuple[str, ...] = (IMAGE,)) -> DataFrame:
    """keys, label, y, x, flux, rank: pixels strictly above their 8 neighbours of the same footprint, brightest first.

    A plateau has no strict maximum and gives no peak. Pixels meet in tiles with a halo of one pixel.
    """
    k = [*keys, "label"]
    lists = gathered(fp_pixels.select(*k, "y", "x", "value").dropna(subset=[*k, "y", "x"]), keys, ["value", "label"], 1)
    peaks = each_pixel(lists, keys, strict_maxima, [])
    rank = F.row_number().over(Window.partitionBy(*k).orderBy(F.desc("value"), "y", "x"))
    return peaks.select(*k, "y", "x", F.col("value").alias("flux"), rank.alias("rank"))


def suppress_close(peaks: DataFrame, min_separation: float, keys: tuple[str, ...] = (IMAGE, "label")) -> DataFrame:
    """Greedy by brightness: a peak goes when a brighter one that stays is closer than ``min_separation``.

    Rounds settle all peaks without a brighter undecided one in reach at once, and drop their neighbours; close
    pairs are found through tiles as wide as the separation.
    """
    k = list(keys)
    tile = max(float(min_separation), 1e-9)
    at = peaks.withColumn("py", F.col("y")).withColumn("px", F.col("x")).withColumn("ty", F.floor(F.col("y") / tile)).withColumn("tx", F.floor(F.col("x") / tile))
    around = at.select(*k, F.explode(F.array(*[F.lit(i) for i in (-1, 0, 1)])).alias("i"), "ty", "tx", F.col("y").alias("y_b"), F.col("x").alias("x_b"), F.col("flux").alias("flux_b")).withColumn("ty", F.col("ty") + F.col("i"))
    around = around.withColumn("j", F.explode(F.array(*[F.lit(i) for i in (-1, 0, 1)]))).withColumn("tx", F.col("tx") + F.col("j"))
    brighter = "flux_b > flux OR (flux_b = flux AND (y_b < y OR (y_b = y AND x_b < x)))"
    rivals = cut(at.join(around, [*k, "ty", "tx"]).where(f"({brighter}) AND pow(y - y_b, 2) + pow(x - x_b, 2) < {float(min_separation) ** 2}").select(*k, "y", "x", "y_b", "x_b"))
    state = cut(peaks.withColumn("kept", F.lit(None).cast("boolean")))
    while True:
        fate = state.select(*k, F.col("y").alias("y_b"), F.col("x").alias("x_b"), F.col("kept").alias("kept_b"))
        seen = rivals.join(fate, [*k, "y_b", "x_b"]).groupBy(*k, "y", "x").agg(F.max(F.coalesce("kept_b", F.lit(False))).alias("beaten"), F.max(F.col("kept_b").isNull()).alias("waits"))
        kept = F.when(F.col("kept").isNotNull(), F.col("kept")).when(F.coalesce("beaten", F.lit(False)), False).when(F.coalesce("waits", F.lit(False)), F.lit(None)).otherwise(True)
        state = cut(state.join(seen, [*k, "y", "x"], "left").select(*[c for c in state.columns if c != "kept"], kept.alias("kept")))
        if state.where("kept IS NULL").isEmpty():
            return state.where("kept").drop("kept")


def scale_footprints(coeffs: DataFrame, scales: int, min_area: int = 4) -> tuple[DataFrame, DataFrame]:
    """Footprints of every plane of a starlet table but the last, in one plan."""
    return footprints(coeffs.where(F.col("scale") < scales), 0, min_area, (IMAGE, "scale"))


def shared_pixels(pixel: np.ndarray, tile: np.ndarray, first: np.ndarray, a: np.ndarray, b: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(tile, a, b, n) of the labels that share pixels, in parts of about ``CELLS`` pairs; repeated pixels of a label count once."""
    many_a, many_b = a.max(initial=0) + 1, b.max(initial=0) + 1
    tile_of_pixel = np.zeros(pixel.max(initial=0) + 1, np.int64)
    tile_of_pixel[pixel] = tile
    at_a, own_a = np.divmod(np.unique(pixel[first] * many_a + a[first]), many_a)
    at_b, own_b = np.divmod(np.unique(pixel[~first] * many_b + b[~first]), many_b)
    low = np.searchsorted(at_b, at_a)
    n = np.searchsorted(at_b, at_a, side="right") - low
    done = np.cumsum(n)
    at = 0
    while at < len(n):
        to = max(at + 1, int(np.searchsorted(done, (done[at - 1] if at else 0) + CELLS, side="right")))
        own = np.repeat(np.arange(at, to), n[at:to])
        other = low[own] + np.arange(len(own)) - np.repeat(np.cumsum(n[at:to]) - n[at:to], n[at:to])
        pair, count = np.unique((tile_of_pixel[at_a[own]] * many_a + own_a[own]) * many_b + own_b[other], return_counts=True)
        yield pair // many_b // many_a, pair // many_b % many_a, pair % many_b, count
        at = to


def footprint_overlap_join(a: DataFrame, b: DataFrame, keys: tuple[str, ...] = (IMAGE,), tile: int = 64) -> DataFrame:
    """keys, a_id, b_id, n: footprints (tables keys, label, y, x) that share pixels, and how many.

    Pixels of both meet in tiles, which count their pairs; only pairs are shuffled again, so a huge pair of footprints is no hot key.
    Repeated pixels of a footprint count once.
    """
    k = list(keys)
    side = lambda df, first: df.select(*k, "y", "x", F.lit(first).alias("first"), (F.col("label") if first else F.lit(None).cast(a.schema["label"].dataType)).alias("a_id"), (F.lit(None).cast(b.schema["label"].dataType) if first else F.col("label")).alias("b_id"))
    cells = side(a, True).unionByName(side(b, False)).dropna(subset=[*k, "y", "x"])
    lists = cells.groupBy(*k, F.floor(F.col("y") / tile).alias("ty"), F.floor(F.col("x") / tile).alias("tx")).agg(F.collect_list(F.struct("y", "x", "first", "a_id", "b_id")).alias("pixels"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch):
                column = part.column(part.schema.get_field_index("pixels"))
                y, x, first, *ids = column.flatten().flatten()
                number = np.repeat(np.arange(part.num_rows), column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
                place = (number * tile + y.to_numpy().astype(np.int64) % tile) * tile + x.to_numpy().astype(np.int64) % tile
                named = [i.dictionary_encode(null_encoding="encode") for i in ids]
                codes = [i.indices.to_numpy(zero_copy_only=False).astype(np.int64) for i in named]
                for t, own_a, own_b, n in shared_pixels(np.unique(place, return_inverse=True)[1], number, first.to_numpy(zero_copy_only=False), *codes):
                    columns = [part.column(part.schema.get_field_index(c)).take(pa.array(t)) for c in k]
                    columns += [i.dictionary.take(pa.array(own)) for i, own in zip(named, (own_a, own_b), strict=True)]
                    yield pa.RecordBatch.from_arrays([*columns, pa.array(n.astype(np.int64))], names=[*k, "a_id", "b_id", "n"])

    kinds = [*lists.select(*k).schema.fields, *cells.select("a_id", "b_id").schema.fields]
    parts = lists.mapInArrow(run, ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in kinds], "n long"]))
    return parts.groupBy(*k, "a_id", "b_id").agg(F.sum("n").alias("n"))


def blend_structures(table: DataFrame, fp_pixels: DataFrame) -> DataFrame:
    """image_id, struct_id, scale, y, x: for each scale-2 footprint the distinct peaks of it and of the scale 0 and 1 footprints whose boxes it overlaps."""
    part = lambda cond: table.where(cond).withColumn("box_id", F.struct("scale", "label"))
    linked = box_overlap_join(part("scale = 2"), part("scale < 2")).select(IMAGE, F.col("a_id.label").alias("struct_id"), F.col("b_id.scale").alias("scale"), F.col("b_id.label").alias("label"))
    own = table.where("scale = 2").select(IMAGE, F.col("label").alias("struct_id"), "scale", "label")
    peaks = local_maxima(fp_pixels, (IMAGE, "scale")).select(IMAGE, "scale", "label", "y", "x")
    return linked.unionByName(own).join(peaks, [IMAGE, "scale", "label"]).select(IMAGE, "struct_id", "scale", "y", "x").distinct()


def detect_peaks(pixels: DataFrame, scales: int = 3, **how: float) -> DataFrame:
    """image_id, y, x, flux: peaks of the footprints of plane 1 of the detection wavelets."""
    from pixelloom.operators.stencil import detect_wavelets

    coeffs = cut(detect_wavelets(pixels, scales, **how))
    _, inside = footprints(coeffs.where("scale = 1"), 0, 4, (IMAGE,))
    return local_maxima(inside).select(IMAGE, "y", "x", "flux")


def footprint_image(fp_pixels: DataFrame, boxes: DataFrame) -> DataFrame:
    """How many footprints hold each pixel of an image's box."""
    from pixelloom.functions.grid import explode_grid

    counts = fp_pixels.groupBy(IMAGE, "y", "x").agg(F.count(F.lit(1)).alias("n"))
    grid = explode_grid(boxes.select(IMAGE, "y0", "y1", "x0", "x1"), "y0", "y1", "x0", "x1").select(IMAGE, "y", "x")
    return grid.join(counts, [IMAGE, "y", "x"], "left").select(IMAGE, "y", "x", F.coalesce("n", F.lit(0)).alias("n"))


def mean_threshold(coadd: DataFrame) -> DataFrame:
    """``coadd`` with ``thresh``, the mean of its image."""
    return coadd.join(coadd.groupBy(IMAGE).agg(F.avg("value").alias("thresh")), IMAGE)
