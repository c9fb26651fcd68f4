"""Pixels as tiles: a row a tile with lists of its pixels, for what is arithmetic on small arrays.

Tiles are bounded, so a huge plane spreads over many tasks, and pixels come together before they are shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pixelloom.functions.grid import cut

SIDE, LEAD = 256, 64  # tiles begin at -64, 192, ..., so images that begin at 0 have a halo of 64 without a tile of its own
CELLS = 1 << 17  # pixels that a worker takes at once


def tile_of(axis: str) -> F.Column:
    return F.floor((F.col(axis) + LEAD) / SIDE).cast("int")


def tiled(df: DataFrame, keys: tuple[str, ...], columns: list[str], halo: int = 0) -> DataFrame:
    """keys, ty, tx, lists y, x and ``columns`` (null: NaN), and for each column ``c`` the list ``c_null`` of places in the tile that are null."""
    for axis, t in (("y", "ty"), ("x", "tx")):
        ends = [F.floor((F.col(axis) + LEAD + d) / SIDE).cast("int") for d in (-halo, halo)]
        df = df.withColumn(t, F.explode(F.sequence(*ends)) if halo else tile_of(axis))
    place = (F.col("y") + LEAD - F.col("ty") * SIDE + halo) * (SIDE + 2 * halo) + F.col("x") + LEAD - F.col("tx") * SIDE + halo
    values = [F.collect_list(F.coalesce(F.col(c).cast("double"), F.lit(float("nan")))).alias(c) for c in columns]
    nulls = [F.collect_list(F.when(F.col(c).isNull(), place.cast("int"))).alias(f"{c}_null") for c in columns]
    return df.groupBy(*keys, "ty", "tx").agg(*[F.collect_list(F.col(c).cast("int")).alias(c) for c in ("y", "x")], *values, *nulls)


def on_grid(batch: pa.RecordBatch, r: int, columns: list[str], halo: int, side: int, lead: int) -> tuple[np.ndarray, ...]:
    """y, x, corner y and x, the columns' grids, where they are null, and which pixels there are; repeated pixels and gaps in a row or column raise an error."""
    y, x = (batch.column(batch.schema.get_field_index(c))[r].values.to_numpy() for c in ("y", "x"))
    y0, x0 = int(y.min()), int(x.min())
    present = np.zeros((int(y.max()) - y0 + 1, int(x.max()) - x0 + 1), bool)
    present[y - y0, x - x0] = True
    for axis, name in ((0, "y"), (1, "x")):
        begun = np.logical_and.accumulate(~present, axis=axis)
        over = np.flip(np.logical_and.accumulate(np.flip(~present, axis), axis=axis), axis)
        if present.sum() != len(y) or not (present | begun | over).all():
            raise ValueError(f"the plane has gaps along {name}: densify it first")
    grids, nulls = np.zeros((2, len(columns), *present.shape))
    ty, tx = (batch.column(batch.schema.get_field_index(t))[r].as_py() for t in ("ty", "tx"))
    for i, c in enumerate(columns):
        grids[i, y - y0, x - x0] = batch.column(batch.schema.get_field_index(c))[r].values.to_numpy()
        at = batch.column(batch.schema.get_field_index(f"{c}_null"))[r].values.to_numpy()
        if len(at):
            ny, nx = np.divmod(at, side + 2 * halo)
            nulls[i, ny + ty * side - lead - halo - y0, nx + tx * side - lead - halo - x0] = np.nan
    return y, x, y0, x0, grids, nulls, present


def summed_on_grid(batch: pa.RecordBatch, r: int, column: str, halo: int, side: int, lead: int) -> tuple[int, int, np.ndarray, np.ndarray, np.ndarray]:
    """Corner y and x, the column's grid, which pixels there are and which have a value; repeated pixels add up, and gaps are 0."""
    y, x, v = (batch.column(batch.schema.get_field_index(c))[r].values.to_numpy() for c in ("y", "x", column))
    y0, x0 = int(y.min()), int(x.min())
    shape = (int(y.max()) - y0 + 1, int(x.max()) - x0 + 1)
    at, size = (y - y0) * shape[1] + x - x0, shape[0] * shape[1]
    n = np.bincount(at, minlength=size)
    empty = np.zeros(size, np.int64)
    places = batch.column(batch.schema.get_field_index(f"{column}_null"))[r].values.to_numpy()
    if len(places):
        ny, nx = np.divmod(places, side + 2 * halo)
        ty, tx = (batch.column(batch.schema.get_field_index(t))[r].as_py() for t in ("ty", "tx"))
        empty = np.bincount((ny + ty * side - lead - halo - y0) * shape[1] + nx + tx * side - lead - halo - x0, minlength=size)
    odd = np.isnan(v)
    total = np.bincount(at, np.where(odd, 0.0, v), size)
    if odd.any():
        total[np.bincount(at[odd], minlength=size) > empty] = np.nan
    return y0, x0, total.reshape(shape), (n > 0).reshape(shape), (n > empty).reshape(shape)


def pixels_of(batch: pa.RecordBatch, keys: tuple[str, ...], rows: list[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]], out: list[str]) -> pa.RecordBatch:
    """Pixels from (row of the batch, y, x, values, which of them are null)."""
    at = pa.array(np.repeat([r[0] for r in rows], [len(r[1]) for r in rows]))
    values, empty = (np.concatenate([r[i] for r in rows], axis=1) for i in (3, 4))
    columns = [batch.column(batch.schema.get_field_index(k)).take(at) for k in keys] + [pa.array(np.concatenate([r[i] for r in rows]).astype("int32")) for i in (1, 2)]
    return pa.RecordBatch.from_arrays(columns + [pa.array(v, mask=n) for v, n in zip(values, empty, strict=True)], names=[*keys, "y", "x", *out])


def each_tile(lists: DataFrame, keys: tuple[str, ...], columns: list[str], halo: int, make: Callable[..., np.ndarray], out: list[str], given: str | None = None) -> DataFrame:
    """keys, y, x and ``out``: what ``make`` gives for tiles' grids and present pixels, without the halo.

    ``make(grids, present)`` takes tiles of one shape at once, grids (len(columns), tile, y, x), gives an array (len(out), tile, y, x) and has to be a stencil:
    where it meets a null the result is null. With ``given`` it also takes that column of the tiles' rows.
    """
    side, lead, names = SIDE, LEAD, [f"`{f.name}` {f.dataType.simpleString()}" for f in lists.select(*keys).schema.fields]

    def done(batch: pa.RecordBatch, some: list[tuple]) -> Iterator[tuple]:
        grids, nulls, present = (np.stack([t[i] for t in some], axis=axis) for i, axis in ((5, 1), (6, 1), (7, 0)))
        more = () if given is None else (np.array([batch.column(batch.schema.get_field_index(given))[t[0]].as_py() for t in some]),)
        values = make(grids, present, *more)
        empty = np.isnan(make(nulls, present, *more)) if np.isnan(nulls).any() else np.zeros(values.shape, bool)
        for i, (r, y, x, y0, x0, *_) in enumerate(some):
            yield r, y, x, values[:, i, y - y0, x - x0], empty[:, i, y - y0, x - x0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            waiting: dict[tuple[int, int], list[tuple]] = {}
            for r in range(batch.num_rows):
                y, x, y0, x0, grids, nulls, present = on_grid(batch, r, columns, halo, side, lead)
                ty, tx = (batch.column(batch.schema.get_field_index(t))[r].as_py() for t in ("ty", "tx"))
                own = ((y + lead) // side == ty) & ((x + lead) // side == tx)
                if own.any():
                    some = waiting.setdefault(present.shape, [])
                    some.append((r, y[own], x[own], y0, x0, grids, nulls, present))
                    if len(some) * present.size >= CELLS:
                        yield pixels_of(batch, keys, list(done(batch, waiting.pop(present.shape))), out)
            for some in waiting.values():
                yield pixels_of(batch, keys, list(done(batch, some)), out)

    return lists.mapInArrow(run, ", ".join([*names, "y int", "x int", *[f"`{o}` double" for o in out]]))


def split_planes(pixels: DataFrame, keys: tuple[str, ...]) -> tuple[DataFrame, DataFrame | None]:
    """Planes of one tile and finite values, as rows of lists; and the pixels of all others, None if there aren't any."""
    lists = cut(tiled(pixels, keys, ["value"]))
    odd = F.exists("value", lambda v: F.isnan(v) | (F.abs(v) == float("inf")))
    tiles = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    many = cut(lists.select(*keys, odd.alias("odd")).withColumn("tiles", tiles).groupBy(*keys).agg(F.max("odd").alias("odd"), F.max("tiles").alias("tiles")).where("odd OR tiles > 1").select(*keys))
    if many.isEmpty():
        return lists, None
    same = [F.col(f"l.{k}").eqNullSafe(F.col(f"m.{k}")) for k in keys]
    m = many.alias("m")
    return lists.alias("l").join(m, same, "left_anti"), pixels.alias("l").join(m, same, "left_semi")


def gathered(df: DataFrame, keys: tuple[str, ...], columns: list[str], halo: int = 0) -> DataFrame:
    """keys, ty, tx and ``pixels``: the tile's rows as a list of structs of y, x and ``columns`` in their own types, in any order."""
    for axis, t in (("y", "ty"), ("x", "tx")):
        ends = [F.floor((F.col(axis) + LEAD + d) / SIDE).cast("int") for d in (-halo, halo)]
        df = df.withColumn(t, F.explode(F.sequence(*ends)) if halo else tile_of(axis))
    return df.groupBy(*keys, "ty", "tx").agg(F.collect_list(F.struct("y", "x", *columns)).alias("pixels"))


def pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch of ``gathered`` rows in parts of at most ``CELLS`` pixels, or one tile."""
    sizes = batch.column(batch.schema.get_field_index("pixels")).value_lengths().to_numpy(zero_copy_only=False)
    low, held = 0, 0
    for r, n in enumerate(sizes.tolist()):
        if r > low and held + n > CELLS:
            yield batch.slice(low, r - low)
            low, held = r, 0
        held += n
    if batch.num_rows:
        yield batch.slice(low)


def each_pixel(lists: DataFrame, keys: tuple[str, ...], make: Callable[..., tuple[np.ndarray, list[np.ndarray]]], out: list[tuple[str, str]]) -> DataFrame:
    """keys, y, x, the other columns of ``pixels`` and ``out`` (names and types) for some of the tiles' pixels.

    ``make(tile, ty, tx, y, x, fields)`` takes the pixels of several whole tiles, ``tile`` numbers them from 0, and gives the places of those that it keeps and their new columns.
    """
    kinds = {"int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_()}
    inner = lists.schema["pixels"].dataType.elementType
    names = [f"`{f.name}` {f.dataType.simpleString()}" for f in (*lists.select(*keys).schema.fields, *inner.fields)]

    def done(batch: pa.RecordBatch) -> pa.RecordBatch:
        column = batch.column(batch.schema.get_field_index("pixels"))
        flat = column.flatten()
        fields = {f.name: flat.field(i) for i, f in enumerate(flat.type)}
        tile = np.repeat(np.arange(batch.num_rows), column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
        ty, tx = (batch.column(batch.schema.get_field_index(t)).to_numpy().astype(np.int64) for t in ("ty", "tx"))
        y, x = (fields[c].to_numpy().astype(np.int64) for c in ("y", "x"))
        kept, made = make(tile, ty[tile], tx[tile], y, x, fields)
        at = pa.array(tile[kept])
        columns = [batch.column(batch.schema.get_field_index(k)).take(at) for k in keys] + [f.take(pa.array(kept)) for f in fields.values()]
        columns += [pa.array(m, kinds[t]) for m, (_, t) in zip(made, out, strict=True)]
        return pa.RecordBatch.from_arrays(columns, names=[*keys, *fields, *[n for n, _ in out]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from map(done, pieces(batch))

    return lists.mapInArrow(run, ", ".join([*names, *[f"`{n}` {t}" for n, t in out]]))
