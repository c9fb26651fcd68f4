"""Fits as tables of components: one row a component, tiles of pixels, and rounds that bring both together.

A component's row holds its box, seds, morphology, moments, iteration and losses, so a table of them is a fit that can
be saved and resumed. Pixels lie in tiles with a halo as wide as the kernels reach. A round sends components to the tiles that they touch. An image of
one tile takes several iterations in a round; an image of more tiles takes one: its tiles give partial gradients, which are added up by component.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelloom.functions import blend as B
from pixelloom.functions.grid import IMAGE, cut
from pixelloom.operators.models import COMPONENT

ARRAYS = ("sed", "s1", "s2", "s3", "m", "m1", "m2", "m3", "rms", "losses")
STATE = (
    "image_id long, source_id long, comp_id int, y0 int, x0 int, ny int, nx int, planes int, cy int, cx int, it int, t double, last double, settled boolean, bands array<string>, "
    + ", ".join(f"{a} array<double>" for a in ARRAYS)
)
KINDS = [(n, {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string()), "array<double>": pa.list_(pa.float64())}[t]) for n, t in (f.split(" ") for f in STATE.split(", "))]
PARTIAL = "image_id long, source_id long, comp_id int, by_sed array<double>, by_morph array<double>, loss double, weight double, pixels long"


def started(seds: DataFrame, morphs: DataFrame, centers: DataFrame | None = None, rms: DataFrame | None = None, scales: int | None = None) -> DataFrame:
    """The state of a fit that hasn't begun: a row for each component that has a SED and a morphology.

    ``rms`` (image_id, band, rms) is what boxes and background cuts go by. With ``scales`` the starlet planes of a morphology are what is fitted.
    Missing pixels of a box and missing bands of an image count as 0; centres are the boxes' middles if not given.
    """
    bands = seds.groupBy(IMAGE).agg(F.sort_array(F.collect_set("band")).alias("bands"))
    s = seds.groupBy(*COMPONENT).agg(F.collect_list("band").alias("own_bands"), F.collect_list(F.col("sed").cast("double")).alias("own_seds"))
    m = morphs.groupBy(*COMPONENT).agg(*[F.collect_list(F.col(c).cast("double" if c == "m" else "int")).alias(f"{c}_list") for c in ("y", "x", "m")])
    rows = s.join(m, COMPONENT).join(bands, IMAGE)
    none = lambda kind, n: F.lit(None).cast(kind).alias(n)
    rows = rows.join(centers.select(*COMPONENT, F.col("cy").cast("int"), F.col("cx").cast("int")), COMPONENT, "left") if centers is not None else rows.select("*", none("int", "cy"), none("int", "cx"))
    noise = rms.groupBy(IMAGE).agg(F.collect_list("band").alias("rms_bands"), F.collect_list(F.col("rms").cast("double")).alias("rms_list")) if rms is not None else None
    rows = rows.join(noise, IMAGE, "left") if noise is not None else rows.select("*", none("array<string>", "rms_bands"), none("array<double>", "rms_list"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = []
            for r in range(batch.num_rows):
                row = {n: batch.column(i)[r] for i, n in enumerate(batch.schema.names)}
                y, x, v = (row[c].values.to_numpy(zero_copy_only=False) for c in ("y_list", "x_list", "m_list"))
                shape = (int(y.max() - y.min()) + 1, int(x.max() - x.min()) + 1)
                m = np.zeros(shape)
                m[y - y.min(), x - x.min()] = v
                names = row["bands"].as_py()
                own = dict(zip(row["own_bands"].as_py(), row["own_seds"].as_py(), strict=True))
                noise = dict(zip(row["rms_bands"].as_py() or [], row["rms_list"].as_py() or [], strict=True))
                sed = np.array([own.get(b, 0.0) for b in names])
                y0, x0 = int(y.min()), int(x.min())
                cy, cx = row["cy"].as_py(), row["cx"].as_py()
                param = B.decomposed(m, scales) if scales else m
                c = B.Component((row["source_id"].as_py(), row["comp_id"].as_py()), y0, x0, y0 + shape[0] // 2 if cy is None else cy, x0 + shape[1] // 2 if cx is None else cx, sed, [np.zeros_like(sed) for _ in range(3)], param, [np.zeros_like(param) for _ in range(3)], np.array([noise.get(b, np.inf) for b in names]) if noise else None)
                held.append((row["image_id"].as_py(), names, c))
            yield encoded(held)

    return rows.mapInArrow(run, STATE)


def encoded(rows: list[tuple[int, list[str], B.Component]]) -> pa.RecordBatch:
    """Components as rows of ``STATE``."""
    columns: dict[str, list] = {n: [] for n, _ in KINDS}
    for image, bands, c in rows:
        ny, nx = c.param.shape[-2:]
        values = [image, *c.key, c.y0, c.x0, ny, nx, len(c.param) if c.param.ndim == 3 else 0, c.cy, c.cx, c.it, c.t, c.last, c.settled, bands]
        values += [c.sed, *c.sed_moments, c.param.ravel(), *(a.ravel() for a in c.moments), c.rms, np.array(c.losses, float)]
        for n, v in zip(columns, values, strict=True):
            columns[n].append(v)
    return pa.RecordBatch.from_arrays([pa.array(columns[n], t) for n, t in KINDS], names=[n for n, _ in KINDS])


def decoded(table: pa.Table | pa.RecordBatch) -> Iterator[tuple[int, list[str], B.Component]]:
    """(image, bands, component) of rows of ``STATE``, in order of their ids."""
    order = sorted(range(table.num_rows), key=lambda r: (table.column("source_id")[r].as_py(), table.column("comp_id")[r].as_py()))
    for r in order:
        v = {n: table.column(n)[r] for n, _ in KINDS}
        a = {n: v[n].values.to_numpy(zero_copy_only=False).astype(float) if v[n].is_valid else None for n in ARRAYS}
        p = {n: v[n].as_py() for n in ("image_id", "source_id", "comp_id", "y0", "x0", "ny", "nx", "planes", "cy", "cx", "it", "t", "last", "settled", "bands")}
        shape = (p["planes"], p["ny"], p["nx"]) if p["planes"] else (p["ny"], p["nx"])
        m, *moments = (a[n].reshape(shape) for n in ("m", "m1", "m2", "m3"))
        yield p["image_id"], p["bands"], B.Component((p["source_id"], p["comp_id"]), p["y0"], p["x0"], p["cy"], p["cx"], a["sed"], [a["s1"], a["s2"], a["s3"]], m, moments, a["rms"], p["it"], p["t"], p["last"], p["settled"], a["losses"].tolist())


def reach(observations: list[tuple[DataFrame, DataFrame]], plane_weights: list[float] | None) -> int:
    """How far a tile's gradient looks: twice the kernels' radius, and the starlet stencils."""
    radii = [k.agg(F.max(F.greatest(F.abs("dy"), F.abs("dx")))).first()[0] or 0 for _, k in observations]
    return 2 * max(radii) + (sum(2 * 2**j for j in range(len(plane_weights) - 1)) if plane_weights else 0)


def bounds(observations: list[tuple[DataFrame, DataFrame]], tile: int) -> DataFrame:
    """image_id, top, left, bottom, right (exclusive) over all observations, and how many tiles lie along y and x."""
    parts = [p.groupBy(IMAGE).agg(F.min("y").alias("top"), F.min("x").alias("left"), (F.max("y") + 1).alias("bottom"), (F.max("x") + 1).alias("right")) for p, _ in observations]
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    whole = whole.groupBy(IMAGE).agg(F.min("top").alias("top"), F.min("left").alias("left"), F.max("bottom").alias("bottom"), F.max("right").alias("right"))
    return whole.select("*", F.ceil((F.col("bottom") - F.col("top")) / tile).cast("int").alias("tiles_y"), F.ceil((F.col("right") - F.col("left")) / tile).cast("int").alias("tiles_x"))


def spread(df: DataFrame, tile: int, halo: int, y: str = "y", y9: str = "y", x: str = "x", x9: str = "x") -> DataFrame:
    """A row for each tile (ty, tx) whose region with halo meets rows y to y9 and columns x to x9."""
    low = lambda c, o: f"CAST(greatest(0, least({{n}} - 1, floor(({c} - {o} - {halo}) / {tile}))) AS INT)"
    high = lambda c, o: f"CAST(greatest(0, least({{n}} - 1, floor(({c} - {o} + {halo}) / {tile}))) AS INT)"
    rows = df.withColumn("ty", F.expr(f"explode(sequence({low(y, 'top').format(n='tiles_y')}, {high(y9, 'top').format(n='tiles_y')}))"))
    return rows.withColumn("tx", F.expr(f"explode(sequence({low(x, 'left').format(n='tiles_x')}, {high(x9, 'left').format(n='tiles_x')}))"))


def tiled(observations: list[tuple[DataFrame, DataFrame]], frames: DataFrame, tile: int, halo: int) -> DataFrame:
    """Rows (image_id, ty, tx, observation, band) with the lists of a tile's pixels, the kernel's entries and the image's bounds.

    Pixels come together in blocks of a quarter of a tile's side before anything is joined, so blocks and not pixels are shuffled. A tile gets
    all blocks that meet its region; ``placed`` leaves out what lies beyond.
    """
    out, side = None, max(1, tile // 4)
    for i, (pixels, kernels) in enumerate(observations):
        on = [c for c in (IMAGE, "band") if c in kernels.columns]
        # In one order of entries for all images and bands, so that equal kernels can be told.
        sorted_ = F.sort_array(F.collect_list(F.struct(*[F.col(c).cast("double").alias(c) for c in ("dy", "dx", "k")])))
        entries = kernels.groupBy(*on).agg(sorted_.alias("e")).select(*on, F.col("e.dy").alias("kdy"), F.col("e.dx").alias("kdx"), F.col("e.k").alias("kk"))
        rows = pixels.select(IMAGE, "band", "y", "x", F.col("value").cast("double").alias("value"), F.col("weight").cast("double").alias("weight"))
        block = [F.floor(F.col(c) / side).alias(f"block_{c}") for c in ("y", "x")]
        ends = [f(c).alias(f"{c}{n}") for c in ("y", "x") for n, f in ((0, F.min), (9, F.max))]
        gathered = rows.groupBy(IMAGE, "band", *block).agg(*ends, *[F.collect_list(c).alias(f"{c}s") for c in ("y", "x", "value", "weight")])
        by = [IMAGE, "ty", "tx", "band", "top", "left", "bottom", "right"]
        met = spread(gathered.join(frames, IMAGE), tile, halo, "y0", "y9", "x0", "x9")
        lists = met.groupBy(*by).agg(*[F.flatten(F.collect_list(f"{c}s")).alias(f"{c}s") for c in ("y", "x", "value", "weight")])
        lists = lists.join(entries, on, "left") if on else lists.crossJoin(F.broadcast(entries))
        lists = lists.select(*by, F.lit(i).alias("observation"), "ys", "xs", "values", "weights", "kdy", "kdx", "kk")
        out = lists if out is None else out.unionByName(lists)
    return out


def placed(table: pa.Table, bands: list[str], tile: int | None, halo: int) -> tuple[list[B.Observed], tuple[int, ...], tuple[int, ...]]:
    """What a tile's rows hold, its region (with halo) and its core; without ``tile`` both are the whole image."""
    top, left, bottom, right = (table.column(c)[0].as_py() for c in ("top", "left", "bottom", "right"))
    region = core = (top, left, bottom, right)
    if tile is not None:
        y, x = top + tile * table.column("ty")[0].as_py(), left + tile * table.column("tx")[0].as_py()
        core = (y, x, min(y + tile, bottom), min(x + tile, right))
        region = (max(top, y - halo), max(left, x - halo), min(bottom, y + tile + halo), min(right, x + tile + halo))
    shape = (region[2] - region[0], region[3] - region[1])
    seen: dict[int, B.Observed] = {}
    for r in range(table.num_rows):
        v = {n: table.column(n)[r] for n in ("ys", "xs", "values", "weights", "kdy", "kdx", "kk")}
        band = table.column("band")[r].as_py()
        if band not in bands:
            continue
        y, x = (v[n].values.to_numpy() - o for n, o in (("ys", region[0]), ("xs", region[1])))
        inside = (y >= 0) & (x >= 0) & (y < shape[0]) & (x < shape[1])
        planes = [np.zeros(shape) for _ in range(3)]
        for plane, what in zip(planes, (v["values"].values, v["weights"].values, None), strict=True):
            plane[y[inside], x[inside]] = 1.0 if what is None else what.to_numpy(zero_copy_only=False)[inside]
        entries = [(int(a), int(b), k) for a, b, k in zip(*((v[n].as_py() or []) for n in ("kdy", "kdx", "kk")), strict=True)]
        o = seen.setdefault(table.column("observation")[r].as_py(), B.Observed([], [], [], [], []))
        for held, what in zip((o.bands, o.value, o.weight, o.present, o.kernels), (bands.index(band), np.nan_to_num(planes[0]), np.nan_to_num(planes[1]), planes[2] > 0, entries), strict=True):
            held.append(what)
    return list(seen.values()), region, core


def weights_of(seen: list[B.Observed], core: tuple[int, ...], region: tuple[int, ...]) -> tuple[float, int]:
    """The sum and number of positive weights in a core."""
    inner = (slice(core[0] - region[0], core[2] - region[0]), slice(core[1] - region[1], core[3] - region[1]))
    own = [w[inner] for o in seen for w in o.weight]
    return float(sum(w[w > 0].sum() for w in own)), int(sum((w > 0).sum() for w in own))


def continued(state: DataFrame, observations: list[tuple[DataFrame, DataFrame]], how: B.How, max_iter: int, tile: int = 256, local: int = 10) -> DataFrame:
    """The state after the fit has gone on to ``max_iter`` iterations or settled, image by image.

    Each round is written to the checkpoint folder; a driver that is lost loses one round. An image's components
    settle together. Components of an image without pixels stay as they are.
    """
    halo = reach(observations, how.plane_weights)
    frames = cut(bounds(observations, tile))
    state = cut(state)
    done = state.where("settled").unionByName(state.where(~F.col("settled")).join(frames.select(IMAGE), IMAGE, "left_anti"))
    state = state.where(~F.col("settled")).join(frames.select(IMAGE), IMAGE, "left_semi")
    # As many tasks as other shuffles have: put together by the size of their rows, the rounds' arithmetic would leave most cores idle.
    dealt = lambda df, *by: df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)
    tiles = cut(tiled(observations, frames.join(state.select(IMAGE).distinct(), IMAGE, "left_semi"), tile, halo))
    wide = "tiles_y > 1 OR tiles_x > 1"
    small = state.join(frames.where(wide).select(IMAGE), IMAGE, "left_anti")
    large = state.join(frames.where(wide).select(IMAGE), IMAGE, "left_semi")
    rest = small

    def whole(left: pa.Table, right: pa.Table) -> pa.Table:
        """The steps of several images: each goes by its own pixels and loss, their components are shaped together."""
        parts, images = list(decoded(left)), {}
        for image, bands, c in parts:
            images.setdefault(image, (bands, []))[1].append(c)
        numbers, counts = np.unique(right.column(IMAGE).to_numpy(), return_counts=True)
        right = right.sort_by(IMAGE)
        ends = np.cumsum(counts)
        going = []
        for image, n, end in zip(numbers.tolist(), counts.tolist(), ends.tolist(), strict=True):
            if image in images:
                bands, components = images[image]
                seen, region, core = placed(right.slice(end - n, n), bands, None, halo)
                total, positive = weights_of(seen, core, region)
                going.append((components, seen, region, core, len(bands), total / max(positive, 1)))
        for _ in range(local):
            going = [g for g in going if not g[0][0].settled and g[0][0].it < max_iter]
            steps, losses = [], []
            for components, seen, region, core, n_bands, mean in going:
                g, loss = B.gradient(components, seen, region, core, n_bands, how.plane_weights)
                components[0].losses.append(loss)
                losses += [loss] * len(components)
                steps += [(c, *B.shares(c, g, region), mean) for c in components]
            B.advance_all(steps, how)
            for (c, *_), loss in zip(steps, losses, strict=True):
                B.after_step(c, loss, how)
        return pa.Table.from_batches([encoded(parts)])

    # Images of some 16,000 pixels together take their steps at once, if there are enough for all tasks.
    narrow = frames.where(f"NOT ({wide})").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("bottom") - F.col("top")).cast("long") * (F.col("right") - F.col("left"))).alias("area")).first()
    groups = max(1, min(narrow.n, max(int(state.sparkSession.conf.get("spark.sql.shuffle.partitions")), (narrow.area or 0) >> 14)))
    grouped = lambda df: df.withColumn("images", F.pmod(F.xxhash64(IMAGE), F.lit(groups)))
    own = dealt(grouped(tiles), "images").groupBy("images")
    unfinished = not rest.isEmpty()
    while unfinished:
        shaped = dealt(grouped(rest), "images").groupBy("images").cogroup(own).applyInArrow(whole, STATE)
        after = cut(shaped)
        over = F.col("settled") | (F.col("it") >= max_iter)
        ended, unfinished = after.agg(F.coalesce(F.bool_or(over), F.lit(False)), F.coalesce(F.bool_or(~over), F.lit(False))).first()
        done, rest = done.unionByName(after.where(over)) if ended else done, after.where(~over)
    if large.isEmpty():
        return done

    def partial(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        rows = {n: [] for n in ("image_id", "source_id", "comp_id", "by_sed", "by_morph", "loss", "weight", "pixels")}
        parts = list(decoded(left))
        if parts and right.num_rows:
            bands, components = parts[0][1], [c for _, _, c in parts]
            seen, region, core = placed(right, bands, tile, halo)
            g, loss = B.gradient(components, seen, region, core, len(bands), how.plane_weights)
            inner = np.zeros(g.shape[1:], bool)
            inner[core[0] - region[0] : core[2] - region[0], core[1] - region[1] : core[3] - region[1]] = True
            g = np.where(inner, g, 0.0)
            made = [(None, None, None, None, loss, *weights_of(seen, core, region))]
            for c in components:
                if c.overlap(core):
                    by_sed, by_morph = B.shares(c, g, region)
                    made.append((*c.key, by_sed, by_morph.ravel(), None, None, None))
            for row in made:
                for n, v in zip(rows, (parts[0][0], *row), strict=True):
                    rows[n].append(v)
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.float64(), pa.float64(), pa.int64()]
        return pa.table([pa.array(v, k) for v, k in zip(rows.values(), kinds, strict=True)], names=list(rows))

    def moved(left: pa.Table, right: pa.Table) -> pa.Table:
        parts = list(decoded(left))
        for _, _, c in parts:
            sums = [sum((row.values.to_numpy() for row in right.column(n) if row.is_valid), np.zeros(shape)) for n, shape in (("by_sed", len(c.sed)), ("by_morph", c.param.shape[-2] * c.param.shape[-1]))]
            loss, mean = left.column("loss")[0].as_py() or 0.0, left.column("mean")[0].as_py() or 1.0
            c.losses.append(loss)
            B.advance(c, sums[0], sums[1].reshape(c.param.shape[-2:]), how, mean)
            B.after_step(c, loss, how)
        return pa.Table.from_batches([encoded(parts)])

    place = [IMAGE, "ty", "tx"]
    while not large.isEmpty():
        sent = spread(large.join(frames, IMAGE), tile, halo, "y0", "y0 + ny - 1", "x0", "x0 + nx - 1")
        # Tiles that no component reaches still count in the loss: they get the image's first component.
        first = large.groupBy(IMAGE).agg(F.min(F.struct("source_id", "comp_id")).alias("f")).select(IMAGE, "f.source_id", "f.comp_id")
        bare = tiles.select(*place).distinct().join(sent.select(*place).distinct(), place, "left_anti").join(first, IMAGE)
        sent = sent.unionByName(bare.join(large.join(frames, IMAGE), COMPONENT), allowMissingColumns=True).select(*[n for n, _ in KINDS], "ty", "tx")
        parts = cut(dealt(sent, *place).groupBy(*place).cogroup(dealt(tiles, *place).groupBy(*place)).applyInArrow(partial, PARTIAL))
        loss = parts.where("source_id IS NULL").groupBy(IMAGE).agg(F.sum("loss").alias("loss"), (F.sum("weight") / F.sum("pixels")).alias("mean"))
        own = large.join(loss, IMAGE, "left")
        after = cut(own.groupBy(*COMPONENT).cogroup(parts.where("source_id IS NOT NULL").groupBy(*COMPONENT)).applyInArrow(moved, STATE))
        over = F.col("settled") | (F.col("it") >= max_iter)
        done, large = done.unionByName(after.where(over)), after.where(~over)
    return done


def joined_by(state: DataFrame, seds: DataFrame, morphs: DataFrame, centers: DataFrame | None = None, rms: DataFrame | None = None) -> DataFrame:
    """A fit's state with more sources: they start at the iteration where their image is, and its components go on; ids must be new."""
    at = state.groupBy(IMAGE).agg(F.max("it").alias("now"), F.max("last").alias("was"))
    scales = None
    more = started(seds, morphs, centers, rms, scales).join(at, IMAGE, "left")
    more = more.withColumn("it", F.coalesce("now", "it")).withColumn("last", F.col("was")).drop("now", "was")
    woken = state.join(more.select(IMAGE).distinct().withColumn("more", F.lit(True)), IMAGE, "left")
    woken = woken.withColumn("settled", F.col("settled") & F.col("more").isNull()).drop("more")
    return woken.unionByName(more.select(*[n for n, _ in KINDS]))


def seds_of(state: DataFrame) -> DataFrame:
    return state.select(*COMPONENT, F.explode(F.arrays_zip("bands", "sed")).alias("e")).select(*COMPONENT, F.col("e.bands").alias("band"), F.col("e.sed").alias("sed"))


def morphs_of(state: DataFrame) -> DataFrame:
    """The morphologies; those fitted as starlet planes are put together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for image, _, c in decoded(batch):
                m = c.m
                y, x = np.mgrid[: m.shape[0], : m.shape[1]]
                n = m.size
                columns = [pa.array(np.full(n, image)), pa.array(np.full(n, c.key[0])), pa.array(np.full(n, c.key[1], np.int32)), pa.array((y.ravel() + c.y0).astype(np.int32)), pa.array((x.ravel() + c.x0).astype(np.int32)), pa.array(m.ravel())]
                yield pa.RecordBatch.from_arrays(columns, names=[*COMPONENT, "y", "x", "m"])

    return state.mapInArrow(run, "image_id long, source_id long, comp_id int, y int, x int, m double")


def losses_of(state: DataFrame) -> DataFrame:
    """image_id, it, loss, from each image's longest history."""
    longest = state.groupBy(IMAGE).agg(F.max_by("losses", F.size("losses")).alias("losses"))
    return longest.select(IMAGE, F.posexplode("losses").alias("it", "loss"))
