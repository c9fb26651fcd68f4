"""What keeps large tables whole and off the driver: plans and bounds of the steps that many queries share."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelloom.functions.grid import explode_grid
from pixelloom.plans import fixtures as X
from pixelloom.plans import registry


def planned(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["f18_resample_rotated", "l4_adaptive_update"])
def test_pixels_are_never_broadcast(spark, sf_dir, name):
    assert "BroadcastHashJoin" not in planned(registry.QUERIES[name](spark, sf_dir))


def test_exploded_cells_are_never_broadcast(spark):
    boxes = spark.range(10).selectExpr("id AS image_id", "0 AS y0", "100 AS y1", "0 AS x0", "100 AS x1")
    cells = explode_grid(boxes, "y0", "y1", "x0", "x1").select("image_id", "y", "x")
    assert "Broadcast" not in planned(cells.join(cells.withColumnRenamed("y", "z"), ["image_id", "x"]))


def test_dense_keeps_planes_without_places(spark):
    sums = spark.createDataFrame([(1, "a", 0, 1, 5), (1, "a", 1, 0, None), (1, "b", None, 1, 7), (2, "a", 9, 9, 8), (2, None, 0, 0, 3), (3, "a", 1, None, 4)], "image_id long, band string, y int, x int, value long")
    got = {(r.image_id, r.band, r.y, r.x): r.value for r in X.finished(X.dense(sums, 2, 2)).collect()}
    planes = {(1, "a"), (1, "b"), (2, "a"), (2, None), (3, "a")}
    assert got == {(i, b, y, x): 5 if (i, b, y, x) == (1, "a", 0, 1) else 0 for i, b in planes for y in range(2) for x in range(2)}


def test_cut_outs_are_not_shuffled(spark):
    """Boxes over tile borders, past the edge, on gaps, of images without pixels or with a nameless band; the same with and without corners."""
    from pixelloom.operators.boxes import box_extract, box_insert

    pixels = [(1, b, y, x, 100 * y + x) for b in ("g", "r") for y in range(20) for x in range(18) if (y, x) != (3, 3) and (b == "g" or y < 5)] + [(1, None, 0, 0, 5)]
    boxes = [(1, 1, 14, 22, 13, 20), (1, 2, -3, 4, -2, 4), (1, 3, 40, 42, 40, 41), (1, 4, 2, 2, 0, 3), (2, 5, 0, 2, 0, 2)]
    p = spark.createDataFrame(pixels, "image_id long, band string, y int, x int, value long")
    b = spark.createDataFrame(boxes, "image_id long, box_id long, y0 int, y1 int, x0 int, x1 int")
    known = {(q[1], q[2], q[3]): q[4] for q in pixels}
    want = {(i, n, band, y - y0, x - x0): known.get((band, y, x), -1) if band else -1 for i, n, y0, y1, x0, x1 in boxes if i == 1 for band in ("g", "r", None) for y in range(y0, y1) for x in range(x0, x1)}
    out = box_extract(p, b, -1)
    assert {tuple(r)[:5]: r.value for r in out.collect()} == want and out.count() == len(want)
    cells = [line for line in planned(out).splitlines() if "Exchange" in line]
    assert cells and not any("box_id" in line and " y#" in line for line in cells)
    for how in ("add", "replace"):
        direct = box_insert(p, box_extract(p, b, -1, corners=True), b, how)
        joined = box_insert(p, out, b, how)
        assert sorted(map(str, direct.collect())) == sorted(map(str, joined.collect()))
    assert "box_id" not in [line for line in planned(box_insert(p, box_extract(p, b, corners=True), b)).splitlines() if "Join" in line][0]


def test_pipeline_packs_in_little_memory(spark, sf_dir, monkeypatch):
    """The last stage's workers hold few words and small batches; which don't change what they give."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    from pixelloom.llm import packing

    given, made = {}, packing.token_pieces
    monkeypatch.setattr(packing, "token_pieces", lambda *a, **how: given.update(how) or made(*a, **how))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60)
    corpus_pipeline.pack_sequences(spark, docs, sf_dir)
    assert given["keep_words"] <= 150_000 and given["batch_bytes"] <= 2 << 20
    path = corpus_pipeline.public_tokenizers.path("word_bpe_49k.json")
    small, large = (made(docs, path, keep_words=n, batch_bytes=b).selectExpr("doc_id", "piece", "start", "length", "crc32(ids)") for n, b in ((50, 4096), (600_000, 8 << 20)))
    assert sorted(map(str, small.collect())) == sorted(map(str, large.collect()))


def test_tiles_are_whole_planes(spark, monkeypatch):
    """Transforms, their inverse, denoising and significant starlets on tiles of 16 pixels and on whole planes; nulls spread as they do in sums."""
    import numpy as np

    from pixelloom.operators import stencil, tiles

    a = np.random.default_rng(5).normal(0, 1, (40, 37)) + 30 * (np.hypot(*(np.mgrid[:40, :37] - 18)) < 4)
    rows = [(1, b, y - 7, x, None if (b, y, x) == ("n", 5, 5) else float(a[y, x])) for b in ("g", "n") for y in range(40) for x in range(37)]
    df = spark.createDataFrame(rows, "image_id long, band string, y int, x int, value double")
    variance = df.withColumn("variance", F.lit(1.0))

    def made():
        w = stencil.starlet_transform(df, 2)
        found = [w, stencil.starlet_reconstruct(w, 2), stencil.wavelet_denoise(df.where("band = 'g'"), 2, max_iter=3), stencil.band_wavelets(variance.where("band = 'g'"), 2)]
        return [{tuple(r[c] for c in t.columns if c != "value"): r.value for r in t.collect()} for t in found]

    whole = made()
    monkeypatch.setattr(tiles, "SIDE", 16)
    monkeypatch.setattr(tiles, "LEAD", 4)
    parts = made()
    assert sum(v is None for v in whole[0].values()) > 0
    for one, other in zip(whole, parts, strict=True):
        assert one.keys() == other.keys() and len(one) > 0
        for at, v in one.items():
            assert other[at] is None if v is None else abs(other[at] - v) < 1e-9


def test_wavelets_of_small_planes_take_few_jobs(spark, sf_dir):
    """Rounds run on a plane's array, not as jobs: it was several jobs a round and 20 rounds."""
    tracker, group = spark.sparkContext.statusTracker(), "wavelets of small planes"
    spark.sparkContext.setJobGroup(group, group)
    registry.QUERIES["f8_wavelet_denoise"](spark, sf_dir).count()
    assert 0 < len(tracker.getJobIdsForGroup(group)) <= 20
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_norms_are_made_once_a_size(spark, monkeypatch):
    """A thousand images of two sizes put two unit images through the transform."""
    from pixelloom.operators import stencil

    units, made = [], stencil.starlet_transform
    monkeypatch.setattr(stencil, "starlet_transform", lambda df, *a, **how: units.append(df) or made(df, *a, **how))

    frames = spark.range(1000).selectExpr("id AS image_id", "IF(id % 2 = 0, 20, 24) AS ny", "21 AS nx")
    norms = stencil.starlet_norm(frames, 2)
    assert norms.count() == 3000 and norms.groupBy("scale").agg(F.countDistinct("norm").alias("n")).where("n > 2").isEmpty()
    alone = stencil.starlet_norm(frames.where("image_id = 7"), 2).collect()
    assert {(r.scale, r.norm) for r in alone} == {(r.scale, r.norm) for r in norms.where("image_id = 7").collect()}
    assert units[0].select("image_id").distinct().count() == 2


def brute_regions(lit):
    root = {p: p for p in lit}

    def find(p):
        while root[p] != p:
            root[p] = root[root[p]]
            p = root[p]
        return p

    for y, x in lit:
        for q in ((y + 1, x), (y, x + 1)):
            if q in root:
                a, b = sorted((find((y, x)), find(q)))
                root[b] = a
    return {p: find(p) for p in lit}


def test_regions_in_tiles_and_over_their_edges(spark):
    """Regions of images in one tile need no rounds of joins; those over tiles' edges are joined, whatever the coordinates."""
    from pixelloom.operators import detect

    rng = np.random.default_rng(3)
    images = {1: {(y, x) for y in range(40) for x in range(30) if rng.random() < 0.6}, 2: {(y, x) for y in range(-70, -50) for x in range(180, 460) if rng.random() < 0.65}, 3: {(190 + i, 191 + j) for i in range(5) for j in range(3) if i % 2 == 0 or j == (i // 2) % 2 * 2}}
    rows = [(i, y, x, 2.0) for i, lit in images.items() for y, x in lit] + [(1, y, x, 0.5) for y in range(40) for x in range(30) if (y, x) not in images[1]] + [(4, 0, 70000, 2.0), (4, 1, 70000, 2.0), (4, 1, 69999, 2.0), (None, 0, 0, 2.0)]
    df = spark.createDataFrame(rows, "image_id long, y int, x int, value double")
    got = {(r.image_id, r.y, r.x): r.label for r in detect.label_components(df, 1).collect()}
    want = {(i, y, x): a * detect.ROW + b for i, lit in images.items() for (y, x), (a, b) in brute_regions(lit).items()} | {(4, y, x): 70000 for y, x in ((0, 70000), (1, 70000), (1, 69999))}
    assert got == want
    rounds = detect.components
    try:
        detect.components = None
        assert {(r.image_id, r.y, r.x): r.label for r in detect.label_components(df.where("image_id = 1"), 1).collect()} == {k: v for k, v in want.items() if k[0] == 1}
        assert detect.label_components(df.where("value > 9"), 1).count() == 0
    finally:
        detect.components = rounds


def test_maxima_of_footprints_that_share_pixels_or_tiles(spark):
    from pixelloom.operators import detect

    rng = np.random.default_rng(4)
    nan = float("nan")
    rows = [(1, 7, y, x, int(rng.integers(9))) for y in range(185, 200) for x in range(188, 198)] + [(1, 8, y, x, int(rng.integers(9))) for y in range(190, 194) for x in range(190, 194)] + [(2, 7, 0, 0, 3), (2, 7, 0, 1, 3), (2, 7, 5, 5, None), (2, 7, 9, 9, None), (2, 7, 9, 8, 1), (2, 7, 20, 20, 4), (2, 7, 20, 20, 5), (2, 7, 21, 20, 4)]
    df = spark.createDataFrame(rows, "image_id long, label long, y int, x int, value long")
    want = set()
    for i, label, y, x, v in rows:
        near = [w for j, other, b, a, w in rows if (j, other) == (i, label) and (b, a) != (y, x) and abs(b - y) <= 1 and abs(a - x) <= 1 and w is not None]
        if not near or v is not None and v > max(near):
            want.add((i, label, y, x, v))
    found = detect.local_maxima(df)
    assert dict(found.dtypes)["flux"] == "bigint" and {(r.image_id, r.label, r.y, r.x, r.flux) for r in found.collect()} == want
    odd = spark.createDataFrame([(1, 1, 0, 0, 5.0), (1, 1, 0, 1, nan), (1, 1, 1, 1, float("inf")), (1, 2, 0, 0, nan), (1, 2, 0, 1, nan), (1, 3, 0, 0, 0.0), (1, 3, 0, 1, -0.0)], "image_id long, label long, y int, x int, value double")
    assert [(r.label, r.y, r.x) for r in detect.local_maxima(odd).collect()] == [(1, 0, 1)]
    assert "Generate inline" not in planned(found)


def test_shared_pixels_of_footprints(spark):
    """Over tiles' edges, with repeated pixels, nameless footprints and images: the same as a join by the pixel, which isn't shuffled."""
    from pixelloom.operators import detect

    rng = np.random.default_rng(6)
    made = lambda: [(int(i), int(n), int(y), int(x)) for i, n, y, x in zip(rng.integers(2, size=400), rng.integers(5, size=400), rng.integers(-5, 4, size=400), rng.integers(58, 70, size=400), strict=True)]
    a, b = made() + [(1, None, 0, 60), (None, 1, 0, 60)], made() + [(1, 2, 0, 60), (None, 1, 0, 60)]
    schema = "image_id long, label long, y int, x int"
    want = {}
    for i, n, y, x in set(a):
        for j, m, v, u in set(b):
            if i is not None and (i, y, x) == (j, v, u):
                want[i, n, m] = want.get((i, n, m), 0) + 1
    found = detect.footprint_overlap_join(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema.replace("label long", "label int")))
    assert {(r.image_id, r.a_id, r.b_id): r.n for r in found.collect()} == want and len(want) > 40
    assert dict(found.dtypes) == {"image_id": "bigint", "a_id": "bigint", "b_id": "int", "n": "bigint"} and "Join" not in planned(found)


def test_shared_pixels_come_in_parts(monkeypatch):
    from pixelloom.operators import detect

    rng = np.random.default_rng(7)
    pixel, first, a, b = rng.integers(40, size=600), rng.random(600) < 0.5, rng.integers(6, size=600), rng.integers(6, size=600)

    def counted():
        out, most = {}, 0
        for part in detect.shared_pixels(np.unique(pixel, return_inverse=True)[1], pixel // 10, first, a, b):
            most = max(most, int(part[3].sum()))
            for t, i, j, n in zip(*(c.tolist() for c in part), strict=True):
                out[t, i, j] = out.get((t, i, j), 0) + n
        return out, most

    whole, _ = counted()
    monkeypatch.setattr(detect, "CELLS", 50)
    parts, most = counted()
    assert parts == whole and most <= 50 and sum(whole.values()) > 500


def test_monotonic_steps_follow_a_box_s_side():
    """Rings of different radii are one step where they don't wait for each other, with the pixels of the ring-by-ring sweep."""
    from pixelloom.functions import blend

    rng = np.random.default_rng(7)
    for ny, nx, cy, cx in ((41, 41, 20, 20), (13, 30, 2, 25)):
        m = rng.random((ny, nx))
        assert len(blend.rings(ny, nx, cy, cx, "angle")) <= 2 * max(ny, nx)
        want = m.copy()
        places = sorted(((y - cy) ** 2 + (x - cx) ** 2, y, x) for y in range(ny) for x in range(nx))
        for r, y, x in places[1:]:
            near = [(p, q) for p in range(max(0, y - 1), min(ny, y + 2)) for q in range(max(0, x - 1), min(nx, x + 2)) if (p - cy) ** 2 + (q - cx) ** 2 < r]
            cos = np.array([((y - p) * (y - cy) + (x - q) * (x - cx)) / np.sqrt(r * ((y - p) ** 2 + (x - q) ** 2)) for p, q in near])
            cos[np.abs(cos) <= 1e-12] = 0
            if cos.sum() > 0:
                want[y, x] = min(m[y, x], (cos * [want[p] for p in near]).sum() / cos.sum())
        assert np.allclose(blend.monotonic(m, cy, cx), want, rtol=1e-12)


def test_rounds_of_fits_and_systems_are_spread_over_all_tasks(spark):
    """Small rows were put together in one task, which solved all systems or took all images' steps."""
    from pixelloom.operators import blocks, fit

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    images = spark.range(20).withColumnRenamed("id", "image_id")
    pixels = images.selectExpr("image_id", "'r' AS band", "explode(sequence(0, 6)) AS y").selectExpr("*", "explode(sequence(0, 6)) AS x").selectExpr("*", "CAST(9 - y - x AS DOUBLE) AS value", "1.0D AS weight")
    morphs = pixels.selectExpr("image_id", "1L AS source_id", "0 AS comp_id", "y", "x", "1.0D / (1 + abs(y - 3) + abs(x - 3)) AS m")
    seds = images.selectExpr("image_id", "1L AS source_id", "0 AS comp_id", "'r' AS band", "2.0D AS sed")
    kernel = images.selectExpr("image_id", "'r' AS band", "0 AS dy", "0 AS dx", "1.0D AS k")
    after = fit.fit_state([(pixels, kernel)], blocks.started(seds, morphs), 2, resize=None)
    assert after.count() == 20 and after.rdd.getNumPartitions() >= n
    solved = fit.fit_seds(pixels, morphs, kernel)
    assert solved.count() == 20 and "REPARTITION_BY_NUM" in planned(solved) and "FlatMapGroupsInPandas" not in planned(solved)


def test_kernels_of_images_leave_planes_where_they_are(spark, sf_dir):
    """Sums of moved pixels were shuffled once more to be cut at their image's ends, and a dense model was moved where a few pixels have a source."""
    from pixelloom.operators.stencil import shift_image
    from pixelloom.plans import q_fit

    shifts = X.v_planes(spark, sf_dir).select("image_id").distinct().selectExpr("image_id", "0.25D AS shift_y", "-0.5D AS shift_x")
    pixels = X.v(spark, sf_dir)
    moved = planned(shift_image(pixels, shifts, "bilinear"))
    above = moved[: moved.index("BroadcastNestedLoopJoin")]
    assert "Exchange" not in above
    loss = planned(q_fit.l1b(spark, sf_dir))
    assert loss.count("BroadcastNestedLoopJoin") <= 10  # pairs of axes: pixels are made at most five times


def test_losses_add_up_in_any_order(spark):
    """A sum of doubles that lies at a rounding tie followed the order of the rows."""
    from pixelloom.operators import fit

    value = [4e5, *[0.44] * 300]
    rows = [[(0, "r", 0, x, v, 1.0) for x, v in enumerate(order)] for order in (value, value[::-1])]
    schema = "image_id long, band string, y int, x int, value double, weight double"
    kernel = spark.createDataFrame([(0, "r", 0, 0, 1.0)], "image_id long, band string, dy int, dx int, k double")
    seds = spark.createDataFrame([(0, 0, 0, "r", 0.0)], "image_id long, source_id long, comp_id int, band string, sed double")
    morphs = spark.createDataFrame([(0, 0, 0, 0, 0, 1.0)], "image_id long, source_id long, comp_id int, y int, x int, m double")
    made = [fit.likelihood_gradient(spark.createDataFrame(r, schema).coalesce(1), seds, morphs, kernel)[1].first().loss for r in rows]
    assert made[0] == made[1] == math.fsum(v * v / 2 for v in value)


def test_splines_of_starlets_move_no_pixels(spark, sf_dir, monkeypatch):
    """Nulls, gaps, repeated pixels and planes smaller than their image, on whole planes and over tiles' edges: the same as two convolutions; the query shuffles no coefficients."""
    from pixelloom.operators import stencil, tiles

    plan = planned(registry.QUERIES["f21_scale_spline_convolve"](spark, sf_dir))
    assert not any("scale" in line for line in plan.splitlines() if "Exchange" in line)

    rng = np.random.default_rng(8)
    rows = [(1, b, y - 3, x, None if (y, x) == (4, 5) else float(rng.normal())) for b, ny, nx in (("g", 33, 29), ("r", 21, 24)) for y in range(ny) for x in range(nx)]
    df = spark.createDataFrame(rows, "image_id long, band string, y int, x int, value double")
    odd = [(1, "g", j, y, x, v) for j, y, x, v in ((0, 0, 0, 1.0), (0, 0, 0, 2.0), (1, 9, 9, None), (1, 30, 2, float("nan")), (2, 15, 15, -1.0), (2, 15, 16, None), (2, 15, 15, None), (3, 5, 5, 1.0))] + [(2, "g", 1, 7, 7, 4.0)]
    gaps = spark.createDataFrame(odd, "image_id long, band string, scale int, y int, x int, value double")

    def twice(coeffs):
        table = spark.createDataFrame(stencil.spline_entries(2), "scale int, d int, k double")
        for axis in (("d AS dy", "0 AS dx"), ("0 AS dy", "d AS dx")):
            coeffs = stencil.convolve(coeffs, table.selectExpr("scale", *axis, "k"), keys=("image_id", "band", "scale"))
        return coeffs

    def found(made):
        rows = made.collect()
        out = {(r.image_id, r.band, r.scale, r.y, r.x): r.value for r in rows}
        assert len(out) == len(rows)
        return out

    whole = stencil.starlet_transform(df, 2)
    want = [found(twice(whole)), found(twice(gaps))]
    assert any(v is None for v in want[1].values())
    for _ in range(2):
        for one, other in zip([found(stencil.starlet_splines(df, 2)), found(stencil.scale_spline_convolve(whole, 2)), found(stencil.scale_spline_convolve(gaps, 2))], [want[0], *want], strict=True):
            assert one.keys() == other.keys()
            for at, v in one.items():
                assert other[at] is None if v is None else np.isclose(v, other[at], rtol=1e-9, atol=1e-9, equal_nan=True)
        monkeypatch.setattr(tiles, "SIDE", 16)
        monkeypatch.setattr(tiles, "LEAD", 4)


def test_images_take_their_steps_together(monkeypatch):
    """One sweep serves all boxes of a shape and centre, with the very numbers of each by itself."""
    from pixelloom.functions import blend

    def parts():
        made, fresh = [], np.random.default_rng(10)
        for i in range(12):
            shape = (9, 9) if i % 3 else (11, 7)
            c = blend.Component((i, 0), i, 2 * i, i + shape[0] // 2, 2 * i + shape[1] // 2, fresh.random(3), [np.zeros(3) for _ in range(3)], fresh.random(shape), [np.zeros(shape) for _ in range(3)], np.ones(3))
            made.append((c, fresh.normal(size=3), fresh.normal(size=shape), 1.5))
        return made

    for how in (blend.How(), blend.How(scheme="fista"), blend.How(scheme="adam", bg_thresh=0.1, cut=True), blend.How(prox_iter=3)):
        one, other, calls, sweeps = parts(), parts(), [], blend.rings
        monkeypatch.setattr(blend, "rings", lambda *a: calls.append(a) or sweeps(*a))  # noqa: B023
        for _ in range(3):
            blend.advance_all(one, how)
        assert how.prox_iter > 1 or len(calls) == 6
        monkeypatch.setattr(blend, "rings", sweeps)
        for _ in range(3):
            for step in other:
                blend.advance(*step[:3], how, step[3])
        for (a, *_), (b, *_) in zip(one, other, strict=True):
            assert np.array_equal(a.param, b.param) and np.array_equal(a.sed, b.sed) and a.t == b.t


def test_rounds_in_which_no_image_ends_are_not_read_again(spark):
    from pixelloom.operators import blocks, fit

    images = spark.range(3).withColumnRenamed("id", "image_id")
    pixels = images.selectExpr("image_id", "'r' AS band", "explode(sequence(0, 6)) AS y").selectExpr("*", "explode(sequence(0, 6)) AS x").selectExpr("*", "CAST(9 - y - x AS DOUBLE) AS value", "1.0D AS weight")
    morphs = pixels.selectExpr("image_id", "1L AS source_id", "0 AS comp_id", "y", "x", "1.0D / (1 + abs(y - 3) + abs(x - 3)) AS m")
    seds = images.selectExpr("image_id", "1L AS source_id", "0 AS comp_id", "'r' AS band", "2.0D AS sed")
    kernel = images.selectExpr("image_id", "'r' AS band", "0 AS dy", "0 AS dx", "1.0D AS k")
    begun = blocks.started(seds, morphs)
    after = [fit.fit_state([(pixels, kernel)], begun, 6, resize=None, e_rel=0.0, local=k) for k in (6, 2)]
    rows = [sorted((r.image_id, r.it, tuple(r.m), tuple(r.losses)) for r in df.collect()) for df in after]
    assert rows[0] == rows[1] and len(rows[0]) == 3
    assert after[1].rdd.getNumPartitions() == after[0].rdd.getNumPartitions()


def test_rotated_grids_move_no_pixels(spark, sf_dir, monkeypatch):
    """Rotated, coarser and finer grids, beyond the image too, and one that can't be inverted; nulls, gaps and nameless bands: the same as a join by weights, whole or over tiles' edges."""
    from pixelloom.operators import stencil, tiles

    plan = planned(registry.QUERIES["f18_resample_rotated"](spark, sf_dir))
    assert not any("ty#" in line and "y#" in line.replace("ty#", "") for line in plan.splitlines() if "Exchange" in line)

    rng = np.random.default_rng(11)
    rows = [(i, b, y - 3, x, None if (y, x) == (4, 5) else float("nan") if (i, y, x) == (1, 20, 20) else float(rng.normal())) for i in (1, 2, 3, 4) for b, ny, nx in (("g", 26, 23), (None, 6, 9)) for y in range(ny) for x in range(nx) if (y * x) % 11 != 7] + [(1, "g", 30, 17, None), (1, "g", 44, 41, 2.0)]
    df = spark.createDataFrame(rows, "image_id long, band string, y int, x int, value double")
    maps = [(1, 40, 45, 0.8, -0.6, 0.6, 0.8, 3.5, -8.25), (2, 7, 9, 3.0, 1.0, -1.0, 3.0, -4.0, 3.0), (3, 30, 31, 0.25, 0.1, -0.1, 0.25, -1.0, 5.0), (4, 9, 9, 1.0, 1.0, 1.0, 1.0, 0.5, 0.25), (9, 3, 3, 1.0, 0.0, 0.0, 1.0, 0.0, 0.0)]
    mapping = spark.createDataFrame(maps, "image_id long, ny int, nx int, m_yy double, m_yx double, m_xy double, m_xx double, m_y0 double, m_x0 double")

    def found(made):
        rows = made.collect()
        out = {(r.image_id, r.band, r.y, r.x): r.value for r in rows}
        assert len(out) == len(rows)
        return out

    want = found(stencil.resampled(df, stencil.resample_weights(mapping)))
    assert any(v is None for v in want.values()) and {k[:2] for k in want} == {(i, b) for i in (1, 2, 3, 4) for b in ("g", None)}
    for _ in range(2):
        made = found(stencil.resample(df, mapping, aligned=False))
        assert made.keys() == want.keys()
        for at, v in made.items():
            assert want[at] is None if v is None else np.isclose(v, want[at], rtol=1e-9, atol=1e-9, equal_nan=True)
        monkeypatch.setattr(tiles, "SIDE", 16)
        monkeypatch.setattr(tiles, "LEAD", 4)


@pytest.mark.parametrize("name", ["l2_grad_sed", "l2_grad_morph", "l1_likelihood_gradient", "i4_source_model"])
def test_exploded_shapes_are_never_broadcast(spark, sf_dir, name):
    """A catalogue may be sent to all executors by way of the driver, but not the pixels that it is exploded to."""
    lines = planned(registry.QUERIES[name](spark, sf_dir)).splitlines()
    for n, line in enumerate(lines):
        if "BroadcastExchange" in line:
            depth = line.index("BroadcastExchange")
            below = next((i for i, other in enumerate(lines[n + 1 :]) if len(other) - len(other.lstrip(" :+-")) <= depth), len(lines))
            assert not any("Generate" in other and "source_id" in other for other in lines[n + 1 : n + 1 + below])


def test_pairs_of_components_meet_tiles(spark):
    """Over tiles' edges, beyond the image and its components, with nulls and gaps: the sums of a join by the rendered pixel, of which none is shuffled."""
    from pixelloom.operators import fit, stencil

    rng = np.random.default_rng(12)
    pixels = spark.createDataFrame([(0, b, y - 4, x, None if (y, x) == (9, 9) else float(rng.normal())) for b in "gr" for y in range(24) for x in range(21) if (y, x) != (12, 12)], "image_id long, band string, y int, x int, value double")
    kernel = spark.createDataFrame([(0, b, dy, dx, float(rng.random())) for b in "gr" for dy in (-1, 0, 1) for dx in (-2, 0, 2)], "image_id long, band string, dy int, dx int, k double")
    morphs = spark.createDataFrame([(0, s, c, y0 + y, x0 + x, float(rng.random())) for s, y0, x0, n in ((1, -6, 2, 9), (2, 5, 8, 12), (3, 14, 17, 7)) for c in (0, 1) if (s, c) != (3, 1) for y in range(n) for x in range(n) if y or x], "image_id long, source_id long, comp_id int, y int, x int, m double")
    bands = spark.createDataFrame([(0, "g"), (0, "r")], "image_id long, band string")
    shown = stencil.convolve(morphs.join(bands, "image_id").withColumnRenamed("m", "value"), kernel, keys=("image_id", "source_id", "comp_id", "band")).toPandas()
    both = shown.pivot_table("value", ["source_id", "band", "y", "x"], "comp_id", "sum", fill_value=0.0).reset_index().merge(pixels.toPandas(), on=["band", "y", "x"])
    u, v, d = both[0], both[1], both["value"].fillna(0.0)
    want = both[["source_id", "band"]].assign(uu=u * u, uv=u * v, vv=v * v, ud=u * d, vd=v * d).groupby(["source_id", "band"]).sum()
    for tile in (256, 8):
        made = fit.pair_sums(pixels, morphs, kernel, tile).drop("image_id").toPandas().groupby(["source_id", "band"]).sum()
        assert list(made.index) == list(want.index) and np.allclose(made, want, rtol=1e-9, atol=1e-12)
    exchanges = [line for line in planned(fit.pair_seds(pixels, morphs, kernel)).splitlines() if "Exchange" in line]
    assert exchanges and not any("comp_id" in line and "band" in line and " y#" in line for line in exchanges)
