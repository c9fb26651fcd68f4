"""The prefix trie, the clustering and the nearest neighbours: brute force, chunk boundaries, the odd rows."""

import hashlib
import random
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelloom.llm import clusters, kmeans_tree, trie
from pixelloom.llm.common import table
from pixelloom.llm.queries import ORACLE_SQL, QUERIES

# --- prefix trie


def brute_rebuilt(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    for turns in own.values():
        turns.sort()
    turns = {c: [t[2:] for t in v] for c, v in own.items()}
    out = {}
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = turns.get(c - int(np.fmod(c, 5)), [])[:h] + turns[c][h:]
    return out


def brute_trie(convs):
    nodes = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    out = set()
    for name, members in nodes.items():
        below = [n for n in nodes if n[: len(name)] == name]
        kids = {n for n in below if len(n) == len(name) + 1}
        leaves = sum(not any(len(m) == len(n) + 1 and m[: len(n)] == n for m in below) for n in below)
        saved = sum((len(nodes[n]) - 1) * len(n[-1][1].encode()) for n in below if n)
        ends = ",".join(str(c) for c in sorted(members) if len(convs[c]) == len(name))
        parent = min(nodes[name[:-1]]) if name else None
        out.add((min(members), len(name), parent, len(members), len(kids), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return out


def made_up_turns(seed, n):
    rng = random.Random(seed)
    rows = []
    for c in [*range(-6, n), 10**12, 10**12 + 3]:
        for turn in range(rng.choice([1, 1, 2, 3, 9, 14])):
            rows.append((c, None if turn == 0 and rng.random() < 0.1 else turn, rng.choice(["user", None]), rng.choice(["a", "é", "", None, "long text " * 3])))
    return rows + [(None, 1, "user", "no id")]


@pytest.mark.parametrize(("seed", "limits"), [(0, {}), (1, {"chunk_rows": 3}), (2, {"chunk_rows": 2, "last_bytes": 600}), (3, {"chunk_bytes": 100, "last_bytes": 900})])
def test_trie_against_brute_force(spark, seed, limits):
    rows = made_up_turns(seed, 90)
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").withColumn("path", F.lit("clash"))
    found = trie.prefix_trie(trie.sequences(trie.rebuilt(df)), **limits).collect()
    want = brute_trie(brute_rebuilt(rows))
    assert len(found) == len(want) and {tuple(r) for r in found} == want


def test_trie_of_copies_spread_over_chunks(spark):
    rows = [(c, t, "user", "same") for c in range(60) for t in range(3)] + [(c, 0, "user", "same") for c in range(100, 140)]
    df = trie.sequences(trie.marked(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")))
    found = {r.depth: r for r in trie.prefix_trie(df, chunk_rows=7, last_bytes=700).collect()}
    digest = lambda ids: hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    assert sorted(found) == [0, 1, 2, 3] and [found[d].n_convs for d in range(4)] == [100, 100, 60, 60]
    assert found[3].ends_sha256 == digest(range(60)) and found[1].ends_sha256 == digest(range(100, 140)) and found[2].ends_sha256 == digest([])
    assert found[1].saved_tokens == 99 * 4 + 59 * 4 * 2 and found[0].n_leaves == 1


def test_trie_of_odd_tables(spark):
    schema = "conv_id long, turn int, role string, text string"
    assert trie.prefix_trie(trie.sequences(trie.rebuilt(spark.createDataFrame([], schema)))).count() == 0
    assert trie.prefix_trie(trie.sequences(trie.rebuilt(spark.createDataFrame([(None, 1, "user", "x")], schema)))).count() == 0
    deep = [(1, t, "user", "x" * (t % 3)) for t in range(3000)]
    rows = trie.prefix_trie(trie.sequences(trie.rebuilt(spark.createDataFrame(deep, schema)))).collect()
    assert len(rows) == 3001 - min(3000, zlib.crc32(b"1") % 9) and all(r.n_convs == 1 and r.n_leaves == 1 and r.saved_tokens == 0 for r in rows)


# --- clustering


def brute_clusters(vectors, k, rounds):
    order = sorted(range(len(vectors)), key=lambda i: (hashlib.sha256(f"2:{vectors[i][0]}".encode()).hexdigest(), vectors[i][1]))
    q = [v for _, v in vectors]
    centroids = [list(q[i]) for i in order[:k]]
    for step in range(rounds + 1):
        near = [min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(centroids)) for v in q]
        if step < rounds:
            for j in range(len(centroids)):
                own = [v for v, (_, at) in zip(q, near, strict=True) if at == j]
                if own:
                    centroids[j] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    total = sum(d for d, _ in near)
    per = [sum(d for d, at in near if at == j) for j in range(len(centroids))]
    return sorted((i, at, d, per[at], total, hashlib.sha256(",".join(map(str, centroids[at])).encode()).hexdigest()) for (i, _), (d, at) in zip(vectors, near, strict=True))


@pytest.mark.parametrize(("block", "page"), [(2, 1 << 16), (1, 7), (4, 50), (5, 16)])
def test_clusters_against_brute_force(spark, block, page):
    rng = random.Random(block)
    raw = [(i // 2 if i > 150 else i, [rng.gauss(0, 0.02 if i % 3 else 0.3) for _ in range(6)]) for i in range(200)]
    raw += [(500 + i, [0.1, -0.2, 0.3, 1e5, -1e5, 0.0]) for i in range(30)]  # copies
    odd = [(900, None), (901, [1.0] * 5), (902, [None] + [1.0] * 5), (903, [float("nan")] * 6), (904, [float("inf")] * 6), (905, [1.0] * 7), (906, [])]
    df = spark.createDataFrame([(i, v, 0) for i, v in raw + odd], "vec_id long, embedding array<double>, cluster int").repartition(5)
    found = clusters.cluster(clusters.whole_vectors(df, width=6), k=9, rounds=3, width=6, block=block, page_rows=page).collect()
    want = brute_clusters([(i, [int(np.floor(256 * x)) for x in v]) for i, v in raw], 9, 3)
    assert sorted(map(tuple, found)) == want


def test_clusters_of_odd_tables(spark):
    schema = "vec_id long, embedding array<float>"
    assert clusters.cluster(clusters.whole_vectors(spark.createDataFrame([], schema))).count() == 0
    few = spark.createDataFrame([(1, [0.5] * 64), (2, [0.25] * 64), (None, [0.25] * 64)], schema)
    assert sorted((r.vec_id or 0, r.distance) for r in clusters.cluster(clusters.whole_vectors(few)).collect()) == [(0, 0), (1, 0), (2, 0)]
    wide = spark.createDataFrame([(1, [1e6] * 64)], schema)
    with pytest.raises(Exception, match="too large"):
        clusters.cluster(clusters.whole_vectors(wide)).collect()


def test_pages_lose_nothing():
    rng = np.random.default_rng(3)
    matrix = rng.integers(-5, 5, (500, 7)) * rng.choice([1, 1 << 26], 7)
    subvectors, codes = clusters.encoded(matrix, 2)
    assert np.array_equal(np.concatenate([s[c] for s, c in zip(subvectors, codes, strict=True)], axis=1), matrix)
    assert all(len(np.unique(s, axis=0)) == len(s) for s in subvectors)


# --- nearest neighbours


def brute_near(raw, k, every):
    usable = [(i, np.array(v, float)) for i, v in raw if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for q in sorted({i for i, _ in usable if i % every == 0}):
        own = min(v.tolist() for i, v in usable if i == q)
        scored = []
        for i, v in usable:
            if i != q and len(v) == len(own):
                total = 0.0
                for a, b in zip(own, v.tolist(), strict=True):
                    total += a * b
                scored.append((-total, i))
        out[q] = [(i, -s) for s, i in sorted(scored)[:k]]
    return out


def made_up_vectors():
    rng = np.random.default_rng(5)
    middle = rng.normal(size=(12, 8))
    raw = [(i, (middle[i % 12] + 0.3 * rng.normal(size=8)).tolist()) for i in range(600)]
    raw += [(1000 + i, raw[7][1]) for i in range(80)]  # copies, and ties
    raw += [(2000 + i, rng.normal(size=3).tolist()) for i in range(15)]  # another width
    raw += [(7, raw[3][1]), (20, raw[5][1])]  # repeated ids
    return raw + [(3000, None), (3020, [0.0] * 8), (3040, [None] * 8), (3060, [float("inf")] * 8), (3080, []), (None, [1.0] * 8)]


def test_neighbours_recall_and_scores(spark):
    raw = made_up_vectors()
    df = spark.createDataFrame([(i, v, 1.0) for i, v in raw], "vec_id long, embedding array<double>, score double")
    vectors = kmeans_tree.usable(df)
    found = {}
    for r in kmeans_tree.neighbours(vectors.where("vec_id % 20 = 0"), vectors, k=10, leaf_rows=8, unit_rows=50).collect():
        found.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    want = brute_near(raw, 10, 20)
    assert set(found) == set(want)
    hit = 0
    for q, rows in found.items():
        assert [r[0] for r in sorted(rows)] == list(range(1, len(want[q]) + 1))
        assert [(-s, i) for _, i, s in sorted(rows)] == sorted((-s, i) for _, i, s in rows)
        hit += len({i for _, i, _ in rows} & {i for i, _ in want[q]})
    assert hit >= 0.9 * sum(map(len, want.values()))


def test_neighbours_are_exact_where_all_leaves_are_visited(spark):
    raw = made_up_vectors()
    vectors = kmeans_tree.usable(spark.createDataFrame(raw, "vec_id long, embedding array<double>"))
    for sample in (300, 4):
        found = {}
        for r in kmeans_tree.neighbours(vectors.where("vec_id % 20 = 0"), vectors, k=10, recall=1.0, calibrate=10_000, sample_rows=sample, leaf_rows=8, unit_rows=64).orderBy("query_id", "rank").collect():
            found.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert found == brute_near(raw, 10, 20)


def test_neighbours_of_few_rows(spark):
    schema = "vec_id long, embedding array<double>"
    none = kmeans_tree.usable(spark.createDataFrame([], schema))
    assert kmeans_tree.neighbours(none, none).count() == 0
    one = kmeans_tree.usable(spark.createDataFrame([(0, [1.0, 2.0])], schema))
    assert kmeans_tree.neighbours(one, one).count() == 0
    few = kmeans_tree.usable(spark.createDataFrame([(0, [1.0, 2.0]), (3, [1.0, 0.0]), (2, [1.0, 0.0])], schema))
    rows = kmeans_tree.neighbours(few.where("vec_id = 0"), few).orderBy("rank").collect()
    assert [tuple(r) for r in rows] == [(0, 1, 2, 1.0), (0, 2, 3, 1.0)]


@pytest.mark.parametrize("name", ["op11_prefix_trie", "op12_centroid_clusters"])
def test_same_rows_as_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("conversations", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    found = con.execute(ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    df = QUERIES[name](spark, sf_dir)
    assert sorted(names) == sorted(df.columns)
    assert sorted(repr(tuple(r)) for r in df.select(*names).collect()) == sorted(repr(r) for r in found.fetchall())


def test_registered_neighbours(spark, sf_dir):
    rows = [(r.vec_id, r.embedding) for r in table(spark, sf_dir, "embeddings").collect()]
    want, found = brute_near(rows, 20, 20), {}
    for r in QUERIES["op13_kmeans_tree"](spark, sf_dir).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    assert sum(len(found[q] & {i for i, _ in w}) for q, w in want.items()) >= 0.9 * sum(map(len, want.values()))


def test_large_group_of_equal_vectors(spark):
    """Copies that can't be among the nearest take no room in the index; what is found is what a whole scan finds."""
    rng = np.random.default_rng(5)
    raw = [(i, [1.0, 2.0, 3.0] if i % 2 else rng.normal(size=3).round(2).tolist()) for i in range(600)] + [(1, [1.0, 2.0, 3.0])] * 3
    vectors = kmeans_tree.usable(spark.createDataFrame(raw, "vec_id long, embedding array<double>"))
    kept = [r.vec_id for r in kmeans_tree.foremost(vectors, 5).collect()]
    assert sorted(i for i in kept if i % 2) == [1, 1, 1, 1, 3, 5, 7, 9, 11] and sum(i % 2 == 0 for i in kept) == 300
    found = {}
    for r in kmeans_tree.neighbours(vectors.where("vec_id % 20 < 2"), vectors, k=5, recall=1.0, calibrate=1000, leaf_rows=8, unit_rows=20).orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append(r.vec_id)
    first = dict(raw)
    for q in (i for i in range(600) if i % 20 < 2):
        near = sorted((-sum(a * b for a, b in zip(first[q], v, strict=True)), i) for i, v in raw if i != q)[:5]
        assert found[q] == [i for _, i in near]


def test_units_follow_the_rows_and_not_the_partitions(spark):
    """Each unit answers a query with its own best rows, so units that follow the number of partitions multiply the answers."""
    rng = np.random.default_rng(5)
    raw = [(i, rng.normal(size=4).tolist()) for i in range(3000)] + [(3000 + i, [1.0, 1.0, 1.0, 1.0 + i / 4096]) for i in range(1500)] + [(4500 + i, [1.0] * (5 + i % 3)) for i in range(9)]
    vectors = kmeans_tree.usable(spark.createDataFrame(raw, "vec_id long, embedding array<double>"))
    trees = kmeans_tree.fit_trees(vectors.where("size(v) = 4"))
    kept = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        spark.conf.set("spark.sql.shuffle.partitions", "48")
        held = kmeans_tree.units(vectors, trees).collect()
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    found = [i for r in held for i in np.frombuffer(r.ids, np.int64).tolist()]
    assert sorted(found) == list(range(4509))
    assert 8 <= len([r for r in held if r.width == 4]) <= 24 and len([r for r in held if r.width > 4]) == 3
    assert max(sum(r.counts) for r in held) <= kmeans_tree.UNIT_ROWS and len({r.unit for r in held}) == len(held)


def test_large_leaves_are_dealt_over_parts_of_their_own():
    shares = kmeans_tree.shared_out({0: 7, 1: 40, 2: 50, 3: 1000, 4: 30, 5: 30}, {1: 8, 2: 8, 3: 8, 4: 8, 5: 3}, 100)
    assert shares == [(1, 0, 1), (2, 0, 1), (3, 1, 14), (4, 15, 1), (5, 16, 1)]
