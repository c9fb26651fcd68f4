"""Approximate nearest neighbours: a hierarchical k-means tree, searched best bin first, with calibrated leaf visits.

The tree is fitted on a bounded sample; every row is indexed under one leaf. The rows of neighbouring leaves lie in units of
bounded size (a leaf of very many rows spans several). A query pops the tree's nodes from a priority queue, best first, and
so ranks the leaves; how many of them it visits is widened until sample queries find enough of their true neighbours.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pixelloom.llm.common import cut

SAMPLE = 8192  # rows that the tree is fitted on, at most
SAMPLE_BYTES = 32 << 20  # and their components as doubles
BRANCH = 8  # children of a node
LEAF = 32  # sample rows of a leaf, at most
UNIT_ROWS = 8192  # rows of a unit, at most
UNITS, LEAST_ROWS = 16, 512  # smaller units, down to so many rows, where there are fewer than so many
UNIT_BYTES = 8 << 20
ASKED = 512  # queries that meet a unit at once


def usable(df: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """vec_id and ``v`` (doubles) of the vectors that take part: not null or zero, no null or non-finite component, with an id."""
    finite = lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf")))
    x = df.where(F.col(embedding).isNotNull() & F.col(vec_id).isNotNull()).select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("v"))
    return x.where(F.forall("v", finite) & F.exists("v", lambda e: e != 0))


@dataclass
class Tree:
    """Nodes' centres and children; a node without children is a leaf with a number of its own."""

    centers: np.ndarray
    children: list[list[int]] = field(default_factory=list)
    leaf: list[int] = field(default_factory=list)

    def assign(self, rows: np.ndarray) -> np.ndarray:
        """The leaf of every row: down the tree, to the nearest centre at each node."""
        out, stack = np.zeros(len(rows), np.int32), [(0, np.arange(len(rows)))]
        while stack:
            node, own = stack.pop()
            if not self.children[node]:
                out[own] = self.leaf[node]
                continue
            near = nearest(rows[own], self.centers[self.children[node]])
            stack += [(child, own[near == i]) for i, child in enumerate(self.children[node]) if (near == i).any()]
        return out

    def ranked(self, query: np.ndarray, visits: int, counts: dict[int, int], enough: int) -> list[int]:
        """The leaves in the order in which a best-bin-first search comes to them: ``visits`` of them, and more until they hold ``enough`` rows."""
        score = self.centers @ query
        queue, found, held = [(-np.inf, 0)], [], 0
        while queue and (len(found) < visits or held < enough):
            _, node = heapq.heappop(queue)
            if self.children[node]:
                for child in self.children[node]:
                    heapq.heappush(queue, (-score[child], child))
            elif counts.get(self.leaf[node]):
                found.append(self.leaf[node])
                held += counts[self.leaf[node]]
        return found


def nearest(rows: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """Each row's nearest centre (squared Euclidean distance)."""
    return ((centers**2).sum(axis=1)[None, :] - 2 * (rows @ centers.T)).argmin(axis=1)


def grow(sample: np.ndarray, first_leaf: int, branch: int = BRANCH, leaf_rows: int = LEAF, rounds: int = 8) -> Tree:
    """A tree over ``sample``: k-means at each node, down to ``leaf_rows``; leaves are numbered from ``first_leaf``."""
    centers, children, leaf = [sample.mean(axis=0) if len(sample) else np.zeros(sample.shape[1])], [[]], [-1]
    stack, number, rng = [(0, sample)], first_leaf, np.random.default_rng(0)
    while stack:
        node, own = stack.pop()
        parts = []
        if len(own) > leaf_rows:
            middle = own[rng.choice(len(own), min(branch, len(own)), replace=False)]
            for _ in range(rounds):
                near = nearest(own, middle)
                middle = np.array([own[near == i].mean(axis=0) for i in range(len(middle)) if (near == i).any()])
            near = nearest(own, middle)
            parts = [own[near == i] for i in range(len(middle)) if (near == i).any()]
        if len(parts) < 2:
            leaf[node] = number
            number += 1
            continue
        for part in parts:
            children[node].append(len(centers))
            stack.append((len(centers), part))
            centers.append(part.mean(axis=0))
            children.append([])
            leaf.append(-1)
    return Tree(np.array(centers), children, leaf)


def fit_trees(vectors: DataFrame, sample_rows: int = SAMPLE, branch: int = BRANCH, leaf_rows: int = LEAF) -> dict[int, Tree]:
    """A tree for each width of vector in a sample of at most ``sample_rows`` rows (and 32 MB of components), taken by a hash of the id."""
    widest = vectors.agg(F.max(F.size("v"))).first()[0] or 1
    rows = min(sample_rows, max(1, SAMPLE_BYTES // (8 * widest)))
    sample = vectors.orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(rows).toArrow()  # bounded by the two parameters
    by: dict[int, list[list[float]]] = {}
    for v in sample.column("v"):
        by.setdefault(len(v), []).append(v.values.to_numpy())
    trees, leaves = {}, 1  # leaf 0 holds vectors of widths that the sample lacks
    for width, own in sorted(by.items()):
        trees[width] = grow(np.array(own), leaves, branch, leaf_rows)
        leaves = max(trees[width].leaf) + 1
    return trees


def matrices(batch: pa.RecordBatch, column: str) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(width, row numbers, matrix) for every width among a batch's vectors."""
    lists = batch.column(column)
    widths = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    at = np.cumsum(widths) - widths
    for width in np.unique(widths).tolist():
        own = np.flatnonzero(widths == width)
        yield width, own, flat[at[own][:, None] + np.arange(width)[None, :]]


def shared_out(counts: dict[int, int], widths: dict[int, int], unit_rows: int) -> list[tuple[int, int, int]]:
    """(leaf, first, parts): neighbouring leaves share a part of at most ``unit_rows`` rows, a larger leaf is dealt over ``parts`` of its own.

    The parts follow from the rows alone, however many tasks there are: each unit that a query visits answers for itself. Few rows still give ``UNITS`` parts.
    """
    rows = min(unit_rows, max(LEAST_ROWS, sum(counts.values()) // UNITS))
    out, first, held, wide = [], 0, 0, None
    for leaf, n in sorted((leaf, n) for leaf, n in counts.items() if leaf):
        most = max(1, min(rows, UNIT_BYTES // (8 * widths[leaf])))
        if held and (widths[leaf] != wide or held + n > most):
            first, held = first + 1, 0
        parts = -(-n // max(1, 3 * most // 4)) if n > most else 1  # dealt by a hash, so with room
        out.append((leaf, first, parts))
        first, held, wide = (first + parts, 0, None) if parts > 1 else (first, held + n, widths[leaf])
    return out


def units(vectors: DataFrame, trees: dict[int, Tree], unit_rows: int = UNIT_ROWS) -> DataFrame:
    """Every row in a unit: unit, width, leaves and counts (the unit's leaves), of (each row's leaf), ids, data (float32 where that loses nothing)."""

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for width, own, matrix in matrices(batch, "v"):
                leaf = trees[width].assign(matrix) if width in trees else np.zeros(len(own), np.int32)
                part = batch.take(pa.array(own))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), width, np.int32)), pa.array(leaf), *part.columns], names=["width", "leaf", "vec_id", "v"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, leaf, parts, held = (None, -1), [], [], [], 0

        def made() -> pa.RecordBatch:
            matrix, of = np.concatenate(parts), np.concatenate(leaf)
            small = matrix.astype(np.float32)
            data = small.tobytes() if np.array_equal(small, matrix) else matrix.tobytes()
            own, count = np.unique(of, return_counts=True)
            kinds = [pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary()]
            values = [now[1], own.tolist(), count.tolist(), of.astype(np.int32).tobytes(), np.concatenate(ids).tobytes(), data]
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(values, kinds, strict=True)], names=["width", "leaves", "counts", "of", "ids", "data"])

        for batch in batches:
            part_of = batch.column("part").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(part_of)) + 1).tolist(), len(part_of)]
            for at, to in zip(cuts, cuts[1:], strict=False):
                piece = batch.slice(at, to - at)
                for wide, own, matrix in matrices(piece, "v"):
                    most = max(1, min(unit_rows, UNIT_BYTES // (8 * wide)))
                    own_ids, own_leaf = piece.column("vec_id").to_numpy()[own], piece.column("leaf").to_numpy()[own]
                    for low in range(0, len(own), most):
                        part = slice(low, low + most)
                        if held and ((part_of[at], wide) != now or held + len(own[part]) > most):
                            yield made()
                            ids, leaf, parts, held = [], [], [], 0
                        now = (part_of[at], wide)
                        ids.append(own_ids[part])
                        leaf.append(own_leaf[part])
                        parts.append(matrix[part])
                        held += len(own[part])
        if held:
            yield made()

    placed = vectors.select("vec_id", "v").mapInArrow(assign, "width int, leaf int, vec_id long, v array<double>")
    counts = {r.leaf: r.n for r in placed.groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).collect()}  # as many as the trees have leaves
    widths = {leaf: width for width, tree in trees.items() for leaf in tree.leaf if leaf > 0}
    shares = vectors.sparkSession.createDataFrame(shared_out(counts, widths, unit_rows), "leaf int, first long, parts long")
    # Vectors in leaf 0 are dealt width by width.
    rest = -(-counts.get(0, 0) // max(1, 3 * unit_rows // 4)) or 1
    dealt = lambda n: F.pmod(F.xxhash64("vec_id", F.lit(2)), n)
    part = F.when(F.col("leaf") > 0, F.col("first") + dealt(F.col("parts"))).otherwise(-1 - F.col("width").cast("long") * rest - dealt(F.lit(rest)))
    keyed = placed.join(F.broadcast(shares), "leaf", "left").select("width", "leaf", "vec_id", "v", part.alias("part"))
    packed = keyed.repartition("part").sortWithinPartitions("part", "width", "leaf").mapInArrow(pack, "width int, leaves array<int>, counts array<long>, of binary, ids binary, data binary")
    return cut(packed.withColumn("unit", F.monotonically_increasing_id()))


def unpacked(width: int, of: pa.Scalar, ids: pa.Scalar, data: pa.Scalar) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A unit's leaves, ids and vectors (doubles)."""
    ids, data = np.frombuffer(ids.as_buffer(), np.int64), data.as_buffer()
    kind = np.float64 if data.size == 8 * width * len(ids) else np.float32
    return np.frombuffer(of.as_buffer(), np.int32), ids, np.frombuffer(data, kind).reshape(len(ids), width).astype(np.float64)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products row by row, added up from the first component to the last, so that equal vectors have equal scores."""
    total = np.zeros(len(a))
    for x, y in zip(a.T, b.T, strict=True):
        total += x * y
    return total


def unit_top(queries: np.ndarray, query_ids: np.ndarray, seen: np.ndarray, bound: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, vector row, score) of each query's ``k`` best among the rows it has ``seen`` and whose score reaches its ``bound``.

    A matrix product picks rows with room for its rounding; their scores are then added up in order.
    """
    rough = queries @ vectors.T
    # Two orders of adding d products differ by at most 2 d rounding errors of |q| |v|.
    room = 2 * queries.shape[1] * 2.0**-52 * np.sqrt((queries**2).sum(axis=1) * (vectors**2).sum(axis=1).max(initial=0)) + 1e-300
    rough[~seen | (query_ids[:, None] == ids[None, :])] = -np.inf
    floor = np.partition(rough, len(ids) - k, axis=1)[:, len(ids) - k] if len(ids) > k else np.full(len(queries), -np.inf)
    rows, cols = np.nonzero((rough >= np.maximum(floor - room, bound - room)[:, None]) & (rough > -np.inf))
    score = products(queries[rows], vectors[cols])
    by = np.lexsort((ids[cols], -score, rows))
    rows, cols, score = rows[by], cols[by], score[by]
    keep = (np.arange(len(rows)) - np.searchsorted(rows, rows) < k) & (score >= bound[rows])
    return rows[keep], cols[keep], score[keep]


def true_ranks(held: DataFrame, trees: dict[int, Tree], counts: dict[int, int], asked: list[tuple[int, np.ndarray]], k: int) -> list[tuple[int, int]]:
    """(neighbours of one leaf visit, visit) pairs of sample queries: when the search comes to each of their true ``k`` nearest, by a whole scan."""
    by: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
    for width in {len(v) for _, v in asked}:
        own = [i for i, (_, v) in enumerate(asked) if len(v) == width]
        by[width] = np.array(own), np.array([asked[i][0] for i in own], np.int64), np.array([asked[i][1] for i in own])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for width, of, ids, data in zip(*batch.columns, strict=True):
                if width.as_py() in by:
                    number, query_ids, queries = by[width.as_py()]
                    of, ids, vectors = unpacked(width.as_py(), of, ids, data)
                    rows, cols, score = unit_top(queries, query_ids, np.ones((len(queries), len(ids)), bool), np.full(len(queries), -np.inf), ids, vectors, k)
                    yield pa.RecordBatch.from_arrays([pa.array(number[rows]), pa.array(ids[cols]), pa.array(score), pa.array(of[cols])], names=["number", "vec_id", "score", "leaf"])

    order = Window.partitionBy("number").orderBy(F.desc("score"), "vec_id")
    near = held.select("width", "of", "ids", "data").mapInArrow(scan, "number long, vec_id long, score double, leaf int")
    best = near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).groupBy("number", "leaf").count().collect()  # k rows a sample query at most
    order_of = {i: {leaf: n for n, leaf in enumerate(trees[len(v)].ranked(v, 1 << 30, counts, 0), 1)} for i, (_, v) in enumerate(asked) if len(v) in trees}
    return [(r["count"], order_of[r.number][r.leaf]) for r in best if r.number in order_of]


def widened(found: list[tuple[int, int]], recall: float) -> int:
    """The least number of leaf visits that reaches ``recall`` of all true neighbours, widened one by one."""
    total, visits = sum(n for n, _ in found), 1
    while sum(n for n, at in found if at <= visits) < recall * total:
        visits += 1
    return visits


def foremost(vectors: DataFrame, k: int) -> DataFrame:
    """Of equal vectors the rows of the ``k`` + 1 least ids.

    Equal vectors have equal scores and ties go to the smaller id, so a row behind k + 1 ids of its own vector is behind
    k rows with other ids than the query's, whatever the query: it can't be among the ``k`` nearest.
    """
    copy = F.dense_rank().over(Window.partitionBy("v").orderBy("vec_id"))
    return vectors.select("vec_id", "v").withColumn("copy", copy).where(F.col("copy") <= k + 1).drop("copy")


def neighbours(queries: DataFrame, vectors: DataFrame, k: int = 20, recall: float = 0.96, calibrate: int = 256, sample_rows: int = SAMPLE, branch: int = BRANCH, leaf_rows: int = LEAF, unit_rows: int = UNIT_ROWS) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's ``k`` nearest found, by the largest inner product.

    Both inputs are ``usable`` tables. The number of leaf visits is the least at which ``calibrate`` queries (taken by a hash of their ids) find
    ``recall`` of their true neighbours, which one whole scan tells. A query's search widens in three rounds: the leaves that hold a few times ``k`` rows, an
    eighth of the visits, all visits; each passes on its k-th score as a bound, and the next returns only what reaches it. A
    query that still has fewer than ``k`` searches all leaves, so it gets all candidates where there are fewer. A vector of a width that the tree's sample lacks is searched exactly. Only vectors of the query's width are candidates, none with its id; repeated rows
    are all candidates, of equal vectors those that can be near (``foremost``); an id is asked once, with its least vector; ties go to the smaller id; other columns are dropped, empty tables give an empty result.
    Rows and units are read again where an executor is lost.
    """
    queries = cut(queries.groupBy("vec_id").agg(F.min("v").alias("v")))
    # A large group of copies would fill many units, and each would answer with k of them.
    vectors = cut(foremost(vectors, k))
    trees = fit_trees(vectors, sample_rows, branch, leaf_rows)
    held = units(vectors, trees, unit_rows)
    where = cut(held.select("unit", F.explode(F.arrays_zip("leaves", "counts")).alias("l")).select("unit", F.col("l.leaves").alias("leaf"), F.col("l.counts").alias("n")))
    counts = {r.leaf: r.n for r in where.groupBy("leaf").agg(F.sum("n").alias("n")).collect()}  # as many as the tree has leaves
    asked = [(r.vec_id, np.array(r.v)) for r in queries.orderBy(F.xxhash64("vec_id", F.lit(1)), "vec_id").limit(calibrate).collect()]
    visits = widened(true_ranks(held, trees, counts, asked, k), recall)
    enough = 4 * k + 1

    def plan(low: int, high: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                leaves = []
                for v in batch.column("v"):
                    tree = trees.get(len(v))
                    v = v.values.to_numpy()
                    before = len(tree.ranked(v, low, counts, enough)) if tree and low else low
                    leaves.append((tree.ranked(v, high, counts, enough) if tree else [0])[before:])
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(leaves, pa.list_(pa.int32()))], names=["query_id", "leaves"])

        return run

    def visited(bounded: DataFrame, low: int, high: int) -> DataFrame:
        """Candidates of the leaves after the ``low``-th up to the ``high``-th of each query (either goes on until they hold ``enough`` rows), at or above its bound."""
        order = bounded.select("vec_id", "v").mapInArrow(plan(low, high), "query_id long, leaves array<int>")
        met = order.select("query_id", F.explode("leaves").alias("leaf")).join(where, "leaf").groupBy("query_id", "unit").agg(F.collect_list("leaf").alias("leaves"))
        sent = met.join(bounded.withColumnRenamed("vec_id", "query_id"), "query_id")
        none = lambda kind, name: F.lit(None).cast(kind).alias(name)
        rows = held.select("unit", F.lit(0).alias("kind"), "width", none("array<int>", "leaves"), "of", "ids", "data", none("long", "query_id"), none("array<double>", "v"), none("double", "bound"))
        rows = rows.unionByName(sent.select("unit", F.lit(1).alias("kind"), F.size("v").alias("width"), "leaves", none("binary", "of"), none("binary", "ids"), none("binary", "data"), "query_id", "v", "bound"))
        return rows.repartition("unit").sortWithinPartitions("unit", "kind").mapInArrow(answer, "query_id long, vec_id long, score double")

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: tuple | None = None
        for batch in batches:
            unit, kind, low = batch.column("unit").to_numpy(), batch.column("kind").to_numpy(), 0
            while low < len(unit):
                if kind[low] == 0:
                    now = unpacked(batch.column("width")[low].as_py(), *(batch.column(c)[low] for c in ("of", "ids", "data")))
                    low += 1
                    continue
                high = low + 1
                while high < len(unit) and high - low < ASKED and kind[high] == 1 and unit[high] == unit[low]:
                    high += 1
                part, (of, ids, vectors) = batch.slice(low, high - low), now
                matrix = part.column("v").flatten().to_numpy(zero_copy_only=False).reshape(high - low, -1)
                own, place = np.unique(of, return_inverse=True)
                asks = np.zeros((high - low, len(own)), bool)
                lists = part.column("leaves")
                asks[np.repeat(np.arange(high - low), np.diff(lists.offsets.to_numpy())), np.searchsorted(own, lists.flatten().to_numpy(zero_copy_only=False))] = True
                query_ids = part.column("query_id").to_numpy(zero_copy_only=False).astype(np.int64)
                bound = part.column("bound").fill_null(-np.inf).to_numpy(zero_copy_only=False)
                rows, cols, score = unit_top(matrix, query_ids, asks[:, place], bound, ids, vectors, k)
                yield pa.RecordBatch.from_arrays([pa.array(query_ids[rows]), pa.array(ids[cols]), pa.array(score)], names=["query_id", "vec_id", "score"])
                low = high

    def top(found: DataFrame) -> DataFrame:
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    near = cut(top(visited(queries.withColumn("bound", F.lit(None).cast("double")), 0, 1)))
    done = 1
    for limit in sorted({-(-visits // 8), visits} - {1}):
        bounds = near.where(F.col("rank") == k).select("query_id", F.col("score").alias("bound"))
        bounded = queries.join(bounds.withColumnRenamed("query_id", "vec_id"), "vec_id", "left")
        near = cut(top(near.drop("rank").unionByName(visited(bounded, done, limit))))
        done = limit
    few = near.groupBy("query_id").count().where(F.col("count") >= k).select(F.col("query_id").alias("vec_id"))
    short = cut(queries.join(few, "vec_id", "left_anti"))
    if short.isEmpty():
        return near.select("query_id", "rank", "vec_id", "score")
    whole = top(visited(short.withColumn("bound", F.lit(None).cast("double")), 0, 1 << 30))
    near = near.join(few.withColumnRenamed("vec_id", "query_id"), "query_id", "left_semi")
    return near.select("query_id", "rank", "vec_id", "score").unionByName(whole.select("query_id", "rank", "vec_id", "score"))

