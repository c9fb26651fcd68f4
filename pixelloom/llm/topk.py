"""Exact top-k inner products by columnar branch-and-bound over vector blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pixelloom.llm.common import cut

STEP = 16  # dimensions of one vertical block
HOME = 64  # blocks that one task holds
WIDEST = 1 << 62  # components must stay below


def quantised(df: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", scale: int = 256) -> DataFrame:
    """vec_id and ``v``, the components as floor(scale * x); rows with a null vector, id or a null or non-finite component are left out.

    A finite component of 2**62 or more once scaled raises an error: it has no such integer.
    """
    finite = lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf")))
    whole = lambda e: F.when(F.abs(e * scale) < F.lit(float(WIDEST)), F.floor(e * scale)).otherwise(F.raise_error(F.lit("a vector's component is too large")).cast("long"))
    x = df.where(F.col(embedding).isNotNull() & F.col(vec_id).isNotNull()).select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("x"))
    return x.where(F.forall("x", finite)).select("vec_id", F.transform("x", whole).alias("v"))


def blocks(vectors: DataFrame, rows: int) -> DataFrame:
    """Pack vectors of one width into blocks: block id, width, ids, and the components dimension by dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[list, list]] = {}

        def made(width: int) -> pa.RecordBatch:
            ids, parts = held.pop(width)
            ids, matrix = np.concatenate(ids), np.concatenate(parts)
            if not matrix.size or max(matrix.max(), -matrix.min()) < 1 << 31:
                matrix = matrix.astype(np.int32)
            return pa.RecordBatch.from_arrays([pa.array([width], pa.int32()), pa.array([ids.astype(np.int64).tobytes()], pa.binary()), pa.array([np.ascontiguousarray(matrix.T).tobytes()], pa.binary())], names=["width", "ids", "data"])

        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            vectors = batch.column(1)
            widths = np.diff(vectors.offsets.to_numpy())
            flat, at = vectors.flatten().to_numpy(zero_copy_only=False), np.cumsum(widths) - widths
            for width in np.unique(widths).tolist():
                own = np.flatnonzero(widths == width)
                matrix = flat[at[own][:, None] + np.arange(width)[None, :]] if width else np.zeros((len(own), 0), np.int64)
                for low in range(0, len(own), rows):
                    entry = held.setdefault(width, ([], []))
                    entry[0].append(ids[own[low : low + rows]])
                    entry[1].append(matrix[low : low + rows])
                    if sum(map(len, entry[0])) >= rows:
                        yield made(width)
        for width in list(held):
            yield made(width)

    packed = vectors.select("vec_id", "v").mapInArrow(run, "width int, ids binary, data binary")
    return cut(packed.withColumn("block", F.monotonically_increasing_id()))


def unpacked(width: int, ids: bytes, data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """A block's ids and its components, dimension by dimension."""
    ids = np.frombuffer(ids, np.int64)
    return ids, np.frombuffer(data, np.int64 if len(data) == 8 * width * len(ids) and width else np.int32).reshape(width, len(ids))


def norms(data: np.ndarray) -> np.ndarray:
    """Euclidean norms of the columns."""
    return np.sqrt((data.astype(np.float64) ** 2).sum(axis=0))


def block_top(queries: np.ndarray, query_ids: np.ndarray, data: np.ndarray, ids: np.ndarray, k: int, best: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each query's k best of one block, as (query row, id, score) columns, but for pairs that stay below the query's ``best``.

    ``data`` lies dimension by dimension. Scores accumulate ``STEP`` dimensions at a time;
    what the rest can add is at most the product of the rests' norms. Pairs whose bound
    falls below the k-th best lower bound of their query, or below ``best`` (the k-th score that it has
    already), are compacted away, so later dimensions are read for survivors only. Equal scores survive, for the tie rule.
    Bounds allow for the rounding of floats; where sums of products may pass 2**53 the survivors are
    added up again as integers, and a score that is no 64-bit integer raises an error.
    """
    d, n = data.shape
    if best is None:
        best = np.full(len(queries), -np.inf)
    # The largest variation first, so that the rest's norms fall fast; the order is the same for all vectors.
    order = np.argsort(-(data.astype(np.float64) ** 2).sum(axis=1), kind="stable")
    c, q = data[order].astype(np.float64), queries[:, order].astype(np.float64)
    rest_c = np.sqrt(np.concatenate([np.cumsum((c**2)[::-1], axis=0)[::-1], np.zeros((1, n))]))
    rest_q = np.sqrt(np.concatenate([np.cumsum((q**2)[:, ::-1], axis=1)[:, ::-1], np.zeros((len(q), 1))], axis=1))
    exact = rest_q[:, 0].max(initial=0) * rest_c[0].max(initial=0) * max(d, 1) < 2.0**52
    rounding = 0.0 if exact else (d + 4) * 2.0**-51
    same = query_ids[:, None] == ids[None, :]
    rows, cols, score = None, None, np.zeros((len(q), n))
    for low in range(0, max(d, 1), STEP):
        high = min(low + STEP, d)
        if rows is None:
            score += q[:, low:high] @ c[low:high]
            slack = (rest_q[:, high][:, None] * rest_c[high][None, :]) * (1 + 1e-9) + 1e-6
            if not exact:
                slack += rounding * rest_q[:, 0][:, None] * rest_c[0][None, :]
            lower = np.where(same, -np.inf, score - slack)
            floor = np.maximum(best, np.partition(lower, n - k, axis=1)[:, n - k] if n > k else -np.inf)
            keep = (score + slack >= floor[:, None]) & ~same
            if keep.mean() < 0.2 or high >= d:
                rows, cols = np.nonzero(keep)
                score = score[rows, cols]
        else:
            for a in range(0, len(rows), 1 << 18):
                part = slice(a, a + (1 << 18))
                score[part] += np.einsum("ij,ij->i", q[rows[part], low:high], c[low:high, cols[part]].T)
            slack = rest_q[rows, high] * rest_c[high, cols] * (1 + 1e-9) + 1e-6 + rounding * rest_q[rows, 0] * rest_c[0, cols]
            lower = score - slack
            by = np.lexsort((-lower, rows))
            first = np.searchsorted(rows[by], np.arange(len(q)))
            have = np.bincount(rows, minlength=len(q))
            floor = np.maximum(best, np.where(have >= k, lower[by][np.minimum(first + k - 1, max(len(by) - 1, 0))] if len(by) else -np.inf, -np.inf))
            keep = score + slack >= floor[rows]
            rows, cols, score = rows[keep], cols[keep], score[keep]
    if exact:
        whole = np.rint(score).astype(np.int64)
    else:
        sums = [sum(int(x) * int(y) for x, y in zip(queries[r], data[:, c], strict=True)) for r, c in zip(rows.tolist(), cols.tolist(), strict=True)]
        whole = np.array(sums, np.int64)  # raises OverflowError where it has to
    by = np.lexsort((ids[cols], -whole, rows))
    rows, cols, whole = rows[by], cols[by], whole[by]
    keep = np.arange(len(rows)) - np.searchsorted(rows, rows) < k
    return rows[keep], ids[cols[keep]], whole[keep]


def home_top(queries: np.ndarray, query_ids: np.ndarray, held: list[tuple[np.ndarray, np.ndarray, float]], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each query's k best over several blocks (ids, data, largest norm), those of large norms first; bounds pass from block to block."""
    have = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    best, own = np.full(len(queries), -np.inf), norms(queries.T) * (1 + 1e-9)
    for ids, data, norm in held:
        able = np.flatnonzero(own * norm + 1e-6 >= best)
        if not len(able):
            continue
        rows, found, score = block_top(queries[able], query_ids[able], data, ids, k, best[able])
        rows, found, score = (np.concatenate(x) for x in zip(have, (able[rows], found, score), strict=True))
        by = np.lexsort((found, -score, rows))
        rows, found, score = rows[by], found[by], score[by]
        nth = np.arange(len(rows)) - np.searchsorted(rows, rows)
        best[rows[nth == k - 1]] = score[nth == k - 1].astype(np.float64) * (1 - np.sign(score[nth == k - 1]) * 1e-15)
        have = rows[nth < k], found[nth < k], score[nth < k]
    return have


def top_k(queries: DataFrame, candidates: DataFrame, k: int = 5, block_rows: int = 4096, most_homes: int = 100_000) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's ``k`` highest inner products.

    Both inputs are ``quantised`` tables (vec_id long, v array of long). Candidates are packed into blocks
    of at most ``block_rows`` that stay together, ``HOME`` to a task; blocks of queries are
    sent to every such home of their width, meet its blocks one by one, those with the largest norms first, and take the
    bounds along: a block whose largest norm can't reach a query's k-th score is passed
    over. Only the list of homes is broadcast, and only up to ``most_homes`` of them. A query isn't its own
    candidate: candidates with its id are left out. Ties go to the smaller id; a query with fewer candidates
    gets them all, one without any gets no row; repeated rows are all candidates, a query id is asked once (with its least vector); empty tables give an
    empty result; other columns are dropped; a score beyond 64 bits raises an error.
    """
    queries = queries.groupBy("vec_id").agg(F.min("v").alias("v"))
    longest = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x)
    left, right = blocks(queries, min(block_rows, 512)), blocks(candidates.withColumn("norm", longest).sortWithinPartitions(F.desc("norm")), block_rows)
    right = right.withColumn("home", F.shiftright("block", HOME.bit_length() - 1))
    homes = right.select("home", "width").distinct()
    if homes.count() <= most_homes:
        homes = F.broadcast(homes)
    both = ["home", "width", "kind", "block", "ids", "data"]
    asked = left.join(homes, "width").withColumn("kind", F.lit(1)).select(both)
    met = right.withColumn("kind", F.lit(0)).select(both).unionByName(asked).repartition("home", "width").sortWithinPartitions("home", "width", "kind", "block")
    schema = T.StructType([T.StructField(n, T.LongType(), True) for n in ("query_id", "vec_id", "score")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            for home, width, kind, _, ids, data in zip(*(c for c in batch.columns), strict=True):
                place = home.as_py(), width.as_py()
                if place != now:
                    now, held = place, []
                own, matrix = unpacked(place[1], ids.as_py(), data.as_py())
                if kind.as_py() == 0:
                    held.append((own, matrix, float(norms(matrix).max(initial=0))))
                    held.sort(key=lambda b: -b[2])
                    continue
                rows, found, score = home_top(matrix.T, own, held, k)
                yield pa.RecordBatch.from_arrays([pa.array(own[rows]), pa.array(found), pa.array(score)], names=schema.names)

    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return met.mapInArrow(run, schema).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
