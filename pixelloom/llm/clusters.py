"""Centroid clustering over subvector dictionaries: exact integer k-means that measures each distinct subvector once a round.

Vectors lie in pages of some ten thousand rows. A page encodes every block of dimensions losslessly as codes into the
page's distinct subvectors, as a columnar file does with its row groups, so no dictionary grows with the table and
nothing is shuffled to make one. A round measures a page's distinct subvectors against all centroids, then adds the partial distances up by code.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelloom.llm.common import cut

BLOCK = 2  # dimensions of a subvector
PAGE = 1 << 16  # rows of a page, and so at most as many subvectors in a dictionary
ROWS = 8192  # rows whose distances are added up at once
WIDEST = 1 << 27  # components stay below, so that a squared distance of 64 components fits 64 bits

RESULT = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"


def whole_vectors(df: DataFrame, width: int = 64, scale: int = 256, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """vec_id and ``v``, the components as floor(scale * x), of vectors with exactly ``width`` components, none null or non-finite.

    A component of 2**27 or more once scaled raises an error: its squared distance may not fit 64 bits.
    """
    finite = lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf")))
    fits = lambda e: F.when(F.abs(e * scale) < F.lit(float(WIDEST)), F.floor(e * scale)).otherwise(F.raise_error(F.lit("a vector's component is too large")).cast("long"))
    x = df.where(F.size(embedding) == width).select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("x"))
    return x.where(F.forall("x", finite)).select("vec_id", F.transform("x", fits).alias("v"))


def encoded(matrix: np.ndarray, block: int = BLOCK) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For each block of ``block`` columns its distinct subvectors (in ascending order) and every row's code."""
    subvectors, codes = [], []
    for low in range(0, matrix.shape[1], block):
        part = matrix[:, low : low + block]
        code = np.zeros(len(part), np.int64)
        for column in part.T:
            values, own = np.unique(column, return_inverse=True)
            code = np.unique(code * len(values) + own, return_inverse=True)[1]
        first = np.unique(code, return_index=True)[1]
        subvectors.append(part[first])
        codes.append(code)
    return subvectors, codes


def pages(vectors: DataFrame, block: int = BLOCK, page_rows: int = PAGE) -> DataFrame:
    """Pages of dictionary-encoded vectors: ids, sizes of the dictionaries, subvectors (int32) and codes (uint16), block after block."""

    def page(ids: list[pa.Array], parts: list[np.ndarray]) -> pa.RecordBatch:
        ids, matrix = pa.concat_arrays(ids), np.concatenate(parts)
        subvectors, codes = encoded(matrix, block)
        columns = [ids.to_pylist(), [len(s) for s in subvectors], b"".join(s.astype("<i4").tobytes() for s in subvectors), b"".join(c.astype("<u2").tobytes() for c in codes)]
        return pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(columns, (pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary(), pa.binary()), strict=True)], names=["ids", "sizes", "subvectors", "codes"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, parts, held = [], [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            matrix = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            for low in range(0, batch.num_rows, page_rows):
                part = matrix[low : low + page_rows]
                if held + len(part) > page_rows:
                    yield page(ids, parts)
                    ids, parts, held = [], [], 0
                ids.append(batch.column(0).slice(low, len(part)))
                parts.append(part)
                held += len(part)
        if held:
            yield page(ids, parts)

    return vectors.select("vec_id", "v").mapInArrow(run, "ids array<long>, sizes array<int>, subvectors binary, codes binary")


class Page:
    """One page, decoded: ids, and the subvectors and codes of each block."""

    def __init__(self, ids: pa.Scalar, sizes: pa.Scalar, subvectors: pa.Scalar, codes: pa.Scalar, width: int, block: int) -> None:
        self.ids = ids.values
        self.lows = list(range(0, width, block))
        flat, self.subvectors, at = np.frombuffer(subvectors.as_buffer(), "<i4"), [], 0
        for size, low in zip(sizes.as_py(), self.lows, strict=True):
            wide = min(block, width - low)
            self.subvectors.append(flat[at : at + size * wide].reshape(size, wide).astype(np.int64))
            at += size * wide
        self.codes = np.frombuffer(codes.as_buffer(), "<u2").reshape(len(self.lows), len(self.ids))

    def nearest(self, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Every row's nearest centroid (ties: the smaller number) and its squared distance."""
        total = np.zeros((len(self.ids), len(centroids)), np.int64)
        for low, subvectors, codes in zip(self.lows, self.subvectors, self.codes, strict=True):
            partial = np.zeros((len(subvectors), len(centroids)), np.int64)
            for j, column in enumerate(subvectors.T):
                apart = column[:, None] - centroids[None, :, low + j]
                partial += apart * apart
            for a in range(0, len(total), ROWS):
                total[a : a + ROWS] += partial[codes[a : a + ROWS]]
        label = total.argmin(axis=1)
        return label, total[np.arange(len(total)), label]

    def sums(self, label: np.ndarray, k: int) -> np.ndarray:
        """Componentwise sums of each cluster's rows: how often it has a code, times the code's subvector."""
        parts = []
        for subvectors, codes in zip(self.subvectors, self.codes, strict=True):
            often = np.bincount(label * len(subvectors) + codes, minlength=k * len(subvectors)).reshape(k, -1)
            parts.append(often @ subvectors)
        return np.concatenate(parts, axis=1)


def rounds_sums(paged: DataFrame, centroids: np.ndarray, block: int) -> list[tuple[int, int, int, np.ndarray]]:
    """(cluster, rows, summed distance, summed vectors) of every cluster that has rows; pages are added up before and after the shuffle."""
    k, width = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in zip(*batch.columns, strict=True):
                page = Page(*row, width, block)
                label, distance = page.nearest(centroids)
                rows, sums = np.bincount(label, minlength=k), page.sums(label, k)
                for c in np.flatnonzero(rows).tolist():
                    own = distance[label == c]
                    total = int(own.sum()) if int(own.max()) * len(own) < 1 << 62 else sum(own.tolist())
                    yield pa.RecordBatch.from_arrays([pa.array([c], pa.int32()), pa.array([rows[c]], pa.int64()), pa.array([Decimal(total)], pa.decimal128(38, 0)), pa.array([sums[c].tolist()], pa.list_(pa.int64()))], names=["cluster", "n", "inertia", "sums"])

    partial = paged.mapInArrow(run, "cluster int, n long, inertia decimal(38,0), sums array<long>")
    added = partial.groupBy("cluster").agg(F.sum("n").alias("n"), F.sum("inertia").alias("inertia"), F.array(*[F.sum(F.col("sums")[i]) for i in range(width)]).alias("sums"))
    return [(r.cluster, r.n, int(r.inertia), np.array(r.sums, np.int64)) for r in added.collect()]  # k rows at most


def cluster(vectors: DataFrame, k: int = 40, rounds: int = 5, salt: str = "2", width: int = 64, block: int = BLOCK, page_rows: int = PAGE) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 for every row of ``whole_vectors``.

    Centroids start as the ``k`` vectors with the least sha256 of ``<salt>:<vec_id>`` (all, if there are fewer), in this order; rows of one id
    count by their vectors, rows without an id come last. Each of ``rounds`` rounds assigns all vectors and moves every centroid that
    has some to the floored mean. Only ``k`` centroids and their sums come to the driver. Pages
    are written to the shared folder once and read in each round; a lost executor's pages are read again. Repeated rows each count and
    are each returned, other columns are dropped, an empty table gives an empty result. Sums beyond 64 bits raise an error.
    """
    if page_rows > PAGE:
        raise ValueError("a page's codes have 16 bits")
    name = F.sha2(F.concat(F.lit(f"{salt}:"), F.col("vec_id").cast("string")), 256)
    starts = vectors.orderBy(name.asc_nulls_last(), "v").limit(k).collect()
    if not starts:
        return vectors.sparkSession.createDataFrame([], RESULT)
    centroids = np.array([r.v for r in starts], np.int64).reshape(-1, width)
    paged = cut(pages(vectors, block, page_rows))
    for _ in range(rounds):
        moved = centroids.copy()
        for c, n, _, sums in rounds_sums(paged, centroids, block):
            moved[c] = np.floor_divide(sums, n)
        centroids = moved
    inertia = {c: total for c, _, total, _ in rounds_sums(paged, centroids, block)}
    if sum(inertia.values()) >= 1 << 63:
        raise OverflowError("the inertia has more than 64 bits")
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    own = np.array([inertia.get(c, 0) for c in range(len(centroids))], np.int64)

    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in zip(*batch.columns, strict=True):
                page = Page(*row, width, block)
                label, distance = page.nearest(centroids)
                columns = [page.ids, pa.array(label.astype(np.int32)), pa.array(distance), pa.array(own[label]), pa.array(np.full(len(label), own.sum())), pa.array([digests[c] for c in label.tolist()], pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"])

    return paged.mapInArrow(assigned, RESULT)
