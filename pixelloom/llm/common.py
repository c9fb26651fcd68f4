"""Shared helpers of the corpus operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def without(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """``df`` less the columns that an operator is about to produce (names compare case-insensitively)."""
    taken = {n.lower() for n in names}
    return df.select(*[f"`{c}`" for c in df.columns if c.lower() not in taken])


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share; one is made only where all of Spark is one process."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not context.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="spark-checkpoint-", dir="/tmp"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and cut its lineage."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it again."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def utf8_parts(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, start offsets and lengths of a string or binary column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data, at[:-1], np.diff(at)


def gather(blob: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The concatenation of ``blob[s : s + n]`` over all (s, n), by one indexed copy."""
    lengths = lengths.astype(np.int64, copy=False)
    total = int(lengths.sum())
    if not total:
        return blob[:0].copy()
    ends = np.cumsum(lengths)
    index = np.repeat(starts - (ends - lengths), lengths)
    index += np.arange(total, dtype=np.int64)
    return blob[index]


def by_bytes(sizes: np.ndarray, target: int) -> Iterator[slice]:
    """Row slices of at most ``target`` bytes each, or of one larger row."""
    start, held = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if i > start and held + n > target:
            yield slice(start, i)
            start, held = i, 0
        held += n
    if start < len(sizes):
        yield slice(start, len(sizes))


_HELD: dict[tuple, object] = {}


def held(key: tuple, make: Callable[[], object]) -> object:
    """The one large cache of a Python worker: making another one lets go of the last.

    Workers are used again by later stages, and caches of different operators would add up.
    """
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = make()
    return _HELD[key]


def map_columns(df: DataFrame, text: str, outputs: list[tuple[str, T.DataType]], kernel: Callable[[pa.Array], list[pa.Array]], batch_bytes: int = 4 << 20, gather_bytes: int = 0) -> DataFrame:
    """``df`` with new columns that ``kernel`` computes from the column ``text``.

    The kernel gets Arrow slices of about ``batch_bytes`` of payload, so a task's
    memory doesn't follow the row count; with ``gather_bytes`` Arrow batches are first
    put together up to that size. Columns of ``df`` named like an output are
    replaced; all others, ``text`` too, pass through unchanged.
    """
    kept = without(df, [n for n, _ in outputs])
    if text.lower() not in {c.lower() for c in kept.columns}:
        raise ValueError(f"column {text!r} is missing or is also an output")
    kept = kept.withColumnsRenamed({c: text for c in kept.columns if c.lower() == text.lower()})
    schema = T.StructType([*kept.schema.fields, *[T.StructField(n, t, True) for n, t in outputs]])
    names = [f.name for f in schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            whole = pa.Table.from_batches(held).combine_chunks()
            rows = whole.column(names.index(text))
            _, _, sizes = utf8_parts(rows)
            for part in by_bytes(sizes + 64, max(batch_bytes, gather_bytes)):
                piece = whole.slice(part.start, part.stop - part.start).combine_chunks()
                columns = [c.chunk(0) if c.num_chunks else pa.array([], c.type) for c in piece.columns]
                made = kernel(columns[names.index(text)])
                out = pa.RecordBatch.from_arrays([*columns, *made], names=names)
                _, _, own = utf8_parts(columns[names.index(text)])
                for rows_out in by_bytes(own + 64, batch_bytes):
                    yield out.slice(rows_out.start, rows_out.stop - rows_out.start)

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                size += batch.nbytes
                if size >= gather_bytes:
                    yield from flush()
                    held.clear()
                    size = 0
        if held:
            yield from flush()

    return kept.mapInArrow(run, schema)


def remainder(column: str, modulus: int):
    """crc32 of the column as text, modulo ``modulus``."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % F.lit(modulus)
