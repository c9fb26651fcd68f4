"""Chat formatting by columnar byte assembly, with a reversible escape and a loss mask.

One turn becomes ``<s>[INST] role\\n`` content `` [/INST]</s>\\n``. Inside roles and
contents each control string gets one more backslash after its first character, and
loses one when read back, so any text survives and no text can forge a mark.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pixelloom.llm.common import by_bytes, gather, utf8_parts

BEGIN, OPEN, CLOSE = b"<s>[INST] ", b"\n", b" [/INST]</s>\n"
# A control string, with any number of backslashes after its first character.
ESCAPE = (r"(<|\[)(\\*)(/?s>|/?INST\])", r"\1\\\2\3")
UNESCAPE = (r"(<|\[)\\(\\*)(/?s>|/?INST\])", r"\1\2\3")
UNESCAPE_BYTES = regex.compile(UNESCAPE[0].encode())
# A role stays on one line: a line break in it is written as the two characters \n, a backslash as two.
TURN = regex.compile(rb"<s>\[INST\] ([^\n]*)\n(.*?) \[/INST\]</s>\n", regex.DOTALL)


def escaped(column: pa.Array) -> pa.Array:
    return pc.replace_substring_regex(pc.fill_null(column, ""), *ESCAPE)


def unescaped(data: bytes) -> bytes:
    return UNESCAPE_BYTES.sub(rb"\1\2\3", data)


def escaped_role(column: pa.Array) -> pa.Array:
    plain = pc.replace_substring(pc.replace_substring(pc.fill_null(column, ""), "\\", "\\\\"), "\n", "\\n")
    return pc.replace_substring_regex(plain, *ESCAPE)


def unescaped_role(data: bytes) -> bytes:
    return regex.sub(rb"\\(.)", lambda m: b"\n" if m[1] == b"n" else m[1], unescaped(data))


def assemble(roles: pa.Array, texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Formatted turns as one preallocated buffer, and each content's start and length within its turn."""
    role_data, role_start, role_len = utf8_parts(escaped_role(roles))
    text_data, text_start, text_len = utf8_parts(escaped(texts))
    marks = np.frombuffer(BEGIN + OPEN + CLOSE, np.uint8)
    n = len(roles)
    blob = np.concatenate([marks, role_data, text_data])
    starts = np.empty((n, 5), np.int64)
    lengths = np.empty((n, 5), np.int64)
    for k, (at, size) in enumerate([(0, len(BEGIN)), (len(marks) + role_start, role_len), (len(BEGIN), len(OPEN)), (len(marks) + len(role_data) + text_start, text_len), (len(BEGIN) + len(OPEN), len(CLOSE))]):
        starts[:, k], lengths[:, k] = at, size
    data = gather(blob, starts.ravel(), lengths.ravel())
    offsets = np.concatenate([[0], np.cumsum(lengths.sum(axis=1))]).astype(np.int32)
    made = pa.Array.from_buffers(pa.string(), n, [None, pa.py_buffer(offsets), pa.py_buffer(data)])
    return made, lengths[:, :3].sum(axis=1), lengths[:, 3]


def format_turns(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", trained: str = "assistant", batch_bytes: int = 4 << 20) -> DataFrame:
    """One row per turn: conv, turn, ``formatted`` (string) and the ``loss_start``, ``loss_length`` byte span.

    The span covers the content of turns whose role is ``trained`` and is null
    for others. Each row is formatted by itself, so nothing is shuffled and one huge
    conversation spreads over all tasks. Null roles and texts count as empty,
    null ids and turns stay null; repeated rows are kept; other columns are
    dropped, so names can't clash; an empty table gives an empty table.
    """
    source = df.select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), F.col(role).cast("string").alias("role"), F.col(text).cast("string").alias("text"))
    schema = T.StructType([source.schema["conv_id"], source.schema["turn"], T.StructField("formatted", T.StringType(), True), T.StructField("loss_start", T.LongType(), True), T.StructField("loss_length", T.LongType(), True)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, _, sizes = utf8_parts(batch.column(3))
            for part in by_bytes(sizes + 64, batch_bytes):
                piece = batch.slice(part.start, part.stop - part.start)
                made, start, length = assemble(piece.column(2), piece.column(3))
                other = ~np.asarray(pc.fill_null(pc.equal(piece.column(2), trained), False).to_numpy(zero_copy_only=False), bool)
                yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(1), made, pa.array(start, pa.int64(), mask=other), pa.array(length, pa.int64(), mask=other)], names=[f.name for f in schema.fields])

    return source.mapInArrow(run, schema)


def read_conversations(formatted: DataFrame) -> DataFrame:
    """Parse ``format_turns``'s output and digest each conversation, streaming over its sorted turns.

    Returns conv_id, n_turns, turns_sha256, loss_chars, loss_sha256,
    formatted_chars. Rows are ordered by turn (null first), ties by the formatted string; the state
    is two running hashes, so memory doesn't follow a conversation's length.
    Rows without a conversation id form one conversation.
    """
    key = formatted.schema["conv_id"]
    schema = T.StructType([key, *[T.StructField(n, t, True) for n, t in (("n_turns", T.LongType()), ("turns_sha256", T.StringType()), ("loss_chars", T.LongType()), ("loss_sha256", T.StringType()), ("formatted_chars", T.LongType()))]])
    sorted_turns = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "formatted")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, done = None, None, []

        def close() -> None:
            done.append((now, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True))
            types = [None, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t or kind) for c, t in zip(columns, types, strict=True)], names=[f.name for f in schema.fields])

        kind = pa.int64()
        for batch in batches:
            kind = batch.schema.field(0).type
            for conv, data, start, length in zip(batch.column(0).to_pylist(), batch.column(2).cast(pa.binary()).to_pylist(), batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True):
                if state is None or conv != now:
                    if state is not None:
                        close()
                    now, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for found in TURN.finditer(data):
                    state[0] += 1
                    state[1].update(unescaped_role(found[1]) + b"\n" + unescaped(found[2]) + b"\n")
                if start is not None:
                    masked = unescaped(data[start : start + length])
                    state[2] += len(masked.decode())
                    state[3].update(masked)
                state[4] += len(data.decode())
            if len(done) >= 4096:
                yield batch_of(done)
                done.clear()
        if state is not None:
            close()
        if done:
            yield batch_of(done)

    return sorted_turns.select("conv_id", "turn", "formatted", "loss_start", "loss_length").mapInArrow(run, schema)
