"""Byte-level BPE encoding and decoding with a bucket queue over merge ranks.

All distinct pre-tokens of a batch lie in one doubly linked list, with no links
between pre-tokens. Each merge rank has a bucket of list positions; a hierarchical
bitmap finds the lowest rank that has any. A bucket is merged in one vectorised step,
and entries whose pair has changed meanwhile are skipped. Cost is near linear in the
bytes, however long a single pre-token is.
"""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from pixelloom.llm.common import gather, map_columns

NONE = np.int32(2**31 - 1)


class RankBitmap:
    """A set of small integers with find-first-set over three levels of 64-bit words."""

    def __init__(self, size: int):
        n0 = size // 64 + 1
        n1 = n0 // 64 + 1
        self.low, self.mid, self.top = [0] * n0, [0] * n1, 0

    def add(self, r: int) -> None:
        self.low[r >> 6] |= 1 << (r & 63)
        self.mid[r >> 12] |= 1 << (r >> 6 & 63)
        self.top |= 1 << (r >> 12)

    def discard(self, r: int) -> None:
        self.low[r >> 6] &= ~(1 << (r & 63))
        if not self.low[r >> 6]:
            self.mid[r >> 12] &= ~(1 << (r >> 6 & 63))
            if not self.mid[r >> 12]:
                self.top &= ~(1 << (r >> 12))

    def first(self) -> int:
        """The smallest member, or -1."""
        if not self.top:
            return -1
        a = (self.top & -self.top).bit_length() - 1
        b = a << 6 | (self.mid[a] & -self.mid[a]).bit_length() - 1
        return b << 6 | (self.low[b] & -self.low[b]).bit_length() - 1


class ByteBpe:
    """A rank vocabulary: encodes lists of pre-tokens, decodes id arrays."""

    def __init__(self, tokens: dict[bytes, int]):
        self.tokens = tokens
        self.size = max(tokens.values()) + 1
        keys, values = [], []
        self.lowering = np.zeros(self.size, bool)  # a pair with this token may have a lower rank than the token itself
        for token, rank in tokens.items():
            for i in range(1, len(token)):
                a, b = tokens.get(token[:i]), tokens.get(token[i:])
                if a is not None and b is not None:
                    keys.append(a * self.size + b)
                    values.append(rank)
                    self.lowering[a] |= a > rank
                    self.lowering[b] |= b > rank
        order = np.argsort(np.array(keys, np.int64), kind="stable")
        self.keys, self.values = np.array(keys, np.int64)[order], np.array(values, np.int32)[order]
        self.bytes_to_ids = np.array([tokens[bytes([b])] for b in range(256)], np.int32)
        self.first_pairs = self.pair_ranks(np.repeat(self.bytes_to_ids, 256), np.tile(self.bytes_to_ids, 256)).reshape(256, 256)
        by_id = [b""] * self.size
        for token, rank in tokens.items():
            by_id[rank] = token
        self.lengths = np.array([len(t) for t in by_id], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.blob = np.frombuffer(b"".join(by_id), np.uint8)

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.full(len(left), NONE, np.int32)
        key = left.astype(np.int64) * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.values[at], NONE)

    def encode(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces, one after the other, and how many each has."""
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        data = np.frombuffer(b"".join(pieces), np.uint8)
        n = len(data)
        if not n:
            return np.zeros(0, np.int32), np.zeros(len(pieces), np.int64)
        ends = np.cumsum(sizes)
        segment = np.repeat(np.arange(len(pieces), dtype=np.int32), sizes)
        ids = self.bytes_to_ids[data]
        after = np.arange(1, n + 1, dtype=np.int32)
        after[ends[sizes > 0] - 1] = -1
        before = np.arange(-1, n - 1, dtype=np.int32)
        before[(ends - sizes)[sizes > 0]] = -1
        alive = np.ones(n, bool)
        rank = np.full(n, NONE, np.int32)
        joined = np.flatnonzero(after >= 0)
        rank[joined] = self.first_pairs[data[joined], data[joined + 1]]
        whole = [self.tokens.get(p, -1) if len(p) > 1 else -1 for p in pieces]
        whole = np.array(whole, np.int64)
        known = np.flatnonzero(whole >= 0)  # a piece that is a token needs no merges
        if len(known):
            inside = np.isin(segment, known.astype(np.int32)) if len(known) < 16 else (whole >= 0)[segment]
            first = (ends - sizes)[known]
            alive[inside] = False
            rank[inside] = NONE
            alive[first], ids[first] = True, whole[known]

        buckets: dict[int, list[np.ndarray]] = {}
        bitmap = RankBitmap(self.size)

        def put(positions: np.ndarray) -> None:
            own = rank[positions]
            positions = positions[own != NONE]
            if not len(positions):
                return
            own = own[own != NONE]
            order = np.argsort(own, kind="stable")
            own, positions = own[order], positions[order]
            cuts = np.flatnonzero(np.diff(own)) + 1
            lows = [0, *cuts.tolist()]
            highs = [*cuts.tolist(), len(own)]
            for low, high, r in zip(lows, highs, own[lows].tolist(), strict=True):
                if r in buckets:
                    buckets[r].append(positions[low:high])
                else:
                    buckets[r] = [positions[low:high]]
                    bitmap.add(r)

        put(np.flatnonzero(rank != NONE).astype(np.int32))
        while (r := bitmap.first()) >= 0:
            held = buckets.pop(r)
            bitmap.discard(r)
            at = held[0] if len(held) == 1 else np.concatenate(held)
            at = np.sort(at[rank[at] == r])  # the others are stale
            if len(at) > 1:
                at = at[np.concatenate([[True], at[1:] != at[:-1]])]
            if not len(at):
                continue
            if len(at) > 1:
                if self.lowering[r]:
                    lead = np.concatenate([[True], segment[at[1:]] != segment[at[:-1]]])
                    if not lead.all():
                        buckets[r] = [at[~lead]]
                        bitmap.add(r)
                        at = at[lead]
                else:
                    chained = after[at[:-1]] == at[1:]
                    if chained.any():  # overlapping pairs: every second one of a chain, from the left
                        index = np.arange(len(at))
                        start = np.maximum.accumulate(np.where(np.concatenate([[True], ~chained]), index, 0))
                        at = at[(index - start) % 2 == 0]
            right = after[at]
            follow = after[right]
            ids[at] = r
            alive[right] = False
            rank[right] = NONE
            after[at] = follow
            linked = follow >= 0
            before[follow[linked]] = at[linked]
            left = before[at]
            touched = np.concatenate([at, left[left >= 0]])
            ahead = after[touched]
            rank[touched] = np.where(ahead >= 0, self.pair_ranks(ids[touched], ids[ahead]), NONE)
            put(touched)
        counts = np.bincount(segment[alive], minlength=len(pieces)).astype(np.int64)
        return ids[alive], counts

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all id rows, one after the other, and how many each row has."""
        sizes = self.lengths[ids]
        total = np.concatenate([[0], np.cumsum(sizes)])
        row_ends = np.cumsum(counts)
        return gather(self.blob, self.starts[ids], sizes), total[row_ends] - total[row_ends - counts]


class Numbered(dict):
    """A dict that asks ``make`` for the value of a missing key and keeps it."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, key):
        value = self[key] = self.make(key)
        return value


class Encoder:
    """Texts to ids, keeping the ids of recurring words up to a bounded number."""

    def __init__(self, bpe: ByteBpe, pattern: str, keep: int = 300_000):
        self.bpe, self.pattern, self.keep = bpe, regex.compile(pattern), keep
        self.forget()

    def forget(self) -> None:
        self.fresh: list[str] = []  # strings that have a number but no ids yet
        self.spaced = Numbered(self.number_word)  # a word that follows one space or starts a line; -1: needs the pattern
        self.spaced.update({"": -1, "\n": -1})
        self.plain = Numbered(self.number)  # any other string as it is
        self.flat, self.start, self.count = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def number(self, string: str) -> int:
        self.fresh.append(string)
        return len(self.start) + len(self.fresh) - 1

    def number_word(self, word: str) -> int:
        if word[-1].isspace() or word[word[0] == "\n" :][:1].isspace():
            return -1
        return self.number(word if word[0] == "\n" else " " + word)

    def add(self, strings: list[str]) -> None:
        pieces: list[bytes] = []
        owner: list[int] = []
        for s in strings:
            found = self.pattern.findall(s)
            pieces += [p.encode() for p in found]
            owner.append(len(found))
        ids, per_piece = self.bpe.encode(pieces)
        owner = np.array(owner, np.int64)
        total = np.concatenate([[0], np.cumsum(per_piece)])
        ends = np.cumsum(owner)
        counts = total[ends] - total[ends - owner]
        self.start = np.concatenate([self.start, len(self.flat) + np.cumsum(counts) - counts])
        self.count = np.concatenate([self.count, counts])
        self.flat = np.concatenate([self.flat, ids])

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and how many each has.

        A text is cut at single spaces and line ends between other characters,
        where no pre-token of the usual byte-level patterns crosses; texts with
        other white space are cut by the pattern itself.
        """
        if len(self.spaced) + len(self.plain) > self.keep:
            self.forget()
        rows = [self.lookup(text) if text else np.zeros(0, np.int64) for text in texts]
        if self.fresh:
            self.add(self.fresh)
            self.fresh = []
        index = np.concatenate(rows) if rows else np.zeros(0, np.int64)
        counts = self.count[index]
        ids = gather(self.flat, self.start[index], counts)
        total = np.concatenate([[0], np.cumsum(counts)])
        words = np.fromiter(map(len, rows), np.int64, len(rows))
        ends = np.cumsum(words)
        return ids, total[ends] - total[ends - words]

    def lookup(self, text: str) -> np.ndarray:
        words = text.replace("\n", " \n").split(" ")
        head = words[0]
        if head and not head[0].isspace() and not head[-1].isspace():
            index = np.fromiter(map(self.spaced.__getitem__, words[1:]), np.int64, len(words) - 1)
            if not len(index) or index.min() >= 0:
                return np.concatenate([[self.plain[head]], index])
        return np.fromiter(map(self.plain.__getitem__, self.pattern.findall(text)), np.int64)


@lru_cache(maxsize=2)
def load(path: str) -> ByteBpe:
    with open(path, "rb") as lines:
        return ByteBpe({base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)})


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> Encoder:
    return Encoder(load(path), pattern)


def encode_bpe(df: DataFrame, ranks: str, pattern: str, text: str = "text", ids: str = "ids", batch_bytes: int = 8 << 20) -> DataFrame:
    """Add the column ``ids`` (array of int): the byte-level BPE ids of ``text``.

    ``ranks`` is the path of a rank file that every executor has (base64 token and
    rank a line), ``pattern`` the split pattern. Special tokens aren't recognised.
    A null or empty text gives an empty array; very long texts and very long
    pre-tokens need time near linear in their bytes; repeated rows repeat their
    result; an empty table stays empty. An input column called ``ids`` is replaced, other
    columns pass through.
    """

    def kernel(column: pa.Array) -> list[pa.Array]:
        flat, counts = encoder(ranks, pattern).encode(column.to_pylist())
        offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
        return [pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int32()))]

    return map_columns(df, text, [(ids, T.ArrayType(T.IntegerType()))], kernel, gather_bytes=batch_bytes)


def decode_bpe(df: DataFrame, ranks: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """Replace the column ``ids`` by ``decoded`` (binary): the bytes that the ids stand for.

    Null or empty arrays give empty bytes. Ids outside the vocabulary raise an
    error. Bytes needn't be valid UTF-8. A column called ``decoded`` is replaced.
    """
    kept = [c for c in df.columns if c.lower() not in (ids.lower(), decoded.lower())]
    schema = T.StructType([*[df.schema[c] for c in kept], T.StructField(decoded, T.BinaryType(), True)])
    source = df.select(*[f"`{c}`" for c in kept], f"`{ids}`")

    def run(batches):
        bpe = load(ranks)
        for batch in batches:
            for part in range(0, batch.num_rows, 256):
                piece = batch.slice(part, 256)
                rows = piece.column(len(kept)).fill_null([])
                counts = np.diff(rows.offsets.to_numpy()).astype(np.int64)
                data, sizes = bpe.decode(rows.flatten().to_numpy(zero_copy_only=False).astype(np.int64), counts)
                offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                made = pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
                yield pa.RecordBatch.from_arrays([*piece.columns[: len(kept)], made], names=[f.name for f in schema.fields])

    return source.mapInArrow(run, schema)
