"""Best-fit packing of token pieces by a configuration linear program over the length histogram."""

from __future__ import annotations

import bisect
import math
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pixelloom.llm.bpe import Numbered
from pixelloom.llm.common import by_bytes, cut, gather, held, utf8_parts, without

LATIN_END = "\u0250"  # below, character classes and case are the same in every Unicode version

# --- tokens ---------------------------------------------------------------


class WordTokens:
    """Ids of a lower-casing word-end BPE of the tokenizers library, keeping the ids of recurring words.

    White space is dropped by this kind of tokenizer and never inside a token, so a text's ids
    are those of its words. New words go through the library's model piece by
    piece; words with anything special in them go through the whole library.
    """

    def __init__(self, path: str, keep: int = 1_000_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.keep = keep
        # The byte-level alphabet: printable Latin-1 stands for itself, other bytes for code points from 256 on.
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = iter(range(256, 512))
        self.alphabet = {b: b if b in printable else next(others) for b in range(256)}
        self.split = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
        self.fast = self.agrees()
        self.forget()

    def agrees(self) -> bool:
        """Whether the short way gives the library's ids on a probe of all kinds of characters."""
        probe = ["Hello", "don't", "x1y22", "É", "éa", "a-b_c", " q", "ß!", "'Ll", "\x1c", "ǅ", "½²", "<|x|>", "İ"]
        return all(self.short(w) == self.tokenizer.encode(w, add_special_tokens=False).ids for w in probe)

    def forget(self) -> None:
        self.numbers = Numbered(self.number)
        self.fresh: list[list[int]] = []
        self.flat, self.start, self.count = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def number(self, word: str) -> int:
        ids = self.ids_of(word)
        self.fresh.append(ids)
        return len(self.start) + len(self.fresh) - 1

    def ids_of(self, word: str) -> list[int]:
        if not (self.fast and max(word, default="") < LATIN_END) or "<" in word and any(s in word for s in self.special):
            return self.tokenizer.encode(word, add_special_tokens=False).ids
        if word[-1:] in (".", ",") and word[-2:-1].lower().isalpha():  # a mark after what stays a letter is a piece of its own
            return self.known(word[:-1]) + self.known(word[-1])
        if word.isalpha() and word != (lower := word.lower()):
            return self.known(lower)
        return self.short(word)

    def known(self, word: str) -> list[int]:
        n = self.numbers[word] - len(self.start)
        return self.fresh[n] if n >= 0 else self.flat[self.start[n] : self.start[n] + self.count[n]].tolist()

    def short(self, word: str) -> list[int]:
        if word.isascii() and word.isalpha():
            return [t.id for t in self.model.tokenize(word.lower())]
        plain = unicodedata.normalize("NFC", word).lower()
        pieces = [plain] if plain.isalpha() else self.split.findall(plain)
        return [t.id for p in pieces for t in self.model.tokenize(p.encode().decode("latin-1").translate(self.alphabet))]

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and how many each has."""
        if len(self.numbers) > self.keep:
            self.forget()
        rows = []
        for text in texts:
            words = (text or "").replace("\n", " ").split(" ")
            rows.append(np.fromiter(map(self.numbers.__getitem__, words), np.int64, len(words)))
        if self.fresh:
            counts = np.fromiter(map(len, self.fresh), np.int64, len(self.fresh))
            self.start = np.concatenate([self.start, len(self.flat) + np.cumsum(counts) - counts])
            self.count = np.concatenate([self.count, counts])
            self.flat = np.concatenate([self.flat, np.array([i for ids in self.fresh for i in ids], np.int32)])
            self.fresh = []
        index = np.concatenate(rows) if rows else np.zeros(0, np.int64)
        counts = self.count[index]
        total = np.concatenate([[0], np.cumsum(counts)])
        words = np.fromiter(map(len, rows), np.int64, len(rows))
        ends = np.cumsum(words)
        return gather(self.flat, self.start[index], counts), total[ends] - total[ends - words]


def word_tokens(path: str, keep: int) -> WordTokens:
    return held(("words", path, keep), lambda: WordTokens(path, keep))


def token_pieces(df: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text", capacity: int = 4096, end_id: int = 1, batch_bytes: int = 8 << 20, keep_words: int = 1_000_000) -> DataFrame:
    """doc key, ``piece`` (from 0), ``start``, ``length``, ``ids`` (binary, little-endian unsigned 32-bit).

    A document's tokens are the ids of its text and ``end_id``; only longer ones
    are cut, into pieces of ``capacity`` tokens, the last of which may be shorter.
    A null or empty text is the one token ``end_id``. Whole texts are read; a
    repeated row gives its pieces again; null keys are kept; other columns are dropped.
    A Python worker remembers the ids of at most ``keep_words`` words, for speed only.
    """
    source = df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    schema = T.StructType([T.StructField(key, source.schema["key"].dataType, True), T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = word_tokens(vocabulary, keep_words)
        for batch in batches:
            _, _, sizes = utf8_parts(batch.column(1))
            for part in by_bytes(sizes + 64, batch_bytes):
                keys, texts = (c.slice(part.start, part.stop - part.start) for c in batch.columns)
                ids, counts = tokens.encode(texts.to_pylist())
                ends = np.cumsum(counts)
                ids = np.insert(ids, ends, end_id).astype("<u4")
                counts = counts + 1
                n_pieces = -(-counts // capacity)
                owner = np.repeat(np.arange(len(counts)), n_pieces)
                number = np.arange(len(owner)) - (np.cumsum(n_pieces) - n_pieces)[owner]
                start = number * capacity
                length = np.minimum(capacity, counts[owner] - start)
                offsets = np.concatenate([[0], np.cumsum(length)]).astype(np.int32) * 4
                data = pa.Array.from_buffers(pa.binary(), len(owner), [None, pa.py_buffer(offsets), pa.py_buffer(ids)])
                yield pa.RecordBatch.from_arrays([keys.take(pa.array(owner)), pa.array(number, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), data], names=[f.name for f in schema.fields])

    return source.mapInArrow(run, schema)


# --- the configuration program -------------------------------------------


def best_configuration(price: np.ndarray, capacity: int) -> np.ndarray:
    """Counts of the classes 1..len(price) of most total price within ``capacity`` units: an unbounded knapsack."""
    best, choice = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    for c in range(1, capacity + 1):
        top = min(c, len(price))
        value = price[:top] + best[c - top : c][::-1]
        k = int(value.argmax())
        if value[k] > best[c - 1]:
            best[c], choice[c] = value[k], k + 1
        else:
            best[c] = best[c - 1]
    counts, c = np.zeros(len(price), np.int64), capacity
    while c > 0:
        if choice[c]:
            counts[choice[c] - 1] += 1
            c -= choice[c]
        else:
            c -= 1
    return counts


def fractional(demand: np.ndarray, capacity: int, epsilon: float = 0.2, rounds: int = 6000) -> list[tuple[np.ndarray, float]]:
    """Configurations and how often to use each, nearly least in sum, by multiplicative weights.

    ``demand`` has the pieces of each class, whose size is its index plus one. Each round prices a class
    by weight over demand, takes the best configuration until its scarcest class is
    served once over, and lowers the weights of what it served.
    """
    there = demand > 0
    weight, served = there.astype(float), np.zeros(len(demand))
    used: dict[bytes, float] = {}
    enough = math.log(max(2, there.sum())) / epsilon**2
    for _ in range(rounds):
        a = best_configuration(np.where(there, weight / np.maximum(demand, 1), 0.0), capacity)
        if not a.any():
            break
        step = (demand[a > 0] / a[a > 0]).min()
        used[a.tobytes()] = used.get(a.tobytes(), 0.0) + step
        share = step * a[there] / demand[there]
        served[there] += share
        weight[there] *= np.exp(-epsilon * share)
        weight /= weight.max()
        if served[there].min() >= enough:
            break
    scale = max(served[there].mean(), 1e-9)
    return sorted(((np.frombuffer(k, np.int64), x / scale) for k, x in used.items()), key=lambda p: -p[1])


class Groups:
    """Sequences of one pattern (counts by length) and how many of them, found by what is left in each."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.by_gap: dict[int, list[tuple[Counter, int]]] = {}
        self.gaps: list[int] = []

    def put(self, pattern: Counter, copies: int) -> None:
        gap = self.capacity - sum(n * k for n, k in pattern.items())
        if gap not in self.by_gap:
            self.by_gap[gap] = []
            bisect.insort(self.gaps, gap)
        self.by_gap[gap].append((pattern, copies))

    def fitting(self, length: int) -> tuple[Counter, int] | None:
        """Take a group of the smallest gap that holds ``length``."""
        i = bisect.bisect_left(self.gaps, length)
        if i == len(self.gaps):
            return None
        gap = self.gaps[i]
        found = self.by_gap[gap].pop()
        if not self.by_gap[gap]:
            del self.by_gap[gap], self.gaps[i]
        return found

    def all(self) -> list[tuple[Counter, int]]:
        return [g for gap in self.gaps for g in self.by_gap[gap]]


def patterns(histogram: dict[int, int], capacity: int, classes: int = 128) -> list[tuple[Counter, int]]:
    """Patterns of exact lengths with numbers of copies, which use every piece of ``histogram`` once.

    Lengths above a 32nd of the capacity are rounded up to ``classes`` classes
    for the linear program. Its solution is rounded down to whole copies, filled with
    exact lengths, longest first; what is left, and the short
    pieces, go into the smallest gaps that hold them, longest first, or open new sequences. All
    sizes here follow the capacity, not the number of pieces.
    """
    left = {n: k for n, k in histogram.items() if k}
    groups = Groups(capacity)
    if k := left.pop(capacity, 0):
        groups.put(Counter({capacity: 1}), k)
    unit = max(1, -(-capacity // classes))
    units = capacity // unit
    small = capacity // 32
    demand = np.zeros(units, np.int64)
    members: dict[int, list[int]] = {}
    for n in sorted(left):
        c = -(-n // unit)
        if n > small and c <= units:
            demand[c - 1] += left[n]
            members.setdefault(c - 1, []).append(n)
    if demand.sum():
        for config, x in fractional(demand, units):
            copies = int(x)
            parts = [c for c in np.flatnonzero(config).tolist() for _ in range(config[c])]
            while copies > 0:
                pattern: Counter = Counter()
                for c in parts:  # the longest length of the class that is still there
                    own = members[c]
                    while own and left[own[-1]] <= 0:
                        own.pop()
                    pick = next((n for n in reversed(own) if left[n] > pattern[n]), None)
                    if pick is not None:
                        pattern[pick] += 1
                if sum(pattern.values()) < len(parts):
                    break
                times = min(copies, *(left[n] // k for n, k in pattern.items()))
                groups.put(pattern, times)
                copies -= times
                for n, k in pattern.items():
                    left[n] -= k * times
    for n in sorted(left, reverse=True):
        while left[n] > 0:
            if (found := groups.fitting(n)) is None:
                per = min(capacity // n, left[n])
                groups.put(Counter({n: per}), left[n] // per)
                left[n] -= left[n] // per * per
                continue
            pattern, copies = found
            gap = capacity - sum(m * k for m, k in pattern.items())
            per = min(gap // n, left[n])
            times = min(copies, left[n] // per)
            groups.put(pattern + Counter({n: per}), times)
            if copies > times:
                groups.put(pattern, copies - times)
            left[n] -= per * times
    return groups.all()


def pack(pieces: DataFrame, length: str = "length", capacity: int = 4096, spread: int = 200_000) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` (long): whole pieces in as few sequences of ``capacity`` as can be found.

    Only the histogram of lengths, at most ``capacity`` counts, comes to the
    driver; the patterns found there are as bounded, and each piece finds its place by its rank
    among those of its length. Ranks come from groups of at most ``spread`` neighbouring rows of one
    input partition, so a length that a third of all pieces have is no hot group, nor are equal rows. Offsets have no gaps.
    Pieces with a null length or one outside 1..capacity raise an error; repeated
    rows are pieces of their own; an empty table stays empty; columns called
    ``sequence_id`` or ``offset`` are replaced, others pass through; columns called ``pack_row``,
    ``pack_salt``, ``pack_rank`` or ``pack_before`` raise an error.
    """
    if clash := {c.lower() for c in pieces.columns} & {"pack_row", "pack_salt", "pack_rank", "pack_before"}:
        raise ValueError(f"columns {sorted(clash)} are taken by pack")
    kept = [c for c in pieces.columns if c.lower() not in ("sequence_id", "offset")]
    own = without(pieces, ("sequence_id", "offset"))
    pieces = cut(own.withColumn("pack_row", F.monotonically_increasing_id()))
    counted = {r[0]: r[1] for r in pieces.groupBy(F.col(length).cast("long")).count().collect()}
    if any(n is None or not 1 <= n <= capacity for n in counted):
        raise ValueError(f"a piece's length is null or outside 1..{capacity}")
    found = patterns(counted, capacity)
    slots, sequences = [], 0
    for pattern, copies in found:
        at = 0
        for n, per in sorted(pattern.items(), reverse=True):
            slots.append((n, per, copies, sequences, at))
            at += n * per
        sequences += copies
    slots.sort(key=lambda s: s[0])
    n, per, copies, first, at = (np.array([s[i] for s in slots], np.int64) for i in range(5))
    base = np.cumsum(per * copies) - per * copies
    length_base = {int(k): int(base[i]) for k, i in zip(*np.unique(n, return_index=True), strict=True)} if len(n) else {}
    starts = np.zeros(capacity + 1, np.int64)
    for k, v in length_base.items():
        starts[k] = v

    salted = pieces.withColumn("pack_salt", F.floor(F.col("pack_row") / spread))
    sizes = salted.groupBy(length, "pack_salt").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select(length, "pack_salt", (F.sum("n").over(Window.partitionBy(length).orderBy("pack_salt")) - F.col("n")).alias("pack_before"))
    ranked = salted.withColumn("pack_rank", F.row_number().over(Window.partitionBy(length, "pack_salt").orderBy("pack_row")).cast("long") - 1)
    joined = ranked.join(before, [length, "pack_salt"]).select(*[f"`{c}`" for c in kept], (F.col("pack_rank") + F.col("pack_before")).alias("pack_rank"))
    schema = T.StructType([*own.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    where = kept.index(next(c for c in kept if c.lower() == length.lower()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(where).to_numpy(zero_copy_only=False).astype(np.int64)
            rank = batch.column(len(kept)).to_numpy(zero_copy_only=False) + starts[own]
            i = np.searchsorted(base, rank, side="right") - 1
            inside = rank - base[i]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(first[i] + inside // per[i]), pa.array(at[i] + inside % per[i] * own)], names=[f.name for f in schema.fields])

    return joined.mapInArrow(run, schema)
