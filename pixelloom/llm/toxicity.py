"""Toxicity by compression distance: windows are compressed with a toxic and an ordinary zstandard dictionary.

Dictionaries of whole toxic and whole ordinary texts don't separate them (AUC 0.70), as
toxic words are a few per document and either dictionary is mostly chance. So the toxic
dictionary is trained on the parts of toxic texts that set them apart.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pixelloom.llm.common import map_columns, remainder
from pixelloom.llm.labelled import halves, labelled_sample, linear, logistic, unlike

# Windows are compressed as OPENING + window + CLOSING. Both dictionaries hold OPENING, so that
# each window already pays for one match; zstandard looks for no match in the last 8 bytes.
OPENING, CLOSING = b"<|window|>", b"\n" * 8
GRAMS = (5, 6, 7, 8)
LOW, HIGH = -16, 40  # the histogram's ends: no window of ordinary width differs by more
LEVELS = (1.0, 2.0, 3.0)  # log odds of windows beyond a threshold


@dataclass(frozen=True)
class Half:
    """Two dictionaries from one half of the rows; thresholds of differences and the calibration from the other."""

    ordinary: bytes
    toxic: bytes
    thresholds: tuple[int, ...]
    weights: tuple[float, ...]


@dataclass(frozen=True)
class ToxicModel:
    """The mean log odds of both halves is the score's."""

    halves: tuple[Half, ...]
    window: int


def normal(text: str) -> bytes:
    """Lower-case bytes with single spaces, and one at either end, so that a word looks alike wherever it stands."""
    return b" " + b" ".join(text.lower().encode(errors="replace").split()) + b" "


def cuts(data: bytes, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of consecutive windows of about ``width`` bytes, cut at white space."""
    a = np.frombuffer(data, np.uint8)
    n = len(a)
    spaces = np.flatnonzero((a == 32) | (a == 10))
    inner = spaces[np.minimum(np.searchsorted(spaces, np.arange(width, n, width)), len(spaces) - 1)] if len(spaces) else np.arange(0)
    if len(spaces) * 64 < n:  # hardly any white space: cut anywhere
        inner = np.arange(width, n, width)
    at = np.unique(np.concatenate([[0], inner, [n]]).astype(np.int64))
    return (at[:-1], np.diff(at)) if n else (np.zeros(1, np.int64), np.zeros(1, np.int64))


@lru_cache(maxsize=8)
def compressor(content: bytes) -> zstandard.ZstdCompressor:
    """Raw literals (a target length with the fast strategy) and matches of 5 bytes or more: lengths then differ only by what the dictionary matches."""
    dictionary = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    parameters = zstandard.ZstdCompressionParameters(window_log=17, hash_log=15, chain_log=15, search_log=4, min_match=5, target_length=1, strategy=zstandard.STRATEGY_FAST, format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=0, write_checksum=0, write_dict_id=0)
    dictionary.precompute_compress(compression_params=parameters)
    return zstandard.ZstdCompressor(dict_data=dictionary, compression_params=parameters)


def framed_windows(data: bytes, width: int) -> tuple[bytes, bytes]:
    """All windows of ``data`` in their frames, and where they lie (pairs of start and length)."""
    start, length = cuts(data, width)
    framed = b"".join([OPENING + data[a : a + n] + CLOSING for a, n in zip(start.tolist(), length.tolist(), strict=True)])
    length = length + len(OPENING) + len(CLOSING)
    return framed, np.stack([np.cumsum(length) - length, length], axis=1).astype(np.uint64).tobytes()


def histogram(framed: bytes, segments: bytes, ordinary: bytes, toxic: bytes) -> np.ndarray:
    """How many windows get so many bytes shorter with the toxic dictionary than with the ordinary one."""
    plain, harsh = (np.fromiter(map(len, compressor(c).multi_compress_to_buffer(zstandard.BufferWithSegments(framed, segments))), np.int64, len(segments) // 16) for c in (ordinary, toxic))
    return np.bincount(np.clip(plain - harsh, LOW, HIGH) - LOW, minlength=HIGH - LOW + 1)


def grams(b: bytes, k: int) -> np.ndarray:
    """All runs of k <= 8 bytes as integers."""
    a = np.frombuffer(b, np.uint8).astype(np.uint64)
    v = np.zeros(max(0, len(a) - k + 1), np.uint64)
    for i in range(k if len(v) else 0):
        v = v << np.uint64(8) | a[i : len(a) - k + 1 + i]
    return v


def in_texts(texts: list[bytes], k: int) -> tuple[np.ndarray, np.ndarray]:
    """The grams of k bytes and in how many texts each is."""
    return np.unique(np.concatenate([np.zeros(0, np.uint64), *[np.unique(grams(b, k)) for b in texts]]), return_counts=True)


def found_in(wanted: np.ndarray, texts: list[bytes], k: int) -> np.ndarray:
    """In how many texts each of the sorted ``wanted`` grams is."""
    found = np.zeros(len(wanted))
    for b in texts if len(wanted) else []:
        g = np.sort(grams(b, k))
        at = np.minimum(np.searchsorted(g, wanted), max(len(g) - 1, 0))
        found += g[at] == wanted if len(g) else False
    return found


def telling_grams(toxic: list[bytes], ordinary: list[bytes], least_ratio: float = 40.0, margin: float = 3.0) -> dict[int, np.ndarray]:
    """Grams that are ``least_ratio`` times commoner in toxic texts, by a likelihood ratio that chance doesn't reach among as many grams."""
    size = sum(map(len, toxic)), sum(map(len, ordinary))
    share = size[0] / sum(size)
    told = {}
    for k in GRAMS:
        u, a = in_texts(toxic, k)
        bound = math.log(max(2, len(u))) + margin
        able = a * -math.log(share) > bound  # no rarer gram can reach it
        u, a = u[able], a[able]
        b = found_in(u, ordinary, k)
        ratio = a * np.log(a / ((a + b) * share)) + b * np.log(np.maximum(b, 1e-9) / ((a + b) * (1 - share)))
        told[k] = u[(ratio > bound) & ((a + 0.25) / share > least_ratio * (b + 0.25) / (1 - share))]
    return told


def telling_parts(text: bytes, told: dict[int, np.ndarray]) -> list[bytes]:
    """The parts of a text that the telling grams cover, of which those that hold a shorter one don't count."""
    n = len(text)
    covered, begun = np.zeros(n + 1, np.int8), {}
    for k, own in told.items():
        if len(own) and n >= k:
            g = grams(text, k)
            hits = own[np.minimum(np.searchsorted(own, g), len(own) - 1)] == g
            for j, before in begun.items():  # starts of shorter ones in i .. i + k - j
                hits &= before[k - j + 1 : k - j + 1 + len(g)] == before[: len(g)]
            begun[k] = np.concatenate([[0], np.cumsum(hits)])
            for i in np.flatnonzero(hits).tolist():
                covered[i : i + k] = 1
    edges = np.flatnonzero(np.diff(np.concatenate([[0], covered])))
    return [text[x:y] for x, y in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True)]


def trained_dictionary(samples: list[bytes], size: int, k: int, d: int = 6) -> bytes:
    """The last ``size`` bytes (all content) of a zstandard dictionary of the samples; with too few of them for the trainer, their own bytes."""
    try:
        return zstandard.train_dictionary(size + 300, samples, k=k, d=d).as_bytes()[-size:]
    except zstandard.ZstdError:
        return b"".join(samples)[:size]


def dictionaries(toxic: list[bytes], ordinary: list[bytes], told: dict[int, np.ndarray], window: int, toxic_bytes: int, ordinary_bytes: int) -> tuple[bytes, bytes]:
    """The ordinary dictionary, and the toxic one, which goes on from the ordinary one's content.

    Zero bytes stand in the ordinary one where the other has toxic content: all else then lies
    equally far back in both, and a window without a toxic match has the same length under either.
    """
    pieces = [OPENING + b[a : a + n] + CLOSING for b in ordinary for a, n in zip(*(x.tolist() for x in cuts(b, 200)), strict=True)]
    plain = trained_dictionary(pieces, ordinary_bytes, k=16)
    parts = [b"\n" + p + b"\n" for b in toxic for p in telling_parts(b, told)]
    harsh = trained_dictionary(parts, toxic_bytes, k=12) if parts else b""
    end = OPENING + CLOSING * 2
    return plain + bytes(len(harsh)) + end, plain + harsh + end


def thresholds(in_toxic: np.ndarray, in_plain: np.ndarray) -> tuple[int, ...]:
    """For each level the least positive difference from which on windows are so many times (as log odds) commoner in toxic texts."""
    capped = [h / np.maximum(1, h.sum(axis=1, keepdims=True) / 200) for h in (in_toxic, in_plain)]  # a very long text doesn't outweigh the others
    a, b = (c.sum(axis=0)[::-1].cumsum()[::-1] for c in capped)
    odds = np.log((a + 1) / (a[0] + 1)) - np.log((b + 1) / (b[0] + 1))
    at = np.arange(LOW, HIGH + 1)
    return tuple(int(at[(at > 0) & (odds >= level)].min(initial=HIGH + 1)) for level in LEVELS)


def features(h: np.ndarray, at: tuple[int, ...]) -> np.ndarray:
    """Of each histogram: the number of windows, and how many (as count and as share) lie beyond each threshold."""
    n = np.maximum(h.sum(axis=1), 1)
    beyond = [h[:, t - LOW :].sum(axis=1) for t in at]
    return np.stack([np.log(n), *[np.log1p(c) for c in beyond], *[np.log1p(200 * c / n) for c in beyond]], axis=1)


def train(rows: list[tuple[str, int]], window: int = 24, toxic_bytes: int = 1000, ordinary_bytes: int = 4000) -> ToxicModel:
    """Cross-fitted: each half of the rows trains dictionaries for which the other half finds thresholds and the calibration.

    Without rows of both classes in both halves every score is the share of toxic rows.
    """
    rows = unlike(rows)
    share = (sum(y for _, y in rows) + 0.5) / (len(rows) + 1)
    parts = [[(normal(t), y) for t, y in half] for half in halves(rows)]
    toxic, ordinary = ([[t for t, y in half if y == c] for half in parts] for c in (1, 0))
    if not all([*toxic, *ordinary]):
        end = OPENING + CLOSING * 2
        return ToxicModel((Half(end, end, (HIGH + 1,) * len(LEVELS), (0.0,) * (2 * len(LEVELS) + 1) + (math.log(share / (1 - share)),)),), window)
    made = []
    for own in (0, 1):
        pair = dictionaries(toxic[own], ordinary[own], telling_grams(toxic[own], ordinary[own]), window, toxic_bytes, ordinary_bytes)
        in_toxic, in_plain = (np.array([histogram(*framed_windows(t, window), *pair) for t in texts[1 - own]], float) for texts in (toxic, ordinary))
        at = thresholds(in_toxic, in_plain)
        weights = logistic(features(np.concatenate([in_toxic, in_plain]), at), np.repeat([1.0, 0.0], [len(in_toxic), len(in_plain)]))
        made.append(Half(*pair, at, tuple(weights)))
    return ToxicModel(tuple(made), window)


def log_odds(texts: list[str | None], model: ToxicModel) -> np.ndarray:
    """The mean log odds of both halves for each text."""
    counted: list[list[np.ndarray]] = [[] for _ in model.halves]
    for t in texts:
        windows = framed_windows(normal(t or ""), model.window)
        for own, h in zip(counted, model.halves, strict=True):
            own.append(histogram(*windows, h.ordinary, h.toxic))
    return np.mean([linear(features(np.array(own, float).reshape(len(texts), HIGH - LOW + 1), h.thresholds), np.array(h.weights)) for own, h in zip(counted, model.halves, strict=True)], axis=0)


def score(df: DataFrame, model: ToxicModel, text: str = "text", output: str = "score") -> DataFrame:
    """Add ``score`` (0 to 1, higher: toxic likelier) from all windows of each whole text.

    Null and empty texts get the score of one empty window; repeated rows repeat
    theirs; the longest texts only make more windows; an empty table stays
    empty; a column called like the output is replaced.
    """

    def kernel(column: pa.Array) -> list[pa.Array]:
        return [pa.array(1 / (1 + np.exp(-log_odds(column.to_pylist(), model))))]

    return map_columns(df, text, [(output, T.DoubleType())], kernel)


def fit(documents: DataFrame, labels: DataFrame, per_class: tuple[int, int] = (2400, 1200), modulus: int = 3, held_out: int = 1) -> ToxicModel:
    """Train on a random sample of at most ``per_class`` labelled rows (ordinary, toxic) outside the held-out remainder."""
    return train(labelled_sample(documents, labels, "toxic", modulus, held_out, per_class))


def classify(documents: DataFrame, model: ToxicModel, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``documents``; a null id counts as held out."""
    scored = score(documents.select("doc_id", "text"), model)
    return scored.select("doc_id", F.coalesce(remainder("doc_id", 3) == 1, F.lit(True)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
