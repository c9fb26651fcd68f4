"""Document quality from a linear-chain conditional random field over lines.

Each line is good or bad. Its evidence uses its own features and those of its
neighbours; the chain adds a weight for each pair of successive labels. The
length-weighted forward-backward marginals are put together to the quality of the document.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pixelloom.llm.common import map_columns, remainder
from pixelloom.llm.labelled import halves, labelled_sample, logistic, probability, unlike

CLASSES = {"upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "lower": b"abcdefghijklmnopqrstuvwxyz", "digit": b"0123456789", "stop": b".,;:", "shout": b"!?", "pipe": b"|", "symbol": b"%&*#$@^~_=+<>\\{}[]`", "quote": b"\"'()-/", "space": b" \t\r"}
TABLE = np.full(256, len(CLASSES), np.int64)
for _k, _bytes in enumerate(CLASSES.values()):
    TABLE[list(_bytes)] = _k
KINDS = len(CLASSES) + 1  # the last: all other bytes
OWN = KINDS + 8  # features of a line itself
WIDE = 3 * OWN + 3


def line_features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """A row of features for each line, with its neighbours' appended, and the lines' lengths in bytes."""
    data = text.encode(errors="replace")
    lines = data.split(b"\n")
    length = np.fromiter(map(len, lines), np.int64, len(lines))
    own = np.zeros((len(lines), OWN))
    a = np.frombuffer(data.replace(b"\n", b""), np.uint8)
    if len(a):
        owner = np.repeat(np.arange(len(lines)), length)
        own[:, :KINDS] = np.bincount(owner * KINDS + TABLE[a], minlength=len(lines) * KINDS).reshape(len(lines), KINDS)
        own[:, :KINDS] /= np.maximum(length, 1)[:, None]
    words = [line.split() for line in lines]
    n = np.fromiter(map(len, words), np.int64, len(lines))
    distinct = np.fromiter((len(set(w)) for w in words), np.int64, len(lines))
    times = Counter(lines)
    own[:, KINDS] = np.log1p(length) / 5
    own[:, KINDS + 1] = np.log1p(n) / 4
    own[:, KINDS + 2] = 1 - distinct / np.maximum(n, 1)
    own[:, KINDS + 3] = length / np.maximum(n, 1) / 20
    own[:, KINDS + 4] = [math.log(times[line]) if line else 0.0 for line in lines]
    own[:, KINDS + 5] = [line[-1:] in (b".", b"!", b"?") for line in lines]
    own[:, KINDS + 6] = [line[:1].isupper() for line in lines]
    own[:, KINDS + 7] = length == 0
    out = np.zeros((len(lines), WIDE))
    out[:, :OWN] = own
    out[1:, OWN : 2 * OWN] = own[:-1]
    out[:-1, 2 * OWN : 3 * OWN] = own[1:]
    out[0, 3 * OWN] = out[-1, 3 * OWN + 1] = 1  # first and last lines
    out[:, 3 * OWN + 2] = 1
    return out, length


@dataclass(frozen=True)
class Chain:
    """Weights of the field: evidence for a bad line, and for each pair of successive labels."""

    mean: np.ndarray
    scale: np.ndarray
    line: np.ndarray
    pair: np.ndarray


def forward_backward(unary: np.ndarray, lengths: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Marginals of a bad label for all lines, expected pair counts and the sum of log partition functions.

    ``unary`` is the evidence of all lines of all chains, one chain after the
    other. Chains run side by side, longest first, one numpy step per line number.
    """
    order = np.argsort(-lengths, kind="stable")
    start = (np.cumsum(lengths) - lengths)[order]
    size = lengths[order]
    steps = int(size[0]) if len(size) else 0
    live = [int(np.searchsorted(-size, -t, side="left")) for t in range(steps)]  # chains that have a line t
    alpha, beta, scale = np.zeros((len(unary), 2)), np.ones((len(unary), 2)), np.zeros(len(unary))
    top = np.maximum(unary, 0)
    node = np.stack([np.exp(-top), np.exp(unary - top)], axis=1)
    m = np.exp(pair)
    for t in range(steps):
        at = start[: live[t]] + t
        a = node[at] if t == 0 else alpha[at - 1] @ m * node[at]
        s = a.sum(axis=1)
        alpha[at], scale[at] = a / s[:, None], s
    for t in range(steps - 1, 0, -1):
        at = start[: live[t]] + t
        beta[at - 1] = (node[at] * beta[at]) @ m.T / scale[at][:, None]
    marginal = alpha * beta
    total = marginal.sum(axis=1, keepdims=True)
    pairs = np.zeros((2, 2))
    inner = np.ones(len(unary), bool)
    inner[start] = False
    at = np.flatnonzero(inner)
    if len(at):
        pairs = m * (alpha[at - 1].T @ (node[at] * beta[at] / scale[at][:, None]))
    return marginal[:, 1] / total[:, 0], pairs, float(np.log(scale).sum() + top.sum())


def fit_chain(x: np.ndarray, lengths: np.ndarray, labels: np.ndarray, line: np.ndarray, pair: np.ndarray, rounds: int = 80, penalty: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """Raise the labels' conditional likelihood by gradient steps with momentum and per-weight scale (Adam)."""
    first = np.zeros(len(x), bool)
    first[np.cumsum(lengths) - lengths] = True
    at = np.flatnonzero(~first)
    seen = np.zeros((2, 2))
    np.add.at(seen, (labels[at - 1].astype(int), labels[at].astype(int)), 1)
    w = np.concatenate([line, pair.ravel()])
    m1, m2 = np.zeros_like(w), np.zeros_like(w)
    for k in range(1, rounds + 1):
        p, pairs, _ = forward_backward(x @ w[:-4], lengths, w[-4:].reshape(2, 2))
        g = np.concatenate([x.T @ (labels - p), (seen - pairs).ravel()]) / len(x) - penalty * w
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.98 * m2 + 0.02 * g * g
        w = w + 0.1 / math.sqrt(1 + k / 20) * (m1 / (1 - 0.9**k)) / (np.sqrt(m2 / (1 - 0.98**k)) + 1e-6)
    return w[:-4], w[-4:].reshape(2, 2)


@dataclass(frozen=True)
class QualityModel:
    """The field and the calibration of its aggregated marginals."""

    chain: Chain
    weights: np.ndarray


def aggregated(chain: Chain, parts: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Features of each document: length-weighted means and the peak of its lines' marginals of being bad."""
    if not parts:
        return np.zeros((0, 5))
    lengths = np.array([len(n) for _, n in parts])
    x = (np.concatenate([x for x, _ in parts]) - chain.mean) / chain.scale
    bad, _, _ = forward_backward(x @ chain.line, lengths, chain.pair)
    size = np.concatenate([n for _, n in parts]) + 1.0
    first = np.cumsum(lengths) - lengths
    share = np.add.reduceat(bad * size, first) / np.add.reduceat(size, first)
    peak = np.maximum.reduceat(bad, first)
    total = np.log(np.add.reduceat(size, first))
    safe = np.clip(share, 1e-4, 1 - 1e-4)
    return np.stack([share, np.log(safe / (1 - safe)) / 4, peak, np.sqrt(share), total / 10], axis=1)


def train(rows: list[tuple[str, int]], chunk: int = 64, passes: int = 3, first_guess: int = 40_000) -> QualityModel:
    """Fit the field on one half of the rows and the calibration on the other.

    All lines of good documents are good. Which lines of a bad document are bad
    isn't known: lines that a line-wise regression holds for bad are taken to be, the worst
    line of each at least, and the field's own marginals replace that guess in
    each further pass. Training chains are cut to ``chunk`` lines. The regression of the first guess takes
    every n-th line of the sample, at most about twice ``first_guess``; the field itself takes all.
    Without rows of both classes every score is the share of good rows.
    """
    rows = unlike(rows)
    first, second = halves(rows)
    share = (sum(y for _, y in rows) + 0.5) / (len(rows) + 1)
    nothing = Chain(np.zeros(WIDE), np.ones(WIDE), np.zeros(WIDE), np.zeros((2, 2)))
    if len({y for _, y in first}) < 2 or len({y for _, y in second}) < 2:
        return QualityModel(nothing, np.array([0, 0, 0, 0, 0, math.log(share / (1 - share))]))
    xs, lengths, doc = [], [], []
    for i, (text, _) in enumerate(first):
        x, _ = line_features(text)
        for a in range(0, len(x), chunk):
            xs.append(x[a : a + chunk])
            lengths.append(len(xs[-1]))
            doc.append(np.full(len(xs[-1]), i))
    x, doc = np.concatenate(xs), np.concatenate(doc)
    mean, scale = x.mean(axis=0), x.std(axis=0)
    mean[-1], scale[-1] = 0, 1
    scale[scale < 1e-9] = 1
    x = (x - mean) / scale
    lengths = np.array(lengths)
    poor = np.array([1 - y for _, y in first])[doc] == 1
    some = np.arange(0, len(x), max(1, len(x) // first_guess))
    bad = probability(x[:, :-1], logistic(x[some][:, :-1], poor[some].astype(float), penalty=1e-2))
    starts = np.flatnonzero(np.diff(doc, prepend=-1))
    line, pair = np.zeros(WIDE), np.zeros((2, 2))
    for k in range(passes):
        worst = np.maximum.reduceat(bad, starts)[doc] if k == 0 else np.maximum(np.maximum.reduceat(bad, starts)[doc], 1e-9)
        labels = (poor & ((bad > 0.5) | (bad >= worst))).astype(float)
        line, pair = fit_chain(x, lengths, labels, line, pair)
        bad, _, _ = forward_backward(x @ line, lengths, pair)
    chain = Chain(mean, scale, line, pair)
    f = aggregated(chain, [line_features(t) for t, _ in second])
    return QualityModel(chain, logistic(f, np.array([y for _, y in second], float)))


def score(df: DataFrame, model: QualityModel, text: str = "text", output: str = "score") -> DataFrame:
    """Add ``score`` (0 to 1, higher: good quality likelier) from all lines of each whole text.

    A null or empty text is one empty line; repeated rows repeat their score;
    very long texts only make longer chains; an empty table stays empty; a column
    called like the output is replaced, others pass through.
    """

    def kernel(column: pa.Array) -> list[pa.Array]:
        parts = [line_features(t or "") for t in column.to_pylist()]
        return [pa.array(probability(aggregated(model.chain, parts), model.weights), pa.float64())]

    return map_columns(df, text, [(output, T.DoubleType())], kernel, batch_bytes=2 << 20)


def fit(documents: DataFrame, labels: DataFrame, per_class: tuple[int, int] = (2500, 2500), modulus: int = 4, held_out: int = 2) -> QualityModel:
    """Train on a random sample of at most ``per_class`` labelled rows (bad, good) outside the held-out remainder."""
    return train(labelled_sample(documents, labels, "quality", modulus, held_out, per_class))


def classify(documents: DataFrame, model: QualityModel, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``documents``; a null id counts as held out."""
    scored = score(documents.select("doc_id", "text"), model)
    return scored.select("doc_id", F.coalesce(remainder("doc_id", 4) == 2, F.lit(True)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
