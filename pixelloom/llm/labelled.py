"""Bounded labelled samples and small calibration helpers for the classifiers."""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelloom.llm.common import remainder


def labelled_sample(documents: DataFrame, labels: DataFrame, label: str, modulus: int, held_out: int, per_class: tuple[int, int], most_chars: int = 100_000) -> list[tuple[str, int]]:
    """At most ``per_class`` (of label 0, of label 1) rows (text, label) whose crc32 remainder isn't the held-out one, one row a doc_id.

    The sample bounds what is learned from, not what is scored: labelled rows in the
    order of a hash of the id, so that it is random and the same in every run. A
    repeated id gives its least text, an id with both labels counts for neither, and texts of more than
    ``most_chars`` characters, of which no sample is needed, are passed over. Only ids
    travel to the documents, as a broadcast of at most the sum of ``per_class``
    rows; at most as many texts come to the driver.
    """
    usable = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & (remainder("doc_id", modulus) != held_out))
    usable = usable.groupBy("doc_id").agg(F.min(label).cast("int").alias("y"), F.max(label).cast("int").alias("other")).where("y = other").select("doc_id", "y")
    order = F.xxhash64("doc_id")
    ids = [r for y in (0, 1) for r in usable.where(F.col("y") == y).orderBy(order, "doc_id").limit(per_class[y]).collect()]
    if not ids:
        return []
    wanted = documents.sparkSession.createDataFrame(ids, usable.schema)
    texts = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).where(F.length("text") <= most_chars)
    rows = texts.join(F.broadcast(wanted), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text")).collect()
    return [(r["text"], r["y"]) for r in sorted(rows, key=lambda r: r["doc_id"])]


def unlike(rows: list[tuple[str, int]]) -> list[tuple[str, int]]:
    """``rows`` without most of the near copies: a text that shares one of three min-hashes of its 5-word shingles with an earlier one goes."""
    seen: set[tuple[int, int]] = set()
    out = []
    for text, y in rows:
        words = text.lower().split()
        h = np.array([zlib.crc32(" ".join(words[i : i + 5]).encode()) for i in range(max(1, len(words) - 4))], np.uint64)
        keys = {(k, int((h * np.uint64(m) & np.uint64(0xFFFFFFFF)).min())) for k, m in enumerate((2654435761, 2246822519, 3266489917))}
        if not keys & seen:
            out.append((text, y))
        seen |= keys
    return out


def halves(rows: list[tuple[str, int]]) -> tuple[list[tuple[str, int]], list[tuple[str, int]]]:
    """Split by a hash of the text, so that equal texts stay together."""
    parts: tuple[list, list] = ([], [])
    for row in rows:
        parts[zlib.crc32(row[0].encode()) >> 7 & 1].append(row)
    return parts


def logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1e-3, rounds: int = 60) -> np.ndarray:
    """Weights of a logistic regression (the last is the constant), by damped Newton steps."""
    x = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    w = np.zeros(x.shape[1])
    ridge = penalty * len(x) * np.eye(len(w))
    ridge[-1, -1] = 1e-9
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ w)
        w += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return w


def linear(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Log odds of a logistic regression, within reason."""
    return np.clip(x @ w[:-1] + w[-1], -30, 30)


def probability(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-linear(x, w)))
