"""Token counts: batch encoding inside Arrow functions that return lengths only."""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from pixelloom.llm.common import held, map_columns, utf8_parts

MARK = "▁"  # the library's word mark
SPACE_END = re.compile(r"[^\S ] | [^\S ]")  # other white space beside a space


class PieceCounter:
    """Counts of a sentencepiece model, by segments that don't influence each other.

    A segment ends at a single space between two other characters. The library
    turns that space, like the start of a text, into its word mark; when no piece
    of the model has the mark after another character, no merge crosses it, and
    the counts of the segments add up to the count of the text. Recurring
    segments are counted once; new ones are encoded in batches of equal bytes.
    """

    def __init__(self, path: str, keep: int = 800_000, batch_bytes: int = 1 << 20):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = (self.model.id_to_piece(i) for i in range(self.model.get_piece_size()))
        self.splits = not any(MARK in p.lstrip(MARK) for p in pieces) and self.additive()
        self.keep, self.batch_bytes = keep, batch_bytes
        self.known: dict[str, int] = {}

    def additive(self) -> bool:
        """Whether the model adds the word mark at the start of a text and keeps inner space."""
        count = lambda s: len(self.model.encode(s))
        return count("a b") == count("a") + count("b") and count("a  b") > count("a b") - 1 and self.model.encode(" a") != self.model.encode("a")

    def segments(self, text: str) -> list[str]:
        """Cuts at the safe spaces; runs of spaces stay inside one segment."""
        if not self.splits:
            return [text]
        parts = text.split(" ")
        if "" not in parts and MARK not in text and SPACE_END.search(text) is None:
            return parts
        out = [parts[0]]
        for p in parts[1:]:
            left, right = out[-1][-1:], p[:1]
            if left and right and not (left.isspace() or right.isspace() or MARK in (left, right)):
                out.append(p)
            else:
                out[-1] += " " + p
        return out

    def counts(self, texts: list[str | None]) -> np.ndarray:
        if len(self.known) > self.keep:
            self.known.clear()
        known = self.known
        rows = [self.segments(t) if t else [] for t in texts]
        fresh = list({s for row in rows for s in row if s not in known})
        fresh.sort(key=len)
        start = 0
        while start < len(fresh):  # sorted by length, so that a batch's rows are alike and its bytes bounded
            stop = start + max(1, min(len(fresh) - start, self.batch_bytes // (len(fresh[start]) + 1)))
            while stop - start > 1 and (stop - start) * len(fresh[stop - 1]) > 4 * self.batch_bytes:
                stop = start + (stop - start) // 2
            known.update(zip(fresh[start:stop], map(len, self.model.encode(fresh[start:stop], num_threads=1)), strict=True))
            start = stop
        return np.array([sum(map(known.__getitem__, row)) for row in rows], np.int64)


def piece_counter(path: str) -> PieceCounter:
    return held(("pieces", path), lambda: PieceCounter(path))


@lru_cache(maxsize=2)
def json_tokenizer(path: str):
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(path)
    made.no_truncation()
    made.no_padding()
    return made


def count_tokens(df: DataFrame, vocabulary: str, text: str = "text", limit: int = 4096, batch_bytes: int = 8 << 20) -> DataFrame:
    """Add ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit`` (more than ``limit`` tokens).

    ``vocabulary`` is a path that every executor has: a ``.model`` file is counted by
    sentencepiece, a ``.json`` file by tokenizers, without begin, end or added special
    tokens, truncation or padding. A null or empty text has 0 bytes and 0 tokens.
    Very long texts of a ``.model`` are cut at single spaces, where that can't
    change a count, so no batch holds more than ``batch_bytes`` of text but for one
    longer row. Repeated rows repeat their result; an empty table stays empty; columns
    with the names of the outputs are replaced, others pass through.
    """

    def kernel(column: pa.Array) -> list[pa.Array]:
        _, _, sizes = utf8_parts(column)
        texts = column.to_pylist()
        if vocabulary.endswith(".model"):
            counts = piece_counter(vocabulary).counts(texts)
        else:
            tokenizer = json_tokenizer(vocabulary)
            counts = np.array([len(tokenizer.encode(t or "", add_special_tokens=False)) for t in texts], np.int64)
        return [pa.array(sizes, pa.int64()), pa.array(counts, pa.int64()), pa.array(counts > limit)]

    outputs = [("n_bytes", T.LongType()), ("n_tokens", T.LongType()), ("over_limit", T.BooleanType())]
    return map_columns(df, text, outputs, kernel, batch_bytes=batch_bytes)
