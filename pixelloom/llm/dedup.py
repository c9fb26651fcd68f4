"""Near-duplicate classes: Order MinHash candidates, verified by banded alignment of five-word shingles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pixelloom.functions.graph import components
from pixelloom.llm.common import cut, map_columns
from pixelloom.llm.sketch import labelled, mixed, order_minhash, shingles, similarity, word_hashes

BANDS, PER_BAND, SAMPLE = 20, 2, 2
DENSE = 16  # shingles in more texts of a block than this are counted by a matrix product
BLOCK = 512


def band_keys(words: np.ndarray) -> np.ndarray:
    """One 64-bit key per band; each joins ``PER_BAND`` Order MinHash values of ``SAMPLE`` shingles."""
    s = shingles(words)
    if not len(s):
        return np.zeros(0, np.int64)
    values = order_minhash(s, BANDS * PER_BAND, SAMPLE).reshape(BANDS, PER_BAND)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for k in range(PER_BAND):
        key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + values[:, k])
    return key.view(np.int64)


def digest(words: np.ndarray, text: str | None) -> bytes:
    """A 128-bit hash of the words, of the text itself where it has none."""
    return xxhash.xxh3_128_digest(words.tobytes() if len(words) else b"text:" + (text or "").encode(errors="replace"))


def sketched(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    """doc_id, ``same`` (the ``digest``) and ``bands``."""

    def kernel(column: pa.Array) -> list[pa.Array]:
        same, bands = [], []
        for t in column.to_pylist():
            words = word_hashes().of(t or "")
            same.append(digest(words, t))
            bands.append(band_keys(words))
        offsets = np.concatenate([[0], np.cumsum([len(b) for b in bands])]).astype(np.int32)
        flat = np.concatenate(bands) if bands else np.zeros(0, np.int64)
        return [pa.array(same, pa.binary()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))]

    source = df.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    return map_columns(source, "text", [("same", T.BinaryType()), ("bands", T.ArrayType(T.LongType()))], kernel).drop("text")


def common_counts(texts: list[np.ndarray]) -> np.ndarray:
    """How many labelled shingles each two of the texts share."""
    n = len(texts)
    owner = np.repeat(np.arange(n), [len(t) for t in texts])
    values = np.concatenate(texts)
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    edge = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1], [True]]))
    size = np.diff(edge)
    counts = np.zeros(n * n)
    first = edge[:-1]
    for k in np.unique(size[(size >= 2) & (size <= DENSE)]).tolist():
        at = first[size == k]
        for low in range(0, len(at), 4096):
            rows = owner[at[low : low + 4096][:, None] + np.arange(k)]
            pairs = rows[:, :, None] * n + rows[:, None, :]
            counts += np.bincount(pairs.ravel(), minlength=n * n)
    counts = counts.reshape(n, n)
    wide = np.flatnonzero(size > DENSE)
    for low in range(0, len(wide), 2048):
        part = wide[low : low + 2048]
        dense = np.zeros((n, len(part)), np.float32)
        column = np.repeat(np.arange(len(part)), size[part])
        at = np.repeat(first[part] - (np.cumsum(size[part]) - size[part]), size[part]) + np.arange(int(size[part].sum()))
        dense[owner[at], column] = 1
        counts += dense @ dense.T
    return counts


def linked(ids: list[int], texts: list[np.ndarray], asked: list[bool], least: float) -> list[tuple[int, int]]:
    """A spanning forest of the links (similarity of at least ``least``) between the texts of one task.

    If some are ``asked`` for and some aren't, only pairs of one of either are compared; else all are.
    The number of common shingles bounds the similarity from above; pairs that
    it leaves are aligned, the most alike first, but for those that are already
    connected.
    """
    if len(ids) < 2:
        return []
    marked = [labelled(t) for t in texts]
    size = np.array([len(t) for t in texts], float)
    common = common_counts(marked)
    bound = common / np.maximum(size[:, None] + size[None, :] - common, 1)
    able = np.triu(bound >= least - 1e-9, 1)
    side = np.array(asked)
    if side.any() and not side.all():
        able &= side[:, None] != side[None, :]
    rows, cols = np.nonzero(able)
    parent = list(range(len(ids)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for k in np.argsort(-bound[rows, cols], kind="stable").tolist():
        a, b = int(rows[k]), int(cols[k])
        if ids[a] != ids[b] and root(a) != root(b) and similarity(texts[a], texts[b], least):
            parent[root(a)] = root(b)
            out.append((ids[a], ids[b]))
    return out


def counted(df: DataFrame, key: str, by: str, salts: int = 64) -> DataFrame:
    """``df`` with ``n``, the rows of its key, and ``first``, the least ``by`` among them; keys of one row go.

    Counts come together in salted groups, and rows find them by key and salt, so a key that a
    third of all rows have is spread over ``salts`` tasks.
    """
    salted = df.withColumn("salt", F.pmod(F.xxhash64(by), F.lit(salts)).cast("int"))
    parts = salted.groupBy(key, "salt").agg(F.count(F.lit(1)).alias("n"), F.min(by).alias("first"))
    whole = parts.groupBy(key).agg(F.sum("n").alias("n"), F.min("first").alias("first")).where("n > 1")
    return salted.join(parts.select(key, "salt").join(whole, key), [key, "salt"]).drop("salt")


def with_shingles(tasks: DataFrame, source: DataFrame, text: str) -> DataFrame:
    """Tasks (lead, i, j) over texts (rep, asked) with the shingles of each text."""
    wanted = source.join(tasks.select("rep").distinct(), "rep").groupBy("rep").agg(F.min("text").alias("text"))

    def kernel(column: pa.Array) -> list[pa.Array]:
        return [pa.array([shingles(word_hashes().of(t or "")).tobytes() for t in column.to_pylist()], pa.binary())]

    read = map_columns(wanted, "text", [("shingles", T.BinaryType())], kernel).drop("text")
    return tasks.join(read, "rep").select("lead", "i", "j", "rep", "asked", "shingles")


def compared(tasks: DataFrame, least: float) -> DataFrame:
    """Links (a, b) found by tasks ``with_shingles``."""
    ready = tasks.repartition("lead", "i", "j").sortWithinPartitions("lead", "i", "j", "rep")
    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, texts, asked = None, [], [], []
        out: list[tuple[int, int]] = []
        for batch in batches:
            for lead, i, j, rep, side, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (lead, i, j) != now:
                    out += linked(ids, texts, asked, least)
                    now, ids, texts, asked = (lead, i, j), [], [], []
                ids.append(rep)
                asked.append(side)
                texts.append(np.frombuffer(data, np.uint64))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([e[k] for e in out], pa.int64()) for k in (0, 1)], names=["a", "b"])
                out = []
        out = linked(ids, texts, asked, least)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([e[k] for e in out], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return ready.mapInArrow(run, schema)


def links(df: DataFrame, reps: DataFrame, doc_id: str, text: str, least: float, block: int = BLOCK) -> DataFrame:
    """Links (a, b) between representatives that share a band, enough to connect all that are linked.

    The least text of a bucket leads it; texts that share a leader
    form a group, so each two that share a bucket meet in one. A group of up to ``block`` texts is compared
    in one task. In a larger one all texts are first compared with the leader, in blocks; only
    those that aren't linked to it are then compared with the others, block by block: with the size
    of a group of true copies the work grows in proportion.
    """
    source = df.select(F.col(doc_id).cast("long").alias("rep"), F.col(text).cast("string").alias("text"))
    members = counted(reps.select("rep", F.explode("bands").alias("bucket")), "bucket", "rep")
    groups = cut(counted(members.select(F.col("first").alias("lead"), "rep").distinct(), "lead", "rep").select("lead", "rep", "n"))
    small = groups.where(F.col("n") <= block).select("lead", F.lit(0).alias("i"), F.lit(0).alias("j"), "rep", F.lit(True).alias("asked"))
    large = groups.where(F.col("n") > block)
    if large.isEmpty():
        return compared(with_shingles(small, source, text), least)

    def part(column: str) -> F.Column:
        return F.pmod(F.xxhash64(column), F.ceil(F.col("n") / block)).cast("int")

    blocks = large.withColumn("j", part("rep"))
    others = blocks.where("rep <> lead").select("lead", F.lit(0).alias("i"), "j", "rep", F.lit(False).alias("asked"))
    leaders = others.select("lead", "i", "j").distinct().select("lead", "i", "j", F.col("lead").alias("rep"), F.lit(True).alias("asked"))
    ready = cut(with_shingles(others.unionByName(leaders).unionByName(small.withColumn("i", F.lit(-1))), source, text))
    near = cut(compared(ready, least))
    star = near.select(F.explode(F.array(F.struct(F.col("a").alias("lead"), F.col("b").alias("rep")), F.struct(F.col("b").alias("lead"), F.col("a").alias("rep")))).alias("e")).select("e.*").distinct()
    # Of each large group: what the leader didn't take, in blocks of its own, against every block of the group.
    left = cut(blocks.where("rep <> lead").join(star, ["lead", "rep"], "left_anti").select("lead", "rep", "n"))
    if left.isEmpty():
        return near
    twice = counted(left.select("lead", "rep").union(left.select("lead", "rep")), "lead", "rep").select("lead", "rep", F.col("n").alias("twice")).distinct()
    asking = twice.select("lead", "rep", F.pmod(F.xxhash64("rep"), F.ceil(F.col("twice") / 2 / block)).cast("int").alias("i"))
    own = asking.select("lead", "i").distinct()
    every = blocks.select("lead", "j").distinct()
    met = own.join(every, "lead")
    asked = asking.join(met, ["lead", "i"]).select("lead", "i", "j", "rep", F.lit(True).alias("asked"))
    answers = blocks.select("lead", "j", "rep").join(met, ["lead", "j"]).select("lead", "i", "j", "rep", F.lit(False).alias("asked"))
    texts = ready.where("i = 0").join(left.select("lead").distinct(), "lead", "left_semi").select("rep", "shingles").dropDuplicates(["rep"])
    rest = asked.unionByName(answers).join(texts, "rep").select("lead", "i", "j", "rep", "asked", "shingles")
    return near.unionByName(compared(rest, least))


def further_texts(reps: DataFrame) -> DataFrame | None:
    """same, rep, node: a number that no id has for each further text that represents the same id; None where every id represents one text.

    An id keeps its own number for the text with the least ``same``. The numbers lie above the ids, or below where those reach 2^62.
    """
    named = reps.where("rep IS NOT NULL").select(F.col("rep").cast("long").alias("rep"), "same")
    more = cut(counted(named, "rep", "same").where("same <> first").select("same", "rep").withColumn("nth", F.monotonically_increasing_id() + 1))
    if more.isEmpty():
        return None
    low, high = named.agg(F.min("rep"), F.max("rep")).first()
    node = F.lit(high) + F.col("nth") if high < 1 << 62 else F.lit(low) - F.col("nth")
    return more.select("same", "rep", node.alias("node"))


def by_node(source: DataFrame, more: DataFrame) -> DataFrame:
    """rep, text of ``source`` with the number of each text from ``further_texts`` in place of its id."""

    def kernel(column: pa.Array) -> list[pa.Array]:
        return [pa.array([digest(word_hashes().of(t or ""), t) for t in column.to_pylist()], pa.binary())]

    shared = more.select("rep").distinct()
    told = map_columns(source.join(shared, "rep", "left_semi"), "text", [("same", T.BinaryType())], kernel)
    renamed = told.join(more.select("same", "node"), "same", "left").select(F.coalesce("node", "rep").alias("rep"), "text")
    return source.join(shared, "rep", "left_anti").select("rep", "text").unionByName(renamed)


def least_ids(roots: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, root with the least id (``rep`` of ``nodes``) of each component as its root."""
    whole = roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
    return counted(whole.join(nodes.select("node", "rep"), "node"), "root", "rep").select("node", F.col("first").alias("root"))


def near_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text", least: float = 0.8) -> DataFrame:
    """doc_id, rep_id, class_id for every row of ``df``: near-duplicate classes.

    Two texts are linked when their sequences of five-word shingles (words are runs of letters,
    digits and underscores in lower case) have an in-order Jaccard similarity of at least ``least``:
    the longest common subsequence over all shingles of both, found within the band that
    the threshold allows. Classes are the connected components; ``class_id`` is the least id of
    the class and ``rep_id`` the least id among texts with the same words.

    Texts with the same words are joined first, by a partially aggregated
    minimum, however many there are. Candidates share one of 20 bands of 2
    Order MinHash values of 2 occurrence-labelled shingles in text order; a pair at the threshold is
    missed with a probability of about 3e-5, and every candidate is verified.
    A text of fewer than five words is one shingle; one without words is only linked to equal texts; null
    counts as empty. Repeated rows each get their class; different texts under one id are linked and classed
    each for itself; rows with a null id get the ids of
    their class, or null where no row of it has an id; ids are integers; other columns are dropped.
    """
    marked = cut(sketched(df, doc_id, text))
    reps = marked.groupBy("same").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands"))
    reps = cut(reps)
    source = df.select(F.col(doc_id).cast("long").alias("rep"), F.col(text).cast("string").alias("text"))
    nodes = reps.withColumn("node", F.col("rep").cast("long"))
    more = further_texts(reps)
    if more is not None:
        source = by_node(source, more)
        nodes = reps.join(more.select("same", "node"), "same", "left").withColumn("node", F.coalesce("node", F.col("rep").cast("long")))
    able = nodes.where("node IS NOT NULL AND size(bands) > 0")
    roots = components(links(source, able.select(F.col("node").alias("rep"), "bands"), "rep", "text", least))
    if more is not None:
        roots = least_ids(roots, nodes)
    labels = nodes.select("same", "rep", "node").join(roots, "node", "left").select("same", "rep", F.coalesce("root", "rep").alias("class_id"))
    return marked.select("doc_id", "same").join(labels, "same").select("doc_id", F.col("rep").alias("rep_id"), "class_id")
