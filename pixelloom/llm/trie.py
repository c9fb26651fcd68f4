"""The prefix trie of conversations: union-find over the LCP edges of sorted neighbours, deepest first.

A conversation is a path of turn digests. Paths are sorted over the cluster; each chunk of neighbours merges its
components along LCP edges in descending depth, and every merge makes a branching node. Nodes off a chunk's first and last path are
complete; what hangs on these two paths is contracted onto them, and the chunks' paths make the next, much smaller, level.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pixelloom.llm.common import cut

MARK = 16  # bytes of a turn's digest
CHUNK_ROWS = 1 << 15  # paths of a chunk
CHUNK_BYTES = 16 << 20
LEAST_PATHS = 16  # of a chunk, so that every level is much smaller than the last
LAST_BYTES = 32 << 20  # of all paths, from which one task makes the last level
SALTS = 32
EMPTY = hashlib.sha256(b"").hexdigest()

LEVEL = (
    "kind int, conv_id long, depth long, parent_conv_id long, parent_key binary, own_key binary, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, "
    "path binary, sizes binary, hung array<struct<depth:long,n:long,least:long,children:long,leaves:long,saved:long>>, ids string"
)
TYPES = [
    ("kind", pa.int32()), ("conv_id", pa.int64()), ("depth", pa.int64()), ("parent_conv_id", pa.int64()), ("parent_key", pa.binary()), ("own_key", pa.binary()), ("n_convs", pa.int64()), ("n_children", pa.int64()),
    ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()), ("ends_sha256", pa.string()), ("path", pa.binary()), ("sizes", pa.binary()),
    ("hung", pa.list_(pa.struct([(n, pa.int64()) for n in ("depth", "n", "least", "children", "leaves", "saved")]))), ("ids", pa.string()),
]
NODE, PATH, ENDS = 0, 1, 2


def marked(turns: DataFrame) -> DataFrame:
    """conv_id, nth (from 1, by turn, null first; equal turns by digest), mark (digest of role and text), size (UTF-8 bytes of the text).

    Null roles and texts are empty; rows without a conversation are left out.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.substring(F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)), 1, MARK)
    rows = turns.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", digest.alias("mark"), F.octet_length(text).cast("long").alias("size"))
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "mark")
    return rows.withColumn("nth", F.row_number().over(order)).select("conv_id", "nth", "mark", "size")


def rebuilt(turns: DataFrame, every: int = 5, modulus: int = 9) -> DataFrame:
    """conv_id, nth, mark, size of conversations that begin as another does: c takes the first h turns of c - c % every, then its own after h.

    h is crc32 of the decimal c, modulo ``modulus``. A conversation has a row with nth = 0 and no mark besides its turns. Only the
    first ``modulus - 1`` turns of a conversation are gathered, and at most 2 * every - 1 conversations take them.
    """
    rows = cut(marked(turns))
    head = F.crc32(F.col("conv_id").cast("string").cast("binary")) % modulus
    first = rows.where(F.col("nth") < modulus).groupBy(F.col("conv_id").alias("base")).agg(F.sort_array(F.collect_list(F.struct("nth", "mark", "size"))).alias("turns"))
    ids = rows.where("nth = 1").select("conv_id", (F.col("conv_id") - F.col("conv_id") % every).alias("base"), head.cast("int").alias("h"))
    kind = "array<struct<nth:int,mark:binary,size:bigint>>"
    none = F.array(F.struct(F.lit(0).alias("nth"), F.lit(b"").alias("mark"), F.lit(0).cast("long").alias("size"))).cast(kind)
    taken = F.concat(none, F.slice(F.coalesce(F.col("turns").cast(kind), F.array().cast(kind)), F.lit(1), F.col("h")))
    heads = ids.join(first, "base", "left").select("conv_id", F.explode(taken).alias("t")).select("conv_id", "t.nth", "t.mark", "t.size")
    own = rows.where(F.col("nth") > head).select("conv_id", (F.col("nth") + modulus).alias("nth"), "mark", "size")
    return heads.unionByName(own)


def sequences(rows: DataFrame) -> DataFrame:
    """conv_id, path (its turns' digests on end) and sizes (32-bit): one row a conversation, 20 bytes a turn, put together as sorted turns stream by."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, path, sizes = None, [], []

        def made(ids: list, paths: list, lists: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(paths, pa.binary()), pa.array(lists, pa.binary())], names=["conv_id", "path", "sizes"])

        for batch in batches:
            if not batch.num_rows:
                continue
            ids, marks, bytes_ = batch.column("conv_id").to_numpy(), batch.column("mark"), batch.column("size").to_numpy().astype("<u4")
            out: tuple[list, list, list] = ([], [], [])
            starts = [0, *(np.flatnonzero(np.diff(ids)) + 1).tolist(), len(ids)]
            for low, high in zip(starts, starts[1:], strict=False):
                if now is not None and now != ids[low]:
                    for column, value in zip(out, (now, b"".join(path), b"".join(sizes)), strict=True):
                        column.append(value)
                    path, sizes = [], []
                now = int(ids[low])
                held = marks.slice(low, high - low).to_pylist()
                path.append(b"".join(held))
                sizes.append(bytes_[low:high][[len(m) > 0 for m in held]].tobytes())
            if out[0]:
                yield made(*out)
        if now is not None:
            yield made([now], [b"".join(path)], [b"".join(sizes)])

    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "nth").select("conv_id", "mark", "size")
    return ordered.mapInArrow(run, "conv_id long, path binary, sizes binary")


def key_of(path: bytes, depth: int) -> bytes:
    """The name of the node at ``depth`` of ``path``."""
    return hashlib.blake2b(path[: depth * MARK], digest_size=16).digest()


def common(a: bytes, b: bytes) -> int:
    """Turns that two paths share from the start."""
    n = min(len(a), len(b)) // MARK
    x, y = (np.frombuffer(p, "<u8", 2 * n).reshape(n, 2) for p in (a, b))
    apart = (x != y).any(axis=1)
    return int(apart.argmax()) if apart.any() else n


class Part:
    """A component of the union-find: paths that share a node at ``depth``, and what hangs at and below it."""

    __slots__ = ("children", "depth", "first", "ids", "last", "least", "leaves", "n", "path", "saved", "tops", "waiting")

    def __init__(self, path: int, depth: int, first: bool, last: bool) -> None:
        self.path, self.depth, self.first, self.last = path, depth, first, last
        self.clear()
        self.waiting: dict[int, list[int]] = {}

    def clear(self) -> None:
        """Nothing hangs at the node."""
        self.n, self.least, self.children, self.leaves, self.saved = 0, None, 0, 0, 0
        self.tops: list[int] = []  # numbers of the children's rows, which wait for their parent
        self.ids: list[int] = []  # conversations that end at the node

    def hang(self, n: int, least: int | None, children: int, leaves: int, saved: int) -> None:
        self.n, self.children, self.leaves, self.saved = self.n + n, self.children + children, self.leaves + leaves, self.saved + saved
        if least is not None:
            self.least = least if self.least is None else min(self.least, least)


class Forest:
    """The trie of one chunk of sorted paths; ``whole`` where no other chunk is there, so that all nodes are complete."""

    def __init__(self, paths: list[bytes], sizes: list[bytes], whole: bool, keyed: bool) -> None:
        self.paths, self.sizes, self.whole, self.keyed = paths, sizes, whole, keyed
        self.rows: list[list] = []  # conv_id, depth, parent_conv_id, parent_key, own_key, n_convs, n_children, n_leaves, saved_tokens, ends_sha256
        self.ends: list[tuple[bytes, int, str]] = []
        self.hung: list[dict[int, list]] = [{}, {}]  # what hangs on the first and the last path
        top = len(paths) - 1
        self.parts = [Part(i, len(p) // MARK, i == 0, i == top) for i, p in enumerate(paths)]

    def lift(self, part: Part, depth: int) -> None:
        """Move a component's node up to ``depth``: complete nodes on the way give rows, others hang on the first or last path."""
        while part.depth > depth:
            stop = max((d for d in part.waiting if depth <= d < part.depth), default=depth)
            if (part.first or part.last) and not self.whole:
                self.lay_down(part)
            else:
                self.complete(part, stop)
            part.depth = stop
            if stop in part.waiting:
                part.hang(*part.waiting.pop(stop))

    def lay_down(self, part: Part) -> None:
        path = self.paths[part.path]
        if part.n:
            self.hung[0 if part.first else 1][part.depth] = [part.n, part.least, part.children, part.leaves, part.saved]
        if part.tops or part.ids:
            key = key_of(path, part.depth)
            for row in part.tops:
                self.rows[row][3] = key
            if part.ids:
                self.ends.append((key, part.ids[0], ",".join(map(str, part.ids))))
        part.clear()

    def complete(self, part: Part, stop: int) -> None:
        path, n, least = self.paths[part.path], part.n, part.least
        leaves, saved, children = part.leaves if part.children else 1, part.saved, part.children
        sizes = np.frombuffer(self.sizes[part.path], "<u4")[max(stop, 0) : part.depth].tolist()
        for row in part.tops:
            self.rows[row][2] = least
        ends = hashlib.sha256(",".join(map(str, part.ids)).encode()).hexdigest() if part.ids else EMPTY
        for depth in range(part.depth, stop, -1):
            saved += (n - 1) * sizes[depth - 1 - max(stop, 0)] if depth else 0
            key = key_of(path, depth) if self.keyed else None
            self.rows.append([least, depth, least if depth > stop + 1 else None, None, key, n, children, leaves, saved, None if self.keyed else ends])
            children, ends = 1, EMPTY
        part.clear()
        if stop >= 0:
            part.hang(n, least, 1, leaves, saved)
            part.tops.append(len(self.rows) - 1)

    def merge(self) -> None:
        """All components become one, along the edges between neighbours, deepest first."""
        shared = [common(a, b) for a, b in zip(self.paths, self.paths[1:], strict=False)]
        root = list(range(len(self.paths)))

        def find(i: int) -> int:
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        for i in sorted(range(len(shared)), key=lambda i: -shared[i]):
            left, right = find(i), find(i + 1)
            a, b = self.parts[left], self.parts[right]
            self.lift(a, shared[i])
            self.lift(b, shared[i])
            a.hang(b.n, b.least, b.children, b.leaves, b.saved)
            a.ids.extend(b.ids)
            if len(a.tops) < len(b.tops):
                a.tops, b.tops = b.tops, a.tops
            a.tops += b.tops
            a.first, a.last = a.first or b.first, a.last or b.last
            if len(a.waiting) < len(b.waiting):
                a.waiting, b.waiting = b.waiting, a.waiting
            for depth, hung in b.waiting.items():
                if depth in a.waiting:
                    old = a.waiting[depth]
                    least = [x for x in (old[1], hung[1]) if x is not None]
                    a.waiting[depth] = [old[0] + hung[0], min(least, default=None), *(x + y for x, y in zip(old[2:], hung[2:], strict=True))]
                else:
                    a.waiting[depth] = hung
            root[right] = left
            self.parts[right] = None
        self.lift(self.parts[find(0)], -1)

    def records(self) -> Iterator[pa.RecordBatch]:
        """Nodes, the two outer paths and open ends as one table of ``LEVEL``."""
        columns = {n: [] for n, _ in TYPES}
        names = [n for n, _ in TYPES]

        def add(**values) -> None:
            for n in names:
                columns[n].append(values.get(n))

        for row in self.rows:
            add(kind=NODE, **dict(zip(names[1:11], row, strict=True)))
        for key, first, ids in self.ends:
            add(kind=ENDS, own_key=key, conv_id=first, ids=ids)
        if not self.whole:
            for side in (0, -1)[: 1 if self.paths[0] == self.paths[-1] and not self.hung[1] else 2]:
                hung = [dict(zip(("depth", "n", "least", "children", "leaves", "saved"), (d, *h), strict=True)) for d, h in self.hung[side].items()]
                add(kind=PATH, path=self.paths[side], sizes=self.sizes[side], hung=hung)
        yield pa.RecordBatch.from_arrays([pa.array(columns[n], t) for n, t in TYPES], names=names)


def chunks(batches: Iterable[pa.RecordBatch], rows: int, size: int, least: int) -> Iterator[list[pa.RecordBatch]]:
    """Neighbouring slices of sorted rows, up to ``rows`` rows or ``size`` bytes but at least ``least`` rows, however long the paths are."""
    held, n, held_bytes = [], 0, 0
    for batch in batches:
        low = 0
        for i, length in enumerate(pc.binary_length(batch.column("path")).to_pylist()):
            n, held_bytes = n + 1, held_bytes + length + 64
            if n >= rows or held_bytes >= size and n >= least:
                yield [*held, batch.slice(low, i + 1 - low)]
                held, n, held_bytes, low = [], 0, 0, i + 1
        if low < batch.num_rows:
            held.append(batch.slice(low))
    if held:
        yield held


def prefix_trie(paths: DataFrame, chunk_rows: int = CHUNK_ROWS, chunk_bytes: int = CHUNK_BYTES, last_bytes: int = LAST_BYTES) -> DataFrame:
    """conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of every node of ``sequences``.

    The root (depth 0) is there if any conversation is; an empty table gives an empty result. Equal conversations meet in one node, whose ids
    are hashed as they stream by in ascending order. A chunk of paths is what a task holds; copies of one path lie in
    many chunks. Levels are written to the shared folder, so a lost executor's chunks are read again. A conversation is one row of 20 bytes a turn, and so
    has at most 2 GB of them.
    """

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, chunk_rows, chunk_bytes, 1):
            ids, own, sizes = (sum((b.column(c).to_pylist() for b in part), []) for c in ("conv_id", "path", "sizes"))
            forest = Forest(own, sizes, whole=False, keyed=False)
            for component, conv in zip(forest.parts, ids, strict=True):
                component.hang(1, conv, 0, 0, 0)
                component.ids.append(conv)
            forest.merge()
            yield from forest.records()

    def next_level(whole: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in [list(batches)] if whole else chunks(batches, max(chunk_rows, LEAST_PATHS), chunk_bytes, LEAST_PATHS):
                own, sizes, hung = (sum((b.column(c).to_pylist() for b in part), []) for c in ("path", "sizes", "hung"))
                if not own:
                    continue
                forest = Forest(own, sizes, whole=whole, keyed=True)
                for component, path_hung in zip(forest.parts, hung, strict=True):
                    component.waiting = {h["depth"]: [h["n"], h["least"], h["children"], h["leaves"], h["saved"]] for h in path_hung}
                    if component.depth in component.waiting:
                        component.hang(*component.waiting.pop(component.depth))
                forest.merge()
                yield from forest.records()

        return run

    level = cut(paths.repartitionByRange("path", "conv_id").sortWithinPartitions("path", "conv_id").mapInArrow(first, LEVEL))
    ends, nodes = level.where(F.col("kind") == ENDS), level.where(F.col("kind") == NODE)
    parts = 1 << 30
    while True:
        outer = level.where(F.col("kind") == PATH).select("path", "sizes", "hung")
        n, size = outer.agg(F.count(F.lit(1)), F.sum(F.length("path") + F.length("sizes") + 64 * F.size("hung"))).first()
        if not n:
            return nodes.selectExpr(*RESULT)
        parts = min(-(-size // last_bytes), n // LEAST_PATHS, parts // 2)
        if parts <= 1:
            level = cut(outer.repartition(1).sortWithinPartitions("path").mapInArrow(next_level(True), LEVEL))
            nodes = nodes.unionByName(level)
            break
        level = cut(outer.repartitionByRange(parts, "path").sortWithinPartitions("path").mapInArrow(next_level(False), LEVEL))
        nodes = nodes.unionByName(level.where(F.col("kind") == NODE))
    return named(nodes, ends)


RESULT = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def named(nodes: DataFrame, ends: DataFrame) -> DataFrame:
    """Nodes with the parents that were open when they were complete, and the digests of ids that lay in several chunks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest = None, None
        for batch in batches:
            done: tuple[list, list] = ([], [])
            for key, ids in zip(batch.column("own_key"), batch.column("ids"), strict=True):
                if key.as_py() != now:
                    if digest is not None:
                        done[0].append(now)
                        done[1].append(digest.hexdigest())
                    now, digest = key.as_py(), hashlib.sha256(ids.as_py().encode())
                else:
                    digest.update(b"," + ids.as_py().encode())
            if done[0]:
                yield pa.RecordBatch.from_arrays([pa.array(done[0], pa.binary()), pa.array(done[1])], names=["own_key", "sha"])
        if digest is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.binary()), pa.array([digest.hexdigest()])], names=["own_key", "sha"])

    hashed = ends.select("own_key", "conv_id", "ids").repartition("own_key").sortWithinPartitions("own_key", "conv_id").mapInArrow(run, "own_key binary, sha string")
    open_ = nodes.where("own_key IS NOT NULL").join(hashed, "own_key", "left").withColumn("ends_sha256", F.coalesce("sha", F.lit(EMPTY))).drop("sha")
    open_ = cut(open_)
    every = nodes.where("own_key IS NULL").unionByName(open_)
    known = every.where("parent_key IS NULL").selectExpr(*RESULT)
    # The root may have most nodes as children: they spread over salts, and the few open nodes are repeated for each.
    salted = every.where("parent_key IS NOT NULL").withColumn("salt", F.pmod(F.xxhash64("conv_id", "depth"), F.lit(SALTS)))
    parents = open_.select(F.col("own_key").alias("parent_key"), F.col("conv_id").alias("parent")).withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return known.unionByName(salted.join(parents, ["parent_key", "salt"]).withColumn("parent_conv_id", F.col("parent")).selectExpr(*RESULT))
