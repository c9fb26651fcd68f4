"""Media columns: MPEG transport streams, written and parsed with numpy.

The writer sends a program association table, a program map table and packetised
elementary stream (PES) packets of one private data stream. The parser finds sync, checks
continuity counters, follows the tables to the elementary streams, puts their
PES packets together and notes presentation times and random-access points.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pixelloom.llm.common import map_columns, utf8_parts

# Fixed values of ISO/IEC 13818-1.
PACKET, SYNC, NULL_PID = 188, 0x47, 0x1FFF
PRIVATE_STREAM, PRIVATE_TYPE = 0xBD, 0x06
# Choices of this writer.
FRAME = 192
UNIT = 16 * FRAME
PMT_PID, DATA_PID, PROGRAM = 0x100, 0x101, 1
TICKS, KEY_EVERY = 3000, 4


@lru_cache(maxsize=64)
def section_crc(data: bytes) -> int:
    """CRC-32 of the MPEG-2 systems layer: polynomial 0x04C11DB7, from all ones, not reflected."""
    crc = 0xFFFFFFFF
    for byte in data:
        crc ^= byte << 24
        for _ in range(8):
            crc = (crc << 1 ^ (0x04C11DB7 if crc & 0x80000000 else 0)) & 0xFFFFFFFF
    return crc


def section_packet(pid: int, section: bytes) -> bytes:
    head = bytes([SYNC, 0x40 | pid >> 8, pid & 255, 0x10, 0])
    return (head + section + section_crc(section).to_bytes(4, "big")).ljust(PACKET, b"\xff")


@lru_cache(maxsize=1)
def table_packets() -> bytes:
    pat = bytes([0x00, 0xB0, 13, 0, 1, 0xC1, 0, 0, PROGRAM >> 8, PROGRAM & 255, 0xE0 | PMT_PID >> 8, PMT_PID & 255])
    pmt = bytes([0x02, 0xB0, 18, PROGRAM >> 8, PROGRAM & 255, 0xC1, 0, 0, 0xE0 | DATA_PID >> 8, DATA_PID & 255, 0xF0, 0, PRIVATE_TYPE, 0xE0 | DATA_PID >> 8, DATA_PID & 255, 0xF0, 0])
    return section_packet(0, pat) + section_packet(PMT_PID, pmt)


def time_field(pts: np.ndarray) -> np.ndarray:
    """The five bytes of a 33-bit presentation time, for each of ``pts``."""
    out = np.empty((len(pts), 5), np.uint8)
    out[:, 0] = 0x21 | (pts >> 29 & 0x0E)
    out[:, 1] = pts >> 22 & 0xFF
    out[:, 2] = (pts >> 14 & 0xFE) | 1
    out[:, 3] = pts >> 7 & 0xFF
    out[:, 4] = (pts << 1 & 0xFE) | 1
    return out


def clock_field(ticks: np.ndarray) -> np.ndarray:
    """The six bytes of a program clock reference with a zero extension."""
    out = np.empty((len(ticks), 6), np.uint8)
    for k in range(4):
        out[:, k] = ticks >> (25 - 8 * k) & 0xFF
    out[:, 4] = (ticks << 7 & 0x80) | 0x7E
    out[:, 5] = 0
    return out


def mux(payload: bytes) -> bytes:
    """A transport stream of ``payload``: one PES packet for each access unit of ``UNIT`` bytes.

    The first packet of every ``KEY_EVERY``-th unit is a random-access point
    with a clock reference; the last packet of a unit is filled up by its
    adaptation field, so the payload's length survives.
    """
    data = np.frombuffer(payload, np.uint8)
    n_units = max(1, -(-len(data) // UNIT))
    unit = np.arange(n_units)
    unit_len = np.minimum(UNIT, len(data) - unit * UNIT)
    key = unit % KEY_EVERY == 0
    pes = np.zeros((n_units, 14), np.uint8)
    pes[:, 2], pes[:, 3] = 1, PRIVATE_STREAM
    pes[:, 4], pes[:, 5] = (unit_len + 8) >> 8, (unit_len + 8) & 255
    pes[:, 6], pes[:, 7], pes[:, 8] = 0x84, 0x80, 5
    pes[:, 9:14] = time_field(unit * TICKS)
    rap_len = np.where(key, 8, 0)  # the adaptation field of a random-access point
    n_packets = -(-(unit_len + 14 + rap_len) // 184)
    total = int(n_packets.sum())
    owner = np.repeat(unit, n_packets)
    first = np.cumsum(n_packets) - n_packets
    number = np.arange(total) - first[owner]
    is_first, is_last = number == 0, number == n_packets[owner] - 1
    room = 184 - np.where(is_first, rap_len[owner], 0)
    stream_len = unit_len + 14
    sent_before = np.where(number == 0, 0, number * 184 - rap_len[owner])
    size = np.minimum(room, stream_len[owner] - sent_before)
    adapt = 184 - size  # bytes of adaptation field, its length byte included
    out = np.full((total, PACKET), 0xFF, np.uint8)
    out[:, 0] = SYNC
    out[:, 1] = np.where(is_first, 0x40, 0) | DATA_PID >> 8
    out[:, 2] = DATA_PID & 255
    out[:, 3] = np.where(adapt > 0, 0x30, 0x10) | np.arange(total) & 15
    has = adapt > 0
    out[has, 4] = adapt[has] - 1
    flags = has & (adapt > 1)
    out[flags, 5] = 0
    rap = first[key]
    out[rap, 5] = 0x50
    out[rap, 6:12] = clock_field(unit[key] * TICKS)
    streams = np.zeros((n_units, UNIT + 14), np.uint8)
    streams[:, :14] = pes
    body = np.zeros(n_units * UNIT, np.uint8)
    body[: len(data)] = data
    streams[:, 14:] = body.reshape(n_units, UNIT)
    rows = np.arange(PACKET)[None, :] >= (PACKET - size)[:, None]
    taken = np.arange(UNIT + 14)[None, :] < stream_len[:, None]
    out[rows] = streams[taken]
    return table_packets() + out.tobytes()


@dataclass
class Stream:
    """What the parser found."""

    packets: int = 0
    lost_bytes: int = 0
    continuity_errors: int = 0
    duplicates: int = 0
    table_errors: int = 0
    programs: dict[int, int] = field(default_factory=dict)
    streams: dict[int, int] = field(default_factory=dict)
    units: list[tuple[int, int, int, int, bool]] = field(default_factory=list)  # pid, pts or -1, offset and length in the pid's data, random access
    data: dict[int, bytes] = field(default_factory=dict)


def synced(data: np.ndarray) -> tuple[np.ndarray, int]:
    """Packets as rows, and how many bytes lie outside of any; sync is looked for again after damage."""
    n = len(data) // PACKET
    if n and len(data) == n * PACKET and (data[::PACKET] == SYNC).all():
        return data.reshape(n, PACKET), 0
    rows, at, lost = [], 0, 0
    while at + PACKET <= len(data):
        if data[at] == SYNC and (at + PACKET == len(data) or at + PACKET < len(data) and data[at + PACKET] == SYNC or at + 2 * PACKET > len(data)):
            rows.append(data[at : at + PACKET])
            at += PACKET
        else:
            at, lost = at + 1, lost + 1
    return (np.stack(rows) if rows else np.zeros((0, PACKET), np.uint8)), lost + len(data) - at


def sections(packets: np.ndarray, start: np.ndarray, body_at: np.ndarray, table: int) -> tuple[list[bytes], int]:
    """Whole sections with a valid checksum of one table, and how many were damaged."""
    good, bad, held = [], 0, b""
    for row, begins, at in zip(packets, start, body_at, strict=True):
        body = row[at:].tobytes()
        if begins:
            held = body[1 + body[0] :] if body else b""
        elif held:
            held += body
        while len(held) >= 3 and held[0] != 0xFF:
            size = 3 + ((held[1] & 15) << 8 | held[2])
            if len(held) < size:
                break
            section, held = held[:size], held[size:]
            if section_crc(section):
                bad += 1
            elif section[0] == table:
                good.append(section)
    return good, bad


def demux(stored: bytes) -> Stream:
    """Parse a transport stream; see the module's docstring."""
    out = Stream()
    packets, out.lost_bytes = synced(np.frombuffer(stored, np.uint8))
    out.packets = len(packets)
    if not len(packets):
        return out
    pid = (packets[:, 1] & 0x1F).astype(np.int32) << 8 | packets[:, 2]
    start = packets[:, 1] & 0x40 > 0
    broken = packets[:, 1] & 0x80 > 0
    control = packets[:, 3] >> 4 & 3
    counter = packets[:, 3] & 15
    has_adapt, has_body = control & 2 > 0, control & 1 > 0
    adapt_len = np.where(has_adapt, packets[:, 4].astype(np.int64) + 1, 0)
    flags = np.where(has_adapt & (adapt_len > 1), packets[:, 5], 0)
    body_at = np.minimum(4 + adapt_len, PACKET)

    def usable(which: int) -> np.ndarray:
        """Indices of a pid's packets with payload, after the continuity check."""
        at = np.flatnonzero((pid == which) & has_body & ~broken)
        if len(at) > 1:
            step = (counter[at[1:]].astype(np.int64) - counter[at[:-1]]) & 15
            same = np.concatenate([[False], (step == 0) & (packets[at[1:]] == packets[at[:-1]]).all(axis=1)])
            announced = np.concatenate([[False], flags[at[1:]] & 0x80 > 0])
            jumped = np.concatenate([[False], step != 1]) & ~same & ~announced
            out.duplicates += int(same.sum())
            out.continuity_errors += int(jumped.sum())
            at = at[~same]
        return at

    at = usable(0)
    tables, bad = sections(packets[at], start[at], body_at[at], 0)
    out.table_errors += bad
    for s in tables:
        for k in range(8, len(s) - 4, 4):
            number, where = s[k] << 8 | s[k + 1], (s[k + 2] & 31) << 8 | s[k + 3]
            if number:
                out.programs[number] = where
    for where in sorted(set(out.programs.values())):
        at = usable(where)
        tables, bad = sections(packets[at], start[at], body_at[at], 2)
        out.table_errors += bad
        for s in tables:
            k = 12 + ((s[10] & 15) << 8 | s[11])
            while k + 5 <= len(s) - 4:
                out.streams[(s[k + 1] & 31) << 8 | s[k + 2]] = s[k]
                k += 5 + ((s[k + 3] & 15) << 8 | s[k + 4])
    for which in sorted(out.streams):
        elementary(out, which, usable(which), packets, start, flags, body_at)
    return out


def elementary(out: Stream, which: int, at: np.ndarray, packets: np.ndarray, start: np.ndarray, flags: np.ndarray, body_at: np.ndarray) -> None:
    """Put the PES packets of one pid together."""
    begins = np.flatnonzero(start[at])
    if not len(begins):
        out.data[which] = b""
        return
    at = at[begins[0] :]
    begins = begins - begins[0]
    rows = packets[at]
    body = rows[np.arange(PACKET)[None, :] >= body_at[at][:, None]]
    ends = np.cumsum(PACKET - body_at[at])
    lows = np.concatenate([[0], ends])[begins]
    highs = np.concatenate([lows[1:], ends[-1:]])
    parts, offset = [], 0
    for low, high, first in zip(lows.tolist(), highs.tolist(), at[begins].tolist(), strict=True):
        head = body[low : low + 14].tobytes()
        if len(head) < 9 or head[:3] != b"\x00\x00\x01":
            continue
        size = head[4] << 8 | head[5]
        stop = min(high, low + 6 + size) if size else high
        begin = low + 9 + head[8]
        pts = -1
        if head[7] & 0x80 and len(head) >= 14:
            pts = (head[9] >> 1 & 7) << 30 | head[10] << 22 | head[11] >> 1 << 15 | head[12] << 7 | head[13] >> 1
        part = body[begin:stop]
        parts.append(part)
        out.units.append((which, pts, offset, len(part), bool(flags[first] & 0x40)))
        offset += len(part)
    out.data[which] = np.concatenate(parts).tobytes() if parts else b""


def store_streams(df: DataFrame, text: str = "text", media: str = "media") -> DataFrame:
    """Replace ``text`` by ``media`` (binary): its UTF-8 bytes, padded with spaces to whole frames of 192, as a transport stream.

    ``n_bytes`` has the unpadded length. Null counts as empty, and empty texts get
    one frame of spaces; the longest text makes the longest stream. Repeated rows
    give equal streams; columns with the names of the outputs are replaced.
    """

    def kernel(column: pa.Array) -> list[pa.Array]:
        data, starts, sizes = utf8_parts(column)
        raw = data.tobytes()
        made = [mux(raw[a : a + n].ljust(max(1, -(-n // FRAME)) * FRAME, b" ")) for a, n in zip(starts.tolist(), sizes.tolist(), strict=True)]
        return [pa.array(made, pa.binary()), pa.array(sizes, pa.int64())]

    return map_columns(df, text, [(media, T.BinaryType()), ("n_bytes", T.LongType())], kernel).drop(text)


UNITS = T.ArrayType(T.StructType([T.StructField("pid", T.IntegerType()), T.StructField("pts", T.LongType()), T.StructField("offset", T.LongType()), T.StructField("length", T.LongType()), T.StructField("random_access", T.BooleanType())]))


def read_streams(df: DataFrame, media: str = "media") -> DataFrame:
    """Parse stored streams: ``payload`` (binary, of all elementary streams by pid), ``units`` and counters.

    ``units`` lists pid, presentation time (90 kHz; -1: none), offset and length
    in the pid's data, and whether a decoder can start there. Damage never
    raises: null or unreadable streams give an empty payload and no units, and what was lost
    shows in ``lost_bytes``, ``continuity_errors`` and ``table_errors``.
    """
    counters = ["packets", "lost_bytes", "continuity_errors", "duplicates", "table_errors"]

    def kernel(column: pa.Array) -> list[pa.Array]:
        found = [demux(x or b"") for x in column.to_pylist()]
        payload = [b"".join(s.data[p] for p in sorted(s.data)) for s in found]
        kind = pa.list_(pa.struct([("pid", pa.int32()), ("pts", pa.int64()), ("offset", pa.int64()), ("length", pa.int64()), ("random_access", pa.bool_())]))
        counts = np.array([len(s.units) for s in found])
        flat = [u for s in found for u in s.units]
        columns = list(zip(*flat, strict=True)) if flat else [[]] * 5
        struct = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, kind.value_type, strict=True)], fields=list(kind.value_type))
        units = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), struct)
        return [pa.array(payload, pa.binary()), units, *[pa.array([getattr(s, c) for s in found], pa.int64()) for c in counters]]

    outputs = [("payload", T.BinaryType()), ("units", UNITS), *[(c, T.LongType()) for c in counters]]
    return map_columns(df, media, outputs, kernel)


def random_access_index(df: DataFrame, *keys: str) -> DataFrame:
    """One row per random-access point of ``read_streams``: keys, pid, pts, offset."""
    return df.select(*keys, F.explode("units").alias("unit")).where("unit.random_access").select(*keys, "unit.pid", "unit.pts", "unit.offset")
