"""Operator 10: media columns in MPEG transport streams.

A payload is cut into access units; each becomes one packetised elementary stream (PES) packet with a presentation
time, carried in 188-byte transport packets. Program tables (PAT, PMT) stand at the start and are repeated. The first
packet of each PES packet is a random-access point with a clock reference. Reading parses the tables, follows the
stream that they name, checks sync bytes, table checksums and continuity counters, reassembles the PES packets and
gives payload, times and random-access points.

A text is stored as its UTF-8 bytes, padded with zeros to a positive multiple of 64 (null and empty: 64 zeros). Equal
texts give equal bytes. Repeated rows give repeated rows, an empty table an empty result.

A packet that repeats the one before it of its stream is legal and left out. Other jumps of a continuity counter are
counted as gaps. A unit that a lost packet left incomplete raises an error, or, with strict=False, is left out and
counted as damaged, and all other units are read. Any other damage raises an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeworks.llm.shared import slices

PACKET, UNIT, TABLES_EVERY = 188, 16_384, 16
PMT_PID, DATA_PID, STREAM_ID, STREAM_TYPE, PROGRAM = 0x1000, 0x101, 0xBD, 0x06, 1
CLOCK, STEP = 90_000, 3_600  # ticks a second; ticks from unit to unit


def _crc_table() -> list[int]:
    out = []
    for byte in range(256):
        r = byte << 24
        for _ in range(8):
            r = (r << 1 ^ 0x04C11DB7) & 0xFFFFFFFF if r & 0x80000000 else r << 1
        out.append(r)
    return out


_CRC = _crc_table()


def crc32_mpeg(data: bytes) -> int:
    r = 0xFFFFFFFF
    for b in data:
        r = (r << 8 & 0xFFFFFFFF) ^ _CRC[r >> 24 ^ b]
    return r


def _section(table: int, number: int, body: bytes) -> bytes:
    head = bytes([table]) + (0xB000 | len(body) + 9).to_bytes(2, "big") + number.to_bytes(2, "big") + b"\xc1\x00\x00"
    return head + body + crc32_mpeg(head + body).to_bytes(4, "big")


_PAT = _section(0, 1, PROGRAM.to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big"))
_PMT = _section(2, PROGRAM, (0xE000 | DATA_PID).to_bytes(2, "big") + b"\xf0\x00" + bytes([STREAM_TYPE]) + (0xE000 | DATA_PID).to_bytes(2, "big") + b"\xf0\x00")


def _table_packet(pid: int, count: int, section: bytes) -> bytes:
    return (b"\x47" + (0x4000 | pid).to_bytes(2, "big") + bytes([0x10 | count & 15, 0]) + section).ljust(PACKET, b"\xff")


def _time(t: int) -> bytes:
    """33 bits with marker bits."""
    return bytes([0x21 | t >> 29 & 0x0E, t >> 22 & 0xFF, t >> 14 & 0xFE | 1, t >> 7 & 0xFF, t << 1 & 0xFE | 1])


def write_stream(payload: bytes) -> bytes:
    out, tables, count = [], 0, 0
    for k, at in enumerate(range(0, len(payload), UNIT)):
        if k % TABLES_EVERY == 0:
            out += [_table_packet(0, tables, _PAT), _table_packet(PMT_PID, tables, _PMT)]
            tables += 1
        unit, pts = payload[at : at + UNIT], (CLOCK + k * STEP) % (1 << 33)
        pes = b"\x00\x00\x01" + bytes([STREAM_ID]) + (len(unit) + 8).to_bytes(2, "big") + b"\x84\x80\x05" + _time(pts) + unit
        clock = bytes([0x50]) + ((pts - STEP) % (1 << 33) << 15 | 0x7E00).to_bytes(6, "big")
        first = min(len(pes), PACKET - 4 - 8)
        n = 1 + -(-(len(pes) - first) // (PACKET - 4))
        packets = np.full((n, PACKET), 0xFF, np.uint8)
        packets[:, 0] = 0x47
        packets[:, 1], packets[:, 2] = DATA_PID >> 8, DATA_PID & 0xFF
        packets[0, 1] |= 0x40
        packets[:, 3] = 0x10 | (count + np.arange(n)) % 16
        count += n
        field = PACKET - 4 - first  # of the first packet: clock reference, then stuffing
        packets[0, 3] |= 0x20
        packets[0, 4:12] = np.frombuffer(bytes([field - 1]) + clock, np.uint8)
        raw = np.frombuffer(pes, np.uint8)
        packets[0, PACKET - first :] = raw[:first]
        rest = raw[first:]
        whole = len(rest) // (PACKET - 4)
        packets[1 : 1 + whole, 4:] = rest[: whole * (PACKET - 4)].reshape(whole, PACKET - 4)
        if left := len(rest) - whole * (PACKET - 4):
            field = PACKET - 4 - left
            packets[-1, 3] |= 0x20
            packets[-1, 4] = field - 1
            if field > 1:
                packets[-1, 5] = 0
            packets[-1, PACKET - left :] = rest[-left:]
        out.append(packets.tobytes())
    return b"".join(out)


def _body(packet: np.ndarray, table: int) -> bytes:
    raw = packet.tobytes()
    at = 5 + raw[4]
    section = raw[at : at + 3 + (int.from_bytes(raw[at + 1 : at + 3], "big") & 0xFFF)]
    if section[0] != table or crc32_mpeg(section):
        raise ValueError("a program table is damaged")
    return section[8:-4]


def read_stream(media: bytes, strict: bool = True) -> dict:
    """payload, times (of each unit), points (packet number of each random-access point), packets, gaps, damaged, program, stream_type."""
    packets = np.frombuffer(media, np.uint8)
    if len(packets) % PACKET or not len(packets):
        raise ValueError("not a whole number of packets")
    packets = packets.reshape(-1, PACKET)
    if (packets[:, 0] != 0x47).any():
        raise ValueError("a sync byte is missing")
    pid = (packets[:, 1].astype(np.int32) & 0x1F) << 8 | packets[:, 2]
    start, control, count = packets[:, 1] & 0x40 > 0, packets[:, 3] >> 4 & 3, packets[:, 3] & 15
    entries = {_body(p, 0) for p in packets[(pid == 0) & start]}
    if len(entries) != 1:
        raise ValueError("no program association, or several")
    entry = entries.pop()
    program, pmt = int.from_bytes(entry[:2], "big"), int.from_bytes(entry[2:4], "big") & 0x1FFF
    maps = {_body(p, 2) for p in packets[(pid == pmt) & start]}
    if len(maps) != 1:
        raise ValueError("no program map, or several")
    streams = maps.pop()
    streams = streams[4 + (int.from_bytes(streams[2:4], "big") & 0xFFF) :]
    kind, data_pid = streams[0], int.from_bytes(streams[1:3], "big") & 0x1FFF
    gaps, rows = 0, {}
    for p in (0, pmt, data_pid):
        at = np.flatnonzero((pid == p) & (control & 1 > 0))
        c = count[at].astype(np.int32)
        again = np.concatenate([[False], (c[1:] == c[:-1]) & (packets[at[1:]] == packets[at[:-1]]).all(axis=1)]) if len(at) else np.zeros(0, bool)
        rows[p], c = at[~again], c[~again]
        gaps += int(((c[1:] - c[:-1]) % 16 != 1).sum())
    where = rows[data_pid]
    mine = packets[where]
    has_field = packets[where, 3] & 0x20 > 0
    begin = 4 + np.where(has_field, mine[:, 4].astype(np.int32) + 1, 0)
    points = where[has_field & (mine[:, 4] > 0) & (mine[:, 5] & 0x40 > 0)]
    stream = mine[np.arange(PACKET)[None, :] >= begin[:, None]].tobytes()
    off = np.concatenate([[0], np.cumsum(PACKET - begin)])
    cuts = [*off[:-1][start[where]].tolist(), len(stream)]
    payload, times, damaged = [], [], 0
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        pes = stream[a:b]
        if pes[:3] != b"\x00\x00\x01" or pes[3] != STREAM_ID or int.from_bytes(pes[4:6], "big") != len(pes) - 6:
            if strict:
                raise ValueError("an elementary packet is damaged")
            damaged += 1
            continue
        t = pes[9:14]
        times.append((t[0] >> 1 & 7) << 30 | t[1] << 22 | t[2] >> 1 << 15 | t[3] << 7 | t[4] >> 1)
        payload.append(pes[9 + pes[8] :])
    return {"payload": b"".join(payload), "times": times, "points": points.tolist(), "packets": len(packets), "gaps": gaps, "damaged": damaged, "program": program, "stream_type": int(kind)}


def padded(text: str | None) -> tuple[bytes, int]:
    raw = (text or "").encode()
    return raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0"), len(raw)


def to_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, n_bytes, media)."""
    docs = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 4 << 20):
                pairs = [padded(t) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([n for _, n in pairs], pa.int64()), pa.array([write_stream(p) for p, _ in pairs], pa.binary())], names=[id_col, "n_bytes", "media"])

    return docs.mapInArrow(run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, n_bytes long, media binary")


def from_media(stored: DataFrame) -> DataFrame:
    """Adds what reading each stream gives: payload, times array<long>, points array<int>, packets, gaps, program, stream_type."""
    names = stored.columns
    where = names.index("media")
    added = [("payload", "binary", pa.binary()), ("times", "array<long>", pa.list_(pa.int64())), ("points", "array<int>", pa.list_(pa.int32())), ("packets", "long", pa.int64()), ("gaps", "long", pa.int64()), ("program", "int", pa.int32()), ("stream_type", "int", pa.int32())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "media", 4 << 20):
                read = [read_stream(m) for m in part.column(where).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, *[pa.array([r[k] for r in read], t) for k, _, t in added]], names=[*names, *[k for k, _, _ in added]])

    return stored.mapInArrow(run, ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in stored.schema.fields], *[f"{k} {t}" for k, t, _ in added]]))


def summary(read: DataFrame, id_col: str = "doc_id") -> DataFrame:
    feature = F.concat_ws(
        ";", F.concat(F.lit("packets="), "packets"), F.concat(F.lit("units="), F.size("times")), F.concat(F.lit("points="), F.size("points")),
        F.concat(F.lit("first="), F.element_at("times", 1)), F.concat(F.lit("last="), F.element_at("times", -1)), F.concat(F.lit("gaps="), "gaps"),
    )
    return read.select(
        id_col, "n_bytes", F.length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"), F.crc32(F.substring("payload", -64, 64)).alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), feature.alias("feature"),
    )
