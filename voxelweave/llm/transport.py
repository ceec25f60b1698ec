"""MPEG transport streams: one program with one private stream, written and parsed in numpy.

A stream has a program association table, a program map table, and access units as elementary packets with 90 kHz
timestamps. Every `RANDOM`-th unit starts with a random-access indicator and a clock reference.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import groups_of_texts, short_batches, strings, text_of

#: Fixed values of the format: packet size, sync byte, table ids, stream type and id of private data, clock.
PACKET, SYNC, PAT_ID, PMT_ID, PRIVATE_TYPE, PRIVATE_STREAM, CLOCK = 188, 0x47, 0x00, 0x02, 0x06, 0xBD, 90_000
PROGRAM, PMT_PID, DATA_PID = 1, 0x1000, 0x0100
UNIT, RANDOM, TICKS = 4096, 8, 3600


def _crc_table() -> list[int]:
    out = []
    for i in range(256):
        c = i << 24
        for _ in range(8):
            c = (c << 1) ^ (0x04C11DB7 if c & 0x80000000 else 0)
        out.append(c & 0xFFFFFFFF)
    return out


_CRC = _crc_table()


def section_crc(data: bytes) -> int:
    c = 0xFFFFFFFF
    for b in data:
        c = (c << 8 & 0xFFFFFFFF) ^ _CRC[(c >> 24) ^ b]
    return c


def _section(table: int, number: int, body: bytes) -> bytes:
    head = bytes([table]) + (0xB000 | len(body) + 9).to_bytes(2, "big") + number.to_bytes(2, "big") + b"\xc1\x00\x00"
    return head + body + section_crc(head + body).to_bytes(4, "big")


def _table_packet(pid: int, section: bytes) -> bytes:
    return (bytes([SYNC, 0x40 | pid >> 8, pid & 255, 0x10, 0]) + section).ljust(PACKET, b"\xff")


_PAT = _table_packet(0, _section(PAT_ID, 1, PROGRAM.to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big")))
_PMT = _table_packet(PMT_PID, _section(PMT_ID, PROGRAM, (0xE000 | DATA_PID).to_bytes(2, "big") + b"\xf0\x00" + bytes([PRIVATE_TYPE]) + (0xE000 | DATA_PID).to_bytes(2, "big") + b"\xf0\x00"))


def _stamp(t: int) -> bytes:
    return bytes([0x21 | t >> 29 & 0x0E, t >> 22 & 255, t >> 14 & 254 | 1, t >> 7 & 255, t << 1 & 254 | 1])


def _elementary(unit: bytes, time: int) -> bytes:
    rest = b"\x84\x80\x05" + _stamp(time & (1 << 33) - 1) + unit
    return b"\x00\x00\x01" + bytes([PRIVATE_STREAM]) + len(rest).to_bytes(2, "big") + rest


def _cells(data: bytes, clock: int | None, counter: int) -> tuple[bytes, int]:
    """Packets of one elementary packet; the first carries a clock reference unless it is None."""
    out = []
    extra = b"" if clock is None else b"\x50" + (clock << 15 | 0x7E00).to_bytes(6, "big")
    room = 184 - (len(extra) + 1 if extra else 0)
    n = min(len(data), room)
    if n < room or extra:
        stuffing = 184 - n - 1 - len(extra)
        field_ = extra or (b"\x00" if stuffing else b"")
        stuffing -= 0 if extra else len(field_)
        field_ += b"\xff" * stuffing
        out.append(bytes([SYNC, 0x40 | DATA_PID >> 8, DATA_PID & 255, 0x30 | counter, len(field_)]) + field_ + data[:n])
    else:
        out.append(bytes([SYNC, 0x40 | DATA_PID >> 8, DATA_PID & 255, 0x10 | counter]) + data[:n])
    counter = counter + 1 & 15
    rest = data[n:]
    if k := len(rest) // 184:
        cells = np.empty((k, PACKET), np.uint8)
        cells[:, 0], cells[:, 1], cells[:, 2] = SYNC, DATA_PID >> 8, DATA_PID & 255
        cells[:, 3] = 0x10 | (np.arange(counter, counter + k) & 15)
        cells[:, 4:] = np.frombuffer(rest, np.uint8, k * 184).reshape(k, 184)
        out.append(cells.tobytes())
        counter = counter + k & 15
    if last := rest[k * 184 :]:
        free = 183 - len(last)
        field_ = b"\x00" + b"\xff" * (free - 1) if free else b""
        out.append(bytes([SYNC, DATA_PID >> 8, DATA_PID & 255, 0x30 | counter, free]) + field_ + last)
        counter = counter + 1 & 15
    return b"".join(out), counter


def write(payload: bytes, unit: int = UNIT, ticks: int = TICKS) -> bytes:
    """A stream of the payload in units of so many bytes, `ticks` of the 90 kHz clock apart."""
    out, counter = [], 0
    for k, at in enumerate(range(0, len(payload), unit)):
        start = k % RANDOM == 0
        if start:
            tables = bytearray(_PAT + _PMT)
            tables[3] = tables[PACKET + 3] = 0x10 | k // RANDOM & 15
            out.append(bytes(tables))
        cells, counter = _cells(_elementary(payload[at : at + unit], k * ticks), k * ticks if start else None, counter)
        out.append(cells)
    return b"".join(out)


@dataclass
class Stream:
    """What a transport stream holds. units: time, whether it is a random-access point, data, and whether it is whole."""

    packets: int = 0
    programs: dict[int, int] = field(default_factory=dict)
    streams: dict[int, int] = field(default_factory=dict)
    continuity_errors: int = 0
    bad_sections: int = 0
    units: list[tuple[int | None, bool, bytes, bool]] = field(default_factory=list)

    @property
    def payload(self) -> bytes:
        return b"".join(x[2] for x in self.units)


def _sections(cells: np.ndarray, pid: np.ndarray, want: int, table: int, out: Stream) -> Iterator[bytes]:
    seen = set()
    for row in cells[(pid == want) & (cells[:, 1] & 0x40 > 0)]:
        raw = row.tobytes()
        if raw[5:] in seen:  # the same table, sent again
            continue
        seen.add(raw[5:])
        body = raw[4 + (1 + raw[4] if raw[3] & 0x20 else 0) :]
        body = body[1 + body[0] :]
        size = (body[1] & 15) << 8 | body[2]
        section = body[: size + 3]
        if body[0] != table or len(section) < size + 3 or section_crc(section[:-4]) != int.from_bytes(section[-4:], "big"):
            out.bad_sections += 1
        else:
            yield section[8:-4]


def read(data: bytes) -> Stream:
    """Parse a stream: tables first, then the packets of its first elementary stream.

    A packet repeated at once counts once. A gap in the continuity counter is counted, and the unit that it falls into
    is marked as not whole. Bytes that aren't whole packets with a sync byte raise ValueError; no bytes give no units.
    """
    out = Stream()
    if len(data) % PACKET:
        raise ValueError(f"{len(data)} bytes aren't whole packets")
    cells = np.frombuffer(data, np.uint8).reshape(-1, PACKET)
    if (cells[:, 0] != SYNC).any():
        raise ValueError("a packet doesn't start with the sync byte")
    out.packets = len(cells)
    pid = (cells[:, 1].astype(np.int32) & 31) << 8 | cells[:, 2]
    for body in _sections(cells, pid, 0, PAT_ID, out):
        for k in range(0, len(body), 4):
            if number := int.from_bytes(body[k : k + 2], "big"):
                out.programs[number] = int.from_bytes(body[k + 2 : k + 4], "big") & 0x1FFF
    for map_pid in out.programs.values():
        for body in _sections(cells, pid, map_pid, PMT_ID, out):
            at = 4 + ((body[2] & 15) << 8 | body[3])
            while at + 5 <= len(body):
                out.streams[int.from_bytes(body[at + 1 : at + 3], "big") & 0x1FFF] = body[at]
                at += 5 + ((body[at + 3] & 15) << 8 | body[at + 4])
    if not out.streams:
        return out
    mine = cells[(pid == next(iter(out.streams))) & (cells[:, 3] & 0x10 > 0)]
    if not len(mine):
        return out
    same = np.zeros(len(mine), bool)
    same[1:] = (mine[1:] == mine[:-1]).all(1)
    mine = mine[~same]
    counter = mine[:, 3].astype(np.int32) & 15
    gap = np.zeros(len(mine), bool)
    gap[1:] = counter[1:] != (counter[:-1] + 1 & 15)
    out.continuity_errors = int(gap.sum())
    has_field = mine[:, 3] & 0x20 > 0
    begin = np.where(has_field, 5 + mine[:, 4].astype(np.int32), 4)
    flat = mine[np.arange(PACKET) >= begin[:, None]].tobytes()
    ends = np.cumsum(PACKET - np.minimum(begin, PACKET))
    starts = np.flatnonzero(mine[:, 1] & 0x40)
    random = has_field & (mine[:, 4] > 0) & (mine[:, 5] & 0x40 > 0)
    limits = [*starts.tolist(), len(mine)]
    for first, after in zip(limits, limits[1:], strict=False):
        raw = flat[ends[first - 1] if first else 0 : ends[after - 1]]
        if len(raw) < 9 or raw[:3] != b"\x00\x00\x01":
            out.units.append((None, bool(random[first]), b"", False))
            continue
        size = int.from_bytes(raw[4:6], "big")
        time = None
        if raw[7] & 0x80:
            a, b, c, d, e = raw[9:14]
            time = (a >> 1 & 7) << 30 | b << 22 | c >> 1 << 15 | d << 7 | e >> 1
        body = raw[9 + raw[8] : 6 + size if size else len(raw)]
        out.units.append((time, bool(random[first]), body, not gap[first + 1 : after].any() and (not size or len(raw) >= 6 + size)))
    return out


def padded(text: str, multiple: int = 64) -> tuple[int, bytes]:
    raw = text.encode()
    return len(raw), raw.ljust(max(multiple, -(-len(raw) // multiple) * multiple), b"\x00")


def feature(found: Stream) -> str:
    """What the parsed stream says: packets, units, random-access points, last time, errors, and the mean byte."""
    data = np.frombuffer(found.payload, np.uint8)
    points = ",".join(str(t) for t, start, *_ in found.units if start)
    return (
        f"packets={found.packets} units={len(found.units)} random_access={points} last={found.units[-1][0] if found.units else None} "
        f"gaps={found.continuity_errors} bad_tables={found.bad_sections} mean={data.mean() if len(data) else 0:.6f}"
    )


def encode(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and the transport stream (media) of each row's text in UTF-8, padded with zeros to 64 bytes."""
    short_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = strings(batch.column(1))
            for begin, end in groups_of_texts(texts):
                made = [(n, write(x)) for n, x in map(padded, texts[begin:end])]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(begin, end - begin), pa.array([n for n, _ in made], pa.int64()), pa.array([x for _, x in made], pa.binary())], names=["doc_id", "n_bytes", "media"])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs).alias("text")).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def decode(media: DataFrame) -> DataFrame:
    """doc_id, payload, times and random-access points of each row's stream; null media give an empty payload."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [read(x or b"") for x in batch.column(1).to_pylist()]
            columns = [pa.array([f.payload for f in found], pa.binary()), pa.array([[u[0] for u in f.units] for f in found], pa.list_(pa.int64())), pa.array([[u[0] for u in f.units if u[1]] for f in found], pa.list_(pa.int64())), pa.array([f.continuity_errors for f in found], pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", "payload", "times", "random_access", "continuity_errors"])

    schema = "doc_id long, payload binary, times array<long>, random_access array<long>, continuity_errors long"
    return media.select(media["doc_id"].cast("long").alias("doc_id"), "media").mapInArrow(run, schema)


def digests(docs: DataFrame) -> DataFrame:
    """Sizes and digests of each row's payload as read back from its stream, and the stream's own.

    A null text counts as empty: 64 zero bytes. Rows with equal doc_ids stay separate rows; other columns aren't looked at.
    """
    short_batches(docs.sparkSession)
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    names = [x.split(" ")[0] for x in schema.split(", ")]
    types = [pa.string() if x.endswith("string") else pa.int64() for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), strings(batch.column(1)), strict=True):
                n, payload = padded(text)
                media = write(payload)
                found = read(media)
                back = found.payload
                rows.append((doc_id, n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature(found)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs).alias("text")).mapInArrow(run, schema)
