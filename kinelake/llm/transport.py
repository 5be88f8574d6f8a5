"""Media columns: MPEG transport streams that hold a payload, and what can be read back from them.

A stream has a program association and a program map table (before every random-access point), and one elementary stream
of private data: the payload in packetized parts of PES_BYTES with presentation time stamps, every RANDOM_EVERY-th of
them a random-access point with a clock reference. The reader parses the tables, which may span packets, checks their CRC
and all continuity counters, drops packets sent twice, reassembles the parts of every elementary stream by itself and
lists time stamps and random-access points.

Defined results: a null text is empty; a payload is never empty (64 bytes of 0 at least); equal payloads give equal
streams; rows keep their multiplicity; only the id and text columns are read; ids are cast to long (one that is no number
fails under ANSI mode and is null without it); an empty table gives an empty result; bytes that are no transport stream raise ValueError.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinelake.runtime import ship

PACKET, SYNC = 188, 0x47
PAT_PID, PMT_PID, ES_PID, NULL_PID, PROGRAM, PRIVATE = 0x0000, 0x1000, 0x0100, 0x1FFF, 1, 0x06
PES_BYTES, RANDOM_EVERY, TICKS, FIRST_PTS = 4096, 8, 3000, 90_000
ALIGN = 64


@lru_cache(1)
def _crc_table() -> list[int]:
    table = []
    for i in range(256):
        c = i << 24
        for _ in range(8):
            c = (c << 1 ^ 0x04C11DB7 if c >> 31 else c << 1) & 0xFFFFFFFF
        table.append(c)
    return table


@lru_cache(256)
def section_crc(data: bytes) -> int:
    """CRC-32 of program tables: most significant bit first, not inverted; 0 over a section with its CRC."""
    c, table = 0xFFFFFFFF, _crc_table()
    for b in data:
        c = (c << 8 & 0xFFFFFFFF) ^ table[c >> 24 ^ b]
    return c


def _section(table_id: int, number: int, body: bytes) -> bytes:
    head = bytes([table_id]) + (0xB000 | len(body) + 9).to_bytes(2, "big") + number.to_bytes(2, "big") + b"\xc1\x00\x00" + body
    return head + section_crc(head).to_bytes(4, "big")


@lru_cache(1)
def _tables() -> tuple[bytes, bytes]:
    pat = _section(0, 1, PROGRAM.to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big"))
    pmt = _section(2, PROGRAM, (0xE000 | ES_PID).to_bytes(2, "big") + b"\xf0\x00" + bytes([PRIVATE]) + (0xE000 | ES_PID).to_bytes(2, "big") + b"\xf0\x00")
    return pat, pmt


def _table_packet(pid: int, counter: int, section: bytes) -> bytes:
    return (bytes([SYNC, 0x40 | pid >> 8, pid & 255, 0x10 | counter & 15, 0]) + section).ljust(PACKET, b"\xff")


def _stamp(pts: int) -> bytes:
    return bytes([0x21 | pts >> 29 & 0x0E, pts >> 22 & 255, pts >> 14 & 0xFE | 1, pts >> 7 & 255, pts << 1 & 0xFE | 1])


def mux(payload: bytes) -> bytes:
    """The transport stream of a payload."""
    out, pat, pmt = [], *_tables()
    es = tables = 0
    for number, at in enumerate(range(0, max(1, len(payload)), PES_BYTES)):
        part = payload[at : at + PES_BYTES]
        pts = FIRST_PTS + number * TICKS & (1 << 33) - 1
        pes = b"\x00\x00\x01\xbd" + (len(part) + 8).to_bytes(2, "big") + b"\x84\x80\x05" + _stamp(pts) + part
        adaptation = b""
        if number % RANDOM_EVERY == 0:
            out += [_table_packet(PAT_PID, tables, pat), _table_packet(PMT_PID, tables, pmt)]
            tables += 1
            adaptation = b"\x50" + (pts >> 1).to_bytes(4, "big") + bytes([(pts & 1) << 7 | 0x7E, 0])
        sent, start = 0, 0x40
        while sent < len(pes):
            room = 184 - (len(adaptation) + 1 if adaptation else 0)
            short = room - (len(pes) - sent)
            if short > 0:  # stuffing in the adaptation field
                adaptation = (adaptation or (b"\x00" if short > 1 else b"")).ljust(len(adaptation) + short if adaptation else short - 1, b"\xff")
                field = bytes([len(adaptation)]) + adaptation
            else:
                field = bytes([len(adaptation)]) + adaptation if adaptation else b""
            room = 184 - len(field)
            out.append(bytes([SYNC, start | ES_PID >> 8, ES_PID & 255, (0x30 if field else 0x10) | es & 15]) + field + pes[sent : sent + room])
            sent, start, adaptation, es = sent + room, 0, b"", es + 1
    return b"".join(out)


def _pts(b: bytes) -> int:
    return (b[0] >> 1 & 7) << 30 | b[1] << 22 | b[2] >> 1 << 15 | b[3] << 7 | b[4] >> 1


class _Sections:
    """Reassembles the program tables of one PID; a section may span packets and follow another."""

    def __init__(self):
        self.held: bytes | None = None

    def add(self, data: bytes, starts: bool) -> Iterator[bytes]:
        if starts:
            before, data = data[1 : 1 + data[0]], data[1 + data[0] :]
            if self.held is not None:
                self.held += before
                yield from self._whole()
            self.held = b""
        if self.held is not None:
            self.held += data
            yield from self._whole()

    def _whole(self) -> Iterator[bytes]:
        while len(self.held) >= 3 and self.held[0] != 0xFF:
            size = 3 + ((self.held[1] & 0x0F) << 8 | self.held[2])
            if len(self.held) < size:
                return
            yield self.held[:size]
            self.held = self.held[size:]
        if self.held[:1] == b"\xff":  # stuffing up to the end of the packet
            self.held = None


def demux(stream: bytes) -> dict:
    """What a stream holds, read back.

    streams (by elementary PID: its payload), payload (that of the smallest elementary PID), pts (time stamps of that
    PID's parts, None for a part without), random_access (indices of its parts), counter_errors, crc_errors, programs,
    packets. A packet may be sent twice in a row: the second is dropped. A lost packet is a counter error.
    """
    if len(stream) % PACKET:
        raise ValueError("not a whole number of packets")
    pmt_pids: dict[int, int] = {}
    counters: dict[int, int] = {}
    before: dict[int, bytes] = {}
    doubled: set[int] = set()
    tables: dict[int, _Sections] = {}
    parts: dict[int, list[list[bytes]]] = {}
    random_access: dict[int, list[int]] = {}
    counter_errors = crc_errors = 0
    for at in range(0, len(stream), PACKET):
        sync, b1, b2, b3 = stream[at : at + 4]
        if sync != SYNC:
            raise ValueError(f"no packet at {at}")
        pid, kind, body, flags = (b1 & 0x1F) << 8 | b2, b3 & 0x30, at + 4, 0
        if kind & 0x20:
            length = stream[body]
            flags = stream[body + 1] if length else 0
            body += 1 + length
        if not kind & 0x10 or pid == NULL_PID:
            continue
        data = stream[body : at + PACKET]
        if pid in counters and not flags & 0x80:
            if b3 & 15 == counters[pid] and data == before[pid] and pid not in doubled:
                doubled.add(pid)
                continue
            counter_errors += b3 & 15 != counters[pid] + 1 & 15
        doubled.discard(pid)
        counters[pid], before[pid] = b3 & 15, data
        starts = bool(b1 & 0x40)
        if pid in parts:
            if starts:
                if flags & 0x40:
                    random_access[pid].append(len(parts[pid]))
                parts[pid].append([data])
            elif parts[pid]:
                parts[pid][-1].append(data)
        elif pid == PAT_PID or pid in pmt_pids:
            for section in tables.setdefault(pid, _Sections()).add(data, starts):
                if section_crc(section):
                    crc_errors += 1
                elif pid == PAT_PID:
                    for i in range(8, len(section) - 4, 4):
                        if number := section[i] << 8 | section[i + 1]:
                            pmt_pids[(section[i + 2] & 0x1F) << 8 | section[i + 3]] = number
                else:
                    i = 12 + ((section[10] & 0x0F) << 8 | section[11])
                    while i < len(section) - 4:
                        found = (section[i + 1] & 0x1F) << 8 | section[i + 2]
                        parts.setdefault(found, [])
                        random_access.setdefault(found, [])
                        i += 5 + ((section[i + 3] & 0x0F) << 8 | section[i + 4])
    streams, stamps = {}, {}
    for pid, held in parts.items():
        payload, stamps[pid] = [], []
        for part in held:
            pes = b"".join(part)
            if pes[:3] != b"\x00\x00\x01":
                raise ValueError("a packetized part without its start code")
            length = pes[4] << 8 | pes[5]
            stamps[pid].append(_pts(pes[9:14]) if pes[7] & 0x80 else None)
            payload.append(pes[9 + pes[8] : 6 + length if length else None])
        streams[pid] = b"".join(payload)
    main = min(streams, default=None)
    return {
        "streams": streams, "payload": streams.get(main, b""), "pts": stamps.get(main, []), "random_access": random_access.get(main, []),
        "counter_errors": counter_errors, "crc_errors": crc_errors, "programs": len(pmt_pids), "packets": len(stream) // PACKET,
    }


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, media binary): every text as a transport stream, padded with bytes 0 to a positive multiple of 64."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [(t.as_py() or "").encode("utf-8", "surrogatepass") for t in b.column(1)]
            media = [mux(t.ljust(max(ALIGN, -(-len(t) // ALIGN) * ALIGN), b"\x00")) for t in texts]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(media, pa.binary())], names=[id_col, "n_bytes", "media"])

    return docs.select(F.col(id_col).cast("long").alias(id_col), text_col).mapInArrow(run, f"`{id_col}` long, n_bytes long, media binary")


def features(stored: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Digests and features of stored(id, n_bytes, media), all from the stored bytes."""
    names = [id_col, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for x in b.column(2):
                media = x.as_py()
                d = demux(media)
                p, pts = d["payload"], d["pts"]
                feature = f"programs={d['programs']};packets={d['packets']};parts={len(pts)};pts={pts[0]}-{pts[-1]};random={','.join(map(str, d['random_access']))};counter_errors={d['counter_errors']};crc_errors={d['crc_errors']}"
                rows.append((len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-ALIGN:]), len(media), hashlib.sha256(media).hexdigest(), feature))
            made = list(zip(*rows, strict=True)) or [()] * 6
            types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *[pa.array(c, t) for c, t in zip(made, types, strict=True)]], names=names)

    return stored.mapInArrow(run, f"`{id_col}` long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def op9_transport(spark, sf_dir: str) -> DataFrame:
    return features(store(spark.read.parquet(f"{sf_dir}/documents.parquet")))
