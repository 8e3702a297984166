"""Media columns: texts as losslessly stored 8-bit sound in Matroska, and packet tables of such files.

`mux` writes a file; `demux` parses any: elements of variable length, clusters, block groups, the three
kinds of lacing, and cues, into a packet table with timestamps, tracks and byte ranges.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Bytes in a packet, packets in a block, blocks in a cluster; samples a second.
PACKET, LACED, BLOCKS, RATE = 576, 8, 32, 8000

# Element ids.
EBML, SEGMENT, INFO, TRACKS, CLUSTER, CUES = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0x1F43B675, 0x1C53BB6B
TRACK, AUDIO, BLOCK_GROUP, CUE_POINT, CUE_PLACE = 0xAE, 0xE1, 0xA0, 0xBB, 0xB7
TIME, SIMPLE_BLOCK, BLOCK, SCALE, NUMBER = 0xE7, 0xA3, 0xA1, 0x2AD7B1, 0xD7
CUE_TIME, CUE_TRACK, CUE_CLUSTER = 0xB3, 0xF7, 0xF1


def _id(x: int) -> bytes:
    return x.to_bytes((x.bit_length() + 7) // 8, "big")


def _size(n: int) -> bytes:
    k = 1
    while n >= (1 << 7 * k) - 1:
        k += 1
    return (n | 1 << 7 * k).to_bytes(k, "big")


def _el(x: int, body: bytes | int | str) -> bytes:
    if isinstance(body, int):
        body = body.to_bytes(max(1, (body.bit_length() + 7) // 8), "big")
    elif isinstance(body, str):
        body = body.encode()
    return _id(x) + _size(len(body)) + body


_HEAD = _el(EBML, _el(0x4286, 1) + _el(0x42F7, 1) + _el(0x42F2, 4) + _el(0x42F3, 8) + _el(0x4282, "matroska") + _el(0x4287, 4) + _el(0x4285, 2))
_TRACK = _el(TRACKS, _el(TRACK, _el(NUMBER, 1) + _el(0x73C5, 1) + _el(0x83, 2) + _el(0x9C, 1) + _el(0x86, "A_PCM/INT/LIT") + _el(AUDIO, _el(0xB5, np.float64(RATE).astype(">f8").tobytes()) + _el(0x9F, 1) + _el(0x6264, 8))))


def mux(payload: bytes) -> bytes:
    """A Matroska file of one 8-bit sound track; `payload` is a positive multiple of PACKET."""
    if not payload or len(payload) % PACKET:
        raise ValueError(f"a positive multiple of {PACKET} bytes is needed")
    ms = PACKET * 1000 // RATE
    n = len(payload) // PACKET
    info = _el(INFO, _el(SCALE, 1_000_000) + _el(0x4D80, "larkspur") + _el(0x5741, "larkspur") + _el(0x4489, np.float64(n * ms).astype(">f8").tobytes()))
    out, cues = [info, _TRACK], []
    at = len(info) + len(_TRACK)
    for first in range(0, n, LACED * BLOCKS):
        body = [_el(TIME, first * ms)]
        for k in range(first, min(n, first + LACED * BLOCKS), LACED):
            m = min(LACED, n - k)
            head = b"\x81" + ((k - first) * ms).to_bytes(2, "big") + (bytes([0x84, m - 1]) if m > 1 else b"\x80")
            body.append(_id(SIMPLE_BLOCK) + _size(len(head) + m * PACKET) + head + payload[k * PACKET : (k + m) * PACKET])
        cluster = _el(CLUSTER, b"".join(body))
        cues.append(_el(CUE_POINT, _el(CUE_TIME, first * ms) + _el(CUE_PLACE, _el(CUE_TRACK, 1) + _el(CUE_CLUSTER, at))))
        out.append(cluster)
        at += len(cluster)
    out.append(_el(CUES, b"".join(cues)))
    return _HEAD + _el(SEGMENT, b"".join(out))


@dataclass
class Media:
    """packets: (track, timestamp in ns, offset, size, keyframe, cluster). cues: (ns, track, offset of the cluster)."""

    packets: list[tuple[int, int, int, int, bool, int]]
    cues: list[tuple[int, int, int]]
    clusters: int
    tracks: dict[int, str]


def _vint(b: bytes, at: int) -> tuple[int, int, int]:
    """Value without its marker, bytes taken, and the largest such value (which means unknown)."""
    first = b[at]
    if not first:
        raise ValueError(f"no variable-length number at {at}")
    k = 9 - first.bit_length()
    if at + k > len(b):
        raise ValueError(f"the file ends in a number at {at}")
    most = (1 << 7 * k) - 1
    return int.from_bytes(b[at : at + k], "big") & most, k, most


def elements(b: bytes, at: int, end: int, parent_ids: frozenset[int] = frozenset()) -> Iterator[tuple[int, int, int, int]]:
    """(id, begin, body, end) from `at` on; one of unknown size ends before an element that can't lie in it."""
    while at < end:
        k = 9 - b[at].bit_length() if b[at] else 9
        if k > 4 or at + k > end:
            raise ValueError(f"no element at {at}")
        what = int.from_bytes(b[at : at + k], "big")
        size, m, most = _vint(b, at + k)
        body = at + k + m
        if size == most:
            stop = end
            if what == CLUSTER:
                for inner, begin, _, _ in elements(b, body, end):
                    if inner in (CLUSTER, CUES, INFO, TRACKS) or inner in parent_ids:
                        stop = begin
                        break
        else:
            stop = body + size
        if stop > end:
            raise ValueError(f"an element at {at} goes on after what holds it")
        yield what, at, body, stop
        at = stop


def _number(b: bytes, at: int, end: int) -> int:
    return int.from_bytes(b[at:end], "big")


def _laces(b: bytes, at: int, end: int, kind: int) -> list[tuple[int, int]]:
    """(offset, size) of the frames in a block's body: none, Xiph, fixed or EBML lacing."""
    if not kind:
        return [(at, end - at)]
    n = b[at] + 1
    at += 1
    if kind == 2:
        if (end - at) % n:
            raise ValueError("frames of unequal size in fixed lacing")
        sizes = [(end - at) // n] * n
    else:
        sizes = []
        for k in range(n - 1):
            if kind == 1:
                size = 0
                while b[at] == 255:
                    size, at = size + 255, at + 1
                size, at = size + b[at], at + 1
            else:
                x, m, most = _vint(b, at)
                at += m
                size = x if not k else sizes[-1] + x - (most >> 1)
            sizes.append(size)
        sizes.append(end - at - sum(sizes))
    if min(sizes) < 0:
        raise ValueError("laced frames are longer than their block")
    out = []
    for size in sizes:
        out.append((at, size))
        at += size
    return out


def demux(b: bytes) -> Media:
    """The packet table of a Matroska file. Raises ValueError where the file is broken off or none."""
    top = {what: (body, end) for what, _, body, end in elements(b, 0, len(b))}
    if EBML not in top or SEGMENT not in top:
        raise ValueError("no Matroska file")
    begin, end = top[SEGMENT]
    scale, media, places, lasting = 1_000_000, Media([], [], 0, {}), {}, {}
    points = []
    for what, at, body, stop in elements(b, begin, end):
        if what == INFO:
            for x, _, c, d in elements(b, body, stop):
                if x == SCALE:
                    scale = _number(b, c, d)
        elif what == TRACKS:
            for x, _, c, d in elements(b, body, stop):
                if x == TRACK:
                    inner = {y: (e, f) for y, _, e, f in elements(b, c, d)}
                    number = _number(b, *inner[NUMBER])
                    media.tracks[number] = b[slice(*inner[0x86])].decode() if 0x86 in inner else ""
                    lasting[number] = _number(b, *inner[0x23E383]) if 0x23E383 in inner else 0
        elif what == CLUSTER:
            places[at - begin] = media.clusters
            time = 0
            for x, _, c, d in elements(b, body, stop):
                key = None
                if x == TIME:
                    time = _number(b, c, d)
                elif x == SIMPLE_BLOCK:
                    key = None
                elif x == BLOCK_GROUP:
                    inner = {y: (e, f) for y, _, e, f in elements(b, c, d)}
                    if BLOCK not in inner:
                        continue
                    c, d = inner[BLOCK]
                    key = 0xFB not in inner  # no reference to another block
                if x in (SIMPLE_BLOCK, BLOCK_GROUP):
                    track, m, _ = _vint(b, c)
                    late = int.from_bytes(b[c + m : c + m + 2], "big", signed=True)
                    flags = b[c + m + 2]
                    frames = _laces(b, c + m + 3, d, flags >> 1 & 3)
                    ns = (time + late) * scale
                    each = lasting.get(track, 0) or (PACKET * 1_000_000_000 // RATE if media.tracks.get(track) == "A_PCM/INT/LIT" else 0)
                    for k, (o, size) in enumerate(frames):
                        media.packets.append((track, ns + k * each, o, size, bool(flags & 0x80) if key is None else key, media.clusters))
            media.clusters += 1
        elif what == CUES:
            for x, _, c, d in elements(b, body, stop):
                if x == CUE_POINT:
                    time, where = 0, []
                    for y, _, e, f in elements(b, c, d):
                        if y == CUE_TIME:
                            time = _number(b, e, f)
                        elif y == CUE_PLACE:
                            where.append({z: _number(b, g, h) for z, _, g, h in elements(b, e, f) if z in (CUE_TRACK, CUE_CLUSTER)})
                    points += [(time * scale, p.get(CUE_TRACK, 0), p.get(CUE_CLUSTER, -1)) for p in where]
    for ns, track, place in points:
        if place not in places:
            raise ValueError(f"a cue leads to {place}, where no cluster begins")
        media.cues.append((ns, track, begin + place))
    return media


def payload_of(text: str | None) -> bytes:
    raw = (text or "").encode()
    return raw + b"\xff" * (-len(raw) % PACKET if raw else PACKET)


def _feature(payload: bytes, media: Media) -> str:
    x = np.frombuffer(payload, np.uint8)
    above = x >= 128
    turns = int(np.count_nonzero(above[1:] != above[:-1]))
    last = media.packets[-1]
    ms = last[1] // 1_000_000 + PACKET * 1000 // RATE
    return f"packets={len(media.packets)};clusters={media.clusters};cues={len(media.cues)};ms={ms};mean={x.mean():.4f};rms={np.sqrt(np.mean((x.astype(np.float64) - 128) ** 2)):.4f};turns={turns}"


def encode(docs: DataFrame) -> DataFrame:
    """(doc_id, media): the file of each row's text; a null text is empty and gives one packet of padding."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            yield pa.RecordBatch.from_arrays([rb.column("doc_id").cast(pa.int64()), pa.array([mux(payload_of(t.as_py())) for t in rb.column("text")], pa.large_binary()).cast(pa.binary())], ["doc_id", "media"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, media binary")


def packets(files: DataFrame) -> DataFrame:
    """A row for each packet of (doc_id, media): doc_id, nth, track, ns, offset, size, keyframe, cluster, error.

    A null or broken file has one row of nulls with the reason in `error`.
    """
    names = ["doc_id", "nth", "track", "ns", "offset", "size", "keyframe", "cluster", "error"]
    kinds = [pa.int64()] * 6 + [pa.bool_(), pa.int64(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            for doc, b in zip(rb.column("doc_id").to_pylist(), rb.column("media").to_pylist(), strict=True):
                try:
                    if b is None:
                        raise ValueError("no file")
                    rows = [(doc, k, *p, None) for k, p in enumerate(demux(b).packets)]
                except (ValueError, IndexError, KeyError) as e:
                    rows = [(doc, *[None] * 7, str(e))]
                cols = list(zip(*rows, strict=True)) or [()] * 9
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

    return files.select("doc_id", "media").mapInArrow(run, "doc_id long, nth long, track long, ns long, offset long, size long, keyframe boolean, cluster long, error string")


def digest(docs: DataFrame) -> DataFrame:
    """What each row's text gives when it is stored and its packets are read back; equal texts, equal values."""
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            rows = []
            for t in rb.column("text"):
                text = t.as_py() or ""
                file = mux(payload_of(text))
                media = demux(file)
                back = b"".join([file[p[2] : p[2] + p[3]] for p in media.packets])
                rows.append((len(text.encode()), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(file), hashlib.sha256(file).hexdigest(), _feature(back, media)))
            cols = list(zip(*rows, strict=True)) or [()] * 7
            yield pa.RecordBatch.from_arrays([rb.column("doc_id").cast(pa.int64()), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
