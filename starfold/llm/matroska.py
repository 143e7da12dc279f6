"""Matroska media columns: a parser of EBML elements into packet tables, and a writer of PCM audio.

The parser walks variable-length elements; it knows segments and clusters of unknown size, simple
blocks and block groups, the three kinds of lacing, tracks and cues. Damaged bytes never raise: what
was read before the damage is returned, with ``error`` set.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starfold.llm._common import by_arrow, documents
from starfold.llm.blocks import texts

# Element identifiers of the format.
EBML, EBML_VERSION, EBML_READ_VERSION, EBML_MAX_ID, EBML_MAX_SIZE = 0x1A45DFA3, 0x4286, 0x42F7, 0x42F2, 0x42F3
DOC_TYPE, DOC_VERSION, DOC_READ_VERSION = 0x4282, 0x4287, 0x4285
SEGMENT, INFO, TIMESTAMP_SCALE, DURATION, MUXING_APP, WRITING_APP = 0x18538067, 0x1549A966, 0x2AD7B1, 0x4489, 0x4D80, 0x5741
TRACKS, TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, FLAG_LACING, DEFAULT_DURATION, CODEC_ID = 0x1654AE6B, 0xAE, 0xD7, 0x73C5, 0x83, 0x9C, 0x23E383, 0x86
AUDIO, SAMPLING_FREQUENCY, CHANNELS, BIT_DEPTH = 0xE1, 0xB5, 0x9F, 0x6264
CLUSTER, CLUSTER_TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, BLOCK_DURATION, REFERENCE_BLOCK = 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1, 0x9B, 0xFB
CUES, CUE_POINT, CUE_TIME, CUE_TRACK_POSITIONS, CUE_TRACK, CUE_CLUSTER_POSITION = 0x1C53BB6B, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
SEEK_HEAD, TAGS, CHAPTERS, ATTACHMENTS = 0x114D9B74, 0x1254C367, 0x1043A770, 0x1941A469

NO_LACING, XIPH, FIXED, EBML_LACING = 0, 1, 2, 3
TOP_LEVEL = {INFO, TRACKS, CLUSTER, CUES, SEEK_HEAD, TAGS, CHAPTERS, ATTACHMENTS}

UNIT = 192
RATE = 8000
FRAMES_A_BLOCK = 8
BLOCKS_A_CLUSTER = 64


class Damaged(ValueError):
    pass


@dataclass
class Packet:
    track: int
    timestamp_ns: int
    offset: int
    size: int
    keyframe: bool
    lacing: int


@dataclass
class Media:
    doc_type: str = ""
    scale: int = 1_000_000
    duration: float = 0.0
    tracks: dict[int, dict] = field(default_factory=dict)
    packets: list[Packet] = field(default_factory=list)
    cues: list[tuple[int, int, int]] = field(default_factory=list)  # time in ns, track, byte of the cluster
    clusters: list[int] = field(default_factory=list)
    error: str = ""


# --- reading ------------------------------------------------------------------


def read_id(data: bytes, at: int) -> tuple[int, int]:
    if at >= len(data) or not data[at]:
        raise Damaged(f"no element identifier at {at}")
    n = 9 - data[at].bit_length()
    if n > 4 or at + n > len(data):
        raise Damaged(f"bad element identifier at {at}")
    return int.from_bytes(data[at : at + n], "big"), at + n


def read_size(data: bytes, at: int) -> tuple[int, int]:
    """Value of a variable-length integer and what follows it; -1 if all its bits are set (unknown)."""
    if at >= len(data) or not data[at]:
        raise Damaged(f"no size at {at}")
    n = 9 - data[at].bit_length()
    if at + n > len(data):
        raise Damaged(f"size cut off at {at}")
    value = int.from_bytes(data[at : at + n], "big") & ((1 << 7 * n) - 1)
    return (-1 if value == (1 << 7 * n) - 1 else value), at + n


def elements(data: bytes, at: int, end: int) -> Iterator[tuple[int, int, int]]:
    """(identifier, first byte, byte after the last) of the elements in a master element."""
    while at < end:
        key, body = read_id(data, at)
        size, body = read_size(data, body)
        stop = end if size < 0 else body + size
        if stop > end:
            raise Damaged(f"element {key:x} at {at} goes past its parent")
        yield key, body, stop
        at = stop


def unsigned(data: bytes, a: int, b: int) -> int:
    return int.from_bytes(data[a:b], "big")


def real(data: bytes, a: int, b: int) -> float:
    if b - a not in (0, 4, 8):
        raise Damaged(f"float of {b - a} bytes at {a}")
    return struct.unpack(">f" if b - a == 4 else ">d", data[a:b])[0] if b > a else 0.0


def laced(data: bytes, at: int, end: int, lacing: int) -> list[tuple[int, int]]:
    """(first byte, size) of each frame of a block's content."""
    if lacing == NO_LACING:
        return [(at, end - at)]
    if at >= end:
        raise Damaged(f"lacing without a count at {at}")
    n, at = data[at] + 1, at + 1
    sizes: list[int] = []
    if lacing == XIPH:
        for _ in range(n - 1):
            size = 0
            while True:
                if at >= end:
                    raise Damaged(f"Xiph lacing cut off at {at}")
                size, at = size + data[at], at + 1
                if data[at - 1] < 255:
                    break
            sizes.append(size)
    elif lacing == EBML_LACING:
        for k in range(n - 1):
            begin = at
            value, at = read_size(data, at)
            if k:
                value = sizes[-1] + value - ((1 << (7 * (at - begin) - 1)) - 1)
            sizes.append(value)
    if lacing == FIXED:
        if (end - at) % n:
            raise Damaged(f"fixed lacing of {end - at} bytes in {n} frames at {at}")
        sizes = [(end - at) // n] * n
    else:
        sizes.append(end - at - sum(sizes))
    if min(sizes) < 0 or sum(sizes) != end - at:
        raise Damaged(f"lacing sizes don't fit at {at}")
    out = []
    for size in sizes:
        out.append((at, size))
        at += size
    return out


def _track(data: bytes, a: int, b: int) -> dict:
    t = {"number": 0, "type": 0, "codec": "", "frame_ns": 0, "rate": 0.0, "channels": 1, "bits": 0}
    for key, x, y in elements(data, a, b):
        if key == TRACK_NUMBER:
            t["number"] = unsigned(data, x, y)
        elif key == TRACK_TYPE:
            t["type"] = unsigned(data, x, y)
        elif key == CODEC_ID:
            t["codec"] = data[x:y].rstrip(b"\0").decode("ascii", "replace")
        elif key == DEFAULT_DURATION:
            t["frame_ns"] = unsigned(data, x, y)
        elif key == AUDIO:
            for k, p, q in elements(data, x, y):
                if k == SAMPLING_FREQUENCY:
                    t["rate"] = real(data, p, q)
                elif k == CHANNELS:
                    t["channels"] = unsigned(data, p, q)
                elif k == BIT_DEPTH:
                    t["bits"] = unsigned(data, p, q)
    return t


def _block(media: Media, data: bytes, a: int, b: int, base: int, simple: bool, duration: int, referred: bool) -> None:
    number, at = read_size(data, a)
    if at + 3 > b:
        raise Damaged(f"block cut off at {a}")
    relative = int.from_bytes(data[at : at + 2], "big", signed=True)
    flags = data[at + 2]
    lacing = flags >> 1 & 3
    frames = laced(data, at + 3, b, lacing)
    each = media.tracks.get(number, {}).get("frame_ns", 0) or (duration * media.scale // len(frames))
    first = (base + relative) * media.scale
    key = bool(flags & 0x80) if simple else not referred
    media.packets += [Packet(number, first + k * each, x, n, key, lacing) for k, (x, n) in enumerate(frames)]


def _cluster(media: Media, data: bytes, at: int, end: int, open_: bool) -> int:
    """Read a cluster; returns where it ends. One of unknown size ends where a top-level element begins."""
    base = 0
    while at < end:
        key, body = read_id(data, at)
        if open_ and (key in TOP_LEVEL or key in (SEGMENT, EBML)):
            return at
        size, body = read_size(data, body)
        stop = body + size
        if size < 0 or stop > end:
            raise Damaged(f"element {key:x} at {at} goes past its cluster")
        if key == CLUSTER_TIMESTAMP:
            base = unsigned(data, body, stop)
        elif key == SIMPLE_BLOCK:
            _block(media, data, body, stop, base, True, 0, False)
        elif key == BLOCK_GROUP:
            block, duration, referred = None, 0, False
            for k, x, y in elements(data, body, stop):
                if k == BLOCK:
                    block = (x, y)
                elif k == BLOCK_DURATION:
                    duration = unsigned(data, x, y)
                elif k == REFERENCE_BLOCK:
                    referred = True
            if block:
                _block(media, data, *block, base, False, duration, referred)
        at = stop
    return end


def parse(data: bytes) -> Media:
    """Everything that the bytes of a file say about tracks, packets and cues."""
    media, at = Media(), 0
    try:
        key, body = read_id(data, 0)
        size, body = read_size(data, body)
        if key != EBML or size < 0 or body + size > len(data):
            raise Damaged("no EBML header")
        for k, a, b in elements(data, body, body + size):
            if k == DOC_TYPE:
                media.doc_type = data[a:b].rstrip(b"\0").decode("ascii", "replace")
        at = body + size
        while at < len(data):
            key, body = read_id(data, at)
            size, body = read_size(data, body)
            end = len(data) if size < 0 else body + size
            if end > len(data):
                raise Damaged(f"element {key:x} at {at} goes past the end")
            if key == SEGMENT:
                _segment(media, data, body, end)
            at = end
    except Damaged as e:
        media.error = str(e)
    return media


def _segment(media: Media, data: bytes, start: int, end: int) -> None:
    at = start
    while at < end:
        key, body = read_id(data, at)
        size, body = read_size(data, body)
        stop = end if size < 0 else body + size
        if stop > end:
            raise Damaged(f"element {key:x} at {at} goes past its segment")
        if key == INFO:
            for k, a, b in elements(data, body, stop):
                if k == TIMESTAMP_SCALE:
                    media.scale = unsigned(data, a, b)
                elif k == DURATION:
                    media.duration = real(data, a, b)
        elif key == TRACKS:
            for k, a, b in elements(data, body, stop):
                if k == TRACK_ENTRY:
                    t = _track(data, a, b)
                    media.tracks[t["number"]] = t
        elif key == CLUSTER:
            media.clusters.append(at)
            stop = _cluster(media, data, body, stop, size < 0)
        elif key == CUES:
            for k, a, b in elements(data, body, stop):
                if k == CUE_POINT:
                    when, places = 0, []
                    for c, x, y in elements(data, a, b):
                        if c == CUE_TIME:
                            when = unsigned(data, x, y)
                        elif c == CUE_TRACK_POSITIONS:
                            track = position = 0
                            for d, p, q in elements(data, x, y):
                                if d == CUE_TRACK:
                                    track = unsigned(data, p, q)
                                elif d == CUE_CLUSTER_POSITION:
                                    position = unsigned(data, p, q)
                            places.append((track, start + position))
                    media.cues += [(when * media.scale, t, p) for t, p in places]
        at = stop


# --- writing ------------------------------------------------------------------


def size_bytes(n: int, width: int = 0) -> bytes:
    width = width or next(w for w in range(1, 9) if n < (1 << 7 * w) - 1)
    return (n | 1 << 7 * width).to_bytes(width, "big")


def element(key: int, body: bytes) -> bytes:
    return key.to_bytes((key.bit_length() + 7) // 8, "big") + size_bytes(len(body)) + body


def uint(key: int, value: int) -> bytes:
    return element(key, value.to_bytes(max(1, (value.bit_length() + 7) // 8), "big"))


def double(key: int, value: float) -> bytes:
    return element(key, struct.pack(">d", value))


def lace(frames: list[bytes], lacing: int) -> bytes:
    """A block's content: lacing head and frames."""
    if lacing == NO_LACING:
        return frames[0]
    head = bytes([len(frames) - 1])
    if lacing == XIPH:
        for f in frames[:-1]:
            head += b"\xff" * (len(f) // 255) + bytes([len(f) % 255])
    elif lacing == EBML_LACING:
        last = None
        for f in frames[:-1]:
            if last is None:
                head += size_bytes(len(f))
            else:
                step = len(f) - last
                width = next(w for w in range(1, 9) if abs(step) < 1 << (7 * w - 1))
                head += size_bytes(step + (1 << (7 * width - 1)) - 1, width)
            last = len(f)
    return head + b"".join(frames)


def write(payload: bytes, unit: int = UNIT, rate: int = RATE) -> bytes:
    """A file with one track of 8-bit PCM: frames of ``unit`` samples, laced in blocks, a cue for each cluster.

    Blocks take the three kinds of lacing in turn; a block of one frame has none.
    """
    frame_ns = unit * 10**9 // rate
    frames = [payload[i : i + unit] for i in range(0, len(payload), unit)]
    head = element(EBML, uint(EBML_VERSION, 1) + uint(EBML_READ_VERSION, 1) + uint(EBML_MAX_ID, 4) + uint(EBML_MAX_SIZE, 8) + element(DOC_TYPE, b"matroska") + uint(DOC_VERSION, 4) + uint(DOC_READ_VERSION, 2))
    info = element(INFO, uint(TIMESTAMP_SCALE, 1_000_000) + double(DURATION, len(frames) * frame_ns / 1e6) + element(MUXING_APP, b"starfold") + element(WRITING_APP, b"starfold"))
    audio = element(AUDIO, double(SAMPLING_FREQUENCY, float(rate)) + uint(CHANNELS, 1) + uint(BIT_DEPTH, 8))
    track = element(TRACK_ENTRY, uint(TRACK_NUMBER, 1) + uint(TRACK_UID, 1) + uint(TRACK_TYPE, 2) + uint(FLAG_LACING, 1) + uint(DEFAULT_DURATION, frame_ns) + element(CODEC_ID, b"A_PCM/INT/LIT") + audio)
    body, at, cues = [info, element(TRACKS, track)], 0, []
    at = sum(map(len, body))
    every = FRAMES_A_BLOCK * BLOCKS_A_CLUSTER
    for first in range(0, len(frames), every):
        base = first * frame_ns // 1_000_000
        blocks = [uint(CLUSTER_TIMESTAMP, base)]
        for k in range(first, min(first + every, len(frames)), FRAMES_A_BLOCK):
            own = frames[k : min(k + FRAMES_A_BLOCK, first + every)]
            lacing = NO_LACING if len(own) == 1 else (FIXED, XIPH, EBML_LACING)[k // FRAMES_A_BLOCK % 3]
            relative = k * frame_ns // 1_000_000 - base
            blocks.append(element(SIMPLE_BLOCK, size_bytes(1) + struct.pack(">hB", relative, 0x80 | lacing << 1) + lace(own, lacing)))
        cluster = element(CLUSTER, b"".join(blocks))
        cues.append(element(CUE_POINT, uint(CUE_TIME, base) + element(CUE_TRACK_POSITIONS, uint(CUE_TRACK, 1) + uint(CUE_CLUSTER_POSITION, at))))
        body.append(cluster)
        at += len(cluster)
    return head + element(SEGMENT, b"".join([*body, element(CUES, b"".join(cues))]))


# --- columns ------------------------------------------------------------------


def padded(data: bytes, unit: int = UNIT) -> bytes:
    return data + b" " * ((-len(data)) % unit if data else unit)


def feature(media: Media, data: bytes) -> str:
    """Of a PCM track: packets, milliseconds, clusters, cues, mean, energy and sign changes of the samples around it."""
    samples = np.frombuffer(data, np.uint8).astype(float)
    mean = samples.mean()
    off = samples - mean
    turns = np.count_nonzero(np.diff(off >= 0)) / max(1, len(off) - 1)
    return f"packets={len(media.packets)};ms={media.duration:.0f};clusters={len(media.clusters)};cues={len(media.cues)};mean={mean:.4f};rms={np.sqrt((off**2).mean()):.4f};turns={turns:.4f}"


def packets(df: DataFrame, column: str, key: str) -> DataFrame:
    """The packet table of a media column: one row per frame of every file, with track, time and byte range.

    Null or empty media have no packets; damaged media have those before the damage.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, data in zip(batch.column(0), batch.column(1), strict=True):
                for i in range(0, len(found := parse(data.as_py() or b"").packets), 50_000):
                    own = found[i : i + 50_000]
                    fields = [pa.array([getattr(p, n) for p in own], t) for n, t in (("track", pa.int64()), ("timestamp_ns", pa.int64()), ("offset", pa.int64()), ("size", pa.int64()), ("keyframe", pa.bool_()))]
                    yield pa.RecordBatch.from_arrays([pa.array([k.as_py()] * len(own), batch.schema.types[0]), pa.array(range(i, i + len(own)), pa.int64()), *fields], names=[key, "packet", "track", "timestamp_ns", "offset", "size", "keyframe"])

    kind = df.schema[key].dataType.simpleString()
    return by_arrow(df.select(key, F.col(column).cast("binary").alias(column)), run, f"`{key}` {kind}, packet long, track long, timestamp_ns long, offset long, size long, keyframe boolean")


def stored_texts(docs: DataFrame) -> DataFrame:
    """Every text of ``docs`` (doc_id, text) written as a file, read back, and described."""
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "n_packets"]
    kinds = ["long", "long", "long", "string", "long", "long", "string", "string", "long"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own, data, ends in texts(batch, "text"):
                rows, at = [], 0
                for end in ends.tolist():
                    text, at = data[at:end], end
                    media = write(padded(text))
                    read = parse(media)
                    if read.error:
                        raise ValueError(f"own file can't be read back: {read.error}")
                    back = b"".join([media[p.offset : p.offset + p.size] for p in read.packets])
                    rows.append((len(text), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature(read, back), len(read.packets)))
                types = [pa.int64() if k == "long" else pa.string() for k in kinds[1:]]
                yield pa.RecordBatch.from_arrays([own.column(0), *(pa.array([r[i] for r in rows], t) for i, t in enumerate(types))], names=names)

    return by_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, ", ".join(map(" ".join, zip(names, kinds, strict=True))))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored_texts(documents(spark, sf_dir))
