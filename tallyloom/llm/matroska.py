"""Matroska media columns: texts stored as 8-bit samples in Matroska files, and files read into packet tables.

``parse`` walks variable-length EBML elements (unknown sizes of segments and clusters included), reads tracks, clusters,
simple blocks and block groups, undoes Xiph, EBML and fixed-size lacing, and reads cues.  A packet has its track,
timestamp, key flag and the byte range of its payload, so payloads are cut from the file only when they are wanted.

Defined cases: a null text is empty and gives one frame of filling; bytes that are no EBML give no packets; a file cut
short gives the packets that are whole; repeated rows give repeated rows; equal texts give equal files.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, slices, texts_of

# Fixed values of the format: element ids.
EBML, SEGMENT, INFO, TRACKS, CLUSTER, CUES = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0x1F43B675, 0x1C53BB6B
EBML_VERSION, EBML_READ_VERSION, MAX_ID, MAX_SIZE, DOC_TYPE, DOC_VERSION, DOC_READ_VERSION = 0x4286, 0x42F7, 0x42F2, 0x42F3, 0x4282, 0x4287, 0x4285
SCALE, DURATION, MUXER, WRITER = 0x2AD7B1, 0x4489, 0x4D80, 0x5741
TRACK, TRACK_NO, TRACK_UID, TRACK_TYPE, LACING, CODEC, AUDIO, RATE, CHANNELS, BITS = 0xAE, 0xD7, 0x73C5, 0x83, 0x9C, 0x86, 0xE1, 0xB5, 0x9F, 0x6264
TIME, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, BLOCK_DURATION, REFERENCE = 0xE7, 0xA3, 0xA0, 0xA1, 0x9B, 0xFB
CUE_POINT, CUE_TIME, CUE_POSITIONS, CUE_TRACK, CUE_CLUSTER = 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
LACES = {0: "none", 2: "xiph", 4: "fixed", 6: "ebml"}
TOP = {INFO, TRACKS, CLUSTER, CUES, 0x114D9B74, 0x1941A469, 0x1043A770, 0x1254C367}

FRAME, FILL, FRAME_MS = 576, 0xFF, 12
FRAMES_PER_BLOCK, BLOCKS_PER_CLUSTER = 8, 8


def vint(value: int, width: int = 0) -> bytes:
    width = width or next(w for w in range(1, 9) if value < (1 << 7 * w) - 1)
    return (value | 1 << 7 * width).to_bytes(width, "big")


def element(eid: int, data: bytes) -> bytes:
    return eid.to_bytes((eid.bit_length() + 7) // 8, "big") + vint(len(data)) + data


def number(eid: int, value: int) -> bytes:
    return element(eid, value.to_bytes(max(1, (value.bit_length() + 7) // 8), "big"))


def lace(frames: list[bytes], kind: int) -> bytes:
    """The body of a block after its flags."""
    if kind == 0:
        return frames[0]
    sizes = [len(f) for f in frames]
    head = bytes([len(frames) - 1])
    if kind == 2:
        head += b"".join(b"\xff" * (n // 255) + bytes([n % 255]) for n in sizes[:-1])
    elif kind == 6:
        head += vint(sizes[0])
        for a, b in zip(sizes, sizes[1:-1]):
            width = next(w for w in range(1, 9) if abs(b - a) < (1 << 7 * w - 1) - 1)
            head += vint(b - a + (1 << 7 * width - 1) - 1, width)
    return head + b"".join(frames)


HEADER = element(EBML, number(EBML_VERSION, 1) + number(EBML_READ_VERSION, 1) + number(MAX_ID, 4) + number(MAX_SIZE, 8) + element(DOC_TYPE, b"matroska") + number(DOC_VERSION, 4) + number(DOC_READ_VERSION, 2))
SOUND = element(TRACKS, element(TRACK, number(TRACK_NO, 1) + number(TRACK_UID, 1) + number(TRACK_TYPE, 2) + number(LACING, 1) + element(CODEC, b"A_PCM/INT/LIT") + element(AUDIO, element(RATE, struct.pack(">d", 48000.0)) + number(CHANNELS, 1) + number(BITS, 8))))


def payload_of(text: str) -> tuple[bytes, int]:
    """The text in UTF-8, filled up to whole frames, and its own length."""
    data = text.encode()
    return data + bytes([FILL]) * (max(1, -(-len(data) // FRAME)) * FRAME - len(data)), len(data)


def build(payload: bytes) -> bytes:
    """One PCM track: frames of 576 samples, eight to a block with the three kinds of lacing in turn, and a cue for each cluster."""
    frames = [payload[i : i + FRAME] for i in range(0, len(payload), FRAME)]
    body = [element(INFO, number(SCALE, 1_000_000) + element(DURATION, struct.pack(">d", float(len(frames) * FRAME_MS))) + element(MUXER, b"tallyloom") + element(WRITER, b"tallyloom")), SOUND]
    at, cues = sum(map(len, body)), []
    for c in range(0, len(frames), FRAMES_PER_BLOCK * BLOCKS_PER_CLUSTER):
        cluster = [number(TIME, c * FRAME_MS)]
        for k, i in enumerate(range(c, min(len(frames), c + FRAMES_PER_BLOCK * BLOCKS_PER_CLUSTER), FRAMES_PER_BLOCK)):
            part = frames[i : i + FRAMES_PER_BLOCK]
            kind = 0 if len(part) == 1 else (2, 6, 4)[k % 3]
            cluster.append(element(SIMPLE_BLOCK, b"\x81" + ((i - c) * FRAME_MS).to_bytes(2, "big") + bytes([0x80 | kind]) + lace(part, kind)))
        cues.append(element(CUE_POINT, number(CUE_TIME, c * FRAME_MS) + element(CUE_POSITIONS, number(CUE_TRACK, 1) + number(CUE_CLUSTER, at))))
        body.append(element(CLUSTER, b"".join(cluster)))
        at += len(body[-1])
    return HEADER + element(SEGMENT, b"".join(body) + element(CUES, b"".join(cues)))


@dataclass
class Packet:
    track: int
    timestamp_ns: int
    key: bool
    lacing: str
    cluster: int
    block_at: int
    frame: int
    offset: int
    size: int


@dataclass
class Media:
    doc_type: str = ""
    scale: int = 1_000_000
    duration: float = 0.0
    tracks: dict[int, dict] = field(default_factory=dict)
    packets: list[Packet] = field(default_factory=list)
    clusters: list[int] = field(default_factory=list)
    cues: list[tuple[int, int, int]] = field(default_factory=list)


def read_vint(b: bytes, at: int, end: int, keep_marker: bool = False) -> tuple[int | None, int]:
    """(value, next position); None for an unknown size; raises ValueError when bytes are missing."""
    if at >= end or not b[at]:
        raise ValueError("no variable-length number here")
    width = 9 - b[at].bit_length()
    if at + width > end:
        raise ValueError("cut short")
    value = int.from_bytes(b[at : at + width], "big")
    if not keep_marker:
        value &= (1 << 7 * width) - 1
        if value == (1 << 7 * width) - 1:
            return None, at + width
    return value, at + width


def elements(b: bytes, at: int, end: int) -> Iterator[tuple[int, int, int, int, bool]]:
    """(id, start, first data byte, end, whole) of the elements of one level."""
    while at < end:
        try:
            eid, p = read_vint(b, at, end, True)
            n, p = read_vint(b, p, end)
        except ValueError:
            return
        if n is None:
            stop = unknown_end(b, eid, p, end)
            yield eid, at, p, stop, True
        else:
            stop = p + n
            yield eid, at, p, min(stop, end), stop <= end
        at = stop


def unknown_end(b: bytes, eid: int, at: int, end: int) -> int:
    """Where an element of unknown size ends: at the next element of a level above it."""
    if eid == SEGMENT:
        return end
    while at < end:
        try:
            inner, p = read_vint(b, at, end, True)
            n, p = read_vint(b, p, end)
        except ValueError:
            return end
        if inner in TOP or inner == SEGMENT or n is None:
            return at
        at = p + n
    return end


def read_block(b: bytes, at: int, end: int, media: Media, time: int, cluster: int, block_at: int, key: bool | None) -> None:
    track, p = read_vint(b, at, end)
    if p + 3 > end:
        return
    when, flags = time + int.from_bytes(b[p : p + 2], "big", signed=True), b[p + 2]
    p, kind = p + 3, flags & 6
    if kind == 0:
        sizes = [end - p]
    else:
        n = b[p] + 1
        p += 1
        if kind == 4:
            sizes = [(end - p) // n] * n
        else:
            sizes = []
            for k in range(n - 1):
                if kind == 2:
                    size = 0
                    while b[p] == 255:
                        size, p = size + 255, p + 1
                    size, p = size + b[p], p + 1
                else:
                    start = p
                    value, p = read_vint(b, p, end)
                    size = value if k == 0 else sizes[-1] + value - ((1 << 7 * (p - start) - 1) - 1)
                sizes.append(size)
            sizes.append(end - p - sum(sizes))
    if min(sizes) < 0:
        return
    step = media.tracks.get(track, {}).get("frame_ns", 0)
    for k, size in enumerate(sizes):
        media.packets.append(Packet(track, when * media.scale + k * step, bool(flags & 0x80) if key is None else key, LACES[kind], cluster, block_at, k, p, size))
        p += size


def parse(b: bytes) -> Media:
    """The tracks, packets and cues of a Matroska file; what cannot be read is left out."""
    media = Media()
    for eid, _, p, end, _ in elements(b, 0, len(b)):
        if eid == EBML:
            media.doc_type = next((b[q:e].decode("latin1") for i, _, q, e, _ in elements(b, p, end) if i == DOC_TYPE), "")
        elif eid == SEGMENT:
            for part in elements(b, p, end):
                read_part(b, media, *part)
    return media


def unsigned(b: bytes, p: int, end: int) -> int:
    return int.from_bytes(b[p:end], "big")


def real(b: bytes, p: int, end: int) -> float:
    return struct.unpack(">d" if end - p == 8 else ">f", b[p:end])[0] if end - p in (4, 8) else 0.0


def read_part(b: bytes, media: Media, eid: int, at: int, p: int, end: int, whole: bool) -> None:
    if eid == INFO:
        for i, _, q, e, _ in elements(b, p, end):
            if i == SCALE:
                media.scale = unsigned(b, q, e)
            elif i == DURATION:
                media.duration = real(b, q, e)
    elif eid == TRACKS:
        for i, _, q, e, _ in elements(b, p, end):
            if i == TRACK:
                read_track(b, media, q, e)
    elif eid == CLUSTER:
        media.clusters.append(at)
        time = 0
        for i, start, q, e, complete in elements(b, p, end):
            try:
                if i == TIME:
                    time = unsigned(b, q, e)
                elif i == SIMPLE_BLOCK and complete:
                    read_block(b, q, e, media, time, len(media.clusters) - 1, start, None)
                elif i == BLOCK_GROUP and complete:
                    inner = list(elements(b, q, e))
                    for j, s, r, f, _ in inner:
                        if j == BLOCK:
                            read_block(b, r, f, media, time, len(media.clusters) - 1, s, all(x[0] != REFERENCE for x in inner))
            except (ValueError, IndexError):
                continue
    elif eid == CUES and whole:
        for i, _, q, e, _ in elements(b, p, end):
            if i == CUE_POINT:
                inner = {j: (r, f) for j, _, r, f, _ in elements(b, q, e)}
                if CUE_TIME in inner and CUE_POSITIONS in inner:
                    where = {j: unsigned(b, r, f) for j, _, r, f, _ in elements(b, *inner[CUE_POSITIONS])}
                    media.cues.append((unsigned(b, *inner[CUE_TIME]), where.get(CUE_TRACK, 0), where.get(CUE_CLUSTER, 0)))


def read_track(b: bytes, media: Media, p: int, end: int) -> None:
    track: dict = {}
    for i, _, q, e, _ in elements(b, p, end):
        if i == TRACK_NO:
            track["number"] = unsigned(b, q, e)
        elif i == CODEC:
            track["codec"] = b[q:e].decode("latin1")
        elif i == AUDIO:
            for j, _, r, f, _ in elements(b, q, e):
                if j == RATE:
                    track["rate"] = real(b, r, f)
                elif j == BITS:
                    track["bits"] = unsigned(b, r, f)
    if track.get("codec", "").startswith("A_PCM") and track.get("rate"):
        track["frame_ns"] = round(FRAME * 1e9 / track["rate"])
    media.tracks[track.get("number", 0)] = track


def features(media: Media) -> str:
    kinds = Counter(p.lacing for p in media.packets)
    t = media.packets
    gaps = sorted({b.timestamp_ns - a.timestamp_ns for a, b in zip(t, t[1:])})
    return ";".join(
        [
            f"codec={','.join(x.get('codec', '') for x in media.tracks.values())}", f"packets={len(t)}", f"clusters={len(media.clusters)}", f"cues={len(media.cues)}",
            "lacing=" + ",".join(f"{k}:{n}" for k, n in sorted(kinds.items())), f"keys={sum(p.key for p in t)}", f"last_ns={t[-1].timestamp_ns if t else -1}", "gap_ns=" + ",".join(map(str, gaps)), f"bytes={sum(p.size for p in t)}",
        ]
    )


DIGESTS = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
FILES = "doc_id long, n_bytes long, media binary"
PACKETS = "track long, timestamp_ns long, key boolean, lacing string, cluster int, block_at long, frame int, offset long, size long"


def media_of_texts(docs: DataFrame) -> DataFrame:
    """Every text as a Matroska file."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(rows):
            for at, texts in slices(batch):
                paid = [payload_of(t) for t in texts]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at, len(texts)), pa.array([n for _, n in paid], pa.int64()), pa.array([build(p) for p, _ in paid], pa.binary())], ["doc_id", "n_bytes", "media"])

    return texts_of(docs).mapInArrow(run, FILES)


def packet_table(files: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """One row per packet of every file, with the file's id."""
    kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.string(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64()]
    names = [c.split()[0] for c in PACKETS.split(", ")]

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(rows):
            for i in range(batch.num_rows):
                packets = parse(batch.column("media")[i].as_py() or b"").packets
                if packets:
                    yield pa.RecordBatch.from_arrays([pa.array([batch.column("doc_id")[i].as_py()] * len(packets), pa.int64()), *(pa.array([getattr(p, c) for p in packets], k) for c, k in zip(names, kinds))], ["doc_id", *names])

    return files.select(F.col(id_col).alias("doc_id"), F.col(media_col).alias("media")).mapInArrow(run, "doc_id long, " + PACKETS)


def media_digests(docs: DataFrame) -> DataFrame:
    """Stores every text, reads the stored file back through its packets and digests what it holds; files stay in their task."""

    def row(text: str) -> tuple:
        payload, n = payload_of(text)
        stored = build(payload)
        media = parse(stored)
        back = b"".join([stored[p.offset : p.offset + p.size] for p in media.packets])
        return n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(stored), hashlib.sha256(stored).hexdigest(), features(media)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in DIGESTS.split(", ")]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        for batch in batches(rows):
            for at, texts in slices(batch):
                columns = zip(*map(row, texts))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at, len(texts)), *(pa.array(c, k) for c, k in zip(columns, kinds))], names)

    return texts_of(docs).mapInArrow(run, DIGESTS)
