"""Media columns: Matroska containers in a binary column, read back as packet tables.

``encode_media`` wraps bytes as 8-bit PCM audio in a Matroska file: EBML header, Info, Tracks, Clusters of laced
SimpleBlocks and Cues. ``packet_tables`` parses any such column into a table of each file's frames: track, timestamp (by the
file's scale, its clusters' and blocks' times and durations), byte range, keyframe. Whatever is read from media goes by it.
All work is per row; nothing is shuffled and a task holds one slice of a batch.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FRAME = 192  # bytes of a frame: 24 ms at 8 kHz, 8 bit, mono
FRAME_MS = 24
LACE = 8  # frames of a block
CLUSTER_FRAMES = 1000  # 24 s, within a block's signed 16-bit relative time
LACINGS = {"none": 0, "xiph": 1, "fixed": 2, "ebml": 3}

# Element ids of the Matroska specification (fixed values).
EBML, SEGMENT, INFO, TRACKS, CLUSTER, CUES = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0x1F43B675, 0x1C53BB6B
TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK = 0xE7, 0xA3, 0xA0, 0xA1
SCALE, TRACK_ENTRY, TRACK_NUMBER, DEFAULT_DURATION, BLOCK_DURATION, REFERENCE = 0x2AD7B1, 0xAE, 0xD7, 0x23E383, 0x9B, 0xFB
CUE_POINT, CUE_TIME, CUE_POSITIONS, CUE_TRACK, CUE_CLUSTER = 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
TOP_LEVEL = {INFO, TRACKS, CLUSTER, CUES, 0x114D9B74, 0x1254C367, 0x1941A469, 0x1043A770}


def vint(value: int) -> bytes:
    """A size in the fewest bytes; all-ones values mean "unknown" and are left free."""
    n = 1
    while value >= (1 << (7 * n)) - 1:
        n += 1
    return (value | 1 << (7 * n)).to_bytes(n, "big")


def signed_vint(value: int) -> bytes:
    n = 1
    while not -(1 << (7 * n - 1)) < value < (1 << (7 * n - 1)):
        n += 1
    return (value + (1 << (7 * n - 1)) - 1 | 1 << (7 * n)).to_bytes(n, "big")


def element(ident: int, body: bytes) -> bytes:
    return ident.to_bytes((ident.bit_length() + 7) // 8, "big") + vint(len(body)) + body


def number(ident: int, value: int) -> bytes:
    return element(ident, value.to_bytes(max(1, (value.bit_length() + 7) // 8), "big"))


def lace(frames: list[bytes], kind: int) -> bytes:
    """Lacing header and frames of one block."""
    sizes = [len(f) for f in frames]
    head = b"" if kind == 0 else bytes([len(frames) - 1])
    if kind == 1:
        head += b"".join(b"\xff" * (s // 255) + bytes([s % 255]) for s in sizes[:-1])
    elif kind == 3 and len(sizes) > 1:
        head += vint(sizes[0]) + b"".join(signed_vint(b - a) for a, b in zip(sizes, sizes[1:-1]))
    return head + b"".join(frames)


def write_media(payload: bytes, frame: int = FRAME, lacing: str = "ebml") -> bytes:
    """One Matroska file; frames of ``frame`` bytes, the last may be shorter. Fixed lacing needs equal frames."""
    kind = LACINGS[lacing]
    per_block = 1 if kind == 0 else LACE
    frames = [payload[i : i + frame] for i in range(0, len(payload), frame)]
    info = element(INFO, number(SCALE, 1_000_000) + element(0x4489, struct.pack(">d", float(FRAME_MS * len(frames)))) + element(0x4D80, b"corpusframe") + element(0x5741, b"corpusframe"))
    audio = element(0xE1, element(0xB5, struct.pack(">d", 8000.0)) + number(0x9F, 1) + number(0x6264, 8))
    tracks = element(TRACKS, element(TRACK_ENTRY, number(TRACK_NUMBER, 1) + number(0x73C5, 1) + number(0x83, 2) + number(0x9C, int(kind > 0)) + number(DEFAULT_DURATION, FRAME_MS * 1_000_000) + element(0x86, b"A_PCM/INT/LIT") + audio))
    body, cues = [info, tracks], []
    at = len(info) + len(tracks)
    for first in range(0, len(frames), CLUSTER_FRAMES):
        blocks = [number(TIMESTAMP, first * FRAME_MS)]
        end = min(first + CLUSTER_FRAMES, len(frames))
        i = first
        while i < end:
            group = frames[i : min(i + per_block, end)]
            use = kind if len(group) > 1 and (kind != 2 or len(set(map(len, group))) == 1) else 0
            if use == 0:
                group = group[:1]
            blocks.append(element(SIMPLE_BLOCK, vint(1) + struct.pack(">hB", (i - first) * FRAME_MS, 0x80 | use << 1) + lace(group, use)))
            i += len(group)
        cluster = element(CLUSTER, b"".join(blocks))
        cues.append(element(CUE_POINT, number(CUE_TIME, first * FRAME_MS) + element(CUE_POSITIONS, number(CUE_TRACK, 1) + number(CUE_CLUSTER, at))))
        body.append(cluster)
        at += len(cluster)
    head = element(EBML, number(0x4286, 1) + number(0x42F7, 1) + number(0x42F2, 4) + number(0x42F3, 8) + element(0x4282, b"matroska") + number(0x4287, 4) + number(0x4285, 2))
    return head + element(SEGMENT, b"".join(body) + element(CUES, b"".join(cues)))


def read_vint(data: bytes, at: int, keep_marker: bool = False) -> tuple[int, int, int]:
    """``(value, next position, length)``; a size with all value bits set is -1, unknown."""
    first = data[at]
    if not first:
        raise ValueError(f"no EBML number at byte {at}")
    n = 9 - first.bit_length()
    value = int.from_bytes(data[at : at + n], "big")
    if keep_marker:
        return value, at + n, n
    value &= (1 << (7 * n)) - 1
    return (-1 if value == (1 << (7 * n)) - 1 else value), at + n, n


def children(data: bytes, at: int, end: int) -> Iterator[tuple[int, int, int]]:
    """``(id, body start, body end)``; an element of unknown size ends where a top-level one follows."""
    while at < end:
        ident, at, _ = read_vint(data, at, True)
        size, at, _ = read_vint(data, at)
        stop = at + size
        if size < 0:
            stop = end
            if ident == CLUSTER:
                scan = at
                while scan < end:
                    inner, after, _ = read_vint(data, scan, True)
                    if inner in TOP_LEVEL:
                        stop = scan
                        break
                    inner_size, after, _ = read_vint(data, after)
                    scan = after + inner_size
        if stop > end:
            raise ValueError(f"element {ident:x} passes its parent's end")
        yield ident, at, stop
        at = stop


def block_frames(data: bytes, at: int, end: int) -> tuple[int, int, int, list[tuple[int, int]]]:
    """``(track, relative time, flags, byte ranges of its frames)``."""
    track, at, _ = read_vint(data, at)
    time, flags = struct.unpack_from(">hB", data, at)
    at += 3
    kind = flags >> 1 & 3
    if kind == 0:
        return track, time, flags, [(at, end)]
    n = data[at] + 1
    at += 1
    sizes: list[int] = []
    if kind == 1:
        for _ in range(n - 1):
            size = 0
            while data[at] == 255:
                size, at = size + 255, at + 1
            sizes.append(size + data[at])
            at += 1
    elif kind == 3:
        for k in range(n - 1):
            value, at, length = read_vint(data, at)
            sizes.append(value if k == 0 else sizes[-1] + value - (1 << (7 * length - 1)) + 1)
    else:
        sizes = [(end - at) // n] * (n - 1)
    edges = [at]
    for size in sizes:
        edges.append(edges[-1] + size)
    return track, time, flags, list(zip(edges, [*edges[1:], end]))


#: One row for each frame: ``timestamp_ns`` and ``duration_ns`` are null where the file doesn't tell them.
PACKET = pa.schema([("track", pa.int64()), ("timestamp_ns", pa.int64()), ("duration_ns", pa.int64()), ("byte_start", pa.int64()), ("byte_length", pa.int64()), ("keyframe", pa.bool_())])


def uint(data: bytes, a: int, b: int) -> int:
    return int.from_bytes(data[a:b], "big")


def track_durations(data: bytes, at: int, end: int) -> dict[int, int]:
    """Default duration of a frame in nanoseconds, by track, where the file has one."""
    out = {}
    for ident, a, b in children(data, at, end):
        if ident == TRACK_ENTRY:
            found = {child: uint(data, x, y) for child, x, y in children(data, a, b) if child in (TRACK_NUMBER, DEFAULT_DURATION)}
            if DEFAULT_DURATION in found:
                out[found.get(TRACK_NUMBER, 0)] = found[DEFAULT_DURATION]
    return out


def cluster_packets(data: bytes, at: int, end: int, scale: int, durations: dict[int, int]) -> Iterator[tuple]:
    """Packets of a cluster, as in ``PACKET``. Block times count from the cluster's, in units of the file's scale.

    A laced frame begins where the one before it ends: durations are the block's, shared out evenly, or else the track's
    default. Without either, only a block's first frame has a time. A block with references is no keyframe.
    """
    now = 0
    for child, a, b in children(data, at, end):
        duration, key = None, None
        if child == TIMESTAMP:
            now = uint(data, a, b)
        elif child in (SIMPLE_BLOCK, BLOCK_GROUP):
            blocks = [(a, b)]
            if child == BLOCK_GROUP:
                inner = [(g, x, y) for g, x, y in children(data, a, b)]
                blocks, key = [(x, y) for g, x, y in inner if g == BLOCK], all(g != REFERENCE for g, _, _ in inner)
                duration = next((uint(data, x, y) * scale for g, x, y in inner if g == BLOCK_DURATION), None)
            for x, y in blocks:
                track, time, flags, frames = block_frames(data, x, y)
                each = durations.get(track) if duration is None else duration / len(frames)
                begin = (now + time) * scale
                for k, (s, e) in enumerate(frames):
                    start = begin if k == 0 else None if each is None else begin + round(k * each)
                    yield track, start, None if each is None else round(each), s, e - s, bool(flags & 0x80) if key is None else key


def read_media(data: bytes) -> tuple[pa.RecordBatch, list[tuple[int, int]]]:
    """The packet table (``PACKET``) in file order, and cues ``(time in nanoseconds, byte of the cluster)``.

    Bytes that aren't whole EBML elements, frames beyond their block, or none at all, give a ValueError.
    """
    found, cues = [], []
    try:
        for ident, at, end in children(data, 0, len(data)):
            if ident != SEGMENT:
                continue
            scale, durations = 1_000_000, {}
            tops = list(children(data, at, end))
            for top, lo, hi in tops:  # tracks and scale may stand behind the clusters
                if top == INFO:
                    scale = next((uint(data, a, b) for child, a, b in children(data, lo, hi) if child == SCALE), scale)
                elif top == TRACKS:
                    durations |= track_durations(data, lo, hi)
            for top, lo, hi in tops:
                if top == CLUSTER:
                    found += cluster_packets(data, lo, hi, scale, durations)
                elif top == CUES:
                    for _, a, b in children(data, lo, hi):
                        point = {}
                        for child, x, y in children(data, a, b):
                            for field, p, q in children(data, x, y) if child == CUE_POSITIONS else [(child, x, y)]:
                                point[field] = uint(data, p, q)
                        cues.append((point.get(CUE_TIME, 0) * scale, at + point.get(CUE_CLUSTER, 0)))
    except (IndexError, struct.error) as broken:
        raise ValueError(f"the media end early: {broken}") from broken
    if any(p[4] < 0 for p in found):
        raise ValueError("a frame passes its block's end")
    columns = list(zip(*found)) if found else [()] * len(PACKET)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, PACKET)], schema=PACKET), cues


def pad(text: str | None, multiple: int = FRAME) -> tuple[int, bytes]:
    """Length and bytes of a text, with spaces up to a positive multiple."""
    raw = (text or "").encode()
    return len(raw), raw + b" " * (max(1, -(-len(raw) // multiple)) * multiple - len(raw))


def encode_media(df: DataFrame, text_col: str = "text", lacing: str = "ebml") -> DataFrame:
    """``doc_id, n_bytes, media``: each text as a Matroska file. Null text is empty text and still gives one frame."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            lo, held, size = 0, [], 0
            for k in range(len(texts)):
                n, payload = pad(texts[k].as_py())
                held.append((n, write_media(payload, lacing=lacing)))
                size += len(held[-1][1])
                if size > 8 << 20 or k + 1 == len(texts):
                    yield pa.RecordBatch.from_arrays([ids.slice(lo, len(held)), pa.array([h[0] for h in held], pa.int64()), pa.array([h[1] for h in held], pa.binary())], ["doc_id", "n_bytes", "media"])
                    lo, held, size = k + 1, [], 0

    return df.select("doc_id", text_col).mapInArrow(run, f"doc_id {df.schema['doc_id'].dataType.simpleString()}, n_bytes long, media binary")


LISTED = "array<struct<track:bigint,timestamp_ns:bigint,duration_ns:bigint,byte_start:bigint,byte_length:bigint,keyframe:boolean>>"


def packet_tables(df: DataFrame) -> DataFrame:
    """``df`` of ``doc_id, n_bytes, media`` with the packet table of each row as ``packets`` and its ``n_cues``.

    Null media has null for both. Broken media fail the task: rows are never skipped.
    """

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                media, row = batch.column(2)[k], batch.slice(k, 1)
                if media.is_valid:
                    found, cues = read_media(media.as_py())
                    listed = pa.ListArray.from_arrays(pa.array([0, found.num_rows], pa.int32()), pa.StructArray.from_arrays(found.columns, fields=list(PACKET)))
                    yield pa.RecordBatch.from_arrays([*row.columns, listed, pa.array([len(cues)], pa.int64())], ["doc_id", "n_bytes", "media", "packets", "n_cues"])
                else:
                    yield pa.RecordBatch.from_arrays([*row.columns, pa.nulls(1, pa.list_(pa.struct(list(PACKET)))), pa.nulls(1, pa.int64())], ["doc_id", "n_bytes", "media", "packets", "n_cues"])

    return df.select("doc_id", "n_bytes", "media").mapInArrow(run, f"doc_id {df.schema['doc_id'].dataType.simpleString()}, n_bytes long, media binary, packets {LISTED}, n_cues long")


def packets(df: DataFrame) -> DataFrame:
    """One row for each frame of ``doc_id, n_bytes, media``: ``doc_id, packet_no`` and the columns of ``PACKET``."""
    return packet_tables(df).select("doc_id", F.posexplode("packets").alias("packet_no", "p")).select("doc_id", F.col("packet_no").cast("long").alias("packet_no"), "p.*")


def features(media: bytes, table: pa.StructArray, n_cues: int) -> tuple[bytes, str]:
    """Payload of a stored file, by the byte ranges of its packet table, and features of both."""
    start, length = (table.field(PACKET.get_field_index(n)).to_pylist() for n in ("byte_start", "byte_length"))
    payload = b"".join(media[a : a + n] for a, n in zip(start, length))
    if not start:
        return payload, "packets=0"
    time, duration = table.field(1), table.field(2)
    end = pc.max(pc.add(time, pc.fill_null(duration, 0))).as_py()
    wave = np.frombuffer(payload, np.uint8).astype(np.int16) - 128
    crossings = int(np.count_nonzero((wave[1:] < 0) & (wave[:-1] > 0) | (wave[1:] > 0) & (wave[:-1] < 0)))
    power = float(np.mean(np.square(wave.astype(np.float64)))) if len(wave) else 0.0
    mean = float(wave.mean()) if len(wave) else 0.0
    return payload, f"packets={len(start)};tracks={len(pc.unique(table.field(0)))};cues={n_cues};ms={(end or 0) // 1_000_000};mean={mean:.4f};rms={power**0.5:.4f};crossings={crossings}"


def media_digest(df: DataFrame) -> DataFrame:
    """Digests and features of ``doc_id, n_bytes, media``, read back from the stored bytes through their packet tables.

    One row for each row of ``df``; null media has nulls, repeated rows give equal ones, an empty table none. Broken media
    fail the task.
    """
    names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def run(batches):
        for batch in batches:
            rows = []
            for k in range(batch.num_rows):
                value = batch.column(2)[k]
                if not value.is_valid:
                    rows.append((None,) * len(names))
                    continue
                media = value.as_py()
                payload, feature = features(media, batch.column(3)[k].values, batch.column(4)[k].as_py())
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature))
            cols = list(zip(*rows)) if rows else [()] * len(names)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(c, k) for c, k in zip(cols, kinds)]], ["doc_id", "n_bytes", *names])

    return packet_tables(df).mapInArrow(run, f"doc_id {df.schema['doc_id'].dataType.simpleString()}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def op3_matroska(spark, sf_dir: str) -> DataFrame:
    """``media_digest`` of every row of ``documents``, each text wrapped as a Matroska file; null text is empty text."""
    return media_digest(encode_media(spark.read.parquet(f"{sf_dir}/documents.parquet")))
