"""Media columns: Matroska.

``parse`` reads a Matroska byte string: variable-length EBML elements, tracks, clusters, simple blocks and block groups,
Xiph, EBML and fixed-size lacing, and cues, into a packet table with timestamps, tracks and byte ranges. ``mux`` writes
8-bit PCM audio as such a file. Both hold one file of one row at a time.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, BooleanType, IntegerType, LongType, StringType, StructField, StructType

#: Element ids of the Matroska specification (RFC 9559) and EBML (RFC 8794).
EBML, SEGMENT, INFO, TIMESTAMP_SCALE, DURATION = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x2AD7B1, 0x4489
TRACKS, TRACK_ENTRY, TRACK_NUMBER, TRACK_TYPE, CODEC_ID = 0x1654AE6B, 0xAE, 0xD7, 0x83, 0x86
DEFAULT_DURATION, AUDIO, SAMPLING, CHANNELS, BIT_DEPTH = 0x23E383, 0xE1, 0xB5, 0x9F, 0x6264
CLUSTER, CLUSTER_TIME, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK = 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1
CUES, CUE_POINT, CUE_TIME, CUE_POSITIONS, CUE_TRACK, CUE_CLUSTER = 0x1C53BB6B, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
DOC_TYPE, EBML_VERSION, DOC_VERSION, TRACK_UID, LACING_FLAG = 0x4282, 0x4286, 0x4287, 0x73C5, 0x9C
#: Level-0 and level-1 elements: an element of unknown size ends where one of these begins.
TOP = {EBML, SEGMENT, INFO, TRACKS, CLUSTER, CUES, 0x114D9B74, 0x1043A770, 0x1941A469, 0x1254C367}
#: Samples of one packet: the unit of a payload.
UNIT = 576
PER_BLOCK, PER_CLUSTER = 8, 32
RATE = 8000


@dataclass
class Movie:
    scale: int = 1_000_000
    duration: float | None = None
    tracks: list[dict] = field(default_factory=list)
    packets: list[dict] = field(default_factory=list)
    cues: list[dict] = field(default_factory=list)
    error: str | None = None


def read_vint(b: bytes, at: int, marked: bool = False) -> tuple[int, int, bool]:
    """(value, next position, all bits set): a variable-length integer; ``marked`` keeps its length bit, as ids do."""
    if at >= len(b) or not b[at]:
        raise ValueError("bad variable-length integer")
    n = 9 - b[at].bit_length()
    if at + n > len(b):
        raise ValueError("truncated variable-length integer")
    v = int.from_bytes(b[at : at + n], "big")
    bare = v & (1 << 7 * n) - 1
    return (v if marked else bare), at + n, bare == (1 << 7 * n) - 1


def elements(b: bytes, at: int, end: int, level: int) -> Iterator[tuple[int, int, int, int]]:
    """(id, start, first byte of data, end of data) of the elements from ``at`` to ``end``."""
    while at < end:
        start = at
        ident, at, _ = read_vint(b, at, True)
        size, at, unknown = read_vint(b, at)
        stop = min(end, at + size)
        if unknown:
            stop = end
            if ident == CLUSTER:  # up to the next element of its own level
                p = at
                while p < end:
                    inner, q, _ = read_vint(b, p, True)
                    if inner in TOP:
                        break
                    n, q, _ = read_vint(b, q)
                    p = q + n
                stop = min(p, end)
        elif at + size > end and level > 0 and ident in (SIMPLE_BLOCK, BLOCK):
            raise ValueError("truncated block")
        yield ident, start, at, stop
        at = stop


def unlace(b: bytes, at: int, end: int, kind: int) -> list[tuple[int, int]]:
    """Byte ranges of a block's frames; ``kind``: 0 none, 1 Xiph, 2 fixed, 3 EBML."""
    if not kind:
        return [(at, end)]
    count, at = b[at] + 1, at + 1
    sizes: list[int] = []
    if kind == 2:
        if (end - at) % count:
            raise ValueError("fixed lacing doesn't divide the block")
        sizes = [(end - at) // count] * (count - 1)
    elif kind == 1:
        for _ in range(count - 1):
            n = 0
            while b[at] == 255:
                n, at = n + 255, at + 1
            sizes.append(n + b[at])
            at += 1
    else:
        for k in range(count - 1):
            start = at
            v, at, _ = read_vint(b, at)
            sizes.append(v if not k else sizes[-1] + v - ((1 << 7 * (at - start) - 1) - 1))
    out = []
    for n in sizes:
        out.append((at, at + n))
        at += n
    if at > end or any(n < 0 for n in sizes):
        raise ValueError("laces exceed the block")
    return [*out, (at, end)]


def _uint(b: bytes, at: int, end: int) -> int:
    return int.from_bytes(b[at:end], "big")


def _float(b: bytes, at: int, end: int) -> float:
    return float(np.frombuffer(b[at:end], ">f4" if end - at == 4 else ">f8")[0]) if end - at in (4, 8) else 0.0


def _block(b: bytes, at: int, end: int, movie: Movie, cluster: int, time: int, simple: bool, key: bool) -> None:
    track, p, _ = read_vint(b, at)
    if p + 3 > end:
        raise ValueError("short block")
    relative, flags = int.from_bytes(b[p : p + 2], "big", signed=True), b[p + 2]
    step = next((t.get("step") or 0 for t in movie.tracks if t.get("number") == track), 0)
    for k, (x, y) in enumerate(unlace(b, p + 3, end, flags >> 1 & 3)):
        movie.packets.append({"track": track, "cluster": cluster, "timestamp": (time + relative) * movie.scale + k * step, "lace": k, "offset": x, "size": y - x, "keyframe": bool(flags & 0x80) if simple else key})


def parse(b: bytes) -> Movie:
    """Packets in file order; a broken file has those before the fault, and the fault in ``error``."""
    m, clusters = Movie(), 0
    try:
        for top, _, a, z in elements(b, 0, len(b), 0):
            for ident, _, x, y in elements(b, a, z, 0) if top == SEGMENT else ():
                # read one by one: what stands before a fault counts
                inner = ((i, p, q) for i, _, p, q in elements(b, x, y, 1)) if ident in (INFO, TRACKS, CLUSTER, CUES) else ()
                if ident == INFO:
                    for i, p, q in inner:
                        if i == TIMESTAMP_SCALE:
                            m.scale = _uint(b, p, q)
                        elif i == DURATION:
                            m.duration = _float(b, p, q)
                elif ident == TRACKS:
                    for i, p, q in inner:
                        if i == TRACK_ENTRY:
                            own = {j: (r, s) for j, _, r, s in elements(b, p, q, 2)}
                            audio = {j: (r, s) for j, _, r, s in elements(b, *own[AUDIO], 3)} if AUDIO in own else {}
                            m.tracks.append({"number": _uint(b, *own[TRACK_NUMBER]) if TRACK_NUMBER in own else None, "type": _uint(b, *own[TRACK_TYPE]) if TRACK_TYPE in own else None, "codec": b[slice(*own[CODEC_ID])].decode("latin-1") if CODEC_ID in own else None, "step": _uint(b, *own[DEFAULT_DURATION]) if DEFAULT_DURATION in own else None, "rate": _float(b, *audio[SAMPLING]) if SAMPLING in audio else None, "bits": _uint(b, *audio[BIT_DEPTH]) if BIT_DEPTH in audio else None})
                elif ident == CLUSTER:
                    time = 0  # a cluster's time stands before its blocks
                    for i, p, q in inner:
                        if i == CLUSTER_TIME:
                            time = _uint(b, p, q)
                        elif i == SIMPLE_BLOCK:
                            _block(b, p, q, m, clusters, time, True, False)
                        elif i == BLOCK_GROUP:
                            parts = {j: (r, s) for j, _, r, s in elements(b, p, q, 2)}
                            if BLOCK in parts:
                                _block(b, *parts[BLOCK], m, clusters, time, False, 0xFB not in parts)
                    clusters += 1
                elif ident == CUES:
                    for i, p, q in inner:
                        if i == CUE_POINT:
                            point = {j: (r, s) for j, _, r, s in elements(b, p, q, 2)}
                            where = {j: (r, s) for j, _, r, s in elements(b, *point[CUE_POSITIONS], 3)} if CUE_POSITIONS in point else {}
                            m.cues.append({"time": _uint(b, *point[CUE_TIME]) if CUE_TIME in point else 0, "track": _uint(b, *where[CUE_TRACK]) if CUE_TRACK in where else 0, "position": a + _uint(b, *where[CUE_CLUSTER]) if CUE_CLUSTER in where else None})
    except (ValueError, IndexError) as e:
        m.error = str(e) or "truncated"
    return m


def vint(v: int, least: int = 1) -> bytes:
    n = least
    while v >= (1 << 7 * n) - 1:
        n += 1
    return (v | 1 << 7 * n).to_bytes(n, "big")


def element(ident: int, data: bytes) -> bytes:
    return ident.to_bytes((ident.bit_length() + 7) // 8, "big") + vint(len(data)) + data


def _number(ident: int, v: int) -> bytes:
    return element(ident, v.to_bytes(max(1, (v.bit_length() + 7) // 8), "big"))


def lace(frames: list[bytes], kind: int) -> bytes:
    """The frames of one block with their sizes, as ``unlace`` reads them."""
    if not kind:
        return frames[0]
    head = bytes([len(frames) - 1])
    if kind == 1:
        head += b"".join(b"\xff" * (len(f) // 255) + bytes([len(f) % 255]) for f in frames[:-1])
    elif kind == 3:
        for k, f in enumerate(frames[:-1]):
            if not k:
                head += vint(len(f))
                continue
            d, n = len(f) - len(frames[k - 1]), 1
            while abs(d) > (1 << 7 * n - 1) - 2:
                n += 1
            head += (d + (1 << 7 * n - 1) - 1 | 1 << 7 * n).to_bytes(n, "big")
    return head + b"".join(frames)


def mux(payload: bytes, unit: int = UNIT) -> bytes:
    """One 8-bit mono PCM track of ``unit`` samples a frame; full blocks are laced with fixed sizes, the last one with EBML sizes if it's short."""
    frames = [payload[i : i + unit] for i in range(0, len(payload), unit)]
    ms = unit * 1000 // RATE
    head = element(EBML, _number(EBML_VERSION, 1) + element(DOC_TYPE, b"matroska") + _number(DOC_VERSION, 4))
    info = element(INFO, _number(TIMESTAMP_SCALE, 1_000_000) + element(DURATION, np.array([len(frames) * ms], ">f8").tobytes()))
    audio = element(AUDIO, element(SAMPLING, np.array([RATE], ">f8").tobytes()) + _number(CHANNELS, 1) + _number(BIT_DEPTH, 8))
    track = element(TRACK_ENTRY, _number(TRACK_NUMBER, 1) + _number(TRACK_UID, 1) + _number(TRACK_TYPE, 2) + _number(LACING_FLAG, 1) + _number(DEFAULT_DURATION, ms * 1_000_000) + element(CODEC_ID, b"A_PCM/INT/LIT") + audio)
    parts, cues = [info, element(TRACKS, track)], []
    at = sum(map(len, parts))
    for c in range(0, len(frames), PER_CLUSTER):
        body = [_number(CLUSTER_TIME, c * ms)]
        for k in range(c, min(c + PER_CLUSTER, len(frames)), PER_BLOCK):
            group = frames[k : min(k + PER_BLOCK, c + PER_CLUSTER)]
            kind = 0 if len(group) == 1 else 2 if len(group) == PER_BLOCK else 3
            body.append(element(SIMPLE_BLOCK, b"\x81" + ((k - c) * ms).to_bytes(2, "big") + bytes([0x80 | kind << 1]) + lace(group, kind)))
        parts.append(element(CLUSTER, b"".join(body)))
        cues.append(element(CUE_POINT, _number(CUE_TIME, c * ms) + element(CUE_POSITIONS, _number(CUE_TRACK, 1) + _number(CUE_CLUSTER, at))))
        at += len(parts[-1])
    return head + element(SEGMENT, b"".join(parts) + element(CUES, b"".join(cues)))


def payload_of(text: str | None, unit: int = UNIT) -> tuple[int, bytes]:
    """(bytes of the text, these padded with 255 to a positive multiple of ``unit``)."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return len(raw), raw + b"\xff" * (-len(raw) % unit or (0 if raw else unit))


PACKET = StructType([StructField("track", LongType()), StructField("cluster", LongType()), StructField("timestamp", LongType()), StructField("lace", IntegerType()), StructField("offset", LongType()), StructField("size", LongType()), StructField("keyframe", BooleanType())])
PACKET_ARROW = pa.list_(pa.struct([("track", pa.int64()), ("cluster", pa.int64()), ("timestamp", pa.int64()), ("lace", pa.int32()), ("offset", pa.int64()), ("size", pa.int64()), ("keyframe", pa.bool_())]))


def _packets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 64):  # a few files at a time
            part = batch.slice(at, 64)
            movies = [parse(x.as_buffer().to_pybytes()) if x.is_valid else Movie(error="no bytes") for x in part.column(1)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([m.packets for m in movies], PACKET_ARROW), pa.array([m.error for m in movies], pa.string())], names=["id", "packets", "error"])


def read_packets(media: DataFrame, id_col: str, media_col: str) -> DataFrame:
    """(id, track, cluster, timestamp in ns, lace, offset, size, keyframe, error): the packet table of a column of Matroska files.

    A null or broken file has its packets up to the fault, and the fault in ``error``; without packets it has one row of
    nulls. Repeated rows are read each. An empty table gives an empty one.
    """
    own = media.select(media[id_col].alias("id"), media[media_col].cast("binary").alias("media"))
    schema = StructType([own.schema["id"], StructField("packets", ArrayType(PACKET)), StructField("error", StringType())])
    return own.mapInArrow(_packets, schema).select("id", F.explode_outer("packets").alias("p"), "error").select("id", "p.*", "error")


def _muxed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 64):
            part = batch.slice(at, 64)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([mux(payload_of(x.as_py())[1]) for x in part.column(1)], pa.binary())], names=["id", "media"])


def write_media(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, media): each text's padded UTF-8 bytes as the samples of a Matroska file. Nulls count as empty texts."""
    own = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))
    return own.mapInArrow(_muxed, StructType([own.schema["id"], StructField("media", BinaryType())]))


def describe(text: str | None) -> dict:
    """One text stored and read back: sizes, digests and features of the packets and samples."""
    n, payload = payload_of(text)
    media = mux(payload)
    movie = parse(media)
    back = b"".join(media[p["offset"] : p["offset"] + p["size"]] for p in movie.packets)
    samples = np.frombuffer(back, np.uint8)
    ends = movie.packets[-1]["timestamp"] // 1_000_000 if movie.packets else 0
    laced = sum(p["lace"] > 0 for p in movie.packets)
    cued = sum(media[c["position"] : c["position"] + 4] == CLUSTER.to_bytes(4, "big") for c in movie.cues)  # that point at a cluster
    feature = f"packets={len(movie.packets)};clusters={len({p['cluster'] for p in movie.packets})};cues={len(movie.cues)};cued={cued};laced={laced};last_ms={ends};sum={int(samples.sum(dtype=np.int64))};max={int(samples.max()) if len(samples) else 0};turns={int(np.count_nonzero(np.diff(samples > 127)))}"
    return {"n_bytes": n, "payload_bytes": len(back), "payload_sha256": hashlib.sha256(back).hexdigest(), "tail_crc32": zlib.crc32(back[-32:]), "media_bytes": len(media), "media_sha256": hashlib.sha256(media).hexdigest(), "feature": feature}


DIGEST = {"n_bytes": pa.int64(), "payload_bytes": pa.int64(), "payload_sha256": pa.string(), "tail_crc32": pa.int64(), "media_bytes": pa.int64(), "media_sha256": pa.string(), "feature": pa.string()}


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [describe(x.as_py()) for x in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array([r[k] for r in rows], t) for k, t in DIGEST.items()]], names=["id", *DIGEST])


def media_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature), a row for each row.

    Every text is muxed, parsed again, and the packets' bytes are put together; no shuffle, one file in memory at a time. Null
    and empty texts are one frame of padding; repeated rows and ids, null ids too, give rows each; an empty table gives an
    empty one. Other columns are not read, whatever their names.
    """
    own = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))
    schema = StructType([own.schema["id"], *[StructField(k, StringType() if t == pa.string() else LongType()) for k, t in DIGEST.items()]])
    return own.mapInArrow(_described, schema).withColumnRenamed("id", "doc_id")
