"""Media columns: ISO base media files in a binary column.

``encode`` stores a payload as a track of raw 8-bit grey frames. ``probe`` walks the nested boxes of any such file,
decodes the sample tables (sizes of 4 to 32 bits; fragments with their runs) and gives codec, duration and the byte ranges
of the keyframes without decoding a payload. ``payload`` follows the sample tables to the stored bytes. What can't be read
is an error that says why, never an empty answer.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haulgrid.llm.scratch import in_arrow

#: A frame of 24 x 24 grey pixels, frames of a second, frames of a chunk; each chunk begins with a keyframe.
SIDE, RATE, CHUNK = 24, 25, 25
FRAME = SIDE * SIDE
_NESTED = {b"mdia", b"minf", b"stbl", b"dinf", b"edts"}
#: Bits of a fragment's header and of its runs, which say what fields follow, and the bit of a sample that is no keyframe.
_BASE, _ENTRY, _DURATION, _SIZE, _FLAGS, _FROM_FRAGMENT = 0x1, 0x2, 0x8, 0x10, 0x20, 0x20000
_RUN_OFFSET, _RUN_FIRST, _RUN_DURATION, _RUN_SIZE, _RUN_FLAGS, _RUN_TIME = 0x1, 0x4, 0x100, 0x200, 0x400, 0x800
_NOT_KEY = 0x10000
_MATRIX = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def _box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4s", len(body) + 8, kind) + body


def _full(kind: bytes, flags: int, *parts: bytes) -> bytes:
    return _box(kind, struct.pack(">I", flags), *parts)


def padded(text: bytes) -> bytes:
    """The bytes with 255s after them, up to a positive multiple of a frame."""
    return text + b"\xff" * (max(1, -(-len(text) // FRAME)) * FRAME - len(text))


def encode(payload: bytes) -> bytes:
    """A file with one video track: a sample of FRAME bytes for each frame of the payload."""
    n, rest = divmod(len(payload), FRAME)
    if rest or not n:
        raise ValueError(f"a payload of {len(payload)} bytes is not whole frames")
    chunks = -(-n // CHUNK)
    first = _box(b"ftyp", b"isom", struct.pack(">I", 512), b"isomiso2")
    entry = _box(b"raw ", struct.pack(">6xH16xHHIII H32xHh", 1, SIDE, SIDE, 0x480000, 0x480000, 0, 1, 40, -1))
    runs = [(1, CHUNK if chunks > 1 else n)] + ([(chunks, n - CHUNK * (chunks - 1))] if chunks > 1 and n % CHUNK else [])

    def movie(at: int) -> bytes:
        wide = at + len(payload) > 0xFFFFFFFF
        places = np.arange(chunks, dtype=np.uint64) * np.uint64(CHUNK * FRAME) + np.uint64(at)
        keys = np.arange(chunks, dtype=np.uint64) * np.uint64(CHUNK) + np.uint64(1)
        table = _box(
            b"stbl",
            _full(b"stsd", 0, struct.pack(">I", 1), entry),
            _full(b"stts", 0, struct.pack(">III", 1, n, 1)),
            _full(b"stss", 0, struct.pack(">I", chunks), keys.astype(">u4").tobytes()),
            _full(b"stsc", 0, struct.pack(">I", len(runs)), *(struct.pack(">III", a, b, 1) for a, b in runs)),
            _full(b"stsz", 0, struct.pack(">II", FRAME, n)),
            _full(b"co64" if wide else b"stco", 0, struct.pack(">I", chunks), places.astype(">u8" if wide else ">u4").tobytes()),
        )
        data = _box(b"dinf", _full(b"dref", 0, struct.pack(">I", 1), _full(b"url ", 1)))
        info = _box(b"minf", _full(b"vmhd", 1, bytes(8)), data, table)
        media = _box(b"mdia", _full(b"mdhd", 0, struct.pack(">IIIIHH", 0, 0, RATE, n, 0x55C4, 0)), _full(b"hdlr", 0, struct.pack(">I4s12x", 0, b"vide"), b"grey\0"), info)
        head = _full(b"tkhd", 3, struct.pack(">IIIII8xHHHH", 0, 0, 1, 0, n, 0, 0, 0, 0), _MATRIX, struct.pack(">II", SIDE << 16, SIDE << 16))
        film = _full(b"mvhd", 0, struct.pack(">IIIIIH10x", 0, 0, RATE, n, 0x10000, 0x100), _MATRIX, bytes(24), struct.pack(">I", 2))
        return _box(b"moov", film, _box(b"trak", head, media))

    long = len(payload) + 8 > 0xFFFFFFFF
    lead = struct.pack(">I4sQ", 1, b"mdat", len(payload) + 16) if long else struct.pack(">I4s", len(payload) + 8, b"mdat")
    size = len(movie(len(payload)))
    return first + movie(len(first) + size + len(lead)) + lead + payload


@dataclass
class Track:
    number: int = 0
    handler: str = ""
    codec: str = ""
    timescale: int = 0
    duration: int = 0
    width: int = 0
    height: int = 0
    sizes: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    offsets: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    keys: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))


def boxes(data: memoryview, start: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(kind, start and end of the body) of the boxes side by side; 64-bit sizes and an open last box included."""
    while start + 8 <= end:
        size, kind = struct.unpack_from(">I4s", data, start)
        body = start + 8
        if size == 1:
            if body + 8 > end:
                raise ValueError("a box is cut off")
            size, body = struct.unpack_from(">Q", data, body)[0], body + 8
        elif size == 0:
            size = end - start
        if size < body - start or start + size > end:
            raise ValueError("a box is cut off")
        yield kind, body, start + size
        start += size


def _numbers(data: memoryview, at: int, end: int, count: int, kind: str) -> np.ndarray:
    wide = np.dtype(kind).itemsize * count
    if at + wide > end:
        raise ValueError("a table is cut off")
    return np.frombuffer(data[at : at + wide], kind).astype(np.int64)


def _track(data: memoryview, start: int, end: int) -> Track:
    track = Track()
    found: dict[bytes, tuple[int, int]] = {}

    def walk(lo: int, hi: int) -> None:
        for kind, a, b in boxes(data, lo, hi):
            if kind in _NESTED:
                walk(a, b)
            else:
                found.setdefault(kind, (a, b))

    walk(start, end)
    if b"tkhd" in found:
        a, _ = found[b"tkhd"]
        track.number = struct.unpack_from(">I", data, a + (20 if data[a] else 12))[0]
    if b"dref" in found:
        a, b = found[b"dref"]
        if any(not data[c + 3] & 1 for _, c, _ in boxes(data, a + 8, b)):
            raise ValueError("samples lie in another file")
    if b"mdhd" in found:
        a, _ = found[b"mdhd"]
        track.timescale, track.duration = struct.unpack_from(">IQ" if data[a] else ">II", data, a + (20 if data[a] else 12))
    if b"hdlr" in found:
        track.handler = bytes(data[found[b"hdlr"][0] + 8 : found[b"hdlr"][0] + 12]).decode("latin-1")
    if b"stsd" in found:
        a, b = found[b"stsd"]
        for kind, c, d in boxes(data, a + 8, b):
            track.codec = kind.decode("latin-1").strip()
            if track.handler == "vide" and d - c >= 28:
                track.width, track.height = struct.unpack_from(">HH", data, c + 24)
            break
    if b"stsz" in found:
        a, b = found[b"stsz"]
        same, n = struct.unpack_from(">II", data, a + 4)
        track.sizes = np.full(n, same, np.int64) if same else _numbers(data, a + 12, b, n, ">u4")
    elif b"stz2" in found:
        a, b = found[b"stz2"]
        bits, n = data[a + 7], struct.unpack_from(">I", data, a + 8)[0]
        if bits == 4:
            pairs = _numbers(data, a + 12, b, -(-n // 2), ">u1")
            track.sizes = np.stack([pairs >> 4, pairs & 15], axis=1).ravel()[:n]
        elif bits in (8, 16):
            track.sizes = _numbers(data, a + 12, b, n, f">u{bits // 8}")
        else:
            raise ValueError(f"sizes of {bits} bits")
    n = len(track.sizes)
    place = found.get(b"stco") or found.get(b"co64")
    if n and not (place and b"stsc" in found):
        raise ValueError("samples without a place")
    if n:
        a, b = place
        starts = _numbers(data, a + 8, b, struct.unpack_from(">I", data, a + 4)[0], ">u4" if b"stco" in found else ">u8")
        a, b = found[b"stsc"]
        runs = _numbers(data, a + 8, b, 3 * struct.unpack_from(">I", data, a + 4)[0], ">u4").reshape(-1, 3)
        per = np.repeat(runs[:, 1], np.diff(np.append(runs[:, 0], len(starts) + 1)))
        if len(per) != len(starts) or per.sum() != n:
            raise ValueError("sample tables disagree")
        before = np.cumsum(track.sizes) - track.sizes
        heads = np.cumsum(per) - per
        track.offsets = np.repeat(starts - before[heads], per) + before
    track.keys = np.arange(n)
    if b"stss" in found:
        a, b = found[b"stss"]
        track.keys = _numbers(data, a + 8, b, struct.unpack_from(">I", data, a + 4)[0], ">u4") - 1
        if len(track.keys) and (int(track.keys.max()) >= n or int(track.keys.min()) < 0):
            raise ValueError("a keyframe is no sample")
    return track


def _run(data: memoryview, at: int, end: int, track: Track, base: int, after: int, own: list[int]) -> int:
    """Appends a run's samples; ``own`` has the duration, size and flags of samples that say nothing else. The run's end."""
    word, n = struct.unpack_from(">II", data, at)
    flags, at, start, first = word & 0xFFFFFF, at + 8, after, None
    if flags & _RUN_OFFSET:
        start, at = base + struct.unpack_from(">i", data, at)[0], at + 4
    if flags & _RUN_FIRST:
        first, at = struct.unpack_from(">I", data, at)[0], at + 4
    fields = [bit for bit in (_RUN_DURATION, _RUN_SIZE, _RUN_FLAGS, _RUN_TIME) if flags & bit]
    table = _numbers(data, at, end, n * len(fields), ">u4").reshape(n, len(fields))
    duration, size, kind = (table[:, fields.index(bit)].copy() if bit in fields else np.full(n, x, np.int64) for bit, x in zip((_RUN_DURATION, _RUN_SIZE, _RUN_FLAGS), own, strict=True))
    if first is not None and n:
        kind[0] = first
    track.keys = np.concatenate([track.keys, len(track.sizes) + np.flatnonzero(kind & _NOT_KEY == 0)])
    track.offsets = np.concatenate([track.offsets, start + np.cumsum(size) - size])
    track.sizes = np.concatenate([track.sizes, size])
    track.duration += int(duration.sum())
    return start + int(size.sum())


def _fragment(data: memoryview, whole: int, lo: int, hi: int, tracks: dict[int, Track], defaults: dict[int, tuple]) -> None:
    """Appends the samples of a fragment whose box begins at ``whole``."""
    after = whole
    for kind, a, b in boxes(data, lo, hi):
        if kind != b"traf":
            continue
        track, base, own = None, after, [0, 0, 0]
        for inner, c, d in boxes(data, a, b):
            if inner == b"tfhd":
                word, number = struct.unpack_from(">II", data, c)
                flags, at = word & 0xFFFFFF, c + 8
                if number not in tracks:
                    raise ValueError("a fragment of no track")
                track, own = tracks[number], list(defaults.get(number, (0, 0, 0)))
                base = whole if flags & _FROM_FRAGMENT else after
                if flags & _BASE:
                    base, at = struct.unpack_from(">Q", data, at)[0], at + 8
                at += 4 * bool(flags & _ENTRY)
                for k, bit in enumerate((_DURATION, _SIZE, _FLAGS)):
                    if flags & bit:
                        own[k], at = struct.unpack_from(">I", data, at)[0], at + 4
                after = base
            elif inner == b"trun":
                if track is None:
                    raise ValueError("a run without its fragment's header")
                after = _run(data, c, d, track, base, after, own)


def parse(media: bytes) -> list[Track]:
    """All tracks of a file; ValueError where boxes or tables don't fit together."""
    data, tracks, defaults, at = memoryview(media), [], {}, 0
    try:
        for kind, lo, hi in boxes(data, 0, len(data)):
            if kind == b"moov":
                for inner, a, b in boxes(data, lo, hi):
                    if inner == b"trak":
                        tracks.append(_track(data, a, b))
                    elif inner == b"mvex":
                        defaults |= {n: x for n, _, *x in (struct.unpack_from(">IIIII", data, c + 4) for k, c, _ in boxes(data, a, b) if k == b"trex")}
            elif kind == b"moof":
                _fragment(data, at, lo, hi, {t.number: t for t in tracks}, defaults)
            at = hi
        for t in tracks:
            if len(t.sizes) and (int(t.offsets.min()) < 0 or int((t.offsets + t.sizes).max()) > len(data)):
                raise ValueError("a sample lies outside the file")
        return tracks
    except (struct.error, IndexError, RecursionError) as e:
        raise ValueError(f"malformed media: {e}") from e


def payload(media: bytes, track: Track) -> bytes:
    """The bytes of all samples in order; neighbours are read at one go."""
    ends = track.offsets + track.sizes
    cuts = np.flatnonzero(track.offsets[1:] != ends[:-1]) + 1
    edges = np.concatenate([[0], cuts, [len(ends)]]) if len(ends) else np.zeros(1, int)
    return b"".join(media[int(track.offsets[a]) : int(ends[b - 1])] for a, b in zip(edges[:-1], edges[1:], strict=True))


def encode_texts(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and media of every text (null: empty); equal texts give equal files."""

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                texts = [(x.as_py() or "").encode() for x in batch.column(1).slice(lo, 256)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, 256), pa.array([len(x) for x in texts], pa.int64()), pa.array([encode(padded(x)) for x in texts], pa.binary())], ["doc_id", "n_bytes", "media"])

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.transform(in_arrow, run, "doc_id long, n_bytes long, media binary")


PROBE = "codec string, handler string, width int, height int, timescale long, duration long, samples long, keyframes array<struct<start:long,size:long>>, error string"


def probe(df: DataFrame, column: str = "media", with_payload: bool = False) -> DataFrame:
    """The columns of ``df`` and a struct ``probe`` of the first track; its error says why a file can't be read.

    A null file has a null struct's fields and the error "no media". ``with_payload`` adds the stored bytes.
    """
    fields = PROBE + (", payload binary" if with_payload else "")
    kind = pa.struct([("codec", pa.string()), ("handler", pa.string()), ("width", pa.int32()), ("height", pa.int32()), ("timescale", pa.int64()), ("duration", pa.int64()), ("samples", pa.int64()), ("keyframes", pa.list_(pa.struct([("start", pa.int64()), ("size", pa.int64())]))), ("error", pa.string()), *([("payload", pa.binary())] if with_payload else [])])
    names = df.columns
    at = names.index(column)

    def one(media: bytes | None) -> dict:
        try:
            tracks = parse(media) if media is not None else []
            if not tracks:
                return {"error": "no media" if media is None else "no track"}
            t = tracks[0]
            keys = [{"start": int(s), "size": int(z)} for s, z in zip(t.offsets[t.keys], t.sizes[t.keys], strict=True)] if len(t.offsets) else []
            out = {"codec": t.codec, "handler": t.handler, "width": t.width, "height": t.height, "timescale": t.timescale, "duration": t.duration, "samples": len(t.sizes), "keyframes": keys}
            return out | ({"payload": payload(media, t)} if with_payload else {})
        except ValueError as e:
            return {"error": str(e)}

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([one(x.as_py()) for x in part.column(at)], kind)], [*names, "probe"])

    schema = ", ".join(f"`{n}` {t}" for n, t in df.dtypes) + f", probe struct<{', '.join(f'{x.split()[0]}:{x.split(maxsplit=1)[1]}' for x in _split(fields))}>"
    return df.transform(in_arrow, run, schema)


def _split(fields: str) -> list[str]:
    out, depth = [""], 0
    for ch in fields:
        depth += (ch == "<") - (ch == ">")
        if ch == "," and not depth:
            out.append("")
        else:
            out[-1] += ch
    return [x.strip() for x in out]


def media_report(docs: DataFrame) -> DataFrame:
    """Every text stored as a media file and read back: sizes, checksums and the features of the file.

    A null text is empty and stored as one frame of padding. Repeated rows are each returned, a null doc_id stays null, an
    empty table gives no rows; other columns are ignored.
    """
    read = probe(encode_texts(docs), with_payload=True)
    p = F.col("probe")
    spans = F.concat_ws(",", F.transform(p["keyframes"], lambda k: F.concat_ws("+", k["start"].cast("string"), k["size"].cast("string"))))
    feature = F.concat_ws(";", p["codec"], F.concat_ws("x", p["width"].cast("string"), p["height"].cast("string")), F.concat_ws("/", p["duration"].cast("string"), p["timescale"].cast("string")), p["samples"].cast("string"), F.size(p["keyframes"]).cast("string"), F.sha2(spans.cast("binary"), 256))
    stored = p["payload"]
    return read.select(
        "doc_id",
        "n_bytes",
        F.octet_length(stored).cast("long").alias("payload_bytes"),
        F.sha2(stored, 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(probe.payload, -32, 32)")).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        feature.alias("feature"),
    )
