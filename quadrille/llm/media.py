"""Media columns: AVI motion-JPEG.

A payload is stored as 24 x 24 grey frames of 8-bit samples, one intra-coded JPEG a frame, in an AVI file with an
idx1 index. Frames are lossless JPEG (SOF3, predictor 1) with a Huffman table whose codes and extra bits add up to 9
bits for every sample, so frames are packed and unpacked as whole arrays. Reading parses the RIFF chunks, finds the
frames by the index, reads each frame's own tables, decodes, and takes histograms; a shot begins where the histogram
difference exceeds the mean of the other differences around it by ``k`` of their standard deviations.

Defined cases: null text is empty and gives one frame of padding; repeated rows are stored each, equal texts to equal
bytes; equal differences are no cut; an empty table gives no rows; doc_ids are whole numbers; extra columns are not
read. A very long text is one file, with all its cuts; memory holds a few times its size.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

SIDE, FRAME, FPS = 24, 576, 25
DIGESTS = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
CLIPS = "doc_id long, clip int, start_frame int, end_frame int, start_s double, end_s double, change double"

#: Category c of a difference has c extra bits and a code of 9 - c bits: category 8 first, '0', then '10', '110', ...
_CATEGORIES = list(range(8, -1, -1))
_HEAD = (
    b"\xff\xd8"
    + b"\xff\xc4" + struct.pack(">HB", 2 + 1 + 16 + 9, 0) + bytes([1] * 9 + [0] * 7) + bytes(_CATEGORIES)
    + b"\xff\xc3" + struct.pack(">HBHHBBBB", 11, 8, SIDE, SIDE, 1, 1, 0x11, 0)
    + b"\xff\xda" + struct.pack(">HBBBBBB", 8, 1, 1, 0, 1, 0, 0)
)


def _code_table() -> np.ndarray:
    """The 9 bits of each difference from -255 to 255."""
    out = np.zeros(511, dtype=np.uint16)
    for d in range(-255, 256):
        c = abs(d).bit_length()
        extra = d if d > 0 else d + (1 << c) - 1
        prefix = (1 << (9 - c)) - 2
        out[d + 255] = (prefix << c) | extra
    return out


_CODES = _code_table()


def encode_frames(frames: np.ndarray) -> list[bytes]:
    """frames: (n, 24, 24) samples. The JPEG of each."""
    x = frames.astype(np.int16)
    diff = np.empty_like(x)
    diff[:, :, 1:] = x[:, :, 1:] - x[:, :, :-1]
    diff[:, 1:, 0] = x[:, 1:, 0] - x[:, :-1, 0]
    diff[:, 0, 0] = x[:, 0, 0] - 128
    c = _CODES[diff.reshape(-1, 8) + 255]
    body = np.empty((len(c), 9), dtype=np.uint8)
    body[:, 0] = c[:, 0] >> 1
    for k in range(1, 8):
        body[:, k] = ((c[:, k - 1] << (8 - k)) | (c[:, k] >> (k + 1))) & 255
    body[:, 8] = c[:, 7] & 255
    flat = body.reshape(len(frames), -1)
    full = flat == 255
    sizes = flat.shape[1] + full.sum(axis=1)
    ends = np.cumsum(sizes)
    stuffed = np.insert(flat.reshape(-1), np.flatnonzero(full.reshape(-1)) + 1, 0).tobytes()
    return [_HEAD + stuffed[e - s : e] + b"\xff\xd9" for s, e in zip(sizes.tolist(), ends.tolist())]


def _chunk(name: bytes, data: bytes) -> bytes:
    return name + struct.pack("<I", len(data)) + data + b"\0" * (len(data) & 1)


def write_avi(frames: list[bytes]) -> bytes:
    longest = max(map(len, frames))
    avih = struct.pack("<14I", 1_000_000 // FPS, longest * FPS, 0, 0x10, len(frames), 0, 1, longest, SIDE, SIDE, 0, 0, 0, 0)
    strh = b"vidsMJPG" + struct.pack("<IHHIIIIIIiI4h", 0, 0, 0, 0, 1, FPS, 0, len(frames), longest, -1, 0, 0, 0, SIDE, SIDE)
    strf = struct.pack("<IiiHH4sIiiII", 40, SIDE, SIDE, 1, 8, b"MJPG", FRAME, 0, 0, 0, 0)
    strl = _chunk(b"LIST", b"strl" + _chunk(b"strh", strh) + _chunk(b"strf", strf))
    hdrl = _chunk(b"LIST", b"hdrl" + _chunk(b"avih", avih) + strl)
    at, movi, index = 4, [b"movi"], []
    for f in frames:
        movi.append(_chunk(b"00dc", f))
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(f)))
        at += len(movi[-1])
    return _chunk(b"RIFF", b"AVI " + hdrl + _chunk(b"LIST", b"".join(movi)) + _chunk(b"idx1", b"".join(index)))


def read_avi(data: bytes) -> list[bytes]:
    """The frames that the index names; without an index, those of the movi list in order."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    at, end, movi, index = 12, 8 + struct.unpack_from("<I", data, 4)[0], None, None
    while at + 8 <= end:
        name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        if name == b"LIST" and data[at + 8 : at + 12] == b"movi":
            movi = (at + 8, at + 8 + size)
        elif name == b"idx1":
            index = np.frombuffer(data, dtype="<u4", count=size // 4, offset=at + 8).reshape(-1, 4)
        at += 8 + size + (size & 1)
    if movi is None:
        raise ValueError("no movi list")
    if index is not None:
        video = index[index[:, 0] == struct.unpack("<I", b"00dc")[0]]
        return [data[movi[0] + o + 8 : movi[0] + o + 8 + s] for o, s in video[:, 2:].tolist()]
    out, at = [], movi[0] + 4
    while at + 8 <= movi[1]:
        size = struct.unpack_from("<I", data, at + 4)[0]
        if data[at : at + 4] == b"00dc":
            out.append(data[at + 8 : at + 8 + size])
        at += 8 + size + (size & 1)
    return out


def _parse_head(jpeg: bytes) -> tuple[int, int, int, np.ndarray]:
    """Where the samples begin, height, width, and the difference that each 9 bits stand for."""
    at, lengths, symbols, shape = 2, [], b"", None
    while True:
        mark, size = jpeg[at + 1], struct.unpack_from(">H", jpeg, at + 2)[0]
        part = jpeg[at + 4 : at + 2 + size]
        if mark == 0xC4:
            lengths, symbols = list(part[1:17]), part[17:]
        elif mark == 0xC3:
            shape = struct.unpack_from(">HH", part, 1)
        elif mark == 0xDA:
            if shape is None or part[3] != 1:
                raise ValueError("only lossless frames with predictor 1 are read")
            break
        at += 2 + size
    table, code, k = np.full(512, -999, dtype=np.int16), 0, 0
    for n, count in enumerate(lengths, 1):
        for _ in range(count):
            c = symbols[k]
            if n + c != 9:
                raise ValueError("only codes of 9 bits with their extra bits are read")
            extra = np.arange(1 << c)
            table[(code << c) + extra] = np.where(extra < (1 << c) >> 1, extra - (1 << c) + 1, extra)
            code, k = code + 1, k + 1
        code <<= 1
    return at + 2 + struct.unpack_from(">H", jpeg, at + 2)[0], *shape, table


def decode_frames(jpegs: list[bytes]) -> np.ndarray:
    """(n, height, width) samples. Frames with equal heads are decoded together."""
    begin, height, width, table = _parse_head(jpegs[0])
    head = jpegs[0][:begin]
    if any(j[:begin] != head for j in jpegs):
        return np.concatenate([decode_frames([j]) for j in jpegs])
    raw = np.frombuffer(b"".join(j[begin:-2] for j in jpegs), dtype=np.uint8)
    keep = np.ones(len(raw), dtype=bool)
    keep[1:] = ~((raw[:-1] == 255) & (raw[1:] == 0))
    b = raw[keep].reshape(-1, 9).astype(np.uint16)
    c = np.empty((len(b), 8), dtype=np.uint16)
    for k in range(8):
        c[:, k] = ((b[:, k] << (k + 1)) | (b[:, k + 1] >> (7 - k))) & 511
    diff = table[c].reshape(-1, height, width).astype(np.int32)
    diff[:, 0, 0] += 128
    diff[:, :, 0] = np.cumsum(diff[:, :, 0], axis=1)
    return np.cumsum(diff, axis=2).astype(np.uint8)


def histograms(frames: np.ndarray, bins: int = 16) -> np.ndarray:
    flat = (frames.reshape(len(frames), -1) >> 4).astype(np.int64) + np.arange(len(frames))[:, None] * bins
    return np.bincount(flat.reshape(-1), minlength=len(frames) * bins).reshape(-1, bins)


def shots(frames: np.ndarray, k: float = 2.0, window: int = 8) -> tuple[list[tuple[int, int]], np.ndarray]:
    """The clips as [first, end) frames, and the change before each frame."""
    h = histograms(frames)
    change = np.zeros(len(h))
    change[1:] = np.abs(np.diff(h, axis=0)).sum(axis=1) / (2.0 * max(1, frames[0].size))
    c1, c2 = np.concatenate([[0.0], np.cumsum(change)]), np.concatenate([[0.0], np.cumsum(change**2)])
    i = np.arange(len(h))
    a, b = np.maximum(i - window, 1), np.minimum(i + window + 1, len(h))  # frame 0 has no change before it
    others = np.maximum(b - a - (i > 0), 1)  # a frame is not compared with itself
    mean = (c1[b] - c1[a] - change) / others
    deviation = np.sqrt(np.maximum((c2[b] - c2[a] - change**2) / others - mean**2, 0))
    cuts = [0, *np.flatnonzero((change > mean + k * deviation) & (change > 0.05) & (i > 0)).tolist(), len(h)]
    return list(zip(cuts[:-1], cuts[1:])), change


def payload_of(text: str | None) -> tuple[int, np.ndarray]:
    raw = (text or "").encode("utf-8")
    return len(raw), np.frombuffer(raw + b"\xff" * (-len(raw) % FRAME or (0 if raw else FRAME)), dtype=np.uint8)


def store(text: str | None) -> tuple[int, bytes]:
    n, payload = payload_of(text)
    return n, write_avi(encode_frames(payload.reshape(-1, SIDE, SIDE)))


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    fields = [x.split() for x in DIGESTS.split(", ")]
    for batch in batches:
        rows = []
        for i, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
            n, media = store(text.as_py())
            frames = decode_frames(read_avi(media))
            payload = frames.tobytes()
            clips, change = shots(frames)
            feature = f"frames={len(frames)};clips={len(clips)};cuts={','.join(str(a) for a, _ in clips[1:])};change={change.mean():.6f};mean={frames.mean():.4f}"
            rows.append((i, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature))
        cols = list(zip(*rows)) or [()] * len(fields)
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if k == "long" else pa.string()) for c, (_, k) in zip(cols, fields)], names=[f for f, _ in fields])


def _clips(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[tuple] = []
        for i, media in zip(batch.column("doc_id").to_pylist(), batch.column("media")):
            found, change = shots(decode_frames(read_avi(media.as_py())))
            out += [(i, k, a, b, a / FPS, b / FPS, float(change[a])) for k, (a, b) in enumerate(found)]
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.float64()]
        cols = list(zip(*out)) or [()] * 7
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=[x.split()[0] for x in CLIPS.split(", ")])


def clip_rows(media: DataFrame) -> DataFrame:
    """media: doc_id and media (AVI bytes, not null). One row a clip, with its frames and seconds."""
    return media.filter("media is not null").select("doc_id", "media").mapInArrow(_clips, CLIPS)


def media_digests(docs: DataFrame) -> DataFrame:
    """Each text stored as AVI, read back by its index, and digested."""
    return docs.select("doc_id", "text").mapInArrow(_digest, DIGESTS)
