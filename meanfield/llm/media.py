"""Media columns: lossless 8-bit PNG in binary columns, read back with numpy, and cosine-transform hashes."""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import tidy

#: Fixed values of the PNG format.
SIGNATURE = b"\x89PNG\r\n\x1a\n"
IDAT_BYTES = 1 << 20
MEDIA = "doc_id long, n_bytes long, media binary"


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def _filtered(image: np.ndarray, kind: int) -> np.ndarray:
    """The residuals of one PNG filter (0 none, 1 sub, 2 up, 3 average, 4 Paeth)."""
    x = image.astype(np.int16)
    left, up, corner = np.zeros_like(x), np.zeros_like(x), np.zeros_like(x)
    left[:, 1:], up[1:], corner[1:, 1:] = x[:, :-1], x[:-1], x[:-1, :-1]
    if kind == 3:
        guess = (left + up) // 2
    elif kind == 4:
        guess = _paeth(left, up, corner)
    else:
        guess = (0, left, up)[kind]
    return (x - guess).astype(np.uint8)


def _paeth(left, up, corner):
    p = left + up - corner
    a, b, c = abs(p - left), abs(p - up), abs(p - corner)
    return np.where((a <= b) & (a <= c), left, np.where(b <= c, up, corner))


def encode_png(image: np.ndarray, filters: tuple[int, ...] = (0, 1, 2), level: int = 1) -> bytes:
    """An 8-bit greyscale PNG of a (height, width) uint8 array.

    Of ``filters`` it takes for the whole image the one with the least sum of absolute signed residuals.
    """
    height, width = image.shape
    best = min(((np.abs(r.view(np.int8).astype(np.int16)).sum(), k, r) for k, r in ((k, _filtered(image, k)) for k in filters)), key=lambda x: x[:2])
    rows = np.empty((height, width + 1), np.uint8)
    rows[:, 0], rows[:, 1:] = best[1], best[2]
    data = zlib.compress(rows.tobytes(), level)
    parts = [_chunk(b"IDAT", data[i : i + IDAT_BYTES]) for i in range(0, len(data), IDAT_BYTES)]
    return b"".join([SIGNATURE, _chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)), *parts, _chunk(b"IEND", b"")])


def decode_png(media: bytes) -> np.ndarray:
    """The (height, width) uint8 array of an 8-bit greyscale PNG; every chunk's checksum is tested."""
    if media is None or media[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at, data, head, ended = 8, [], None, False
    while at < len(media):
        (n,) = struct.unpack_from(">I", media, at)
        kind, body = media[at + 4 : at + 8], media[at + 8 : at + 8 + n]
        if len(body) != n or struct.pack(">I", zlib.crc32(kind + body)) != media[at + 8 + n : at + 12 + n]:
            raise ValueError(f"bad checksum in chunk {kind!r}")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            data.append(body)
        elif kind == b"IEND":
            ended = True
        at += 12 + n
    if not ended or head is None or head[2:] != (8, 0, 0, 0, 0):
        raise ValueError("not a whole 8-bit greyscale PNG")
    width, height = head[:2]
    rows = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(height, width + 1)
    return _unfiltered(rows[:, 0], rows[:, 1:])


def _unfiltered(kinds: np.ndarray, rest: np.ndarray) -> np.ndarray:
    if not kinds.any():
        return rest
    if (kinds == 1).all():
        return np.cumsum(rest, axis=1, dtype=np.uint8)
    if (kinds == 2).all():
        return np.cumsum(rest, axis=0, dtype=np.uint8)
    out = np.zeros(rest.shape, np.uint8)
    up = np.zeros(rest.shape[1], np.uint8)
    for y, kind in enumerate(kinds.tolist()):
        if kind == 0:
            out[y] = rest[y]
        elif kind == 1:
            out[y] = np.cumsum(rest[y], dtype=np.uint8)
        elif kind == 2:
            out[y] = rest[y] + up
        elif kind in (3, 4):
            left = corner = 0
            for x, (r, u) in enumerate(zip(rest[y].tolist(), up.tolist(), strict=True)):
                guess = (left + u) // 2 if kind == 3 else int(_paeth(np.int16(left), np.int16(u), np.int16(corner)))
                left, corner = (r + guess) & 255, u
                out[y, x] = left
        else:
            raise ValueError(f"unknown filter {kind}")
        up = out[y]
    return out


_DCT = np.cos(np.pi / 32 * np.outer(np.arange(8), np.arange(32) + 0.5))


def cosine_hash(image: np.ndarray) -> str:
    """64 bits in hexadecimal: signs, against their median, of the 8 x 8 lowest frequencies of the 32 x 32 area means."""
    small = image.astype(np.float64)
    for axis in (0, 1):
        n = small.shape[axis]
        if n < 32:
            small = np.repeat(small, -(-32 // n), axis=axis)
            n = small.shape[axis]
        cut = np.arange(32) * n // 32
        small = np.add.reduceat(small, cut, axis=axis) / np.expand_dims(np.diff(np.append(cut, n)), 1 - axis)
    low = (_DCT @ small @ _DCT.T).ravel()
    return np.packbits(low > np.median(low[1:])).tobytes().hex()


def store_texts(docs: DataFrame, width: int = 64, level: int = 1) -> DataFrame:
    """doc_id, n_bytes, media: each text's UTF-8 bytes, padded with 0 to a positive multiple of ``width``, as PNG rows.

    Null text is stored as empty; equal texts give equal media; texts of any length are stored whole; null doc_ids pass
    through; extra columns are ignored; an empty table gives an empty result.
    """

    def run(batches):
        for batch in batches:
            sizes, media = [], []
            for text in batch.column(1):
                raw = text.as_buffer() if text.is_valid else b""
                raw = bytes(raw) if raw is not None else b""
                padded = raw.ljust(max(1, -(-len(raw) // width)) * width, b"\0")
                sizes.append(len(raw))
                media.append(encode_png(np.frombuffer(padded, np.uint8).reshape(-1, width), level=level))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(tidy(run), MEDIA)


FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def read_features(media: DataFrame) -> DataFrame:
    """FEATURES of a table MEDIA: decodes every value with its checksums tested and hashes what was read back.

    A value that isn't a whole PNG with right checksums raises ValueError, null too; null doc_ids pass through; equal
    values give equal features; repeated rows are kept; extra columns are ignored; an empty table gives an empty result.
    """

    def run(batches):
        for batch in batches:
            cols: list[list] = [[], [], [], [], [], []]
            for value in batch.column(2):
                stored = value.as_py()
                image = decode_png(stored)
                payload = image.tobytes()
                for col, v in zip(cols, (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(stored), hashlib.sha256(stored).hexdigest(), cosine_hash(image)), strict=True):
                    col.append(v)
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            names = [x.split()[0] for x in FEATURES.split(", ")]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names)

    return media.select("doc_id", "n_bytes", "media").mapInArrow(tidy(run), FEATURES)
