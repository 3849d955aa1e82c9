"""Media columns: Netpbm and BMP images as bytes, numpy arrays, NPY tiles and difference hashes.

``decode`` reads binary Netpbm (P4, P5, P6 with 8- or 16-bit samples) and uncompressed
BMP (8-bit palette, 24- and 32-bit), ``encode_pgm`` and ``encode_bmp`` write 8-bit grey.
``area_resize`` averages exactly over fractional areas from an integral image;
``dhash`` compares neighbours of a 9 x 8 reduction, 64 bits as hex. ``tile`` is the
reduction written as an NPY file. All work on one image at a time, in Arrow batches.

Defined results of the query: a null text is empty; an empty text is one row of 64
zero bytes. Equal texts give equal values, as nothing else goes in. Further columns
are ignored, repeated rows stay.
"""

from __future__ import annotations

import hashlib
import io
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textbatch as tb
from .common import table

WIDTH = 64
TILE = 16
_HEAD = re.compile(rb"P([456])((?:\s+|#[^\n]*\n)+)(\d+)((?:\s+|#[^\n]*\n)+)(\d+)(?:((?:\s+|#[^\n]*\n)+)(\d+))?\s")


def encode_pgm(samples: np.ndarray) -> bytes:
    """8-bit grey samples, rows by columns, as binary PGM."""
    return b"P5\n%d %d\n255\n" % (samples.shape[1], samples.shape[0]) + samples.tobytes()


def encode_bmp(samples: np.ndarray) -> bytes:
    """8-bit grey samples as BMP with a grey palette; rows go bottom up, padded to 4 bytes."""
    h, w = samples.shape
    rows = np.zeros((h, (w + 3) & ~3), np.uint8)
    rows[:, :w] = samples[::-1]
    grey = np.arange(256, dtype=np.uint8)
    palette = np.stack([grey, grey, grey, np.zeros(256, np.uint8)], axis=1).tobytes()
    start = 14 + 40 + len(palette)
    head = struct.pack("<2sIHHI", b"BM", start + rows.size, 0, 0, start) + struct.pack("<IiiHHIIiiII", 40, w, h, 1, 8, 0, rows.size, 0, 0, 256, 256)
    return head + palette + rows.tobytes()


def decode(stored: bytes) -> np.ndarray:
    """Samples, rows by columns (by 3 for colour). ValueError for what is no such image."""
    return _decode_bmp(stored) if stored[:2] == b"BM" else _decode_netpbm(stored)


def _decode_netpbm(stored: bytes) -> np.ndarray:
    if stored[:2] == b"P4":
        m = re.match(rb"P4(?:\s+|#[^\n]*\n)+(\d+)(?:\s+|#[^\n]*\n)+(\d+)\s", stored)
        if not m:
            raise ValueError("no Netpbm header")
        w, h = int(m[1]), int(m[2])
        line = (w + 7) // 8
        bits = np.frombuffer(stored, np.uint8, h * line, m.end()).reshape(h, line)
        return (1 - np.unpackbits(bits, axis=1)[:, :w]) * np.uint8(255)
    m = _HEAD.match(stored)
    if not m or m[7] is None:
        raise ValueError("no Netpbm header")
    w, h, most, bands = int(m[3]), int(m[5]), int(m[7]), 3 if m[1] == b"6" else 1
    kind = np.dtype(np.uint8 if most < 256 else ">u2")
    if len(stored) - m.end() < w * h * bands * kind.itemsize:
        raise ValueError("Netpbm samples are missing")
    flat = np.frombuffer(stored, kind, w * h * bands, m.end())
    return flat.reshape((h, w, 3) if bands == 3 else (h, w))


def _decode_bmp(stored: bytes) -> np.ndarray:
    if len(stored) < 54:
        raise ValueError("no BMP header")
    start, size, w, h, _, depth, packed = struct.unpack_from("<I", stored, 10) + struct.unpack_from("<IiiHHI", stored, 14)
    if packed != 0 or depth not in (8, 24, 32):
        raise ValueError("a kind of BMP that isn't read")
    line = (w * depth // 8 + 3) & ~3
    if len(stored) < start + abs(h) * line:
        raise ValueError("BMP samples are missing")
    rows = np.frombuffer(stored, np.uint8, abs(h) * line, start).reshape(abs(h), line)
    rows = rows[::-1] if h > 0 else rows
    if depth != 8:
        return rows[:, : w * depth // 8].reshape(abs(h), w, depth // 8)[:, :, 2::-1]
    colours = struct.unpack_from("<I", stored, 46)[0] or 256
    palette = np.frombuffer(stored, np.uint8, colours * 4, 14 + size).reshape(colours, 4)[:, 2::-1]
    out = palette[rows[:, :w]]
    return np.ascontiguousarray(out[:, :, 0]) if np.array_equal(palette[:, 0], palette[:, 1]) and np.array_equal(palette[:, 0], palette[:, 2]) else out


def _along(integral: np.ndarray, n: int) -> np.ndarray:
    """The integral's values at n + 1 evenly spaced places along axis 0, between samples linearly."""
    size = len(integral) - 1
    place = np.arange(n + 1) * size
    whole, part = place // n, (place % n) / n
    after = np.minimum(whole + 1, size)
    return integral[whole] + (integral[after] - integral[whole]) * part[:, None]


def area_resize(samples: np.ndarray, height: int, width: int) -> np.ndarray:
    """Exact area means of a grey image. The integral along rows is kept only at the wanted columns."""
    columns = _along(np.vstack([np.zeros((1, samples.shape[0])), np.cumsum(samples.T, axis=0, dtype=np.float64)]), width)
    across = np.diff(columns, axis=0).T
    both = _along(np.vstack([np.zeros((1, width)), np.cumsum(across, axis=0)]), height)
    return np.diff(both, axis=0) * (height * width) / (samples.shape[0] * samples.shape[1])


def grey(samples: np.ndarray) -> np.ndarray:
    return samples if samples.ndim == 2 else samples @ np.array([0.299, 0.587, 0.114])


def dhash(samples: np.ndarray) -> str:
    small = area_resize(grey(samples), 8, 9)
    return np.packbits(small[:, 1:] > small[:, :-1] + 1e-9).tobytes().hex()


def tile(samples: np.ndarray, size: int = TILE) -> bytes:
    """The image reduced to size x size 8-bit samples, as the bytes of an NPY file."""
    out = io.BytesIO()
    np.save(out, np.clip(np.rint(area_resize(grey(samples), size, size)), 0, 255).astype(np.uint8))
    return out.getvalue()


def store(payload: bytes) -> bytes:
    """A payload of whole rows as an image: BMP where its checksum is odd, else PGM."""
    samples = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    return encode_bmp(samples) if zlib.crc32(payload) & 1 else encode_pgm(samples)


COLUMNS = "doc_id long, n_bytes long, media binary, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, tile binary"


def text_media(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Each text stored as an image and read back: the media and tile columns and what was computed from them."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("tile", pa.binary())])
        held, size = [], 0
        for batch in batches:
            for i, one in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = one.as_py() or b""
                media = store(raw + bytes(-len(raw) % WIDTH if raw else WIDTH))
                samples = decode(media)
                read = samples.tobytes()
                held.append((i, len(raw), media, len(read), hashlib.sha256(read).hexdigest(), zlib.crc32(read[-64:]), len(media), hashlib.sha256(media).hexdigest(), dhash(samples), tile(samples)))
                size += len(media)
                if size > 8 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)

    ids = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.encode(F.col(text).cast("string"), "UTF-8").alias("raw"))
    return ids.mapInArrow(tb.tidy(rows), COLUMNS)


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as media; the digests of what was read back."""
    out = text_media(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", F.sha2("tile", 256).alias("tile_sha256"))
