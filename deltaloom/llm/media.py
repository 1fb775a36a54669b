"""Media columns: Netpbm and BMP images as numpy arrays, integral-image resizing, NPY tiles, difference hashes."""

from __future__ import annotations

import hashlib
import io
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .support import lean
from .textblocks import flat

#: Payloads are padded to multiples of this many bytes, which is also the width of the images that hold them.
UNIT = 64


def encode_pgm(pixels: np.ndarray) -> bytes:
    """A grey (h, w) or RGB (h, w, 3) array of 8-bit samples as binary PGM or PPM."""
    h, w = pixels.shape[:2]
    return f"P{5 if pixels.ndim == 2 else 6}\n{w} {h}\n255\n".encode() + np.ascontiguousarray(pixels, np.uint8).tobytes()


def encode_bmp(pixels: np.ndarray) -> bytes:
    """A grey (h, w) array as an 8-bit BMP with a grey palette, an RGB one as a 24-bit BMP; rows from the bottom up."""
    h, w = pixels.shape[:2]
    grey = pixels.ndim == 2
    rows = pixels[::-1] if grey else pixels[::-1, :, ::-1].reshape(h, 3 * w)
    rows = np.pad(rows, ((0, 0), (0, -rows.shape[1] % 4)))
    palette = np.repeat(np.arange(256, dtype=np.uint8), 4).reshape(256, 4) * np.array([1, 1, 1, 0], np.uint8) if grey else np.empty(0, np.uint8)
    start = 54 + palette.size
    head = struct.pack("<2sIHHI", b"BM", start + rows.size, 0, 0, start) + struct.pack("<IiiHHIIiiII", 40, w, h, 1, 8 if grey else 24, 0, rows.size, 2835, 2835, 256 if grey else 0, 0)
    return head + palette.tobytes() + rows.astype(np.uint8).tobytes()


def _netpbm(data: bytes) -> np.ndarray:
    kind, at, fields = data[1] - 48, 2, []
    need = 2 if kind in (1, 4) else 3
    while len(fields) < need:
        while at < len(data) and (data[at : at + 1].isspace() or data[at] == 35):
            at = data.find(b"\n", at) + 1 or len(data) if data[at] == 35 else at + 1
        end = at
        while end < len(data) and data[end : end + 1].isdigit():
            end += 1
        if end == at:
            raise ValueError("broken Netpbm header")
        fields.append(int(data[at:end]))
        at = end
    w, h, top = (*fields, 1)[:3]
    depth = 3 if kind in (3, 6) else 1
    n = w * h * depth
    if kind in (1, 2, 3):
        rest = b"\n".join(x.partition(b"#")[0] for x in data[at:].split(b"\n"))
        values = np.array(list(rest.translate(None, b" \t\r\n\v\f")) if kind == 1 else rest.split(), np.int64)[:n]
        values = 1 - (values - 48) if kind == 1 else values
    elif kind == 4:
        across = -(-w // 8)
        bits = np.unpackbits(np.frombuffer(data, np.uint8, across * h, at + 1).reshape(h, across), axis=1)[:, :w]
        values = 1 - bits.ravel()
    else:
        values = np.frombuffer(data, "u1" if top < 256 else ">u2", n, at + 1)
    if len(values) != n:
        raise ValueError("short Netpbm data")
    if top != 255:
        values = (values.astype(np.int64) * 255 + top // 2) // top
    return values.astype(np.uint8).reshape((h, w, 3) if depth == 3 else (h, w))


def _bmp(data: bytes) -> np.ndarray:
    start, size, w, h, _, bits, how = struct.unpack_from("<I", data, 10) + struct.unpack_from("<IiiHHI", data, 14)
    if how not in (0, 3) or bits not in (1, 4, 8, 24, 32):
        raise ValueError("only plain BMP is read")
    across = (w * bits + 31) // 32 * 4
    rows = np.frombuffer(data, np.uint8, across * abs(h), start).reshape(abs(h), across)
    rows = rows[::-1] if h > 0 else rows
    if bits >= 24:
        return np.ascontiguousarray(rows[:, : w * bits // 8].reshape(abs(h), w, bits // 8)[:, :, 2::-1])
    used = struct.unpack_from("<I", data, 46)[0] or 1 << bits
    palette = np.zeros((256, 4), np.uint8)
    palette[:used] = np.frombuffer(data, np.uint8, 4 * used, 14 + size).reshape(used, 4)
    if bits == 8:
        at = rows[:, :w]
    elif bits == 4:
        at = np.stack([rows >> 4, rows & 15], axis=2).reshape(abs(h), -1)[:, :w]
    else:
        at = np.unpackbits(rows, axis=1)[:, :w]
    colours = palette[at][:, :, 2::-1]
    return np.ascontiguousarray(colours[:, :, 0]) if (palette[:, 0] == palette[:, 1]).all() and (palette[:, 1] == palette[:, 2]).all() else np.ascontiguousarray(colours)


def decode(data: bytes) -> np.ndarray:
    """(h, w) or (h, w, 3) 8-bit samples of a Netpbm (P1 to P6) or BMP image; ValueError for anything else."""
    if data[:1] == b"P" and data[1:2] in b"123456" and len(data) > 2:
        return _netpbm(data)
    if data[:2] == b"BM":
        return _bmp(data)
    raise ValueError("neither Netpbm nor BMP")


def _edges(total: np.ndarray, cells: int) -> np.ndarray:
    """The running totals of axis 0 at the edges of cells equal parts; edges may fall inside a sample."""
    n = total.shape[0] - 1
    at = np.arange(cells + 1) * n / cells
    low = np.minimum(at.astype(np.int64), n - 1)
    part = (at - low).reshape(-1, *[1] * (total.ndim - 1))
    return total[low] * (1 - part) + total[low + 1] * part


def area_resize(pixels: np.ndarray, height: int, width: int) -> np.ndarray:
    """Means over the areas of a height x width grid, from the integral image; grey from RGB is its plain mean."""
    grey = pixels.astype(np.float64)
    grey = grey.mean(axis=2) if grey.ndim == 3 else grey
    h, w = grey.shape
    total = np.zeros((h + 1, w + 1))
    total[1:, 1:] = grey.cumsum(axis=0).cumsum(axis=1)
    at_rows = np.diff(_edges(total, height), axis=0)
    cells = np.diff(_edges(at_rows.T.copy(), width), axis=0).T
    return cells * (height * width) / (h * w)


def difference_hash(pixels: np.ndarray) -> int:
    """64 bits: is each of 8 x 9 area means below its right neighbour."""
    small = np.round(area_resize(pixels, 8, 9), 6)
    return int.from_bytes(np.packbits(small[:, 1:] > small[:, :-1]).tobytes(), "big")


def npy_tile(pixels: np.ndarray, side: int) -> bytes:
    """The image resized to side x side 8-bit grey samples, as the bytes of an NPY file."""
    out = io.BytesIO()
    np.save(out, np.clip(np.round(area_resize(pixels, side, side)), 0, 255).astype(np.uint8))
    return out.getvalue()


def payload(text: bytes) -> bytes:
    return text + bytes(max(UNIT, -(-len(text) // UNIT) * UNIT) - len(text))


def _columns(side: int, form: str, with_bytes: bool):
    encode = {"pgm": encode_pgm, "bmp": encode_bmp}[form]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            b, offsets = flat(batch.column("text"))
            raw, rows = b.tobytes(), []
            for s, e in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                sent = payload(raw[s:e])
                stored = encode(np.frombuffer(sent, np.uint8).reshape(-1, UNIT))
                pixels = decode(stored)
                back = pixels.tobytes()
                tile = npy_tile(pixels, side)
                rows.append((e - s, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-UNIT:]), len(stored), hashlib.sha256(stored).hexdigest(), f"{difference_hash(pixels):016x}", hashlib.sha256(tile).hexdigest(), *((stored, tile) if with_bytes else ())))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary(), pa.binary()]
            columns = list(zip(*rows, strict=True)) or [()] * (10 if with_bytes else 8)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=False))], ["doc_id", *NAMES[: len(columns)]])

    return run


NAMES = ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "tile_sha256", "media", "tile")


def media_columns(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", form: str = "pgm", tile: int = 32, with_bytes: bool = True) -> DataFrame:
    """Stores each whole text as an image of 64 samples a row and reads it back: one row per row of docs with
    n_bytes, payload_bytes, payload_sha256, tail_crc32 (all of what was read back), media_bytes, media_sha256,
    feature (difference hash, hexadecimal), tile_sha256, and with with_bytes the image and its NPY tile.

    Defined results: null and empty texts are one row of 64 zero bytes; texts of any length are stored whole;
    equal texts have equal values; repeated rows and null doc_id are kept; an empty table gives an empty
    result; other columns are ignored. No shuffle; memory is that of one batch of rows.
    """
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, tile_sha256 string" + ", media binary, tile binary" * with_bytes
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(lean(_columns(tile, form, with_bytes)), schema)


def _describe(side: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for data in batch.column("media").to_pylist():
                try:
                    x = decode(data) if data else None
                except (ValueError, struct.error, IndexError):
                    x = None
                rows.append((None,) * 4 if x is None or not x.size else (x.shape[0], x.shape[1], f"{difference_hash(x):016x}", npy_tile(x, side)))
            kinds = (pa.int32(), pa.int32(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(c, k) for c, k in zip(list(zip(*rows, strict=True)) or [()] * 4, kinds, strict=True))], ["id", "height", "width", "feature", "tile"])

    return run


def describe_images(images: DataFrame, *, id_column: str = "id", media: str = "media", tile: int = 32) -> DataFrame:
    """id, height, width, feature and NPY tile of a column of Netpbm and BMP files; nulls for what can't be read."""
    return images.select(F.col(id_column).cast("long").alias("id"), F.col(media).alias("media")).mapInArrow(lean(_describe(tile), 100), "id long, height int, width int, feature string, tile binary")
