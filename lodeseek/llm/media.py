"""Media columns: Netpbm and BMP codecs on numpy arrays, area resizing by integral images, NPY tiles, difference hashes."""

from __future__ import annotations

import io
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import text_of, tidy
from .words import slices

#: A payload row is 64 pixels of 3 samples; the tile and the hash grid in rows and columns.
ROW_BYTES, WIDTH, TILE, GRID = 192, 64, (16, 16), (8, 9)
#: Rows of an image worked on at a time, bytes of text taken together.
BLOCK, SLICE = 1 << 14, 2_000_000


def encode_ppm(pixels: np.ndarray) -> bytes:
    """Binary Netpbm: P6 for (h, w, 3), P5 for (h, w); 8-bit samples."""
    kind = b"P6" if pixels.ndim == 3 else b"P5"
    return kind + b"\n%d %d\n255\n" % (pixels.shape[1], pixels.shape[0]) + np.ascontiguousarray(pixels, np.uint8).tobytes()


_NETPBM = re.compile(rb"P([56])(?:\s|#[^\n]*\n)+(\d+)(?:\s|#[^\n]*\n)+(\d+)(?:\s|#[^\n]*\n)+(\d+)\s")


def decode_netpbm(data: bytes) -> np.ndarray:
    """P5 and P6 with comments in the header; 16-bit samples (big-endian) for a maximum above 255."""
    m = _NETPBM.match(data)
    if not m:
        raise ValueError("not a binary PGM or PPM")
    width, height, most = (int(m[i]) for i in (2, 3, 4))
    shape = (height, width, 3) if m[1] == b"6" else (height, width)
    dtype = np.dtype(np.uint8 if most < 256 else ">u2")
    return np.frombuffer(data, dtype, int(np.prod(shape)), m.end()).reshape(shape)


def encode_bmp(pixels: np.ndarray) -> bytes:
    """24-bit BMP, rows bottom-up in blue, green, red, padded to four bytes."""
    height, width = pixels.shape[:2]
    stride = (width * 3 + 3) // 4 * 4
    rows = np.zeros((height, stride), np.uint8)
    rows[:, : width * 3] = pixels[::-1, :, ::-1].reshape(height, width * 3)
    head = struct.pack("<2sIHHI", b"BM", 54 + rows.size, 0, 0, 54)
    return head + struct.pack("<IiiHHIIiiII", 40, width, height, 1, 24, 0, rows.size, 2835, 2835, 0, 0) + rows.tobytes()


def decode_bmp(data: bytes) -> np.ndarray:
    """Uncompressed 24- and 32-bit BMP, bottom-up or top-down, as (h, w, 3) red, green, blue."""
    kind, _, _, _, at = struct.unpack_from("<2sIHHI", data)
    _, width, height, _, bits, packed = struct.unpack_from("<IiiHHI", data, 14)
    if kind != b"BM" or bits not in (24, 32) or packed:
        raise ValueError("not an uncompressed 24- or 32-bit BMP")
    stride, n = (width * bits // 8 + 3) // 4 * 4, abs(height)
    rows = np.frombuffer(data, np.uint8, stride * n, at).reshape(n, stride)[:, : width * bits // 8]
    pixels = rows.reshape(n, width, bits // 8)[:, :, 2::-1]
    return pixels[::-1] if height > 0 else pixels


def decode(data: bytes) -> np.ndarray:
    return decode_bmp(data) if data[:2] == b"BM" else decode_netpbm(data)


def _cumulative(n: int, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the edges of `parts` equal stretches of n samples lie: whole samples before, and the part of the next."""
    edge = np.arange(parts + 1) * (n / parts)
    whole = np.minimum(edge.astype(np.int64), n)
    return whole, edge - whole


def _grey(pixels: np.ndarray) -> np.ndarray:
    return pixels.mean(axis=2) if pixels.ndim == 3 else pixels.astype(np.float64)


def integral_rows(pixels: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Rows of the integral image of the grey levels (row r sums the r rows above), made block by block so that a large image needs little memory."""
    h, w = pixels.shape[:2]
    out, above = np.zeros((len(wanted), w + 1)), np.zeros(w + 1)
    for a in range(0, h, BLOCK):
        sums = np.zeros((min(BLOCK, h - a) + 1, w + 1))
        np.cumsum(np.cumsum(_grey(pixels[a : a + BLOCK]), 0), 1, out=sums[1:, 1:])
        sums += above
        inside = (wanted > a) & (wanted <= a + BLOCK)
        out[inside] = sums[wanted[inside] - a]
        above = sums[-1]
    return out


def area_resizes(pixels: np.ndarray, sizes: list[tuple[int, int]]) -> list[np.ndarray]:
    """For each height and width the mean grey level over each cell's area, cells of any fraction of a pixel: differences of
    the interpolated integral image, of which all sizes' rows are made in one pass."""
    h, w = pixels.shape[:2]
    heights = [_cumulative(h, height) for height, _ in sizes]
    wanted = np.unique(np.concatenate([np.minimum(r, h) for y, _ in heights for r in (y, y + 1)]))
    made, out = integral_rows(pixels, wanted), []
    for (y, fy), (height, width) in zip(heights, sizes):
        x, fx = _cumulative(w, width)
        low, high = (made[np.searchsorted(wanted, np.minimum(r, h))] for r in (y, y + 1))
        rows = low + fy[:, None] * (high - low)
        at = rows[:, x] + fx * (rows[:, np.minimum(x + 1, w)] - rows[:, x])
        out.append(np.diff(np.diff(at, axis=0), axis=1) / ((h / height) * (w / width)))
    return out


def area_resize(pixels: np.ndarray, height: int, width: int) -> np.ndarray:
    return area_resizes(pixels, [(height, width)])[0]


def npy(array: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.save(out, array, allow_pickle=False)
    return out.getvalue()


def features(pixels: np.ndarray) -> tuple[bytes, str]:
    """An NPY tile of 8-bit grey levels and the 64-bit difference hash (a bit for each cell darker than its right neighbour)."""
    resized, grid = area_resizes(pixels, [TILE, GRID])
    tile = np.clip(np.rint(resized), 0, 255).astype(np.uint8)
    return npy(tile), np.packbits(grid[:, 1:] > grid[:, :-1] + 1e-9).tobytes().hex()


def _media(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, 1, SLICE):
            out: tuple[list, ...] = ([], [], [], [], [])
            for text in batch.column(1).to_pylist():
                raw = text.encode()
                payload = raw + b" " * (ROW_BYTES - len(raw) if not raw else -len(raw) % ROW_BYTES)
                pixels = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH, 3)
                stored = (encode_bmp if zlib.crc32(payload) & 1 else encode_ppm)(pixels)
                back = decode(stored)
                for column, value in zip(out, (len(raw), stored, np.ascontiguousarray(back).tobytes(), *features(back))):
                    column.append(value)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *map(pa.array, out[:1]), pa.array(out[1], pa.binary()), pa.array(out[2], pa.binary()), pa.array(out[3], pa.binary()), pa.array(out[4], pa.string())],
                names=["doc_id", "n_bytes", "media", "payload", "tile", "dhash"],
            )


def store_media(docs: DataFrame) -> DataFrame:
    """Each text as an image, read back: doc_id, n_bytes, media, payload, tile (NPY), dhash.

    docs: doc_id, text; other columns are ignored. The text's UTF-8 bytes (null: none)
    with spaces up to a positive multiple of 192 are rows of 64 pixels, stored as PPM or
    BMP (by the payload's checksum, so equal texts are stored alike); payload, tile and
    dhash come from the decoded image. A row for each row; an empty table gives an empty one.
    """
    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", text_of().alias("text")).mapInArrow(
        tidy(_media), f"doc_id {id_type}, n_bytes long, media binary, payload binary, tile binary, dhash string"
    )


def op9_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = store_media(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return stored.select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -16, 16)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.concat("dhash", F.lit(":"), F.substring(F.sha2("tile", 256), 1, 16)).alias("feature"),
    )
