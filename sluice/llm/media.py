"""Media columns: Netpbm and BMP to arrays, NPY tiles, area-resized difference hashes.

A picture becomes a ``(height, width, channels)`` array of its samples. Area resizing reads block
means off an integral image, so its cost does not depend on the target. Pictures are stored as NPY
tiles of a bounded number of rows, one after the other.
"""

from __future__ import annotations

import hashlib
import io
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm.common import texts

#: Width in samples of a text's picture, and the payload's unit in bytes.
UNIT = 64
#: Rows of one stored tile.
TILE_ROWS = 4096
HASH_ROWS, HASH_COLUMNS = 8, 9


def decode_netpbm(data: bytes) -> np.ndarray:
    """A Netpbm picture (P1 to P6, up to 16 bits) as ``(height, width, channels)``."""
    kind = data[:2]
    if kind not in (b"P1", b"P2", b"P3", b"P4", b"P5", b"P6"):
        raise ValueError("not a Netpbm picture")
    numbers, at = [], 2
    wanted = 2 if kind in (b"P1", b"P4") else 3
    while len(numbers) < wanted:
        m = re.compile(rb"(?:\s|#[^\n]*\n)*(\d+)").match(data, at)
        if not m:
            raise ValueError("broken Netpbm header")
        numbers.append(int(m[1]))
        at = m.end()
    width, height = numbers[:2]
    most = 1 if wanted == 2 else numbers[2]
    if not (width and height and 0 < most < 65536):
        raise ValueError("Netpbm picture without samples or with a maximum out of range")
    channels = 3 if kind in (b"P3", b"P6") else 1
    n = width * height * channels
    if kind in (b"P1", b"P2", b"P3"):
        body = re.sub(rb"#[^\n]*", b" ", data[at:])
        values = (re.findall(rb"[01]", body) if kind == b"P1" else body.split())[:n]
        if any(len(v) > 5 and len(v.lstrip(b"0")) > 5 for v in values):
            raise ValueError("Netpbm sample above the maximum")
        out = np.array(values, dtype=np.uint32)
        if kind == b"P1":
            out = 1 - out
    elif kind == b"P4":
        stride = (width + 7) // 8
        bits = np.unpackbits(np.frombuffer(data, np.uint8, stride * height, at + 1).reshape(height, stride), axis=1)
        out = 1 - bits[:, :width].reshape(-1)
    else:
        out = np.frombuffer(data, np.uint8 if most < 256 else np.dtype(">u2"), n, at + 1)
    if out.size < n:
        raise ValueError("Netpbm picture ends early")
    if out.size and out.max() > most:
        raise ValueError("Netpbm sample above the maximum")
    return out.astype(np.uint8 if most < 256 else np.uint16, copy=False).reshape(height, width, channels)


def encode_pgm(samples: np.ndarray) -> bytes:
    """An 8-bit ``(height, width)`` array as a binary grey Netpbm picture."""
    return b"P5\n%d %d\n255\n" % (samples.shape[1], samples.shape[0]) + samples.tobytes()


def decode_bmp(data: bytes) -> np.ndarray:
    """An uncompressed BMP of 1, 4, 8, 24 or 32 bits as ``(height, width, 3)`` RGB (grey palettes too)."""
    if data[:2] != b"BM":
        raise ValueError("not a BMP picture")
    word = lambda at: int.from_bytes(data[at : at + 4], "little", signed=True)
    start, header, width, height = word(10), word(14), word(18), word(22)
    bits, packed = int.from_bytes(data[28:30], "little"), word(30)
    if packed not in (0, 3) or bits not in (1, 4, 8, 24, 32) or width <= 0 or height == 0 or start < 0:
        raise ValueError("unsupported BMP picture")
    rows, stride = abs(height), (width * bits + 31) // 32 * 4
    body = np.frombuffer(data, np.uint8, stride * rows, start).reshape(rows, stride)
    if bits >= 24:
        out = body[:, : width * bits // 8].reshape(rows, width, bits // 8)[:, :, 2::-1]
    else:
        colours = word(46) or 1 << bits
        palette = np.zeros((1 << bits, 3), np.uint8)
        table = np.frombuffer(data, np.uint8, 4 * colours, 14 + header).reshape(-1, 4)
        palette[: len(table)] = table[:, 2::-1]
        if bits < 8:
            plane = np.unpackbits(body, axis=1)[:, : width * bits].reshape(rows, width, bits)
            body = (plane @ (1 << np.arange(bits - 1, -1, -1))).astype(np.uint8)
        out = palette[body[:, :width]]
    return out if height < 0 else out[::-1]


def decode(data: bytes) -> np.ndarray:
    return decode_bmp(data) if data[:2] == b"BM" else decode_netpbm(data)


def resize(samples: np.ndarray, rows: int, columns: int) -> np.ndarray:
    """Area means of a 2-d array in ``rows`` x ``columns`` cells, off the integral image.

    Cell edges may cut samples; the integral image is read between its points linearly, which is
    the exact area there too.
    """
    h, w = samples.shape
    total = np.zeros((h + 1, w + 1))
    np.cumsum(samples, axis=0, dtype=np.float64, out=total[1:, 1:])
    np.cumsum(total[1:, 1:], axis=1, out=total[1:, 1:])

    def at(edges: np.ndarray, values: np.ndarray) -> np.ndarray:
        low = np.minimum(edges.astype(np.int64), len(values) - 2)
        part = (edges - low)[:, None]
        return values[low] * (1 - part) + values[low + 1] * part

    y, x = np.linspace(0, h, rows + 1), np.linspace(0, w, columns + 1)
    corners = at(x, at(y, total).T).T
    return np.diff(np.diff(corners, axis=0), axis=1) / ((h / rows) * (w / columns))


def difference_hash(samples: np.ndarray) -> str:
    """64 bits in hexadecimal: whether each of 8 x 9 area means is above its left neighbour."""
    grey = samples.mean(axis=2) if samples.ndim == 3 else samples
    small = np.round(resize(grey, HASH_ROWS, HASH_COLUMNS), 6)
    return np.packbits(small[:, 1:] > small[:, :-1]).tobytes().hex()


def write_tiles(samples: np.ndarray, rows: int = TILE_ROWS) -> bytes:
    """The array as NPY tiles of at most ``rows`` rows, one after the other."""
    out = io.BytesIO()
    for start in range(0, max(1, len(samples)), rows):
        np.save(out, np.ascontiguousarray(samples[start : start + rows]))
    return out.getvalue()


def read_tiles(stored: bytes) -> np.ndarray:
    source = io.BytesIO(stored)
    tiles = []
    while source.tell() < len(stored):
        tiles.append(np.load(source, allow_pickle=False))
    return tiles[0] if len(tiles) == 1 else np.concatenate(tiles)


def decode_pictures(df: DataFrame, id_col: str, data_col: str) -> DataFrame:
    """``id, height, width, channels, tiles, hash, error`` of encoded Netpbm or BMP pictures.

    Null or broken data gives a row with the error's text and nulls: samples above the stated maximum,
    a maximum beyond 65535 and pictures without samples are broken. Repeated rows stay repeated.
    About 2 MB of encoded pictures are decoded at a time.
    """

    def one(data: bytes) -> tuple:
        try:
            picture = decode(data)
            return (*picture.shape, write_tiles(picture), difference_hash(picture), None)
        except (ValueError, IndexError, OverflowError) as broken:
            return (None, None, None, None, None, str(broken))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, part in texts(batch.column(1)):
                rows = [one(data) for data in part]
                kinds = (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.string(), pa.string())
                columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
                yield pa.record_batch([batch.column(0).slice(start, len(part)), *columns], ["id", "height", "width", "channels", "tiles", "hash", "error"])

    kind = df.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, height int, width int, channels int, tiles binary, hash string, error string"
    return df.select(F.col(id_col).alias("id"), F.col(data_col).alias("data")).mapInArrow(run, schema)


def text_pictures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tiles: bool = False) -> DataFrame:
    """Whole texts as grey pictures of 64 samples a row, stored as NPY tiles and read back.

    The UTF-8 bytes (null: none) are filled with zeros to a positive multiple of 64, pass through a
    binary Netpbm picture and are written as tiles. Sums and hashes are of what is read back.
    Returns ``doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes,
    media_sha256, feature`` and, if asked for, ``media``. Repeated rows stay repeated.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, part in texts(batch.column(1)):
                rows = []
                for text in part:
                    payload = text.ljust(max(UNIT, -(-len(text) // UNIT) * UNIT), b"\0")
                    picture = decode_netpbm(encode_pgm(np.frombuffer(payload, np.uint8).reshape(-1, UNIT)))
                    media = write_tiles(picture)
                    back = read_tiles(media)
                    stored = back.tobytes()
                    rows.append((len(text), len(stored), hashlib.sha256(stored).hexdigest(), zlib.crc32(stored[-UNIT:]), len(media), hashlib.sha256(media).hexdigest(), difference_hash(back[:, :, 0]), media if tiles else None))
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary())
                columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
                yield pa.record_batch([batch.column(0).slice(start, len(part)), *columns], names)

    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "media"]
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, media binary"
    found = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)
    return found if tiles else found.drop("media")
