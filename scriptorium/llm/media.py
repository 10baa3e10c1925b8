"""Media columns: Netpbm and BMP images as arrays, NPY tiles, and difference hashes.

Images come as bytes in a column.  They are decoded to arrays of 8-bit samples, cut into tiles of whole rows, each tile
written in NPY format (a header and the raw samples, so nothing is lost), and described by a difference hash: the grey
image is resized by area to 9 x 8 with an integral image, and each bit says whether a cell is brighter than its left
neighbour.
"""

from __future__ import annotations

import ast
import hashlib
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import prepare, written

UNIT, WIDTH, FILL = 576, 24, 255
_NPY = b"\x93NUMPY\x01\x00"


def npy(array: np.ndarray) -> bytes:
    """An array of unsigned 8-bit samples in NPY format 1.0."""
    array = np.ascontiguousarray(array, np.uint8)
    shape = f"({', '.join(map(str, array.shape))}{',' if array.ndim == 1 else ''})"
    head = f"{{'descr': '|u1', 'fortran_order': False, 'shape': {shape}, }}"
    head += " " * (-(len(_NPY) + 2 + len(head) + 1) % 64) + "\n"
    return _NPY + struct.pack("<H", len(head)) + head.encode("latin-1") + array.tobytes()


def from_npy(data: bytes) -> np.ndarray:
    """The array of an NPY file of unsigned 8-bit samples."""
    if data[:8] != _NPY:
        raise ValueError("no NPY file of version 1.0")
    (n,) = struct.unpack_from("<H", data, 8)
    head = ast.literal_eval(data[10 : 10 + n].decode("latin-1"))
    if head["descr"] != "|u1" or head["fortran_order"]:
        raise ValueError("not 8-bit samples in C order")
    return np.frombuffer(data, np.uint8, int(np.prod(head["shape"], dtype=np.int64)), 10 + n).reshape(head["shape"])


def pgm(samples: bytes, width: int) -> bytes:
    """A binary Netpbm grey map of whole rows."""
    return f"P5\n{width} {len(samples) // width}\n255\n".encode() + samples


_FIELD = re.compile(rb"(?:[\s]|#[^\n]*\n)*([0-9]+)")


def _netpbm(data: bytes) -> np.ndarray:
    kind = data[1:2]
    at, fields = 2, []
    for _ in range(2 if kind in b"14" else 3):
        m = _FIELD.match(data, at)
        if not m:
            raise ValueError("a Netpbm header is cut off")
        fields.append(int(m[1]))
        at = m.end()
    width, height, top = (*fields, 1)[:3]
    depth = 3 if kind in b"36" else 1
    n = width * height * depth
    if not n or not 0 < top < 65536:
        raise ValueError("a Netpbm image without samples, or with a maximum out of range")
    if n > 8 * len(data):
        raise ValueError("a Netpbm image is cut off")
    if kind in b"123":
        if kind == b"1":
            found = np.frombuffer(re.sub(rb"[^01]", b"", re.sub(rb"#[^\n]*", b"", data[at:]))[:n], np.uint8) - 48
        else:
            found = np.array([int(x) for x in re.sub(rb"#[^\n]*", b"", data[at:]).split()[:n]], object)
    elif kind == b"4":
        stride = (width + 7) // 8
        rows = np.frombuffer(data, np.uint8, stride * height, at + 1).reshape(height, stride)
        found = np.unpackbits(rows, axis=1)[:, :width].ravel()
    else:
        found = np.frombuffer(data, np.uint8 if top < 256 else ">u2", n, at + 1)
    if found.size != n:
        raise ValueError("a Netpbm image is cut off")
    if found.max() > (top if kind not in b"14" else 1):
        raise ValueError("a Netpbm sample is above its maximum")
    if kind in b"14":
        found = (1 - found) * 255
    elif top != 255:
        found = (found.astype(np.int64) * 255 + top // 2) // top
    return found.astype(np.uint8).reshape((height, width, depth)[: 2 + (depth == 3)])


def _bmp(data: bytes) -> np.ndarray:
    at, head, width, height, _, bits, packed = *struct.unpack_from("<II", data, 10), *struct.unpack_from("<iiHHI", data, 18)
    if packed not in (0, 3) or bits not in (1, 4, 8, 24, 32) or packed == 3 and bits != 32:
        raise ValueError("not a plain BMP")
    if width <= 0 or not height or width * abs(height) > 8 * len(data):
        raise ValueError("a BMP image is empty or cut off")
    stride = (width * bits + 31) // 32 * 4
    rows = np.frombuffer(data, np.uint8, stride * abs(height), at).reshape(abs(height), stride)
    if height > 0:
        rows = rows[::-1]
    if packed == 3:
        masks = struct.unpack_from("<III", data, 54)
        if not all(masks):
            raise ValueError("a BMP mask is zero")
        points = np.ascontiguousarray(rows[:, : 4 * width]).view("<u4").astype(np.int64)
        scaled = [((points & m) // (m & -m) * 255 + m // (m & -m) // 2) // (m // (m & -m)) for m in masks]
        return np.stack(scaled, 2).astype(np.uint8)
    if bits >= 24:
        return rows[:, : width * bits // 8].reshape(abs(height), width, bits // 8)[:, :, 2::-1]
    index = rows if bits == 8 else (np.unpackbits(rows, axis=1) if bits == 1 else np.stack([rows >> 4, rows & 15], 2).reshape(abs(height), -1))
    colours = (at - 14 - head) // 4
    if colours <= int(index[:, :width].max()):
        raise ValueError("a BMP index is beyond the palette")
    palette = np.frombuffer(data, np.uint8, 4 * colours, 14 + head).reshape(-1, 4)[:, 2::-1]
    return palette[index[:, :width]]


def decode(data: bytes) -> np.ndarray:
    """The samples of a Netpbm (P1 to P6) or plain BMP image, rows by columns, and by red, green and blue for colours."""
    if re.match(rb"P[1-6]\s", data):
        return _netpbm(data)
    if data[:2] == b"BM":
        return _bmp(data)
    raise ValueError("neither Netpbm nor BMP")


def resized(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """The mean of each of height x width equal areas of a grey image, as float, from its integral image.

    Areas need not end at pixels: the integral is taken between its points by linear interpolation, which is exact.
    """
    total = np.zeros((image.shape[0] + 1, image.shape[1] + 1))
    total[1:, 1:] = image.cumsum(0, dtype=np.float64).cumsum(1)

    def at(edges: np.ndarray, axis: int, table: np.ndarray) -> np.ndarray:
        low = np.minimum(edges.astype(np.int64), table.shape[axis] - 2)
        part = (edges - low).reshape((-1, 1) if axis == 0 else (1, -1))
        return table.take(low, axis) * (1 - part) + table.take(low + 1, axis) * part

    rows, columns = np.arange(height + 1) * image.shape[0] / height, np.arange(width + 1) * image.shape[1] / width
    corner = at(columns, 1, at(rows, 0, total))
    return np.diff(np.diff(corner, axis=0), axis=1) / (image.shape[0] / height * image.shape[1] / width)


def difference_hash(image: np.ndarray) -> str:
    """16 hex digits: for 8 rows, whether each of 8 cells is brighter than the one to its left."""
    grey = image if image.ndim == 2 else image @ np.array([0.299, 0.587, 0.114])
    small = np.round(resized(grey, 8, 9), 6)
    return np.packbits(small[:, 1:] > small[:, :-1]).tobytes().hex()


def tiles(image: np.ndarray, rows: int = 32768) -> list[bytes]:
    """The image in NPY tiles of at most `rows` rows."""
    return [npy(image[k : k + rows]) for k in range(0, len(image), rows)]


def untiled(stored: list[bytes]) -> np.ndarray:
    return np.concatenate([from_npy(x) for x in stored])


def store(images: DataFrame, key: str = "doc_id", image: str = "image") -> DataFrame:
    """key, tiles (array of NPY files) and error for images (a key and an image as bytes), written to the shared folder.

    What isn't an image that ``decode`` knows has no tiles, and error says why; null counts as such.  Rows are kept one
    for one and other columns are ignored.
    """
    prepare(images.sparkSession)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, why = [], []
            for data in batch.column(1).to_pylist():
                try:
                    if data is None:
                        raise ValueError("null")
                    out.append(tiles(decode(data)))
                    why.append(None)
                except (ValueError, OverflowError, struct.error) as e:
                    out.append(None)
                    why.append(str(e) or "not readable")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.binary())), pa.array(why, pa.string())], ["key", "tiles", "error"])

    kind = images.select(F.col(key).alias("key")).schema["key"].dataType.simpleString()
    stored = images.select(F.col(key).alias("key"), F.col(image).alias("image")).mapInArrow(rows, f"key {kind}, tiles array<binary>, error string")
    return written(stored, "media").withColumnRenamed("key", key)


def text_images(docs: DataFrame) -> DataFrame:
    """doc_id and image: each whole text as UTF-8 in a grey map of 24 columns.

    Bytes 255 fill it up to a positive multiple of 576.  A null text is empty.
    """
    data = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), data.alias("data"))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            images = []
            for raw in batch.column("data").to_pylist():
                fill = -len(raw) % UNIT if raw else UNIT
                images.append(pgm(raw + bytes([FILL]) * fill, WIDTH))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(images, pa.binary())], ["doc_id", "image"])

    return docs.mapInArrow(rows, "doc_id long, image binary")


def report(docs: DataFrame) -> DataFrame:
    """What the stored media of all texts hold: doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes,
    media_sha256, feature.  All but doc_id are computed from the tiles read back; equal texts have equal values.

    A null text counts as empty (one unit of fill); repeated rows are kept; other columns are ignored, whatever their names;
    an empty table gives no rows.
    """
    prepare(docs.sparkSession)
    stored = store(text_images(docs))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")}
            for parts in batch.column("tiles").to_pylist():
                image = untiled(parts)
                payload = image.tobytes()
                # UTF-8 has no byte 255: what is filled up begins at the first.
                n = payload.find(FILL)
                for k, v in (("n_bytes", len(payload) if n < 0 else n), ("payload_bytes", len(payload)), ("payload_sha256", hashlib.sha256(payload).hexdigest()), ("tail_crc32", zlib.crc32(payload[-32:])), ("media_bytes", sum(map(len, parts))), ("media_sha256", hashlib.sha256(b"".join(parts)).hexdigest()), ("feature", difference_hash(image))):
                    out[k].append(v)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(v, pa.string() if k.endswith("256") or k == "feature" else pa.int64()) for k, v in out.items())], ["doc_id", *out])

    return stored.drop("error").mapInArrow(rows, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
