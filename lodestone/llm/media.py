"""Media columns: Netpbm and BMP bytes decoded to arrays, area-resized by integral images, kept as NPY tiles with difference hashes."""

from __future__ import annotations

import hashlib
import io
import re
import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import binary_list, table

ROW = 192  # bytes of a row of 64 RGB samples
GAP = rb"(?:\s|#[^\n]*\n)+"


def write_ppm(samples: np.ndarray) -> bytes:
    """(height, width, 3) or (height, width) 8-bit samples as binary PPM or PGM."""
    h, w = samples.shape[:2]
    return b"P%d\n%d %d\n255\n" % (6 if samples.ndim == 3 else 5, w, h) + samples.tobytes()


def write_bmp(samples: np.ndarray) -> bytes:
    """(height, width, 3) 8-bit RGB samples as a 24-bit BMP, rows from the bottom up."""
    h, w = samples.shape[:2]
    rows = np.zeros((h, (w * 3 + 3) // 4 * 4), np.uint8)
    rows[:, : w * 3] = samples[::-1, :, ::-1].reshape(h, w * 3)
    return b"BM" + struct.pack("<IHHI", 54 + rows.size, 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, w, h, 1, 24, 0, rows.size, 2835, 2835, 0, 0) + rows.tobytes()


def decode(data: bytes) -> np.ndarray:
    """The 8-bit samples of a Netpbm (P1 to P6, 8 bits a sample) or uncompressed BMP (1, 4, 8, 24 or 32 bits, byte-wide masks) image.

    ValueError for other bytes, empty images, missing samples, and samples above the maximum or outside the palette.
    """
    if data[:2] == b"BM":
        return _bmp(data)
    if data[:1] == b"P" and data[1:2] in (b"1", b"2", b"3", b"4", b"5", b"6"):
        return _netpbm(data)
    raise ValueError("neither Netpbm nor BMP")


def _netpbm(data: bytes) -> np.ndarray:
    kind = data[1] - 48
    fields = 2 if kind in (1, 4) else 3
    head = re.match(rb"P[1-6]" + (GAP + rb"(\d{1,9})") * fields + rb"(?=\s)", data)
    if not head:
        raise ValueError("no Netpbm header")
    w, h = int(head[1]), int(head[2])
    top = int(head[3]) if fields == 3 else 1
    if not w or not h:
        raise ValueError("an image without samples")
    if not 0 < top < 256:
        raise ValueError("more than 8 bits a sample")
    deep = 3 if kind in (3, 6) else 1
    n, at = w * h * deep, head.end() + 1
    if kind == 1:
        out = np.frombuffer(re.sub(rb"#[^\n]*(?:\n|\Z)|\s", b"", data[at - 1 :])[:n], np.uint8) - 48  # below 48 wraps round, above what is allowed
    elif kind in (2, 3):
        own = re.sub(rb"#[^\n]*(?:\n|\Z)", b" ", data[at - 1 :]).split(maxsplit=n)[:n]
        if not all(x.isdigit() and len(x) < 10 for x in own):
            raise ValueError("samples that are no numbers")
        out = np.array(own, np.int64)
    else:
        row = (w + 7) // 8 if kind == 4 else w * deep
        if len(data) - at < row * h:
            raise ValueError("samples are missing")
        out = np.frombuffer(data, np.uint8, row * h, at)
        if kind == 4:
            out = np.unpackbits(out).reshape(h, -1)[:, :w].ravel()
    if out.size != n:
        raise ValueError("samples are missing")
    if int(out.max()) > top:
        raise ValueError("a sample above the maximum")
    if kind in (1, 4):
        out = 255 * (1 - out)
    elif top != 255:
        out = (out.astype(np.int64) * 255 + top // 2) // top
    return out.astype(np.uint8).reshape((h, w, 3) if deep == 3 else (h, w))


def _bmp(data: bytes) -> np.ndarray:
    if len(data) < 26:
        raise ValueError("no BMP header")
    at, size = struct.unpack_from("<II", data, 10)
    if size == 12:  # the oldest header
        w, h, planes, bits = struct.unpack_from("<HHHH", data, 18)
        packed, colours, entry = 0, 1 << bits if bits <= 8 else 0, 3
    elif size >= 40 and len(data) >= 54:
        w, h, planes, bits, packed = struct.unpack_from("<iiHHI", data, 18)
        colours, entry = struct.unpack_from("<I", data, 46)[0] or (1 << bits if bits <= 8 else 0), 4
    else:
        raise ValueError("no BMP header")
    if packed not in (0, 3) or bits not in (1, 4, 8, 24, 32) or packed == 3 and bits != 32:
        raise ValueError("BMP of another kind")
    if w <= 0 or not h or planes != 1 or bits <= 8 and colours > 1 << bits:
        raise ValueError("a BMP header that says nothing true")
    step, high = (w * bits + 31) // 32 * 4, abs(h)
    if at < 14 + size or len(data) - at < step * high:
        raise ValueError("samples are missing")
    rows = np.frombuffer(data, np.uint8, step * high, at).reshape(high, step)
    if h > 0:
        rows = rows[::-1]
    if bits >= 24:
        order = [2, 1, 0]
        if packed == 3:
            if len(data) < 66:
                raise ValueError("no masks")
            places = {0xFF: 0, 0xFF00: 1, 0xFF0000: 2, 0xFF000000: 3}
            order = [places.get(m, -1) for m in struct.unpack_from("<III", data, 54)]
            if -1 in order:
                raise ValueError("masks that are no bytes")
        return np.ascontiguousarray(rows[:, : w * bits // 8].reshape(high, w, bits // 8)[:, :, order])
    if len(data) < 14 + size + entry * colours:
        raise ValueError("the palette is missing")
    palette = np.frombuffer(data, np.uint8, entry * colours, 14 + size).reshape(-1, entry)[:, 2::-1]
    if bits == 4:
        rows = np.stack([rows >> 4, rows & 15], 2).reshape(high, -1)
    elif bits == 1:
        rows = np.unpackbits(rows, axis=1)
    rows = rows[:, :w]
    if int(rows.max()) >= colours:
        raise ValueError("a sample outside the palette")
    return np.ascontiguousarray(palette[rows])


def area_resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Means of the height x width equal areas of image, from its integral image; borders inside a sample count by their share."""
    h, w = image.shape[:2]
    total = np.zeros((h + 1, w + 1, *image.shape[2:]))
    np.cumsum(np.cumsum(image, 0, dtype=np.float64), 1, out=total[1:, 1:])

    def at(table, n, m, axis):
        where = np.arange(m + 1) * n / m
        low = np.minimum(where.astype(int), n - 1)
        part = (where - low).reshape([-1 if a == axis else 1 for a in range(table.ndim)])
        return np.take(table, low, axis) * (1 - part) + np.take(table, low + 1, axis) * part

    corners = at(at(total, h, height, 0), w, width, 1)
    return np.diff(np.diff(corners, axis=0), axis=1) / (h * w / (height * width))


def luma(image: np.ndarray) -> np.ndarray:
    return image if image.ndim == 2 else image @ np.array([0.299, 0.587, 0.114])


def difference_hash(image: np.ndarray) -> str:
    """16 hex digits: whether each of 8 x 8 areas is darker than the one to its right."""
    small = np.round(luma(area_resize(image, 8, 9)), 6)
    return np.packbits(small[:, :-1] < small[:, 1:]).tobytes().hex()


def npy_tile(image: np.ndarray, height: int = 16, width: int = 16) -> bytes:
    """image resized to a tile of 8-bit samples, as the bytes of an NPY file."""
    out = io.BytesIO()
    np.save(out, np.clip(np.rint(area_resize(image, height, width)), 0, 255).astype(np.uint8), allow_pickle=False)
    return out.getvalue()


def tiles(media: DataFrame, id_column: str = "media_id", data_column: str = "data", height: int = 16, width: int = 16) -> DataFrame:
    """(media_id, height, width, channels, tile, dhash, error) of every row; tile holds NPY bytes. Null or undecodable bytes give nulls and an error."""
    kind = media.schema[id_column].dataType.simpleString()
    names = ["media_id", "height", "width", "channels", "tile", "dhash", "error"]

    def one(data):
        try:
            image = decode(data or b"")
            return *image.shape[:2], 1 if image.ndim == 2 else image.shape[2], npy_tile(image, height, width), difference_hash(image), None
        except ValueError as e:
            return None, None, None, None, None, str(e)

    def run(batches):
        import pyarrow as pa

        kinds = [pa.int64()] * 3 + [pa.binary(), pa.string(), pa.string()]
        for batch in batches:
            if batch.num_rows:
                cols = zip(*map(one, batch.column(1).to_pylist()))
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds))], names)

    return media.select(F.col(id_column), F.col(data_column)).mapInArrow(run, f"media_id {kind}, height long, width long, channels long, tile binary, dhash string, error string")


def text_media(docs: DataFrame, form: str = "ppm", id_column: str = "doc_id", text_column: str = "text", keep_media: bool = False) -> DataFrame:
    """Texts as images and back: each text's UTF-8 bytes, filled with spaces to a positive multiple of 192, are rows of 64 RGB
    samples, stored as PPM or BMP, decoded again, and described.

    Columns: doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature (the difference
    hash), tile (NPY bytes); with keep_media also media, the stored bytes. Null texts are empty.
    """
    kind = docs.schema[id_column].dataType.simpleString()
    write = {"ppm": write_ppm, "bmp": write_bmp}[form]
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "tile"] + ["media"] * keep_media

    def one(text):
        text = text or b""
        payload = text + b" " * (max(1, -(-len(text) // ROW)) * ROW - len(text))
        media = write(np.frombuffer(payload, np.uint8).reshape(-1, 64, 3))
        image = decode(media)
        back = image.tobytes()
        return (len(text), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(media), hashlib.sha256(media).hexdigest(), difference_hash(image), npy_tile(image)) + ((media,) if keep_media else ())

    def run(batches):
        import pyarrow as pa

        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary(), pa.binary()]
        for batch in batches:
            if batch.num_rows:
                cols = zip(*map(one, binary_list(batch.column(1))))
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds))], names)

    schema = f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, tile binary"
    return docs.select(F.col(id_column), F.col(text_column)).mapInArrow(run, schema + ", media binary" * keep_media)


def op9_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_media(table(spark, sf_dir, "documents"))
