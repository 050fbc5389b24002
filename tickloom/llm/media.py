"""Media columns: Netpbm and BMP bytes as numpy arrays, area-resized tiles, difference hashes."""

from __future__ import annotations

import hashlib
import io
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.frames import pick

ROW_BYTES = 64


def write_pgm(samples: np.ndarray) -> bytes:
    """A binary grey Netpbm file of 8-bit samples."""
    height, width = samples.shape
    return b"P5\n%d %d\n255\n" % (width, height) + np.ascontiguousarray(samples, dtype=np.uint8).tobytes()


def write_bmp(samples: np.ndarray) -> bytes:
    """An uncompressed 8-bit BMP with a grey palette (rows from the bottom, padded to 4 bytes)."""
    height, width = samples.shape
    pitch = (width + 3) // 4 * 4
    rows = np.zeros((height, pitch), dtype=np.uint8)
    rows[:, :width] = samples[::-1]
    palette = np.repeat(np.arange(256, dtype=np.uint8)[:, None], 4, axis=1)
    palette[:, 3] = 0
    start = 14 + 40 + 1024
    head = b"BM" + np.array([start + rows.size, 0, start], dtype="<u4").tobytes()
    info = np.array([40], "<u4").tobytes() + np.array([width, height], "<i4").tobytes() + np.array([1, 8], "<u2").tobytes()
    return head + info + np.array([0, rows.size, 0, 0, 256, 0], "<u4").tobytes() + palette.tobytes() + rows.tobytes()


def _netpbm(data: bytes) -> np.ndarray:
    kind = data[1] - 48
    need, at, values = (2 if kind in (1, 4) else 3), 2, []
    while len(values) < need:
        m = re.compile(rb"(?:\s|#[^\n\r]*[\n\r])*(\d+)").match(data, at)
        if not m:
            raise ValueError("Netpbm header is cut off")
        values.append(int(m[1]))
        at = m.end()
    width, height, most = values[0], values[1], values[2] if need == 3 else 1
    depth = 3 if kind in (3, 6) else 1
    if kind <= 3:
        body = re.sub(rb"#[^\n\r]*", b"", data[at:])
        found = re.findall(rb"[01]" if kind == 1 else rb"\d+", body)[: width * height * depth]
        samples = np.array(found, dtype="S8").astype(np.int64)
    elif kind == 4:
        pitch = (width + 7) // 8
        bits = np.unpackbits(np.frombuffer(data, np.uint8, pitch * height, at + 1).reshape(height, pitch), axis=1)
        samples = bits[:, :width].ravel().astype(np.int64)
    else:
        samples = np.frombuffer(data, np.dtype(">u2") if most > 255 else np.uint8, width * height * depth, at + 1)
    if kind in (1, 4):
        samples = 1 - samples  # a set bit is black
    if most != 255:
        samples = (samples.astype(np.int64) * 255 + most // 2) // most
    shape = (height, width, 3) if depth == 3 else (height, width)
    return samples.astype(np.uint8).reshape(shape)


def _bmp(data: bytes) -> np.ndarray:
    u4 = lambda at: int.from_bytes(data[at : at + 4], "little")
    start, head = u4(10), u4(14)
    width, height = (int.from_bytes(data[i : i + 4], "little", signed=True) for i in (18, 22))
    bits, packed, used = int.from_bytes(data[28:30], "little"), u4(30), u4(46)
    if packed or bits not in (1, 4, 8, 24, 32):
        raise ValueError(f"BMP with {bits} bits and compression {packed}")
    pitch = (width * bits + 31) // 32 * 4
    rows = np.frombuffer(data, np.uint8, pitch * abs(height), start).reshape(abs(height), pitch)
    if height > 0:
        rows = rows[::-1]
    if bits >= 24:
        return np.ascontiguousarray(rows[:, : width * bits // 8].reshape(abs(height), width, bits // 8)[:, :, 2::-1])
    if bits < 8:
        per = 8 // bits
        rows = (rows[:, :, None] >> np.arange(8 - bits, -1, -bits, dtype=np.uint8)[:per]) & ((1 << bits) - 1)
        rows = rows.reshape(abs(height), -1)
    palette = np.frombuffer(data, np.uint8, 4 * (used or 1 << bits), 14 + head).reshape(-1, 4)[:, 2::-1]
    index = rows[:, :width]
    if (palette == palette[:, :1]).all():
        return np.ascontiguousarray(palette[:, 0][index])
    return np.ascontiguousarray(palette[index])


def decode_image(data: bytes) -> np.ndarray:
    """Netpbm (P1 to P6) or BMP bytes as uint8 samples, (height, width) or (height, width, 3)."""
    if data[:1] == b"P" and data[1:2] in (b"1", b"2", b"3", b"4", b"5", b"6"):
        return _netpbm(data)
    if data[:2] == b"BM":
        return _bmp(data)
    raise ValueError("neither Netpbm nor BMP")


def grey(image: np.ndarray) -> np.ndarray:
    """One channel; colours are weighted 299, 587, 114 thousandths."""
    if image.ndim == 2:
        return image
    return ((image[..., :3].astype(np.int64) @ np.array([299, 587, 114]) + 500) // 1000).astype(np.uint8)


def area_resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Mean of the area behind each target sample, by an integral image; borders inside a sample are weighted."""
    h, w = image.shape
    if not h or not w:
        return np.zeros((height, width))
    table = np.zeros((h + 1, w + 1))
    np.cumsum(image, axis=0, dtype=np.float64, out=table[1:, 1:])
    np.cumsum(table[1:, 1:], axis=1, out=table[1:, 1:])

    def edges(n: int, to: int) -> tuple[np.ndarray, np.ndarray]:
        at = np.arange(to + 1) * n / to
        low = np.minimum(at.astype(np.int64), n - 1)
        return low, at - low

    y, fy = edges(h, height)
    x, fx = edges(w, width)
    rows = table[y] * (1 - fy)[:, None] + table[y + 1] * fy[:, None]
    at = rows[:, x] * (1 - fx) + rows[:, x + 1] * fx
    return (at[1:, 1:] - at[:-1, 1:] - at[1:, :-1] + at[:-1, :-1]) * (height * width / (h * w))


def npy(array: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.save(out, array, allow_pickle=False)
    return out.getvalue()


def difference_hash(image: np.ndarray) -> str:
    """64 bits in hex: is a sample of the 8 x 9 reduction brighter than its left neighbour?"""
    small = np.round(area_resize(image, 8, 9), 6)
    return np.packbits(small[:, 1:] > small[:, :-1]).tobytes().hex()


FIELDS = "height int, width int, channels int, dhash string, tile binary"
PAYLOAD_FIELDS = (
    "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long,"
    " media_sha256 string, feature string, tile_bytes long"
)


def image_features(media: Column, tile: int = 32) -> Column:
    """Struct of a binary column: height, width, channels, dhash and an NPY tile of ``tile`` x ``tile`` grey samples.

    Null, empty and undecodable values give a null struct field each.
    """

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            rows = []
            for value in column:
                try:
                    image = decode_image(value.as_py() or b"")
                except (ValueError, IndexError):
                    rows.append((None,) * 5)
                    continue
                g = grey(image)
                small = np.rint(area_resize(g, tile, tile)).astype(np.uint8)
                rows.append((image.shape[0], image.shape[1], 1 if image.ndim == 2 else 3, difference_hash(g), npy(small)))
            kinds = (pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.binary())
            columns = list(zip(*rows)) or [()] * 5
            yield pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=[f.split()[0] for f in FIELDS.split(", ")])

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, FIELDS)(media)


def media_features(df: DataFrame, id_col: str = "media_id", media_col: str = "media", tile: int = 32) -> DataFrame:
    """One row per row of ``df``: media_id, height, width, channels, dhash, tile (NPY bytes).

    Null, empty or broken media give nulls; null ids stay; repeated rows repeat; other columns are not read.
    """
    rows = pick(df, media_id=id_col, media=media_col)
    return rows.select("media_id", image_features(F.col("media"), tile).alias("m")).select("media_id", "m.*")


def store_payload(payload: bytes, form: str = "pgm") -> tuple[bytes, bytes]:
    """(padded payload, stored image): 64 samples a row, zero bytes to a positive multiple of 64."""
    size = max(1, -(-len(payload) // ROW_BYTES)) * ROW_BYTES
    padded = payload.ljust(size, b"\0")
    samples = np.frombuffer(padded, np.uint8).reshape(-1, ROW_BYTES)
    return padded, {"pgm": write_pgm, "bmp": write_bmp}[form](samples)


def payload_features(text: Column, form: str = "pgm", tile: int = 32) -> Column:
    """Text bytes stored as grey images, read back through the decoder, and described.

    The struct has the sizes and digests of what was read back and of the stored form;
    feature is the difference hash, a dash and the CRC-32 of the NPY tile.
    """

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            out = [[] for _ in range(8)]
            for value in column.cast(pa.binary()):
                raw = value.as_py() or b""
                _, stored = store_payload(raw, form)
                image = grey(decode_image(stored))
                back = image.tobytes()
                small = npy(np.rint(area_resize(image, tile, tile)).astype(np.uint8))
                feature = f"{difference_hash(image)}-{zlib.crc32(small):08x}"
                row = (len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(stored), hashlib.sha256(stored).hexdigest(), feature, len(small))
                for held, v in zip(out, row):
                    held.append(v)
            text_at = {2, 5, 6}
            arrays = [pa.array(v, pa.string() if i in text_at else pa.int64()) for i, v in enumerate(out)]
            yield pa.StructArray.from_arrays(arrays, names=[f.split()[0] for f in PAYLOAD_FIELDS.split(",")])

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, PAYLOAD_FIELDS)(text)


def text_media(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", form: str = "pgm", tile: int = 32) -> DataFrame:
    """One row per row of ``df``: doc_id and what ``payload_features`` gives.

    Null and empty texts store one row of 64 zero samples; null ids stay; repeated rows
    repeat; equal texts give equal values; other columns are not read.
    """
    docs = pick(df, doc_id=id_col, text=text_col)
    return docs.select("doc_id", payload_features(F.col("text"), form, tile).alias("m")).select("doc_id", "m.*")
