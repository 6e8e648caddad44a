"""Netpbm and BMP images as arrays, tiles and difference hashes.

``decode`` reads P1 to P6 and uncompressed BMP (8, 24 and 32 bits, 16 and 32 with
masks) into uint8 arrays; ``area_resize`` averages over exact fractional boxes by
an integral image; ``to_tiles`` and ``npy_bytes`` give the stored form, NPY tiles
of 24 x 24. ``media_tiles`` does all of this to a column of files.

The registered query has no images to read, so each text becomes one: its UTF-8
bytes, padded, are the samples of a grey Netpbm image 24 wide, which then takes
the same way as any other image.
"""

from __future__ import annotations

import hashlib
import io
import re
import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame

from .common import map_texts, slices, small_batches, table

TILE = 24
BLOCK = TILE * TILE
_TOKEN = re.compile(rb"(?:\s|#[^\n\r]*[\n\r])*([^\s#]+)")


def _numbers(data: bytes, at: int, n: int, most: int) -> np.ndarray:
    """The n decimal samples from there on; none is above ``most``."""
    words = re.sub(rb"#[^\n\r]*", b"", data[at:]).split(None, n)[:n]
    if len(words) != n or any(not w.isdigit() or len(w) > 5 for w in words):
        raise ValueError("bad or too few samples")
    values = np.array(words, dtype=np.int64)
    if values.max(initial=0) > most:
        raise ValueError("a sample is above the greatest value")
    return values


def _netpbm(data: bytes) -> np.ndarray:
    kind, at, head = data[1:2], 2, []
    for _ in range(2 if kind in b"14" else 3):
        m = _TOKEN.match(data, at)
        if not m or not m[1].isdigit() or len(m[1]) > 9:
            raise ValueError("bad Netpbm header")
        head.append(int(m[1]))
        at = m.end()
    width, height, most = head[0], head[1], head[2] if len(head) > 2 else 1
    if width < 1 or height < 1 or not 0 < most < 65536:
        raise ValueError("bad Netpbm header")
    channels = 3 if kind in b"36" else 1
    n = width * height * channels
    # an image holds at least one bit of data per sample: checked before any array is made
    if n > 8 * len(data):
        raise ValueError("truncated Netpbm data")
    if kind == b"1":
        bits = np.frombuffer(re.sub(rb"#[^\n\r]*|\s+", b"", data[at:])[:n], np.uint8)
        if bits.size != n or not np.isin(bits, (48, 49)).all():
            raise ValueError("bad or too few bits")
        values = bits - 48
    elif kind in b"23":
        values = _numbers(data, at, n, most)
    elif kind == b"4":
        row = (width + 7) // 8
        bits = np.unpackbits(np.frombuffer(data, np.uint8, row * height, at + 1).reshape(height, row), axis=1)
        values = bits[:, :width].ravel()
    else:
        values = np.frombuffer(data, np.uint8 if most < 256 else ">u2", n, at + 1)
        if most not in (255, 65535) and values.max() > most:
            raise ValueError("a sample is above the greatest value")
    if kind in b"14":
        values = (1 - values.astype(np.uint8)) * 255
    elif most != 255:
        values = (values.astype(np.int64) * 255 + most // 2) // most
    image = values.astype(np.uint8, copy=False)
    return image.reshape((height, width, 3) if channels == 3 else (height, width))


def _masked(pixels: np.ndarray, mask: int) -> np.ndarray:
    """The channel under a mask of consecutive bits, scaled to 8 bits."""
    shift = (mask & -mask).bit_length() - 1
    most = mask >> shift
    if not mask or most & (most + 1):
        raise ValueError("bad BMP mask")
    return ((((pixels & mask) >> shift).astype(np.uint64) * 255 + most // 2) // most).astype(np.uint8)


def _bmp(data: bytes) -> np.ndarray:
    offset, header = struct.unpack_from("<II", data, 10)
    if header == 12:  # the oldest form: 16-bit sizes and palettes of three bytes
        width, height, _planes, bits = struct.unpack_from("<HHHH", data, 18)
        compression, used, entry = 0, 0, 3
    elif header >= 40:
        width, height, _planes, bits, compression = struct.unpack_from("<iiHHI", data, 18)
        used, entry = struct.unpack_from("<I", data, 46)[0], 4
    else:
        raise ValueError("unsupported BMP header")
    if (bits, compression) not in ((8, 0), (24, 0), (32, 0), (16, 3), (32, 3)) or width < 1 or height == 0:
        raise ValueError("unsupported BMP")
    row = (width * bits + 31) // 32 * 4
    if offset + row * abs(height) > len(data) or used > 256:
        raise ValueError("truncated BMP data")
    raw = np.frombuffer(data, np.uint8, row * abs(height), offset).reshape(abs(height), row)
    if bits == 8:
        n = used or 256
        palette = np.frombuffer(data, np.uint8, entry * n, 14 + header).reshape(n, entry)[:, 2::-1]
        if raw[:, :width].max() >= n:
            raise ValueError("a pixel is outside the palette")
        image = palette[raw[:, :width]]
    elif compression == 3:  # the masks follow the first 40 bytes of the header, within it or after it
        pixels = raw[:, : width * bits // 8].copy().view(f"<u{bits // 8}")
        image = np.stack([_masked(pixels, m) for m in struct.unpack_from("<III", data, 54)], axis=2)
    else:
        image = raw[:, : width * bits // 8].reshape(abs(height), width, bits // 8)[:, :, 2::-1]
    return np.ascontiguousarray(image[::-1] if height > 0 else image)


def decode(data: bytes) -> np.ndarray:
    """A (height, width) or (height, width, 3) uint8 array; ValueError if it is neither format, malformed or truncated."""
    try:
        if data[:1] == b"P" and data[1:2] in b"123456" and len(data) > 2:
            return _netpbm(data)
        if data[:2] == b"BM":
            return _bmp(data)
    except (struct.error, IndexError, OverflowError, MemoryError) as e:
        raise ValueError(str(e) or type(e).__name__) from e
    raise ValueError("neither Netpbm nor BMP")


def grey(image: np.ndarray) -> np.ndarray:
    if image.ndim == 2:
        return image
    return ((image.astype(np.uint32) * np.array([299, 587, 114], np.uint32)).sum(axis=2) // 1000).astype(np.uint8)


def _edges(size: int, parts: int) -> tuple[np.ndarray, np.ndarray]:
    at = np.arange(parts + 1) * size
    return at // parts, (at % parts) / parts


def area_resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Mean of each of height x width equal boxes of a grey image, with fractional edges, as floats."""
    total = np.zeros((image.shape[0] + 1, image.shape[1] + 1))
    np.cumsum(np.cumsum(image, axis=0, dtype=np.int64), axis=1, out=total[1:, 1:])
    for axis, parts in ((0, height), (1, width)):
        whole, part = _edges(image.shape[axis], parts)
        low = np.take(total, whole, axis=axis)
        high = np.take(total, np.minimum(whole + 1, total.shape[axis] - 1), axis=axis)
        total = low + (high - low) * (part[:, None] if axis == 0 else part[None, :])
    return np.diff(np.diff(total, axis=0), axis=1) * (height * width / (image.shape[0] * image.shape[1]))


def resized(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """The image at another size as uint8, each channel by ``area_resize``, rounded to the nearest."""
    planes = [image] if image.ndim == 2 else [image[:, :, k] for k in range(image.shape[2])]
    out = [np.clip(np.floor(area_resize(p, height, width) + 0.5), 0, 255).astype(np.uint8) for p in planes]
    return out[0] if image.ndim == 2 else np.stack(out, axis=2)


def difference_hash(image: np.ndarray) -> str:
    """16 hex digits for steps to the right, 16 for steps down."""
    grid = np.round(area_resize(image, 9, 9), 6)
    right, down = grid[:8, 1:] > grid[:8, :-1], grid[1:, :8] > grid[:-1, :8]
    return np.packbits(right).tobytes().hex() + np.packbits(down).tobytes().hex()


def to_tiles(image: np.ndarray, tile: int = TILE, fill: int = 255) -> np.ndarray:
    """(n, tile, tile[, 3]) tiles in row order; the right and lower edges are filled up."""
    h, w = -(-image.shape[0] // tile), -(-image.shape[1] // tile)
    if (h * tile, w * tile) != image.shape[:2]:
        padded = np.full((h * tile, w * tile, *image.shape[2:]), fill, np.uint8)
        padded[: image.shape[0], : image.shape[1]] = image
        image = padded
    return np.ascontiguousarray(image.reshape(h, tile, w, tile, *image.shape[2:]).swapaxes(1, 2)).reshape(h * w, tile, tile, *image.shape[2:])


def npy_bytes(array: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.lib.format.write_array(out, array, version=(1, 0), allow_pickle=False)
    return out.getvalue()


def text_image(text: str | None) -> tuple[int, bytes]:
    """Bytes of the text and its P5 image, 24 wide, filled with 255 to a positive multiple of 576 samples."""
    raw = (text or "").encode()
    size = max(1, -(-len(raw) // BLOCK)) * BLOCK
    return len(raw), b"P5\n%d %d\n255\n" % (TILE, size // TILE) + raw.ljust(size, b"\xff")


MEDIA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _media(ids: list, texts: list) -> dict:
    out = {c.split()[0]: [] for c in MEDIA.split(", ")}
    for i, text in zip(ids, texts):
        n, pgm = text_image(text)
        stored = npy_bytes(to_tiles(decode(pgm)))
        back = np.lib.format.read_array(io.BytesIO(stored), allow_pickle=False)
        payload = back.tobytes()
        feature = f"{difference_hash(back.reshape(-1, TILE))}:{back.mean():.6f}"
        row = (i, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(stored), hashlib.sha256(stored).hexdigest(), feature)
        for values, x in zip(out.values(), row):
            values.append(x)
    return out


def media_digests(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``; a null text is an empty one, which gives one block of 255. Equal texts have equal values."""
    return map_texts(docs, _media, MEDIA)


def media_tiles(images: DataFrame, content: str = "content", size: tuple[int, int] | None = (96, 96)) -> DataFrame:
    """``images`` with columns tiles (NPY bytes of 24 x 24 tiles), height, width, hash and error.

    The tiles are those of the image area-resized to ``size`` (height, width), or
    with None at its own size; height, width and the hash are the image's own.
    What can't be decoded (null, empty, another format, malformed, truncated) has
    nulls and the reason in ``error``; existing columns of these names are
    replaced. Repeated rows give equal results; an empty table gives none.
    """
    import pyarrow as pa
    from pyspark.sql.types import StructType

    added = StructType.fromDDL("tiles binary, height int, width int, hash string, error string")
    taken = {n.lower() for n in added.names}
    kept = images.select(*[images[f"`{c}`"] for c in images.columns if c.lower() not in taken or c == content])
    if content.lower() in taken:
        raise ValueError(f"the content column may not be named {content}")
    schema = StructType([*kept.schema.fields, *added.fields])

    def one(data) -> tuple:
        try:
            if data is None:
                raise ValueError("null")
            image = decode(bytes(data))
            shown = image if size is None else resized(image, *size)
            return npy_bytes(to_tiles(shown)), *image.shape[:2], difference_hash(grey(image)), None
        except ValueError as e:
            return None, None, None, None, str(e)

    def run(batches):
        for batch in batches:
            for part in slices(batch, content):
                rows = [one(data) for data in part.column(part.schema.get_field_index(content)).to_pylist()]
                kinds = (pa.binary(), pa.int32(), pa.int32(), pa.string(), pa.string())
                new = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays([*part.columns, *new], names=[*part.schema.names, *added.names])

    small_batches(images.sparkSession)
    return kept.mapInArrow(run, schema)


def op5_media(spark, sf_dir: str) -> DataFrame:
    return media_digests(table(spark, sf_dir, "documents"))
