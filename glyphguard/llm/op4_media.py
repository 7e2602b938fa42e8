"""Media columns: Netpbm and BMP decoded to numpy arrays, area-resized by integral images, written
as NPY tiles with difference hashes.

Everything is a per-row function of the bytes, so the plan is a narrow map over the scan.
"""

from __future__ import annotations

import io
import re
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches

#: Rows of an image whose integral is held at once.
STRIP_ROWS = 1024
#: Greatest width and height, as the tiles' columns hold them.
MOST = (1 << 31) - 1
TOKEN = re.compile(rb"(?:[ \t\r\n\x0b\x0c]|#[^\r\n]*[\r\n])*([0-9]+)")


def _header(data: bytes, at: int, count: int) -> tuple[list[int], int]:
    """``count`` numbers from ``at`` on, white space and comments between; the place after them."""
    found = []
    for _ in range(count):
        m = TOKEN.match(data, at)
        if not m:
            raise ValueError("bad Netpbm header")
        found.append(int(m[1]))
        at = m.end()
    return found, at


def decode_netpbm(data: bytes) -> np.ndarray:
    """P1-P6 as (h, w) or (h, w, 3); 8-bit samples as uint8, wider ones as uint16; bitmaps as bool with
    True for black, as stored."""
    kind = data[1] - 48
    bitmap, plain, channels = kind in (1, 4), kind <= 3, 3 if kind in (3, 6) else 1
    numbers, at = _header(data, 2, 2 if bitmap else 3)
    w, h, most = *numbers[:2], 1 if bitmap else numbers[2]
    if not 0 < most < 65536:
        raise ValueError("bad Netpbm depth")
    if max(w, h) > MOST:
        raise ValueError("Netpbm image too large")
    n, row = w * h * channels, (w + 7) // 8
    wide = np.dtype("u1" if most < 256 else ">u2")
    if (n if plain else row * h if bitmap else n * wide.itemsize) > len(data) - at:
        raise ValueError("Netpbm data end early")
    if plain:
        body = re.sub(rb"#[^\r\n]*", b"", data[at:])
        values = [c - 48 for c in body if c in b"01"][:n] if bitmap else [int(x) for x in body.split()[:n]]
        if len(values) < n:
            raise ValueError("Netpbm data end early")
        if values and not 0 <= min(values) <= max(values) <= most:
            raise ValueError("Netpbm sample out of range")
        flat = np.array(values, wide.newbyteorder("="))
    elif bitmap:
        flat = np.unpackbits(np.frombuffer(data, np.uint8, row * h, at + 1).reshape(h, row), axis=1)[:, :w].reshape(-1)
    else:
        flat = np.frombuffer(data, wide, n, at + 1).astype(wide.newbyteorder("="))
    flat = flat.astype(bool) if bitmap else flat
    return flat.reshape((h, w, 3) if channels == 3 else (h, w))


def decode_bmp(data: bytes) -> np.ndarray:
    """Uncompressed 8-bit palette, 24-bit and 32-bit BMP, and 32-bit with colour masks, as (h, w, 3) RGB,
    or (h, w) for a grey palette."""
    offset, header, w, h, _, bits, packed = struct.unpack_from("<10xIIiiHHI", data)
    if (packed, bits) not in ((0, 8), (0, 24), (0, 32), (3, 32)) or w <= 0 or abs(h) > MOST:
        raise ValueError("unsupported BMP")
    stride = (w * bits // 8 + 3) // 4 * 4
    if stride * abs(h) > len(data) - offset:
        raise ValueError("BMP data end early")
    rows = np.frombuffer(data, np.uint8, stride * abs(h), offset).reshape(abs(h), stride)
    rows = rows[::-1] if h > 0 else rows
    if bits == 8:
        colours = struct.unpack_from("<I", data, 46)[0] or 256
        if colours > 256 or 14 + header + 4 * colours > len(data):
            raise ValueError("bad BMP palette")
        palette = np.zeros((256, 3), np.uint8)
        palette[:colours] = np.frombuffer(data, np.uint8, 4 * colours, 14 + header).reshape(-1, 4)[:, 2::-1]
        image = palette[rows[:, :w]]
        return image[..., 0] if (palette == palette[:, :1]).all() else image
    if packed == 3:
        words, image = np.ascontiguousarray(rows).view("<u4"), np.empty((abs(h), w, 3), np.uint8)
        for k, mask in enumerate(struct.unpack_from("<III", data, 54)):
            if not mask:
                raise ValueError("BMP mask without bits")
            low = (mask & -mask).bit_length() - 1
            image[..., k] = ((words & np.uint32(mask)) >> np.uint32(low)).astype(np.float64) * 255 / (mask >> low)
        return image
    return rows[:, : w * bits // 8].reshape(abs(h), w, bits // 8)[..., 2::-1]


def decode(data: bytes) -> np.ndarray:
    if data[:2] == b"BM":
        return decode_bmp(data)
    if len(data) > 2 and data[:1] == b"P" and data[1] in b"123456":
        return decode_netpbm(data)
    raise ValueError("neither Netpbm nor BMP")


def to_grey(image: np.ndarray) -> np.ndarray:
    """Brightness; a bitmap's black is 0 and its white 1."""
    if image.dtype == bool:
        return (~image).astype(np.uint8)
    return image if image.ndim == 2 else image.astype(np.float64) @ np.array([0.299, 0.587, 0.114])


def area_resize(grey: np.ndarray, height: int, width: int) -> np.ndarray:
    """Mean of the area under each target pixel, from the integral image read at fractional edges.
    The integral is built in strips and kept only at the column edges, so memory is
    STRIP_ROWS x w plus h x (width + 1)."""
    h, w = grey.shape
    edges = np.linspace(0, w, width + 1)
    left = np.minimum(edges.astype(np.int64), w)
    part = edges - left
    at_edges = np.empty((h + 1, width + 1))
    at_edges[0] = 0
    for top in range(0, h, STRIP_ROWS):
        strip = grey[top : top + STRIP_ROWS]
        sums = np.zeros((len(strip), w + 1))
        np.cumsum(strip, axis=1, out=sums[:, 1:])
        at_edges[top + 1 : top + 1 + len(strip)] = sums[:, left] * (1 - part) + sums[:, np.minimum(left + 1, w)] * part
    np.cumsum(at_edges, axis=0, out=at_edges)
    rows = np.linspace(0, h, height + 1)
    above = np.minimum(rows.astype(np.int64), h)
    part = (rows - above)[:, None]
    corner = at_edges[above] * (1 - part) + at_edges[np.minimum(above + 1, h)] * part
    return np.diff(np.diff(corner, axis=0), axis=1) / ((h / height) * (w / width))


def difference_hash(grey: np.ndarray) -> str:
    """64 bits in hex: whether each of 8 x 9 cells is darker than the next in its row."""
    cells = np.round(area_resize(grey, 8, 9), 6)
    return np.packbits(cells[:, 1:] > cells[:, :-1]).tobytes().hex()


def to_npy(image: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.lib.format.write_array(out, np.ascontiguousarray(image), version=(1, 0), allow_pickle=False)
    return out.getvalue()


def from_npy(tile: bytes) -> np.ndarray:
    return np.lib.format.read_array(io.BytesIO(tile), allow_pickle=False)


TILE = "struct<tile:binary,width:int,height:int,thumb:binary,dhash:string,error:string>"


def media_tiles(df: DataFrame, image: str, thumb: int = 16) -> DataFrame:
    """``df`` plus a struct column ``media``: the NPY ``tile`` of the decoded image (samples
    unchanged), its width and height, an area-resized grey ``thumb`` as NPY, and the difference
    hash of the samples read back from the tile.

    Null bytes give a null struct. Bytes that are no supported image give a struct with only
    ``error`` set. An image without pixels has a tile, and null thumb and hash. A column named
    media is replaced.
    """

    @F.arrow_udf(TILE)
    def tiles(images: pa.Array) -> pa.Array:
        rows = []
        for x in images:
            data = x.as_py()
            if data is None:
                rows.append(None)
                continue
            row = dict.fromkeys(("tile", "width", "height", "thumb", "dhash", "error"))
            try:
                row["tile"] = to_npy(decode(data))
                grey = to_grey(from_npy(row["tile"]))
                row["height"], row["width"] = grey.shape
                if grey.size:
                    row["thumb"] = to_npy(np.clip(np.rint(area_resize(grey, thumb, thumb)), 0, 65535).astype(np.uint16))
                    row["dhash"] = difference_hash(grey)
            except (ValueError, OverflowError, struct.error, IndexError) as e:
                row["error"] = str(e)
            rows.append(row)
        return pa.array(rows, pa.struct([("tile", pa.binary()), ("width", pa.int32()), ("height", pa.int32()), ("thumb", pa.binary()), ("dhash", pa.string()), ("error", pa.string())]))

    return bounded_batches(df).withColumn("media", tiles(image))


def payload_of(text, unit: int = 576):
    """UTF-8 bytes of a text column (null: empty), filled with bytes 255 to a positive multiple of ``unit``."""
    raw = F.coalesce(text, F.lit("")).cast("binary")
    n = F.octet_length(raw)
    fill = F.when(n == 0, F.lit(unit)).otherwise(F.pmod(-n, F.lit(unit)))
    return F.concat(raw, F.substring(F.lit(bytearray(b"\xff" * unit)), F.lit(1), fill))


def netpbm_of(payload, width: int = 576, channels: int = 1):
    """A binary grey map (P5) of ``width`` samples a row, or a pixmap (P6) of a third as many pixels, that
    holds the payload."""
    header = F.concat(F.lit(f"P{5 if channels == 1 else 6}\n{width // channels} "), (F.octet_length(payload) / width).cast("long").cast("string"), F.lit("\n255\n"))
    return F.concat(header.cast("binary"), payload)


def bmp_of(payload, width: int = 576):
    """An 8-bit BMP of ``width`` samples a row (a multiple of 4) and a grey palette, its rows from the top."""

    def number(x):
        """Four bytes, the lowest first."""
        text = F.lpad(F.hex(F.pmod(x.cast("long"), F.lit(1 << 32))), 8, "0")
        return F.unhex(F.concat(*[F.substring(text, k, 2) for k in (7, 5, 3, 1)]))

    whole = lambda *numbers: F.lit(bytearray(struct.pack(f"<{len(numbers)}I", *numbers)))
    rows, start = F.octet_length(payload) / width, 54 + 4 * 256
    palette = F.lit(bytearray(b"".join(bytes([k, k, k, 0]) for k in range(256))))
    head = F.concat(F.lit(bytearray(b"BM")), number(F.octet_length(payload) + start), whole(0, start, 40, width), number(-rows), F.lit(bytearray(struct.pack("<HH", 1, 8))), whole(0), number(F.octet_length(payload)))
    return F.concat(head, whole(2835, 2835, 256, 0), palette, payload)


def image_of(payload, width: int = 576):
    """The payload as a grey map, a pixmap or a BMP, by its number of rows."""
    turn = F.pmod((F.octet_length(payload) / width).cast("long"), F.lit(3))
    return F.when(turn == 0, netpbm_of(payload, width)).when(turn == 1, netpbm_of(payload, width, 3)).otherwise(bmp_of(payload, width))


def tile_samples(tile):
    """The samples of a column of 8-bit NPY tiles as bytes, read back through the NPY reader."""

    @F.arrow_udf("binary")
    def samples(tiles: pa.Array) -> pa.Array:
        return pa.array([None if not x.is_valid else from_npy(x.as_py()).tobytes() for x in tiles], pa.binary())

    return samples(tile)


def op4_media(spark, sf_dir: str) -> DataFrame:
    """Every document's bytes as a grey map, pixmap or BMP, stored as an NPY tile and read back."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    image = image_of(payload_of(F.col("text")))
    stored = media_tiles(docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), image.alias("image")), "image")
    back = stored.select("doc_id", "n_bytes", "media", tile_samples("media.tile").alias("samples"))
    return back.select(
        "doc_id",
        "n_bytes",
        F.octet_length("samples").cast("long").alias("payload_bytes"),
        F.sha2("samples", 256).alias("payload_sha256"),
        F.crc32(F.substring("samples", -32, 32)).alias("tail_crc32"),
        F.octet_length("media.tile").cast("long").alias("media_bytes"),
        F.sha2("media.tile", 256).alias("media_sha256"),
        F.col("media.dhash").alias("feature"),
    )
