"""Media columns: Netpbm and BMP decoded to numpy arrays, area-resized by integral images, written as NPY tiles with
difference hashes.

decode() reads P1 to P6 Netpbm (8-bit samples, scaled to 255 from a smaller maximum; bitmaps as 1 for black) and
uncompressed 8-, 24- and 32-bit BMP without colour masks. area_resize() averages the
exact area under each target pixel: the integral image is read at fractional borders by linear interpolation, so any
size maps to any other. A tile is the NPY form of (part of) the decoded array; its difference hash compares
neighbours of the array resized to 9 by 8.

Edge cases: bytes that are no image raise ValueError in decode(); tiles() gives no tile and a reason for them, also
for null. An array without pixels has no tiles. Equal bytes give equal tiles. Long texts become tall images of 64
columns; memory stays within a small multiple of one text.
"""

from __future__ import annotations

import hashlib
import io
import re
import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm import common

COLUMNS = 64
#: Rows of the image that are summed at a time; bounds the integral image of a tall picture.
BAND = 4096

_HEADER = re.compile(rb"^P([1-6])" + rb"(?:\s+(?:#[^\n]*\n\s*)*(\d+))" * 2)


def decode_netpbm(data: bytes) -> np.ndarray:
    m = _HEADER.match(data)
    if not m:
        raise ValueError("no Netpbm header")
    kind, width, height = (int(x) for x in m.groups())
    at, top = m.end(), 1
    if kind not in (1, 4):
        more = re.compile(rb"\s+(?:#[^\n]*\n\s*)*(\d+)").match(data, at)
        if not more:
            raise ValueError("no maximum value")
        top, at = int(more[1]), more.end()
        if not 0 < top < 256:
            raise ValueError("samples of more than 8 bits")
    planes = 3 if kind in (3, 6) else 1
    n = width * height * planes
    if kind == 1:
        out = np.array([c == 49 for c in data[at:] if c in b"01"], np.uint8)[:n]
    elif kind in (2, 3):
        out = np.array(data[at:].split()[:n], np.int64).astype(np.uint8)
    elif kind == 4:
        row = (width + 7) // 8
        bits = np.frombuffer(data, np.uint8, row * height, at + 1) if len(data) >= at + 1 + row * height else np.zeros(0, np.uint8)
        out = np.unpackbits(bits.reshape(-1, row), axis=1)[:, :width].ravel() if len(bits) else bits
    else:
        out = np.frombuffer(data, np.uint8, n, at + 1) if len(data) >= at + 1 + n else np.zeros(0, np.uint8)
    if len(out) != n:
        raise ValueError("too few samples")
    if kind not in (1, 4) and top < 255:
        out = ((np.minimum(out, top).astype(np.uint32) * 510 + top) // (2 * top)).astype(np.uint8)
    return out.reshape((height, width, 3) if planes == 3 else (height, width))


def encode_pgm(pixels: np.ndarray) -> bytes:
    return b"P5\n%d %d\n255\n" % (pixels.shape[1], pixels.shape[0]) + pixels.tobytes()


def decode_bmp(data: bytes) -> np.ndarray:
    if data[:2] != b"BM" or len(data) < 54:
        raise ValueError("no BMP header")
    at, _, width, height, _, bits, packed = struct.unpack_from("<IIiiHHI", data, 10)
    if packed != 0 or bits not in (8, 24, 32) or width <= 0 or height == 0:
        raise ValueError("a kind of BMP that is not read")  # compressed, or with its own masks for the colours
    row = (width * bits // 8 + 3) // 4 * 4
    if len(data) < at + row * abs(height):
        raise ValueError("too few samples")
    rows = np.frombuffer(data, np.uint8, row * abs(height), at).reshape(abs(height), row)
    rows = rows[::-1] if height > 0 else rows
    if bits == 8:
        size, used = struct.unpack_from("<I", data, 14)[0], struct.unpack_from("<I", data, 46)[0] or 256
        table = np.zeros((256, 4), np.uint8)
        table[:used] = np.frombuffer(data, np.uint8, 4 * used, 14 + size).reshape(used, 4)
        out = table[rows[:, :width]][:, :, 2::-1]
        return out[:, :, 0] if (table[:, 0] == table[:, 1]).all() and (table[:, 1] == table[:, 2]).all() else out
    return rows[:, : width * bits // 8].reshape(abs(height), width, bits // 8)[:, :, 2::-1]


def encode_bmp(pixels: np.ndarray) -> bytes:
    """Grey levels as 8 bits with a grey table, colours as 24 bits."""
    height, width = pixels.shape[:2]
    if pixels.ndim == 2:
        table, bits, body = np.repeat(np.arange(256, dtype=np.uint8), 4).reshape(256, 4), 8, pixels
        table = table * np.array([1, 1, 1, 0], np.uint8)
    else:
        table, bits, body = np.zeros((0, 4), np.uint8), 24, pixels[:, :, ::-1].reshape(height, width * 3)
    rows = np.zeros((height, (body.shape[1] + 3) // 4 * 4), np.uint8)
    rows[:, : body.shape[1]] = body[::-1]
    at = 54 + table.size
    head = b"BM" + struct.pack("<IHHI", at + rows.size, 0, 0, at) + struct.pack("<IiiHHIIiiII", 40, width, height, 1, bits, 0, rows.size, 2835, 2835, len(table), 0)
    return head + table.tobytes() + rows.tobytes()


def decode(data: bytes) -> np.ndarray:
    return decode_bmp(data) if data[:2] == b"BM" else decode_netpbm(data)


def area_resize(pixels: np.ndarray, height: int, width: int) -> np.ndarray:
    """Mean of the area under each target pixel, in double precision; grey or colour.

    The integral image is built in bands of BAND rows and read at the borders of the target rows, at fractions by
    linear interpolation, which is exact as the integral is linear inside a pixel.
    """
    if pixels.ndim == 3:
        return np.stack([area_resize(pixels[:, :, c], height, width) for c in range(pixels.shape[2])], 2)
    h, w = pixels.shape
    ys, xs = np.linspace(0, h, height + 1), np.linspace(0, w, width + 1)
    x0 = np.minimum(xs.astype(np.int64), w - 1)
    at_y = np.zeros((height + 1, width + 1))
    carry = np.zeros(w + 1)
    for top in range(0, h, BAND):
        band = pixels[top : top + BAND]
        integral = np.zeros((len(band) + 1, w + 1))
        np.cumsum(np.cumsum(band, axis=0, dtype=np.int64), axis=1, out=integral[1:, 1:])
        inside = np.flatnonzero((ys > top) & (ys <= top + len(band)))
        if len(inside):
            y = ys[inside] - top
            y0 = np.minimum(y.astype(np.int64), len(band) - 1)
            f = (y - y0)[:, None]
            rows = carry + integral[y0] * (1 - f) + integral[y0 + 1] * f
            g = xs - x0
            at_y[inside] = rows[:, x0] * (1 - g) + rows[:, x0 + 1] * g
        carry = carry + integral[-1]
    cells = np.diff(np.diff(at_y, axis=0), axis=1)
    return cells / ((h / height) * (w / width))


def difference_hash(pixels: np.ndarray) -> str:
    """64 bits, in hexadecimal: whether each cell of the 8 by 9 thumbnail is darker than its right neighbour."""
    grey = pixels if pixels.ndim == 2 else pixels.mean(2)
    small = np.round(area_resize(grey if grey.dtype == np.uint8 else np.round(grey).astype(np.uint8), 8, 9), 6)
    return np.packbits((small[:, :-1] < small[:, 1:]).ravel()).tobytes().hex()


def npy(pixels: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.lib.format.write_array(out, np.ascontiguousarray(pixels), version=(1, 0), allow_pickle=False)
    return out.getvalue()


def from_npy(data: bytes) -> np.ndarray:
    return np.lib.format.read_array(io.BytesIO(data), allow_pickle=False)


def tiles(df: DataFrame, media: str, rows: int = 256, columns: int = 256, size: tuple[int, int] | None = None, keep: list[str] | None = None) -> DataFrame:
    """The columns keep with one row for each tile of the image in the binary column media: tile_y, tile_x (in tiles),
    npy, dhash (of the tile), error. size resizes the image first. Unreadable media give one row with error set."""

    def make():
        def cut(data: bytes) -> list[dict]:
            try:
                pixels = decode(data)
            except ValueError as e:
                return [{"tile_y": None, "tile_x": None, "npy": None, "dhash": None, "error": str(e)}]
            if not pixels.size:
                return []
            if size:
                pixels = np.round(area_resize(pixels, *size)).astype(np.uint8)
            found = []
            for y in range(0, pixels.shape[0], rows):
                for x in range(0, pixels.shape[1], columns):
                    own = pixels[y : y + rows, x : x + columns]
                    found.append({"tile_y": y // rows, "tile_x": x // columns, "npy": npy(own), "dhash": difference_hash(own), "error": None})
            return found

        return lambda datas: [[cut(d) for d in datas]]

    kind = "tiles array<struct<tile_y:int,tile_x:int,npy:binary,dhash:string,error:string>>"
    got = common.map_texts(df, media, kind, make, keep)
    kept = [c for c in got.columns if c != "tiles"]
    return got.select(*kept, F.explode("tiles").alias("tile")).select(*kept, "tile.*")


def stored(text: bytes) -> tuple:
    """What op3 reports of a text: it becomes a grey PGM image of 64 columns, is decoded from those bytes, written as
    an NPY tile and read back from it."""
    payload = text + bytes(-len(text) % COLUMNS) if text else bytes(COLUMNS)
    media = encode_pgm(np.frombuffer(payload, np.uint8).reshape(-1, COLUMNS))
    pixels = decode(media)
    tile = npy(pixels)
    back = from_npy(tile)
    data = back.tobytes()
    return (len(text), len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-COLUMNS:]), len(media), hashlib.sha256(media).hexdigest(), difference_hash(back), len(tile))


def text_media(df: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    def make():
        return lambda texts: list(zip(*[stored(t) for t in texts]))

    fields = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, tile_bytes long"
    return common.map_texts(df, text, fields, make, keep)
