"""Grey images of 8 or 16 bits (PNG) from rows and back, by zlib alone."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values of the format: its first bytes.
MAGIC = b"\x89PNG\r\n\x1a\n"


def encode(pixels: np.ndarray) -> bytes:
    """A 2-D array of uint8 or uint16 as a grey PNG."""
    if pixels.ndim != 2 or pixels.dtype not in (np.uint8, np.uint16):
        raise ValueError("a grey image is a 2-D array of uint8 or uint16")
    depth = 8 * pixels.dtype.itemsize
    wide = np.ascontiguousarray(pixels.astype(pixels.dtype.newbyteorder(">")))
    raw = b"".join(b"\0" + row.tobytes() for row in wide)

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    head = struct.pack(">IIBBBBB", pixels.shape[1], pixels.shape[0], depth, 0, 0, 0, 0)
    return MAGIC + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw, 6)) + chunk(b"IEND", b"")


def decode(data: bytes) -> np.ndarray:
    """The pixels of a grey PNG of 8 or 16 bits; all five row filters, no interlacing."""
    if data[:8] != MAGIC:
        raise ValueError("not a PNG")
    at, body, head = 8, b"", None
    while at < len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        part = data[at + 8 : at + 8 + n]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", part)
        elif kind == b"IDAT":
            body += part
        at += 12 + n
    if head is None or head[2] not in (8, 16) or head[3] != 0 or head[6] != 0:
        raise ValueError("only grey images of 8 or 16 bits without interlacing")
    width, height, step = head[0], head[1], head[2] // 8
    line, raw = width * step, zlib.decompress(body)
    above, rows = bytearray(line), []
    for r in range(height):
        kind = raw[r * (line + 1)]
        row = bytearray(raw[r * (line + 1) + 1 : (r + 1) * (line + 1)])
        if kind == 2:
            row = bytearray((a + b) & 255 for a, b in zip(row, above))
        elif kind:
            for k in range(line):
                left = row[k - step] if k >= step else 0
                corner = above[k - step] if k >= step else 0
                if kind == 1:
                    guess = left
                elif kind == 3:
                    guess = (left + above[k]) // 2
                else:
                    near = sorted(((abs(above[k] - corner), 0, left), (abs(left - corner), 1, above[k]), (abs(left + above[k] - 2 * corner), 2, corner)))
                    guess = near[0][2]
                row[k] = (row[k] + guess) & 255
        rows.append(bytes(row))
        above = row
    return np.frombuffer(b"".join(rows), dtype=">u2" if step == 2 else "u1").reshape(height, width).astype(np.uint16 if step == 2 else np.uint8)


def to_images(cells: DataFrame, by: Sequence[str], value: str, bits: int = 16) -> DataFrame:
    """(by, height, width, png): one image for each group of (i, j, value), i and j from the group's least;
    cells that are not there are 0. Groups are tiles of a stated size, so that one fits in a task."""
    kind, top = (np.uint16, 65535) if bits == 16 else (np.uint8, 255)

    def draw(rows: pd.DataFrame) -> pd.DataFrame:
        i, j = rows["i"] - rows["i"].min(), rows["j"] - rows["j"].min()
        grey = np.zeros((int(i.max()) + 1, int(j.max()) + 1), kind)
        grey[i.to_numpy(), j.to_numpy()] = np.clip(rows[value].fillna(0).to_numpy(), 0, top).astype(kind)
        return pd.DataFrame({**{k: [rows[k].iloc[0]] for k in by}, "height": [grey.shape[0]], "width": [grey.shape[1]], "png": [encode(grey)]})

    keys = ", ".join(f"`{k}` {cells.schema[k].dataType.simpleString()}" for k in by)
    return cells.select(*by, "i", "j", value).groupBy(*by).applyInPandas(draw, f"{keys}, height int, width int, png binary")


def from_images(images: DataFrame, keep: Sequence[str], png: str = "png") -> DataFrame:
    """(keep, i, j, value): the pixels of each image; images without content give no rows."""
    schema = ", ".join([*[f"`{k}` {images.schema[k].dataType.simpleString()}" for k in keep], "i long, j long, value int"])

    def pixels(batches):
        for batch in batches:
            for row in batch.to_dict("records"):
                if row[png]:
                    grey = decode(bytes(row[png]))
                    i, j = np.indices(grey.shape)
                    yield pd.DataFrame({**{k: [row[k]] * grey.size for k in keep}, "i": i.ravel(), "j": j.ravel(), "value": grey.ravel().astype("int32")})

    return images.select(*keep, png).mapInPandas(pixels, schema)


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """(path, png) of the PNG files under a path that Spark reads."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.png").load(path).select("path", F.col("content").alias("png"))
