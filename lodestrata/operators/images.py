"""Images as arrays of bytes or as pixel rows."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rgb_distance(pixels: DataFrame) -> DataFrame:
    """image_i, image_j, distance: mean colour distance of all ordered pairs of images, each with itself too.

    pixels: image, px, r, g, b.  The pairs meet on the pixel; pixels that only
    the second image has are left out, as if it were cropped to the first.
    """
    a = pixels.select("px", F.col("image").alias("image_i"), F.col("r").alias("r1"), F.col("g").alias("g1"), F.col("b").alias("b1"))
    b = pixels.select("px", F.col("image").alias("image_j"), F.col("r").alias("r2"), F.col("g").alias("g2"), F.col("b").alias("b2"))
    square = sum((F.col(f"{c}1") - F.col(f"{c}2")) * (F.col(f"{c}1") - F.col(f"{c}2")) for c in "rgb")
    return a.join(b, "px").groupBy("image_i", "image_j").agg(F.avg(F.sqrt(square)).alias("distance"))


def mosaic(images: DataFrame, wide: int = 41, tile: int = 256) -> DataFrame:
    """images (image, ordinal from 0) with the pixel place of their tile: left and top."""
    return images.withColumns({"left": F.pmod("ordinal", F.lit(wide)) * tile, "top": F.floor(F.col("ordinal") / wide) * tile})


def directory(spark, path: str) -> DataFrame:
    """path, major, minor, content of the images named image_<major>_<minor>.png in a folder."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", "image*.png").load(path)
    part = lambda k: F.regexp_extract("path", r"image_(\d+)_(\d+)", k).try_cast("int")
    return rows.select("path", part(1).alias("major"), part(2).alias("minor"), "content")


def decode_png(data: bytes) -> np.ndarray:
    """Height x width x 3 bytes of a PNG of 8-bit grey, RGB or RGBA samples, not interlaced."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG")
    at, idat, head = 8, b"", None
    while at < len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            idat += body
        at += 12 + size
    width, height, depth, colour, _, _, interlace = head
    samples = {0: 1, 2: 3, 6: 4}.get(colour)
    if depth != 8 or samples is None or interlace:
        raise ValueError("only 8-bit grey, RGB or RGBA without interlacing")
    raw = np.frombuffer(zlib.decompress(idat), np.uint8).reshape(height, 1 + width * samples)
    out = np.zeros((height, width * samples), np.int32)
    for y in range(height):
        kind, line, above = raw[y, 0], raw[y, 1:].astype(np.int32), out[y - 1] if y else np.zeros(width * samples, np.int32)
        if kind == 0:
            out[y] = line
        elif kind == 2:
            out[y] = (line + above) & 255
        else:
            for k in range(width * samples):
                left = out[y, k - samples] if k >= samples else 0
                corner = above[k - samples] if k >= samples else 0
                if kind == 1:
                    guess = left
                elif kind == 3:
                    guess = (left + above[k]) // 2
                else:
                    p = left + above[k] - corner
                    guess = min((abs(p - left), 0, left), (abs(p - above[k]), 1, above[k]), (abs(p - corner), 2, corner))[2]
                out[y, k] = (line[k] + guess) & 255
    rows = out.reshape(height, width, samples).astype(np.uint8)
    return np.repeat(rows, 3, axis=2) if samples == 1 else rows[:, :, :3]


def to_pixels(images: DataFrame) -> DataFrame:
    """path, px, r, g, b of PNG images (path, content); px counts row by row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch.path, batch.content, strict=True):
                flat = decode_png(bytes(content)).reshape(-1, 3).astype("int32")
                yield pd.DataFrame({"path": path, "px": np.arange(len(flat)), "r": flat[:, 0], "g": flat[:, 1], "b": flat[:, 2]})

    return images.select("path", "content").mapInPandas(run, "path string, px long, r int, g int, b int")
