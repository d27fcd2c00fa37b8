"""Photos from image files, and synthetic ones for tests."""

from __future__ import annotations

import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LIMIT = 24 * 1024 * 1024


def read_photos(spark: SparkSession, path: str) -> DataFrame:
    """photo_id, path, height, width, n_channels, data (blue first) of image files up to 24 MiB; undecodable files are dropped by the source."""
    small = spark.read.format("binaryFile").load(path).where(F.col("length") <= LIMIT).select("path")
    rows = spark.read.format("image").option("dropInvalid", True).load(path).select("image.*")
    rows = rows.join(small, F.regexp_replace(rows["origin"], "^file:/+", "/") == F.regexp_replace(small["path"], "^file:/+", "/"), "left_semi")
    return rows.select(F.xxhash64("origin").alias("photo_id"), F.col("origin").alias("path"), "height", "width", F.col("nChannels").alias("n_channels"), "data")


def rejected(spark: SparkSession, path: str) -> DataFrame:
    """path, length of files that are too large."""
    return spark.read.format("binaryFile").load(path).where(F.col("length") > LIMIT).select("path", "length")


def working_copy(rgb: np.ndarray, side: int = 1500) -> np.ndarray:
    """At most `side` long, by means over the pixels that fall together."""
    h, w = rgb.shape[:2]
    scale = min(1.0, side / max(h, w))
    if scale == 1:
        return rgb
    nh, nw = max(1, round(h * scale)), max(1, round(w * scale))
    ys, xs = (np.arange(n + 1) * m // n for n, m in ((nh, h), (nw, w)))
    total = np.add.reduceat(np.add.reduceat(rgb.astype(float), ys[:-1], 0), xs[:-1], 1)
    area = np.diff(ys)[:, None, None] * np.diff(xs)[None, :, None]
    return np.floor(total / area + 0.5).astype(np.uint8)


def png(rgb: np.ndarray) -> bytes:
    """An uncomplicated PNG file of an RGB array."""
    h, w = rgb.shape[:2]

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    rows = np.concatenate([np.zeros((h, 1), np.uint8), rgb.reshape(h, w * 3)], 1).tobytes()
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")
