"""Image directories: bytes and pixels by Spark's two readers, hashes and features in batches of numpy.

Files are read by bytes for digests, types and guards, and by Spark's image reader for what needs pixels. Either is a scan
without a shuffle; what is joined of the two is a few numbers for each file.
"""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assaya.functions.text import content_type

#: The file types read.
READ_TYPES = ("image/png", "image/jpeg", "image/bmp", "image/webp")
GLOB = "*.{png,jpg,jpeg,bmp,webp,PNG,JPG,JPEG,BMP,WEBP}"


def _below(path, folder: str):
    """The path without its scheme and the folder."""
    plain = lambda c: F.regexp_replace(c, "^file:/*", "/")
    return F.replace(plain(path), F.regexp_replace(plain(F.lit(folder)), "/*$", "/"), F.lit(""))


def _scan(spark: SparkSession, folder: str, kind: str) -> DataFrame:
    return spark.read.format(kind).option("recursiveFileLookup", True).option("pathGlobFilter", GLOB).option("dropInvalid", False).load(folder)


def header_size(content):
    """(width, height) that the first bytes of a PNG, GIF or BMP state, as a struct; nulls for other types."""
    head = F.hex(F.substring(content, 1, 26))
    number = lambda at, n, little: F.conv(F.concat(*[F.substring(head, 2 * i + 1, 2) for i in (range(at + n - 1, at - 1, -1) if little else range(at, at + n))]), 16, 10).cast("long")
    kind = content_type(content)
    pick = lambda png, gif, bmp: F.when(kind == "image/png", number(png, 4, False)).when(kind == "image/gif", number(gif, 2, True)).when(kind == "image/bmp", number(bmp, 4, True))
    return F.struct(pick(16, 6, 18).alias("width"), pick(20, 8, 22).alias("height"))


def read_files(spark: SparkSession, folder: str) -> DataFrame:
    """(file_name, relative_path, sha256, size, content_type, stated_width, stated_height): every image file below ``folder``,
    by its bytes, which go no further than the scan. Guards on the stated sides need no decoding."""
    files = _scan(spark, folder, "binaryFile")
    rows = files.select(_below(F.col("path"), folder).alias("relative_path"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("size"), content_type(F.col("content")).alias("content_type"), header_size(F.col("content")).alias("_stated"))
    return rows.select(F.regexp_extract("relative_path", "([^/]*)$", 1).alias("file_name"), "relative_path", "sha256", "size", "content_type", F.col("_stated.width").alias("stated_width"), F.col("_stated.height").alias("stated_height"))


def read_pixels(spark: SparkSession, folder: str) -> DataFrame:
    """(relative_path, width, height, channels, data) of every image below ``folder``: blue, green, red (or one grey) by row.
    An undecodable file has a width of -1. Features are worked out where a file is decoded; pixels aren't shuffled."""
    return _scan(spark, folder, "image").select(_below(F.col("image.origin"), folder).alias("relative_path"), "image.width", "image.height", F.col("image.nChannels").alias("channels"), "image.data")


def read_images(spark: SparkSession, folder: str) -> DataFrame:
    """The rows of ``read_files`` with width, height and channels as decoded. Only these few numbers are joined."""
    seen = read_pixels(spark, folder).select("relative_path", "width", "height", "channels")
    return read_files(spark, folder).join(seen, "relative_path", "left").select("file_name", "relative_path", "sha256", "size", "content_type", "stated_width", "stated_height", "width", "height", "channels")


def image_code(most_bytes: int = 50 << 20, most_side: int = 8192, most_pixels: int = 8192 * 8192):
    """The first guard that a row fails, else null. A row of ``read_images`` may have ``content_type``, the type that its first
    bytes show: ``not_an_image`` for none, ``unsupported_format`` for one that isn't read."""
    return (
        F.when(F.col("size") > most_bytes, "file_too_large")
        .when(F.col("content_type") == "application/octet-stream", "not_an_image")
        .when(~F.col("content_type").isin(*READ_TYPES), "unsupported_format")
        .when(F.coalesce(F.col("width"), F.lit(-1)) < 0, "not_decodable")
        .when(F.greatest("width", "height") > most_side, "dimension_too_large")
        .when(F.col("width").cast("long") * F.col("height") > most_pixels, "too_many_pixels")
    )


def _rgb(row) -> np.ndarray | None:
    if row.data is None or row.width is None or row.width <= 0:
        return None
    a = np.frombuffer(row.data, dtype=np.uint8).reshape(int(row.height), int(row.width), int(row.channels)).astype(float)
    return np.repeat(a, 3, axis=2) if a.shape[2] == 1 else a[:, :, 2::-1]


def resized(a: np.ndarray, height: int, width: int) -> np.ndarray:
    """By area: each target pixel is the mean of what it covers."""

    def weights(n: int, m: int) -> np.ndarray:
        edges = np.linspace(0, n, m + 1)
        at = np.arange(n)
        w = np.clip(np.minimum(edges[1:, None], at + 1) - np.maximum(edges[:-1, None], at), 0, None)
        return w / w.sum(axis=1, keepdims=True)

    return np.tensordot(weights(a.shape[0], height), np.tensordot(weights(a.shape[1], width), a, axes=(1, 1)), axes=(1, 1))


def grey(rgb: np.ndarray) -> np.ndarray:
    return rgb @ np.array([0.299, 0.587, 0.114])


def _hex(bits: np.ndarray) -> str:
    return f"{int(''.join('1' if b else '0' for b in bits.ravel()), 2):016x}"


def dhash(g: np.ndarray) -> str:
    """64 bits: is a pixel of the 9 x 8 image darker than its right neighbour?"""
    small = resized(g, 8, 9)
    return _hex(small[:, 1:] > small[:, :-1])


def phash(g: np.ndarray) -> str:
    """64 bits: which of the 8 x 8 lowest frequencies of the 32 x 32 image are above their median?"""
    i, k = np.arange(32), np.arange(8)
    cosines = np.cos(np.pi * np.outer(k, 2 * i + 1) / 64)
    low = cosines @ resized(g, 32, 32) @ cosines.T
    return _hex(low > np.median(low))


def _mapped(images: DataFrame, keys: list[str], one, schema: str) -> DataFrame:
    names = [x.split()[0] for x in schema.split(", ")]

    def work(batches):
        for pdf in batches:
            rows = []
            for row in pdf.itertuples(index=False):
                rgb = _rgb(row)
                rows += [(*[getattr(row, k) for k in keys], *values) for values in one(rgb)]
            yield pd.DataFrame(rows, columns=names)

    return images.select(*keys, "width", "height", "channels", "data").mapInPandas(work, schema)


def fingerprints(images: DataFrame) -> DataFrame:
    """(relative_path, phash, dhash); nulls for what has no pixels."""
    return _mapped(images, ["relative_path"], lambda a: [(None, None) if a is None else (phash(grey(a)), dhash(grey(a)))], "relative_path string, phash string, dhash string")


def photometric(images: DataFrame) -> DataFrame:
    """(relative_path, red, green, blue, luminance_std) of the 32 x 32 image; 128, 128, 128 and 30 for what has no pixels."""

    def one(a):
        if a is None:
            return [(128.0, 128.0, 128.0, 30.0)]
        small = resized(a, 32, 32)
        return [(*small.reshape(-1, 3).mean(axis=0).tolist(), float(grey(small).std()))]

    return _mapped(images, ["relative_path"], one, "relative_path string, red double, green double, blue double, luminance_std double")


def corner_patches(images: DataFrame) -> DataFrame:
    """(relative_path, location, dhash, variance): four rows for each image of 16 pixels a side or more; a patch has an eighth
    of each side, 8 to 48 pixels."""

    def one(a):
        if a is None or min(a.shape[:2]) < 16:
            return []
        h, w = (max(8, min(48, n // 8)) for n in a.shape[:2])
        g = grey(a)
        corners = {"top_left": g[:h, :w], "top_right": g[:h, -w:], "bottom_left": g[-h:, :w], "bottom_right": g[-h:, -w:]}
        return [(name, dhash(c), float(c.var())) for name, c in corners.items()]

    return _mapped(images, ["relative_path"], one, "relative_path string, location string, dhash string, variance double")
