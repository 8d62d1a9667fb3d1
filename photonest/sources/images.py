"""Image files as rows: scan, format filter, id and order; decoded by Spark's own image source."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from photonest.functions.expressions import photo_id
from photonest.operators.order import numbered

# The supported extensions, and the row of Spark's image source.
EXTENSIONS = r"(?i)\.(jpe?g|png|tiff?|bmp|webp)$"
IMAGE = "image struct<origin:string,height:int,width:int,nChannels:int,mode:int,data:binary>"


def path_order(path: Column) -> list[Column]:
    """Paths sort by their parts, not as plain strings."""
    return [F.split(path, "/").asc(), path.asc()]


def scan_images(spark: SparkSession, folder: str) -> DataFrame:
    """``(id, idx, path, length)`` of the image files under ``folder``, idx from 0 in path order."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select(plain_path(F.col("path")).alias("path"), "length")
    files = files.where(F.col("path").rlike(EXTENSIONS)).withColumn("id", photo_id(F.col("path")))
    placed = numbered(files, path_order(F.col("path")), "n")
    return placed.select("id", (F.col("n") - 1).alias("idx"), "path", "length")


def plain_path(path: Column) -> Column:
    """A local path without its scheme, as the binary source writes it."""
    return F.regexp_replace(path, "^file:(//)?", "")


def unescaped(origin: Column) -> Column:
    """The image source writes escaped addresses, the binary source plain ones."""
    return F.url_decode(F.replace(origin, F.lit("+"), F.lit("%2B")))


def load_images(spark: SparkSession, folder: str, stream: bool = False) -> DataFrame:
    """``(path, height, width, channels, data)`` of image files, data as Spark's image source gives it.

    Files that cannot be decoded (WEBP has no reader here) have height -1; ``rgb_of`` turns the rest into arrays.
    """
    reader = spark.readStream if stream else spark.read
    raw = reader.format("image").schema(IMAGE).option("dropInvalid", False).option("recursiveFileLookup", True).load(folder).select("image.*")
    raw = raw.withColumn("path", plain_path(unescaped(F.col("origin")))).where(F.col("path").rlike(EXTENSIONS))
    return raw.select("path", "height", "width", F.col("nChannels").alias("channels"), "data")


def rgb_of(height: int, width: int, channels: int, data: bytes) -> np.ndarray:
    """[height, width, 3]: gray gives equal channels, alpha is dropped."""
    pixels = np.frombuffer(data, np.uint8).reshape(height, width, channels)
    return np.repeat(pixels, 3, axis=2) if channels == 1 else pixels[..., 2::-1]
