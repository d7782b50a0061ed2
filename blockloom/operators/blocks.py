"""Blocking, unblocking, and recombining channels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockloom.functions.pixels import rounded

PLANE = ["image_id", "channel"]


def to_vectors(pixels: DataFrame, width: int, block: int = 4) -> DataFrame:
    """(image_id, channel, vec_idx, v): one array a block, blocks and the pixels in them in raster order.

    A block that lacks a pixel, or has one twice, fails the job.
    """
    across = width // block
    at = F.floor(F.col("y") / block) * across + F.floor(F.col("x") / block)
    pos = (F.col("y") % block) * block + F.col("x") % block
    cells = pixels.select(*PLANE, at.cast("int").alias("vec_idx"), F.struct(pos.cast("int").alias("pos"), F.col("v").cast("float").alias("v")).alias("c"))
    rows = cells.groupBy(*PLANE, "vec_idx").agg(F.array_sort(F.collect_list("c")).alias("c"))
    places = F.col("c.pos") == F.array(*map(F.lit, range(block * block)))
    whole = places & (F.size(F.array_compact("c.v")) == block * block)
    message = F.concat(F.col("image_id"), F.lit(" "), F.col("channel"), F.lit(": block "), F.col("vec_idx").cast("string"), F.lit(" is not whole"))
    return rows.select(*PLANE, "vec_idx", F.when(whole, F.col("c.v")).otherwise(F.raise_error(message).cast("array<float>")).alias("v"))


def to_pixels(vectors: DataFrame, width: int, block: int = 4, column: str = "v") -> DataFrame:
    """The inverse of to_vectors; values are rounded to whole pixels."""
    across = width // block
    cells = vectors.select(*PLANE, "vec_idx", F.posexplode(column).alias("pos", "e"))
    y = F.floor(F.col("vec_idx") / across) * block + F.floor(F.col("pos") / block)
    x = (F.col("vec_idx") % across) * block + F.col("pos") % block
    return cells.select(*PLANE, y.cast("int").alias("y"), x.cast("int").alias("x"), rounded(F.col("e")).alias("v"))


def decode(labels: DataFrame, codebook: DataFrame, width: int, block: int = 4) -> DataFrame:
    """Pixels of labelled blocks. A codebook has at most 256 codes a plane; planes are matched, too."""
    words = codebook.select(*PLANE, F.col("code").alias("label"), "w")
    return to_pixels(labels.join(words, [*PLANE, "label"]), width, block, "w")


def merge_channels(pixels: DataFrame, channels: tuple[str, ...] = ("Red", "Green", "Blue")) -> DataFrame:
    """One row a pixel with a column for each channel, in lower case."""
    aggs = [F.max(F.when(F.col("channel") == c, F.col("v"))).alias(c.lower()) for c in channels]
    return pixels.where(F.col("channel").isin(*channels)).groupBy("image_id", "y", "x").agg(*aggs)
