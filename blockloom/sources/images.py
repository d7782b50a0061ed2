"""Image sources: text grids of integers, and the image derived from the events table."""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from blockloom.functions.pixels import clamp
from blockloom.operators.order import placed

RGB = ("Red", "Green", "Blue")
GRAY = "Gray"


def integer_prefix(text: Column) -> Column:
    """The integers at the start of a text, as strings: white space, signs and digits up to the first thing that is none.

    Anchoring each match at the end of the last one keeps the regular expression from recursing.
    """
    return F.regexp_extract_all(text, F.lit(r"\G\s*([+-]?[0-9]+)"), F.lit(1))


def token_value(token: Column, low: int = 0, high: int = 255) -> Column:
    """A token as a clamped integer; tokens too long for 64 bits go to the end that their sign says."""
    number = token.try_cast("bigint")
    over = F.when(token.startswith("-"), F.lit(low)).otherwise(F.lit(high))
    return F.when(number.isNull(), over).otherwise(clamp(number, low, high)).cast("int")


def mode_of(tokens: Column, width: int, height: int) -> Column:
    """gray, color or unknown, by the number of integers."""
    n = width * height
    return F.when(tokens == n, "gray").when(tokens == 3 * n, "color").otherwise("unknown")


def scan_text(spark: SparkSession, path: str, width: int, height: int, mode: str | None = None) -> DataFrame:
    """(image_id, channel, y, x, v) of every text file under a path; image_id is the file's path.

    Surplus integers are ignored when the mode is given. A file with too few, or, without a mode, with
    any other number of integers than a gray or color image has, fails the job; the mode must be None, "gray" or "color".
    """
    if mode not in (None, "gray", "color"):
        raise ValueError(f"unknown mode: {mode}")
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("image_id"), integer_prefix(F.col("value")).alias("tokens"))
    n = width * height
    found = F.size("tokens")
    kind = F.lit(mode) if mode else mode_of(found, width, height)
    files = files.withColumn("mode", kind)
    need = F.when(F.col("mode") == "color", 3 * n).otherwise(n)
    bad = (F.col("mode") == "unknown") | (found < need)
    message = F.concat(F.col("image_id"), F.lit(": "), found.cast("string"), F.lit(" integers do not make a "), F.lit(f"{width} x {height} image; give the mode of files of another size"))
    files = files.withColumn("tokens", F.when(bad, F.raise_error(message).cast("array<string>")).otherwise(F.slice("tokens", 1, need)))
    return cells_of(files, width)


def cells_of(files: DataFrame, width: int) -> DataFrame:
    """(image_id, mode, tokens) -> (image_id, channel, y, x, v); tokens are a whole image's, of mode gray or color."""
    cells = files.select("image_id", "mode", F.posexplode("tokens").alias("pos", "token"))
    color = F.col("mode") == "color"
    pixel = F.when(color, F.floor(F.col("pos") / 3)).otherwise(F.col("pos")).cast("int")
    channel = F.when(color, F.element_at(F.array(*map(F.lit, RGB)), F.col("pos") % 3 + 1)).otherwise(GRAY)
    return cells.select("image_id", channel.alias("channel"), F.floor(pixel / width).cast("int").alias("y"), (pixel % width).cast("int").alias("x"), token_value(F.col("token")).alias("v"))


def detect_modes(spark: SparkSession, path: str, width: int, height: int) -> DataFrame:
    """(image_id, tokens, mode) of every text file under a path."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("image_id"), F.size(integer_prefix(F.col("value"))).alias("tokens"))
    return files.withColumn("mode", mode_of(F.col("tokens"), width, height))


class Frame(NamedTuple):
    """Size of an image in pixels, how many of them have a value of their own, and whether event_id counts these from 0 without gaps or repeats."""

    width: int
    height: int
    filled: int
    dense: bool = True


def frame_of(n: int, block: int = 4) -> Frame:
    """The least image, about square and of whole blocks, that holds n pixels; one block at least."""
    root = math.isqrt(max(0, n - 1)) + 1  # the square root, rounded up
    width = block * -(-root // block)
    return Frame(width, block * max(1, -(-n // (block * width))), n)


def events_frame(spark: SparkSession, sf_dir: str) -> Frame:
    """One job; a bit an event is sent, in bitmaps, to tell whether ids are dense."""
    i = F.col("event_id").cast("bigint")
    bits = F.bitmap_count(F.bitmap_construct_agg(F.bitmap_bit_position(i)))
    parts = spark.read.parquet(f"{sf_dir}/events.parquet").groupBy(F.bitmap_bucket_number(i).alias("bucket")).agg(bits.alias("bits"), F.count("*").alias("n"), F.min(i).alias("low"), F.max(i).alias("high"))
    bits, n, low, high = parts.agg(F.sum("bits"), F.coalesce(F.sum("n"), F.lit(0)), F.min("low"), F.max("high")).head()
    return frame_of(n)._replace(dense=n == 0 or (bits == n and low == 0 and high == n - 1))


def events_image(spark: SparkSession, sf_dir: str, *, color: bool = True, frame: Frame | None = None) -> DataFrame:
    """The events table as an image that holds every event, in the order of event_id; pixels after the last event are 0, as are those of null values.

    Where event_id counts from 0 without gaps or repeats it is the pixel's place; else places are told by sorting.
    """
    frame = events_frame(spark, sf_dir) if frame is None else frame
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "value", "user_id")
    if frame.dense:
        e = e.withColumn("place", F.col("event_id"))
    else:
        e = placed(e, F.col("event_id").asc_nulls_first(), F.col("user_id").asc_nulls_first(), F.col("value").asc_nulls_first())
    red = clamp(F.floor("value")).cast("int")
    green = F.pmod(F.floor(F.col("value") * 7), F.lit(256)).cast("int")
    blue = F.pmod(F.col("user_id") * 37, F.lit(256)).cast("int")
    valued = lambda v, of: F.when(F.col(of).isNull(), 0).otherwise(v).cast("int")
    each = {"r": valued(red, "value"), "g": valued(green, "value"), "b": valued(blue, "user_id")}
    rest = spark.range(frame.filled, frame.width * frame.height).select(F.col("id").alias("place"), *(F.lit(0).alias(c) for c in each))
    e = e.select(F.col("place").cast("bigint").alias("place"), *(v.alias(c) for c, v in each.items())).unionByName(rest)
    planes = [(GRAY, "r")] if not color else list(zip(RGB, each, strict=True))
    cell = F.explode(F.array(*(F.struct(F.lit(c).alias("channel"), F.col(v).alias("v")) for c, v in planes))).alias("p")
    y, x = F.floor(F.col("place") / frame.width).cast("int"), (F.col("place") % frame.width).cast("int")
    return e.select(y.alias("y"), x.alias("x"), cell).select(F.lit("events").alias("image_id"), "p.channel", "y", "x", "p.v")
