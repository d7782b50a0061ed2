"""Quality and size metrics of planes and images."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockloom.functions.pixels import psnr, ratio
from blockloom.plans.config import VQConfig

from .blocks import PLANE


def mse_psnr(pairs: DataFrame) -> DataFrame:
    diff = F.col("a").cast("double") - F.col("b").cast("double")
    return pairs.groupBy(*PLANE).agg(F.avg(diff * diff).alias("mse")).withColumn("psnr", psnr(F.col("mse")))


def compression_ratios(sizes: DataFrame, pixels: int, vectors: int, config: VQConfig) -> DataFrame:
    """Of huffman_sizes. Of the labels, a byte each: cr_data (over the coded bytes), cr_total (with the header).

    Of the pixels, a byte each: cr_system (over codebook, header and coded bytes), cr_fixed (over codebook and a byte a label), bpp (8 / cr_system).
    """
    labels, raw, book = F.lit(float(vectors)), F.lit(float(pixels)), config.codes * config.length
    s = sizes.withColumn("cr_data", ratio(labels, F.col("data_bytes"))).withColumn("cr_total", ratio(labels, F.col("total_bytes")))
    s = s.withColumn("cr_system", ratio(raw, F.col("total_bytes") + book)).withColumn("cr_fixed", ratio(raw, F.lit(float(book + vectors))))
    return s.withColumn("bpp", ratio(F.lit(8.0), F.col("cr_system")))


def image_metrics(planes: DataFrame, pixels: int, codebook_bytes: int) -> DataFrame:
    """Planes to images: mean mse and ssim, psnr of the mean mse, bytes with codebooks, the ratio of totals, not a mean of ratios, and all planes' seconds of training."""
    bytes_ = F.sum("total_bytes") + F.count("*") * codebook_bytes
    seconds = [F.sum("train_seconds").alias("train_seconds")] if "train_seconds" in planes.columns else []
    whole = planes.groupBy("image_id").agg(F.count("*").alias("planes"), F.avg("mse").alias("mse"), F.avg("ssim").alias("ssim"), bytes_.alias("compressed_bytes"), *seconds)
    whole = whole.withColumn("psnr", psnr(F.col("mse")))
    return whole.withColumn("cr_system", ratio(F.col("planes") * F.lit(float(pixels)), F.col("compressed_bytes")))
