"""The whole pipeline: blocks, training, coding, decoding, filtering, metrics, for any number of images and planes at once."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockloom.functions.pixels import rounded
from blockloom.operators import assign, blocks, coding, fidelity, stencil, train
from blockloom.operators.blocks import PLANE
from blockloom.sources import sinks
from blockloom.sources.images import GRAY

from .config import VQConfig
from .tables import written


@dataclass
class Result:
    codebook: DataFrame
    labels: DataFrame
    deltas: DataFrame
    raw: DataFrame
    filtered: DataFrame
    encoded: DataFrame
    iterations: DataFrame
    planes: DataFrame
    seconds: dict[str, float] = field(default_factory=dict)


def run(pixels: DataFrame, config: VQConfig, codebook: Callable[[DataFrame], DataFrame] | None = None) -> Result:
    """All steps; each plane's metrics are in `planes`. Metrics compare the input with the filtered image.

    With `codebook`, which makes (image_id, channel, code, w) from the vectors, nothing is trained: vectors take their nearest codes in it.
    """
    seconds, began = {}, time.perf_counter()

    def took(name: str) -> None:
        nonlocal began
        seconds[name], began = time.perf_counter() - began, time.perf_counter()

    pixels = written(pixels)
    vectors = written(blocks.to_vectors(pixels, config.width, config.block))
    took("blocks")
    trained = train.fit(vectors, config) if codebook is None else given(vectors, codebook(vectors), config)
    took("training")
    deltas = written(coding.delta_encode(trained.labels))
    codes = written(coding.huffman_codes(coding.histogram(deltas, "d")))
    encoded = written(coding.huffman_pieces(deltas, codes))
    took("coding")
    raw = written(blocks.decode(coding.delta_decode(deltas), trained.codebook, config.width, config.block))
    took("decoding")
    filtered = written(stencil.bilateral(raw, config))
    took("filter")
    pairs = stencil.paired(pixels, filtered)
    pixels_of, vectors_of = config.width * config.height, config.width * config.height // config.length
    sizes = coding.huffman_streams(encoded, codes).withColumn("total_bytes", F.col("data_bytes") + F.col("header_bytes"))
    planes = fidelity.compression_ratios(sizes, pixels_of, vectors_of, config)
    planes = planes.join(fidelity.mse_psnr(pairs), PLANE)
    ssim = stencil.ssim_map(pairs, config.width, config.height, config).groupBy(*PLANE).agg(F.avg("ssim").alias("ssim"))
    # An image without a whole window has 0.
    planes = planes.join(ssim, PLANE, "left").withColumn("ssim", F.coalesce("ssim", F.lit(0.0)))
    planes = planes.join(trained.seconds.withColumnRenamed("seconds", "train_seconds"), PLANE, "left")
    planes = planes.join(coding.entropy(trained.labels, "label", config.codes).withColumnRenamed("entropy", "entropy_label"), PLANE)
    planes = written(planes.join(coding.entropy(deltas, "d", 256).withColumnRenamed("entropy", "entropy_delta"), PLANE))
    took("metrics")
    return Result(trained.codebook, trained.labels, deltas, raw, filtered, encoded, trained.iterations, planes, seconds)


def given(vectors: DataFrame, codebook: DataFrame, config: VQConfig) -> train.Trained:
    """Labels of a codebook that is known already."""
    codebook = written(codebook)
    labels = written(assign.nearest(vectors, codebook, config.length).select(*PLANE, "vec_idx", "label"))
    none = vectors.limit(0)
    log = none.select(*PLANE, F.lit(0).alias("k"), F.lit(0).alias("iter"), F.lit(0.0).alias("distortion"), F.lit(0.0).alias("improvement"))
    return train.Trained(codebook, labels, log, none.select(*PLANE, F.lit(0.0).alias("seconds")))


def images(result: Result, config: VQConfig) -> DataFrame:
    """One row an image."""
    return fidelity.image_metrics(result.planes, config.width * config.height, config.codes * config.length)


def write_outputs(result: Result, pixels: DataFrame, config: VQConfig, path: str) -> None:
    """BMP files of the input, the decoded and the filtered images in folders of their own, and the latter two as text if they are gray."""
    for name, cells in (("original", pixels), ("compressed_raw", result.raw), ("compressed_filtered", result.filtered)):
        sinks.write_bmp(cells, config.width, config.height, f"{path}/{name}")
    for name, cells in (("lbg_decompress", result.raw), ("decompress", result.filtered)):
        gray = cells.where(F.col("channel") == GRAY)
        if gray.limit(1).count():
            sinks.write_text(gray, f"{path}/{name}")


def codebook_bytes(codebook: DataFrame) -> DataFrame:
    """Codewords as whole numbers."""
    return codebook.select(*PLANE, "code", F.transform("w", rounded).alias("w"))


def codebook_head(codebook: DataFrame, n: int = 10) -> DataFrame:
    return codebook.where(F.col("code") < n).select(*PLANE, "code", F.array_join(F.transform("w", lambda e: F.format_string("%.1f", e)), " ").alias("w"))


def report(result: Result, config: VQConfig | None = None) -> str:
    """Metrics and step times as text: a plane a line and, with the configuration, a line for each image of several planes."""
    lines = [f"{r.image_id} {r.channel}: mse {r.mse:.4f}, psnr {r.psnr:.2f} dB, ssim {r.ssim:.4f}, entropy {r.entropy_label:.4f} -> {r.entropy_delta:.4f}, {r.total_bytes} bytes, labels over bytes {r.cr_data:.2f} and {r.cr_total:.2f}, ratio {r.cr_system:.2f}, fixed {r.cr_fixed:.2f}, {r.bpp:.3f} bits a pixel, training {r.train_seconds or 0:.3f} s, round trip {'ok' if r.roundtrip else 'ERROR'}" for r in result.planes.orderBy(*PLANE).collect()]
    if config:
        lines += [f"{r.image_id}: mse {r.mse:.4f}, psnr {r.psnr:.2f} dB, mean ssim {r.ssim:.4f}, ratio {r.cr_system:.2f}, training {r.train_seconds or 0:.3f} s" for r in images(result, config).where("planes > 1").orderBy("image_id").collect()]
    return "\n".join(lines + [f"{k}: {v:.3f} s" for k, v in result.seconds.items()] + [f"all: {sum(result.seconds.values()):.3f} s"])
