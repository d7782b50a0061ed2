"""Neighbourhood operators: the bilateral filter and structural similarity.

Rows of an image are windows of their own, then columns, so a huge image is many small groups.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from blockloom.functions.pixels import clamp
from blockloom.plans.config import VQConfig

from .blocks import PLANE


def along_rows() -> WindowSpec:
    return Window.partitionBy(*PLANE, "y").orderBy("x")


def along_columns() -> WindowSpec:
    return Window.partitionBy(*PLANE, "x").orderBy("y")


def total(terms: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, terms)


def bilateral(pixels: DataFrame, config: VQConfig = VQConfig()) -> DataFrame:  # noqa: B008
    """(…, y, x, v): alpha * center + (1 - alpha) * the weighted mean of the neighbours inside the image, to whole numbers by + 0.5."""
    r = config.bilateral_size // 2
    offsets = range(-r, r + 1)
    wide = pixels.select(*PLANE, "y", "x", *(F.lag(F.col("v").cast("double"), -i).over(along_rows()).alias(f"h{i + r}") for i in offsets))
    taps = [(j, i, F.lag(f"h{i + r}", -j).over(along_columns()).alias(f"t{j + r}_{i + r}")) for j in offsets for i in offsets]
    near = wide.select(*PLANE, "y", "x", *(c for _, _, c in taps))
    center = F.col(f"t{r}_{r}")
    space, color = 2.0 * config.sigma_space**2, 2.0 * config.sigma_color**2
    weights, sums = [], []
    for j, i, _ in taps:
        v = F.col(f"t{j + r}_{i + r}")
        w = F.coalesce(F.lit(math.exp(-(i * i + j * j) / space)) * F.exp(-((v - center) * (v - center)) / F.lit(color)), F.lit(0.0))
        weights.append(w.alias(f"w{j + r}_{i + r}"))
        sums.append(F.col(f"w{j + r}_{i + r}") * F.coalesce(v, F.lit(0.0)))
    weighed = near.select("*", *weights)
    mean = total(sums) / total([F.col(f"w{j + r}_{i + r}") for j, i, _ in taps])
    blended = F.lit(config.alpha) * center + F.lit(1.0 - config.alpha) * mean
    return weighed.select(*PLANE, "y", "x", F.floor(clamp(blended, 0, 255).cast("double") + 0.5).cast("int").alias("v"))


def gaussian(size: int, sigma: float) -> list[float]:
    """One axis of the normalised window; the two-dimensional one is its outer product."""
    raw = [math.exp(-((i - size // 2) ** 2) / (2.0 * sigma * sigma)) for i in range(size)]
    return [x / sum(raw) for x in raw]


def paired(first: DataFrame, second: DataFrame) -> DataFrame:
    """(…, y, x, a, b): two images of the same planes by position."""
    return first.select(*PLANE, "y", "x", F.col("v").alias("a")).join(second.select(*PLANE, "y", "x", F.col("v").alias("b")), [*PLANE, "y", "x"])


def ssim_map(pairs: DataFrame, width: int, height: int, config: VQConfig = VQConfig()) -> DataFrame:  # noqa: B008
    """(…, y, x, ssim) of each window that lies inside the image, at its center.

    The window is separable: five moments are weighted along rows, then along columns.
    """
    half, g = config.ssim_window // 2, gaussian(config.ssim_window, config.ssim_sigma)
    a, b = F.col("a").cast("double"), F.col("b").cast("double")
    moments = pairs.select(*PLANE, "y", "x", a.alias("ma"), b.alias("mb"), (a * a).alias("aa"), (b * b).alias("bb"), (a * b).alias("ab"))
    names = ["ma", "mb", "aa", "bb", "ab"]
    for window, at, most in ((along_rows(), "x", width), (along_columns(), "y", height)):
        sums = [total([F.lit(w) * F.lag(n, half - i).over(window) for i, w in enumerate(g)]).alias(n) for n in names]
        moments = moments.select(*PLANE, "y", "x", *sums).where(F.col(at).between(half, most - 1 - half))
    c1, c2 = (config.ssim_k1 * config.peak) ** 2, (config.ssim_k2 * config.peak) ** 2
    ma, mb = F.col("ma"), F.col("mb")
    top = (2.0 * ma * mb + c1) * (2.0 * (F.col("ab") - ma * mb) + c2)
    bottom = (ma * ma + mb * mb + c1) * ((F.col("aa") - ma * ma) + (F.col("bb") - mb * mb) + c2)
    return moments.select(*PLANE, "y", "x", (top / bottom).alias("ssim"))
