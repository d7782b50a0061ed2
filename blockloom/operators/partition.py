"""Partition plans: how many vectors each of `ranks` workers would get. Spark's scheduler replaces them; the plan is the result."""

from __future__ import annotations

import time

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def with_offsets(counts: DataFrame) -> DataFrame:
    """(rank, cnt) -> (rank, cnt, displ): running sums of the counts before; one row a worker."""
    before = Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    return counts.select("rank", "cnt", F.coalesce(F.sum("cnt").over(before), F.lit(0)).alias("displ"))


def equal_split(spark: SparkSession, n: int, ranks: int) -> DataFrame:
    """The remainder goes to the lowest ranks."""
    rank = F.col("id").cast("int")
    return with_offsets(spark.range(ranks).select(rank.alias("rank"), (F.lit(n // ranks) + F.when(rank < n % ranks, 1).otherwise(0)).cast("bigint").alias("cnt")))


def weighted_split(speeds: DataFrame, n: int) -> DataFrame:
    """(rank, speed) -> plan in proportion to speeds, by largest remainders; equal remainders go to the lowest rank.

    Speeds that add up to nothing or less count as 1 each.
    """
    whole = Window.partitionBy(F.lit(0))
    s = speeds.withColumn("sum", F.sum("speed").over(whole))
    s = s.withColumn("speed", F.when(F.col("sum") <= 0, 1.0).otherwise(F.col("speed"))).withColumn("sum", F.sum("speed").over(whole))
    s = s.withColumn("ideal", F.lit(float(n)) * F.col("speed") / F.col("sum")).withColumn("base", F.floor("ideal"))
    s = s.withColumn("rest", F.lit(n) - F.sum("base").over(whole))
    turn = F.row_number().over(Window.orderBy((F.col("ideal") - F.col("base")).desc(), F.col("rank")))
    return with_offsets(s.withColumn("turn", turn).select("rank", (F.col("base") + F.when(F.col("turn") <= F.col("rest"), 1).otherwise(0)).cast("bigint").alias("cnt")))


def split_plan(spark: SparkSession, n: int, ranks: int, strategy: str | None = None, speeds: list[float] | None = None) -> DataFrame:
    """equal or adaptive; None: adaptive for more than 4 workers."""
    if strategy not in (None, "equal", "adaptive"):
        raise ValueError(f"unknown strategy: {strategy}")
    if strategy == "equal" or strategy is None and ranks <= 4:
        return equal_split(spark, n, ranks)
    speeds = speeds or [1.0] * ranks
    return weighted_split(spark.createDataFrame([(i, float(v)) for i, v in enumerate(speeds)], "rank int, speed double"), n)


def calibrate_speed(vectors: int = 512, codes: int = 64, length: int = 16, rounds: int = 2) -> float:
    """Distance comparisons a second on this machine: a measurement, different each time, for weighted_split."""
    from .train import assign

    rng = np.random.default_rng(1)
    x, w = (rng.integers(0, 256, (n, length)).astype(np.float32) for n in (vectors, codes))
    began = time.perf_counter()
    for _ in range(rounds):
        assign(x, w)
    return rounds * vectors * codes / max(1e-9, time.perf_counter() - began)
