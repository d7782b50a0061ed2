"""Places and running sums in a whole order, without a task that holds all of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from blockloom.plans.tables import fits, written

#: Blocks of a plane that one task puts in order; longer planes are cut into runs of so many.
RUN = 1 << 18
#: The most runs whose totals are broadcast; those of more are joined.
BROADCAST_RUNS = 500_000


def placed(rows: DataFrame, *order: Column) -> DataFrame:
    """Adds place: how many rows come before in the order. Rows that tie in it stand in any order."""
    key = F.monotonically_increasing_id()
    sorted_ = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", key)
    sorted_ = written(sorted_)
    # The identifier is the partition's number times 2**33 and the place in it; one row a partition comes to the driver.
    before, starts = 0, []
    for r in sorted_.groupBy(F.shiftright("place", 33).alias("p")).agg(F.count("*").alias("n")).orderBy("p").collect():
        starts.append((r["p"], before))
        before += r["n"]
    starts = rows.sparkSession.createDataFrame(starts, "p long, before long")
    inside = F.col("place").bitwiseAND(F.lit((1 << 33) - 1))
    return sorted_.join(F.broadcast(starts), F.shiftright("place", 33) == F.col("p")).withColumn("place", inside + F.col("before")).drop("p", "before")


def long_planes(rows: DataFrame) -> bool:
    """Whether some plane has more blocks than a run; blocks count from 0."""
    return not rows.where(F.col("vec_idx") >= RUN).limit(1).isEmpty()


def running(rows: DataFrame, keys: list[str], value: Column, into: str) -> DataFrame:
    """Adds the sum of `value` over a plane's blocks up to and with each one, in the order of vec_idx.

    Where planes are longer than a run, sums are taken inside runs, and the totals of the runs before are added.
    """
    if not long_planes(rows):
        upto = Window.partitionBy(*keys).orderBy("vec_idx").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return rows.withColumn(into, F.sum(value).over(upto))
    cut = rows.withColumn("__run", F.floor(F.col("vec_idx") / RUN).cast("int")).withColumn(into, value.cast("bigint"))
    totals = cut.groupBy(*keys, "__run").agg(F.sum(into).alias("__total"))
    earlier = Window.partitionBy(*keys).orderBy("__run").rowsBetween(Window.unboundedPreceding, -1)
    totals = written(totals.select(*keys, "__run", F.coalesce(F.sum("__total").over(earlier), F.lit(0)).alias("__before")))
    totals = F.broadcast(totals) if fits(totals, BROADCAST_RUNS) else totals
    inside = Window.partitionBy(*keys, "__run").orderBy("vec_idx").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = cut.join(totals, [*keys, "__run"]).withColumn(into, F.sum(into).over(inside) + F.col("__before"))
    return summed.drop("__run", "__before")


def previous(rows: DataFrame, keys: list[str], column: str, into: str) -> DataFrame:
    """Adds the column's value in the block before, null at a plane's first; blocks count from 0 without gaps.

    Where planes are longer than a run, the last block of each run also stands in front of the next one.
    """
    if not long_planes(rows):
        return rows.withColumn(into, F.lag(column).over(Window.partitionBy(*keys).orderBy("vec_idx")))
    run = F.floor(F.col("vec_idx") / RUN).cast("int")
    both = F.when(F.col("vec_idx") % RUN == RUN - 1, F.array(run, run + 1)).otherwise(F.array(run))
    cut = rows.withColumn("__run", F.explode(both))
    cut = cut.withColumn(into, F.lag(column).over(Window.partitionBy(*keys, "__run").orderBy("vec_idx")))
    return cut.where(run == F.col("__run")).drop("__run")
