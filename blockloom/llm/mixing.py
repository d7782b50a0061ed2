"""Mixing sources to target weights by Pareto order sampling.

Each source has a target number of words. Its ratio to the source's size, at most `most`, splits
into whole copies, which every document gets for certain, and a rest. The rest is a sample of fixed
size (in words) with unequal probabilities: documents stand in the order of random odds u / (1 - u)
divided by inclusion odds, which are in proportion to their sizes, and the first are taken until
the rest is reached. So a document of `size` words is in the sample with probability
c * size / (1 + c * size), with the one c of its source at which the sample has the words it should: long texts are likelier. DataFrame functions only.

No task sees a source as a whole. Orders are cut into bands of equal ratio of the rank value; whatever the sizes, a band
holds less than ln(2) / (4 * BANDS) of a source's documents, expected. The words of each source
and band are summed with map-side combining; sums of blocks of BANDS bands show the block in which a
source's sample ends, and the bands of that block the band. So a task puts at most BANDS rows of a source
in order, or its blocks: a doubling of the rank value each, some 130 at most. Only documents of the last bands are sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from blockloom.operators.order import placed

from .common import documents, fits, tidy, written

#: Bands of the order for each doubling of the rank value.
BANDS = 1024
#: The most sources whose plan is broadcast; that of more is joined.
BROADCAST_SOURCES = 100_000
#: The most sources that one task puts in order; targets of more come from sums over all of them, again and again.
SORTED_SOURCES = 200_000
WORD = r"[^\x20\x09-\x0D]+"


def uniform(seed: int, *columns: Column) -> Column:
    """A number above 0 and below 1 from a hash of the columns, the same in every run."""
    text = F.concat_ws("|", F.lit(str(seed)), *(F.coalesce(c.cast("string"), F.lit("null")) for c in columns))
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(1 << 52))


def weight_of(n: Column, weights: tuple[float, ...]) -> Column:
    """The weight of the n-th source, from 0."""
    return F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (n % len(weights) + 1).cast("int"))


def targets(sizes: DataFrame, most: float, weights: tuple[float, ...]) -> DataFrame:
    """(source, source_size) -> also weight and target.

    Targets are least(most * source_size, t * weight) with the one t at which they add up to all
    sizes; that is where resharing the excess by weight ends. Sources reach their limits in the order of
    limit / weight, so t follows from running sums in that order: one row a source, in one task, if they are at most SORTED_SOURCES.
    """
    sizes = written(sizes)
    if not fits(sizes, SORTED_SOURCES):
        return targets_of_many(sizes, most, weights)
    order = Window.orderBy(F.col("source").asc_nulls_last())
    s = sizes.withColumn("weight", weight_of(F.row_number().over(order) - 1, weights)).withColumn("most", F.lit(float(most)) * F.col("source_size"))
    full = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    before, rest = full.rowsBetween(Window.unboundedPreceding, -1), full.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy(F.lit(0))
    s = s.withColumn("total", F.sum("source_size").over(everything).cast("double"))
    s = s.withColumn("level", (F.col("total") - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("weight").over(rest))
    # With any number of first sources at their limits, the others' level is t at most; at the right number it is t.
    s = s.withColumn("t", F.max("level").over(everything))
    return s.select("source", "source_size", "weight", F.least(F.col("most"), F.col("t") * F.col("weight")).alias("target"))


def targets_of_many(sizes: DataFrame, most: float, weights: tuple[float, ...]) -> DataFrame:
    """The same targets by resharing: t rises until no further source is at its limit; each step is one sum over all sources."""
    s = placed(sizes, F.col("source").asc_nulls_last()).withColumn("weight", weight_of(F.col("place"), weights)).withColumn("most", F.lit(float(most)) * F.col("source_size"))
    s = written(s.drop("place"))
    total, t, at_limit = float(s.agg(F.sum("source_size")).head()[0] or 0), 0.0, -1
    while True:
        full = F.col("most") <= F.lit(t) * F.col("weight")
        n, filled, open_ = s.agg(F.count_if(full), F.sum(F.when(full, F.col("most"))), F.sum(F.when(~full, F.col("weight")))).head()
        if n == at_limit or not open_:
            break
        at_limit, t = n, (total - (filled or 0.0)) / open_
    return s.select("source", "source_size", "weight", F.least(F.col("most"), F.lit(t) * F.col("weight")).alias("target"))


def ending(parts: DataFrame, part: str) -> DataFrame:
    """(s, part, words, rest, start) -> the part of each s, in their order, in which its rest ends; `before` has the words before that, from `start` on."""
    run = Window.partitionBy("s").orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("before", F.col("start") + F.coalesce(F.sum("words").over(run), F.lit(0)))
    return parts.where((F.col("before") <= F.col("rest")) & (F.col("rest") < F.col("before") + F.col("words")))


@tidy
def mix_sources(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", most: float = 3.0, weights: tuple[float, ...] = (1.0, 2.0, 3.0), seed: int = 9, keep_text: bool = False) -> DataFrame:
    """Choose how often each document goes into a mix in which sources have the targets of `targets`.

    Returns id, size (words), source_size, target, taken (words, repeats counted), copies, and with
    keep_text the input's columns instead of size and taken. A null text has size 0; a null source is a source of its own, the last; documents of
    size 0 get the whole copies of their source and never the rest. Rows that share an id have the same draw; of those that share the size, too,
    the hash of the whole row tells which comes first with keep_text, and without it they give equal rows but for `taken` and `copies`. So reruns agree.
    An empty table gives none. Ids may be null and of any type that has a text form. Other columns are
    not looked at. A source's taken words differ from its target by half of one document at most.
    """
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    kept = [F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")] if keep_text else []
    d = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), size.alias("size"), *kept)
    u = uniform(seed, F.col("id"))
    d = d.withColumn("q", F.when(F.col("size") > 0, (u / (1 - u)) / F.col("size")))
    # The logarithm of random odds has a density below 1/4, and sizes only shift it.
    d = d.withColumn("band", F.floor(F.lit(float(BANDS)) * F.log2("q")).cast("int"))
    slim = written(d.select("id", "source", "size", "q", "band"))
    d = d if keep_text else slim
    bands = written(slim.groupBy("source", "band").agg(F.sum("size").alias("words")).withColumn("block", F.floor(F.col("band") / BANDS)))
    plan = targets(bands.groupBy("source").agg(F.sum("words").alias("source_size")), most, weights)
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    plan = plan.withColumn("whole", F.floor(ratio)).withColumn("rest", F.col("target") - F.floor(ratio) * F.col("source_size"))
    blocks = bands.where("band is not null").groupBy("source", "block").agg(F.sum("words").alias("words"))
    blocks = blocks.join(plan.select(F.col("source").alias("s"), "rest"), F.col("source").eqNullSafe(F.col("s"))).withColumn("start", F.lit(0).cast("long"))
    last = ending(blocks, "block").select("s", "rest", F.col("block").alias("end_block"), F.col("before").alias("start"))
    ends = ending(bands.join(last, F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("end_block"))), "band")
    ends = ends.select("s", F.col("band").alias("end_band"), "before")
    plan = plan.join(ends, F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
    plan = written(plan.select(F.col("source").alias("s"), "source_size", "target", "whole", "rest", "end_band", "before"))
    plan = F.broadcast(plan) if fits(plan, BROADCAST_SOURCES) else plan
    d = d.join(plan, F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
    inside = F.when(F.col("band") < F.col("end_band"), 1).when(F.col("band") > F.col("end_band"), 0)
    # A target of all words has no band in which it ends.
    d = d.withColumn("sure", F.when(F.col("band").isNull() | (F.col("rest") <= 0), 0).when(F.col("end_band").isNull(), 1).otherwise(inside))
    edge = d.where("sure is null")
    # Rows that tie in all else are told apart by what they hold.
    tie = [F.xxhash64(F.to_json("row"))] if keep_text else []
    ranked = Window.partitionBy("source", "band").orderBy("q", "id", *tie).rowsBetween(Window.unboundedPreceding, -1)
    middle = F.col("before") + F.coalesce(F.sum("size").over(ranked), F.lit(0)) + F.col("size") / 2
    both = d.where("sure is not null").unionByName(edge.withColumn("sure", F.when(middle <= F.col("rest"), 1).otherwise(0)))
    copies = (F.col("whole") + F.col("sure")).cast("long")
    out = [F.col("id").alias(id_col), "size", "source_size", "target", (copies * F.col("size")).alias("taken"), copies.alias("copies")]
    return both.select("row", copies.alias("copies")) if keep_text else both.select(*out)


def op9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(documents(spark, sf_dir)).drop("copies")


#: The same mix in one piece: cumulative sums over each source's whole order.
OP9_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         (('0x' || substr(md5('9|' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u
  FROM documents),
s AS (SELECT source, sum(size)::DOUBLE AS source_size FROM d GROUP BY source),
w AS (SELECT *, ((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::DOUBLE AS weight, 3.0 * source_size AS most FROM s),
l AS (SELECT *, row_number() OVER (ORDER BY most / weight, source ASC NULLS LAST) AS n, (sum(source_size) OVER () - coalesce(sum(most) OVER (ORDER BY most / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
              / sum(weight) OVER (ORDER BY most / weight, source ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
t AS (SELECT level AS t FROM l WHERE level * weight <= most ORDER BY n LIMIT 1),
p AS (SELECT source, source_size, least(most, t * weight) AS target FROM l, t),
r AS (SELECT source, source_size, target, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole FROM p),
q AS (SELECT d.doc_id, d.size, r.*, r.target - r.whole * r.source_size AS rest, (u / (1 - u)) / nullif(d.size, 0) AS q
      FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source),
m AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY q NULLS LAST, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + size / 2.0 AS middle FROM q)
SELECT doc_id, size, source_size::BIGINT AS source_size, target,
       (size * (whole + CASE WHEN size > 0 AND rest > 0 AND middle <= rest THEN 1 ELSE 0 END))::BIGINT AS taken
FROM m
"""
