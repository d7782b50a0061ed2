"""Connected components of links between long ids, without a task or a driver that holds a component."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tidy, written

#: A node with more than this share of all link ends is handled by broadcast; so there are at most 1 / share of them.
HOT_SHARE, HOT_LEAST = 1e-4, 500


def with_least(pairs: DataFrame, ends: int) -> DataFrame:
    """(u, v) -> (u, v, m), m the least of u and all v beside it.

    Nodes with very many neighbours would pile up in the tasks of a join; they are few, by
    the share that makes them hot, and are broadcast.
    """
    least = written(pairs.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"), "n"))
    limit = max(HOT_LEAST, int(ends * HOT_SHARE))
    hot, rest = F.broadcast(least.where(F.col("n") > limit).drop("n")), least.where(F.col("n") <= limit).drop("n")
    on = F.col("u") == F.col("w")
    return pairs.join(hot, on).select("u", "v", "m").unionByName(pairs.join(hot, on, "left_anti").join(rest, on).select("u", "v", "m"))


@tidy
def components(links: DataFrame) -> DataFrame:
    """Links (a, b) of long ids -> (node, root): for every node that has a link, the least node it can reach.

    Alternates the large-star and small-star steps: each keeps components whole, and together
    they turn any graph into stars around least nodes in a logarithmic number of rounds. Each round is
    written to the shared folder, so that lineage stays short and a lost executor costs one round.
    Nulls and links of a node to itself count for nothing; links may repeat and face either way.
    """
    e = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e, mark = written(e), None
    while True:
        n, total = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).head()
        if (n, total) == mark or n == 0:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        mark = (n, total)
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = written(with_least(both, 2 * n).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        small = with_least(large, n)
        e = written(small.select("u", F.col("m").alias("v")).unionByName(small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct())
