"""Embedding near-dedup by sorted projection passes.

Vectors of one label and length are a group. In each pass, random hyperplanes through a group's centre turn a vector into a
string of bits; vectors stand in the order of these strings, and each is compared with its next NEIGHBOURS in that order.
Verified pairs of all passes are united. A window is a cap, so what the passes leave apart is compared then, in blocks: no link is
missed in a group of any size. At last links are counted exactly inside each component, in blocks, too.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import fits, tidy, written
from .components import components

THRESHOLD, NEIGHBOURS = 0.93, 32
#: Chance that a pair at the threshold stands within a window in no pass, if vectors spread evenly; it sets the number of passes, and so what they leave to the exact comparison.
MISS = 0.005
#: Rows of a block of the sorted order, and of a block of a component.
BLOCK, PART = 2048, 1024
#: Rows of a block of a group in the exact comparison, at least; values of one, at most, where more rows than those spare a large group copies of its rows.
WHOLE, BLOCK_VALUES = 4096, 1 << 21
#: Rows of a block that meet the other block at a time, at most (BLOCK_VALUES pairs), and pairs that are verified at a time.
CHUNK, VERIFIED = 512, 20_000
BITS, SEED = 64, 93
#: The most values of all groups' centres that are broadcast; more are joined.
CENTRE_VALUES = 1 << 21
#: The most large components whose sizes are broadcast; those of more are joined.
BROADCAST_ROOTS = 500_000


def passes_for(rows: int, threshold: float = THRESHOLD, neighbours: int = NEIGHBOURS, miss: float = MISS) -> int:
    """Passes after which a pair at the threshold among `rows` vectors has missed all windows with chance `miss`.

    Vectors at cosine c agree on a bit with chance 1 - acos(c) / pi and meet if they agree on
    the first log2(rows / neighbours) bits.
    """
    meet = (1 - math.acos(threshold) / math.pi) ** max(0.0, math.log2(max(1, rows) / neighbours))
    return max(4, math.ceil(math.log(miss) / math.log(max(1e-12, 1 - meet)))) if meet < 1 else 4


def sort_keys(x: np.ndarray, number: int) -> np.ndarray:
    """The bit string of each vector, from its group's centre, in pass `number`, as an unsigned integer: the first bit weighs most."""
    planes = np.random.default_rng([SEED, number, x.shape[1]]).standard_normal((x.shape[1], BITS))
    return np.packbits(x @ planes > 0, axis=1).view(">u8").ravel().astype(np.uint64)


def units(column: pa.Array) -> np.ndarray:
    """Rows of equal length, as unit vectors in double precision."""
    x = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.float64)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def by_length(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    lengths = np.array([len(v) for v in batch.column(column)])
    for n in np.unique(lengths):
        yield batch.filter(pa.array(lengths == n))


def ranked(keys: DataFrame, order: list[str]) -> DataFrame:
    """Adds rank, the place in the whole order (which must be strict), from places in sorted ranges."""
    schema = keys.schema

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(n, part, np.int32)), pa.array(np.arange(at, at + n))], names=[*batch.schema.names, "part", "place"])
            at += n

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    rows = written(keys.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(place, types + ", part int, place long"))
    # One row a partition comes to the driver.
    before, offsets = 0, []
    for r in rows.groupBy("part").agg(F.count("*").alias("n")).orderBy("part").collect():
        offsets.append((r["part"], before))
        before += r["n"]
    starts = keys.sparkSession.createDataFrame(offsets, "p int, before long")
    return rows.join(F.broadcast(starts), F.col("part") == F.col("p")).withColumn("rank", F.col("place") + F.col("before")).drop("part", "place", "p", "before")


def rest_links(apart: DataFrame, groups: DataFrame, threshold: float) -> DataFrame:
    """(c, root, label, v) -> (a, b): links of all pairs of a label and length whose roots differ, of each two blocks a spanning forest of their roots.

    Every pair is compared: in single precision, with room for its rounding, and in double precision where that comes near.
    """
    rows = F.greatest(F.lit(WHOLE), F.least(F.sqrt(F.col("n") * WHOLE), F.lit(BLOCK_VALUES) / F.col("s")))
    sizes = written(groups.select("l", "s", F.ceil(F.col("n") / rows).cast("int").alias("parts")).where("parts > 1"))
    sizes = F.broadcast(sizes) if fits(sizes, BROADCAST_ROOTS) else sizes
    m = apart.select("c", "root", "label", F.size("v").alias("size"), "v").join(sizes, (F.col("label") == F.col("l")) & (F.col("size") == F.col("s")), "left")
    m = m.withColumn("parts", F.coalesce("parts", F.lit(1))).withColumn("part", F.pmod(F.xxhash64("c"), F.col("parts")).cast("int"))
    m = m.select("c", "root", "label", "size", "v", "part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    m = m.select("c", "root", "label", "size", "v", "part", F.least("part", "other").alias("x"), F.greatest("part", "other").alias("y"))

    def link(table: pa.Table) -> pa.Table:
        part, c, root = (table[k].to_numpy() for k in ("part", "c", "root"))
        root, x = root.copy(), units(table["v"].combine_chunks())
        short, near = x.astype(np.float32), threshold - 1.2e-7 * (x.shape[1] + 4)
        same = table["x"][0] == table["y"][0]
        left, right = np.flatnonzero(part == table["x"][0].as_py()), np.flatnonzero(part == table["y"][0].as_py())
        found, step = [], max(1, min(CHUNK, BLOCK_VALUES // max(1, len(right))))
        for i in range(0, len(left), step):
            rows, others = left[i : i + step], right[i:] if same else right
            a, b = np.nonzero((short[rows] @ short[others].T >= near) & (root[rows][:, None] != root[others]))
            a, b = rows[a], others[b]
            while len(a):
                # What is united by now needs no other link.
                open_ = root[a] != root[b]
                a, b = a[open_], b[open_]
                p, q = a[:VERIFIED], b[:VERIFIED]
                close = (x[p] * x[q]).sum(axis=1) >= threshold
                for j, k in zip(p[close].tolist(), q[close].tolist(), strict=True):
                    if root[j] != root[k]:
                        root[root == root[k]] = root[j]
                        found.append((c[j], c[k]))
                a, b = a[VERIFIED:], b[VERIFIED:]
        pairs = np.array(found, np.int64).reshape(-1, 2)
        return pa.table({"a": pairs[:, 0], "b": pairs[:, 1]})

    return m.groupBy("label", "size", "x", "y").applyInArrow(link, "a long, b long")


def centres(classes: DataFrame) -> DataFrame:
    """(l, s, n, mean): rows and mean unit vector of each label and length."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in by_length(whole, 1):
                x, label = units(batch.column(1)), batch.column(0).to_numpy()
                order = np.argsort(label, kind="stable")
                each, first, n = np.unique(label[order], return_index=True, return_counts=True)
                total = np.add.reduceat(x[order], first, axis=0)
                size = x.shape[1]
                at = np.tile(np.arange(size, dtype=np.int32), len(each))
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(each, size)), pa.array(np.full(len(at), size, np.int32)), pa.array(at), pa.array(total.ravel()), pa.array(np.repeat(n, size))], names=["l", "s", "at", "total", "n"])

    got = classes.select("label", "v").mapInArrow(sums, "l int, s int, at int, total double, n long")
    got = got.groupBy("l", "s", "at").agg(F.sum("n").alias("n"), (F.sum("total") / F.sum("n")).alias("mean"))
    return got.groupBy("l", "s").agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("at", "mean"))), lambda x: x["mean"]).alias("mean"))


def neighbour_links(classes: DataFrame, groups: DataFrame, threshold: float, neighbours: int, miss: float) -> DataFrame:
    """(a, b): pairs within a window of some pass of their label and length and at the threshold or above; of each block a spanning forest of them."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in by_length(whole, 2):
                c, label, size = batch.column(0).to_numpy(), batch.column(1).to_numpy(), len(batch.column(2)[0])
                x = units(batch.column(2)) - batch.column(4).flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
                each, at = np.unique(batch.column(3).to_numpy(), return_inverse=True)
                many = np.array([passes_for(int(n), threshold, neighbours, miss) for n in each])[at]
                for k in range(int(many.max())):
                    of = many > k
                    # Signed order of the flipped integer is unsigned order of the bits.
                    key = (sort_keys(x[of], k) ^ np.uint64(1 << 63)).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), k, np.int32)), pa.array(label[of]), pa.array(np.full(len(key), size, np.int32)), pa.array(key), pa.array(c[of])], names=["pass", "label", "size", "key", "c"])

    values = groups.agg(F.sum("s")).head()[0] or 0
    of_group = (F.broadcast(groups) if values <= CENTRE_VALUES else groups).select("l", "s", "n", "mean")
    known = classes.join(of_group, (F.col("label") == F.col("l")) & (F.size("v") == F.col("s"))).select("c", "label", "v", "n", "mean")
    keys = known.mapInArrow(hashed, "pass int, label int, size int, key long, c long")
    at = ranked(keys, ["pass", "label", "size", "key", "c"])
    block = F.floor(F.col("rank") / BLOCK).cast("long")
    # A block also gets the first rows of the next, to which its last rows are compared.
    both = F.when((F.col("rank") % BLOCK < neighbours) & (F.col("rank") >= BLOCK), F.array(block, block - 1)).otherwise(F.array(block))
    at = at.select("pass", "label", "size", "rank", "c", F.explode(both).alias("block"))
    rows = at.join(classes.select(F.col("c").alias("c2"), "v"), F.col("c") == F.col("c2")).select("block", "rank", "pass", "label", "size", "c", "v")

    def compare(table: pa.Table) -> pa.Table:
        table = table.sort_by("rank")
        rank, c = table["rank"].to_numpy(), table["c"].to_numpy()
        group = np.stack([table[k].to_numpy() for k in ("pass", "label", "size")])
        edges = np.flatnonzero((group[:, 1:] != group[:, :-1]).any(axis=0)) + 1
        found = []
        for a, b in zip([0, *edges], [*edges, len(c)], strict=True):
            x = units(table["v"].slice(a, b - a).combine_chunks())
            parent = np.arange(b - a)

            def root(i: int, parent: np.ndarray = parent) -> int:
                while parent[i] != i:
                    parent[i] = parent[parent[i]]
                    i = parent[i]
                return i

            for step in range(1, min(neighbours, b - a - 1) + 1):
                for i in np.flatnonzero((x[:-step] * x[step:]).sum(axis=1) >= threshold):
                    p, q = root(i), root(i + step)
                    if p != q:
                        parent[max(p, q)] = min(p, q)
                        found.append((c[a + i], c[a + i + step]))
        pairs = np.array(found, np.int64).reshape(-1, 2)
        return pa.table({"a": pairs[:, 0], "b": pairs[:, 1]})

    return rows.groupBy("block").applyInArrow(compare, "a long, b long")


def all_links(classes: DataFrame, threshold: float, neighbours: int, miss: float) -> DataFrame:
    """(a, b): links that unite what any link unites: those of the passes and, where these leave two vectors apart, of comparing them. Groups of every size go the same way."""
    groups = written(centres(classes))
    passed = written(neighbour_links(classes, groups, threshold, neighbours, miss))
    apart = classes.join(components(passed), F.col("c") == F.col("node"), "left").select("c", F.coalesce("root", "c").alias("root"), "label", "v")
    return passed.unionByName(written(rest_links(apart, groups, threshold)))


def links_inside(members: DataFrame, threshold: float) -> DataFrame:
    """(c, root, label, v, weight) -> (c, links): the weights of the other classes of c's component at the threshold or above.

    Components are cut into parts of about PART rows; every pair of parts is one bounded group.
    """
    sizes = members.groupBy("root").agg(F.count("*").alias("n")).select(F.col("root").alias("r"), F.ceil(F.col("n") / PART).cast("int").alias("parts"))
    # Only those of several parts need to be told: few, so that members of a large one don't meet in a task for it.
    sizes = written(sizes.where("parts > 1"))
    sizes = F.broadcast(sizes) if fits(sizes, BROADCAST_ROOTS) else sizes
    m = members.join(sizes, F.col("root") == F.col("r"), "left").drop("r").withColumn("parts", F.coalesce("parts", F.lit(1)))
    m = m.withColumn("part", F.pmod(F.xxhash64("c"), F.col("parts")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    m = m.select("c", "root", "v", "weight", "part", other.alias("other"))
    m = m.select("c", "root", "v", "weight", "part", F.least("part", "other").alias("x"), F.greatest("part", "other").alias("y"))

    def count(table: pa.Table) -> pa.Table:
        part, weight, c = (table[k].to_numpy() for k in ("part", "weight", "c"))
        v = table["v"].combine_chunks()
        x = units(v)
        first, last = part == table["x"][0].as_py(), part == table["y"][0].as_py()
        close = x[first] @ x[last].T >= threshold
        if table["x"][0] == table["y"][0]:
            np.fill_diagonal(close, False)
            return pa.table({"c": c, "links": close @ weight})
        return pa.table({"c": np.concatenate([c[first], c[last]]), "links": np.concatenate([close @ weight[last], close.T @ weight[first]])})

    return m.groupBy("root", "x", "y").applyInArrow(count, "c long, links long").groupBy("c").agg(F.sum("links").alias("links"))


@tidy
def dedup_embeddings(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = THRESHOLD, neighbours: int = NEIGHBOURS, miss: float = MISS) -> DataFrame:
    """Link vectors of one label whose cosine is at least the threshold; a row per input row: id,
    n_links (other vectors linked directly), component_id, kept (the id is its component's smallest).

    Vectors that are null, empty, zero or hold null or non-finite components, and rows with a
    null label or id, link with nothing: 0 links, a component of their own (null for a null id),
    kept. Vectors of different lengths don't link. A row that repeats another's id and vector is the
    same vector and gets the same values; equal vectors of different ids are handled as one class.
    No pair is missed, whatever `neighbours` and `miss` are: they set how much the passes find and how much is left to comparing
    what they leave apart, which is quadratic in the vectors of a label. Other columns are not looked at.
    """
    number = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    usable = F.col("id").isNotNull() & F.col("label").isNotNull() & F.coalesce(F.forall("v", fine) & F.exists("v", lambda x: x != 0), F.lit(False))
    d = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("label"), number.alias("v"))
    d = d.withColumn("usable", usable)
    good = d.where("usable").select("id", "label", "v").distinct()
    # A class is known by its smallest id; where several vectors share that, the others get hashes as numbers.
    classes = written(good.groupBy("label", "v").agg(F.min("id").alias("first"), F.count("*").alias("weight")).withColumn("c", F.col("first")))
    if classes.groupBy("c").agg(F.count("*").alias("n")).where("n > 1").limit(1).count():
        turn = F.row_number().over(Window.partitionBy("first").orderBy("label", "v"))
        classes = written(classes.withColumn("c", F.when(turn == 1, F.col("first")).otherwise(F.xxhash64("first", turn))))
    links = all_links(classes, threshold, neighbours, miss)
    roots = components(links)
    members = written(classes.join(roots, F.col("c") == F.col("node"), "left").select("c", "first", "label", "v", "weight", F.coalesce("root", "c").alias("root"), F.col("root").isNotNull().alias("linked")))
    counts = links_inside(members.where("linked").drop("first"), threshold)
    least = written(members.groupBy(F.col("root").alias("r")).agg(F.min("first").alias("least")))
    told = members.join(least, F.col("root") == F.col("r")).join(counts.select(F.col("c").alias("c3"), "links"), F.col("c") == F.col("c3"), "left")
    told = told.select(F.col("label").alias("label2"), F.col("v").alias("v2"), (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), "least")
    out = d.join(told, F.col("usable") & (F.col("label") == F.col("label2")) & (F.col("v") == F.col("v2")), "left")
    component = F.when(F.col("usable"), F.col("least")).otherwise(F.col("id"))
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("id").eqNullSafe(component)).alias("kept"))


def op7_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_embeddings(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
