"""Nearest codewords, and one step of Lloyd's iteration, as joins and aggregates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockloom.functions.pixels import squared_distance

from .blocks import PLANE
from .train import assign as nearest_codes
from .train import by_plane

#: The most rows of codebooks that go to every task (13 MB of codes of 16 values).
BOOKS = 100_000


def distances(vectors: DataFrame, codebook: DataFrame, length: int = 16) -> DataFrame:
    """Every vector against every code of its plane (at most 256): an equi-join on the plane."""
    both = vectors.join(F.broadcast(codebook) if bounded(codebook) else codebook, PLANE)
    return both.select(*PLANE, "vec_idx", "code", squared_distance(F.col("v").cast("array<double>"), F.col("w").cast("array<double>"), length).alias("dist"))


def bounded(codebook: DataFrame, rows: int = BOOKS) -> bool:
    """Whether a codebook is small enough to broadcast; it grows with the number of planes."""
    return codebook.limit(rows + 1).count() <= rows


def nearest(vectors: DataFrame, codebook: DataFrame, length: int = 16) -> DataFrame:
    """(…, vec_idx, v, label, dist): ties go to the lowest code; vectors of planes without a codebook are left out.

    Codebooks of at most BOOKS rows in all go to every task, which compares its vectors with them in blocks. More are joined by plane: a
    plane's codes come as one array, so each vector meets them in its own row, without a row a pair or an aggregate.
    """
    book = codebook.select(*PLANE, "code", F.col("w").cast("array<double>").alias("w"))
    table = book.limit(BOOKS + 1).toArrow()
    if table.num_rows > BOOKS:
        return nearest_joined(vectors, book, length)
    books: dict[tuple, list] = {}
    for image, channel, code, w in zip(*(c.to_pylist() for c in table.columns), strict=True):
        books.setdefault((image, channel), []).append((code, w))
    number = {plane: i for i, plane in enumerate(books)}
    words = [(np.array([c for c, _ in sorted(b)], np.int32), np.array([w for _, w in sorted(b)])) for b in books.values()]
    sent = vectors.sparkSession.sparkContext.broadcast((number, words))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, words = sent.value
        for whole in batches:
            for k, batch in by_plane(whole, number):
                codes, w = words[k]
                x = batch.column(3).flatten().to_numpy().reshape(batch.num_rows, -1).astype(np.float64)
                label, best = nearest_codes(x, w)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(codes[label]), pa.array(best)], names=[*batch.schema.names, "label", "dist"])

    kind = vectors.schema["v"].dataType.simpleString()
    return vectors.select(*PLANE, "vec_idx", "v").mapInArrow(run, f"image_id string, channel string, vec_idx int, v {kind}, label int, dist double")


def nearest_joined(vectors: DataFrame, codebook: DataFrame, length: int = 16) -> DataFrame:
    words = codebook.groupBy(*PLANE).agg(F.array_sort(F.collect_list(F.struct("code", "w"))).alias("words"))
    both = vectors.join(words, PLANE).withColumn("d", F.col("v").cast("array<double>"))
    best = F.array_min(F.transform("words", lambda c: F.struct(squared_distance(F.col("d"), c["w"], length).alias("dist"), c["code"].alias("code"))))
    return both.withColumn("best", best).select(*PLANE, "vec_idx", "v", F.col("best.code").alias("label"), F.col("best.dist").alias("dist"))


def seed_codeword(vectors: DataFrame, length: int = 16) -> DataFrame:
    """The mean vector of each plane, as code 0."""
    means = F.array(*(F.avg(F.col("v")[i].cast("double")) for i in range(length)))
    return vectors.groupBy(*PLANE).agg(means.alias("w")).select(*PLANE, F.lit(0).alias("code"), "w")


def split_codebook(codebook: DataFrame, delta: float = 0.01) -> DataFrame:
    """k codes to 2 k: w * (1 + delta) stays at its code, w * (1 - delta) goes to code + k."""
    k = codebook.groupBy(*PLANE).agg(F.count("*").cast("int").alias("k"))
    both = codebook.join(k, PLANE)
    grown = lambda s: F.transform("w", lambda e: e * F.lit(s))
    up = both.select(*PLANE, "code", grown(1.0 + delta).alias("w"))
    return up.unionByName(both.select(*PLANE, (F.col("code") + F.col("k")).alias("code"), grown(1.0 - delta).alias("w")))


def cell_sums(labelled: DataFrame, length: int = 16) -> DataFrame:
    """Counts, vector sums and distortion of each cell in one aggregate, summed on the map side first."""
    sums = F.array(*(F.sum(F.col("v")[i].cast("double")) for i in range(length)))
    return labelled.groupBy(*PLANE, "label").agg(F.count("*").alias("cnt"), sums.alias("sums"), F.sum("dist").alias("dist"))


def update_codebook(codebook: DataFrame, cells: DataFrame) -> DataFrame:
    """Means of the cells, sum * (1 / count); a code without vectors stays as it is."""
    c = cells.select(*PLANE, F.col("label").alias("code"), F.transform("sums", lambda s: s * (F.lit(1.0) / F.col("cnt"))).alias("mean"))
    return codebook.join(c, [*PLANE, "code"], "left").select(*PLANE, "code", F.coalesce("mean", F.col("w").cast("array<double>")).alias("w"))


def distortion(cells: DataFrame) -> DataFrame:
    """Mean distortion of each plane."""
    return cells.groupBy(*PLANE).agg((F.sum("dist") / F.sum("cnt")).alias("distortion"), F.sum("cnt").alias("n"))
