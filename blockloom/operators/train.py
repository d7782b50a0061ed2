"""Splitting-codebook training, in two physical forms with equal results; fit chooses by the size of each plane.

fit_grouped runs a plane's whole training in one task: a 512 x 512 plane is 1 MB. It scales over
planes. fit_distributed is for planes too large for a task: the driver holds the
codebooks alone, and each iteration of all planes is one partial aggregate on the executors.

Labels are those of the last assignment, made with the codebook before the last update, which is
the one returned; that order is part of the results.
"""

from __future__ import annotations

import time
from collections.abc import Generator, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockloom.plans.config import VQConfig
from blockloom.plans.tables import written

from .blocks import PLANE

#: Elements of the distance matrix that are held at a time.
TILE = 1 << 21
#: The most values of a plane that one task trains on (256 MB as they come), and how many larger planes are trained side by side.
GROUPED, TOGETHER = 1 << 26, 64


@dataclass
class Trained:
    codebook: DataFrame  # image_id, channel, code, w
    labels: DataFrame  # image_id, channel, vec_idx, label
    iterations: DataFrame  # image_id, channel, k, iter, distortion, improvement
    seconds: DataFrame  # image_id, channel, seconds: how long the training took, another each time


def assign(x: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(labels, distances): summed in the arrays' precision from the first dimension to the last; ties to the lowest code."""
    labels, best = np.empty(len(x), np.int32), np.empty(len(x), x.dtype)
    rows = max(1, TILE // max(1, len(w)))
    for i in range(0, len(x), rows):
        part = x[i : i + rows]
        d = np.zeros((len(part), len(w)), x.dtype)
        for j in range(x.shape[1]):
            e = part[:, j, None] - w[None, :, j]
            d += e * e
        labels[i : i + rows] = d.argmin(axis=1)
        best[i : i + rows] = d[np.arange(len(part)), labels[i : i + rows]]
    return labels, best


def cell_stats(x: np.ndarray, labels: np.ndarray, best: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, float]:
    counts = np.bincount(labels, minlength=k)
    sums = np.stack([np.bincount(labels, x[:, j], k) for j in range(x.shape[1])], axis=1)
    return counts, sums, float(best.sum(dtype=np.float64))


def updated(w: np.ndarray, counts: np.ndarray, sums: np.ndarray) -> np.ndarray:
    kind = w.dtype.type
    means = sums.astype(w.dtype) * (kind(1) / np.maximum(counts, 1).astype(w.dtype))[:, None]
    return np.where(counts[:, None] > 0, means, w).astype(w.dtype)


def grown(w: np.ndarray, delta: float) -> np.ndarray:
    kind = w.dtype.type
    return np.concatenate([w * (kind(1) + kind(delta)), w * (kind(1) - kind(delta))])


def schedule(seed: np.ndarray, n: int, config: VQConfig, log: list) -> Generator[np.ndarray, tuple, tuple[np.ndarray, np.ndarray]]:
    """All stages: yields a codebook, takes its (counts, sums, total distortion). Returns the last two codebooks: for labels, and the result."""
    w = before = seed
    while len(w) < config.codes:
        w = grown(w, config.delta)
        last = 1e30
        for i in range(1, config.max_iter + 1):
            counts, sums, total = yield w
            now = total / n
            better = abs(last - now) / (now + 1e-9)
            log.append((len(w), i, now, better))
            before, w, last = w, updated(w, counts, sums), now
            if better <= config.epsilon:
                break
    return before, w


def lbg(x: np.ndarray, config: VQConfig) -> tuple[np.ndarray, np.ndarray, list]:
    """(labels, codebook, log of iterations) of one plane's vectors. One code: every label is 0."""
    x = x.astype(config.precision)
    log: list = []
    run = schedule(x.mean(axis=0, dtype=np.float64).astype(x.dtype)[None, :], len(x), config, log)
    answer = None
    while True:
        try:
            w = run.send(answer)
        except StopIteration as end:
            before, w = end.value
            return assign(x, before)[0], w, log
        answer = cell_stats(x, *assign(x, w), len(w))


def split_result(rows: DataFrame) -> Trained:
    rows = written(rows)
    codebook = rows.where("kind = 0").select(*PLANE, F.col("a").alias("code"), "w")
    labels = rows.where("kind = 1").select(*PLANE, F.col("a").alias("vec_idx"), F.col("b").alias("label"))
    log = rows.where("kind = 2").select(*PLANE, F.col("a").alias("k"), F.col("b").alias("iter"), F.col("w")[0].alias("distortion"), F.col("w")[1].alias("improvement"))
    return Trained(codebook, labels, log, rows.where("kind = 3").select(*PLANE, F.col("w")[0].alias("seconds")))


def fit_grouped(vectors: DataFrame, config: VQConfig) -> Trained:
    """Train every plane in a task of its own; planes run beside each other."""

    def train(key: tuple, table: pa.Table) -> pa.Table:
        began = time.perf_counter()
        table = table.sort_by("vec_idx")
        x = table["v"].combine_chunks().flatten().to_numpy().reshape(table.num_rows, -1)
        labels, w, log = lbg(x, config)
        n = table["vec_idx"].to_numpy()
        kind = np.repeat([0, 1, 2, 3], [len(w), len(n), len(log), 1])
        a = np.concatenate([np.arange(len(w)), n, [r[0] for r in log], [0]]).astype(np.int32)
        b = np.concatenate([np.zeros(len(w)), labels, [r[1] for r in log], [0]]).astype(np.int32)
        values = [*w.astype(np.float64).tolist(), *[None] * len(n), *[[r[2], r[3]] for r in log], [time.perf_counter() - began]]
        planes = [pa.array([k.as_py()] * len(kind), pa.string()) for k in key]
        return pa.Table.from_arrays([*planes, pa.array(kind.astype(np.int32)), pa.array(a), pa.array(b), pa.array(values, pa.list_(pa.float64()))], names=[*PLANE, "kind", "a", "b", "w"])

    rows = vectors.select(*PLANE, "vec_idx", "v").groupBy(*PLANE).applyInArrow(train, "image_id string, channel string, kind int, a int, b int, w array<double>")
    return split_result(rows)


def by_plane(batch: pa.RecordBatch, number: dict[tuple, int]) -> Iterator[tuple[int, pa.RecordBatch]]:
    """The rows of each plane of a batch whose first columns are PLANE; planes without a number have none."""
    image, channel = (batch.column(i).dictionary_encode("encode") for i in (0, 1))
    of = image.indices.to_numpy().astype(np.int64) * max(1, len(channel.dictionary)) + channel.indices.to_numpy()
    for k in np.unique(of).tolist():
        plane = image.dictionary[k // len(channel.dictionary)].as_py(), channel.dictionary[k % len(channel.dictionary)].as_py()
        if plane in number:
            yield number[plane], batch.filter(pa.array(of == k))


def labelled(vectors: DataFrame, books: dict[tuple, np.ndarray]) -> DataFrame:
    """Labels by the codebook of each plane, e.g. in fit_distributed."""
    number, words = {k: i for i, k in enumerate(books)}, list(books.values())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k, batch in by_plane(whole, number):
                x = batch.column(3).flatten().to_numpy().reshape(batch.num_rows, -1).astype(words[k].dtype)
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(assign(x, words[k])[0])], names=[*PLANE, "vec_idx", "label"])

    return vectors.select(*PLANE, "vec_idx", "v").mapInArrow(run, "image_id string, channel string, vec_idx int, label int")


def fit_distributed(vectors: DataFrame, config: VQConfig) -> Trained:
    """Train a codebook for each plane, however large: a job an iteration, which all planes share.

    Each task sends a row for each code it saw; the driver gets at most `codes` rows a plane, so planes should be few. The input is
    written once, so that iterations read it and lineage stays constant.
    """
    began = time.perf_counter()
    v = written(vectors.select(*PLANE, "vec_idx", "v"))
    spark = v.sparkSession
    first = v.limit(1).collect()
    if not first:
        raise ValueError("no vectors to train on")
    length = len(first[0]["v"])
    means = v.groupBy(*PLANE).agg(F.count("*"), *(F.avg(F.col("v")[i].cast("double")) for i in range(length))).collect()
    logs: dict[tuple, list] = {tuple(r[:2]): [] for r in means}
    number = {k: i for i, k in enumerate(logs)}

    def step(books: dict[int, np.ndarray]) -> dict[int, tuple[np.ndarray, np.ndarray, float]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen = {k: (np.zeros(len(w), np.int64), np.zeros((len(w), length)), np.zeros(len(w))) for k, w in books.items()}
            for whole in batches:
                for k, batch in by_plane(whole, number):
                    if k in books:
                        w, (counts, sums, dist) = books[k], seen[k]
                        x = batch.column(2).flatten().to_numpy().reshape(batch.num_rows, -1).astype(w.dtype)
                        labels, best = assign(x, w)
                        c, s, _ = cell_stats(x, labels, best, len(w))
                        seen[k] = counts + c, sums + s, dist + np.bincount(labels, best, len(w))
            for k, (counts, sums, dist) in seen.items():
                c = np.flatnonzero(counts)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(c), k, np.int32)), pa.array(c.astype(np.int32)), pa.array(counts[c]), pa.array(list(sums[c]), pa.list_(pa.float64())), pa.array(dist[c])], names=["plane", "code", "n", "s", "d"])

        parts = v.select(*PLANE, "v").mapInArrow(run, "plane int, code int, n long, s array<double>, d double")
        out = {k: [np.zeros(len(w), np.int64), np.zeros((len(w), length)), 0.0] for k, w in books.items()}
        for r in parts.groupBy("plane", "code").agg(F.sum("n"), F.sum("d"), *(F.sum(F.col("s")[i]) for i in range(length))).collect():
            cells = out[r[0]]
            cells[0][r[1]], cells[1][r[1]] = r[2], r[4:]
            cells[2] += r[3]
        return {k: tuple(cells) for k, cells in out.items()}

    runs = {number[tuple(r[:2])]: schedule(np.array([r[3:]], config.precision), r[2], config, logs[tuple(r[:2])]) for r in means}
    answers: dict[int, tuple | None] = dict.fromkeys(runs)
    done: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    while len(done) < len(runs):
        asked = {}
        for k, answer in answers.items():
            try:
                asked[k] = runs[k].send(answer)
            except StopIteration as end:
                done[k] = end.value
        answers = step(asked) if asked else {}
    rows = [(*plane, i, [float(e) for e in w]) for plane, k in number.items() for i, w in enumerate(done[k][1])]
    codebook = spark.createDataFrame(rows, "image_id string, channel string, code int, w array<double>")
    iterations = spark.createDataFrame([(*plane, *r) for plane, log in logs.items() for r in log], "image_id string, channel string, k int, iter int, distortion double, improvement double")
    seconds = spark.createDataFrame([(*plane, (time.perf_counter() - began) / len(logs)) for plane in logs], "image_id string, channel string, seconds double")
    return Trained(codebook, labelled(v, {plane: done[k][0] for plane, k in number.items()}), iterations, seconds)


def fit(vectors: DataFrame, config: VQConfig) -> Trained:
    """Train every plane: in a task of its own where it has at most GROUPED values, else on all executors."""
    values = F.sum(F.size("v").cast("bigint"))
    large = [tuple(r[:2]) for r in vectors.groupBy(*PLANE).agg(values.alias("values")).where(F.col("values") > GROUPED).orderBy(*PLANE).collect()]
    if not large:
        return fit_grouped(vectors, config)
    own = lambda planes: F.struct(*(F.coalesce(c, F.lit("")) for c in PLANE)).isin([F.struct(*(F.lit(x or "") for x in p)) for p in planes])
    parts = [fit_distributed(vectors.where(own(large[i : i + TOGETHER])), config) for i in range(0, len(large), TOGETHER)]
    rest = vectors.where(~own(large))
    if not rest.limit(1).isEmpty():
        parts.append(fit_grouped(rest, config))
    return Trained(*(reduce(DataFrame.unionByName, (getattr(p, f) for p in parts)) for f in ("codebook", "labels", "iterations", "seconds")))
