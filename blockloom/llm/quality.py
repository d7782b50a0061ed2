"""Quality classifier: histogram gradient-boosted trees over document statistics.

Trees are complete, so that each is a row of flat arrays (feature, threshold, leaf value) and a batch of
documents goes down all trees at once by index arithmetic.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_bytes, documents, hashed, rolling, slices

#: The most labelled rows that the trees learn from: those with the smallest hashes of their ids.
TRAIN_ROWS = 20_000
TREES, DEPTH, BINS, RATE, SHRINK, LEAST = 120, 4, 64, 0.12, 1.0, 8.0
FEATURES = ["log_bytes", "log_words", "bytes_a_word", "upper", "lower", "digit", "blank", "newline", "stop", "shout", "symbol", "pipe", "other", "high", "entropy", "distinct_words", "doubled_words", "top_word", "distinct_triples", "distinct_lines", "words_a_line"]
CLASSES = [range(65, 91), range(97, 123), range(48, 58), (9, 11, 12, 13, 32), (10,), b".,", b"!?", b"#$%&*+/<=>@\\^_`{}~[]", b"|", b"\"'()-:;", range(128, 256)]


def distinct_share(hashes: np.ndarray, row: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct values / values, largest share of one value) of each row; 1 and 0 where a row has none."""
    n = np.bincount(row, minlength=rows)
    if not len(hashes):
        return np.ones(rows), np.zeros(rows)
    order = np.lexsort((hashes, row))
    h, r = hashes[order], row[order]
    new = np.r_[True, (h[1:] != h[:-1]) | (r[1:] != r[:-1])]
    first = np.flatnonzero(new)
    top = np.zeros(rows)
    np.maximum.at(top, r[first], np.diff(np.r_[first, len(h)]))
    return np.where(n, np.bincount(r[first], minlength=rows) / np.maximum(n, 1), 1.0), top / np.maximum(n, 1)


def statistics(texts: list[bytes | None]) -> np.ndarray:
    """(documents, FEATURES) statistics of whole texts; those of a null text are those of an empty one."""
    rows = len(texts)
    texts = [t or b"" for t in texts]
    size = np.fromiter(map(len, texts), np.int64, rows)
    counts = np.stack([np.bincount(np.frombuffer(t, np.uint8), minlength=256) for t in texts]) if rows else np.zeros((0, 256))
    share = counts / np.maximum(size, 1)[:, None]
    classes = np.stack([share[:, list(c)].sum(axis=1) for c in CLASSES], axis=1)
    entropy = -(share * np.log2(np.where(share > 0, share, 1))).sum(axis=1)
    flat, words = hashed(texts)
    row = np.repeat(np.arange(rows), words)
    distinct, top = distinct_share(flat, row, rows)
    doubled = np.bincount(row[1:][(flat[1:] == flat[:-1]) & (row[1:] == row[:-1])], minlength=rows) / np.maximum(words - 1, 1)
    triples = rolling(flat, 3)
    inside = row[2:] == row[: len(triples)] if len(triples) else np.zeros(0, bool)
    distinct_triples, _ = distinct_share(triples[inside], row[: len(triples)][inside], rows)
    lines = [[x for x in t.split(b"\n") if x] for t in texts]
    n_lines = np.fromiter(map(len, lines), np.int64, rows)
    distinct_lines = np.fromiter((len({*x}) for x in lines), np.int64, rows) / np.maximum(n_lines, 1)
    out = [np.log1p(size), np.log1p(words), size / np.maximum(words, 1), *classes.T, entropy, distinct, doubled, top, distinct_triples, distinct_lines, words / np.maximum(n_lines, 1)]
    return np.stack(out, axis=1).astype(np.float32)


class Trees:
    """Boosted trees for the log-odds of label 1; complete trees of one depth in flat arrays."""

    def __init__(self, base: float, feature: np.ndarray, threshold: np.ndarray, value: np.ndarray):
        self.base, self.feature, self.threshold, self.value = base, feature, threshold, value

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        n, (trees, inner) = len(x), self.feature.shape
        node = np.zeros((n, trees), np.int64)
        row, first = np.arange(n)[:, None], np.arange(trees)[None, :] * inner
        feature, threshold = self.feature.ravel(), self.threshold.ravel()
        for _ in range((inner + 1).bit_length() - 1):
            at = first + node
            node = 2 * node + 1 + (x[row, feature[at]] > threshold[at])
        leaf = np.arange(trees)[None, :] * self.value.shape[1] + node - inner
        return self.base + self.value.ravel()[leaf].sum(axis=1, dtype=np.float64)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.log_odds(x), -500, 500)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, bins: int = BINS) -> Trees:
    """Newton boosting on histograms of gradients and curvatures; splits lie between quantiles of a feature."""
    n, f = x.shape
    inner = (1 << depth) - 1
    share = (y.sum() + 1) / (n + 2)
    base = float(np.log(share / (1 - share)))
    if n == 0 or y.min() == y.max():
        return Trees(base if n else 0.0, np.zeros((1, inner), np.int64), np.zeros((1, inner), np.float32), np.zeros((1, inner + 1)))
    cuts = [np.unique(np.quantile(x[:, k], np.arange(1, bins) / bins, method="lower")) for k in range(f)]
    binned = np.stack([np.searchsorted(c, x[:, k], side="left") for k, c in enumerate(cuts)], axis=1)  # x <= cuts[b] has bin <= b
    flat = binned + np.arange(f) * bins
    usable = np.arange(bins)[None, :] < np.array([len(c) for c in cuts])[:, None]
    features, thresholds, values = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf, np.float32), np.zeros((trees, inner + 1))
    z = np.full(n, base)
    for t in range(trees):
        p = 1 / (1 + np.exp(-z))
        g, h = y - p, p * (1 - p)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            here = (1 << level) - 1
            wide = 1 << level
            at = (node - here)[:, None] * (f * bins) + flat
            size = wide * f * bins
            hist = [np.bincount(at.ravel(), np.repeat(w, f), size).reshape(wide, f, bins).cumsum(axis=2) for w in (g, h)]
            (gl, hl), (gt, ht) = hist, (x[:, :1, -1:] for x in hist)
            gain = gl**2 / (hl + SHRINK) + (gt - gl) ** 2 / (ht - hl + SHRINK) - gt**2 / (ht + SHRINK)
            # A side must hold enough curvature, as many as LEAST rows at even odds would have a part of.
            gain = np.where(usable[None] & (hl >= LEAST / 16) & (ht - hl >= LEAST / 16), gain, 0.0).reshape(wide, -1)
            best = gain.argmax(axis=1)
            split = gain[np.arange(wide), best] > 1e-9
            k, b = best // bins, best % bins
            features[t, here : here + wide] = np.where(split, k, 0)
            thresholds[t, here : here + wide] = [cuts[i][j] if s else np.inf for i, j, s in zip(k, b, split, strict=True)]
            own = node - here
            right = split[own] & (binned[np.arange(n), k[own]] > b[own])
            node = 2 * node + 1 + right
        leaf = node - inner
        gs, hs = (np.bincount(leaf, w, inner + 1) for w in (g, h))
        values[t] = RATE * gs / (hs + SHRINK)
        z += values[t][leaf]
    return Trees(base, features, thresholds, values)


def scored(d: DataFrame, model: Trees | None, inside: str = "") -> DataFrame:
    """(i, t binary, …) -> (score, …) with a model; else (i, t, y) -> (i, y, x: the statistics).

    With `inside`, t is a struct that stays, and the text its field of that name.
    """
    sent = d.sparkSession.sparkContext.broadcast(model) if model else None

    names, first = d.columns, 1 if inside else 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if inside:
                batch = batch.append_column("text", pc.struct_field(batch.column(1), [inside]).cast(pa.string()).cast(pa.binary()))
            for start, end in slices(batch, len(names) if inside else 1):
                part = batch.slice(start, end - start)
                x = statistics(part.column(len(names) if inside else 1).to_pylist())
                if sent:
                    yield pa.RecordBatch.from_arrays([pa.array(sent.value.score(x)), *part.columns[first : len(names)]], names=["score", *names[first:]])
                else:
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.FixedSizeListArray.from_arrays(x.ravel(), x.shape[1]).cast(pa.list_(pa.float32()))], names=["i", "y", "x"])

    if not sent:
        return d.mapInArrow(run, "i long, y int, x array<float>")
    return d.mapInArrow(run, ", ".join(["score double", *(f"`{f.name}` {f.dataType.simpleString()}" for f in d.schema.fields[first:])]))


def held_out(c: str, folds: int, fold: int):
    """Whether crc32 of the id as text leaves `fold` modulo `folds`; no for a null id."""
    return F.coalesce(F.crc32(F.col(c).cast("string")) % folds == fold, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", folds: int = 4, fold: int = 2, rows: int = TRAIN_ROWS) -> Trees:
    """Trees from at most `rows` labelled ids outside the held-out fold, chosen by a hash of the id.

    Null labels and ids teach nothing; an id with several labels counts once, with the largest; rows that repeat an id teach once, by
    the least of their statistics. Only statistics of the chosen ids come to the driver, a row each.
    """
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(id_col, folds, fold))
    known = known.groupBy(F.col(id_col).cast("long").alias("j")).agg(F.max((F.col(label_col) == 1).cast("int")).alias("y"))
    chosen = known.orderBy(F.xxhash64("j"), "j").limit(rows)
    d = docs.select(F.col(id_col).cast("long").alias("i"), as_bytes(text_col).alias("t")).join(F.broadcast(chosen), F.col("i") == F.col("j")).select("i", "t", "y")
    got = scored(d, None).groupBy("i").agg(F.min(F.struct("x", "y")).alias("m")).select("i", "m.x", "m.y").toArrow()
    x = got["x"].combine_chunks().flatten().to_numpy().reshape(-1, len(FEATURES)) if got.num_rows else np.zeros((0, len(FEATURES)), np.float32)
    i, y = got["i"].to_numpy(), got["y"].to_numpy().astype(np.float64)
    order = np.lexsort((*x.T, i))  # the same order in every run
    return fit(x[order], y[order])


def classify_quality(docs: DataFrame, model: Trees, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7, folds: int = 4, fold: int = 2, keep_row: bool = False) -> DataFrame:
    """Score every whole text: id, held_out, score (0 to 1), predicted (1 from `threshold`), and row with keep_row.

    Null and empty texts are scored as texts without words; null ids are not held out; rows may
    repeat; other columns are not looked at. One pass without a shuffle.
    """
    text = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row") if keep_row else as_bytes(text_col).alias("t")
    d = docs.select(F.lit(0).alias("i"), text, F.col(id_col).cast("long").alias("id"), held_out(id_col, folds, fold).alias("held_out"))
    d = scored(d, model, text_col if keep_row else "")
    return d.select(F.col("id").alias(id_col), "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"), *["row"] * keep_row)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return classify_quality(docs, learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
