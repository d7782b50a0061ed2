"""Substring dedup: Rabin-Karp hashes of every window of `width` words, counted in Spark.

A window occurrence goes if the same words also start in a document with a smaller id; windows that
touch or overlap merge into maximal intervals.

Three jobs, none of which sends every window over the network:
1. Each window is represented by its minimizer, the smallest hash of the 5-word runs inside it. Equal
   windows have equal minimizers and about one window in five has a new one, so counting documents
   for each minimizer moves a fifth of the rows. Those in several documents set bits in a bitmap of
   a size that follows their number, up to a bound. As it fills up beyond that, it lets more windows through, never fewer.
2. Windows whose minimizer has its bit set are counted by two hashes of their own, 96 bits in all: each task sends the smallest
   document of each hash once, so that a passage that a third of all documents share costs one row
   a task; its other documents in that task are already known to lose it.
3. What each document loses is joined to its text by id.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BASE, as_bytes, documents, hashed, rolling, slices, split_words, tidy, written

WIDTH, GRAM = 13, 5
#: The bitmap of shared minimizers has 16 bits for each, between these powers of two (128 kB to 64 MB), and is sent in pieces of 2**SEGMENT bits.
LEAST_BITS, MOST_BITS, SEGMENT = 20, 29, 20
#: Base of the second polynomial of a window. With it a window is known by 96 bits: of the 1.4e26 pairs that 100 TB of text hold, 0.002 are expected to meet.
SECOND = 0xD1342543DE82EF95
#: Windows that a task holds before it sends them.
HELD = 1_500_000


def least_in_runs(x: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each run of `width` values."""
    done = 1
    while done < width:
        step = min(done, width - done)
        x = np.minimum(x[:-step], x[step:])
        done += step
    return x


def starts(counts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(position in the flat words, number of the text) of every window that lies in one text."""
    ends = np.cumsum(counts)
    n = np.maximum(counts - width + 1, 0)
    row = np.repeat(np.arange(len(counts)), n)
    first = np.repeat(ends - counts - (np.cumsum(n) - n), n)
    return first + np.arange(int(n.sum())), row


def minimizers(flat: np.ndarray, width: int, gram: int) -> np.ndarray:
    return least_in_runs(rolling(flat, gram), width - gram + 1)


def batches_of(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, flat word hashes, word counts) of the rows that have an id."""
    for start, end in slices(batch, 1):
        part = batch.slice(start, end - start)
        part = part.filter(part.column(0).is_valid())
        if part.num_rows:
            flat, counts = hashed(part.column(1).to_pylist())
            yield part.column(0).to_numpy(zero_copy_only=False), flat, counts


def shared_minimizers(d: DataFrame, width: int, gram: int) -> DataFrame:
    """Minimizers (column m) that windows of at least two different ids have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            m, i = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.lexsort((i, m))
            m, i = m[order], i[order]
            new = np.r_[True, m[1:] != m[:-1]]
            last = np.r_[new[1:], True]
            keep = new | (last & (i != i[np.maximum.accumulate(np.where(new, np.arange(len(m)), 0))]))
            m, i = m[keep], i[keep]
            by_id = np.argsort(i, kind="stable")  # rows of one document together compress better
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(m[by_id].view(np.int64)), pa.array(i[by_id])], names=["m", "i"])

        for batch in batches:
            for ids, flat, counts in batches_of(batch):
                at, row = starts(counts, width)
                if not len(at):
                    continue
                m = minimizers(flat, width, gram)[at]
                new = np.r_[True, (m[1:] != m[:-1]) | (row[1:] != row[:-1])]
                held.append((m[new], ids[row[new]]))
                size += int(new.sum())
                if size >= HELD:
                    yield flush()
                    size = 0
        if held:
            yield flush()

    rows = d.mapInArrow(run, "m long, i long").repartition("m")
    return rows.groupBy("m").agg(F.min("i").alias("lo"), F.max("i").alias("hi")).where("lo < hi").select("m")


def bitmap(keys: DataFrame, column: str) -> np.ndarray:
    """A bit for each value of the first bits of the keys, as bytes. Comes to the driver in pieces of a bounded total size."""
    size = bits_for(keys.count())
    bit = F.shiftrightunsigned(F.col(column), 64 - size)
    bits = keys.select(bit.alias("bit")).withColumn("segment", F.shiftright("bit", SEGMENT).cast("int"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            bit, segment = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            order = np.argsort(segment, kind="stable")
            bit, segment = bit[order], segment[order]
            for s, own in zip(segment[np.r_[True, segment[1:] != segment[:-1]]].tolist(), np.split(bit, np.flatnonzero(segment[1:] != segment[:-1]) + 1), strict=True) if len(bit) else ():
                flags = found.setdefault(s, np.zeros(1 << SEGMENT, bool))
                flags[own & ((1 << SEGMENT) - 1)] = True
        for s, flags in found.items():
            yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([np.packbits(flags).tobytes()])], names=["segment", "bits"])

    out = np.zeros(1 << (size - 3), np.uint8)
    step = 1 << (SEGMENT - 3)
    for s, part in bits.repartition("segment").mapInArrow(run, "segment int, bits binary").toLocalIterator():
        out[s * step : (s + 1) * step] = np.frombuffer(part, np.uint8)
    return out


def bits_for(keys: int) -> int:
    return min(MOST_BITS, max(LEAST_BITS, (16 * keys).bit_length()))


def has_bit(bits: np.ndarray, x: np.ndarray) -> np.ndarray:
    at = x >> np.uint64(62 - len(bits).bit_length())  # the first log2(8 * len(bits)) bits
    return (bits[at >> np.uint64(3)] >> (np.uint8(7) - (at & np.uint64(7)).astype(np.uint8))) & 1 > 0


def losses(d: DataFrame, width: int, gram: int) -> DataFrame:
    """(i, h): documents and the hashes of their windows that also start in a document with a smaller id."""
    spark = d.sparkSession
    sent = spark.sparkContext.broadcast(bitmap(written(shared_minimizers(d, width, gram)), "m"))

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, bits = [], 0, sent.value

        def flush() -> pa.RecordBatch:
            h, g, i = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            order = np.lexsort((i, g, h))
            h, g, i = h[order], g[order], i[order]
            new = np.r_[True, (h[1:] != h[:-1]) | (g[1:] != g[:-1])]
            other = np.r_[False, i[1:] != i[:-1]] & ~new
            keep = new | other
            by_id = np.argsort(i[keep], kind="stable")
            h, g, i, lost = h[keep][by_id], g[keep][by_id], i[keep][by_id], other[keep][by_id]
            # What is known to be lost goes anywhere; what isn't meets the other tasks' rows of the hash.
            key = np.where(lost, h * np.uint64(0x9E3779B97F4A7C15) + i.view(np.uint64), h)
            return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(np.where(lost, 0, g)), pa.array(i), pa.array(h.view(np.int64), mask=~lost)], names=["key", "g", "i", "h"])

        for batch in batches:
            for ids, flat, counts in batches_of(batch):
                at, row = starts(counts, width)
                if not len(at):
                    continue
                hit = has_bit(bits, minimizers(flat, width, gram)[at])
                if hit.any():
                    h, second = (rolling(flat, width, base)[at[hit]] for base in (BASE, SECOND))
                    held.append((h, (second >> np.uint64(32)).astype(np.uint32).view(np.int32), ids[row[hit]]))
                    size += len(h)
                if size >= HELD:
                    yield flush()
                    size = 0
        if held:
            yield flush()

    def lost(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by both hashes and id; of each window, all ids but the first lose it."""
        at, least = None, None
        for batch in batches:
            key, g, i = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1, 2))
            sure = batch.column(3).is_valid().to_numpy(zero_copy_only=False)
            h = np.where(sure, batch.column(3).fill_null(0).to_numpy(zero_copy_only=False), key)
            open_ = np.flatnonzero(~sure)
            gone = sure.copy()
            if len(open_):
                k, l, o = key[open_], g[open_], i[open_]
                new = np.r_[at != (k[0], l[0]), (k[1:] != k[:-1]) | (l[1:] != l[:-1])]
                first = o[np.maximum.accumulate(np.where(new, np.arange(len(k)), 0))]
                if not new[0]:
                    first[: int(np.argmax(new)) if new.any() else len(k)] = least
                gone[open_] = o > first
                at, least = (k[-1], l[-1]), first[-1]
            if gone.any():
                yield pa.RecordBatch.from_arrays([pa.array(i[gone]), pa.array(h[gone])], names=["i", "h"])

    rows = d.mapInArrow(windows, "key long, g int, i long, h long").repartition("key").sortWithinPartitions("key", "g", "i")
    return rows.mapInArrow(lost, "i long, h long")


@tidy
def dedup_substrings(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, gram: int = GRAM, keep_row: bool = False) -> DataFrame:
    """Remove every word that is covered by a window of `width` words which also starts in a document with a smaller id.

    Words are runs of bytes other than 0x20 and 0x09-0x0D, unchanged; windows are judged on the
    input. Returns a row per input row: id, n_words, n_removed, kept_sha256, kept (the kept words, joined
    by one space) and spans (the removal intervals, in words: first, and one past the last); with
    keep_row also row, the input's columns, in which kept isn't put yet.

    A null or short text has no window. Rows without an id lose nothing and make others lose
    nothing. Rows that share an id do not count against each other, and each loses what documents with
    smaller ids have. Ids are whole numbers (else the cast fails). An empty table gives none. Other columns are not looked at, whatever their names.
    """
    row = [F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")] if keep_row else []
    d = docs.select(F.col(id_col).cast("long").alias("i"), as_bytes(text_col).alias("t"), *row)
    gone = losses(d.select("i", "t"), width, gram).groupBy("i").agg(F.collect_set("h").alias("hs")).withColumnRenamed("i", "j")
    # A row that is kept brings its text along.
    both = d.join(gone, F.col("i") == F.col("j"), "left").select("i", "hs", "row" if keep_row else "t")
    columns = [("i", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.string()), ("spans", pa.list_(pa.list_(pa.int32())))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if keep_row:
                batch = batch.append_column("t", pc.struct_field(batch.column(2), [text_col]).cast(pa.string()).cast(pa.binary()))
            for start, end in slices(batch, 2 + keep_row):
                part, rows = batch.slice(start, end - start), []
                texts = part.column(2 + keep_row).to_pylist()
                flat, counts = hashed(texts)
                ends = np.cumsum(counts)
                for text, hs, n, end_ in zip(texts, part.column(1), counts, ends, strict=True):
                    words, spans = split_words(text), []
                    if hs.is_valid:
                        hit = np.flatnonzero(np.isin(rolling(flat[end_ - n : end_], width).view(np.int64), hs.values.to_numpy(zero_copy_only=False)))
                        if len(hit):
                            cut = np.flatnonzero(np.diff(hit) > width)
                            spans = np.stack([hit[np.r_[0, cut + 1]], hit[np.r_[cut, len(hit) - 1]] + width], axis=1).tolist()
                    kept, at = [], 0
                    for a, b in spans:
                        kept += words[at:a]
                        at = b
                    kept += words[at:]
                    joined = b" ".join(kept)
                    rows.append((len(words), len(words) - len(kept), hashlib.sha256(joined).hexdigest(), joined.decode("utf-8", "replace"), spans))
                made = [part.column(0), *(pa.array([r[k] for r in rows], t) for k, (_, t) in enumerate(columns[1:]))]
                yield pa.RecordBatch.from_arrays(made + [part.column(2)] * keep_row, names=[n for n, _ in columns] + ["row"] * keep_row)

    schema = "i long, n_words long, n_removed long, kept_sha256 string, kept string, spans array<array<int>>"
    if keep_row:
        schema += f", row {d.schema['row'].dataType.simpleString()}"
    return both.mapInArrow(run, schema).withColumnRenamed("i", id_col)


def op10_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_substrings(documents(spark, sf_dir)).select("doc_id", "n_words", "n_removed", "kept_sha256")


OP10_SQL = r"""
WITH w AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS ws FROM documents),
p AS (SELECT doc_id, unnest(range(1, len(ws) - 11)) AS p, ws FROM w),
g AS (SELECT doc_id, p, array_to_string(ws[p : p + 12], ' ') AS g FROM p),
m AS (SELECT g, min(doc_id) AS lo FROM g GROUP BY g HAVING min(doc_id) < max(doc_id)),
c AS (SELECT DISTINCT g.doc_id, unnest(range(p, p + 13)) AS q FROM g JOIN m USING (g) WHERE g.doc_id > m.lo),
r AS (SELECT doc_id, list(q) AS qs FROM c GROUP BY doc_id),
k AS (SELECT w.doc_id, len(ws) AS n, coalesce(len(qs), 0) AS gone,
             CASE WHEN qs IS NULL THEN ws ELSE list_transform(list_filter(range(1, len(ws) + 1), lambda q: NOT list_contains(qs, q)), lambda q: ws[q]) END AS ks
      FROM w LEFT JOIN r USING (doc_id))
SELECT doc_id, n::BIGINT AS n_words, gone::BIGINT AS n_removed, sha256(coalesce(array_to_string(ks, ' '), '')) AS kept_sha256 FROM k
"""
