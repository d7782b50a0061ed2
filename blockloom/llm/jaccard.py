"""N-gram Jaccard join by universe partitioning.

A document's set holds the hashes of its word shingles. Sizes fall into bands; a pair is found under
the scheme of the band of its smaller set. A scheme cuts the universe of hashes into segments: if the
symmetric difference of a linked pair is at most H and segments' weights add up to H + 1 + slack,
then segments of weight above `slack` agree: a segment of weight 1 agrees if it holds the
same shingles on both sides, one of weight 2 if one shingle at most is different. So a set is indexed by
its segments (weight 1) and by its segments with their one-deletion neighbours (weight 2). How many
segments of either kind a scheme has is chosen by the cost of their signatures.

Signatures of no shingle would be shared by sets that have nothing to do with each other, so they are left out. A pair is lost by that only
if such signatures weigh more than the slack in both of its sets. Sets of which this is true are thin, and are indexed once more
under another cut of the universe; those that are thin there, too, under a third, and so on, each time a small share. At the last of LEVELS cuts every signature is
kept, so no pair is lost, and the share of all sets that meet there for want of shingles is that of a few per cent to the power of LEVELS - 1.

Signatures that several sets share give candidates, which are verified in rounds, so that a group of
n near copies costs about n checks and not n * n / 2: first every set of a bucket against the
bucket's least; then, in buckets that still hold several components, the likeliest pair of each two
components; then all pairs that are still across components. A parity sketch (bits toggled by each shingle) bounds the symmetric difference from below and
rules out most false candidates without their texts; the rest are compared shingle by shingle.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_bytes, documents, fits, hashed, mixed, remembered, rolling, slices, tidy, written
from .components import components

WORDS, PERCENT = 5, 80
#: Ratio of a band's sizes, and how much a signature of at most one shingle costs beside the one that it is.
BAND, WEAK = 1.6, 2.0
#: Cuts of the universe for sets that are thin under those before.
LEVELS = 8
#: Signatures that a task holds before it deals them.
HELD = 1_000_000
#: The least bits of a parity sketch.
SKETCH = 512
#: The most rows of cells, and of ids, that are broadcast (32 MB); more are joined.
BROADCAST_CELLS, BROADCAST_IDS = 500_000, 2_000_000
#: Texts that meet one text in a cell.
CELL = 256
#: Buckets of a set that tell whether another bucket gives a pair already.
FIRST = 8
#: Sets in a part of a bucket; larger buckets are cut, and every pair of parts is one bounded group.
PART = 1024


class Scheme(NamedTuple):
    number: int
    low: int  # sizes from low to below high are the smaller sets'
    high: int
    top: int  # the largest size that a set can have beside one of them
    single: int  # segments of weight 1
    double: int  # segments of weight 2
    slack: int


def most_different(x: int, y: int, percent: int) -> int:
    """The largest symmetric difference of linked sets of these sizes: from percent * union <= 100 * intersection."""
    return (100 - percent) * (x + y) // (100 + percent)


def allocate(n: float, low: int, need: int) -> tuple[int, int, int]:
    """(segments of weight 1, of weight 2, slack) with the least cost for sets of about n shingles; one of weight 2 at least, where there are enough."""
    best = None
    for double in range(int(need > 3), need // 2 + 1, max(1, need // 16)):
        for slack in range(0, 4 * need + 8):
            single = need + slack - 2 * double
            mean = low / (single + 2 * double)
            bare, few = math.exp(-mean), math.exp(-2 * mean) * (1 + 2 * mean)  # odds of segments without a shingle, or with one at most
            lost, spread = single * bare + 2 * double * few, math.sqrt(single * bare + 4 * double * few) + 1e-9
            thin = 0.5 * math.erfc((slack + 0.5 - lost) / spread / math.sqrt(2))
            if thin > 0.2:
                continue
            mean = n / (single + 2 * double)
            weak = single * mean * math.exp(-mean) + double * math.exp(-2 * mean) * (1 + 4 * mean + 4 * mean * mean)
            cost = (single + double * (1 + 2 * mean) + WEAK * weak) / (1 - thin)
            if best is None or cost < best[0]:
                best = (cost, single, double, slack)
            if thin < 1e-3:
                break
    if best is None:  # few shingles for many segments: none but the last cut finds all
        return need, 0, 0
    return best[1:]


def schemes(limit: int, percent: int) -> list[Scheme]:
    """Schemes for all sizes up to `limit`. Sets that link with equal ones only need none."""
    bound = 1 << max(10, (limit - 1).bit_length())
    return [s for s in remembered(("schemes", bound, percent), lambda: made_schemes(bound, percent)) if s.low <= limit]


def made_schemes(limit: int, percent: int) -> list[Scheme]:
    out, low = [], 1
    while low <= limit:
        if most_different(low, 100 * low // percent, percent) == 0:
            low += 1
            continue
        high = max(low + 1, int(low * BAND))
        top = 100 * (high - 1) // percent
        need = most_different(high - 1, top, percent) + 1
        out.append(Scheme(len(out), low, high, top, *allocate(math.sqrt(low * high), low, need)))
        low = high
    return out


def shingle_sets(texts: list[bytes | None], words: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingle hashes of all texts, end to end; their number for each text)."""
    flat, counts = hashed(texts, lower=True)
    ends = np.cumsum(counts)
    n = np.maximum(counts - words + 1, 0)
    row = np.repeat(np.arange(len(texts)), n)
    at = np.arange(int(n.sum())) + np.repeat(ends - counts - (np.cumsum(n) - n), n)
    h = rolling(flat, words)[at] if len(at) else np.empty(0, np.uint64)
    short = np.flatnonzero((counts > 0) & (counts < words))
    if len(short):  # the whole sequence as one shingle; its length keeps it apart from longer ones
        whole = [rolling(flat[ends[i] - counts[i] : ends[i]], int(counts[i]))[0] for i in short]
        h = np.concatenate([h, mixed(np.array(whole, np.uint64) + counts[short].astype(np.uint64))])
        row = np.concatenate([row, short])
        order = np.argsort(row, kind="stable")
        h, row = h[order], row[order]
    edges = np.cumsum(np.bincount(row, minlength=len(texts)))
    for i, j in zip([0, *edges[:-1]], edges, strict=True) if len(edges) else ():
        h[i:j].sort()
    new = np.r_[True, (h[1:] != h[:-1]) | (row[1:] != row[:-1])] if len(h) else np.zeros(0, bool)
    return h[new], np.bincount(row[new], minlength=len(texts))


def fingerprints(h: np.ndarray, sizes: np.ndarray, other: bool = False) -> np.ndarray:
    """A 64-bit fingerprint of each set that is not empty: the sum of its mixed hashes, mixed; with `other` one that is independent of it."""
    first = (np.cumsum(sizes) - sizes)[sizes > 0]
    if not len(first):
        return np.empty(0, np.uint64)
    return mixed(np.add.reduceat(mixed(h * np.uint64(0xD1342543DE82EF95) + np.uint64(1) if other else h), first) + sizes[sizes > 0].astype(np.uint64))


def class_of(h: np.ndarray, sizes: np.ndarray, clashing: np.ndarray) -> np.ndarray:
    """The class of each set, 0 for an empty one: its fingerprint or, where several sets have that one, a number from the other."""
    k = np.zeros(len(sizes), np.uint64)
    k[sizes > 0] = fingerprints(h, sizes)
    if len(clashing) and (hit := np.isin(k, clashing) & (sizes > 0)).any():
        other = np.zeros(len(sizes), np.uint64)
        other[sizes > 0] = fingerprints(h, sizes, True)
        k[hit] = mixed(other[hit] + mixed(k[hit]))
    return k.view(np.int64)


def sketches(h: np.ndarray, sizes: np.ndarray) -> list[bytes | None]:
    """For each set, bits of which each is set if an odd number of shingles fall on it: two to four a shingle, a power of two in all."""
    out: list[bytes | None] = []
    ends = np.cumsum(sizes)
    for n, end in zip(sizes.tolist(), ends.tolist(), strict=True):
        width = max(SKETCH, 1 << (2 * n - 1).bit_length()) if n else 0
        odd = np.bincount((h[end - n : end] & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1 if n else None
        out.append(np.packbits(odd.astype(bool), bitorder="little").tobytes() if n else None)
    return out


def differences(first: list[bytes], second: list[bytes]) -> np.ndarray:
    """How many bits the sketches of each pair differ in: never more than the shingles that the sets do.

    The wider sketch of two is folded onto the width of the other.
    """
    out = np.zeros(len(first), np.int64)
    widths = np.array([min(len(a), len(b)) for a, b in zip(first, second, strict=True)], np.int64)
    for width in np.unique(widths).tolist():
        rows = np.flatnonzero(widths == width)
        a, b = (folded([side[i] for i in rows.tolist()], width) for side in (first, second))
        out[rows] = np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int64)
    return out


def folded(sketch: list[bytes], width: int) -> np.ndarray:
    """(sketches, width / 8) words of 64 bits."""
    return np.stack([np.bitwise_xor.reduce(np.frombuffer(x, np.uint64).reshape(-1, width // 8), axis=0) for x in sketch])


def signatures(h: np.ndarray, sizes: np.ndarray, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(number of the set, signature) arrays, scheme by scheme and cut by cut."""
    row = np.repeat(np.arange(len(sizes)), sizes)
    for s in schemes(int(sizes.max(initial=0)), percent):
        thin = (sizes >= s.low) & (sizes <= max(s.top, s.high - 1))
        for level in range(LEVELS):
            if not thin.any():
                break
            sets, own = np.flatnonzero(thin), thin[row]
            of, signature, thin_here = cut(h[own], np.searchsorted(sets, row[own]), len(sets), s, level)
            yield sets[of], signature
            thin = np.zeros(len(sizes), bool)
            thin[sets[thin_here]] = True


def cut(x: np.ndarray, r: np.ndarray, sets: int, s: Scheme, level: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shingles x of sets r, under a scheme's cut: (sets, their signatures; whether each set is thin)."""
    units, wide = s.single + 2 * s.double, s.single + s.double
    place = mixed(x + np.uint64(0x632BE59BD9B4E019 * (s.number * LEVELS + level + 1) % (1 << 64)))
    unit = (((place >> np.uint64(32)) * np.uint64(units)) >> np.uint64(32)).astype(np.int64)
    segment = np.where(unit < s.single, unit, s.single + (unit - s.single) // 2)
    at, size = r * wide + segment, sets * wide
    # Sums of 32-bit halves stay exact in double precision.
    high, low = (x >> np.uint64(32)).astype(np.float64), (x & np.uint64(0xFFFFFFFF)).astype(np.float64)
    sums = [np.bincount(at, v, size) for v in (high, low)]
    held = np.bincount(at, minlength=size)
    everywhere = np.arange(size)
    of, single = everywhere // wide, everywhere % wide < s.single
    lost = np.bincount(of, np.where(single, held == 0, 2 * (held <= 1)), sets)
    thin = lost > s.slack
    last = level == LEVELS - 1

    def signed(high: np.ndarray, low: np.ndarray, at: np.ndarray) -> np.ndarray:
        name = (at % wide).astype(np.uint64) + np.uint64((s.number * LEVELS + level) << 32)
        return mixed(mixed((high.astype(np.uint64) << np.uint64(32)) + low.astype(np.uint64)) + name * np.uint64(0x9E3779B97F4A7C15))

    keep = everywhere[(held > 0) | (last & thin[of])]
    out = [(of[keep], signed(sums[0][keep], sums[1][keep], keep))]
    if s.double:
        d = np.flatnonzero((segment >= s.single) & ((held[at] > 1) | (last & thin[r])))
        out.append((r[d], signed(sums[0][at[d]] - high[d], sums[1][at[d]] - low[d], at[d])))
    of, signature = (np.concatenate(v) for v in zip(*out, strict=True))
    return of, signature, thin


def keys_of(d: DataFrame, words: int, clashing: np.ndarray) -> DataFrame:
    """(i, t) -> (i, n, k, other, sketch): the size, class, another fingerprint and sketch of each set; the latter three are null for an empty one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, end in slices(batch, 1):
                part = batch.slice(start, end - start)
                h, sizes = shingle_sets(part.column(1).to_pylist(), words)
                k, other = class_of(h, sizes, clashing), np.zeros(len(sizes), np.uint64)
                other[sizes > 0] = fingerprints(h, sizes, True)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes.astype(np.int64)), pa.array(k, mask=sizes == 0), pa.array(other.view(np.int64), mask=sizes == 0), pa.array(sketches(h, sizes), pa.binary())], names=["i", "n", "k", "other", "sketch"])

    return d.mapInArrow(run, "i long, n long, k long, other long, sketch binary")


def signatures_of(d: DataFrame, words: int, percent: int, clashing: np.ndarray) -> DataFrame:
    """(i, t) -> (key, k, s, p): the signatures of every different set of a task, once.

    Of the sets that share a signature, HELD rows at a time, all but the least come with it as p and are dealt anywhere; the least, whose s and p
    are null, is dealt by its signature, which is then the key. So a signature that very many sets share makes few rows that must meet.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def dealt() -> pa.RecordBatch:
            s, k = (np.concatenate(v) for v in zip(*held, strict=True))
            held.clear()
            order = np.lexsort((k, s))
            s, k = s[order], k[order]
            new = np.r_[True, s[1:] != s[:-1]]
            keep = new | np.r_[True, k[1:] != k[:-1]]
            p = k[np.maximum.accumulate(np.where(new, np.arange(len(s)), 0))]
            s, k, p, new = s[keep], k[keep], p[keep], new[keep]
            key = np.where(new, s, mixed((s + k).view(np.uint64)).view(np.int64))
            return pa.RecordBatch.from_arrays([pa.array(key), pa.array(k), pa.array(s, mask=new), pa.array(p, mask=new)], names=["key", "k", "s", "p"])

        for batch in batches:
            for start, end in slices(batch, 1):
                h, sizes = shingle_sets(batch.column(1).slice(start, end - start).to_pylist(), words)
                if not len(h):
                    continue
                k = class_of(h, sizes, clashing)
                fresh = np.zeros(len(sizes), bool)
                for j, x in enumerate(k.tolist()):
                    if sizes[j] and x not in seen:
                        seen.add(x)
                        fresh[j] = True
                own, k = np.repeat(fresh, sizes), k[fresh]
                for of, s in signatures(h[own], sizes[fresh], percent):
                    held.append((s.view(np.int64), k[of]))
                    size += len(s)
                if size >= HELD:
                    yield dealt()
                    size = 0
        if held:
            yield dealt()

    return d.mapInArrow(run, "key long, k long, s long, p long")


def buckets(rows: DataFrame) -> DataFrame:
    """(key, k, s, p) of signatures_of -> (s, k, p): the sets of each signature that at least two sets have, each with one that is not larger, p.

    Rows stream through sorted, and nothing but the current bucket's least is held.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = pivot = last = None
        told = True
        for batch in batches:
            sure = batch.column(3).is_valid()
            yield batch.select(["s", "k", "p"]).filter(sure)
            batch = batch.filter(pc.invert(sure))
            s, k = (batch.column(c).to_numpy() for c in (0, 1))
            if not len(s):
                continue
            new = np.r_[at is None or s[0] != at, s[1:] != s[:-1]]
            same = np.r_[not new[0] and k[0] == last, ~new[1:] & (k[1:] == k[:-1])]
            first = np.maximum.accumulate(np.where(new, np.arange(len(s)), -1))
            p = np.where(first >= 0, k[np.maximum(first, 0)], pivot if pivot is not None else 0)
            member = ~new & ~same
            out = [(s[member], k[member], p[member])]
            # The least itself goes out with the first other member.
            leads = np.unique(first[member])
            if len(leads) and leads[0] < 0:
                if not told:
                    out.append((np.array([at]), np.array([pivot]), np.array([pivot])))
                    told = True
                leads = leads[1:]
            out.append((s[leads], k[leads], k[leads]))
            if first[-1] >= 0:
                pivot, told = k[first[-1]], bool(len(leads) and leads[-1] == first[-1])
            at, last = s[-1], k[-1]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], names=["s", "k", "p"])

    return rows.repartition("key").sortWithinPartitions("key", "k").mapInArrow(run, "s long, k long, p long")


def may_link(n1: np.ndarray, n2: np.ndarray, different: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of these sizes, with at least so many different shingles, can link."""
    return (100 * np.minimum(n1, n2) >= percent * np.maximum(n1, n2)) & ((100 + percent) * different <= (100 - percent) * (n1 + n2))


def plausible(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (a, b) that sizes and sketches don't rule out."""
    c = classes.select("k", "n", "sketch")
    both = pairs.join(c.toDF("ka", "na", "xa"), F.col("a") == F.col("ka")).join(c.toDF("kb", "nb", "xb"), F.col("b") == F.col("kb"))
    both = both.where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")).select("a", "b", "na", "nb", "xa", "xb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                different = differences(batch.column(4).to_pylist(), batch.column(5).to_pylist())
                ok = may_link(batch.column(2).to_numpy(), batch.column(3).to_numpy(), different, percent)
                yield batch.select(["a", "b"]).filter(pa.array(ok))

    return both.mapInArrow(run, "a long, b long")


def verified(pairs: DataFrame, classes: DataFrame, d: DataFrame, words: int, percent: int, clashing: np.ndarray) -> DataFrame:
    """Those of the pairs (a, b) of classes whose sets link, by comparing the sets.

    The texts beside one a meet in cells of about CELL rows, each with a's text in front. So a
    text travels once for each pair that it is in, and no cell grows with the number of pairs of its a.
    """
    parts = pairs.groupBy("a").agg(F.ceil(F.count("*") / CELL).cast("int").alias("parts")).withColumnRenamed("a", "a2")
    parts = written(parts)
    part = F.pmod(F.xxhash64("b"), F.col("parts")).cast("int")
    cells = pairs.join(parts, F.col("a") == F.col("a2")).select("a", part.alias("part"), F.lit(1).alias("place"), F.col("b").alias("node"))
    heads = parts.select(F.col("a2").alias("a"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("place"), F.col("a2").alias("node"))
    cells = cells.unionByName(heads).join(classes.select("k", F.col("first").alias("j")), F.col("node") == F.col("k")).drop("k")
    cells = written(cells)
    cells = F.broadcast(cells) if fits(cells, BROADCAST_CELLS) else cells
    names = ["a", "part", "place", "node"]
    rows = d.join(cells, F.col("i") == F.col("j")).select(*names, "t").repartition("a", "part").sortWithinPartitions(*names)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = of = None
        for batch in batches:
            for start, end in slices(batch, 4):
                part = batch.slice(start, end - start)
                a, place, node = (part.column(c).to_pylist() for c in (0, 2, 3))
                h, sizes = shingle_sets(part.column(4).to_pylist(), words)
                ends, found = np.cumsum(sizes), []
                for r, k in enumerate(class_of(h, sizes, clashing).tolist()):
                    own = h[ends[r] - sizes[r] : ends[r]]
                    if k != node[r]:
                        continue  # another text under the same id
                    if place[r] == 0:
                        head, of = own.copy(), a[r]
                    elif of == a[r]:
                        shared = np.intersect1d(head, own, assume_unique=True).size
                        if 100 * shared >= percent * (len(head) + len(own) - shared):
                            found.append((a[r], k))
                yield pa.RecordBatch.from_arrays([pa.array([f[c] for f in found], pa.int64()) for c in (0, 1)], names=["a", "b"])

    return rows.mapInArrow(compare, "a long, b long").distinct()


def across(members: DataFrame, classes: DataFrame, percent: int, best: bool) -> DataFrame:
    """(s, k, root) -> (a, b): pairs of a bucket in different components that may link.

    With `best` only the pair of each two components whose sketches differ least, over all buckets.
    Else a pair comes from one of the buckets that it shares, as far as each set's first FIRST buckets tell: it is left
    to an earlier bucket that holds both.
    """
    sizes = members.groupBy("s").agg(F.count("*").alias("m"), F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi")
    sizes = written(sizes.select(F.col("s").alias("s2"), F.ceil(F.col("m") / PART).cast("int").alias("parts")))
    sizes = F.broadcast(sizes) if fits(sizes, BROADCAST_IDS) else sizes
    # A set whose copies lie in several tasks comes several times.
    open_ones = members.join(sizes, F.col("s") == F.col("s2")).select("s", "k", "root", "parts").distinct()
    early = open_ones.groupBy(F.col("k").alias("k3")).agg(F.slice(F.array_sort(F.collect_set("s")), 1, FIRST).alias("early"))
    known = classes.select(F.col("k").alias("k2"), "n", "sketch").join(early, F.col("k2") == F.col("k3")).drop("k3")
    m = open_ones.join(known, F.col("k") == F.col("k2"))
    m = m.withColumn("part", F.pmod(F.xxhash64("k"), F.col("parts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    m = m.select("s", F.least("part", "other").alias("x"), F.greatest("part", "other").alias("y"), "part", "k", "root", "n", "sketch", "early")
    names = ["s", "x", "y"]

    def pairs(table: pa.Table) -> Iterator[pa.RecordBatch]:
        part, k, root, n = (table[c].to_numpy() for c in ("part", "k", "root", "n"))
        sketch = table["sketch"].to_pylist()
        bits = folded(sketch, min(map(len, sketch)))
        x, y = table["x"][0].as_py(), table["y"][0].as_py()
        left, right = np.flatnonzero(part == x), np.flatnonzero(part == y)
        s = table["s"][0].as_py()
        early = np.full((len(k), FIRST), s)
        for r, own in enumerate(table["early"].to_pylist()):
            early[r, : len(own)] = own
        held: list[np.ndarray] = []
        for i in range(0, len(left), 64):
            rows = left[i : i + 64]
            cross = root[rows][:, None] != root[right][None, :]
            if x == y:
                cross &= k[rows][:, None] < k[right][None, :]
            u, v = np.nonzero(cross)
            u, v = rows[u], right[v]
            for j in range(0, len(u), 16384):
                a, b = u[j : j + 16384], v[j : j + 16384]
                different = np.bitwise_count(bits[a] ^ bits[b]).sum(axis=1, dtype=np.int64)
                ok = np.flatnonzero(may_link(n[a], n[b], different, percent))
                if not best:
                    first, second = early[a[ok]], early[b[ok]]
                    ok = ok[~((first[:, :, None] == second[:, None, :]) & (first < s)[:, :, None]).any(axis=(1, 2))]
                if len(ok):
                    a, b, different = a[ok], b[ok], different[ok]
                    held.append(np.stack([np.minimum(root[a], root[b]), np.maximum(root[a], root[b]), different, np.minimum(k[a], k[b]), np.maximum(k[a], k[b])]))
        if held:
            found = np.concatenate(held, axis=1)
            if best:
                found = found[:, np.lexsort(found[::-1])]
                found = found[:, np.r_[True, (found[:2, 1:] != found[:2, :-1]).any(axis=0)]]
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in found], names=["x", "y", "different", "a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = pa.concat_tables([rest, table]) if rest is not None else table
            if not table.num_rows:
                continue
            group = np.stack([table[c].to_numpy() for c in names])
            edges = np.flatnonzero((group[:, 1:] != group[:, :-1]).any(axis=0)) + 1
            for a, b in zip([0, *edges[:-1]], edges, strict=False):
                yield from pairs(table.slice(a, b - a))
            rest = table.slice(edges[-1] if len(edges) else 0)
        if rest is not None and rest.num_rows:
            yield from pairs(rest)

    found = m.repartition(*names).sortWithinPartitions(*names).mapInArrow(run, "x long, y long, different long, a long, b long")
    if best:
        return found.groupBy("x", "y").agg(F.min(F.struct("different", "a", "b")).alias("m")).select("m.a", "m.b")
    return found.select("a", "b").distinct()


def grouped(found: DataFrame, roots: DataFrame) -> DataFrame:
    """The members of buckets with the components that they are in so far."""
    return written(found.join(roots, F.col("k") == F.col("node"), "left").select("s", "k", F.coalesce("root", "k").alias("root")))


def classed(d: DataFrame, words: int) -> tuple[DataFrame, DataFrame, np.ndarray]:
    """(keys_of(d), the classes: k, first, n, sketch, fingerprints of which sets have several).

    Sets that share a fingerprint but not the other one are told apart by both, 128 bits.
    """
    clashing = np.empty(0, np.uint64)
    while True:
        keys = written(keys_of(d, words, clashing))
        classes = keys.where(F.col("k").isNotNull() & F.col("i").isNotNull()).groupBy("k").agg(F.min("i").alias("first"), F.min("n").alias("n"), F.min("sketch").alias("sketch"), F.min("other").alias("lo"), F.max("other").alias("hi"))
        classes = written(classes)
        # Far below one in 10**9 sets; none in most tables.
        again = classes.where("lo <> hi").select("k").toArrow()["k"].to_numpy().view(np.uint64)
        if not len(again):
            return keys.drop("other"), classes.drop("lo", "hi"), clashing
        clashing = np.union1d(clashing, again)


@tidy
def jaccard_components(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """Link documents whose shingle sets have a Jaccard similarity of `percent` or more; a row per input row: id, n_shingles, component_id.

    A set holds the distinct shingles of `words` words (runs of bytes other than 0x20 and 0x09-0x0D,
    A-Z lower-cased); with fewer words, the whole sequence is one; a null text or one
    without words has the empty set and links with nothing. component_id is the smallest id that
    links reach. Ids are whole numbers (else the cast fails). Rows without an id link with nothing and have none. Rows that repeat an id are
    documents of their own with that id; equal sets are one class, told apart by 128 bits. An empty table gives none.
    Other columns are not looked at, whatever their names.
    """
    d = docs.select(F.col(id_col).cast("long").alias("i"), as_bytes(text_col).alias("t"))
    keys, classes, clashing = classed(d, words)
    with_id = d.where(F.col("i").isNotNull())
    found = written(buckets(signatures_of(with_id, words, percent, clashing)))
    stars = written(plausible(found.where("k <> p").select(F.col("p").alias("a"), F.col("k").alias("b")).distinct(), classes, percent))
    near = written(verified(stars, classes, with_id, words, percent, clashing))
    # The likeliest pair of each two components comes first: where it links, the others needn't be looked at.
    best = written(across(grouped(found, components(near)), classes, percent, True))
    near = written(near.unionByName(verified(best, classes, with_id, words, percent, clashing)))
    rest = across(grouped(found, components(near)), classes, percent, False)
    tried = stars.select(F.least("a", "b").alias("a2"), F.greatest("a", "b").alias("b2")).unionByName(best.select(F.least("a", "b").alias("a2"), F.greatest("a", "b").alias("b2")))
    rest = rest.join(tried, (F.col("a") == F.col("a2")) & (F.col("b") == F.col("b2")), "left_anti")
    more = verified(written(rest), classes, with_id, words, percent, clashing)
    roots = written(components(near.unionByName(more)))
    named = classes.join(roots, F.col("k") == F.col("node"), "left").select("k", "first", F.coalesce("root", "k").alias("root"))
    least = named.groupBy("root").agg(F.min("first").alias("least")).withColumnRenamed("root", "r")
    told = written(named.join(least, F.col("root") == F.col("r")).select(F.col("k").alias("k2"), "least"))
    out = keys.select("i", "n", "k").join(told, F.col("k") == F.col("k2"), "left")
    return out.select(F.col("i").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("i").isNotNull(), F.coalesce("least", "i")).alias("component_id"))


def op4_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(documents(spark, sf_dir))


OP4_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
                          ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda p: array_to_string(ws[p : p + 4], ' '))) END AS sh FROM w),
n AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS h FROM s),
f AS (SELECT n.*, row_number() OVER (PARTITION BY doc_id ORDER BY cnt, h) AS r FROM n JOIN (SELECT h, count(*) AS cnt FROM n GROUP BY h) USING (h)),
x AS (SELECT * FROM f WHERE r <= n - ceil(0.8 * n) + 1),
c AS (SELECT DISTINCT a.doc_id AS a, b.doc_id AS b FROM x a JOIN x b ON a.h = b.h AND a.doc_id < b.doc_id WHERE 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)),
p AS (SELECT a, b FROM c JOIN s sa ON sa.doc_id = a JOIN s sb ON sb.doc_id = b
      WHERE 100 * len(list_intersect(sa.sh, sb.sh)) >= 80 * (len(sa.sh) + len(sb.sh) - len(list_intersect(sa.sh, sb.sh)))),
e AS (SELECT a, b FROM p UNION SELECT b, a FROM p),
t AS (SELECT doc_id AS v, doc_id AS c FROM documents UNION SELECT e.b, t.c FROM t JOIN e ON e.a = t.v WHERE t.c < e.b)
SELECT s.doc_id, len(sh)::BIGINT AS n_shingles, m.c AS component_id FROM s JOIN (SELECT v, min(c) AS c FROM t GROUP BY v) m ON m.v = s.doc_id
"""
