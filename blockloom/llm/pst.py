"""LM scoring: a probabilistic suffix tree over the bytes of a text's words.

A text is the sequence of its words, each ended by a space, and one end symbol. The tree holds contexts
of up to DEPTH bytes that occur LEAST times or more (on small corpora, in a share LEAST_SHARE of all positions) and whose next-symbol distribution diverges from that of
their longest suffix; their suffixes are kept, too. Distributions are smoothed towards those of the
suffix. The tree grows with the corpus, so Spark makes it, a level after the other. Contexts in a share HEAD_SHARE of all positions,
TREE_HEAD rows at most, go to every task, which looks each different run of symbols up once a slice. Longer contexts than
those are told by a bitmap of fixed size and joined: what each adds to the logarithm is a sum over contexts.

Word counts for the base score come from all training texts: frequent words, a bounded number, go to
every task; the rest is joined.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property
from math import ceil

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import as_bytes, documents, hashed, mixed, slices, split_words, tidy, written
from .quality import held_out

DEPTH, LEAST, LEAST_SHARE, DIVERGENCE, SMOOTH = 6, 30, 1e-5, 0.002, 30.0
SPACE, END = 0x20, 0x0A
#: The most words whose counts go to every task (16 MB).
HEAD = 1_000_000
#: The most (context, symbol) rows of the tree that go to every task (50 MB), and the bits that tell of other contexts (16 MB).
TREE_HEAD, BITS = 3_000_000, 27
#: Contexts in a smaller share of all positions are joined even where there is room for them, so that every size of corpus is split at the same place.
HEAD_SHARE = 4e-7
#: Positions or words that a task holds before it sums them up.
HELD = 1_500_000
#: Bytes of text whose positions are looked up together, beyond one text.
TOGETHER = 1_000_000


class Sums:
    """Counts by 64-bit key: new keys are sorted HELD at a time and merged into those counted before."""

    def __init__(self) -> None:
        self.new: list[np.ndarray] = []
        self.size = 0
        self.keys, self.counts = np.empty(0, np.uint64), np.empty(0, np.int64)

    def add(self, keys: np.ndarray) -> None:
        self.new.append(keys)
        self.size += len(keys)
        if self.size >= HELD:
            self.settle()

    def settle(self) -> None:
        if not self.size:
            return
        new = np.sort(np.concatenate(self.new))
        first = np.flatnonzero(np.r_[True, new[1:] != new[:-1]])
        counts = np.diff(np.r_[first, len(new)])
        new = new[first]
        at = np.searchsorted(self.keys, new)
        old = np.zeros(len(new), bool)
        inside = at < len(self.keys)
        old[inside] = self.keys[at[inside]] == new[inside]
        self.counts[at[old]] += counts[old]
        self.keys, self.counts = np.insert(self.keys, at[~old], new[~old]), np.insert(self.counts, at[~old], counts[~old])
        self.new, self.size = [], 0

    def full(self) -> bool:
        return len(self.keys) >= HELD

    def take(self, names: list[str]) -> Iterator[pa.RecordBatch]:
        self.settle()
        if len(self.keys):
            yield pa.RecordBatch.from_arrays([pa.array(self.keys.view(np.int64)), pa.array(self.counts)], names=names)
        self.__init__()


def spelled(words: list[bytes], depth: int) -> bytes:
    """The symbols of a text, after `depth` end symbols that stand for nothing before it."""
    return b"\n" * depth + (b" ".join(words) + b" " if words else b"") + b"\n"


def mask(d: int, depth: int) -> int:
    """The bits of a context's d newest symbols; a context has nine bits a symbol, the newest highest: 0 for none, the byte + 1."""
    return ((1 << 9 * d) - 1) << 9 * (depth - d)


def runs_of(texts: list[list[bytes]], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(context << 8 | symbol of each position of all texts, end to end; number of positions of each text)."""
    parts = [np.frombuffer(spelled(ws, depth), np.uint8) for ws in texts]
    flat = np.concatenate(parts).astype(np.int64)
    key = flat[depth:].copy()
    flat += 1
    for j in range(1, depth + 1):
        key |= flat[depth - j : len(flat) - j] << (9 * (depth - j) + 8)
    # Runs that end inside the padding of a text are not its own.
    n = np.fromiter(map(len, parts), np.int64, len(parts))
    first = (np.cumsum(n) - n)[1:]
    own = np.ones(len(key), bool)
    own[(first[:, None] + np.arange(depth)).ravel() - depth] = False
    return key[own], n - depth


def different(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the sorted different values, the place of each value among them); by a table of hashes, and by bisection for values whose slot another one has."""
    each = np.sort(x)
    each = each[np.r_[True, each[1:] != each[:-1]]] if len(each) else each
    bits = len(each).bit_length() + 2
    slot = lambda v: (v.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - bits)).view(np.int64)
    table = np.zeros(1 << bits, np.int32)
    table[slot(each)] = np.arange(len(each), dtype=np.int32)
    place = table[slot(x)]
    other = np.flatnonzero(each[place] != x) if len(x) else np.empty(0, np.intp)
    place[other] = np.searchsorted(each, x[other])
    return each, place


def counted(d: DataFrame, what: str, depth: int = DEPTH) -> DataFrame:
    """(t binary) -> (k, c): counts of words' hashes, or of contexts of `depth` symbols and the next symbol."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = Sums()
        for batch in batches:
            for start, end in slices(batch, 0, TOGETHER):
                texts = batch.column(0).slice(start, end - start).to_pylist()
                if what == "words":
                    sums.add(hashed(texts, lower=True)[0])
                else:
                    sums.add(runs_of([split_words(t, lower=True) for t in texts], depth)[0].view(np.uint64))
                if sums.full():
                    yield from sums.take(["k", "c"])
        yield from sums.take(["k", "c"])

    return d.mapInArrow(run, "k long, c long").repartition("k").groupBy("k").agg(F.sum("c").alias("c"))


class Suffixes:
    """Sorted contexts, closed under suffixes, from the empty one on: the longest that ends another context."""

    def __init__(self, contexts: np.ndarray, depth: int):
        self.contexts, self.depth = contexts, depth
        self.length = sum((contexts & mask(d, depth) != contexts for d in range(depth)), np.zeros(len(contexts), np.int8))
        self.above = np.zeros(len(contexts), np.int32)  # the suffix that is shorter by one
        for d in range(1, depth + 1):
            of = self.length == d
            self.above[of] = np.searchsorted(contexts, contexts[of] & mask(d - 1, depth))

    def longest(self, contexts: np.ndarray) -> np.ndarray:
        """The one before a context in the order shares its longest suffix with it."""
        at = np.searchsorted(self.contexts, contexts, side="right") - 1
        unlike = contexts ^ self.contexts[at]
        same = np.zeros(len(at), np.intp)
        for d in range(self.depth):
            same += unlike < 1 << 9 * d
        live = np.flatnonzero(self.length[at] > same)
        while len(live):
            at[live] = self.above[at[live]]
            live = live[self.length[at[live]] > same[live]]
        return at


class SuffixAutomaton:
    """A suffix tree in memory: contexts, what they add for symbols not seen after them, and log10 probabilities of the seen."""

    def __init__(self, root: np.ndarray, contexts: np.ndarray, symbols: np.ndarray, sizes: np.ndarray, logs: np.ndarray, depth: int, smooth: float = SMOOTH):
        """root: counts of the 256 symbols; then a row for each context but the empty one and each symbol seen after it."""
        self.depth = depth
        self.root = np.log10((root + 0.1) / (root.sum() + 25.6))
        self.suffixes = Suffixes(np.unique(np.r_[0, contexts]), depth)
        at = np.searchsorted(self.suffixes.contexts, contexts)
        back = np.zeros(len(self.suffixes.contexts))
        back[at] = np.log10(smooth / (sizes + smooth))
        self.back = back.astype(np.float32)
        pairs = (at << 8 | symbols).astype(np.uint32)  # far fewer than 2**24 contexts
        order = np.argsort(pairs)
        self.pairs, self.logs = pairs[order], logs[order].astype(np.float32)
        self.alphabet = sorted({int(x) for x in np.flatnonzero(root)} | {SPACE, END})
        self.symbol = np.zeros(256, np.intp)
        self.symbol[self.alphabet] = np.arange(1, len(self.alphabet) + 1)

    def look(self, runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(log10 of the probability of each run's symbol after its context, length of the longest suffix held)."""
        state, x = self.suffixes.longest(runs >> 8), runs & 255
        length, out = self.suffixes.length[state], np.zeros(len(runs))
        live = np.arange(len(runs))
        for _ in range(self.depth):
            live = live[state[live] > 0]
            key = (state[live] << 8 | x[live]).astype(np.uint32)
            at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
            seen = self.pairs[at] == key if len(live) else np.zeros(0, bool)
            out[live[seen]] += self.logs[at[seen]]
            state[live[seen]] = -1
            live = live[~seen]
            out[live] += self.back[state[live]]
            state[live] = self.suffixes.above[state[live]]
        out[state == 0] += self.root[x[state == 0]]
        return out, length

    def scores(self, texts: list[list[bytes]]) -> np.ndarray:
        """log10 of the probability of each text: its words and its end."""
        runs, n = runs_of(texts, self.depth)
        each, at = different(runs)
        return np.bincount(np.repeat(np.arange(len(texts)), n), self.look(each)[0][at], len(texts))

    @cached_property
    def states(self) -> Suffixes:
        """Contexts and their beginnings, so that a state and a symbol determine the next state."""
        contexts, each = self.suffixes.contexts, [self.suffixes.contexts]
        for _ in range(self.depth):  # without the newest symbol
            contexts = contexts << 9 & mask(self.depth, self.depth)
            each.append(contexts)
        return Suffixes(np.unique(np.concatenate(each)), self.depth)

    @cached_property
    def step(self) -> np.ndarray:
        """step[state, symbol], to look at small trees; symbol 0 stands for all bytes never seen."""
        out = np.zeros((len(self.states.contexts), len(self.alphabet) + 1), np.int32)
        for x in self.alphabet:
            out[:, self.symbol[x]] = self.states.longest(self.states.contexts >> 9 | (x + 1) << 9 * (self.depth - 1))
        return out

    @cached_property
    def log(self) -> np.ndarray:
        """log10 probability[state, symbol], to look at small trees."""
        never = [x for x in range(256) if not self.symbol[x]][:1]
        out = np.zeros((len(self.states.contexts), len(self.alphabet) + 1), np.float32)
        for x in never + self.alphabet:
            out[:, self.symbol[x]] = self.look(self.states.contexts << 8 | x)[0]
        return out

    @property
    def start(self) -> int:
        state = 0
        for _ in range(self.depth):
            state = int(self.step[state, self.symbol[END]])
        return state


def grown(d: DataFrame, depth: int, least: int, share: float, divergence: float) -> tuple[np.ndarray, DataFrame]:
    """(counts of the 256 symbols, the tree from all texts of d (t binary)).

    The tree is (context, x, n, p, shorter): for each context kept and symbol seen after it, the context's
    count, the symbol's probability and that after the suffix that is shorter by one.
    """
    runs = written(counted(d, "runs", depth))
    root = np.zeros(256)
    for r in runs.groupBy(F.col("k").bitwiseAND(F.lit(255)).alias("x")).agg(F.sum("c").alias("c")).collect():
        root[r["x"]] = r["c"]
    total = root.sum()
    least = min(least, share * total)
    # Counts of each length come from those of the next longer one; a context has 256 rows at most.
    counts = {}
    rows = runs.select(F.shiftright("k", 8).alias("context"), F.col("k").bitwiseAND(F.lit(255)).alias("x"), "c")
    for j in range(depth, 0, -1):
        if j < depth:
            rows = rows.groupBy(F.col("context").bitwiseAND(F.lit(mask(j, depth))).alias("context"), "x").agg(F.sum("c").alias("c"))
        rows = written(rows.withColumn("n", F.sum("c").over(Window.partitionBy("context"))))
        counts[j] = rows.where(F.col("n") >= least)
    before = d.sparkSession.createDataFrame([(0, x, float((root[x] + 0.1) / (total + 25.6))) for x in range(256)], "suffix long, x2 long, shorter double")
    levels = None
    for j in range(1, depth + 1):
        suffix = F.col("context").bitwiseAND(F.lit(mask(j - 1, depth)))
        level = counts[j].join(before, (suffix == F.col("suffix")) & (F.col("x") == F.col("x2")))
        level = written(level.select("context", "x", "c", "n", "shorter", ((F.col("c") + SMOOTH * F.col("shorter")) / (F.col("n") + SMOOTH)).alias("p")))
        before = level.select(F.col("context").alias("suffix"), F.col("x").alias("x2"), F.col("p").alias("shorter"))
        levels = level if levels is None else levels.unionByName(level)
    own = F.col("c") / F.col("n")
    apart = levels.groupBy("context").agg(F.sum(own * F.log(own / F.col("shorter"))).alias("far")).where(F.col("far") >= divergence)
    # With all their suffixes; the empty one is the root.
    kept = apart.select(F.explode(F.array(*(F.col("context").bitwiseAND(F.lit(mask(j, depth))) for j in range(1, depth + 1)))).alias("context2")).distinct()
    return root, written(levels.join(kept, F.col("context") == F.col("context2")).select("context", "x", "n", "p", "shorter"))


def frequent_part(tree: DataFrame, root: np.ndarray, depth: int, head: int, share: float = 0.0) -> tuple[SuffixAutomaton, int]:
    """(the tree's contexts in a `share` of all positions and often enough for `head` rows at most, the least count of theirs). Suffixes are as frequent."""
    least, many = 1 << 62, 0
    for r in tree.groupBy(F.floor(F.log2("n") * 16).alias("b")).agg(F.count("*").alias("rows"), F.min("n").alias("least")).orderBy(F.desc("b")).collect():
        many += r["rows"]
        if many > head:
            break
        least = r["least"]
    least = max(least, ceil(share * root.sum()))
    got = tree.where(F.col("n") >= least).select(F.shiftleft("context", 8).bitwiseOR(F.col("x")).alias("k"), "n", F.log10("p").cast("float").alias("log")).toArrow()
    k, n, log = (got[c].to_numpy() for c in ("k", "n", "log"))
    return SuffixAutomaton(root, k >> 8, k & 255, n, log, depth), least


def learn_tree(d: DataFrame, *, depth: int = DEPTH, least: int = LEAST, share: float = LEAST_SHARE, divergence: float = DIVERGENCE, head: int = TREE_HEAD) -> SuffixAutomaton:
    """A tree from all texts of d (t binary), of contexts that occur `least` times or in a `share` of all positions; of these the most frequent, `head` rows at most."""
    root, tree = grown(d, depth, least, share, divergence)
    return frequent_part(tree, root, depth, head)[0]


def bit_of(contexts: np.ndarray) -> np.ndarray:
    return (mixed(contexts.view(np.uint64)) >> np.uint64(64 - BITS)).astype(np.int64)


def bitmap(contexts: DataFrame) -> np.ndarray:
    """2**BITS bits, as bytes; bit_of(context) is set for each (context)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(bit_of(batch.column(0).to_numpy()))], names=["bit"])

    bits = contexts.mapInArrow(run, "bit long")
    word = F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("bits")
    got = bits.groupBy(F.shiftright("bit", 6).alias("word")).agg(word).toArrow()
    out = np.zeros(1 << (BITS - 6), np.int64)
    out[got["word"].to_numpy()] = got["bits"].to_numpy()
    return out


@tidy
def score_texts(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", folds: int = 10, fold: int = 0, head: int = HEAD, tree_head: int = TREE_HEAD, head_share: float = HEAD_SHARE) -> DataFrame:
    """Score every whole text, learning from those outside the held-out fold.

    Returns id, held_out, n_tokens, n_known, train_tokens, base_score, score. Null texts are empty: one
    token, the end. Words and contexts are told by 64 bits; ids are whole numbers (else the cast fails). Rows without an id are learned from and not held out; rows may repeat and each counts;
    an empty table gives none; other columns are not looked at. With nothing to learn from, every base
    probability is 1 and the tree is its smoothed root.
    """
    spark = docs.sparkSession
    d = docs.select(F.col(id_col).cast("long").alias("i"), as_bytes(text_col).alias("t"), held_out(id_col, folds, fold).alias("held_out"))
    train = d.where(~F.col("held_out")).select("t")
    root, grown_tree = grown(train, DEPTH, LEAST, LEAST_SHARE, DIVERGENCE)
    automaton, least_n = frequent_part(grown_tree, root, DEPTH, tree_head, head_share)
    tail = grown_tree.where(F.col("n") < least_n)
    beyond = bitmap(tail.select("context").distinct()) if tail.limit(1).count() else None
    joined = beyond is not None
    tree = spark.sparkContext.broadcast((automaton, beyond))
    del automaton, beyond
    words = written(counted(train, "words"))
    ends = train.count()
    row = words.agg(F.sum("c"), F.count("c")).head()
    total, distinct = (row[0] or 0) + ends, row[1] + (ends > 0)
    below = total + 0.1 * (distinct + 1)
    # The least count of words that every task knows: as many words as `head` allows.
    least, many = 1 << 62, 0
    for r in words.groupBy(F.floor(F.log2("c") * 16).alias("b")).agg(F.count("*").alias("n"), F.min("c").alias("least")).orderBy(F.desc("b")).collect():
        many += r["n"]
        if many > head:
            break
        least = r["least"]
    table = words.where(F.col("c") >= least).toArrow()
    keys, counts = table["k"].to_numpy().view(np.uint64), table["c"].to_numpy()
    order = np.argsort(keys)
    frequent = spark.sparkContext.broadcast((keys[order], np.log10((counts[order] + 0.1) / below)))
    end_score = float(np.log10((ends + 0.1) / below))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (automaton, beyond), (keys, logs) = tree.value, frequent.value
        for batch in batches:
            for start, end in slices(batch, 1, TOGETHER):
                part = batch.slice(start, end - start)
                raw = part.column(1).to_pylist()
                flat, n = hashed(raw, lower=True)
                texts = [split_words(t, lower=True) for t in raw]
                runs, size = runs_of(texts, DEPTH)
                each, place = different(runs)
                log, length = automaton.look(each)
                text = np.repeat(np.arange(len(texts)), size)
                score = np.bincount(text, log[place], len(texts))
                deep, holder = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
                if beyond is not None:
                    longest = length.copy()  # of the suffixes that may be in the tree
                    for d in range(1, DEPTH + 1):
                        at = np.flatnonzero(longest == d - 1)
                        bit = bit_of(each[at] >> 8 & mask(d, DEPTH))
                        longest[at[beyond[bit >> 6] >> (bit & 63) & 1 > 0]] = d
                    found = np.flatnonzero((longest > length)[place])
                    kind, of = place[found], text[found]
                    for d in range(1, DEPTH + 1):
                        take = (length[kind] < d) & (longest[kind] >= d)
                        deep.append(each[kind[take]] & (mask(d, DEPTH) << 8 | 255))
                        holder.append(of[take])
                holder = np.concatenate(holder)
                deep = np.concatenate(deep)[np.argsort(holder, kind="stable")]
                ends_of = np.r_[0, np.cumsum(np.bincount(holder, minlength=len(texts)))].astype(np.int32)
                deep_of = pa.ListArray.from_arrays(pa.array(ends_of, pa.int32()), pa.array(deep))
                names = [xxhash.xxh3_128_intdigest(b" ".join(ws)) for ws in texts]
                at = np.searchsorted(keys, flat)
                hit = keys[np.minimum(at, len(keys) - 1)] == flat if len(keys) else np.zeros(len(flat), bool)
                of = np.repeat(np.arange(len(texts)), n)
                base = np.bincount(of[hit], logs[at[hit]], len(texts)) + end_score
                sure = np.bincount(of[hit], minlength=len(texts)) + (ends > 0)
                rare, owner = flat[~hit], of[~hit]
                edges = np.r_[0, np.cumsum(np.bincount(owner, minlength=len(texts)))].astype(np.int32)
                words_of = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(rare.view(np.int64)))
                halves = [pa.array(np.array([x >> s & (1 << 64) - 1 for x in names], np.uint64).view(np.int64)) for s in (0, 64)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(n + 1), pa.array(sure.astype(np.int64)), pa.array(base), pa.array(score), *halves, words_of, deep_of], names=["i", "held_out", "n_tokens", "sure", "base", "score", "a", "b", "rare", "deep"])

    made = written(d.mapInArrow(run, "i long, held_out boolean, n_tokens long, sure long, base double, score double, a long, b long, rare array<long>, deep array<long>"))
    tree.unpersist()
    frequent.unpersist()
    # Equal texts have equal rare words and contexts, which are looked up once.
    once = lambda name: made.where(F.size(name) > 0).select("a", "b", name).dropDuplicates(["a", "b"]).select(F.col("a").alias("a2"), F.col("b").alias("b2"), F.explode(name).alias("w"))
    rest = words.where(F.col("c") < least)
    looked = once("rare").join(rest, F.col("w") == F.col("k"), "left").select("a2", "b2", F.coalesce("c", F.lit(0)).alias("c"))
    looked = looked.select("a2", "b2", F.log10((F.col("c") + 0.1) / below).alias("more"), (F.col("c") > 0).cast("long").alias("seen"), F.lit(0.0).alias("deeper"))
    if joined:
        # What a context adds to its suffix's logarithm, for each symbol seen after it and for all others.
        gain = F.map_from_entries(F.collect_list(F.struct("x", F.log10(F.col("p") / F.col("shorter")).alias("gain")))).alias("gains")
        gains = tail.groupBy("context").agg(gain, F.max(F.log10(SMOOTH / (F.col("n") + SMOOTH))).alias("other"))
        found = once("deep").join(gains, F.shiftright("w", 8) == F.col("context"))
        looked = looked.unionByName(found.select("a2", "b2", F.lit(0.0).alias("more"), F.lit(0).cast("long").alias("seen"), F.coalesce(F.try_element_at("gains", F.col("w").bitwiseAND(F.lit(255))), "other").alias("deeper")))
    looked = looked.groupBy("a2", "b2").agg(F.sum("more").alias("more"), F.sum("seen").alias("seen"), F.sum("deeper").alias("deeper"))
    looked = written(looked)  # so that both sides of the join are dealt anew, and a text with very many copies can be split
    out = made.join(looked, (F.col("a") == F.col("a2")) & (F.col("b") == F.col("b2")), "left")
    return out.select(F.col("i").alias(id_col), "held_out", "n_tokens", (F.col("sure") + F.coalesce("seen", F.lit(0))).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"), (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"), (F.col("score") + F.coalesce("deeper", F.lit(0.0))).alias("score"))


def op6_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(documents(spark, sf_dir))
