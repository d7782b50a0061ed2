import re
import zlib
from collections import Counter
from math import log, log10

import pytest
from pyspark.sql import functions as F

from blockloom.llm.pst import DEPTH, SuffixAutomaton, learn_tree, score_texts, spelled

SCHEMA = "doc_id long, text string, score double, held_out string"


def words_of(text):
    small = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", small)


def brute(rows):
    out_of = lambda i: i is not None and zlib.crc32(str(i).encode()) % 10 == 0
    known = Counter()
    for i, text in rows:
        if not out_of(i):
            known.update([*words_of(text), "\n"])
    total, distinct = sum(known.values()), len(known)
    for i, text in rows:
        tokens = [*words_of(text), "\n"]
        base = sum(log10((known[w] + 0.1) / (total + 0.1 * (distinct + 1))) for w in tokens)
        yield i, out_of(i), len(tokens), sum(known[w] > 0 for w in tokens), total, pytest.approx(base, rel=1e-9, abs=1e-9)


def check(spark, rows, **options):
    d = spark.createDataFrame([(i, t, 1.0, "x") for i, t in rows], SCHEMA)
    got = score_texts(d, **options).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[2], r[3])
    assert [tuple(r)[:6] for r in sorted(got, key=key)] == sorted(brute(rows), key=key)
    assert all(r.score < 0 for r in got)
    return got


@pytest.mark.parametrize("head", [1_000_000, 50])
def test_base_score_against_counting(spark, small, head):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
    check(spark, rows, head=head)


def test_held_out_texts_are_likelier_than_by_word_counts(spark):
    got = score_texts(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).where("held_out").toPandas()
    assert len(got) > 50 and got.score.sum() > got.base_score.sum()


def test_nulls_ties_and_long_texts(spark):
    long = "Ab cd\n" * 3000
    check(spark, [(None, "A a"), (1, None), (2, ""), (2, ""), (3, " \t"), (4, "a b a"), (4, "a b a"), (5, long), (6, "é É <x>"), (7, long + "z")])


def test_empty_table_and_nothing_to_learn_from(spark):
    assert score_texts(spark.createDataFrame([], SCHEMA)).collect() == []
    (i,) = [i for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0][:1]
    check(spark, [(i, "a b")])


def test_probabilities_add_up_and_longest_suffix_is_used(spark):
    texts = ["abab abba baab"] * 5 + ["ab ba"] * 7
    tree = learn_tree(spark.createDataFrame([(bytearray(t, "ascii"),) for t in texts], "t binary"), share=1e-3)
    assert isinstance(tree, SuffixAutomaton)
    used = (tree.symbol > 0).sum()
    mass = (10 ** tree.log[:, 1:].astype(float)).sum(axis=1) + (256 - used) * 10 ** tree.log[:, 0].astype(float)
    assert mass == pytest.approx(1, abs=1e-4)
    # step by step from the start, the automaton and the windows agree, however long the text
    for words in ([b"abab"], [b"ab", b"q"] * 700, []):
        state, total = tree.start, 0.0
        for b in spelled(words, DEPTH)[DEPTH:]:
            total += float(tree.log[state, tree.symbol[b]])
            state = tree.step[state, tree.symbol[b]]
        assert tree.scores([words, [b"x"]])[0] == pytest.approx(total, rel=1e-5)


def test_clashing_names_are_ignored(spark):
    d = spark.createDataFrame([(1, "a b")], "doc_id long, text string").withColumns({c: F.lit("x") for c in ("i", "t", "k", "c", "rare", "score")})
    assert score_texts(d).count() == 1


def test_a_context_counts_however_large_the_corpus(spark):
    # 40 of 5 million positions: less than a share of 1e-5
    d = spark.range(500).selectExpr("cast(repeat('ab ba ', 1700) as binary) t").unionByName(spark.range(40).selectExpr("cast('xqzvkwjp' as binary) t"))
    assert learn_tree(d).scores([[b"xqzvkwjp"]])[0] > -8


def test_contexts_that_are_joined_score_as_those_in_every_task(spark):
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want, some, none = ({r.doc_id: r.score for r in score_texts(d, tree_head=n).collect()} for n in (10**7, 3000, 0))
    assert some == pytest.approx(want, rel=1e-5)
    assert none == pytest.approx(want, rel=1e-5)
    assert {r.doc_id: r.score for r in score_texts(d, head_share=1e-4).collect()} == pytest.approx(want, rel=1e-5)


def plain_tree(texts, depth=DEPTH, least=3, divergence=0.002, smooth=30.0):
    """The tree from its meaning, in dictionaries: contexts and next symbols, kept by count and divergence, smoothed towards their suffixes."""
    counts = Counter()
    for t in texts:
        s = "\n" * depth + "".join(w + " " for w in words_of(t)) + "\n"
        for i in range(depth, len(s)):
            for n in range(depth + 1):
                counts[s[i - n : i], s[i]] += 1
    after = {}
    for (context, x), c in counts.items():
        after.setdefault(context, {})[x] = c
    total = sum(after[""].values())
    root = lambda x: (after[""].get(x, 0) + 0.1) / (total + 25.6)
    often = {c: sum(d.values()) for c, d in after.items() if c and sum(d.values()) >= least}

    def p(context, x):
        return (after[context].get(x, 0) + smooth * (p(context[1:], x))) / (often[context] + smooth) if context else root(x)

    kept = {""}
    for context, n in often.items():
        if sum(c / n * log(c / n / p(context[1:], x)) for x, c in after[context].items()) >= divergence:
            kept |= {context[i:] for i in range(len(context))}

    def score(text):
        s, out = "\n" * depth + "".join(w + " " for w in words_of(text)) + "\n", 0.0
        for i in range(depth, len(s)):
            context = next(s[i - n : i] for n in range(depth, -1, -1) if s[i - n : i] in kept)
            out += log10(p(context, s[i]))
        return out

    return kept, score


@pytest.mark.parametrize("divergence", [0.002, 0.3])
def test_learning_and_scores_against_dictionaries(spark, divergence):
    import random

    rng = random.Random(5)
    texts = [" ".join(rng.choice(["ab", "ba", "abc", "Cab", "bb"]) for _ in range(rng.randrange(12))) for _ in range(60)] + [None, ""]
    kept, score = plain_tree(texts, least=3, divergence=divergence)
    d = spark.createDataFrame([(None if t is None else bytearray(t, "ascii"),) for t in texts], "t binary")
    tree = learn_tree(d, least=3, share=1.0, divergence=divergence)
    assert len(tree.suffixes.contexts) == len(kept)
    for t in texts[:20] + ["", "zz top", "abcabc bba cab"]:
        assert tree.scores([[w.encode() for w in words_of(t)]])[0] == pytest.approx(score(t), rel=1e-5)


def test_scores_of_the_query_are_those_of_dictionaries(spark):
    rows = [(i, f"{'ab ba' if i % 3 else 'ba abb'} c{i % 4}" * (i % 5)) for i in range(120)]
    learned = [t for i, t in rows if zlib.crc32(str(i).encode()) % 10]
    positions = sum(len("".join(w + " " for w in words_of(t))) + 1 for t in learned)
    _, score = plain_tree(learned, least=min(30, 1e-5 * positions))
    got = {r.doc_id: r.score for r in score_texts(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: pytest.approx(score(t), rel=1e-5) for i, t in rows}


def test_distinct_values():
    import numpy as np

    from blockloom.llm.pst import different

    rng = np.random.default_rng(1)
    for x in (rng.integers(0, 1 << 62, 0), rng.integers(0, 3, 50), rng.integers(0, 1 << 62, 5000), rng.integers(0, 900, 20_000) << 50):
        each, place = different(x)
        assert (each == np.unique(x)).all() and (each[place] == x).all()
