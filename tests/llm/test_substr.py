import hashlib
import random
import re

import pytest

from blockloom.llm import substr

SCHEMA = "doc_id long, text string, hs string, h string"


def brute(rows, width=13):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    least = {}
    for (i, _), w in zip(rows, words, strict=True):
        for p in range(len(w) - width + 1):
            if i is not None:
                key = tuple(w[p : p + width])
                least[key] = min(least.get(key, i), i)
    for (i, _), w in zip(rows, words, strict=True):
        gone = set()
        for p in range(len(w) - width + 1):
            if i is not None and least[tuple(w[p : p + width])] < i:
                gone.update(range(p, p + width))
        kept = " ".join(x for p, x in enumerate(w) if p not in gone)
        yield i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept


def check(spark, rows, width=13):
    d = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)
    got = substr.dedup_substrings(d, width=width).collect()
    assert sorted((tuple(r)[:5] for r in got), key=str) == sorted(brute(rows, width), key=str)
    for r in got:
        assert sum(b - a for a, b in r.spans) == r.n_removed
        assert all(b < c for (_, b), (c, _) in zip(r.spans, r.spans[1:], strict=False))


@pytest.mark.parametrize("held", [1_500_000, 50])
def test_against_all_windows(spark, monkeypatch, held):
    monkeypatch.setattr(substr, "HELD", held)
    rng = random.Random(3)
    passages = [[rng.choice("abcdefg") for _ in range(n)] for n in (13, 14, 30, 60)]
    texts = []
    for _ in range(150):
        words = []
        for _ in range(rng.randrange(5)):
            words += [str(rng.randrange(10**6)) for _ in range(rng.randrange(30))]
            p = rng.choice(passages)
            words += p[rng.randrange(3) :]
        texts.append(" \n"[rng.randrange(2)].join(words))
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    check(spark, rows)


def test_few_words_many_repeats(spark):
    rng = random.Random(4)
    check(spark, [(n, " ".join(rng.choice("ab") for _ in range(rng.randrange(60)))) for n in range(60)])
    check(spark, [(n, "x " * n) for n in range(40)])


def test_nulls_ties_and_long_texts(spark):
    long = " ".join(f"w{k}" for k in range(9000))
    part = " ".join(f"w{k}" for k in range(100, 140))
    check(spark, [(5, long), (3, part), (9, long), (9, long), (None, long), (1, None), (2, ""), (4, " \t "), (7, long + " END"), (7, "q " + part), (-1, "Ä" + part)])
    check(spark, [])


def test_width_of_its_own(spark):
    check(spark, [(1, "a b c d e f g"), (2, "x b c d e f y"), (3, "f g")], width=5)


def test_minimum_of_runs():
    import numpy as np

    x = np.random.default_rng(0).integers(0, 99, 50)
    for width in range(1, 14):
        assert substr.least_in_runs(x, width).tolist() == [x[i : i + width].min() for i in range(50 - width + 1)]


@pytest.mark.parametrize("size", [20, 22, 29])
def test_bitmaps_of_all_sizes(size):
    import numpy as np

    bits = np.zeros(1 << (size - 3), np.uint8)
    x = np.random.default_rng(1).integers(0, 1 << 64, 1000, np.uint64)
    for k in (x >> np.uint64(64 - size)).tolist():
        bits[k // 8] |= 128 >> k % 8
    assert substr.has_bit(bits, x).all() and substr.has_bit(bits, ~x).mean() < 0.01
    assert substr.bits_for(0) == 20 and substr.bits_for(10**6) == 24 and substr.bits_for(10**12) == 29


def test_windows_whose_first_hashes_meet(spark, monkeypatch):
    """With a first hash of 4 bits the second one tells windows apart; inside a document the words do."""
    import numpy as np

    real, plain, few = substr.rolling, substr.BASE, np.uint64(15)
    monkeypatch.setattr(substr, "rolling", lambda w, width, base=plain: real(w, width, base) & few if base == plain and width == 13 else real(w, width, base))
    one, two = (" ".join(f"{c}{k}" for k in range(13)) for c in "ab")
    rows = [(n, f"{one if n % 3 else two} {n}" if n % 2 else " ".join(f"{n}_{k}" for k in range(13))) for n in range(40)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    lost = {r.i for r in substr.losses(d.selectExpr("doc_id i", "cast(text as binary) t"), 13, 5).collect()}
    want = {i for i, _, gone, _, _ in brute(rows) if gone}
    assert lost == want and len(want) == 18
