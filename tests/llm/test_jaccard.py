import random
import re

import numpy as np
import pytest

from blockloom.llm import jaccard
from blockloom.llm.jaccard import jaccard_components, mixed, schemes, signatures

SCHEMA = "doc_id long, text string, n string, k string, root string"


def shingles(text):
    small = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", small)
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    classes = {}
    for (i, _), s in zip(rows, sets, strict=True):
        if i is not None and s:
            classes[s] = min(classes.get(s, i), i)
    keys = list(classes)
    group = {s: classes[s] for s in keys}
    links = [(a, b) for n, a in enumerate(keys) for b in keys[:n] if min(len(a), len(b)) * 100 >= 80 * max(len(a), len(b)) and 100 * len(a & b) >= 80 * len(a | b)]
    changed = True
    while changed:
        changed = False
        for a, b in links:
            if group[a] != group[b]:
                group[a] = group[b] = min(group[a], group[b])
                changed = True
    return sorted(((i, len(s), None if i is None else group.get(s, i) if s else i) for (i, _), s in zip(rows, sets, strict=True)), key=str)


def check(spark, rows):
    d = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA)
    assert sorted(map(tuple, jaccard_components(d).collect()), key=str) == brute(rows)


def edited(rng, words, share):
    return [rng.choice("abcdefghij") * 3 + str(rng.randrange(99)) if rng.random() < share else w for w in words]


def corpus(seed, groups):
    rng = random.Random(seed)
    texts = []
    passage = [f"p{k}" for k in range(40)]
    for _ in range(groups):
        size = rng.choice([3, 5, 6, 7, 8, 9, 12, 15, 25, 60, 150, 400])
        base = [rng.choice("qwertzuiop") + str(rng.randrange(500)) for _ in range(size)]
        texts.append(base)
        for _ in range(rng.choice([0, 0, 1, 2, 9])):
            share = rng.choice([0, 0.01, 0.02, 0.03, 0.05])
            copy = edited(rng, base, share)
            cut = rng.randrange(0, 1 + len(copy) // 8)
            texts.append(copy[cut:])
        if rng.random() < 0.2:
            texts.append(passage + base[: rng.randrange(1, 20)])
    rng.shuffle(texts)
    return [(n, (" " if n % 2 else "\n").join(w.upper() if n % 5 == 0 else w for w in t)) for n, t in enumerate(texts)]


@pytest.mark.parametrize("seed", range(2))
def test_against_all_pairs(spark, seed):
    check(spark, corpus(seed, 70))


def test_nulls_short_texts_and_repeats(spark):
    long = " ".join(f"w{k}" for k in range(9000))
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "a b"), (5, "A\tB "), (6, "a"), (7, "a b c d e"), (8, "a b c d e f"), (9, "b c d e f"), (10, long), (11, long + " x"), (11, long + " x"), (None, long), (None, "a b"), (12, "É b c d"), (13, "é b c d"), (11, "other text under one id"), (0, "a\x0bb")]
    check(spark, rows)
    check(spark, [])


def test_parts_and_cells_are_whole(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "PART", 4)
    monkeypatch.setattr(jaccard, "CELL", 3)
    monkeypatch.setattr(jaccard, "BROADCAST_CELLS", 0)
    rng = random.Random(7)
    base = [f"b{k}" for k in range(120)]
    chain, texts = base, []
    for k in range(60):  # each is near the last, the ends are far apart
        chain = [f"n{k}_{j}" if rng.random() < 0.01 else w for j, w in enumerate(chain)]
        texts.append(" ".join(chain))
        texts.append(" ".join(edited(rng, base, 0.03)))
    check(spark, list(enumerate(texts)))


@pytest.mark.parametrize("percent", [50, 80, 95])
def test_linked_sets_share_a_signature(percent):
    rng = np.random.default_rng(percent)
    for _ in range(400):
        x = int(rng.choice([rng.integers(1, 12), rng.integers(4, 60), rng.integers(60, 900)]))
        y = int(rng.integers(x, 100 * x // percent + 1))
        shared = -(-percent * (x + y) // (100 + percent))
        if shared > x or x == y == shared:
            continue
        values = mixed(rng.permutation(1 << 20)[: x + y - shared].astype(np.uint64))
        a, b = np.sort(values[:x]), np.sort(np.concatenate([values[:shared], values[x:]]))
        found = list(signatures(np.concatenate([a, b]), np.array([x, y]), percent))
        of, s = (np.concatenate(v) for v in zip(*found, strict=True))
        assert np.intersect1d(s[of == 0], s[of == 1]).size, (x, y, shared)


@pytest.mark.parametrize("levels", [1, 2, 3])
def test_linked_sets_share_a_signature_at_few_cuts(monkeypatch, levels):
    monkeypatch.setattr(jaccard, "LEVELS", levels)
    test_linked_sets_share_a_signature(80)


@pytest.mark.parametrize("size", [10, 20, 60, 100])
def test_unrelated_sets_do_not_meet(size):
    """No signature is shared for want of shingles: the largest bucket of random sets doesn't grow with their number."""
    rng = np.random.default_rng(size)
    for sets in (2000, 20_000):
        h = np.sort(rng.integers(0, 1 << 64, (sets, size), np.uint64), axis=1).ravel()
        found = np.concatenate([s for _, s in signatures(h, np.full(sets, size), 80)])
        assert np.unique(found, return_counts=True)[1].max() <= 2


def test_classes_whose_fingerprints_meet(spark, monkeypatch):
    real, few = jaccard.fingerprints, np.uint64(7)
    monkeypatch.setattr(jaccard, "fingerprints", lambda h, sizes, other=False: real(h, sizes, other) if other else real(h, sizes) & few)
    check(spark, corpus(5, 25))


def test_hot_signatures_meet_in_parts(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "HELD", 300)
    monkeypatch.setattr(jaccard, "PART", 8)
    check(spark, corpus(6, 60))


def test_schemes_cover_all_sizes_without_gaps():
    made = schemes(5000, 80)
    assert made[0].low == 4 and all(a.high == b.low for a, b in zip(made, made[1:], strict=False))
    assert all(s.top < n.high for s, n in zip(made, made[1:], strict=False))
    assert all(s.single + 2 * s.double == jaccard.most_different(s.high - 1, s.top, 80) + 1 + s.slack for s in made)
