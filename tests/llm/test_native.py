import re

import pytest
from pyspark.sql import functions as F

from blockloom.llm import mixing, urlfilter

URLS = [
    ("http://a.example.com/en/x", "a.example.com", "/en/x", "example.com/en/", "block"),
    ("http://WWW.Example.COM/en/x?q=1", "www.example.com", "/en/x", "www.example.com/en/", "allow"),
    ("https://m.www.example.com/en/", "m.www.example.com", "/en/", "www.example.com/en/", "allow"),
    ("https://example.com/EN/x", "example.com", "/EN/x", "com/", "allow"),
    ("https://example.com/en", "example.com", "/en", "com/", "allow"),
    ("https://notexample.com/en/", "notexample.com", "/en/", "com/", "allow"),
    ("http://com/", "com", "/", "com/", "allow"),
    ("http://x.net/es/1#a", "x.net", "/es/1", "net/es/", "block"),
    ("http://net/fr/", "net", "/fr/", "net/fr/", "block"),
    ("http://a.com?x=/en/", "a.com", "", None, None),
    ("http://a.com#/en/", "a.com", "", None, None),
    ("http://a.com:80/p", "a.com:80", "/p", None, None),
    ("http://x.net/de/1", "x.net", "/de/1", None, None),
    ("a://b://c/d", "b:", "//c/d", None, None),
    ("no url", "", "", None, None),
    ("://", "", "", None, None),
    ("", "", "", None, None),
    (None, "", "", None, None),
    ("http://É.com/Ä\n?", "É.com", "/Ä\n", "com/", "allow"),
    ("http://x.org/" + "a" * 5000, "x.org", "/" + "a" * 5000, None, None),
]


def score(host, path):
    bias, weights = urlfilter.fitted()
    slots = urlfilter.grams(host, path)
    return sum(weights[s] for s in slots) + bias * max(1, len(slots)) ** 0.5


def test_urls(spark):
    rows = [(n, u[0], "x", "y") for n, u in enumerate(URLS)] + [(None, URLS[0][0], "x", "y")] + [(0, URLS[0][0], "x", "y")]
    d = spark.createDataFrame(rows, "page_id long, url string, host string, w string")
    got = urlfilter.filter_urls(d).collect()
    assert len(got) == len(rows)
    for r in got:
        _, host, path, rule, verdict = URLS[r.page_id or 0]
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == (verdict or ("block" if score(host, path) > 0 else "allow"))
        assert r.score == pytest.approx(score(host, path))
    assert urlfilter.filter_urls(d.limit(0)).collect() == []
    plan = d._jdf and urlfilter.filter_urls(d)._jdf.queryExecution().toString()
    assert "Exchange" not in plan and "Python" not in plan


def test_model_knows_its_table():
    right = [(score(h, p) > 0) == bool(y) for h, p, y in urlfilter.LABELLED]
    assert sum(right) >= 0.95 * len(right)


def reshared(sizes, weights, most):
    """Targets by resharing the excess, again and again."""
    total, limit = sum(sizes), [most * s for s in sizes]
    share = [total * w / sum(weights) for w in weights]
    for _ in range(1000):
        over = sum(max(0, a - b) for a, b in zip(share, limit, strict=True))
        share = [min(a, b) for a, b in zip(share, limit, strict=True)]
        free = [k for k in range(len(sizes)) if share[k] < limit[k] - 1e-12 * limit[k]]
        if over < 1e-9 or not free:
            break
        for k in free:
            share[k] += over * weights[k] / sum(weights[j] for j in free)
    return share


def check(spark, rows, **options):
    d = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, source string, size long, band string")
    got = mixing.mix_sources(d, **options).collect()
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix_sources(d.repartition(3), **options).collect()))
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    names = sorted({s for _, _, s in rows if s is not None}) + [None] * any(s is None for _, _, s in rows)
    sizes = [sum(count(t) for _, t, x in rows if x == s) for s in names]
    want = dict(zip(names, reshared(sizes, [k % 3 + 1 for k in range(len(names))], 3), strict=True))
    by = {}
    source = {i: s for i, _, s in rows}
    for r in got:
        s = source[r.doc_id]
        assert r.source_size == sizes[names.index(s)]
        assert r.target == pytest.approx(want[s], abs=1e-6)
        assert r.size <= 0 or r.taken % r.size == 0 and r.taken <= 3 * r.size
        by.setdefault(s, []).append(r)
    for s, own in by.items():
        largest = max(r.size for r in own)
        assert abs(sum(r.taken for r in own) - want[s]) <= largest / 2 + 1e-6
    return got


def test_mix_of_uneven_sources(spark):
    rows = [(k, "w " * (k * 37 % 91 + 1), s) for k, s in enumerate(["a"] * 300 + ["b"] * 20 + ["c"] * 5 + ["é"] * 100 + ["Z"] * 40 + [None] * 10)]
    check(spark, rows)
    check(spark, [(i, t, "one") for i, t, _ in rows])


def test_mix_of_nulls_empties_and_repeats(spark):
    check(spark, [(1, None, "a"), (2, "", "a"), (3, "x", "b"), (3, "x", "b"), (4, " y\tz ", "b"), (5, "q " * 9000, "c"), (6, "q", None)])
    check(spark, [(1, None, "a"), (2, "", None)])
    assert mixing.mix_sources(spark.createDataFrame([], "doc_id long, text string, source string")).collect() == []
    d = spark.createDataFrame([(None, "a b", "s"), (None, "a b", "s"), (7, "c", "s")], "doc_id long, text string, source string")
    assert sum(r.taken for r in mixing.mix_sources(d).collect()) == 5


def test_large_documents_are_likelier(spark):
    """Inclusion odds are in proportion to size: among equal draws the larger half of a sample's documents is taken more often."""
    rows = [(k, "w " * (1 if k % 2 else 50), s) for k, s in enumerate(["a"] * 400 + ["b"] * 400 + ["c"] * 400)]
    got = mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    taken = {r.size: r.n for r in got.where("doc_id < 400").groupBy("size").agg(F.avg("copies").alias("n")).collect()}
    assert taken[50] > taken[1]


def test_rows_are_kept_with_their_copies(spark):
    d = spark.createDataFrame([(k, "w " * (k + 1), "ab"[k % 2], "e") for k in range(50)], "doc_id long, text string, source string, row string")
    want = {r.doc_id: r.copies for r in mixing.mix_sources(d).collect()}
    assert {r.row.doc_id: r.copies for r in mixing.mix_sources(d, keep_text=True).collect()} == want
    plan = mixing.mix_sources(d)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_inclusion_probabilities(spark):
    """Sources as repeated draws: a document of size s is in the sample with probability c s / (1 + c s)."""
    sizes = [1, 2, 4, 8, 16, 32] * 4
    rows = [(r * 100 + k, "w " * n, f"s{r:04}") for r in range(600) for k, n in enumerate(sizes)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix_sources(d).where("source_size <> target").groupBy("size", (F.col("target") / F.col("source_size")).alias("share")).agg(F.avg(F.col("copies") - F.floor(F.col("target") / F.col("source_size"))).alias("rate"), F.count("*").alias("n")).collect()
    assert sorted({round(r.share, 6) for r in got}) == [0.5, 1.5] and len(got) == 12
    low, high = 1e-6, 1e6
    for _ in range(200):
        c = (low * high) ** 0.5
        words = sum(c * s * s / (1 + c * s) for s in sizes)
        low, high = (c, high) if words < sum(sizes) / 2 else (low, c)
    for r in got:
        p = c * r["size"] / (1 + c * r["size"])
        # the sample ends at a whole document, which moves the rate a little
        assert abs(r.rate - p) < 4 * (p * (1 - p) / r.n) ** 0.5 + 0.04


@pytest.mark.parametrize("sizes", ["1", "1000000", "if(id % 10 = 0, 1000000, 1)", "pow(10, id % 7)"])
def test_bands_are_evenly_small(spark, sizes):
    u = mixing.uniform(9, F.col("id"))
    bands = spark.range(200_000).select(F.floor(mixing.BANDS * F.log2(u / (1 - u) / F.expr(sizes))).alias("band")).groupBy("band").count()
    assert bands.agg(F.max("count")).head()[0] < 100  # 34 expected at most


def test_targets_of_many_sources(spark, monkeypatch):
    rows = [(f"s{k:03}" if k else None, (k * 37 % 91) ** 3) for k in range(200)]
    sizes = spark.createDataFrame(rows, "source string, source_size long")
    want = {r.source: (r.weight, r.target) for r in mixing.targets(sizes, 3.0, (1.0, 2.0, 3.0)).collect()}
    monkeypatch.setattr(mixing, "SORTED_SOURCES", 5)
    got = {r.source: (r.weight, r.target) for r in mixing.targets(sizes, 3.0, (1.0, 2.0, 3.0)).collect()}
    assert got.keys() == want.keys()
    for k, (weight, target) in got.items():
        assert weight == want[k][0] and target == pytest.approx(want[k][1], rel=1e-9)
    assert mixing.targets(sizes.limit(0), 3.0, (1.0, 2.0)).collect() == []


def test_ties_are_the_same_in_every_run(spark):
    rows = [(k // 8, f"a b c{k}", "s" if k % 3 else "t") for k in range(240)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    a, b = (sorted(map(str, mixing.mix_sources(x, keep_text=True).collect())) for x in (d, d.repartition(5, "text")))
    assert a == b
