import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from blockloom.llm.common import LONG_WORD, fits, hashed, mixed, rolling, slices, split_words, written

TEXT = st.one_of(st.none(), st.binary(max_size=80), st.lists(st.sampled_from([b"ab", b"Ba", b" ", b"\n", b"\x0b", b"\x85", b"x" * LONG_WORD, b"\xc3\xa9"]), max_size=20).map(b"".join))


@settings(max_examples=300, deadline=None)
@given(st.lists(TEXT, max_size=8), st.booleans())
def test_hashes_tell_words_apart(texts, lower):
    h, counts = hashed(texts, lower)
    words = [split_words(t, lower) for t in texts]
    assert counts.tolist() == [len(w) for w in words]
    flat = [w for ws in words for w in ws]
    by = dict(zip(flat, h.tolist(), strict=True))
    assert [by[w] for w in flat] == h.tolist() and len({*by.values()}) == len(by)


def test_hashes_do_not_depend_on_place_or_company():
    words = [b"a", b"b", b"ab", b"ba", b"aab", b"aba", b"\xff", b"x" * 31, b"x" * 32, b"x" * 33, b"y" * 5000]
    alone = [int(hashed([w])[0][0]) for w in words]
    together, _ = hashed([b" ".join(words), None, b"\n".join(words)])
    assert together.tolist() == alone * 2
    # Words that differ in two letters' order, the weakest kind for polynomials
    swaps = {bytes([97 + (k == i) + 2 * (k == j) for k in range(32)]) for i in range(32) for j in range(32) if i != j}
    assert len({int(x) for x in hashed([b" ".join(sorted(swaps))])[0]}) == len(swaps)


def test_rolling_is_by_content():
    w, _ = hashed([b"a b c d e a b c d e f"])
    r = rolling(w, 5)
    assert len(r) == 7 and r[0] == r[5] and len({*r.tolist()}) == 6
    assert len(rolling(w, 12)) == 0
    x = np.arange(1000, dtype=np.uint64)
    assert len({*mixed(x).tolist()}) == 1000


def test_slices_cover_all_rows():
    batch = pa.RecordBatch.from_arrays([pa.array([None, b"", b"x" * 3_000_000, b"y"] + [b"z"] * 2000, pa.binary())], names=["t"])
    got = list(slices(batch, 0))
    assert got[0][0] == 0 and got[-1][1] == 2004 and all(a[1] == b[0] for a, b in zip(got, got[1:], strict=False))
    assert list(slices(batch.slice(0, 0), 0)) == []


def test_written_and_fits(spark):
    d = spark.range(10).select("id", F.lit("a").alias("s"))
    assert sorted(written(d).collect()) == d.collect()
    assert fits(d, 10) and not fits(d, 9)
