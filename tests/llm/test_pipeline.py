import hashlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_jaccard import brute as jaccard_brute
from test_substr import brute as substr_brute

import corpus_pipeline
from blockloom.llm import mixing, quality
from blockloom.llm.common import written

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 400")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(written(stage(spark, out[-1], SF)))
    return out


def test_columns_stay(stages):
    assert all(s.columns == stages[0].columns for s in stages[:-1])
    assert stages[-1].columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


def test_quality_stage_rejects_what_is_labelled_so(spark, stages):
    model = quality.learn(stages[0], spark.read.parquet(f"{SF}/labels.parquet"))
    rejected = {r.doc_id for r in quality.classify_quality(stages[0], model).where("predicted = 0").collect()}
    kept = {r.doc_id: r for r in stages[1].collect()}
    assert kept == {r.doc_id: r for r in stages[0].collect() if r.doc_id not in rejected}
    truth = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    right = [(i not in rejected) == truth[i] for i in truth if i < 400]
    assert np.mean(right) > 0.97


def test_one_of_each_group_stays(stages):
    rows = {r.doc_id: r for r in stages[1].collect()}
    want = {i for i, _, c in jaccard_brute([(i, r.text) for i, r in rows.items()]) if i == c}
    assert {r.doc_id: r for r in stages[2].collect()} == {i: rows[i] for i in want} and len(want) < len(rows)


def test_repeated_windows_go(stages):
    rows = stages[2].collect()
    want = {i: (gone, kept) for i, _, gone, _, kept in substr_brute([(r.doc_id, r.text) for r in rows])}
    before = {r.doc_id: r for r in rows}
    for r in stages[3].collect():
        gone, kept = want.pop(r.doc_id)
        assert r.text == (kept if gone else before[r.doc_id].text)
        assert r.n_chars == (len(kept) if gone else before[r.doc_id].n_chars)
    assert not want


def test_mix_repeats_documents(stages):
    copies = {r.doc_id: r.copies for r in mixing.mix_sources(stages[3]).collect()}
    got = {}
    texts = {r.doc_id: r.text for r in stages[3].collect()}
    for r in stages[4].collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + 1
        assert r.text == texts[r.doc_id]
    assert got == {i: n for i, n in copies.items() if n} and max(copies.values()) <= 3


def test_last_stage_reads_every_copy(stages):
    want = sorted((r.doc_id, hashlib.sha256(r.text.encode()).hexdigest()) for r in stages[4].collect())
    assert sorted((r.doc_id, r.decoded_sha256) for r in stages[5].collect()) == want


def test_odd_rows_and_no_rows(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, row string, kept string"
    same = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"
    rows = [(1, None, None, None, None, "a", "b"), (2, "", "en", "s", 0, "a", "b"), (3, same, "en", "s", 1, "a", "b"), (4, same + " x", "en", "s", 1, "a", "b"), (4, same + " x", "en", "s", 1, "a", "b"), (None, same, "en", None, 1, "a", "b"), (5, "w " * 30_000, "en", "s", 1, "a", "b"), (6, "own", "en", "t", 3, "a", "b"), (6, "own", "en", "t", 3, "a", "b")]
    for d in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        one = corpus_pipeline.keep_one_of_each_group(spark, d, SF)
        assert one.columns == d.columns
        ids = sorted(str(r.doc_id) for r in one.collect())
        assert ids == (["1", "2", "3", "5", "6", "None"] if d.count() else [])
        for _, stage in corpus_pipeline.STAGES:
            d = written(stage(spark, d, SF))


def test_run_is_the_stages_in_turn(spark, tmp_path):
    for name in ("documents", "labels"):
        spark.read.parquet(f"{SF}/{name}.parquet").where("doc_id < 60").write.parquet(f"file://{tmp_path}/{name}.parquet")
    got = corpus_pipeline.run(spark, f"file://{tmp_path}")
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert got.select(F.count("*"), F.count_distinct("doc_id")).head()[1] > 20


def test_columns_of_any_name_stay(spark):
    names = ["gone", "again", "kept", "_gone", "n", "__kept", "__gone", "row", "i", "t", "sure", "q", "band", "J", "s"]
    rows = [(k, f"{k % 7} one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen {k % 7}", "en", "ab"[k % 2], 5) for k in range(20)]
    d = spark.createDataFrame([*rows, rows[0], (None, None, None, None, None)], "doc_id long, text string, lang string, source string, n_chars long").withColumns({c: F.lit(c) for c in names})
    for _, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, d, SF)
        assert got.columns == d.columns
        for r in got.collect():
            assert all(r[c] == c for c in names)
    assert corpus_pipeline.STAGES[-1][1](spark, d, SF).count() == d.count()


def test_batches_of_text_are_bounded(spark):
    """10,000 rows of 3 kB go to Python in pieces in every stage, so that executors hold no batch of all of them; a smaller bound of the session stays."""
    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], names=["n"])

    setting = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(setting)
    docs = spark.range(0, 10_000, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("word "), 600).alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"))
    empty = docs.limit(0)
    try:
        for _, stage in corpus_pipeline.STAGES:
            spark.conf.unset(setting)
            stage(spark, empty, SF)
            assert docs.mapInArrow(sizes, "n long").agg(F.max("n")).head()[0] < 5_000_000
            spark.conf.set(setting, "1m")
            stage(spark, empty, SF)
            assert spark.conf.get(setting) == "1m"
    finally:
        spark.conf.set(setting, before)
