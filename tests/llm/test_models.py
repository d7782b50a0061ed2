import zlib

import numpy as np
import pytest

from blockloom.llm import langid, quality


def fold(i, n):
    return zlib.crc32(str(i).encode()) % n


def numeric(model, x, y, p, index, step=1e-3):
    kept = p[index]
    losses = []
    for sign in (1, -1):
        p[index] = kept + sign * step
        losses.append(model.slopes(x, y)[0])
    p[index] = kept
    return (losses[0] - losses[1]) / (2 * step)


def test_backpropagation_through_time():
    model = langid.BiGru(["a", "b", "c"], hidden=3, seed=1)
    for cell in (model.ahead, model.back):
        cell.e, cell.u = cell.e.astype(float) * 0.5, cell.u.astype(float) * 0.5
    model.w, model.b = model.w.astype(float), model.b.astype(float)
    rng = np.random.default_rng(0)
    x, y = rng.integers(97, 103, (6, 4)), np.array([0, 1, 2, 1])
    _, slopes = model.slopes(x, y)
    for p, g in zip(model.parameters(), slopes, strict=True):
        for index in [tuple(i) for i in np.argwhere(np.abs(g) > 1e-4)][:12]:
            assert g[index] == pytest.approx(numeric(model, x, y, p, index), rel=0.05, abs=2e-4)


def test_probabilities_do_not_depend_on_the_batch():
    model = langid.BiGru(["a", "b"], seed=3)
    rng = np.random.default_rng(1)
    texts = [bytes(rng.integers(32, 127, n).astype(np.uint8)) for n in (1, 5, 255, 256, 257, 700, 2000)]
    together = model.probabilities([*texts, b""])
    for k, t in enumerate(texts):
        assert together[k] == pytest.approx(model.probabilities([t])[0], abs=1e-5)
        each = model.positions(t)
        assert each.shape == (len(t), 2) and each.sum(axis=1) == pytest.approx(1, abs=1e-5)
        assert each.mean(axis=0) == pytest.approx(together[k], abs=1e-5)
    assert model.positions(b"").shape == (0, 2)
    assert together.sum(axis=1) == pytest.approx(1, abs=1e-4)
    assert together[-1].tolist() == [0.5, 0.5]


def plain_gru(cell, text):
    """States of one direction, byte by byte."""
    k, h, out = cell.hidden, np.zeros(cell.hidden), []
    for b in text:
        e, u = cell.e[:, b].astype(float), cell.u.astype(float) @ h
        r, z = (np.clip(e[i * k : (i + 1) * k] + u[i * k : (i + 1) * k] + 0.5, 0, 1) for i in (0, 1))
        n = np.tanh(e[2 * k :] + r * u[2 * k :])
        h = n + z * (h - n)
        out.append(h)
    return out


def test_positions_against_plain_loops(monkeypatch):
    model = langid.BiGru(["a", "b", "c"], hidden=4, seed=2)
    monkeypatch.setattr(langid, "READ_WINDOW", 20)
    monkeypatch.setattr(langid, "HALO", 7)
    text = bytes(np.random.default_rng(3).integers(32, 127, 73).astype(np.uint8))
    got, small = model.positions(text), text.lower()
    for at in range(0, len(text), 20):
        begin, end = max(0, at - 7), min(len(text), at + 27)
        window = small[begin:end]
        states = zip(plain_gru(model.ahead, window), plain_gru(model.back, window[::-1])[::-1], strict=True)
        for t, (f, b) in enumerate(states):
            if at <= begin + t < min(len(text), at + 20):
                z = model.w.astype(float) @ np.concatenate([f, b]) + model.b[:, 0]
                p = np.exp(z - z.max())
                assert got[begin + t] == pytest.approx(p / p.sum(), abs=1e-4)
    assert model.probabilities([text, b"", text[:5]])[0] == pytest.approx(got.mean(axis=0), abs=1e-5)


def test_long_texts_teach_by_pieces(spark):
    rows = [(n, (w * 40 if n % 2 else w * 60_000), lang) for n, (w, lang) in enumerate([("the cat ", "en"), ("der hund ", "de")] * 8)]
    model = langid.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"), steps=60)
    assert model.languages == ["de", "en"] and model.probabilities([b"the cat the cat", b"der hund der"]).argmax(axis=1).tolist() == [1, 0]


def test_an_id_that_repeats_teaches_once(spark):
    d = spark.createDataFrame([(k % 40, f"a b {k % 40} c" * (1 + k % 40)) for k in range(400)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)], "doc_id long, quality int")
    once, often = quality.learn(d.dropDuplicates(["doc_id"]), labels), quality.learn(d, labels)
    assert (once.value == often.value).all() and (once.feature == often.feature).all()


def test_held_out_languages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.identify_language(docs, langid.learn(docs)).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (fold(r.doc_id, 3) == 1) for r in got) and len(got) == 1000
    assert np.mean([r.lang == r.lang_pred for r in held]) > 0.95
    assert all(0 <= r.score <= 1 for r in got)


def test_language_of_odd_rows(spark):
    schema = "doc_id long, text string, lang string, score string"
    rows = [(n, w * 40, lang, "x") for n, (w, lang) in enumerate([("the cat ", "en"), ("der hund ", "de")] * 30)]
    odd = [(None, "the cat", "en", "x"), (900, None, "en", "x"), (901, "", None, "x"), (902, "123 !?", "de", "x"), (903, "the cat " * 5000, None, "x"), (903, "the cat " * 5000, None, "x"), (904, "ж", "en", "x")]
    d = spark.createDataFrame(rows + odd, schema)
    model = langid.learn(d, steps=60)
    got = {}
    for r in langid.identify_language(d, model).collect():
        assert got.setdefault(r.doc_id, r) == r
    assert [got[i].lang_pred for i in (900, 901, 902)] == ["und"] * 3 and got[900].score == 0
    assert got[903].lang_pred == got[None].lang_pred == "en" and not got[None].held_out
    assert got[904].lang_pred in ("en", "de")
    empty = d.limit(0)
    assert langid.identify_language(empty, langid.learn(empty)).collect() == []
    nothing = langid.learn(spark.createDataFrame(odd[1:3], schema))
    assert {r.lang_pred for r in langid.identify_language(d, nothing).collect()} == {"und"}


def test_trees_go_down_as_one_by_one():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(500, 5)).astype(np.float32)
    x[:, 4] = np.round(x[:, 4])
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] + x[:, 4] > 0)).astype(float)
    m = quality.fit(x[:400], y[:400], trees=60)
    assert ((m.score(x[400:]) > 0.5) == y[400:]).mean() > 0.85
    for row in x[:20]:
        z = m.base
        for t in range(60):
            node = 0
            while node < m.feature.shape[1]:
                node = 2 * node + (2 if row[m.feature[t, node]] > m.threshold[t, node] else 1)
            z += m.value[t, node - m.feature.shape[1]]
        assert m.log_odds(row[None])[0] == pytest.approx(z)


def test_statistics_of_odd_texts():
    x = quality.statistics([None, b"", b"a", b"a a a", b"x\n" * 50_000, "é!".encode(), b"\xff"])
    assert x.shape == (7, len(quality.FEATURES)) and np.isfinite(x).all() and (x[0] == x[1]).all()
    at = quality.FEATURES.index
    assert x[3, at("distinct_words")] == pytest.approx(1 / 3) and x[3, at("doubled_words")] == 1 and x[3, at("top_word")] == 1
    assert x[4, at("distinct_lines")] == pytest.approx(1 / 50_000)
    assert quality.statistics([]).shape[0] == 0


def test_held_out_quality(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = quality.learn(docs, labels)
    got = quality.classify_quality(docs, model).collect()
    truth = {r.doc_id: r.quality for r in labels.collect()}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert len(held) > 50 and np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.95
    assert all(r.held_out == (fold(r.doc_id, 4) == 2) and r.predicted == (r.score >= 0.7) for r in got)
    again = quality.learn(docs.repartition(7), labels.repartition(5))
    assert [r.score for r in got] == [r.score for r in quality.classify_quality(docs, again).collect()]


def test_quality_of_odd_rows(spark):
    d = spark.createDataFrame([(None, "a b", 1), (1, None, 1), (2, "", 1), (3, "w " * 30_000, 1), (3, "w " * 30_000, 1)], "doc_id long, text string, score int")
    no_labels = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, quality int")
    got = quality.classify_quality(d, quality.learn(d, no_labels)).collect()
    assert len(got) == 5 and {r.score for r in got} == {0.5}
    labels = spark.createDataFrame([(i, q) for i in (1, 2, 3, 3) for q in (0, 1)], "doc_id long, quality int")
    assert all(0 <= r.score <= 1 for r in quality.classify_quality(d, quality.learn(d, labels)).collect())
    assert quality.classify_quality(d.limit(0), quality.learn(d.limit(0), labels), keep_row=True).collect() == []
    kept = quality.classify_quality(d, quality.learn(d, labels), keep_row=True).select("row.*")
    assert sorted(map(str, kept.collect())) == sorted(map(str, d.collect()))
