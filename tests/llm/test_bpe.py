import hashlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from blockloom.llm.bpe import Bpe, bpe_encode_decode, vocabulary

OURS = Bpe(vocabulary())
THEIRS = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def check(text):
    ids = THEIRS.encode(text, add_special_tokens=False).ids
    assert OURS.encode(text) == ids
    assert OURS.decode(ids) == THEIRS.decode(ids, skip_special_tokens=False)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80) | st.text("ab '\nst<|endoftx>|é ", max_size=60))
def test_any_text(text):
    check(text)


@pytest.mark.parametrize("text", ["", " ", "a<|endoftext|>b", "<|endoftext|><|endoftext|>", "<|endoftext", "  \n\n x\u0085 　 y\x1c", "we'LL don't", "x" * 5000, "ab" * 3000, "😀 नमस्ते 1²½", "​﻿ "])
def test_cases(text):
    check(text)


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(0, 50256), max_size=30))
def test_any_ids_decode(ids):
    assert OURS.decode(ids) == THEIRS.decode(ids, skip_special_tokens=False)


def test_documents(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in bpe_encode_decode(docs, vocabulary(), keep_ids=True).collect():
        ids = THEIRS.encode(texts[r.doc_id], add_special_tokens=False).ids
        packed = np.array(ids, "<u4").tobytes()
        assert (r.n_tokens, r.ids, r.ids_sha256) == (len(ids), ids, hashlib.sha256(packed).hexdigest())
        assert r.decoded == texts[r.doc_id] and r.decoded_sha256 == hashlib.sha256(r.decoded.encode()).hexdigest()


def test_nulls_repeats_and_clashing_names(spark):
    d = spark.createDataFrame([(1, None, 7), (1, "", 7), (None, "a b", 7), (2, "a b", 7), (2, "a b", 7)], "doc_id long, text string, n_tokens long")
    got = sorted(map(tuple, bpe_encode_decode(d, vocabulary()).collect()), key=str)
    empty = hashlib.sha256(b"").hexdigest()
    assert [g[:2] for g in got] == [(1, 0), (1, 0), (2, 2), (2, 2), (None, 2)]
    assert got[0][2:] == (empty, empty) and got[2] == got[3] and got[2][1:] == got[4][1:]
    assert bpe_encode_decode(d.limit(0), vocabulary()).collect() == []


@pytest.mark.parametrize("change", [{"normalizer": {"type": "NFC"}}, {"pre_tokenizer": {"type": "Whitespace"}}, {"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": True}}, {"decoder": None}, {"added_tokens": [{"id": 1, "content": "x", "lstrip": True}]}, {"model": {"ignore_merges": True}}, {"model": {"type": "Unigram"}}])
def test_other_vocabularies_are_refused(spark, change):
    import json

    spec = json.loads(vocabulary())
    model = spec["model"] | change.pop("model", {})
    with pytest.raises(ValueError, match="not plain"):
        bpe_encode_decode(spark.createDataFrame([(1, "a")], "doc_id long, text string"), json.dumps(spec | change | {"model": model}))
