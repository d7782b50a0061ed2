import hashlib
import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from blockloom.llm import tiff


@pytest.mark.parametrize("compression", [tiff.NONE, tiff.LZW, tiff.DEFLATE, tiff.PACKBITS, tiff.OLD_DEFLATE])
@pytest.mark.parametrize("order", "<>")
def test_pages_round_trip(compression, order):
    rng = np.random.default_rng(1)
    for predictor in (1, 2):
        for shape in [(1, 1), (7, 13), (130, 70), (65, 40, 3)]:
            pages = [rng.integers(0, top, shape).astype(np.uint8) for top in (2, 256, 1, 256)]
            got = tiff.read_pages(tiff.write_tiff(pages, compression=compression, predictor=predictor, order=order, tile=(16, 32), rows=50))
            assert [p.pixels for p in got] == [p.tobytes() for p in pages]
            assert [(p.height, p.width) for p in got] == [shape[:2]] * 4


@settings(max_examples=100, deadline=None)
@given(st.binary(max_size=9000) | st.binary(min_size=1, max_size=3).map(lambda b: b * 3000))
def test_codecs_round_trip(data):
    assert tiff.unpack_bits(tiff.pack_bits(data)) == data
    assert tiff.unpack_lzw(tiff.pack_lzw(data)) == data


def test_lzw_of_a_known_stream():
    # 7 7 7 8 8 7 7 6 6, clear and end included: codes 256 7 258 8 8 258 6 6 257 of 9 bits
    bits = "".join(f"{c:09b}" for c in (256, 7, 258, 8, 8, 258, 6, 6, 257))
    data = int(bits.ljust(88, "0"), 2).to_bytes(11, "big")
    assert tiff.unpack_lzw(data) == bytes([7, 7, 7, 8, 8, 7, 7, 6, 6])
    assert tiff.unpack_bits(bytes.fromhex("FEAA0280002AFDAA0380002A22F7AA")) == bytes.fromhex("AAAAAA80002AAAAAAAAA80002A22AAAAAAAAAAAAAAAAAAAA")


def file_of(order, tags, data):
    """A directory behind data; values of more than 4 bytes lie after it."""
    out = bytearray((b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 8 + len(data)) + data)
    out += struct.pack(order + "H", len(tags))
    for tag, kind, value in sorted(tags):
        out += struct.pack(order + "HHI", tag, kind, 1) + (struct.pack(order + "HH", value, 0) if kind == 3 else struct.pack(order + "I", value))
    return bytes(out + b"\0\0\0\0")


@pytest.mark.parametrize("order", "<>")
@pytest.mark.parametrize("kind", ["u2", "u4"])
def test_wide_samples_and_predictor_2(order, kind):
    values = np.random.default_rng(2).integers(0, 60000, (5, 6)).astype(order + kind)
    stored = np.diff(values, axis=1, prepend=values.dtype.type(0)).astype(order + kind).tobytes()
    tags = [(256, 3, 6), (257, 3, 5), (258, 3, 8 * int(kind[1])), (259, 3, 1), (273, 4, 8), (277, 3, 1), (278, 3, 5), (279, 4, len(stored)), (317, 3, 2)]
    (page,) = tiff.read_pages(file_of(order, tags, stored))
    assert (np.frombuffer(page.pixels, "<" + kind).reshape(5, 6) == values).all()


def test_floating_point_predictor():
    values = np.random.default_rng(3).normal(size=(4, 5)).astype(">f4")
    planes = values.view(np.uint8).reshape(4, 5, 4).transpose(0, 2, 1).reshape(4, 20)
    stored = np.diff(planes, axis=1, prepend=np.uint8(0)).tobytes()
    tags = [(256, 3, 5), (257, 3, 4), (258, 3, 32), (259, 3, 1), (273, 4, 8), (278, 3, 4), (279, 4, len(stored)), (317, 3, 3)]
    (page,) = tiff.read_pages(file_of("<", tags, stored))
    assert (np.frombuffer(page.pixels, "<f4").reshape(4, 5) == values).all()


def test_files_that_are_none(spark):
    good = tiff.write_tiff([np.zeros((3, 4), np.uint8), np.ones((2, 2), np.uint8)])
    loop = bytearray(good)
    (at,) = struct.unpack_from("<I", loop, 4)
    (n,) = struct.unpack_from("<H", loop, at)
    struct.pack_into("<I", loop, at + 2 + 12 * n, at)
    rows = [(1, good), (1, good), (2, None), (3, b""), (4, b"II*"), (5, good[:-30]), (6, bytes(loop)), (None, good), (7, b"MM\0*\0\0\0\0")]
    d = spark.createDataFrame([(i, b, "x") for i, b in rows], "doc_id long, media binary, page string")
    got = tiff.tiff_pages(d).collect()
    count = lambda i: sorted((r.page, bool(r.error)) if r.page is not None else (-1, bool(r.error)) for r in got if r.doc_id == i)
    assert count(1) == [(0, False)] * 2 + [(1, False)] * 2 and count(None) == [(0, False), (1, False)]
    for i in (2, 3, 4, 5, 6, 7):
        assert count(i) == [(-1, True)]
    (page,) = [r for r in got if r.doc_id is None and r.page == 1]
    assert (page.width, page.height, page.samples, page.bits, page.predictor, bytes(page.pixels)) == (2, 2, 1, 8, 2, b"\1\1\1\1")
    assert tiff.tiff_pages(d.limit(0)).collect() == []


def test_texts_come_back(spark):
    long = "löng \n" * 60_000  # more than two pages, so strips and tiles
    texts = [None, "", "a", "ä" * 288, "x" * 576, "x" * 577, long, long]
    d = spark.createDataFrame([(n, t, "?") for n, t in enumerate(texts)] + [(None, "a", "!")], "doc_id long, text string, feature string")
    got = {r.doc_id: r for r in tiff.tiff_round_trip(d).collect()}
    assert len(got) == len(texts) + 1
    for n, t in [*enumerate(texts), (None, "a")]:
        raw = (t or "").encode()
        payload = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
        r = got[n]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        media = tiff.store(payload)
        assert (r.media_bytes, r.media_sha256) == (len(media), hashlib.sha256(media).hexdigest())
    assert got[6][1:] == got[7][1:] and got[6].n_pages == 3 and got[2][1:] == got[None][1:]
    assert tiff.tiff_round_trip(d.limit(0)).collect() == []


@pytest.mark.parametrize(("tag", "kind", "value"), [(256, 2, 6), (257, 11, 6), (258, 12, 8), (277, 5, 8), (273, 2, 8), (279, 11, 30), (317, 2, 1), (278, 9, 0xFFFFFFFF), (256, 3, 0), (258, 3, 7), (259, 3, 77)])
def test_fields_of_the_wrong_kind_are_errors(spark, tag, kind, value):
    tags = {256: (3, 6), 257: (3, 5), 258: (3, 8), 259: (3, 1), 273: (4, 8), 277: (3, 1), 278: (3, 5), 279: (4, 30)} | {tag: (kind, value)}
    data = file_of("<", [(t, k, v) for t, (k, v) in tags.items()], bytes(30))
    with pytest.raises(ValueError):
        tiff.read_pages(data)


def test_a_bad_file_costs_a_row_and_not_the_job(spark):
    tags = [(256, 2, 6), (257, 3, 5), (273, 4, 8), (279, 4, 30)]
    d = spark.createDataFrame([(1, file_of("<", tags, bytes(30))), (2, tiff.write_tiff([np.ones((2, 2), np.uint8)]))], "doc_id long, media binary")
    got = {r.doc_id: r for r in tiff.tiff_pages(d).collect()}
    assert got[1].page is None and "256" in got[1].error and got[2].page == 0 and got[2].error is None


def test_unpacking_stops_at_the_size_of_a_strip():
    bomb = tiff.pack_lzw(bytes(20_000_000))
    assert len(bomb) < 20_000 and 5000 <= len(tiff.unpack_lzw(bomb, 5000)) < 5000 + 4096
    assert 5000 <= len(tiff.unpack_bits(tiff.pack_bits(bytes(1_000_000)), 5000)) < 5000 + 128
    tags = [(256, 3, 50), (257, 3, 100), (258, 3, 8), (259, 3, 5), (273, 4, 8), (278, 3, 100), (279, 4, len(bomb))]
    (page,) = tiff.read_pages(file_of("<", tags, bomb))
    assert page.pixels == bytes(5000)


def test_feature_against_plain_loops():
    for text in (b"", b"a" * 10, bytes(range(256)) * 9):
        payload = text + b"\xff" * (-len(text) % 576 if text else 576)
        size = len(payload) // 64
        means = [sum(payload[k * size : (k + 1) * size]) / size for k in range(64)]
        whole = sum(means) / 64
        bits = "".join(str(int(m > whole)) for m in means)
        assert tiff.average_hash(payload) == f"{int(bits, 2):016x}"
