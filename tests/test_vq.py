import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from blockloom.functions.pixels import psnr
from blockloom.operators import assign, blocks, coding, fidelity, partition, stencil, train
from blockloom.plans import pipeline
from blockloom.plans.config import VQConfig
from blockloom.sources import images, sinks

SMALL = VQConfig(width=16, height=16, codes=8)


def frame(spark, image, channel="Gray", name="i"):
    rows = [(name, channel, y, x, int(v)) for y, row in enumerate(image) for x, v in enumerate(row)]
    return spark.createDataFrame(rows, "image_id string, channel string, y int, x int, v int")


def grid(df, shape):
    out = np.full(shape, -1)
    for r in df.collect():
        out[r.y, r.x] = r.v
    return out


def noise(seed=0, shape=(16, 16)):
    return np.random.default_rng(seed).integers(0, 256, shape)


def labels_of(spark, labels):
    return spark.createDataFrame([("i", "Gray", n, int(v)) for n, v in enumerate(labels)], "image_id string, channel string, vec_idx int, label int")


def test_config_rejects_bad_sizes():
    for bad in ({"codes": 48}, {"codes": 512}, {"width": 510}, {"height": 0}):
        with pytest.raises(ValueError):
            VQConfig(**bad)


@pytest.mark.parametrize(("text", "values"), [("1 2-3 +4 5x 6 7", [1, 2, 0, 4, 5]), ("-4 0 255 300", [0, 0, 255, 255]), ("x", []), ("9" * 30 + " -" + "9" * 30, [255, 0])])
def test_tokens_and_clamp(spark, text, values):
    d = spark.createDataFrame([(text,)], "t string").select(F.transform(images.integer_prefix(F.col("t")), lambda t: images.token_value(t)).alias("v"))
    assert d.head()[0] == values


def test_scan_text_modes(spark, tmp_path):
    gray, color = noise(1), noise(2, (16, 16, 3))
    (tmp_path / "g.txt").write_text("\n".join(map(str, gray.ravel())))
    (tmp_path / "c.txt").write_text(" ".join(map(str, color.ravel())))
    assert (grid(images.scan_text(spark, f"{tmp_path}/g.txt", 16, 16), (16, 16)) == gray).all()
    got = images.scan_text(spark, f"{tmp_path}/c.txt", 16, 16)
    for k, name in enumerate(images.RGB):
        assert (grid(got.where(F.col("channel") == name), (16, 16)) == color[:, :, k]).all()
    modes = {r.image_id[-5:]: r["mode"] for r in images.detect_modes(spark, str(tmp_path), 16, 16).collect()}
    assert modes == {"g.txt": "gray", "c.txt": "color"}
    # a forced mode ignores the surplus, but not a lack
    assert (grid(images.scan_text(spark, f"{tmp_path}/c.txt", 16, 16, "gray"), (16, 16)).ravel() == color.ravel()[:256]).all()
    for path, mode in (("g.txt", "color"),):
        with pytest.raises(Exception, match="integers do not make"):
            images.scan_text(spark, f"{tmp_path}/{path}", 16, 16, mode).collect()
    (tmp_path / "s.txt").write_text("1 2 3")
    with pytest.raises(Exception, match="integers do not make"):
        images.scan_text(spark, f"{tmp_path}/s.txt", 16, 16).collect()
    with pytest.raises(ValueError):
        images.scan_text(spark, str(tmp_path), 16, 16, "grey")


def test_blocks_round_trip_and_order(spark):
    image = noise()
    v = blocks.to_vectors(frame(spark, image), 16)
    first = v.where("vec_idx = 5").head().v
    assert first == image[4:8, 4:8].ravel().tolist()
    assert (grid(blocks.to_pixels(v, 16), (16, 16)) == image).all()


def test_nearest_takes_the_lowest_code_of_a_tie(spark):
    v = spark.createDataFrame([("i", "Gray", 0, [1.0, 0.0])], "image_id string, channel string, vec_idx int, v array<float>")
    book = spark.createDataFrame([("i", "Gray", c, w) for c, w in ((0, [9.0, 9.0]), (2, [0.0, 0.0]), (5, [2.0, 0.0]))], "image_id string, channel string, code int, w array<double>")
    r = assign.nearest(v, book, 2).head()
    assert (r.label, r.dist) == (2, 1.0)
    new = assign.update_codebook(book, assign.cell_sums(assign.nearest(v, book, 2), 2))
    assert {r.code: r.w for r in new.collect()} == {0: [9.0, 9.0], 2: [1.0, 0.0], 5: [2.0, 0.0]}


def plain_training(x, config):
    """Plain loops: the meaning of the training, step by step."""
    x = x.astype(np.float64)
    w = x.mean(axis=0)[None, :]
    labels = np.zeros(len(x), int)
    while len(w) < config.codes:
        w = np.concatenate([w * (1 + config.delta), w * (1 - config.delta)])
        last = 1e30
        for _ in range(config.max_iter):
            d = ((x[:, None, :] - w[None]) ** 2).sum(axis=2)
            labels = d.argmin(axis=1)
            now = d.min(axis=1).mean()
            w = np.stack([x[labels == k].mean(axis=0) if (labels == k).any() else w[k] for k in range(len(w))])
            better, last = abs(last - now) / (now + 1e-9), now
            if better <= config.epsilon:
                break
    return labels, w


def test_training_forms_agree(spark):
    image = noise(3, (32, 32))
    config = VQConfig(width=32, height=32, codes=8, precision="float64")
    v = blocks.to_vectors(frame(spark, image), 32)
    x = np.array([r.v for r in v.orderBy("vec_idx").collect()])
    labels, w = plain_training(x, config)
    for fit in (train.fit_grouped, train.fit_distributed):
        t = fit(v, config)
        assert [r.label for r in t.labels.orderBy("vec_idx").collect()] == labels.tolist()
        assert np.allclose([r.w for r in t.codebook.orderBy("code").collect()], w)
        log = t.iterations.orderBy("k", "iter").collect()
        assert {r.k for r in log} == {2, 4, 8} and all(r.iter <= 100 for r in log)
        for k in (2, 4, 8):
            run = [r.distortion for r in log if r.k == k]
            assert len(run) >= 2 and all(b <= a * (1 + 1e-9) for a, b in zip(run, run[1:], strict=False))


@pytest.mark.parametrize("level", [0, 100, 255])
def test_flat_images_are_kept(spark, level):
    config = VQConfig(width=16, height=16, codes=64)
    r = pipeline.run(frame(spark, np.full((16, 16), level)), config).planes.head()
    assert (r.mse, r.psnr, r.entropy_label, r.roundtrip) == (0.0, 100.0, 0.0, True)
    assert r.ssim == pytest.approx(1.0)


def test_two_levels_survive_before_the_filter(spark):
    image = np.zeros((16, 16), int)
    image[:, 8:] = 255
    got = pipeline.run(frame(spark, image), VQConfig(width=16, height=16, codes=2))
    assert (grid(got.raw, (16, 16)) == image).all()
    assert got.labels.select("label").distinct().count() == 2


def test_delta_wraps(spark):
    d = coding.delta_encode(labels_of(spark, [0, 200, 0]))
    assert [r.d for r in d.orderBy("vec_idx").collect()] == [0, 72, 184]
    assert [r.label for r in coding.delta_decode(d).orderBy("vec_idx").collect()] == [0, 200, 0]


def test_huffman_fixtures(spark):
    def sizes(pairs):
        h = spark.createDataFrame([("i", "Gray", s, f) for s, f in pairs], "image_id string, channel string, symbol int, freq long")
        r = coding.huffman_sizes(h).head()
        return r and (r.bits, r.data_bytes, r.header_bytes, r.total_bytes)

    assert sizes(enumerate([5, 9, 12, 13, 16, 45])) == (224, 28, 24, 52)
    assert sizes([(7, 10)]) == (10, 2, 4, 6)
    assert sizes([]) is None
    assert spark.range(1).select(coding.huffman_cost(F.array().cast("array<bigint>"))).head()[0] == 0


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 255), max_size=300))
def test_huffman_codes_are_optimal_and_decode(values):
    d = np.array(values, int)
    symbols, freqs = np.unique(d, return_counts=True)
    codes = coding.code_table(symbols.tolist(), freqs.tolist())
    data = coding.pack(d, codes)
    assert coding.unpack(data, codes, len(d)) == values
    bits = sum(int(f) * codes[int(s)][0] for s, f in zip(symbols, freqs, strict=True))
    assert len(data) == -(-bits // 8)
    if len(symbols) > 1:
        assert sum(2.0 ** -n for n, _ in codes.values()) == 1
        p = freqs / len(d)
        entropy = float(-(p * np.log2(p)).sum())
        assert entropy - 1e-9 <= bits / len(d) < entropy + 1


def test_entropy_counts_bins_but_divides_by_all(spark):
    r = coding.entropy(labels_of(spark, [0, 0, 1, 9]), "label", 2).head()
    assert r.entropy == pytest.approx(0.5 + 0.5)


def test_bilateral_against_loops(spark):
    image, c = noise(4), VQConfig(width=16, height=16)
    want = np.zeros_like(image)
    for y in range(16):
        for x in range(16):
            top = bottom = 0.0
            for j in range(max(0, y - 2), min(16, y + 3)):
                for i in range(max(0, x - 2), min(16, x + 3)):
                    w = math.exp(-((y - j) ** 2 + (x - i) ** 2) / 800) * math.exp(-((image[j, i] - image[y, x]) ** 2) / 800)
                    top, bottom = top + w * image[j, i], bottom + w
            want[y, x] = int(min(255, max(0, 0.8 * image[y, x] + 0.2 * top / bottom)) + 0.5)
    assert (grid(stencil.bilateral(frame(spark, image), c), (16, 16)) == want).all()


def test_ssim_against_loops(spark):
    a, b = noise(5), noise(6)
    g = np.array(stencil.gaussian(11, 1.5))
    assert g.sum() == pytest.approx(1)
    weights, want = np.outer(g, g), {}
    for y in range(5, 11):
        for x in range(5, 11):
            p, q = (m[y - 5 : y + 6, x - 5 : x + 6].astype(float) for m in (a, b))
            mp, mq = (weights * p).sum(), (weights * q).sum()
            vp, vq, cov = (weights * (p - mp) ** 2).sum(), (weights * (q - mq) ** 2).sum(), (weights * (p - mp) * (q - mq)).sum()
            want[y, x] = (2 * mp * mq + 6.5025) * (2 * cov + 58.5225) / ((mp**2 + mq**2 + 6.5025) * (vp + vq + 58.5225))
    got = {(r.y, r.x): r.ssim for r in stencil.ssim_map(stencil.paired(frame(spark, a), frame(spark, b)), 16, 16).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    same = stencil.ssim_map(stencil.paired(frame(spark, a), frame(spark, a)), 16, 16)
    assert same.where(F.abs(F.col("ssim") - 1) > 1e-9).count() == 0


def test_psnr_of_no_error(spark):
    assert spark.range(1).select(psnr(F.lit(0.0))).head()[0] == 100.0
    a = frame(spark, noise())
    r = fidelity.mse_psnr(stencil.paired(a, a)).head()
    assert (r.mse, r.psnr) == (0.0, 100.0)


def test_split_plans(spark):
    plan = lambda d: [(r.cnt, r.displ) for r in d.orderBy("rank").collect()]
    assert plan(partition.equal_split(spark, 10, 4)) == [(3, 0), (3, 3), (2, 6), (2, 8)]
    assert plan(partition.split_plan(spark, 10, 3, "adaptive", [1, 1, 1])) == [(4, 0), (3, 4), (3, 7)]
    assert plan(partition.split_plan(spark, 10, 3, "adaptive", [0, 0, 0])) == [(4, 0), (3, 4), (3, 7)]
    assert plan(partition.split_plan(spark, 10, 4)) == [(3, 0), (3, 3), (2, 6), (2, 8)]
    assert sum(c for c, _ in plan(partition.split_plan(spark, 101, 7))) == 101
    with pytest.raises(ValueError):
        partition.split_plan(spark, 10, 4, "fast")


def test_sinks(spark, tmp_path):
    gray = noise(7, (8, 12))
    data = bytes(sinks.to_bmp(frame(spark, gray), 12, 8).head().data)
    assert data[:2] == b"BM" and len(data) == 54 + 1024 + 96
    assert (np.frombuffer(data[1078:], np.uint8).reshape(8, 12)[::-1] == gray).all()
    assert len(sinks.bmp([np.zeros((512, 512), np.uint8)])) == 263222
    assert len(sinks.bmp([np.zeros((512, 512), np.uint8)] * 3)) == 786486
    color = frame(spark, gray, "Red").unionByName(frame(spark, gray + 0, "Green")).unionByName(frame(spark, gray * 0, "Blue"))
    row = np.frombuffer(bytes(sinks.to_bmp(color, 12, 8).head().data)[54:], np.uint8).reshape(8, 36)[-1]
    assert row[:3].tolist() == [0, gray[0, 0], gray[0, 0]]
    assert sinks.write_bmp(frame(spark, gray), 12, 8, f"file://{tmp_path}") == ["i.bmp"]
    assert (tmp_path / "i.bmp").read_bytes() == data
    assert sinks.text_lines(frame(spark, gray)).head().value == "\n".join(map(str, gray.ravel()))
    sinks.write_text(frame(spark, gray), f"file://{tmp_path}/t")
    assert spark.read.text(f"file://{tmp_path}/t").count() == gray.size


def test_pipeline_of_several_images_at_once(spark):
    a, b = frame(spark, noise(8), name="a"), frame(spark, noise(9), name="b")
    both = pipeline.run(a.unionByName(b), SMALL)
    alone = pipeline.run(a, SMALL)
    assert both.planes.where("image_id = 'a'").drop("image_id", "train_seconds").collect() == alone.planes.drop("image_id", "train_seconds").collect()
    whole = {r.image_id: r for r in pipeline.images(both, SMALL).collect()}
    assert whole["a"].planes == 1 and whole["a"].compressed_bytes == alone.planes.head().total_bytes + 8 * 16
    assert "round trip ok" in pipeline.report(alone)


def test_stream_of_images(spark, tmp_path):
    from blockloom.streaming.images import metrics_stream

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("\n".join(map(str, noise(8).ravel())))
    (tmp_path / "in" / "c.txt").write_text("\n".join(map(str, noise(8, (16, 16, 3)).ravel())))
    (tmp_path / "in" / "short.txt").write_text("1 2 3")
    query = metrics_stream(spark, f"file://{tmp_path}/in", f"file://{tmp_path}/out", f"file://{tmp_path}/state", SMALL)
    query.awaitTermination(120)
    got = spark.read.parquet(f"file://{tmp_path}/out").collect()
    assert sorted((r.image_id[-5:], r.channel) for r in got) == [("a.txt", "Gray"), ("c.txt", "Blue"), ("c.txt", "Green"), ("c.txt", "Red")]
    bad = spark.read.parquet(f"file://{tmp_path}/out_errors").collect()
    assert [(r.image_id[-9:], r.tokens) for r in bad] == [("short.txt", 3)]


def test_offsets_place_every_code(spark):
    values = [3, 3, 3, 7, 7, 200, 3, 0, 7, 3]
    d = spark.createDataFrame([("i", "Gray", n, v) for n, v in enumerate(values)], "image_id string, channel string, vec_idx int, d int")
    rows = coding.bit_offsets(d, coding.huffman_codes(coding.histogram(d, "d"))).orderBy("vec_idx").collect()
    data = bytes(coding.huffman_pieces(d, coding.huffman_codes(coding.histogram(d, "d"))).head().data)
    stream = "".join(f"{b:08b}" for b in data)
    assert [r.d for r in rows] == values
    assert all(stream[r.start : r.start + r.len] == f"{r.bits:0{r.len}b}" for r in rows)
    assert -(-(rows[-1].start + rows[-1].len) // 8) == len(data)


def test_mismatches(spark):
    a, b = labels_of(spark, [1, 2, 3]), labels_of(spark, [1, 5, 3, 4])
    assert coding.mismatches(a, a).head().mismatches == 0
    assert coding.mismatches(a, b).head().mismatches == 2


def test_speed_is_a_number():
    assert partition.calibrate_speed(rounds=1) > 0


def test_command_line(spark, tmp_path, capsys):
    from blockloom.__main__ import main

    (tmp_path / "g.txt").write_text("\n".join(map(str, noise(1).ravel())))
    assert main(["--grey"], spark) == 1
    assert main([f"file://{tmp_path}/g.txt", "--size", "16x16", "--out", f"file://{tmp_path}/out"], spark) == 0
    assert "round trip ok" in capsys.readouterr().out
    assert len(list((tmp_path / "out" / "compressed_filtered").glob("*.bmp"))) == 1
    assert spark.read.text(f"file://{tmp_path}/out/decompress").count() == 256


@pytest.mark.parametrize("scale", ["0.001", "0.01"])
def test_trained_queries_have_the_codes_of_the_reference(spark, scale):
    from blockloom.plans.queries import lbg_codebook

    got = lbg_codebook(spark, f"/root/testdata/sf{scale}").groupBy("channel").agg(F.countDistinct("code").alias("n")).collect()
    assert {r.n for r in got} == {64} and len(got) == 3


def test_ratios_worked_out_by_hand(spark):
    """A flat image of 512 x 512: 16,384 labels coded to 2,048 bytes with a header of 8, and a codebook of 1,024 bytes."""
    sizes = spark.createDataFrame([("i", "Gray", 2048, 8, 2056)], "image_id string, channel string, data_bytes long, header_bytes long, total_bytes long")
    r = fidelity.compression_ratios(sizes, 512 * 512, 16384, VQConfig()).head()
    assert (r.cr_data, r.cr_total) == (8.0, pytest.approx(16384 / 2056))
    assert (r.cr_system, r.cr_fixed) == (pytest.approx(262144 / 3080), pytest.approx(262144 / 17408))
    assert r.bpp == pytest.approx(8 * 3080 / 262144)
    planes = spark.createDataFrame([("i", c, m, 0.5, t, 1.5) for c, m, t in (("Red", 1.0, 976), ("Green", 2.0, 1976), ("Blue", 6.0, 2976))], "image_id string, channel string, mse double, ssim double, total_bytes long, train_seconds double")
    w = fidelity.image_metrics(planes, 512 * 512, 1024).head()
    assert (w.planes, w.mse, w.ssim, w.compressed_bytes, w.train_seconds) == (3, 3.0, 0.5, 9000, 4.5)
    assert w.cr_system == pytest.approx(786432 / 9000) and w.psnr == pytest.approx(10 * math.log10(65025 / 3))


def test_a_flat_image_has_these_sizes(spark):
    config = VQConfig(width=64, height=64)
    r = pipeline.run(frame(spark, np.full((64, 64), 100)), config).planes.head()
    # 256 labels, all alike: the first as it is, then 255 deltas of 128: a bit each
    assert (r.data_bytes, r.header_bytes, r.total_bytes) == (32, 8, 40)
    assert (r.cr_data, r.cr_total, r.cr_system) == (8.0, 6.4, pytest.approx(4096 / 1064))
    assert r.train_seconds > 0


@pytest.mark.parametrize("n", [0, 1, 15, 16, 17, 1000, 10_000, 10_001, 100_000, 10**12 + 7])
def test_frames_hold_every_pixel(n):
    w, h, filled, dense = images.frame_of(n)
    assert w % 4 == h % 4 == 0 and w * h >= n == filled and w >= 4 <= h
    assert w * (h - 4) < max(n, 1) and ((w - 4) ** 2 < n or w == 4)


@pytest.mark.parametrize("ids", ["cast(id as bigint)", "id * 3 - 7", "case when id = 5 then null else id div 2 end"])
def test_every_event_is_a_pixel(spark, tmp_path, ids):
    spark.range(1000).selectExpr(f"{ids} as event_id", "cast(id % 256 as double) as value", "id * 11 as user_id").repartition(3).write.parquet(f"file://{tmp_path}/events.parquet")
    got = images.events_image(spark, f"file://{tmp_path}", color=False)
    rows = sorted((r.y, r.x, r.v) for r in got.collect())
    assert [(y, x) for y, x, _ in rows] == [(y, x) for y in range(32) for x in range(32)]
    want = [i % 256 for i in range(1000)]
    if "null" in ids:
        want = [5, *want[:5], *want[6:]]
    assert [v for _, _, v in rows] == want + [0] * 24


def test_all_events_of_the_smallest_tables_are_read(spark, small):
    events = {r.event_id: r for r in spark.read.parquet(f"{small}/events.parquet").collect()}
    got = {(r.y * 32 + r.x, r.channel): r.v for r in images.events_image(spark, small).collect()}
    assert len(events) == 1000 and len(got) == 3 * 1024
    for i, e in events.items():
        assert got[i, "Red"] == max(0, min(255, math.floor(e.value))) and got[i, "Green"] == math.floor(e.value * 7) % 256 and got[i, "Blue"] == e.user_id * 37 % 256


def test_blocks_must_be_whole(spark):
    image = frame(spark, noise())
    for bad in (image.where("y <> 3 or x <> 3"), image.unionByName(image.where("y = 0 and x = 0")), image.withColumn("v", F.when(F.col("x") > 0, F.col("v")))):
        with pytest.raises(Exception, match="is not whole"):
            blocks.to_vectors(bad, 16).collect()


def test_long_planes_are_cut_into_runs(spark, monkeypatch):
    from blockloom.operators import order

    rng = np.random.default_rng(3)
    labels = rng.integers(0, 60, 101)
    d = labels_of(spark, labels).unionByName(labels_of(spark, labels[::-1].copy()).withColumn("channel", F.lit("Red")))
    codes = coding.huffman_codes(coding.histogram(coding.delta_encode(d), "d"))

    def steps():
        deltas = coding.delta_encode(d)
        at = coding.bit_offsets(deltas, codes)
        return [sorted(map(str, t.collect())) for t in (deltas, coding.delta_decode(deltas), at)], coding.huffman_pieces(deltas, codes)

    whole, one = steps()
    monkeypatch.setattr(order, "RUN", 7)
    monkeypatch.setattr(order, "BROADCAST_RUNS", 3)
    cut, pieces = steps()
    assert cut == whole
    for channel in ("Gray", "Red"):
        (want,) = one.where(F.col("channel") == channel).collect()
        stream = bytearray(len(want.data))
        parts = pieces.where(F.col("channel") == channel).orderBy("piece").collect()
        assert len(parts) == 15 and all(p.roundtrip for p in parts)
        for p in parts:
            for k, byte in enumerate(bytes(p.data)):
                stream[p.start // 8 + k] |= byte
        assert bytes(stream) == bytes(want.data)
    assert coding.huffman_streams(pieces, codes).collect() == coding.huffman_streams(one, codes).collect()


def test_large_planes_are_trained_on_all_executors(spark, monkeypatch):
    config = VQConfig(width=32, height=32, codes=8, precision="float64")
    v = frame(spark, noise(3, (32, 32))).unionByName(frame(spark, noise(4, (32, 32)), "Red")).unionByName(frame(spark, noise(5, (32, 32)), name="j"))
    v = blocks.to_vectors(v, 32)
    want = train.fit(v, config)
    monkeypatch.setattr(train, "TOGETHER", 2)
    for most in (0, 64 * 16 - 1):
        monkeypatch.setattr(train, "GROUPED", most)
        got = train.fit(v, config)
        assert sorted(map(str, got.labels.collect())) == sorted(map(str, want.labels.collect()))
        key = lambda r: r[:3]
        assert np.allclose([r.w for r in sorted(got.codebook.collect(), key=key)], [r.w for r in sorted(want.codebook.collect(), key=key)])
        assert got.iterations.count() == want.iterations.count() and got.seconds.count() == 3
    part = train.fit(v.unionByName(v.where("image_id = 'j'").withColumns({"image_id": F.lit("k"), "vec_idx": F.col("vec_idx") + 64})), config)
    assert part.codebook.groupBy("image_id", "channel").count().count() == 4


def test_nearest_codes_of_many_codebooks_are_joined(spark, monkeypatch):
    v = blocks.to_vectors(frame(spark, noise(1)).unionByName(frame(spark, noise(2), "Red")), 16)
    book = v.where("vec_idx % 3 = 0 and (channel = 'Gray' or vec_idx < 9)").withColumnsRenamed({"vec_idx": "code", "v": "w"})
    want = sorted(map(str, assign.nearest(v, book).collect()))
    monkeypatch.setattr(assign, "BOOKS", 3)
    assert sorted(map(str, assign.nearest(v, book).collect())) == want and len(want) == 32


def test_strips_make_the_whole_file(spark):
    gray = noise(7, (12, 10))
    d = frame(spark, gray)
    color = d.withColumn("channel", F.lit("Red")).unionByName(d.withColumn("channel", F.lit("Green"))).unionByName(d.withColumn("channel", F.lit("Blue")))
    for image in (d, color):
        want = bytes(sinks.to_bmp(image, 10, 12).head().data)
        for rows in (1, 5, 12, 99):
            assert b"".join(bytes(r.data) for r in sinks.to_strips(image, 10, 12, rows).orderBy("strip").collect()) == want


def test_written_images_are_read_again(spark, tmp_path):
    color = frame(spark, noise(1), "Red").unionByName(frame(spark, noise(2), "Green")).unionByName(frame(spark, noise(3), "Blue"))
    sinks.write_scans(color, f"file://{tmp_path}/c")
    got = images.scan_text(spark, f"file://{tmp_path}/c", 16, 16)
    assert sorted(map(str, got.drop("image_id").collect())) == sorted(map(str, color.drop("image_id").collect()))


def test_tables_go_as_soon_as_nothing_reads_them(spark, tmp_path, monkeypatch):
    from blockloom.plans import tables

    paths = []
    make = tables.scratch
    monkeypatch.setattr(tables, "scratch", lambda s: paths.append(make(s)) or paths[-1])

    @tables.tidy
    def inner():
        return tables.written(tables.written(spark.range(3)).where("id > 0"))

    @tables.tidy
    def outer():
        return inner().join(tables.written(spark.range(9)), "id")

    import os

    kept = inner()
    assert [os.path.exists(p.removeprefix("file://")) for p in paths] == [False, True] and kept.count() == 2
    assert outer().count() == 2 and [os.path.exists(p.removeprefix("file://")) for p in paths[2:]] == [False, True, True]


def test_a_cluster_needs_a_shared_folder(monkeypatch):
    from types import SimpleNamespace

    from blockloom.plans import tables

    session = SimpleNamespace(conf=SimpleNamespace(get=lambda k, d: None), sparkContext=SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(RuntimeError, match="checkpoint"):
        tables.shared_folder(session)
    session.sparkContext.master = "local[2]"
    assert tables.shared_folder(session).startswith("file://")
    session.conf.get = lambda k, d: "hdfs://x/y/"
    assert tables.shared_folder(session) == "hdfs://x/y"
