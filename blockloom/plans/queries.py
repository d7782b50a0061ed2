"""Registered queries over the image that is derived from the events table, and over embeddings."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from blockloom.functions.pixels import clamp
from blockloom.operators import assign, blocks, coding, fidelity, partition, stencil, train
from blockloom.operators.blocks import PLANE
from blockloom.sources import images, sinks

from . import pipeline
from .config import VQConfig
from .tables import scratch, tidy, written

#: Codes of the fixed codebook: every n-th vector. The queries after training use it, so that SQL can follow them.
CODES = 16


class Scene:
    """The derived image of a scale factor and what queries share of it."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self.frame = images.events_frame(spark, sf_dir)
        self.width, self.height = self.frame.width, self.frame.height
        self.n = (self.width // 4) * (self.height // 4)
        self.config = VQConfig(width=self.width, height=self.height, codes=CODES)
        # The full training has the reference's codes.
        self.trained = VQConfig(width=self.width, height=self.height)
        self.tables: dict[str, DataFrame] = {}

    def pixels(self, color: bool = True) -> DataFrame:
        return images.events_image(self.spark, self.sf_dir, color=color, frame=self.frame)

    def vectors(self, color: bool = True) -> DataFrame:
        return blocks.to_vectors(self.pixels(color), self.width)

    def kept(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        """A table that several steps of a query read is made once."""
        if name not in self.tables:
            self.tables[name] = written(make())
        return self.tables[name]

    def blocks(self) -> DataFrame:
        return self.kept("blocks", self.vectors)

    def nth(self, vectors: DataFrame) -> DataFrame:
        """Every n-th vector as a codebook."""
        step = max(1, self.n // CODES)
        code = F.floor(F.col("vec_idx") / step).cast("int")
        return vectors.where((F.col("vec_idx") % step == 0) & (code < CODES)).select(*PLANE, code.alias("code"), F.col("v").cast("array<double>").alias("w"))

    def codebook(self) -> DataFrame:
        return self.nth(self.blocks())

    def labelled(self) -> DataFrame:
        return self.kept("labelled", lambda: assign.nearest(self.blocks(), self.codebook()))

    def deltas(self) -> DataFrame:
        return self.kept("deltas", lambda: coding.delta_encode(self.labelled()))

    def codes(self) -> DataFrame:
        return self.kept("codes", lambda: coding.huffman_codes(coding.histogram(self.deltas(), "d")))

    def decoded(self) -> DataFrame:
        return blocks.decode(self.labelled(), self.codebook(), self.width)

    def pairs(self) -> DataFrame:
        return self.kept("pairs", lambda: stencil.paired(self.pixels(), self.decoded()))


def cells(vectors: DataFrame, *columns: str, array: str = "v") -> DataFrame:
    return vectors.select("channel", *columns, F.posexplode(array).alias("pos", "v")).withColumn("v", F.col("v").cast("double"))


def plain(df: DataFrame) -> DataFrame:
    return df.drop("image_id")


def rounded6(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


def image_pixels(spark, sf_dir):
    return plain(Scene(spark, sf_dir).pixels(color=False))


def image_pixels_rgb(spark, sf_dir):
    return plain(Scene(spark, sf_dir).pixels())


def clamp_pixels(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select("event_id", clamp(F.floor("value")).cast("int").alias("v"))


def integer_tokens(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", images.integer_prefix(F.col("text")).alias("tokens"))
    values = F.transform("tokens", lambda t: images.token_value(t))
    return d.select("doc_id", F.coalesce(F.size("tokens"), F.lit(0)).alias("tokens"), F.coalesce(F.aggregate(values, F.lit(0).cast("bigint"), lambda a, x: a + x), F.lit(0)).alias("total"))


def detect_mode(spark, sf_dir):
    s = Scene(spark, sf_dir)
    counts = s.pixels().groupBy().agg(F.count("*").alias("tokens")).union(s.pixels(False).groupBy().agg(F.count("*"))).union(s.pixels().where("y > 0").groupBy().agg(F.count("*")))
    return counts.select("tokens", images.mode_of(F.col("tokens"), s.width, s.height).alias("mode"))


def training_vectors(spark, sf_dir):
    return cells(Scene(spark, sf_dir).vectors(), "vec_idx")


def unblock_roundtrip(spark, sf_dir):
    s = Scene(spark, sf_dir)
    return plain(blocks.to_pixels(s.vectors(), s.width))


def channel_recombine(spark, sf_dir):
    return plain(blocks.merge_channels(Scene(spark, sf_dir).pixels()))


def seed_codeword(spark, sf_dir):
    return rounded6(cells(assign.seed_codeword(Scene(spark, sf_dir).vectors()), "code", array="w"), "v")


def codebook_split(spark, sf_dir):
    s = Scene(spark, sf_dir)
    return rounded6(cells(assign.split_codebook(s.codebook()), "code", array="w"), "v")


def sq_distance(spark, sf_dir):
    s = Scene(spark, sf_dir)
    return plain(assign.distances(s.blocks(), s.codebook()))


def nearest_codeword(spark, sf_dir):
    return plain(Scene(spark, sf_dir).labelled().drop("v"))


def lloyd_step(spark, sf_dir):
    s = Scene(spark, sf_dir)
    return rounded6(cells(assign.update_codebook(s.codebook(), assign.cell_sums(s.labelled())), "code", array="w"), "v")


def lloyd_distortion(spark, sf_dir):
    return rounded6(plain(assign.distortion(assign.cell_sums(Scene(spark, sf_dir).labelled()))), "distortion")


def empty_cell_carry(spark, sf_dir):
    """The step of a codebook with one more code, far from every vector, which keeps its value."""
    s = Scene(spark, sf_dir)
    far = s.codebook().where("code = 0").select(*PLANE, F.lit(CODES).alias("code"), F.array_repeat(F.lit(10000.0), 16).alias("w"))
    book = s.codebook().unionByName(far)
    new = assign.update_codebook(book, assign.cell_sums(assign.nearest(s.blocks(), book)))
    return rounded6(cells(new, "code", array="w"), "v")


def small_config(s: Scene) -> VQConfig:
    """Two stages of three iterations each, in double precision: what SQL can follow step by step."""
    return VQConfig(width=s.width, height=s.height, codes=4, epsilon=-1.0, max_iter=3, precision="float64")


def lbg_codebook_small(spark, sf_dir):
    s = Scene(spark, sf_dir)
    return rounded6(cells(train.fit_grouped(s.vectors(), small_config(s)).codebook, "code", array="w"), "v")


def lbg_labels_small(spark, sf_dir):
    s = Scene(spark, sf_dir)
    return plain(train.fit_grouped(s.vectors(), small_config(s)).labels)


def lbg_iterations_small(spark, sf_dir):
    s = Scene(spark, sf_dir)
    log = plain(train.fit_grouped(s.vectors(), small_config(s)).iterations)
    return log.select("channel", "k", "iter", F.round("distortion", 6).alias("distortion"), F.when(F.col("iter") > 1, F.round("improvement", 6)).alias("improvement"))


def lbg_distributed_small(spark, sf_dir):
    s = Scene(spark, sf_dir)
    trained = train.fit_distributed(s.vectors(color=False), small_config(s))
    return rounded6(cells(trained.codebook, "code", array="w"), "v")


def lbg_codebook(spark, sf_dir):
    s = Scene(spark, sf_dir)
    return cells(train.fit(s.kept("blocks", s.vectors), s.trained).codebook, "code", array="w")


def lbg_labels(spark, sf_dir):
    s = Scene(spark, sf_dir)
    return plain(train.fit(s.kept("blocks", s.vectors), s.trained).labels)


def lbg_iterations(spark, sf_dir):
    s = Scene(spark, sf_dir)
    return plain(train.fit(s.kept("blocks", s.vectors), s.trained).iterations)


def embedding_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return e.select(F.lit("embeddings").alias("image_id"), F.col("label").cast("string").alias("channel"), F.col("vec_id").cast("int").alias("vec_idx"), F.col("embedding").alias("v"))


def embedding_vq_small(spark, sf_dir):
    """Two stages of two iterations each on the vectors of each label, which SQL can follow."""
    trained = train.fit(written(embedding_vectors(spark, sf_dir)), VQConfig(codes=4, epsilon=-1.0, max_iter=2, precision="float64"))
    return trained.labels.select("channel", "vec_idx", "label")


def embedding_vq(spark, sf_dir):
    """A codebook of 4 codes for the 64-dimensional vectors of each label."""
    trained = train.fit(written(embedding_vectors(spark, sf_dir)), VQConfig(codes=4))
    return trained.labels.select("channel", "vec_idx", "label")


def embedding_nearest(spark, sf_dir):
    """Each embedding's nearest among the first 8 of its label."""
    v = embedding_vectors(spark, sf_dir)
    # Each task keeps its own first 8 before rows are sent.
    turn = F.row_number().over(Window.partitionBy(*PLANE).orderBy("vec_idx"))
    book = v.withColumn("code", turn - 1).where("code < 8").select(*PLANE, "code", F.col("v").cast("array<double>").alias("w"))
    return rounded6(plain(assign.nearest(v, book, 64)).select("channel", "vec_idx", "label", "dist"), "dist")


def codebook_u8(spark, sf_dir):
    s = Scene(spark, sf_dir)
    book = assign.update_codebook(s.codebook(), assign.cell_sums(s.labelled()))
    return plain(pipeline.codebook_bytes(book)).select("channel", "code", F.posexplode("w").alias("pos", "v"))


def codebook_head(spark, sf_dir):
    s = Scene(spark, sf_dir)
    return plain(pipeline.codebook_head(s.codebook()))


def decompress(spark, sf_dir):
    return plain(Scene(spark, sf_dir).decoded())


def label_entropy(spark, sf_dir):
    return rounded6(plain(coding.entropy(Scene(spark, sf_dir).labelled(), "label", CODES)), "entropy")


def delta_entropy(spark, sf_dir):
    return rounded6(plain(coding.entropy(Scene(spark, sf_dir).deltas(), "d", 256)), "entropy")


def delta_encode(spark, sf_dir):
    return plain(Scene(spark, sf_dir).deltas())


def delta_decode(spark, sf_dir):
    return plain(coding.delta_decode(Scene(spark, sf_dir).deltas()))


def symbol_freq(spark, sf_dir):
    return plain(coding.histogram(Scene(spark, sf_dir).deltas(), "d"))


def used_symbols(spark, sf_dir):
    return Scene(spark, sf_dir).deltas().groupBy("channel").agg(F.countDistinct("d").alias("symbols"))


def huffman_sizes(spark, sf_dir):
    return plain(coding.huffman_sizes(coding.histogram(Scene(spark, sf_dir).deltas(), "d")))


def huffman_event_types(spark, sf_dir):
    h = spark.read.parquet(f"{sf_dir}/events.parquet").groupBy("event_type").agg(F.count("*").alias("freq"))
    return h.agg(coding.huffman_cost(F.collect_list("freq")).alias("bits"))


def huffman_codes(spark, sf_dir):
    return plain(Scene(spark, sf_dir).codes())


def huffman_lengths(spark, sf_dir):
    """Kraft sums and coded bits of the code tables."""
    codes = Scene(spark, sf_dir).codes()
    return codes.groupBy("channel").agg(F.sum(F.pow(F.lit(2.0), -F.col("len"))).alias("kraft"), F.sum(F.col("freq") * F.col("len")).alias("bits"))


def huffman_encode(spark, sf_dir):
    """The pieces of each plane's stream."""
    s = Scene(spark, sf_dir)
    return plain(coding.huffman_pieces(s.deltas(), s.codes())).select("channel", "piece", "n", "start", "bits", F.lower(F.hex("data")).alias("data"))


def huffman_roundtrip(spark, sf_dir):
    s = Scene(spark, sf_dir)
    return plain(coding.huffman_streams(coding.huffman_pieces(s.deltas(), s.codes()), s.codes()))


def bit_offsets(spark, sf_dir):
    s = Scene(spark, sf_dir)
    return plain(coding.bit_offsets(s.deltas(), s.codes()))


def stream_bits(spark, sf_dir):
    """The last code of each plane ends where its stream does."""
    s = Scene(spark, sf_dir)
    at = coding.bit_offsets(s.deltas(), s.codes())
    return at.groupBy("channel").agg(F.count("*").alias("symbols"), F.max(F.col("start") + F.col("len")).alias("bits"))


def roundtrip_mismatches(spark, sf_dir):
    s = Scene(spark, sf_dir)
    return plain(coding.mismatches(s.labelled(), coding.delta_decode(s.deltas())))


def compression_ratios(spark, sf_dir):
    s = Scene(spark, sf_dir)
    sizes = coding.huffman_sizes(coding.histogram(s.deltas(), "d"))
    got = fidelity.compression_ratios(sizes, s.width * s.height, s.n, s.config)
    return rounded6(plain(got).select("channel", "cr_data", "cr_total", "cr_system", "cr_fixed", "bpp"), "cr_data", "cr_total", "cr_system", "cr_fixed", "bpp")


def bilateral_filter(spark, sf_dir):
    return plain(stencil.bilateral(Scene(spark, sf_dir).decoded()))


def gaussian_window(spark, sf_dir):
    c = VQConfig()
    g = stencil.gaussian(c.ssim_window, c.ssim_sigma)
    axis = F.array(*map(F.lit, g))
    i = spark.range(len(g) ** 2).select((F.col("id") / len(g)).cast("int").alias("i"), (F.col("id") % len(g)).cast("int").alias("j"))
    return i.select("i", "j", F.round(F.element_at(axis, F.col("i") + 1) * F.element_at(axis, F.col("j") + 1), 12).alias("w"))


def mse_psnr(spark, sf_dir):
    s = Scene(spark, sf_dir)
    return rounded6(plain(fidelity.mse_psnr(s.pairs())), "mse", "psnr")


def ssim_map(spark, sf_dir):
    s = Scene(spark, sf_dir)
    return rounded6(plain(stencil.ssim_map(s.pairs(), s.width, s.height)), "ssim")


def ssim_mean(spark, sf_dir):
    s = Scene(spark, sf_dir)
    m = stencil.ssim_map(s.pairs(), s.width, s.height)
    return rounded6(m.groupBy("channel").agg(F.count("*").alias("windows"), F.avg("ssim").alias("ssim")), "ssim")


def rgb_aggregate(spark, sf_dir):
    s = Scene(spark, sf_dir)
    pairs = s.pairs()
    planes = fidelity.mse_psnr(pairs).join(stencil.ssim_map(pairs, s.width, s.height).groupBy(*PLANE).agg(F.avg("ssim").alias("ssim")), PLANE)
    planes = planes.join(coding.huffman_sizes(coding.histogram(s.deltas(), "d")), PLANE)
    got = fidelity.image_metrics(planes, s.width * s.height, s.config.codes * s.config.length)
    return rounded6(plain(got), *IMAGE_METRICS)


def equal_split_plan(spark, sf_dir):
    return partition.equal_split(spark, Scene(spark, sf_dir).n, 6)


def weighted_split_plan(spark, sf_dir):
    """Every nation as a worker, whose speed follows from its key."""
    speeds = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").cast("int").alias("rank"), (F.col("n_nationkey") % 3 + 1).cast("double").alias("speed"))
    return partition.weighted_split(speeds, Scene(spark, sf_dir).n)


def two_codeword_psnr(spark, sf_dir):
    """Seed, one split, one step, decode, metrics: the smallest slice of the whole pipeline."""
    s = Scene(spark, sf_dir)
    v = s.kept("gray", lambda: s.vectors(color=False))
    book = assign.split_codebook(assign.seed_codeword(v))
    labelled = written(assign.nearest(v, book))
    new = assign.update_codebook(book, assign.cell_sums(labelled))
    return rounded6(plain(fidelity.mse_psnr(stencil.paired(s.pixels(False), blocks.decode(labelled, new, s.width)))), "mse", "psnr")


def bmp_image(spark, sf_dir):
    s = Scene(spark, sf_dir)
    return sinks.to_bmp(s.pixels(), s.width, s.height).select("image_id", F.length("data").alias("bytes"), F.sha2("data", 256).alias("sha256"))


def bmp_gray(spark, sf_dir):
    s = Scene(spark, sf_dir)
    return sinks.to_bmp(s.pixels(False), s.width, s.height).select("image_id", F.length("data").alias("bytes"), F.sha2("data", 256).alias("sha256"))


def text_image(spark, sf_dir):
    t = sinks.text_lines(Scene(spark, sf_dir).pixels())
    return t.select("channel", F.length("value").alias("chars"), F.sha2("value", 256).alias("sha256"))


def scanned(spark: SparkSession, sf_dir: str, color: bool) -> DataFrame:
    """The derived image, written as a text file of integers and read from it."""
    s = Scene(spark, sf_dir)
    path = scratch(spark)
    sinks.write_scans(s.pixels(color), path)
    return plain(images.scan_text(spark, path, s.width, s.height))


def scan_text(spark, sf_dir):
    return scanned(spark, sf_dir, False)


def scan_text_rgb(spark, sf_dir):
    return scanned(spark, sf_dir, True)


PLANE_METRICS = ["mse", "psnr", "ssim", "entropy_label", "entropy_delta", "cr_data", "cr_total", "cr_system", "cr_fixed", "bpp"]
IMAGE_METRICS = ["mse", "ssim", "psnr", "cr_system"]


def pipeline_gray(spark, sf_dir):
    s = Scene(spark, sf_dir)
    planes = pipeline.run(s.pixels(False), s.trained).planes
    return rounded6(planes.select("channel", "total_bytes", "roundtrip", *PLANE_METRICS), *PLANE_METRICS)


def pipeline_color(spark, sf_dir):
    s = Scene(spark, sf_dir)
    whole = pipeline.images(pipeline.run(s.pixels(), s.trained), s.trained)
    return rounded6(whole.drop("train_seconds"), *IMAGE_METRICS)


def pipeline_gray_fixed(spark, sf_dir):
    """The whole pipeline but the training: with every n-th block as codebook."""
    s = Scene(spark, sf_dir)
    planes = pipeline.run(s.pixels(False), s.config, s.nth).planes
    return rounded6(planes.select("channel", "total_bytes", "roundtrip", *PLANE_METRICS), *PLANE_METRICS)


def pipeline_color_fixed(spark, sf_dir):
    s = Scene(spark, sf_dir)
    whole = pipeline.images(pipeline.run(s.pixels(), s.config, s.nth), s.config)
    return rounded6(whole.drop("image_id", "train_seconds"), *IMAGE_METRICS)


NAMES = """two_codeword_psnr image_pixels image_pixels_rgb clamp_pixels integer_tokens detect_mode training_vectors unblock_roundtrip
channel_recombine seed_codeword codebook_split sq_distance nearest_codeword lloyd_step lloyd_distortion empty_cell_carry lbg_codebook_small
lbg_labels_small lbg_iterations_small lbg_distributed_small lbg_codebook lbg_labels lbg_iterations embedding_vq embedding_vq_small embedding_nearest codebook_u8
codebook_head decompress label_entropy delta_entropy delta_encode delta_decode symbol_freq used_symbols huffman_sizes huffman_event_types
huffman_codes huffman_lengths huffman_encode huffman_roundtrip bit_offsets stream_bits roundtrip_mismatches compression_ratios bilateral_filter gaussian_window mse_psnr ssim_map ssim_mean
rgb_aggregate equal_split_plan weighted_split_plan bmp_image bmp_gray text_image scan_text scan_text_rgb
pipeline_gray pipeline_color pipeline_gray_fixed pipeline_color_fixed""".split()

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {n: tidy(globals()[n]) for n in NAMES}
