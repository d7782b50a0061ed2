"""The corpus pipeline: five stages, each written as Parquet and read again by the next.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of docs.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockloom.llm import bpe, jaccard, mixing, quality, substr
from blockloom.llm.common import documents, fits, fresh, tidy, written

#: Bytes of a batch of rows on its way to Python. Spark's own bound lets 10,000 rows of text through, buffers of 32 MB that an executor's allocator keeps.
BATCH_BYTES = 4 << 20
BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(stage: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """stage, before which the session's batches are bounded by BATCH_BYTES, unless they are already by less. They stay so: what a stage returns runs later. No result depends on it."""

    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        held = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(BATCH_SETTING))
        if not 0 < held <= BATCH_BYTES:
            spark.conf.set(BATCH_SETTING, f"{BATCH_BYTES}b")
        return stage(spark, docs, sf_dir)

    return run


@small_batches
def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject, rows as they are.

    Null and empty texts are scored like any text, as ones without words; rows without an id are judged, too; repeated
    rows are judged alike; an empty table gives none. Extra columns stay, whatever their names.
    """
    model = quality.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.classify_quality(docs, model, keep_row=True).where("predicted = 1").select("row.*")


@small_batches
@tidy
def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near copies, rows as they are.

    Documents without an id stay, as do those whose text is null or has no words; of rows that repeat an id and its text, one stays.
    An empty table gives none. Extra columns stay, whatever their names.
    """
    gone, again = fresh(docs, "gone"), fresh(docs, "again")
    found = written(jaccard.jaccard_components(docs))
    lost = found.where("doc_id <> component_id").select(F.col("doc_id").alias(gone)).distinct()
    lost = F.broadcast(lost) if fits(lost, jaccard.BROADCAST_IDS) else lost
    kept = docs.join(lost, F.col("doc_id") == F.col(gone), "left_anti")
    twice = found.groupBy(F.col("doc_id").alias(again)).agg(F.count("*").alias("n")).where((F.col("n") > 1) & F.col(again).isNotNull()).select(again)
    if not twice.limit(1).count():
        return kept
    twice = written(twice)
    twice = F.broadcast(twice) if fits(twice, jaccard.BROADCAST_IDS) else twice
    on = F.col("doc_id") == F.col(again)
    return kept.join(twice, on, "left_anti").unionByName(kept.join(twice, on, "left_semi").dropDuplicates(["doc_id", "text"]))


@small_batches
def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the windows that documents with smaller ids have; a text that loses nothing stays as it is.

    Null, empty and short texts and rows without an id lose nothing; rows that share an id don't count against each other. Every
    row stays, also one whose text loses all. Extra columns stay, whatever their names; n_chars, if it is one, follows the text.
    """
    kept, gone = fresh(docs, "kept"), fresh(docs, "gone")
    cut = substr.dedup_substrings(docs, keep_row=True).select("row.*", F.col("kept").alias(kept), F.col("n_removed").alias(gone))
    cut = cut.withColumn("text", F.when(F.col(gone) > 0, F.col(kept)).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.when(F.col(gone) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return cut.select(*(f"`{c}`" for c in docs.columns))


@small_batches
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it, rows as they are.

    Null and empty texts have no words and are taken as often as whole copies of their source are; a null source is one of its own. An
    empty table gives none. Extra columns stay, whatever their names.
    """
    chosen = mixing.mix_sources(docs, keep_text=True)
    return chosen.select(F.explode(F.array_repeat("row", F.col("copies").cast("int"))).alias("row")).select("row.*")


@small_batches
def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every document of the mix: doc_id, n_tokens, ids_sha256, decoded_sha256.

    Null and empty texts have no tokens; ids may be null or repeat; an empty table gives none. Other columns are not looked at.
    """
    return bpe.bpe_encode_decode(docs, bpe.vocabulary())


STAGES = [
    ("quality classifier", keep_quality),
    ("n-gram Jaccard join", keep_one_of_each_group),
    ("substring dedup", cut_repeats),
    ("mixing sources to target weights", mix),
    ("BPE encoding and decoding", encode),
]

#: Trained trees and hashed sets are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


@tidy
def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
