"""Streams of images: text files that arrive in a folder go through the whole pipeline, a micro-batch at a time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from blockloom.plans import pipeline
from blockloom.plans.config import VQConfig
from blockloom.plans.tables import written
from blockloom.sources.images import cells_of, integer_prefix, mode_of


def with_mode(files: DataFrame, width: int, height: int) -> DataFrame:
    """(image_id, value: the text) -> (image_id, tokens, mode): gray, color or unknown, by the number of integers."""
    t = files.select("image_id", integer_prefix(F.col("value")).alias("tokens"))
    return t.withColumn("mode", mode_of(F.size("tokens"), width, height))


def metrics_stream(spark: SparkSession, source: str, target: str, checkpoint: str, config: VQConfig, errors: str | None = None) -> StreamingQuery:
    """Write each new image's metrics, a row a plane, to a Parquet folder, and files that are neither a gray nor a color image to another.

    The latter, `errors` (by default `target` with _errors), gets image_id and the number of integers. A batch that is run again replaces its own folders.
    """
    errors = errors or f"{target.rstrip('/')}_errors"
    files = spark.readStream.format("text").option("wholetext", True).schema("value string").load(source)
    files = files.select(F.col("_metadata.file_path").alias("image_id"), "value")

    def batch(rows: DataFrame, number: int) -> None:
        read = written(with_mode(rows, config.width, config.height))
        bad = read.where("mode = 'unknown'").select("image_id", F.size("tokens").alias("tokens"))
        bad.write.mode("overwrite").parquet(f"{errors}/batch={number}")
        good = read.where("mode <> 'unknown'")
        if not good.limit(1).isEmpty():
            pipeline.run(cells_of(good, config.width), config).planes.write.mode("overwrite").parquet(f"{target}/batch={number}")

    return files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
