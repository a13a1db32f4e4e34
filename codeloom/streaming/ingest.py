"""Streaming upkeep of the file snapshot, and windowed counts of an event stream."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from codeloom.model import files_now
from codeloom.session import ensure_checkpoint_dir, table


def stream_table(spark: SparkSession, sf_dir: str, name: str, files_per_batch: int = 4) -> DataFrame:
    """The named table as a stream of its files (the table is one file or a folder of parts)."""
    static = table(spark, sf_dir, name)
    reader = spark.readStream.schema(static.schema).option("maxFilesPerTrigger", files_per_batch)
    files = static.inputFiles()
    if len(files) == 1 and files[0].endswith(f"/{name}.parquet"):
        return reader.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)
    return reader.parquet(f"{sf_dir}/{name}.parquet")


def _stored(spark: SparkSession, place: str, schema: StructType, below: int | None = None) -> DataFrame | None:
    """The newest version of every bucket under ``place``, of versions before ``below``; None if there is none."""
    try:
        rows = spark.read.schema(StructType([*schema.fields, StructField("version", LongType()), StructField("bucket", IntegerType())])).parquet(place)
    except AnalysisException:  # nothing was written yet
        return None
    if below is not None:
        rows = rows.where(F.col("version") < below)
    newest = rows.groupBy("bucket").agg(F.max("version").alias("version"))
    return rows.join(newest, ["bucket", "version"])


def keep_files_snapshot(spark: SparkSession, stream: DataFrame, place: str | None = None, buckets: int = 32) -> DataFrame:
    """Run a stream of ``files`` rows to its end and return the latest row per id.

    ``place`` is a folder that all executors share; a later call with the same place goes on where
    the stream stood, and what was kept is kept. Rows lie in buckets by their id. A micro-batch reads
    and writes only the buckets of its own ids, as a version with the number of the batch, so a batch
    that is run again overwrites its own version and the result holds each row once. Late and repeated
    rows do not change the latest. Versions of a bucket before its newest may be removed at any time.
    """
    place = place or f"{ensure_checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    rows_at, schema = f"{place}/rows", stream.schema

    def merge(batch: DataFrame, batch_id: int) -> None:
        fresh = batch.withColumn("bucket", F.pmod(F.xxhash64("id"), F.lit(buckets)).cast("int"))
        before = _stored(spark, rows_at, schema, batch_id)
        if before is not None:
            fresh = fresh.unionByName(before.drop("version").join(fresh.select("bucket").distinct(), "bucket", "left_semi"))
        files_now(fresh).write.mode("overwrite").partitionBy("bucket").parquet(f"{rows_at}/version={batch_id}")

    query = stream.writeStream.foreachBatch(merge).option("checkpointLocation", f"{place}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    kept = _stored(spark, rows_at, schema)
    return spark.createDataFrame([], schema) if kept is None else kept.select(*schema.names)


def windowed_counts(stream: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(start, event_type, n, total): event counts per tumbling window, for batch or stream.

    As a stream, rows that come later than ``late`` after the newest are dropped by the watermark.
    """
    rows = stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late) if stream.isStreaming else stream
    g = rows.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return g.select(F.col("w.start").alias("start"), "event_type", "n", "total")
