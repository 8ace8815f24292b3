"""Incremental maintenance: event windows with late data, and notes that arrive again and again.

Windows are an extension over the events table; batches of new notes stand for the study's repeated runs.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rotativa.functions import text as T
from rotativa.session import shared_folder


def state_folder(spark: SparkSession, name: str) -> str:
    """A new folder for a stream's state in the session's shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(place)


def event_stream(spark: SparkSession, path: str) -> DataFrame:
    """A stream over the Parquet files at ``path``, a folder or one file (which the source takes as a pattern only)."""
    pattern = f"{path[:-1]}[{path[-1]}]" if path.endswith(".parquet") else path
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(pattern)


def window_counts(events: DataFrame, time: str, size: str, late: str, *keys: str, slide: str | None = None) -> DataFrame:
    """(start, keys, n): counts of tumbling or sliding windows; events later than ``late`` are left out."""
    window = F.window(time, size, slide) if slide else F.window(time, size)
    counted = events.withWatermark(time, late).groupBy(window, *keys).agg(F.count("*").alias("n"))
    return counted.select(F.col("window.start").alias("start"), *keys, "n")


def run_available(stream: DataFrame, path: str, mode: str = "append") -> None:
    """Work off what is there, write it to ``path`` as Parquet, and stop."""
    query = stream.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", state_folder(stream.sparkSession, "run")).trigger(availableNow=True).start()
    query.awaitTermination()


def new_notes(batch: DataFrame, stored: DataFrame | None, key: str = "url", text: str = "cuerpo", order: str = "id") -> DataFrame:
    """Rows of a batch whose key and content are neither stored nor earlier in the batch."""
    hashed = batch.withColumn("_h", T.content_hash(F.col(text)))
    by_key = hashed.groupBy(key).agg(F.min(order).alias(order))
    firsts = hashed.join(by_key.select(order), order, "left_semi")
    same = firsts.where("_h != ''").groupBy("_h").agg(F.min(order).alias(order))
    kept = firsts.join(firsts.where("_h = ''").select(order).unionByName(same.select(order)), order, "left_semi")
    if stored is not None:
        kept = kept.join(stored.select(key).distinct(), key, "left_anti")
        kept = kept.join(stored.select(T.content_hash(F.col(text)).alias("_h")).where("_h != ''").distinct(), "_h", "left_anti")
    return kept.select(*batch.columns)


def ingest(stream: DataFrame, path: str, key: str = "url", text: str = "cuerpo", order: str = "id") -> None:
    """Append the new notes of each micro-batch to the table at ``path``."""

    def append(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        # the table does not exist before its first batch; one that cannot be read is an error
        stored = spark.read.parquet(path) if exists(spark, path) else None
        fresh = new_notes(batch, stored, key, text, order).persist()
        fresh.count()
        fresh.write.mode("append").parquet(path)
        fresh.unpersist()

    query = stream.writeStream.foreachBatch(append).option("checkpointLocation", state_folder(stream.sparkSession, "ingest")).trigger(availableNow=True).start()
    query.awaitTermination()


def count_batches(stream: DataFrame, path: str, time: str, size: str, *keys: str) -> None:
    """Append the window counts of each micro-batch to ``path``; windows that lie in several batches are summed by the reader."""

    def append(batch: DataFrame, _: int) -> None:
        counted = batch.groupBy(F.window(time, size), *keys).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), *keys, "n")
        counted.write.mode("append").parquet(path)

    query = stream.writeStream.foreachBatch(append).option("checkpointLocation", state_folder(stream.sparkSession, "count")).trigger(availableNow=True).start()
    query.awaitTermination()
