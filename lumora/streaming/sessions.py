"""An extension that batch experiments don't need: sessions and windowed counts of a live log, with late data bounded."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumora.session import scratch


def live_sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(user_id, start, end, n, last_items) of each session of a stream of events(user_id, item_id, ts), closed after `gap`."""
    window = F.session_window("ts", gap)
    grouped = events.withWatermark("ts", late).groupBy("user_id", window.alias("w"))
    return grouped.agg(F.count("*").alias("n"), F.max_by("item_id", "ts").alias("last_item")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "last_item")


def live_popularity(events: DataFrame, size: str = "1 day", late: str = "1 hour") -> DataFrame:
    """(start, vertical, item_id, n): events by item in tumbling windows."""
    counted = events.withWatermark("ts", late).groupBy(F.window("ts", size).alias("w"), "vertical", "item_id").agg(F.count("*").alias("n"))
    return counted.select(F.col("w.start").alias("start"), "vertical", "item_id", "n")


def files_as_stream(spark: SparkSession, path: str) -> DataFrame:
    """The Parquet file or folder at path as a stream; wall-clock timestamps become those of the session's zone, as watermarks need."""
    schema = spark.read.parquet(path).schema
    stream = spark.readStream.schema(schema).parquet(f"{path[:-1]}[{path[-1]}]")  # a pattern, as a plain path has to be a folder
    return stream.withColumns({f.name: F.col(f.name).cast("timestamp") for f in schema.fields if f.dataType.typeName() == "timestamp_ntz"})


def drained(stream: DataFrame) -> DataFrame:
    """What a stream gives from all that is there now, in append mode: windows that its watermark has closed, each once.

    The sink and the stream's state are folders of their own in the shared folder, so a restarted query goes on where it was.
    """
    folder = scratch(stream.sparkSession, "stream-")
    query = stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/out")
