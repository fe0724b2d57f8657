"""Bars out of a stream of events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: The time of the mark that ends a stream.
END = "9000-01-01 00:00:00"


def read_events(spark: SparkSession, path: str, schema: StructType, marks: str) -> DataFrame:
    """The event files of a folder as a stream, with the marks of another one that close it."""
    spark.createDataFrame([], schema).write.mode("append").parquet(marks)  # the folder has to be there
    return spark.readStream.schema(schema).parquet(path).unionByName(spark.readStream.schema(schema).parquet(marks))


def close_stream(spark: SparkSession, schema: StructType, marks: str) -> None:
    """Mark the stream as ended: the watermark passes all open windows with the next run. Events after that are late."""
    cells = [F.to_timestamp_ntz(F.lit(END)).cast(f.dataType) if f.name == "ts" else F.lit(None).cast(f.dataType) for f in schema]
    spark.range(1).select(*[c.alias(f.name) for c, f in zip(cells, schema, strict=True)]).write.mode("append").parquet(marks)


def streaming_bars(events: DataFrame, minutes: int = 30, late: str = "1 hour") -> DataFrame:
    """Bars of a stream: tumbling windows that close once the watermark is past them. The state holds open windows only; that of an end mark never closes."""
    rows = events.select("event_type", "event_id", F.col("ts").cast("timestamp").alias("ts"), (100 + F.col("value") / 100).alias("px")).withWatermark("ts", late)
    order = F.struct("ts", "event_id")
    bars = rows.groupBy(F.window("ts", f"{minutes} minutes"), F.col("event_type")).agg(
        F.min_by("px", order).alias("open"), F.max("px").alias("high"), F.min("px").alias("low"), F.max_by("px", order).alias("close"), F.count("*").cast("double").alias("volume"), F.sum("px").alias("amt"),
    )
    return bars.select(F.col("event_type").alias("symbol"), F.col("window.start").cast("timestamp_ntz").alias("ts"), "open", "high", "low", "close", "volume", "amt")


def write_bars(bars: DataFrame, path: str, checkpoint: str):
    """Append closed bars to a Parquet table, each once: the sink's log and the checkpoint go together. All input that is there, then stop."""
    return bars.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
