"""Queries that run as streams over a table's files until all have been read, with SQL where it can give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidecast.sources.written import fresh_path
from tidecast.streaming import events

LATE = "6 hours"


def all_of(stream: DataFrame) -> DataFrame:
    """What a stream writes until all that is there has been read, as a table in the shared folder."""
    spark = stream.sparkSession
    out, marks = fresh_path(spark, "stream"), fresh_path(spark, "marks")
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", marks).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/events.parquet")
    return spark.readStream.schema(table.schema).parquet(f"{sf_dir}/event[s].parquet").withColumn("one", F.lit(1))


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by type and hour from the raw stream; hours that the watermark has not passed are still open."""
    closed = events.steps(event_stream(spark, sf_dir), "event_type", "ts", "one", "hour", LATE)
    return all_of(closed).select("series_id", "t", F.col("y").cast("long").alias("n"))


HOURLY_SQL = """WITH h AS (SELECT event_type AS series_id, date_trunc('hour', CAST(ts AS TIMESTAMP)) AS hour, count(*) AS n FROM events WHERE event_type IS NOT NULL AND ts IS NOT NULL GROUP BY 1, 2)
SELECT series_id, CAST(epoch(hour) // 3600 AS BIGINT) AS t, n FROM h WHERE hour + INTERVAL 1 HOUR <= (SELECT max(CAST(ts AS TIMESTAMP)) FROM events) - INTERVAL 6 HOUR"""


def followed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly events by type, with weights on the last two hours, the day before and three neurons that follow the stream."""
    ends = spark.read.parquet(f"{sf_dir}/events.parquet").where("event_type is not null").select("event_type").distinct()
    plans = ends.select(F.col("event_type").alias("series_id"), F.array(F.lit(1), F.lit(2), F.lit(24)).alias("lags"), F.lit(0.0).alias("low"), F.lit(100.0).alias("high"))
    steps = all_of(events.steps(event_stream(spark, sf_dir), "event_type", "ts", "one", "hour", LATE))
    again = spark.readStream.schema(steps.schema).parquet(steps.inputFiles()[0].rsplit("/", 1)[0])
    return all_of(events.follow(again, plans, hidden=3, h=3)).select("series_id", "t", "y", "filled", F.round("expected", 6).alias("expected"), F.transform("ahead", lambda v: F.round(v, 6)).alias("ahead"))


STREAMS = {"stream_hourly_steps": (hourly, HOURLY_SQL)}
LEARNED = {"stream_followed": followed}
