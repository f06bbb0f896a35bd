"""Streams: the request ledger, new files by content, and result sets that run out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.operators.aggregate import latency_by
from marginalia.plans.records import table
from marginalia.storage import new_folder


def summary(ledger: DataFrame) -> DataFrame:
    """Counts and sums by stage; the same frame works on a table or a stream."""
    return ledger.groupBy("event_type").agg(F.count("*").alias("requests"), F.round(F.sum("value"), 4).alias("total"), F.max("value").alias("slowest"))


def windowed(ledger: DataFrame, size: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Requests by window of time; rows later than ``late`` are left out of a stream."""
    return ledger.withWatermark("ts", late).groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("requests"), F.sum("value").alias("total"))


def drain(stream: DataFrame, mode: str) -> DataFrame:
    """Run a stream over all that is there now, and return what it made: a table in the shared folder, the last state where the mode is complete."""
    spark = stream.sparkSession
    path, state = new_folder(spark, "drained"), new_folder(spark, "stream")
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", state).trigger(availableNow=True)
    if mode == "append":
        query = writer.format("parquet").option("path", path).start()
    else:
        query = writer.foreachBatch(lambda rows, _: rows.write.mode("overwrite").parquet(path)).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def follow(spark: SparkSession, sf_dir: str, name: str, files: int = 1) -> DataFrame:
    """A table's files as a stream, some at a time."""
    schema = table(spark, sf_dir, name).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).option("pathGlobFilter", f"{name}*.parquet").parquet(sf_dir)


def new_documents(stream: DataFrame, key: str) -> DataFrame:
    """Rows whose content was not seen before."""
    return stream.dropDuplicates([key])


def live_results(results: DataFrame, now, seconds: int = 1800) -> DataFrame:
    """Stored result sets that have not run out."""
    return results.where(F.col("created_at") + F.expr(f"INTERVAL {seconds} SECONDS") > F.lit(now))


QUERIES = {
    "ledger_stream": (
        lambda s, d: drain(summary(follow(s, d, "events")), "complete"),
        "SELECT event_type, count(*) AS requests, round(sum(value), 4) AS total, max(value) AS slowest FROM events GROUP BY event_type",
    ),
    "ledger_windows": (
        lambda s, d: windowed(table(s, d, "events")).select(F.col("w.start").cast("string").alias("start"), "event_type", "requests"),
        "SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS requests FROM events GROUP BY 1, 2",
    ),
    "latency_report": (
        lambda s, d: latency_by(table(s, d, "events").where("value >= 10"), "event_type", "value"),
        "SELECT event_type, count(*) AS samples, round(quantile_cont(value, 0.5), 4) AS p50, round(quantile_cont(value, 0.95), 4) AS p95, round(max(value), 4) AS max_value FROM events WHERE value >= 10 GROUP BY event_type",
    ),
}
