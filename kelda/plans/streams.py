"""Streams over the events, run to their end on the files there are."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from kelda.plans.registry import Catalog
from kelda.session import ensure_checkpoint_dir
from kelda.sources.storage import Storage
from kelda.sources.tables import table
from kelda.streaming.feeds import daily_counts, insert_first, sessions, stored

catalog = Catalog()


def _place(spark: SparkSession) -> str:
    """A folder of its own below the shared one."""
    return f"{ensure_checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"


def _events(spark: SparkSession, d: str) -> DataFrame:
    """The events as a stream. A file source takes a folder or a pattern, so a single file is given as one."""
    return spark.readStream.schema(table(spark, d, "events").schema).parquet(f"{d}/events.parquet*")


@catalog.query("streaming_first_seen", "SELECT user_id, min(ts) AS first_seen, arg_min(event_type, (ts, event_id)) AS event_type FROM events GROUP BY user_id")
def streaming_first_seen(spark: SparkSession, d: str) -> DataFrame:
    """The first event of each user, stored once by a stream that inserts what its table lacks."""
    place = _place(spark)
    stream = _events(spark, d).select("user_id", "ts", "event_id", "event_type")
    insert_first(stream, f"{place}/table", ["user_id"], ["ts", "event_id"], f"{place}/progress").awaitTermination()
    return stored(spark, f"{place}/table", stream.schema).select("user_id", F.col("ts").alias("first_seen"), "event_type")


def _run(spark: SparkSession, d: str, windows: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What the windows over the events come to, each appended to a table when the watermark closes it.

    In append mode a window is written once, when no row can still fall into it, and its
    state is dropped. The stream is run to the end of its files; then a row without values,
    long after the last one, closes the windows that are still open, as time would.
    """
    place, store = _place(spark), Storage(spark)
    events = table(spark, d, "events")
    ends = events.select(*[F.lit(None).cast(t).alias(c) if c != "ts" else (F.max("ts") + F.expr("INTERVAL 60 DAYS")).alias("ts") for c, t in events.dtypes])
    events.limit(0).write.parquet(f"{place}/end")

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{place}/table/batch={number}")

    for last in (False, True):
        if last:
            ends.write.mode("append").parquet(f"{place}/end")
        # Event time in a type that watermarks accept.
        stream = _events(spark, d).unionByName(spark.readStream.schema(events.schema).parquet(f"{place}/end")).withColumn("ts", F.col("ts").cast("timestamp"))
        q = windows(stream).writeStream.outputMode("append").foreachBatch(write).option("checkpointLocation", f"{place}/progress").trigger(availableNow=True).start()
        q.awaitTermination()
    store.remove(f"{place}/progress")
    store.remove(f"{place}/end")
    return spark.read.parquet(f"{place}/table").drop("batch")


@catalog.query("streaming_daily_counts", "SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS day, event_type, count(*) AS n_rows, round(sum(value), 2) AS total FROM events GROUP BY 1, 2")
def streaming_daily_counts(spark: SparkSession, d: str) -> DataFrame:
    return _run(spark, d, lambda s: daily_counts(s, "ts", "event_type")).withColumn("day", F.col("day").cast("timestamp_ntz"))


@catalog.query(
    "streaming_sessions",
    """WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events),
    s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e)
    SELECT user_id, min(ts) AS "first", max(ts) + INTERVAL 6 HOUR AS until, count(*) AS n_rows FROM s GROUP BY user_id, k""",
)
def streaming_sessions(spark: SparkSession, d: str) -> DataFrame:
    out = _run(spark, d, lambda s: sessions(s, "ts", "user_id", "6 hours"))
    return out.select("user_id", *[F.col(c).cast("timestamp_ntz").alias(c) for c in ("first", "until")], "n_rows")
