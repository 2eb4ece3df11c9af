"""Feeds as streams: new keys inserted once, windows by day, sessions by gap.

Insert-if-absent has no watermark, as a late row is welcome for ever; its state therefore
lives in the table itself, against which each batch is checked, and not in the query.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from kelda.operators.sets import insert_absent
from kelda.sources.storage import Storage


def file_stream(spark: SparkSession, path: str, schema: StructType, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


#: Buckets of keys in which a table of first rows is kept.
BUCKETS = 16


def insert_first(stream: DataFrame, target: str, keys: list[str], order: list[str], checkpoint: str) -> StreamingQuery:
    """Appends to the Parquet table at ``target`` the first row of each key that it lacks, batch by batch.

    The table is kept in buckets of keys, and a batch reads no more than the keys of the
    buckets that it touches. A batch that is repeated after a failure overwrites its own
    folders, so a row is never stored twice.
    """
    bucket = F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int")

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        placed = batch.withColumn("bucket", bucket)
        touched = [r.bucket for r in placed.select("bucket").distinct().collect()]
        have = stored(spark, target, batch.schema, whole=True).where(F.col("bucket").isin(touched) & (F.col("batch") < number))
        fresh = insert_absent(have.select(*placed.columns), placed, keys, order)
        fresh.withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "batch").parquet(target)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stored(spark: SparkSession, target: str, schema: StructType, whole: bool = False) -> DataFrame:
    """What ``insert_first`` has stored so far, with the batch of each row and, if ``whole``, its bucket."""
    shape = StructType([*schema.fields]).add("bucket", "integer").add("batch", "long")
    rows = spark.read.schema(shape).parquet(target) if Storage(spark).exists(target) else spark.createDataFrame([], shape)
    return rows if whole else rows.drop("bucket")


def daily_counts(stream: DataFrame, at: str, group: str, late: str = "2 days") -> DataFrame:
    """Counts and sums by day and group; rows later than ``late`` behind the newest are dropped by the watermark."""
    day = F.window(F.col(at), "1 day").alias("w")
    return stream.withWatermark(at, late).groupBy(day, group).agg(F.count("*").alias("n_rows"), F.round(F.sum("value"), 2).alias("total")).select(F.col("w.start").alias("day"), group, "n_rows", "total")


def sessions(stream: DataFrame, at: str, key: str, gap: str, late: str = "2 days") -> DataFrame:
    """Runs of a key's rows that follow each other within ``gap``."""
    return stream.withWatermark(at, late).groupBy(F.session_window(F.col(at), gap).alias("w"), key).agg(F.count("*").alias("n_rows")).select(key, F.col("w.start").alias("first"), F.col("w.end").alias("until"), "n_rows")


def seen_between(stored_names: DataFrame | None, batch: DataFrame, name: str, day: str) -> DataFrame:
    """name, first_seen, last_seen after a batch: the first day stays, the last one advances, nothing is dropped."""
    new = batch.groupBy(name).agg(F.min(day).alias("first_seen"), F.max(day).alias("last_seen"))
    if stored_names is None:
        return new
    return stored_names.select(name, "first_seen", "last_seen").unionByName(new).groupBy(name).agg(F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"))
