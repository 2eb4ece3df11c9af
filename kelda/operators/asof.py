"""As-of join: what was known of an entity on the day of an event.

Both sides are reduced first: versions to one per entity and day on which they became
known (ties resolved there, in a combinable aggregation), events to the distinct days at
which an entity is asked for. Each bucket of entities then runs DuckDB's ASOF LEFT JOIN,
and the answers are joined back to the events. An entity with a third of all rows brings
no more than one row per calendar day to its bucket.
"""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from kelda.session import shuffle_partitions

#: Buckets a shuffle partition holds at least; a task has one bucket at a time in memory.
BUCKETS_PER_PARTITION = 4
#: Bytes of both sides, as the optimizer estimates them, that a bucket is made for, and what DuckDB may take for one.
BUCKET_BYTES, MEMORY = 32 << 20, "1GB"


def bucket_count(*sides: DataFrame) -> int:
    """Buckets for the data that is read: their size follows from it, and not from how many partitions a shuffle has.

    What the optimizer can't tell the size of counts for nothing."""
    size = 0
    for d in sides:
        leaves = d._jdf.queryExecution().optimizedPlan().collectLeaves()
        sizes = [int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size())]
        size += sum(x for x in sizes if x < 1 << 60)
    return max(BUCKETS_PER_PARTITION * shuffle_partitions(sides[0].sparkSession), -(-size // BUCKET_BYTES))


def _asof_bucket(asked: pa.Table, known: pa.Table) -> pa.Table:
    import duckdb

    con = duckdb.connect(config={"threads": 1, "memory_limit": MEMORY})
    try:
        con.register("asked", asked)
        con.register("known", known)
        table = con.sql(
            "SELECT a.entity, a.day, k.known_on, k.version FROM asked a ASOF LEFT JOIN known k"
            " ON a.entity = k.entity AND a.day >= k.known_on"
        ).to_arrow_table()
    finally:
        con.close()
    return table.cast(pa.schema([("entity", pa.string()), ("day", pa.int32()), ("known_on", pa.int32()), ("version", pa.string())]))


def asof_join(
    events: DataFrame,
    versions: DataFrame,
    keys: list[str],
    at: str,
    known_on: str,
    payload: list[str],
    ties: list[Column],
    buckets: int | None = None,
) -> DataFrame:
    """events with ``payload`` and ``known_on`` of the version known latest on or before their day ``at``.

    ``at`` and ``known_on`` are DATE columns. Of an entity's versions known on one day the
    one greatest by ``ties`` counts (NULL lowest), then by the payload itself. Events come
    out once each; those without an answer have NULLs.

    Defined cases: events with a NULL key or day, and versions with one, match nothing;
    repeated versions change nothing and repeated events are kept; an empty side gives
    NULLs or no rows; columns of versions that are neither key nor payload are ignored, so
    that their names cannot clash; a column of events named as one of the payload or
    ``known_on`` is replaced.
    """
    n = buckets or bucket_count(events, versions)
    entity = F.to_json(F.array(*[F.col(f"`{k}`").cast("string") for k in keys]))

    def whole(df: DataFrame, *cols: str) -> DataFrame:
        for c in cols:
            df = df.where(F.col(f"`{c}`").isNotNull())
        return df

    days = F.unix_date
    row = F.struct(*[F.col(f"`{p}`") for p in payload])
    best = (
        whole(versions, *keys, known_on)
        .select(entity.alias("entity"), days(F.col(f"`{known_on}`")).alias("known_on"), F.struct(*ties).alias("__t"), row.alias("__row"))
        .groupBy("entity", "known_on")
        .agg(F.max_by("__row", F.struct("__t", "__row")).alias("__row"))
        .select("entity", "known_on", F.to_json("__row").alias("version"))
    )
    asked = whole(events, *keys, at).select(entity.alias("entity"), days(F.col(f"`{at}`")).alias("day")).distinct()
    bucket = F.pmod(F.xxhash64("entity"), F.lit(n)).cast("int")

    def join(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        return _asof_bucket(left.drop_columns(["bucket"]), right.drop_columns(["bucket"]))

    answers = (
        asked.withColumn("bucket", bucket)
        .groupBy("bucket")
        .cogroup(best.withColumn("bucket", bucket).groupBy("bucket"))
        .applyInArrow(join, "entity string, day int, known_on int, version string")
        .where(F.col("version").isNotNull())
    )
    types = dict(versions.select(*[f"`{p}`" for p in payload]).dtypes)
    shape = ", ".join(f"`{p}` {types[p]}" for p in payload)
    answers = answers.select(
        F.col("entity").alias("__entity"),
        F.col("day").alias("__day"),
        F.date_from_unix_date("known_on").alias("__known"),
        F.from_json("version", shape).alias("__v"),
    )
    full = reduce(lambda a, b: a & b, [F.col(f"`{k}`").isNotNull() for k in keys])
    keyed = events.select(F.struct(*[f"`{c}`" for c in events.columns]).alias("__e"), F.when(full, entity).alias("__entity"), days(F.col(f"`{at}`")).alias("__day"))
    out = keyed.join(answers, ["__entity", "__day"], "left")
    kept = [F.col(f"__e.`{c}`").alias(c) for c in events.columns if c not in {*payload, known_on}]
    return out.select(*kept, F.col("__known").alias(known_on), *[F.col(f"__v.`{p}`").alias(p) for p in payload])
