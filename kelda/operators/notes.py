"""Tracked items as an append-only log of events; the state of an item is its latest event's."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def current_state(events: DataFrame, key: str, at: str, event: str) -> DataFrame:
    """key, event, at, n_events of the latest event of each item; a combinable maximum, ties to the greater event."""
    last = events.groupBy(key).agg(F.max(F.struct(at, event)).alias("__l"), F.count("*").alias("n_events"))
    return last.select(key, F.col(f"__l.{event}").alias(event), F.col(f"__l.{at}").alias(at), "n_events")


def allowed(events: DataFrame, asked: DataFrame, key: str, at: str, event: str, moves: dict[str, list[str]]) -> DataFrame:
    """asked with ``state`` and ``refusal`` (NULL: append it). moves: states from which each event may follow; '' is none yet."""
    now = current_state(events, key, at, event).select(key, F.col(event).alias("state"))
    out = asked.join(now, key, "left").withColumn("state", F.coalesce("state", F.lit("")))
    ok: Column = F.lit(False)
    for e, states in moves.items():
        ok = ok | ((F.col(event) == e) & F.col("state").isin(states))
    return out.withColumn("refusal", F.when(~ok, F.concat(F.lit("not from "), F.when(F.col("state") == "", "nothing").otherwise(F.col("state")))))


def first_and_last(events: DataFrame, keys: list[str], at: str, value: str) -> DataFrame:
    """First and last value per key, as a review keeps the first answer and shows the last."""
    return events.groupBy(*keys).agg(F.min_by(value, F.struct(at, value)).alias("first"), F.max_by(value, F.struct(at, value)).alias("last"), F.count("*").alias("n"))
