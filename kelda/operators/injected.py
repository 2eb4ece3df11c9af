"""Callables given from outside: encoders, models, extractors. They may fail without failing the job."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F


def with_injected(rows: DataFrame, column: str, call: Callable[[pd.Series], pd.Series], name: str, kind: str) -> DataFrame:
    """rows with ``name``, what the callable answers for a batch of the column, and ``name_reason`` where it did not.

    An exception costs its batch the answers, not the task: the rows stay, with the reason.
    """
    fields = f"value {kind}, reason string"

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            try:
                out = pd.Series(list(call(s)), index=s.index, dtype=object)
                if len(out) != len(s):
                    raise ValueError(f"{len(out)} answers to {len(s)} rows")
                yield pd.DataFrame({"value": out, "reason": [None] * len(s)})
            except Exception as e:  # noqa: BLE001
                yield pd.DataFrame({"value": [None] * len(s), "reason": [f"{type(e).__name__}: {e}"[:200]] * len(s)})

    answered = rows.withColumn("__a", F.pandas_udf(run, fields)(F.col(column)))
    return answered.withColumn(name, F.col("__a.value")).withColumn(f"{name}_reason", F.col("__a.reason")).drop("__a")


def with_cache(items: DataFrame, cache: DataFrame, keys: list[str], value: str) -> tuple[DataFrame, DataFrame]:
    """(items with a stored answer, items without). The cache is append-only: the first answer of a key stands."""
    stored = cache.groupBy(*keys).agg(F.min(value).alias(value))
    return items.join(stored, keys, "inner"), items.join(stored.select(*keys), keys, "left_anti")


def hashed_encoder(dimensions: int = 64) -> Callable[[pd.Series], pd.Series]:
    """An encoder without a model: hashed letter trigrams as a unit vector."""

    def encode(texts: pd.Series) -> pd.Series:
        import numpy as np
        import xxhash

        out = []
        for t in texts:
            v = np.zeros(dimensions)
            s = f" {(t or '').lower()} "
            for i in range(len(s) - 2):
                h = xxhash.xxh3_64_intdigest(s[i : i + 3])
                v[h % dimensions] += 1 if h >> 63 else -1
            n = np.linalg.norm(v)
            out.append((v / n if n else v).tolist())
        return pd.Series(out)

    return encode
