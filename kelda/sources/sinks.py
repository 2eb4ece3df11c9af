"""Writing tables so that a failed build leaves the last good one in place."""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from kelda.operators.sets import insert_absent
from kelda.sources.storage import Storage

POINTER = "CURRENT"


def publish(df: DataFrame, root: str, meta: dict[str, object], keep: int = 2, partition_by: list[str] | None = None, key: str | None = None) -> str:
    """Writes a new build below ``root``, checks its rows, and moves the pointer to it; gives the build's name.

    The pointer is replaced in one step after everything else, so readers see the old build
    or the new one. ``key``: a column that must not be blank; rows where it is are left out
    and counted in the meta row. The last ``keep`` builds stay.
    """
    build = f"build-{int(time.time() * 1000):x}-{uuid.uuid4().hex[:8]}"
    spark, path = df.sparkSession, f"{root}/{build}"
    store = Storage(spark)
    kept = df if key is None else df.where(F.coalesce(~F.lower(F.trim(F.col(key).cast("string"))).isin("", "nan"), F.lit(False)))
    writer = kept.write.mode("error")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(f"{path}/data")
    written = spark.read.parquet(f"{path}/data").count()
    row = {**meta, "build": build, "row_count": written, "built_at": int(time.time())}
    spark.createDataFrame([(json.dumps(row, sort_keys=True),)], "meta string").coalesce(1).write.text(f"{path}/meta")
    store.replace(f"{root}/{POINTER}", build)
    builds = [b for b in store.names(root) if b.startswith("build-") and b != build]
    for old in builds[: max(0, len(builds) - (keep - 1))]:
        store.remove(f"{root}/{old}")
    return build


def current(spark: SparkSession, root: str) -> DataFrame:
    """The published build; FileNotFoundError where nothing was published, which differs from an empty table."""
    return spark.read.parquet(f"{root}/{Storage(spark).read(f'{root}/{POINTER}').strip()}/data")


def current_meta(root: str, spark: SparkSession | None = None) -> dict[str, object]:
    """The meta row of the published build."""
    store = Storage(spark or SparkSession.active())
    folder = f"{root}/{store.read(f'{root}/{POINTER}').strip()}/meta"
    name = next(n for n in store.names(folder) if n.startswith("part-"))
    return json.loads(store.read(f"{folder}/{name}").splitlines()[0])


def append_once(df: DataFrame, path: str, keys: list[str], order: list[str], fmt: str = "json") -> int:
    """Appends the rows whose key the log lacks, the first of each, and gives their number."""
    spark = df.sparkSession
    reader = spark.read.schema(df.schema).format(fmt)
    have = reader.load(path) if Storage(spark).exists(path) else spark.createDataFrame([], df.schema)
    fresh = insert_absent(have, df, keys, order).cache()
    n = fresh.count()
    if n:
        fresh.write.mode("append").format(fmt).save(path)
    fresh.unpersist()
    return n


def snapshot(df: DataFrame, path: str, day: str) -> None:
    """The day's snapshot of a feed, other days' left alone."""
    df.withColumn("snapshot_date", F.lit(day)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("snapshot_date").parquet(path)


def output_path(default: str, explicit: str | None, sampled: str | None) -> str:
    """Where a result goes: a sampled one never in place of the whole one unless told so."""
    if explicit:
        return explicit
    return f"{default}.sample" if sampled else default


def compare_provenance(source: dict[str, object], built: dict[str, object]) -> dict[str, object]:
    """Whether a build is of the source as it is: state and the basis it was told by; digests before times."""
    a, b = source.get("sha256"), built.get("sha256")
    if a and b:
        return {"state": "same" if a == b else "differs", "basis": "sha256"}
    a, b = source.get("modified"), built.get("modified")
    if a is not None and b is not None:
        return {"state": "same" if a == b else "newer" if a > b else "older", "basis": "modified"}
    return {"state": "unknown", "basis": "none"}


def spend(calls: DataFrame) -> DataFrame:
    """Calls and tokens by purpose; sums of nothing are 0."""
    return calls.groupBy("purpose").agg(F.count("*").alias("calls"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tokens_in", "tokens_out")])


def write_outputs(results: dict[str, DataFrame], root: str, meta: dict[str, object]) -> dict[str, object]:
    """Writes the small results of an evaluation below ``root``, one CSV each, and last a manifest with their rows.

    A reader that finds the manifest finds all of them. Names must be plain words.
    """
    bad = [n for n in results if not n.replace("_", "").isalnum()]
    if bad:
        raise ValueError(f"no names for files: {bad}")
    rows = {}
    for name, df in results.items():
        df.coalesce(1).write.mode("overwrite").option("header", True).csv(f"{root}/{name}")
        rows[name] = df.sparkSession.read.option("header", True).csv(f"{root}/{name}").count()
    manifest = {**meta, "rows": rows}
    write_manifest(f"{root}/manifest.json", manifest)
    return manifest


def write_manifest(path: str, manifest: dict[str, object]) -> None:
    """A manifest in one step, in a fixed order of keys."""
    Storage(SparkSession.active()).replace(path, json.dumps(manifest, sort_keys=True, ensure_ascii=False, indent=1))


def read_manifest(path: str) -> dict[str, object]:
    """A manifest, {} where there is none; one that is damaged raises."""
    try:
        return json.loads(Storage(SparkSession.active()).read(path))
    except FileNotFoundError:
        return {}


def case_bundles(cases: DataFrame, case: str, evidence: dict[str, tuple[DataFrame, list[str]]], most: int = 50) -> DataFrame:
    """case, bundle (JSON), digest: every case with the first ``most`` rows of each kind of evidence, and how many it has.

    evidence: kind to (rows with the case's key, the columns by which they are ordered).
    Rows are ranked before they are packed, so no case's list is longer than ``most``.
    """
    out = cases.select(case).distinct()
    for kind, (rows, order) in evidence.items():
        w = Window.partitionBy(case).orderBy(*order)
        few = rows.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= most)
        packed = few.groupBy(case).agg(F.array_sort(F.collect_list(F.struct("__n", *[c for c in rows.columns if c != case]))).alias("__l"))
        packed = packed.select(case, F.transform("__l", lambda x: x.dropFields("__n")).alias("__l"))
        counts = rows.groupBy(case).agg(F.count("*").alias("__c"))
        both = packed.join(counts, case).select(case, F.struct(F.col("__l").alias("rows"), (F.col("__c") - F.size("__l")).alias("others")).alias(kind))
        out = out.join(both, case, "left")
    bundle = F.to_json(F.struct(case, *evidence))
    return out.select(case, bundle.alias("bundle"), F.sha2(bundle, 256).alias("digest"))
