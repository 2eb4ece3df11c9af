"""Session defaults and lineage cutting."""

from __future__ import annotations

import atexit
import hashlib
import io
import os
import py_compile
import shutil
import tempfile
import zipfile

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str = "local[*]", app: str = "kelda", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A session with the settings the operators assume: UTC, AQE with skew handling, Arrow."""
    b = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only a local-mode session without that setting gets a folder of its own; on a
    cluster a missing setting is an error, since a machine-local folder would be lost
    with its machine.
    """
    sc = spark.sparkContext
    shared = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if shared:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(shared)
        return shared
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        own = tempfile.mkdtemp(prefix="kelda-ckpt-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        sc.setCheckpointDir(own)
    return sc.getCheckpointDir()


def cut_lineage(df: DataFrame, eager: bool = True) -> DataFrame:
    """Write df to the shared checkpoint folder and read it from there."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ship_package(spark: SparkSession) -> None:
    """Gives the executors this package, once a session, so that they needn't have it installed.

    The archive goes to the shared folder; it holds compiled modules too, so that workers
    don't compile them over and over.
    """
    sc = spark.sparkContext
    if getattr(sc, "_kelda_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as z, tempfile.TemporaryDirectory() as scratch:
        for folder, _, files in sorted(os.walk(root)):
            for name in sorted(f for f in files if f.endswith(".py")):
                source = os.path.join(folder, name)
                inside = os.path.join("kelda", os.path.relpath(source, root))
                z.write(source, inside)
                compiled = py_compile.compile(source, os.path.join(scratch, "c.pyc"), dfile=inside, invalidation_mode=py_compile.PycInvalidationMode.UNCHECKED_HASH)
                z.write(compiled, inside + "c")
    data = packed.getvalue()
    place = f"{ensure_checkpoint_dir(spark)}/kelda-{hashlib.sha256(data).hexdigest()[:12]}.zip"
    path = sc._jvm.org.apache.hadoop.fs.Path(place)
    fs = path.getFileSystem(sc._jsc.hadoopConfiguration())
    if not fs.exists(path):
        out = fs.create(path, True)
        out.write(bytearray(data))
        out.close()
    sc.addPyFile(place)
    sc._kelda_shipped = True
