"""Session-level helpers: where lineage is cut, and how sizes are checked."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder for checkpoints: the cluster's own, else a local one.

    A cluster names a folder that all executors share in
    ``spark.checkpoint.dir``.  Only a local session that names none gets a
    temporary folder; anywhere else a missing setting is an error, because a
    machine-local folder would lose data with its machine.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if named:
        if sc._jsc.sc().getCheckpointDir().isEmpty():
            sc.setCheckpointDir(named)
        return named
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="rowgraph-checkpoint-")
    sc.setCheckpointDir(own)
    return own


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_FUSED = "spark.sql.codegen.wholeStage"


def cut(df: DataFrame, fused: bool = True) -> DataFrame:
    """``df`` computed once and written to the shared checkpoint folder.

    The shuffle files behind it are not needed any more and go at once, so a
    long chain of steps holds the disk of one step, not of all.  A long
    condition fused into one Java method is too large for the JVM to compile
    and runs interpreted; with ``fused=False`` Spark keeps to small methods.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    wanted = {_CLEANUP: "true"} if fused else {_CLEANUP: "true", _FUSED: "false"}
    before = {k: spark.conf.get(k, None) for k in wanted}
    try:
        for k, v in wanted.items():
            spark.conf.set(k, v)
        # the settings count for plans made while they are on
        return df.select("*").checkpoint(eager=True)
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def filed(df: DataFrame) -> DataFrame:
    """``df`` computed once and written as Parquet under the shared checkpoint folder.

    For many rows of few columns: they take a fraction of what a checkpoint
    does.  The files stay until the application ends.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/filed-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, None)
    try:
        spark.conf.set(_CLEANUP, "true")
        df.select("*").write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)


def ship_package(spark: SparkSession) -> None:
    """Let Python workers import this package wherever the driver found it.

    The package is zipped once a session and handed to Spark, which serves it
    to every executor, also to one that joins later.
    """
    sc = spark.sparkContext
    if getattr(sc, "_rowgraph_shipped", False):
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="rowgraph-package-")) / "rowgraph_package.zip"
    with zipfile.ZipFile(target, "w") as z:
        for file in sorted(root.rglob("*.py")):
            z.write(file, file.relative_to(root.parent))
    sc.addPyFile(str(target))
    sc._rowgraph_shipped = True
