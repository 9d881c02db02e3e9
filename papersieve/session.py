"""Session helpers shared by every operator: table reads, partition spreading and lineage cuts."""

from __future__ import annotations

import atexit
import gc
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def ship(spark: SparkSession) -> None:
    """Make this package importable in the Python workers of every executor; once per context."""
    sc = spark.sparkContext
    if getattr(sc, "_papersieve_shipped", False):
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="papersieve-")) / "papersieve.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, str(p.relative_to(root.parent)))
    sc.addPyFile(str(target))
    sc._papersieve_shipped = True


def read_table(spark: SparkSession, data_dir: str, name: str) -> DataFrame:
    """One Parquet table of a data folder; a file or a folder of part files."""
    ship(spark)
    return spark.read.parquet(f"{data_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    """Partition count for Python-heavy stages: several waves over all cores, and never below the shuffle setting."""
    return max(spark.sparkContext.defaultParallelism * 3, int(spark.conf.get("spark.sql.shuffle.partitions")))


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash-spread rows over all cores before a CPU-bound Python stage.

    The keys must be (nearly) unique, so no partition can grow hot. A fixed count keeps adaptive execution from
    folding the partitions again, which goes by bytes and not by the CPU time a byte costs.
    """
    return df.repartition(partitions(df.sparkSession), *keys)


def ensure_parallel(df: DataFrame, *keys: str) -> DataFrame:
    """Spread rows only where the input has fewer partitions than the cluster has cores, as a single file of one row group
    has; inputs of many splits are left as they are read, without a shuffle."""
    spark = df.sparkSession
    if df._jdf.queryExecution().toRdd().getNumPartitions() >= spark.sparkContext.defaultParallelism:
        return df
    return spread(df, *keys)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of the session. Where none is configured, a temporary one is set if all tasks run in
    this process; on a cluster that is an error, as every machine would write to its own disk."""
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not configured and not sc._jsc.sc().isLocal():
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    target = configured or os.path.join(tempfile.gettempdir(), f"papersieve-{os.getpid()}")
    sc.setCheckpointDir(target)
    return target


def cut(df: DataFrame, reclaim: bool = False) -> DataFrame:
    """Materialise once as a table in the shared checkpoint folder and read it back.

    The lineage ends there, so a lost executor costs a re-read and not a re-run; as compressed columns the table takes a
    fraction of an RDD checkpoint. The folder of a process is removed when the process ends.
    With reclaim, the driver then collects its garbage, so Spark deletes the shuffle files of finished stages at once
    instead of some time.
    """
    spark = df.sparkSession
    base = ensure_checkpoint_dir(spark).rstrip("/")
    sc = spark.sparkContext
    home = f"{base}/papersieve-{sc.applicationId}"
    if not getattr(sc, "_papersieve_cleanup", False):
        sc._papersieve_cleanup = True
        atexit.register(_remove, sc, home)
    path = f"{home}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    schema = df.schema
    if reclaim:
        del df
        gc.collect()
        sc._jvm.System.gc()
    return spark.read.schema(schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete a table that cut wrote, as soon as nothing that is still to run reads it."""
    sc = df.sparkSession.sparkContext
    for file in df.inputFiles()[:1]:
        folder = sc._jvm.org.apache.hadoop.fs.Path(sc._jvm.java.net.URI(file)).getParent()
        if folder.getParent().getName() == f"papersieve-{sc.applicationId}":
            folder.getFileSystem(sc._jsc.hadoopConfiguration()).delete(folder, True)


def _remove(sc, home: str) -> None:
    try:
        jvm = sc._jvm
        target = jvm.org.apache.hadoop.fs.Path(home)
        target.getFileSystem(sc._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session is gone; the folder belongs to the cluster's own cleaning
        pass
