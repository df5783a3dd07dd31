"""Session helpers: table paths, the shared folder for cut lineage, staged tables."""

from __future__ import annotations

import gc
import os
import tempfile
import threading
import time
import uuid

from pyspark.sql import DataFrame, SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one driver table; the path may be any URI that Spark can open."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package from a source checkout, and hand them rows in batches bounded in rows and in bytes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 1000)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20)
    env = spark.sparkContext.environment
    paths = env.get("PYTHONPATH", "").split(os.pathsep)
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, paths)])


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a local one where it is unset (tests)."""
    given = spark.conf.get("spark.checkpoint.dir", None)
    if given:
        return given.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
    made = "file://" + tempfile.mkdtemp(prefix="cairn-")
    spark.conf.set("spark.checkpoint.dir", made)
    spark.sparkContext.setCheckpointDir(made)
    return made


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


class _Made(threading.local):
    """Paths of staged tables that still exist, in order. Each thread has its own, so that two queries at once in one session do not delete each other's tables."""

    def __init__(self) -> None:
        self.paths: list[str] = []


_made = _Made()


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    _made.paths.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cairn_path = path
    return out


class Staging:
    """The tables that one call stages: each call has its own, so calls in one session never delete each other's tables."""

    def __init__(self) -> None:
        self.made: list[DataFrame] = []

    def put(self, df: DataFrame, name: str) -> DataFrame:
        """Write df as Parquet in the shared folder and read it back."""
        path = scratch_path(df.sparkSession, name)
        df.write.parquet(path)
        out = df.sparkSession.read.schema(df.schema).parquet(path)
        out._cairn_path = path
        self.made.append(out)
        return out

    def drop(self, *keep: DataFrame) -> None:
        """Delete the tables made so far, but for those that a result still reads."""
        for df in [x for x in self.made if not any(x is y for y in keep)]:
            drop_path(df.sparkSession, df._cairn_path)
            self.made = [x for x in self.made if x is not df]


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a path of the shared folder through Hadoop's file system API."""
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop_path, True)


def unstage(*dfs: DataFrame) -> None:
    """Delete staged tables that nothing reads any more."""
    for df in dfs:
        drop_path(df.sparkSession, df._cairn_path)
        _made.paths.remove(df._cairn_path)


def made_so_far() -> int:
    """A mark for tidy()."""
    return len(_made.paths)


def tidy(spark: SparkSession, since: int, *keep: DataFrame) -> None:
    """Delete the tables staged since the mark, but for those that the result still reads."""
    kept = {df._cairn_path for df in keep}
    for path in [p for p in _made.paths[since:] if p not in kept]:
        drop_path(spark, path)
        _made.paths.remove(path)


def free_shuffles(spark: SparkSession) -> None:
    """Collect garbage in both drivers, so that Spark deletes shuffle files that no plan refers to any more."""
    gc.collect()
    time.sleep(0.1)
    spark._jvm.System.gc()
    time.sleep(0.5)


def scan_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of a scan in bytes (the size on disk of the files read); 0 where it knows none."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return 0 if size >= 2**60 else size
