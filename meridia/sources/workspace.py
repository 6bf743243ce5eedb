"""The folder that driver and executors share, and intermediate tables in it."""

from __future__ import annotations

import hashlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it is unset, a temporary folder if driver and executors are one process, else an error."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="meridia-checkpoint-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(found)
    return found


def _path(spark: SparkSession, folder: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def exists(spark: SparkSession, path: str) -> bool:
    store, at = _path(spark, path)
    return store.exists(at)


def folders(spark: SparkSession, path: str) -> list[str]:
    """The folders in a folder; none if it is not there."""
    store, at = _path(spark, path)
    return [f.getPath().toString() for f in store.listStatus(at) if f.isDirectory()] if store.exists(at) else []


def fingerprint(spark: SparkSession, path: str) -> str:
    """A digest of the names, sizes and times of the files in a folder and the folders in it."""
    store, at = _path(spark, path)
    files = store.listFiles(at, True)
    seen = []
    while files.hasNext():
        f = files.next()
        seen.append(f"{f.getPath().toString()} {f.getLen()} {f.getModificationTime()}")
    return hashlib.sha256("\n".join(sorted(seen)).encode()).hexdigest()[:24]


def remove(spark: SparkSession, path: str) -> None:
    store, at = _path(spark, path)
    store.delete(at, True)


def workspace(spark: SparkSession) -> str:
    """This application's own folder; it is removed when the driver ends."""
    folder = f"{shared_dir(spark).rstrip('/')}/meridia-{spark.sparkContext.applicationId}"
    store, path = _path(spark, folder)
    if not store.exists(path):
        store.mkdirs(path)
        store.deleteOnExit(path)
    return folder


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{workspace(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, even: bool = True) -> DataFrame:
    """Cut the lineage: write df to the shared folder as Parquet and read it again.

    What is read no longer depends on shuffle files or on the executors that made it. even deals the rows out
    anew, so that a small table becomes a few files however many tasks made it; it is left out for large ones,
    whose tasks write as they are.
    """
    spark = df.sparkSession
    path = new_folder(spark, name)
    (df.hint("rebalance") if even else df).write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(table: DataFrame) -> None:
    """Removes a written table that nothing will read again."""
    spark = table.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
        if f"/meridia-{spark.sparkContext.applicationId}/" in folder:
            remove(spark, folder)
