"""Session settings and the shared folder in which lineage is cut."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

PACKAGE_ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def local_session(cpus: int | str = 8, name: str = "quill", partitions: int = 8) -> SparkSession:
    """A session for tests and benches; on a cluster the caller brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; one of our own only where that is unset (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    current = spark.sparkContext.getCheckpointDir()
    if folder:
        if not current:
            spark.sparkContext.setCheckpointDir(folder)
        return folder.rstrip("/")
    if not current:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
        own = tempfile.mkdtemp(prefix="quill-checkpoint-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(own)
        current = own
    return current.rstrip("/")


def _file_system(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    files, where = _file_system(spark, path)
    return bool(files.exists(where))


def delete(spark: SparkSession, path: str) -> None:
    """Removes a folder of any store that Spark can write to."""
    files, where = _file_system(spark, path)
    files.delete(where, True)


_written: list[str] = []


def drop_written(spark: SparkSession | None = None) -> None:
    """Removes the tables written by this process; to be called before the session is stopped where they lie in a remote store.
    At the end of the process what is left is removed, in a mounted folder also without a session."""
    spark = spark or SparkSession.getActiveSession()
    while _written:
        path = _written.pop()
        try:
            delete(spark, path)
        except Exception:  # no session any more
            shutil.rmtree(path.removeprefix("file://"), ignore_errors=True)


atexit.register(drop_written)


def cut(df: DataFrame) -> DataFrame:
    """Run df once and cut its lineage in the shared folder; freed by the context cleaner."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str) -> DataFrame:
    """Like cut, as a compressed columnar table, for wide intermediate rows read more than once."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _written.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of the folder. One that comes in far fewer splits than there are cores (small files of one row group) is
    spread over them; a large table never is."""
    table = spark.read.parquet(f"{folder}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return table.repartition(cores) if 2 * table.rdd.getNumPartitions() <= cores else table
