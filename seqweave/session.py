"""Session helpers: a local session for tests and the shared work folder."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = 8, partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and benchmarks; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("seqweave")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``.

    Only a local master may do without the setting; it gets a folder of its own.
    """
    set_dir = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if set_dir:
        return set_dir.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = tempfile.mkdtemp(prefix="seqweave-")
    return _OWN[app]


def work_dir(spark: SparkSession) -> str:
    """This application's own part of the shared folder."""
    return f"{shared_dir(spark)}/seqweave/{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path for work files, which ``clear_work`` removes."""
    return f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"


def lasting_path(spark: SparkSession, name: str) -> str:
    """A fresh path for a table that is to outlive the application; no one clears it."""
    return f"{shared_dir(spark)}/seqweave/kept/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back: cuts the
    lineage and survives the loss of executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _file_system(spark: SparkSession, path: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop


def delete_path(spark: SparkSession, path: str) -> None:
    """Remove a path of the shared folder."""
    fs, hadoop = _file_system(spark, path)
    fs.delete(hadoop, True)


@contextmanager
def open_output(spark: SparkSession, path: str):
    """A file of any file system Spark knows, opened for writing (``write(bytes)``); folders
    on the way are made, an older file of that name is replaced."""
    fs, hadoop = _file_system(spark, path)
    out = fs.create(hadoop, True)
    try:
        yield out
    finally:
        out.close()


def clear_work(spark: SparkSession) -> None:
    """Remove the work files this application's operators wrote to the shared folder; those
    of other applications and tables meant to last stay. Results that have not
    been read or written elsewhere yet are lost with them."""
    delete_path(spark, work_dir(spark))
