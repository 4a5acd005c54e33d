"""Session helpers: defaults for local runs, and a lineage cut that survives lost executors."""

from __future__ import annotations

import os
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A local session as tests and the bench use it. A cluster brings its own."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("wiretally")
    defaults = {
        "spark.sql.shuffle.partitions": str(shuffle_partitions),
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.driver.memory": "8g",
        "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    }
    for k, v in (defaults | conf).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: that of spark.checkpoint.dir. Only a local session may go without the setting and
    then gets a temporary folder; on a cluster a folder of one machine would lose rows, so this raises."""
    context = spark.sparkContext._jsc.sc()
    if context.getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", "")
        if not folder and not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(folder or tempfile.mkdtemp(prefix="wiretally-"))
    return context.getCheckpointDir().get()


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared file system, with what is in it."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and go on from there."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def ship(spark: SparkSession) -> None:
    """Send this package to Python workers that couldn't import it: those of a session started elsewhere without it on
    their path. Done once for an application."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    seen = [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)]
    sc = spark.sparkContext
    if root in map(os.path.abspath, filter(None, seen)) or sc.applicationId in _shipped:
        return
    _shipped.add(sc.applicationId)
    folder = tempfile.mkdtemp(prefix="wiretally-")
    sc.addPyFile(shutil.make_archive(f"{folder}/wiretally", "zip", root, "wiretally"))


_shipped: set[str] = set()
