"""Session helpers: tables by name, and lineage cuts that survive lost executors."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: str = "*", name: str = "quirework") -> SparkSession:
    """A local session for tests and the bench; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, rows: int = 2000) -> DataFrame:
    """The same rows in tasks of about `rows` each, for work that is large beside the bytes a row is read from.

    Spark sizes tasks by bytes: a short table from which whole documents are made or parsed would be the work of one task.
    """
    n = -(-df.count() // rows)
    return df.repartition(n) if n > 1 else df


_tables: list = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Where it is unset a temporary one, but on one machine only: on a cluster every executor would write to a disk of its own."""
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", "")
    if not shared:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError(f"spark.checkpoint.dir must name a folder that all executors share (master: {master})")
        shared = tempfile.mkdtemp(prefix="quirework-")
        spark.conf.set("spark.checkpoint.dir", shared)
        atexit.register(shutil.rmtree, shared, True)
    return shared


def cut_lineage(df: DataFrame) -> DataFrame:
    """The rows as a table written to the shared folder, and read back.

    The folder is shared by all executors, so a lost executor loses no result. Columns are compressed and read as
    needed, which takes a fraction of a checkpoint's disk. `drop_cuts` removes the tables; the session's end does too.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/quirework-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    if not _tables:
        atexit.register(_drop_at_exit, spark)
    _tables.append(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_cuts(spark: SparkSession) -> None:
    """Removes the tables that cut_lineage wrote; results that read them must be stored before. A table that can't be removed stays listed, and the failure is raised."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    while _tables:
        path = jvm.org.apache.hadoop.fs.Path(_tables[-1])
        path.getFileSystem(conf).delete(path, True)
        _tables.pop()


def _drop_at_exit(spark: SparkSession) -> None:
    """A session that has ended before leaves the tables to the folder's owner."""
    try:
        if spark.sparkContext._jsc is not None and not spark.sparkContext._jsc.sc().isStopped():
            drop_cuts(spark)
    except (Py4JError, ConnectionError):
        pass
