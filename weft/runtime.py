"""Session settings and the shared folder in which lineage is cut.

Executors can be lost at any time, so intermediate tables that are read more than
once are written as Parquet to the folder named by ``spark.checkpoint.dir`` and
read back: a later stage then depends on files only.  Only where the setting is
absent *and* the master is local (tests) a temporary folder is made.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}

_local: dict[str, str] = {}


def session(app: str = "weft", master: str | None = None, **extra: str) -> SparkSession:
    """A session with the settings the operators expect (UTC, adaptive plans, Arrow)."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    for k, v in {**SETTINGS, **extra}.items():
        b = b.config(k, v)
    return b.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``; raises on a cluster without one."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if sc.applicationId not in _local:
        _local[sc.applicationId] = path = tempfile.mkdtemp(prefix="weft-")
        atexit.register(shutil.rmtree, path, ignore_errors=True)
    return "file://" + _local[sc.applicationId]


def own_dir(spark: SparkSession) -> str:
    """The application's part of the shared folder."""
    return f"{shared_dir(spark)}/weft-{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the application's folder."""
    return f"{own_dir(spark)}/{label}-{uuid.uuid4().hex}"


def clear(spark: SparkSession) -> None:
    """Delete the tables this application has cut; results must have been written before."""
    path = spark._jvm.org.apache.hadoop.fs.Path(own_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def cut(df: DataFrame, label: str = "table") -> DataFrame:
    """Write ``df`` to the shared folder and return the table read back.

    The rows are computed once and survive the loss of executors; columnar
    compression keeps the copy smaller than a checkpoint of rows would be.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.cut_path = path
    return out


def drop(table: DataFrame) -> None:
    """Delete a table of :func:`cut` that nothing reads any more, and let go of the shuffle files of finished jobs.

    Shuffle files go when the driver's garbage collector finds their jobs unreachable, by default after half an hour; a long
    job with several large steps would hold all of them until then.
    """
    spark = table.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(table.cut_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    spark._jvm.System.gc()


#: Tables below so many bytes are not worth a shuffle.
SPREAD_FROM = 1 << 20


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores if it is a scan of fewer splits than there are cores, as single small files are.

    Tables of a cluster's size have more splits than cores and pass unchanged.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    plan = df._jdf.queryExecution()
    if int(str(plan.optimizedPlan().stats().sizeInBytes())) < SPREAD_FROM or plan.toRdd().getNumPartitions() >= cores:
        return df
    return df.repartition(cores)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder."""
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))
