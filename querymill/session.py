"""Session helpers: builder defaults, table access and lineage cutting in the cluster's shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Settings every job of this engine is written for; a cluster's own values win.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build(master: str | None = None, app: str = "querymill", **conf: str) -> SparkSession:
    """A session with DEFAULTS; keyword names use _ for . in Spark's setting names."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in (DEFAULTS | {k.replace("_", "."): v for k, v in conf.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """Table `name` of the data set in sf_dir; only `columns` reach the scan if any are given."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir.

    Only a local master may do without it; it then gets a temporary folder of its own.
    """
    sc = spark.sparkContext
    where = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    current = sc._jsc.sc().getCheckpointDir()
    if where:
        if not current.isDefined():
            sc.setCheckpointDir(where)
        return where
    if current.isDefined():
        return current.get()
    if not sc.master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    where = tempfile.mkdtemp(prefix="querymill-")
    sc.setCheckpointDir(where)
    return where


def cut(df: DataFrame) -> DataFrame:
    """df computed once and kept in the shared folder, so that a lost executor loses nothing."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Paths that write_shared has written, by application.
_WRITTEN: dict[str, list[str]] = {}


def write_shared(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet below the shared folder and read again; unlike cut(), columns can be pruned.

    It stays there for whatever is read from it later, until release() or the folder's owner removes it.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def written(spark: SparkSession) -> int:
    """How many tables write_shared has written for this application: a mark for release()."""
    return len(_WRITTEN.get(spark.sparkContext.applicationId, []))


def release(spark: SparkSession, since: int = 0) -> int:
    """Removes what write_shared has written since a mark; for when nothing read from it is needed any more."""
    paths = _WRITTEN.get(spark.sparkContext.applicationId, [])
    gone = paths[since:]
    for path in gone:
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)
    del paths[since:]
    return len(gone)


#: Setting with the number of tasks that passes in Python are dealt out to; unset, they run as the scan is split.
PASS_TASKS = "spark.querymill.pass.tasks"


def spread(df: DataFrame) -> DataFrame:
    """df in PASS_TASKS partitions, if that is set: for small files of heavy rows, which would keep one core busy."""
    tasks = df.sparkSession.conf.get(PASS_TASKS, None)
    return df.repartition(int(tasks)) if tasks else df
