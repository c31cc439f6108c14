"""Session helpers: a local session for tests, the shared working folder."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cpus: int | str = 8, **conf: str) -> SparkSession:
    """A local session with the settings that tests and the bench use."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("tideline")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def is_local(spark: SparkSession) -> bool:
    """Are the driver and all tasks one process, as with ``local`` and ``local[n]``, but not with ``local-cluster[...]``?"""
    return re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master) is not None


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Only where a session names none and is local, as in tests, a temporary folder
    of this machine is made and set; on a cluster that raises.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    known = spark.sparkContext.getCheckpointDir()
    if named:
        if known is None:
            spark.sparkContext.setCheckpointDir(named)
        return named.rstrip("/")
    if known is None:
        if not is_local(spark):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and the executors share")
        spark.sparkContext.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='spark-')}")
        known = spark.sparkContext.getCheckpointDir()
    return known.rstrip("/")


def scratch_path(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder, never used before."""
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """The same rows with their lineage cut by a reliable checkpoint."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, what: str) -> DataFrame:
    """The same rows, written once as Parquet to the shared folder and read back."""
    spark = df.sparkSession
    path = scratch_path(spark, what)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Bytes of an Arrow batch that goes to a Python worker, unless one row is larger.
BATCH_BYTES = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded_batches(df: DataFrame) -> DataFrame:
    """df, with its session's Arrow batches bounded in bytes as well as in rows, so that long texts do not come in thousands at once."""
    now = df.sparkSession.conf.get(_BATCH, None)
    if now is None or not now.isdigit() or not 0 < int(now) <= BATCH_BYTES:
        df.sparkSession.conf.set(_BATCH, str(BATCH_BYTES))
    return df


def discard(spark: SparkSession, *paths: str) -> None:
    """Delete folders that were written by :func:`scratch_path` and that nothing reads any more."""
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


#: A key is hot if it has more than one in so many of all rows; there are no more such keys than this.
HOT = 1000


def join_hot(rows: DataFrame, keys: DataFrame, on: str, count: str, total: int | None = None) -> DataFrame:
    """The inner join of rows with keys, which have one row for each value of ``on`` and say in ``count`` how many rows it has.

    The hot keys, HOT at most, are broadcast, so that their rows stay where they are; all others are
    joined as Spark sees fit. ``total``: the sum of the counts, or no less than it by much; computed if not given.
    """
    if total is None:
        total = keys.agg(F.sum(count)).first()[0] or 0
    hot = F.col(count) * HOT > total
    busy = F.broadcast(keys.filter(hot).drop(count).withColumnRenamed(on, "_hot_key"))
    marked = rows.join(busy, F.col(on) == F.col("_hot_key"), "left")
    names = [*rows.columns, *[c for c in keys.columns if c not in (on, count)]]
    served = marked.filter(F.col("_hot_key").isNotNull()).select(*names)
    rest = marked.filter(F.col("_hot_key").isNull()).select(*rows.columns).join(keys.filter(~hot).drop(count), on).select(*names)
    return served.unionByName(rest)


def fresh_name(df: DataFrame, name: str) -> str:
    """A column name that df does not have, whatever the case of its letters."""
    there = {c.lower() for c in df.columns}
    while name.lower() in there:
        name += "_"
    return name


def ddl(df: DataFrame) -> str:
    """The columns of df as a schema text."""
    return ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in df.schema.fields)
