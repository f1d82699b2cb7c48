"""Session defaults and the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Times its even share of the rows, over all cores, that the largest split of a table may hold.
UNEVEN = 1.5
#: The JVM never compiles a method of more bytes than this.
COMPILED = 8000


def build_session(app: str = "rentweave", master: str | None = None, **conf) -> SparkSession:
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.codegen.hugeMethodLimit", COMPILED)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if master:
        builder = builder.master(master)
    for name, value in conf.items():
        builder = builder.config(name.replace("__", "."), str(value))
    return builder.getOrCreate()


def pin_utc(spark: SparkSession) -> SparkSession:
    """All listing times are UTC instants; the session must agree before parsing or formatting any."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def compile_wide_rows(spark: SparkSession) -> SparkSession:
    """Stages over wide listings run as compiled code.

    Spark puts a whole stage into one method, which for a listing's columns grows beyond what the JVM compiles, so every row would be interpreted. With this
    limit such a stage runs operator by operator, in methods that are compiled.
    """
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", str(COMPILED))
    return spark


def join_in_place(spark: SparkSession) -> SparkSession:
    """Rows dealt by a key stay where they are in joins on that key and further columns; only the smaller side moves, if at all.

    Without this, Spark deals wide rows out by all columns of such a join and back by the key for the next window. Meant for keys whose
    hot ones are split apart (`operators.skew`).
    """
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """Folder for checkpoints and batch state.

    The cluster names a shared folder in ``spark.checkpoint.dir``. Only a session without that setting
    (a local test) gets a temporary one.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    current = spark.sparkContext.getCheckpointDir()
    if named:
        if current is None:
            spark.sparkContext.setCheckpointDir(named)
        return named
    if current is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        current = tempfile.mkdtemp(prefix="rentweave-ckpt-")
        spark.sparkContext.setCheckpointDir(current)
    return current


@contextmanager
def passing_shuffles(spark: SparkSession) -> Iterator[None]:
    """The shuffle files of tables made and run inside go when the run ends, so that steps of a job don't add up on disk. For tables run once."""
    conf, name = spark.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    own = conf.get(name)
    conf.set(name, "true")
    try:
        yield
    finally:
        conf.set(name, own)


def cut_lineage(df: DataFrame) -> DataFrame:
    """The table as written into the checkpoint folder: a lost executor costs a read of it, not the work that led to it."""
    checkpoint_root(df.sparkSession)
    with passing_shuffles(df.sparkSession):
        return df.select("*").checkpoint()


def stored_apart(df: DataFrame) -> DataFrame:
    """As `cut_lineage`, for tables of many rows: by column and compressed, a fraction of what checkpointed rows take."""
    path = f"{checkpoint_root(df.sparkSession).rstrip('/')}/apart/{uuid.uuid4().hex}"
    with passing_shuffles(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *by: str) -> DataFrame:
    """Hash a scan over all cores if a few of its splits hold most rows.

    The number of splits does not tell: Parquet rows lie in the split that has the middle of their row group, so a file of few row groups comes as
    many splits, most of them empty. Rows are counted by split, which reads no column. A table that is even already is returned as it is.
    """
    cores, splits = df.sparkSession.sparkContext.defaultParallelism, df.rdd.getNumPartitions()
    if splits >= cores:
        by_split = df.groupBy(F.spark_partition_id().alias("split")).count()
        rows, most = by_split.agg(F.sum("count"), F.max("count")).first()
        if not rows or most * cores <= UNEVEN * rows:
            return df
    return df.repartition(max(cores, splits), *by)
