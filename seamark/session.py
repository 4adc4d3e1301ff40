"""Session settings and lineage cuts shared by every operator."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Settings the operators rely on; anything already set on the session wins.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def build_session(app: str = "seamark", master: str | None = None, **extra: str) -> SparkSession:
    """A session with DEFAULTS; ``extra`` overrides them (dots written as ``__``)."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    for k, v in {**DEFAULTS, **{k.replace("__", "."): v for k, v in extra.items()}}.items():
        b = b.config(k, v)
    return b.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder, which ``spark.checkpoint.dir`` names. Where it is unset, a temporary folder in local mode, as in tests; an error on a cluster, where such a folder would be lost with its machine."""
    sc = spark.sparkContext
    have = sc.getCheckpointDir()
    if have:
        return have
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named and not sc.master.startswith("local") or not named and sc.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir names no shared folder for intermediate tables")
    sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="seamark-checkpoint-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and go on from the written copy.

    Survives the loss of any executor, keeps partitions and their order, and stops plans that
    are used twice from being computed twice.
    """
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def cut_table(df: DataFrame, codec: str | None = None) -> DataFrame:
    """As ``cut``, but written by column to a table in the shared checkpoint folder: compact, and later reads take only the columns they need.

    Keeps neither partitions nor order. The table is removed when the driver's Python ends. ``codec``: of parquet, if not the session's.
    """
    spark = df.sparkSession
    at = f"{checkpoint_dir(spark)}/table-{uuid.uuid4()}"
    df.write.parquet(at, compression=codec)
    atexit.register(_remove, spark, at)
    return spark.read.schema(df.schema).parquet(at)


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Within it, files of a query's shuffles are removed when the query ends, not when the driver happens to collect its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def _remove(spark: SparkSession, at: str) -> None:
    try:
        path = spark._jvm.org.apache.hadoop.fs.Path(at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # noqa: BLE001 - the session, and with it perhaps the folder, is already gone
        pass


def spread(df: DataFrame) -> DataFrame:
    """``df`` with at least a partition a core, for stages that run Python on every row.

    Inputs with as many splits as cores, as all large ones, are left as they are: no shuffle is added.
    """
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n) if df.rdd.getNumPartitions() < n else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the parquet tables of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
