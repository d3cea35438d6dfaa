"""Session helpers: where intermediate tables go, and how lineage is cut."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local_dir: str | None = None
_written: list[str] = []


def get_session(app: str = "inkstream", master: str = "local[8]", shuffle_partitions: int = 8) -> SparkSession:
    """A local session with the settings the engine expects (UTC, AQE, Arrow)."""
    return (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the cluster names it in ``spark.checkpoint.dir``.

    Only where the setting is absent and the master is local (tests) a folder of our own is made; it is removed at exit. On a
    cluster, whose executors would each write to their own disk, the setting is required.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not re.fullmatch(r"local(\[.*\])?", master):
        raise ValueError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
    global _local_dir
    if _local_dir is None:
        _local_dir = tempfile.mkdtemp(prefix="inkstream-")
        atexit.register(shutil.rmtree, _local_dir, True)
    return f"file://{_local_dir}"


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder; ``drop_materialized`` deletes what is written there."""
    path = f"{shared_dir(spark)}/inkstream/{tag}-{uuid.uuid4().hex}"
    _written.append(path)
    return path


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    This cuts the lineage durably: a lost executor costs a re-read, not a recomputation. The schema is
    handed to the reader, so no job is spent on footers, and empty results keep their columns.
    """
    spark = df.sparkSession
    path = scratch_path(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_materialized(spark: SparkSession) -> int:
    """Delete what was written at the paths of ``materialize`` and ``scratch_path`` in this process; for long sessions, once their results are stored."""
    paths, _written[:] = list(_written), []
    for path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    return len(paths)
