"""Materialisation that survives the loss of an executor.

Iterative operators and two-pass ranks need a result that will not be computed
twice with different partition borders.  They use reliable checkpoints, or tables in the
shared folder named by ``spark.checkpoint.dir``; nothing is kept only on the
executors' disks.
"""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Bytes under which a side is broadcast; above them the join is left to the planner.
BROADCAST_BYTES = 32 << 20


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the session's checkpoint folder; invent one only for local runs."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not named:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        named = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    sc.setCheckpointDir(named)
    return sc.getCheckpointDir()


def durable(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the checkpoint folder and read it from there."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def _remove(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # the session may be gone
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` as a columnar table in the checkpoint folder and read it from there; later reads prune columns.

    The table is deleted when the driver's Python ends.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_remove, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def broadcast_if_small(small: DataFrame, row_bytes: int) -> DataFrame:
    """``small`` (a stored table), with a broadcast hint if its counted rows of ``row_bytes`` fit the bound."""
    return F.broadcast(small) if small.count() * row_bytes <= BROADCAST_BYTES else small


ROWS_PER_TASK = 500_000


def spread(df: DataFrame, *by: str, rows: int | None = None, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """``df`` placed by the hash of ``by`` so that a task groups about ``rows_per_task`` rows, whatever the splits of the files.

    Groups that hold few rows each are not made smaller by combining before the shuffle; such a table of a whole file split would
    stay in one task's memory.  ``rows`` is their number if it is known.
    """
    n = df.count() if rows is None else rows
    return df.repartition(max(1, -(-n // rows_per_task)), *by)


def join_bounded(big: DataFrame, small: DataFrame, on: list[str], how: str = "left", row_bytes: int = 160) -> DataFrame:
    """Join a table that is usually small: broadcast it only after counting its rows."""
    return big.join(broadcast_if_small(durable(small), row_bytes), on, how)
