"""Session helpers: shared folder, reliable cuts, size-checked broadcasts."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from functools import reduce
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it.

    ``spark.checkpoint.dir`` is read from the session. Only a local session
    without that setting gets a temporary folder; a cluster without it is an
    error, because a machine-local folder is lost with its machine.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        named = tempfile.mkdtemp(prefix="ragloom-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(named)
    return named.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path under the shared folder."""
    return f"{shared_dir(spark)}/ragloom/{label}-{uuid.uuid4().hex}"


WRITERS = "spark.sql.maxConcurrentOutputFileWriters"
OPEN_FILES = 64  # a task with more folders to write sorts its rows by them


def written(df: DataFrame, label: str, partition_by: str | None = None, large_rows: bool = False) -> DataFrame:
    """Cut lineage through a parquet table in the shared folder.

    Unlike ``checkpoint()`` the result keeps column pruning, filter pushdown
    and size statistics. With ``partition_by`` a task keeps the files of its few
    folders open instead of sorting its rows by folder. With ``large_rows``, of megabytes,
    pages and row groups are measured behind each row, not behind a hundred.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    if partition_by is None:
        often = {f"parquet.{what}.size.row.check.{end}": 1 for what in ("page", "block") for end in ("min", "max")} if large_rows else {}
        df.write.options(**often).parquet(path)
    else:
        before = spark.conf.get(WRITERS)
        spark.conf.set(WRITERS, str(OPEN_FILES))
        try:
            df.write.partitionBy(partition_by).parquet(path)
        finally:
            spark.conf.set(WRITERS, before)
    return spark.read.schema(df.schema).parquet(path)


def settled(df: DataFrame) -> tuple[DataFrame, int]:
    """Evaluate a set once: written to the shared folder and read from there, with its row count.

    The count comes from what was written, so nothing is computed twice, whatever the size.
    """
    out = written(df, "set")
    return out, out.count()


def broadcast_within(df: DataFrame, rows: int, row_bytes: int, limit_bytes: int) -> DataFrame:
    """Hint a broadcast only where ``rows * row_bytes`` is known to fit."""
    if rows * row_bytes <= limit_bytes:
        return F.broadcast(df)
    return df


def salted_join(big: DataFrame, small: DataFrame, on: list[str], salt_col: str, salts: int) -> DataFrame:
    """Inner equi-join whose hot keys on ``big`` are spread over ``salts`` tasks.

    ``big`` rows take a salt from the hash of ``salt_col``; ``small`` rows are
    repeated once per salt, so every pair still meets exactly once.
    """
    left = big.withColumn("_salt", F.pmod(F.xxhash64(salt_col), F.lit(salts)).cast("int"))
    right = small.withColumn("_salt", F.explode(F.array(*[F.lit(i) for i in range(salts)])))
    return left.join(right, on + ["_salt"]).drop("_salt")


def one_row(*aggregates: DataFrame) -> DataFrame:
    """Single-row aggregates with different columns, side by side, without a cross join."""
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), aggregates)
    return stacked.agg(*[F.max(c).alias(c) for c in stacked.columns])


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once per application.

    Needed by operators whose tasks run package code; a cluster that installs
    the package on every node loses nothing by it.
    """
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    archive = shutil.make_archive(
        str(Path(tempfile.mkdtemp(prefix="ragloom-ship-")) / "ragloom"), "zip", root.parent, root.name
    )
    sc.addPyFile(archive)
    _shipped.add(sc.applicationId)
