"""Chunk tables that readers see only when complete."""

from __future__ import annotations

import re
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ragloom.session import shared_dir

_NAME = re.compile(r"[a-z_][a-z0-9_]*")
_VERSION = "ragloom.version"


def checked_name(name: str) -> str:
    if not _NAME.fullmatch(name):
        raise ValueError(f"invalid table name: {name!r}")
    return name


def _point(spark: SparkSession, name: str, version: str) -> None:
    spark.sql(
        f"CREATE OR REPLACE VIEW {name} TBLPROPERTIES ('{_VERSION}' = '{version}') AS SELECT * FROM {version}"
    )


def current_version(spark: SparkSession, name: str) -> str:
    """The stored table a name stands for."""
    return spark.sql(f"SHOW TBLPROPERTIES {checked_name(name)} ('{_VERSION}')").head()["value"]


def full_reload(df: DataFrame, name: str, location: str | None = None) -> DataFrame:
    """Replace the content of ``name`` by ``df``.

    The rows go into a new stored table; the name is pointed at it only after
    the write has succeeded, so a failed reload leaves the old content. Loading
    the same rows again gives the same content. A version that no name stands
    for any more is dropped; readers that began on it hold it by ``reading``.
    """
    spark = df.sparkSession
    version = f"{checked_name(name)}__{uuid.uuid4().hex}"
    path = f"{location or shared_dir(spark) + '/ragloom/tables'}/{version}"
    df.write.option("path", path).saveAsTable(version)
    before = current_version(spark, name) if spark.catalog.tableExists(name) else None
    _point(spark, name, version)
    _drop_unused(spark, before)
    return spark.table(name)


def _filesystem(spark: SparkSession, place: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(place)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _leases(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/ragloom/leases"


def _leased(spark: SparkSession, version: str) -> bool:
    """Whether a reader still holds a version; a lease that ran out counts no more."""
    path, fs = _filesystem(spark, f"{_leases(spark)}/{version}")
    if not fs.exists(path):
        return False
    return any(int(f.getPath().getName().rpartition("-")[2]) > time.time() for f in fs.listStatus(path))


@dataclass(frozen=True)
class Held:
    """The rows of a stored version, and its name."""

    rows: DataFrame
    version: str


@contextmanager
def reading(spark: SparkSession, name: str, seconds: int = 86_400) -> Iterator[Held]:
    """The rows that ``name`` stands for now, held until the block ends.

    A reload or promotion meanwhile changes what the name stands for, not these
    rows: their version is leased for ``seconds`` at most, and is dropped by
    whoever gives it up last.
    """
    while True:
        version = current_version(spark, name)
        path, fs = _filesystem(spark, f"{_leases(spark)}/{version}/{uuid.uuid4().hex}-{int(time.time()) + seconds}")
        fs.create(path).close()
        if spark.catalog.tableExists(version):
            break
        fs.delete(path, False)  # dropped between the look and the lease
    try:
        yield Held(spark.table(version), version)
    finally:
        fs.delete(path, False)
        _drop_unused(spark, version)


def _drop_unused(spark: SparkSession, version: str | None) -> None:
    """Drop a stored version, with its files, once no name stands for it and no reader holds it."""
    if version is None or not spark.catalog.tableExists(version) or _leased(spark, version):
        return
    for row in spark.sql("SHOW VIEWS").collect():
        if not row["isTemporary"]:
            kept = spark.sql(f"SHOW TBLPROPERTIES {row['viewName']}").filter(F.col("key") == _VERSION).head()
            if kept and kept["value"] == version:
                return
    place = spark.sql(f"DESCRIBE EXTENDED {version}").filter("col_name = 'Location'").head()["data_type"]
    spark.sql(f"DROP TABLE {version}")
    path, fs = _filesystem(spark, place)
    fs.delete(path, True)
    path, fs = _filesystem(spark, f"{_leases(spark)}/{version}")
    fs.delete(path, True)


def promote(spark: SparkSession, shadow: str, live: str, version: str | None = None) -> DataFrame:
    """Let ``live`` stand for what the shadow table holds now, or for the ``version`` of it that was looked at."""
    before = current_version(spark, live) if spark.catalog.tableExists(checked_name(live)) else None
    version = version or current_version(spark, shadow)
    _point(spark, live, version)
    if before != version:
        _drop_unused(spark, before)
    return spark.table(live)
