"""Shared-folder tables: what cuts lineage and survives a lost executor.

Every intermediate is a parquet table below ``spark.checkpoint.dir``, which the
driver and all executors share.  Only where the session leaves that setting
unset and runs on one machine (tests, local use) a folder below
``/tmp/checkpoints`` is chosen; on a cluster that is an error.

Tables that are no longer read are dropped by whoever made them; those that a
lazy result still reads stay until ``scratch`` ends or the application does.
"""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Paths of the tables that are there, by the application that made them.
_TABLES: dict[str, dict[str, SparkSession]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that the session names in ``spark.checkpoint.dir``."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file:///tmp/checkpoints/peelspark"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _known(spark: SparkSession) -> dict[str, SparkSession]:
    app = spark.sparkContext.applicationId
    if app not in _TABLES:
        _TABLES[app] = {}
        atexit.register(_clear, app)
    return _TABLES[app]


def _clear(app: str) -> None:
    """At the end of the driver: its tables go, if its session still runs."""
    for path, spark in list(_TABLES.pop(app, {}).items()):
        try:
            delete(spark, path)
        except Exception:  # noqa: BLE001, the session has ended: nothing can be deleted through it
            return


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it again."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    _known(df.sparkSession)[path] = df.sparkSession
    kept = df.sparkSession.read.schema(df.schema).parquet(path)
    kept.kept_at = path
    return kept


def delete(spark: SparkSession, path: str) -> bool:
    sc = spark.sparkContext
    at = sc._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)


def drop(*kept: DataFrame) -> None:
    """Remove the files of tables that ``keep`` returned and nothing reads any more."""
    for df in kept:
        if _known(df.sparkSession).pop(df.kept_at, None):
            delete(df.sparkSession, df.kept_at)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[list[DataFrame]]:
    """Tables kept inside go at the end, but for those appended to the list."""
    before, stay = set(_known(spark)), []
    yield stay
    for path in set(_known(spark)) - before - {df.kept_at for df in stay}:
        del _known(spark)[path]
        delete(spark, path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of a side that may be broadcast; beyond it the join is shuffled.
BROADCAST = 16 << 20


def sized(df: DataFrame, row_bytes: int) -> DataFrame:
    """``df``, marked for broadcast if its counted rows fit ``BROADCAST``; a row takes ``row_bytes``."""
    return F.broadcast(df) if df.limit(BROADCAST // row_bytes + 1).count() * row_bytes <= BROADCAST else df


def without(df: DataFrame, ids: DataFrame, on: str) -> DataFrame:
    """``df`` less the rows whose ``on`` is in ``ids`` (one column of that name); nulls stay."""
    ids = keep(ids.select(on).filter(f"`{on}` IS NOT NULL").distinct(), "left-out")
    return df.join(sized(ids, 32), on, "left_anti")
