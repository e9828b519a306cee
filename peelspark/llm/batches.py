"""Arrow batches of rows that hold whole texts."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Rows of an Arrow batch: a row may bring two whole token sets, and a Python worker holds several batches.
ROWS = 1_000
_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"


def short_batches(spark: SparkSession) -> None:
    """Cut the session's Arrow batches to ``ROWS``; a smaller setting stays.

    The setting holds when a plan runs, which for a lazy result is after its
    operator has returned, so it is the session's and isn't put back.
    """
    now = int(spark.conf.get(_SETTING))
    if not 0 < now <= ROWS:
        spark.conf.set(_SETTING, str(ROWS))
