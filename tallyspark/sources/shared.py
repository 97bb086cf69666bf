"""The folder that driver and executors share, and results that are kept there."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession, functions as F


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder of this application, in spark.checkpoint.dir.

    A session on one machine (tests, notebooks) may leave that unset and gets a temporary folder; on a cluster an
    executor's folder is no place that others can read, so there the setting is needed.
    """
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-"))
    return context._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder and go on from there."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


#: A table of up to this many rows may go to every task; a dictionary of more has too many words for one to hold most rows.
SENT = 100_000


def small(df: DataFrame) -> DataFrame:
    """df, marked to be sent to every task if a count proves that it is small, so that the rows of a frequent word, which
    would meet in one task, stay where they are."""
    return F.broadcast(df) if df.limit(SENT + 1).count() <= SENT else df


#: Rows of a task, where its memory is to stay the same for a table of any size.
ROWS = 500_000


def tasks_of(*tables: DataFrame) -> int:
    """As many tasks as give each about ROWS rows of the tables, by a count."""
    return max(-(-sum(df.count() for df in tables) // ROWS), tables[0].sparkSession.sparkContext.defaultParallelism)


def dealt(df: DataFrame, *keys: str, tasks: int | None = None) -> DataFrame:
    """df dealt by its keys to tasks of about ROWS rows, or to as many as told. Groupings, windows and joins on the keys take
    these tasks as they are, whatever number of shuffle partitions the session has; sides of a join need the same number."""
    return df.repartition(tasks or tasks_of(df), *keys)
