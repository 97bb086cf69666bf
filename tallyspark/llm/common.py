"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tallyspark.operators.graph import components
from tallyspark.sources.shared import cut, shared_folder

__all__ = ["BLANKS", "BLANK_CHARS", "components", "cut", "read", "slices", "stored", "text_id"]

#: Fixed value: what separates words, as a Java and RE2 class body.
BLANKS = r"\x20\x09-\x0D"
#: The same characters, for str.split-like work in Python.
BLANK_CHARS = " \t\n\x0b\x0c\r"
#: Rows that a worker turns into Python values at a time.
ROWS = 500


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def stored(df: DataFrame) -> DataFrame:
    """As cut(), but as a compressed table of the same folder: for wide intermediate results.

    The shuffle files of the finished plan are free once the driver has collected its garbage; it is asked to.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    spark.sparkContext._jvm.System.gc()
    return spark.read.schema(df.schema).parquet(path)


def slices(batches: Iterator[pa.RecordBatch], rows: int = ROWS) -> Iterator[pa.RecordBatch]:
    """The rows of Arrow batches, in their order, in batches of up to `rows`: what a worker makes of them at a time."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def text_id(text: Column) -> Column:
    """A text's digest for keys of rows whose doc_id repeats; null is not the empty text."""
    return F.coalesce(F.unhex(F.md5(text)), F.lit(b""))
