"""Small groups in Arrow batches: many groups a call, where a call for each group would cost more than its work."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StructType


def by_group(df: DataFrame, key: str, order: list[Column], work: Callable[[pa.Table, list[range]], pa.Table], schema: StructType | str) -> DataFrame:
    """work(table, groups) over the rows of df, sorted by key and order; each range of groups is all rows of one key.

    A task holds one Arrow batch and the rows of a key that goes on into the next one, so the groups must be small. Rows
    are dealt by a digest of the key: Spark takes out a shuffle by the key itself above a join on it, and may then
    replan that join without its shuffle, which no operator here would forbid.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None

        def done(table: pa.Table, keys: list) -> list[pa.RecordBatch]:
            groups, start = [], 0
            for _, same in groupby(keys):
                size = sum(1 for _ in same)
                groups.append(range(start, start + size))
                start += size
            return work(table, groups).to_batches()

        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if rest is None else pa.concat_tables([rest, table])
            keys = table[key].to_pylist()
            last = len(keys)
            while last and keys[last - 1] == keys[-1]:
                last -= 1
            rest = table.slice(last).combine_chunks()
            if last:
                yield from done(table.slice(0, last).combine_chunks(), keys[:last])
        if rest is not None and rest.num_rows:
            yield from done(rest, rest[key].to_pylist())

    return df.repartition(F.xxhash64(key)).sortWithinPartitions(key, *order).mapInArrow(run, schema)
