"""Streams into the ledger: file or event streams, foreachBatch, keyed state.

The versioned ledger is a store (sources.store). Each attempt at a batch writes folders of its own and then commits them,
so a batch that runs again after a failure reads the version of the batch before it and never overwrites what it reads.
A version has one folder for each bucket of keys; buckets that a batch doesn't touch are not written again: the commit
names the folder that each bucket is in.
"""

from __future__ import annotations

import time
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tallyspark.functions.text import blank_to_null
from tallyspark.operators.ledger import STATUS, drop_refreshed, upsert
from tallyspark.sources.store import Store


#: Buckets of keys of a ledger; a batch rewrites those that its keys fall into.
BUCKETS = 64


def current(spark: SparkSession, path: str, before: int | None = None) -> dict[int, str]:
    """The folder of each bucket of the current version, or of that before batch `before`; empty before the first."""
    version = Store(spark, path).head(lambda v: before is None or v.about["batch"] < before)
    return {int(name.removeprefix("bucket=")): folders[0] for name, folders in version.folders.items()}


def snapshot(spark: SparkSession, path: str, like: DataFrame, before: int | None = None, buckets: list[int] | None = None) -> DataFrame:
    """The current rows, or those of some buckets; before the first version an empty table of the batch's columns."""
    folders = [folder for bucket, folder in sorted(current(spark, path, before).items()) if buckets is None or bucket in buckets]
    if folders:
        return spark.read.parquet(*folders)
    return like.limit(0).withColumns({"first_seen": F.lit(None).cast("timestamp"), "updated_at": F.lit(None).cast("timestamp")})


def bucket_of(key: str) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")


def publish(spark: SparkSession, path: str, batch: int, key: str, rows: DataFrame, touched: list[int], source: str = "stream") -> None:
    """Write the touched buckets, then commit them with the others' old folders: readers see the old or the new version,
    never a part. rows may have the column change (upsert()), which is counted while they are written, for the log."""
    store, seen = Store(spark, path), Observation()
    numbers = store.numbers()
    change = F.col("change") if "change" in rows.columns else F.lit("")
    counted = rows.observe(seen, *[F.count_if(change == kind).alias(kind) for kind in ("inserted", "updated")])
    folder = store.write(counted.drop("change").withColumn("bucket", bucket_of(key)).repartition("bucket"), "ledger", ["bucket"])
    named = {b: f"{folder}/bucket={b}" for b in touched}
    folders = {f"bucket={b}": [f] for b, f in sorted((current(spark, path, batch) | named).items())}
    about = {"batch": batch, "source": source, "n_inserted": seen.get["inserted"], "n_updated": seen.get["updated"], "logged_at": time.time()}
    store.commit(numbers[0] if numbers else 0, folders, about)


def batch_log(spark: SparkSession, path: str) -> DataFrame:
    """One row for each batch of a ledger: batch, source, n_inserted, n_updated, logged_at; of a batch that ran again,
    the last time."""
    if not Store(spark, path).numbers():
        return spark.createDataFrame([], "batch long, source string, n_inserted long, n_updated long, logged_at timestamp")
    notes = "about struct<batch:long,source:string,n_inserted:long,n_updated:long,logged_at:double>"
    rows = spark.read.schema(notes).json(f"{path}/commits").where("about is not null").select("about.*")
    last = rows.groupBy("batch").agg(F.max_by(F.struct("source", "n_inserted", "n_updated", F.timestamp_seconds("logged_at").alias("logged_at")), "logged_at").alias("r"))
    return last.select("batch", "r.*")


def upsert_stream(stream: DataFrame, key: str, seq: str, path: str, checkpoint: str, refreshed: DataFrame | None = None, day: str | None = None) -> StreamingQuery:
    """Upserts each micro-batch into the ledger at path; rows of refreshed days are late and dropped.

    The last row of a key in a batch counts. Only the buckets of the batch's keys are read and rewritten, so a batch costs
    what it touches, not what the ledger holds. Runs with availableNow, so it ends when the source is read.
    """

    def apply(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = drop_refreshed(batch, refreshed, day) if refreshed is not None else batch
        columns = batch.columns
        last = rows.groupBy(key).agg(F.max_by(F.struct(*columns), seq).alias("_r")).select("_r.*").select(*columns)
        touched = [r["b"] for r in last.select(bucket_of(key).alias("b")).distinct().collect()]
        if touched:
            old = snapshot(spark, path, batch, number, touched).select(*columns, "first_seen", "updated_at")
            publish(spark, path, number, key, upsert(old, last, key, F.current_timestamp()), touched)

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def once_stream(stream: DataFrame, request: str, at: str, within: str) -> DataFrame:
    """The first of each request id; state is given up when the watermark has passed `within`."""
    return stream.withWatermark(at, within).dropDuplicatesWithinWatermark([request])


def replies(stream: DataFrame, request: str, seq: str, reply: str, hold_ms: int | None = None) -> DataFrame:
    """A stream of (seq, request, reply, repeated) for every request: one whose id came before gets the first reply.

    The first reply, by seq within a batch, is kept in state for each id, also over restarts; with hold_ms it is given
    up when no request of that id came for so long. Requests with a null or blank id have no state, get their own reply
    and don't meet in a task.
    """
    out = stream.select(F.col(seq).cast("long").alias("seq"), F.col(request).alias("request"), F.col(reply).cast("string").alias("reply"))

    def answer(key: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        if held.hasTimedOut:
            held.remove()
            return
        first = held.get[0] if held.exists else None
        known = held.exists
        for rows in [pd.concat(list(batches)).sort_values("seq")]:
            if not known:
                first = rows["reply"].iloc[0]
                held.update((first,))
            if hold_ms:
                held.setTimeoutDuration(hold_ms)
            yield rows.assign(reply=first, repeated=[known or i > 0 for i in range(len(rows))])[["seq", "request", "reply", "repeated"]]

    named = blank_to_null(F.col("request")).isNotNull()
    timeout = GroupStateTimeout.ProcessingTimeTimeout if hold_ms else GroupStateTimeout.NoTimeout
    kind = "seq long, request string, reply string, repeated boolean"
    kept = out.where(named).groupBy("request").applyInPandasWithState(answer, kind, "reply string", "append", timeout)
    return kept.union(out.where(~named).select("seq", "request", "reply", F.lit(False).alias("repeated")))


def fold_one(status: str | None, fields: dict[str, str], count: int, action: str, given: dict | None) -> tuple[str | None, dict[str, str], int]:
    """One event of the review fold: the rules of operators.ledger.fold_reviews."""
    if action == "reset":
        return None, {}, 0
    if action in ("edit", "agent_confirm"):
        fields = {**fields, **dict(given or {})}
    if action == "agent_confirm":
        status = "ready" if ((given or {}).get("agent") or "").strip() else "review"
    return STATUS.get(action, status), fields, count + 1


def reviews(stream: DataFrame) -> DataFrame:
    """A stream of (record_id long, status, agent, company, n_events) after each batch of events, in order of seq.

    events: record_id, seq, action, fields (map). State is one small record per record_id.
    """
    state = "status string, fields map<string,string>, n long"
    out = "record_id long, status string, agent string, company string, n_events long"

    def fold(key: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        status, fields, count = held.get if held.exists else (None, {}, 0)
        fields = dict(fields or {})
        rows = pd.concat(list(batches)).sort_values("seq")
        for action, given in zip(rows["action"], rows["fields"]):
            status, fields, count = fold_one(status, fields, count, action, dict(given) if given is not None else None)
        held.update((status, fields, count))
        yield pd.DataFrame({"record_id": [key[0]], "status": [status], "agent": [fields.get("agent")], "company": [fields.get("company")], "n_events": [count]})

    return stream.groupBy("record_id").applyInPandasWithState(fold, out, state, "update", GroupStateTimeout.NoTimeout)
