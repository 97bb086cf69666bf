"""Streams, written outputs and SQL functions: each query reads a driver table and returns what was written."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tallyspark.functions import sql as Q
from tallyspark.sources import messages as M
from tallyspark.sources.shared import shared_folder
from tallyspark.sources.store import Incomplete, Store, publish_complete, replace_days
from tallyspark.streaming import ledger_stream as L

from . import ledger as batch
from .base import Plans, table

plans = Plans()
QUERIES, ORACLES = plans.queries, plans.oracles


def folder(spark) -> str:
    return f"{shared_folder(spark)}/query-{uuid.uuid4().hex}"


def event_stream(spark, sf_dir):
    """The events table as a file stream."""
    schema = table(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/[e]vents.parquet")


@plans.add("s1_upsert_stream", "SELECT user_id, max(event_id) AS event_id FROM events WHERE day(ts) NOT BETWEEN 5 AND 9 GROUP BY user_id")
def s1(spark, sf_dir):
    where = folder(spark)
    days = table(spark, sf_dir, "events").select(F.col("ts").cast("date").alias("day")).distinct().where("dayofmonth(day) between 5 and 9")
    stream = event_stream(spark, sf_dir).select("user_id", "event_id", F.col("ts").cast("date").alias("day"))
    L.upsert_stream(stream, "user_id", "event_id", f"{where}/ledger", f"{where}/state", days, "day").awaitTermination()
    return L.snapshot(spark, f"{where}/ledger", stream).select("user_id", "event_id")


@plans.add("i5_once_stream", "SELECT user_id, event_type, count(DISTINCT CAST(ts AS DATE)) AS n FROM events GROUP BY ALL")
def once(spark, sf_dir):
    where = folder(spark)
    stream = event_stream(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp")).withColumn("request", F.concat_ws("|", "user_id", "event_type", F.col("ts").cast("date")))
    out = L.once_stream(stream, "request", "ts", "400 days")
    out.writeStream.format("parquet").option("path", f"{where}/out").option("checkpointLocation", f"{where}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{where}/out").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))


@plans.add("i5_first_replies", "WITH f AS (SELECT event_id, CASE WHEN event_id % 10 = 0 THEN NULL ELSE user_id || '|' || event_type END AS request FROM events) SELECT event_id, request, coalesce(min(event_id) OVER (PARTITION BY request), event_id) AS answered, request IS NOT NULL AND event_id > min(event_id) OVER (PARTITION BY request) AS repeated FROM f WHERE request IS NOT NULL UNION ALL SELECT event_id, request, event_id, false FROM f WHERE request IS NULL")
def replies(spark, sf_dir):
    """Every event as a request of its user and kind, some without an id; each gets the number of the first one."""
    where = folder(spark)
    request = F.when(F.col("event_id") % 10 != 0, F.concat_ws("|", "user_id", "event_type"))
    stream = event_stream(spark, sf_dir).select("event_id", request.alias("request"), F.col("event_id").cast("string").alias("reply"))
    out = L.replies(stream, "request", "event_id", "reply")
    out.writeStream.format("parquet").option("path", f"{where}/out").option("checkpointLocation", f"{where}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{where}/out").select(F.col("seq").alias("event_id"), "request", F.col("reply").cast("long").alias("answered"), "repeated")


@plans.add("i1_stream_log", "SELECT count(DISTINCT user_id) AS n_inserted, 0 AS n_updated, 'stream' AS source FROM events")
def stream_log(spark, sf_dir):
    where = folder(spark)
    stream = event_stream(spark, sf_dir).select("user_id", "event_id")
    L.upsert_stream(stream, "user_id", "event_id", f"{where}/ledger", f"{where}/state").awaitTermination()
    return L.batch_log(spark, f"{where}/ledger").select("n_inserted", "n_updated", "source")


@plans.add("i2_replace_days", """SELECT * FROM (SELECT event_id % 2 AS list, count(*) FILTER (day(ts) NOT BETWEEN 5 AND 9 OR event_id % 3 = 0) AS n, count(*) FILTER (day(ts) BETWEEN 5 AND 9 AND event_id % 3 = 0) AS fresh, count(*) FILTER (day(ts) BETWEEN 5 AND 9) AS archived FROM events GROUP BY 1), (SELECT count(*) AS days FROM range(5, 10))""")
def i2_days(spark, sf_dir):
    """The events as two lists of a store, odd and even ones; five days of both are replaced by a third of their rows."""
    store = Store(spark, folder(spark))
    rows = batch.events(spark, sf_dir).select("event_id", "day", F.lit(False).alias("fresh"))
    day = lambda d: F.lit(f"2024-01-{d:02d}").cast("date")
    for odd in (0, 1):
        taken, version = store.begin()
        store.commit(taken, version.folders | {f"list{odd}": [store.write(rows.where(F.col("event_id") % 2 == odd), "list")]})
    new = rows.where(F.col("day").between(day(5), day(9)) & (F.col("event_id") % 3 == 0)).withColumn("fresh", F.lit(True))
    version = replace_days(store, {f"list{odd}": new.where(F.col("event_id") % 2 == odd) for odd in (0, 1)}, "day", day(5), day(9), F.lit("2024-02-01").cast("timestamp"), "r1")
    archived = store.read(version, "archive").groupBy(F.right("dataset", F.lit(1)).cast("int").alias("list")).agg(F.count("*").alias("archived"))
    lists = store.read(version, "list0").withColumn("list", F.lit(0)).unionByName(store.read(version, "list1").withColumn("list", F.lit(1)))
    counts = lists.groupBy("list").agg(F.count("*").alias("n"), F.count_if("fresh").alias("fresh"))
    days = store.read(version, "refreshed_days").agg(F.count("*").alias("days"))
    return counts.join(archived, "list").join(F.broadcast(days), F.lit(True))


@plans.add("a4_publish_complete", "SELECT o_orderkey FROM orders")
def a4_publish(spark, sf_dir):
    """All orders are published; a later run that lacks some leaves them."""
    store, rows = Store(spark, folder(spark)), table(spark, sf_dir, "orders")
    expected = rows.groupBy("o_custkey").count().agg(F.coalesce(F.sum("count"), F.lit(0))).head()[0]
    publish_complete(store, "orders", rows, expected, F.col("o_orderdate").isNull())
    try:
        publish_complete(store, "orders", rows.where("o_orderkey % 2 = 0"), expected, F.lit(False))
    except Incomplete:
        pass
    return store.read(store.head(), "orders").select("o_orderkey")


@plans.add("i6_review_stream", f"WITH {batch.FOLD} SELECT record_id, status, agent, company, n_events FROM s")
def reviews(spark, sf_dir):
    where = folder(spark)
    events = event_stream(spark, sf_dir)
    action = F.element_at(F.array(*[F.lit(a) for a in ("edit", "confirm", "agent_confirm", "return", "needs_info", "edit", "reset")]), (F.col("event_id") % 7 + 1).cast("int"))
    fields = F.create_map(F.element_at(F.array(F.lit("agent"), F.lit("company"), F.lit("project")), (F.col("event_id") % 3 + 1).cast("int")), F.col("event_type"))
    stream = events.select(F.col("user_id").alias("record_id"), F.col("event_id").alias("seq"), action.alias("action"), fields.alias("fields"))
    keep = lambda rows, n: rows.withColumn("batch", F.lit(n)).write.mode("overwrite").parquet(f"{where}/out/b={n}")
    L.reviews(stream).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{where}/state").trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.parquet(f"{where}/out")
    last = rows.groupBy("record_id").agg(F.max_by(F.struct("status", "agent", "company", "n_events"), "batch").alias("r")).select("record_id", "r.*")
    return last.where("n_events > 0")


@plans.add("a15_write_pair", "WITH q AS (SELECT CASE o_orderstatus WHEN 'F' THEN 'work' WHEN 'O' THEN 'filtered' ELSE 'review' END AS queue, count(*) AS n FROM orders GROUP BY 1) SELECT unnest(['run', 'current']) AS copy, queue, n FROM q")
def a15(spark, sf_dir):
    where = folder(spark)
    queue = F.when(F.col("o_orderstatus") == "F", "work").when(F.col("o_orderstatus") == "O", "filtered")
    M.write_stage1(table(spark, sf_dir, "orders").withColumn("queue", queue), "queue", where, "r1")
    read = lambda df, name: df.select(F.lit(name).alias("copy"), F.col("queue").cast("string").alias("queue"))
    return read(spark.read.parquet(f"{where}/run_id=r1"), "run").union(read(M.read_stage1(spark, where), "current")).groupBy("copy", "queue").agg(F.count("*").alias("n"))


@plans.add("a16_archive_run", "SELECT 'r1' AS run_id, DATE '1995-01-01' AS low, DATE '2001-12-31' AS high, count(*) FILTER (o_orderstatus = 'F') AS n_work, count(*) FILTER (o_orderstatus = 'P') AS n_review FROM orders")
def a16(spark, sf_dir):
    where = folder(spark)
    queue = F.when(F.col("o_orderstatus") == "F", "work").when(F.col("o_orderstatus") == "O", "filtered")
    M.write_stage1(table(spark, sf_dir, "orders").withColumn("queue", queue), "queue", where, "r1")
    M.archive_run(spark, where, f"{where}/archive", "1995-01-01", "2001-12-31", "r1")
    manifest = M.list_archives(spark.read.parquet(f"{where}/archive/manifest"))
    return manifest.select("run_id", "low", "high", F.col("counts")["work"].alias("n_work"), F.col("counts")["review"].alias("n_review"))


@plans.add("a18_ingest", "SELECT event_id FROM events WHERE event_type = 'click'")
def a18(spark, sf_dir):
    where = folder(spark)
    stream = event_stream(spark, sf_dir).where("event_type = 'click'").select("event_id", "value")
    L.upsert_stream(stream, "event_id", "value", f"{where}/ledger", f"{where}/state").awaitTermination()
    return L.snapshot(spark, f"{where}/ledger", stream).select("event_id")


@plans.add("a20_check_import", "SELECT n.name, n.lacks, n.usable FROM (VALUES ('part', [], (SELECT count(*) > 0 FROM part WHERE trim(p_name) <> '' AND trim(p_brand) <> '')), ('nation', ['p_name', 'p_brand'], false), ('small parts', [], (SELECT count(*) > 0 FROM part WHERE p_size < 0))) n(name, lacks, usable)")
def a20(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    tables = {"part": part, "nation": table(spark, sf_dir, "nation"), "small parts": part.where("p_size < 0")}
    results = [(name, *M.check_import(df, ["p_name", "p_brand"])) for name, df in tables.items()]
    return spark.createDataFrame(results, "name string, lacks array<string>, usable boolean")


@plans.add("k1_sql_functions", "SELECT p_partkey, replace(p_name, ' ', '') AS n, 'abc' || regexp_replace(lower(p_brand), '[^a-z0-9]+', '', 'g') AS k, CASE WHEN p_name LIKE 'red%' THEN 100 ELSE NULL END AS s FROM part")
def k1(spark, sf_dir):
    text = "SELECT p_partkey, norm_text(p_name) AS n, identity_key('ＡＢ　c ' || p_brand) AS k, CASE WHEN p_name LIKE 'red%' THEN similarity(p_name, p_name) END AS s FROM {part}"
    return Q.query(spark, text, part=table(spark, sf_dir, "part"))


@plans.add("k2_group_segments", "WITH s AS (SELECT user_id, event_id, CASE WHEN event_id % 7 = 0 THEN 'c' || event_id END AS co, CASE WHEN event_id % 3 = 0 THEN 'n' || event_id % 5 END AS na, CASE WHEN event_id % 2 = 0 THEN event_type END AS service FROM events), n AS (SELECT *, count(co) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS record_no FROM s), c AS (SELECT *, last_value(co IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS company, last_value(na IGNORE NULLS) OVER (PARTITION BY user_id, record_no ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS country FROM n) SELECT user_id AS mail, event_id AS no, record_no, company, country, service FROM c WHERE service IS NOT NULL AND company IS NOT NULL")
def k2(spark, sf_dir):
    """The segments of f4_group_segments by the table function, called from SQL."""
    text = """SELECT g.* FROM group_segments(TABLE(SELECT user_id AS mail, event_id AS no, CASE WHEN event_id % 7 = 0 THEN concat('c', event_id) END AS company,
        CASE WHEN event_id % 3 = 0 THEN concat('n', event_id % 5) END AS country, CASE WHEN event_id % 2 = 0 THEN event_type END AS service FROM {events}) PARTITION BY mail ORDER BY no) g"""
    return Q.query(spark, text, events=table(spark, sf_dir, "events"))


@plans.add("k3_arrow_similarity", "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 100 WHEN p_partkey % 3 = 1 THEN 50 END AS s, CASE WHEN p_partkey % 3 = 2 THEN NULL ELSE 100 END AS part FROM part")
def k3(spark, sf_dir):
    other = "CASE p_partkey % 3 WHEN 0 THEN p_name WHEN 1 THEN concat(p_name, repeat('#', 2 * length(p_name))) END"
    return Q.query(spark, f"SELECT p_partkey, similarity_arrow(p_name, {other}) AS s, partial_similarity_arrow(p_name, {other}) AS part FROM {{part}}", part=table(spark, sf_dir, "part"))
