"""Messages and reference tables: reading, conforming, splitting and writing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tallyspark.functions.text import blank_to_null

from .store import Store


def effective_ts(header: str, arrival: str) -> Column:
    return F.coalesce(F.col(header), F.col(arrival))


def scan_range(df: DataFrame, header: str, arrival: str, low: Column, high: Column) -> DataFrame:
    """A1: messages whose header day, or arrival day where there is no header, lies in the range, both ends in.

    A header day outside the range excludes the message whatever its arrival. Messages without either never match.
    """
    return df.where(effective_ts(header, arrival).cast("date").between(low, high))


def range_metrics(df: DataFrame, header: str, arrival: str, low: Column, high: Column) -> DataFrame:
    """A2: one row: header_hits, fallback_hits, out_of_range, unknown."""
    inside = effective_ts(header, arrival).cast("date").between(low, high)
    has, some = F.col(header).isNotNull(), effective_ts(header, arrival).isNotNull()
    return df.agg(F.count_if(inside & has).alias("header_hits"), F.count_if(inside & ~has).alias("fallback_hits"), F.count_if(some & ~inside).alias("out_of_range"), F.count_if(~some).alias("unknown"))


def union_candidates(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """A3: the keys of both, once each, in numeric order."""
    return a.select(key).union(b.select(key)).distinct().orderBy(F.col(key).cast("long"))


def require_complete(df: DataFrame, expected: int, unknown: Column) -> DataFrame:
    """A4: df, if it has `expected` rows and none is unknown; else the query stops and the earlier result stays."""
    got = df.agg(F.count("*").alias("_n"), F.count_if(unknown).alias("_u"))
    ok = got.select(F.assert_true((F.col("_n") == expected) & (F.col("_u") == 0), F.lit("incomplete: not published")).alias("_ok"))
    return df.join(ok, F.lit(True)).where("_ok is null").drop("_ok")


def load_address_set(df: DataFrame) -> DataFrame:
    """A5: every cell that holds an @, lower case and trimmed, once."""
    cells = df.select(F.explode(F.array(*[F.col(c).cast("string") for c in df.columns])).alias("cell"))
    return cells.select(F.lower(F.trim("cell")).alias("email")).where(F.contains("email", F.lit("@"))).distinct()


def import_addresses(cells: DataFrame, words: tuple[str, ...]) -> DataFrame:
    """A5: (email, suffix) of an import form given as cells (row_no, col_no, value): the addresses below the first header
    cell, from the top and then the left, that holds one of the words; without such a cell, those of the whole table.

    Addresses are lower case and trimmed, once each; suffix is what follows their @.
    """
    low = cells.select("row_no", "col_no", F.lower(F.trim("value")).alias("_v"))
    header = reduce(lambda a, b: a | b, [F.contains("_v", F.lit(w.lower())) for w in words]) & ~F.contains("_v", F.lit("@"))
    head = low.agg(F.min(F.when(header, F.struct("row_no", "col_no"))).alias("_h"))
    inside = F.col("_h").isNull() | ((F.col("col_no") == F.col("_h.col_no")) & (F.col("row_no") > F.col("_h.row_no")))
    found = low.where(F.contains("_v", F.lit("@"))).withColumn("_one", F.lit(1)).join(F.broadcast(head.withColumn("_one", F.lit(1))), "_one").where(inside)
    return found.select(F.col("_v").alias("email"), F.substring_index("_v", "@", -1).alias("suffix")).distinct()


def load_projects(df: DataFrame, name: str) -> DataFrame:
    """The distinct non-blank names; an empty table stops the query."""
    names = df.select(blank_to_null(F.col(name)).alias(name)).where(f"{name} is not null").distinct()
    some = names.agg(F.count("*").alias("_n")).select(F.assert_true(F.col("_n") > 0, F.lit("the project table is empty")).alias("_ok"))
    return names.join(some, F.lit(True)).where("_ok is null").drop("_ok")


def conform(df: DataFrame, aliases: dict[str, list[str]], standard: dict[str, str] | None = None) -> DataFrame:
    """One column per canonical name: the first non-blank of its aliases that the table has.

    A standard header goes before older internal keys, whatever its place. A blank never overwrites a value; a name
    none of whose aliases is there is null.
    """
    lower = {c.lower(): c for c in df.columns}
    out = []
    for name, listed in aliases.items():
        order = ([standard[name]] if standard and name in standard else []) + listed
        found = [blank_to_null(F.col(f"`{lower[a.lower()]}`").cast("string")) for a in order if a.lower() in lower]
        out.append((F.coalesce(*found) if found else F.lit(None).cast("string")).alias(name))
    return df.select(*out)


def split_stage1(df: DataFrame, queue: str) -> dict[str, DataFrame]:
    """The work, review and filtered lists; every row is in exactly one, null counts as review."""
    name = F.coalesce(F.col(queue), F.lit("review"))
    return {q: df.where(name == q) for q in ("work", "review", "filtered")}


def list_sizes(df: DataFrame, queue: str) -> DataFrame:
    """(list, n) of the three lists from one scan; an empty list has no row."""
    return df.groupBy(F.coalesce(F.col(queue), F.lit("review")).alias("list")).agg(F.count("*").alias("n")).where(F.col("list").isin("work", "review", "filtered"))


def write_stage1(df: DataFrame, queue: str, path: str, run_id: str) -> None:
    """One write, partitioned by queue, of this run's copy; then the store's current version points to it, so
    that readers of read_stage1() see the run before or this one."""
    store = Store(df.sparkSession, path)
    taken, version = store.begin()
    named = df.withColumn(queue, F.coalesce(F.col(queue), F.lit("review")))
    named.write.partitionBy(queue).mode("overwrite").parquet(f"{path}/run_id={run_id}")
    store.commit(taken, version.folders | {"stage1": [f"{path}/run_id={run_id}"]}, {"run_id": run_id})


def read_stage1(spark: SparkSession, path: str) -> DataFrame:
    """The current run's rows."""
    store = Store(spark, path)
    return store.read(store.head(), "stage1")


def archive_run(spark: SparkSession, path: str, archive: str, low: str, high: str, run_id: str) -> DataFrame:
    """Copies a run into the archive of its range and appends the manifest row, which is returned."""
    rows = spark.read.parquet(f"{path}/run_id={run_id}")
    rows.write.mode("overwrite").parquet(f"{archive}/runs/{run_id}")
    manifest = spark.read.parquet(f"{archive}/runs/{run_id}").groupBy("queue").count().agg(F.map_from_entries(F.collect_list(F.struct("queue", "count"))).alias("counts"))
    manifest = manifest.select(F.lit(run_id).alias("run_id"), F.lit(low).cast("date").alias("low"), F.lit(high).cast("date").alias("high"), "counts")
    manifest.write.mode("append").parquet(f"{archive}/manifest")
    return manifest


def list_archives(manifest: DataFrame) -> DataFrame:
    """Newest range first, only runs that have a work or review part."""
    has = lambda q: F.coalesce(F.col("counts")[q], F.lit(0)) > 0
    return manifest.where(has("work") | has("review")).orderBy(F.col("high").desc(), F.col("low").desc(), F.col("run_id").desc())


def modified_fields(changes: DataFrame, key: list[str], before: str = "before", after: str = "after") -> DataFrame:
    """One row a changed field: (key, field, before, after), from maps of a row's old and new values. A field that
    one of the maps lacks is null there; equal values, and blanks for null, are no change."""
    names = F.array_union(F.coalesce(F.map_keys(before), F.expr("cast(array() as array<string>)")), F.coalesce(F.map_keys(after), F.expr("cast(array() as array<string>)")))
    each = changes.select(*key, F.explode(names).alias("field"), F.col(before).alias("_b"), F.col(after).alias("_a"))
    rows = each.select(*key, "field", F.try_element_at("_b", F.col("field")).alias("before"), F.try_element_at("_a", F.col("field")).alias("after"))
    return rows.where(~blank_to_null(F.col("before")).eqNullSafe(blank_to_null(F.col("after"))))


def export_reviewed(details: DataFrame, operations: DataFrame, deleted: DataFrame, changes: DataFrame, added: DataFrame, day: str, low: Column, high: Column) -> dict[str, DataFrame]:
    """Five tables cut to a range of mail days: confirmed details, operations, deleted, modified and added.

    changes has the day, record_id and the maps before and after; modified has one row for each changed field.
    """
    cut = lambda df: df.where(F.col(day).between(low, high))
    return {"confirmed": cut(details).where("status = 'confirmed'"), "operations": cut(operations), "deleted": cut(deleted), "modified": modified_fields(cut(changes), [day, "record_id"]), "added": cut(added)}


def check_import(df: DataFrame, needed: list[str]) -> tuple[list[str], bool]:
    """(absent columns, whether a row has all needed values)."""
    absent = [c for c in needed if c not in df.columns]
    usable = not absent and bool(df.where(reduce(lambda a, b: a & b, [blank_to_null(F.col(c).cast("string")).isNotNull() for c in needed])).limit(1).count())
    return absent, usable


#: The columns of each report, as (name, source column).
REPORTS = {
    "work": (("mail_key", "mail_key"), ("subject", "subject")),
    "review": (("mail_key", "mail_key"), ("subject", "subject"), ("reason", "reason"), ("hint", "hint")),
    "filtered": (("mail_key", "mail_key"), ("subject", "subject"), ("body", "body"), ("names", "names"), ("reason", "reason")),
    "stage": (("mail_key", "mail_key"), ("company", "company"), ("project", "project"), ("found", "found"), ("order_no", "order_no"), ("match_status", "match_status"), ("lookup", "state"), ("note", "reason")),
    "result": (("mail_key", "mail_key"), ("company", "company"), ("project", "project"), ("found", "found"), ("order_no", "order_no")),
}


def project_report(df: DataFrame, kind: str) -> DataFrame:
    """The columns of a report: filtered lists cut the body at 300 letters and join the attachment names; the stage
    view shows rows before a lookup in the outcome's columns, with what they don't have yet as blanks; the result list is
    plain. Columns that the table lacks are blank."""
    shown = {"body": lambda c: F.substring(c, 1, 300), "names": lambda c: F.array_join(c, ", ")}
    there = lambda c: F.col(c) if c in df.columns else F.lit("")
    blank = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    columns = REPORTS[kind]
    if kind in ("stage", "result"):
        return df.select(*[(there(source) if name == "mail_key" else blank(there(source))).alias(name) for name, source in columns])
    return df.select(*[shown.get(name, lambda c: c)(there(source)).alias(name) for name, source in columns])
