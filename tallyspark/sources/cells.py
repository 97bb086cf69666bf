"""Table attachments as long cells: rows (file, sheet, row_no, col_no, value)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tallyspark.functions.text import blank_to_null, identity_key, trimmed

from .shared import dealt, small, tasks_of

SHEET = ["file", "sheet"]


def sectioned_records(cells: DataFrame, roles: DataFrame, needed: tuple[tuple[str, ...], ...], skip: str = r"(?i)^(?:total|sum|note)") -> DataFrame:
    """(file, sheet, row_no, role, value): the records below each header row.

    roles has (label, role), the label as an identity key. A row is a header when its roles hold one of the
    combinations `needed`; it governs the rows up to the next header. Rows with a value that matches `skip` are no
    records. Where two columns of a header have one role, the left one with a value counts.
    """
    named = cells.withColumn("_key", identity_key(F.col("value"))).join(roles.select(F.col("label").alias("_key"), "role"), "_key", "left")
    rows = named.groupBy(*SHEET, "row_no").agg(F.collect_set("role").alias("_roles"), F.bool_or(F.col("value").rlike(skip)).alias("_skip"))
    test = F.lit(False)
    for combination in needed:
        test = test | (F.size(F.array_except(F.array(*[F.lit(r) for r in combination]), "_roles")) == 0)
    rows = rows.withColumn("_header", test)
    order = W.partitionBy(*SHEET).orderBy("row_no").rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = rows.withColumn("_at", F.last(F.when(F.col("_header"), F.col("row_no")), ignorenulls=True).over(order))
    body = rows.where("not _header and not _skip and _at is not null").select(*SHEET, "row_no", "_at")
    heads = named.where("role is not null").select(*SHEET, F.col("row_no").alias("_at"), "col_no", "role")
    values = cells.where(blank_to_null(F.col("value")).isNotNull()).join(body, [*SHEET, "row_no"]).join(heads, [*SHEET, "_at", "col_no"])
    return values.groupBy(*SHEET, "row_no", "role").agg(F.min_by("value", "col_no").alias("value"))


def preferred_columns(headers: DataFrame, rank: DataFrame) -> DataFrame:
    """A10: one column per (sheet, role): the best by the label's rank, then the left one. rank has (label, rank)."""
    ranked = headers.join(small(rank), "label", "left").withColumn("_r", F.coalesce("rank", F.lit(1_000_000)))
    return dealt(ranked, *SHEET, "role").groupBy(*SHEET, "role").agg(F.min(F.struct("_r", "col_no")).alias("_b")).select(*SHEET, "role", "_b.col_no")


def label_values(cells: DataFrame, labels: DataFrame, right: int = 6, down: int = 2) -> DataFrame:
    """(file, sheet, row_no, field, value) behind labels: in the cell after a colon, else the next non-blank
    cell to the right that is no label, else the first non-blank one below; one per field and value.

    labels has (label, field), the label as an identity key. Cells travel once, to the task of their sheet, where the
    nearest cells are found by windows over its rows and columns; a cell without a place has no neighbours.
    """
    text = cells.where(trimmed(F.col("value")) != "").select(*SHEET, "row_no", "col_no", F.trim("value").alias("value"))
    # Most cells have no letters beyond ASCII, so that no wide form has to be sought in them.
    key = lambda c: F.when(F.octet_length(c) == F.length(c), identity_key(F.col(c), wide=False)).otherwise(identity_key(F.col(c)))
    known = small(labels.select(F.col("label").alias("_key"), "field"))
    named = text.withColumn("_head", F.substring_index(F.replace("value", F.lit("："), F.lit(":")), ":", 1)).withColumn("_key", key("_head")).join(known, "_key", "left")
    # A label's own text goes no further, only what stands behind its colon, blank if there is nothing.
    inline = F.when(F.col("value").rlike("[:：]"), F.trim(F.regexp_extract("value", r"^[^:：]*[:：](.*)$", 1)))
    named = named.select(*SHEET, "row_no", "col_no", F.when(F.col("field").isNull(), F.col("value")).otherwise(inline).alias("value"), "field")
    placed = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in (*SHEET, "row_no", "col_no")])

    def nearest(line: str, order: str, reach: int) -> Column:
        """The value of the next cell in the line, if no label is in its place; the ones behind it don't count."""
        order_by = W.partitionBy("_at", *SHEET, line).orderBy(order).rangeBetween(1, reach)
        first = F.min(F.struct(F.col(order), F.col("field").isNull().alias("plain"), "value")).over(order_by)
        return F.when(placed & first["plain"], first["value"])

    # Dealt by a digest: a constant file or sheet is taken out of the windows' keys, which then don't fit a deal by them.
    found = dealt(named.withColumn("_at", F.xxhash64(*SHEET)), "_at", tasks=tasks_of(cells)).withColumns({"_right": nearest("row_no", "col_no", right), "_below": nearest("col_no", "row_no", down)})
    both = found.where("field is not null").select("_at", *SHEET, "field", "row_no", F.coalesce(F.nullif("value", F.lit("")), "_right", "_below").alias("value")).where("value is not null")
    return both.withColumn("_k", key("value")).groupBy("_at", *SHEET, "field", "_k").agg(F.min(F.struct("row_no", "value")).alias("_b")).select(*SHEET, "_b.row_no", "field", "_b.value")


def name_columns(cells: DataFrame, header_row: int) -> DataFrame:
    """(file, sheet, col_no, name): blank headers are col_i, the nth repetition is name#n, and columns blank in
    header and values go."""
    heads = cells.where(F.col("row_no") == header_row).select(*SHEET, "col_no", blank_to_null(F.col("value")).alias("_h"))
    used = cells.where(F.col("row_no") > header_row).groupBy(*SHEET, "col_no").agg(F.bool_or(blank_to_null(F.col("value")).isNotNull()).alias("_used"))
    both = heads.join(used, [*SHEET, "col_no"], "full").where("_h is not null or _used")
    place = F.row_number().over(W.partitionBy(*SHEET, "_h").orderBy("col_no"))
    name = F.when(F.col("_h").isNull(), F.concat(F.lit("col_"), "col_no")).when(place == 1, F.col("_h")).otherwise(F.concat("_h", F.lit("#"), place))
    return both.select(*SHEET, "col_no", name.alias("name"))


def checked_pairs(marks: DataFrame) -> DataFrame:
    """(form, row_no, country, service, outcome) of checked marks: pair, unmatched (country only) or orphan."""
    on = marks.where("checked").select("form", "row_no", "kind", "label").distinct()
    c = on.where("kind = 'country'").select("form", "row_no", F.col("label").alias("country"))
    s = on.where("kind = 'service'").select("form", "row_no", F.col("label").alias("service"))
    outcome = F.when(F.col("service").isNull(), "unmatched").when(F.col("country").isNull(), "orphan").otherwise("pair")
    return c.join(s, ["form", "row_no"], "full").withColumn("outcome", outcome)
