"""Ordered text segments: lines and items with a place, carried forward by windows."""

from __future__ import annotations

from collections.abc import Callable

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tallyspark.functions.text import trimmed


def split_items(df: DataFrame, items: str, keep: Column | None = None) -> DataFrame:
    """one row per item with split_no `i/n`; rows with one item or none stay whole, without a split_no.

    keep tells which items count, as a function of the array column already applied; fillers are gone before
    numbering.
    """
    work = df.withColumn(items, keep) if keep is not None else df
    n = F.size(items)
    each = work.withColumn("_n", F.greatest(n, F.lit(0))).select("*", F.posexplode_outer(items).alias("_i", "item"))
    return each.withColumn("split_no", F.when(F.col("_n") > 1, F.concat_ws("/", F.col("_i") + 1, F.col("_n")))).drop("_i", "_n", items)


def lines(df: DataFrame, key: list[str], text: str) -> DataFrame:
    """(key, line_no, line) of the non-blank lines, trimmed; the number is the line's place in the text."""
    return df.select(*key, F.posexplode(F.transform(F.split(text, "\n"), trimmed)).alias("line_no", "line")).where("line != ''")


def carried(value: Column, per: list[str], order: str) -> Column:
    """The last non-null value so far."""
    return F.last(value, ignorenulls=True).over(W.partitionBy(*per).orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow))


def group_segments(segments: DataFrame, mail: str, order: str, company: Column, country: Column, service: Column) -> DataFrame:
    """(mail, order, company, country, service): a company opens a record, services attach to the open company,
    and a segment without a country takes over the last one since its company opened. Segments before any company
    or without a service make no row.
    """
    work = segments.select(mail, order, company.alias("_company"), country.alias("_country"), service.alias("service"))
    work = work.withColumn("record_no", F.count("_company").over(W.partitionBy(mail).orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow)))
    work = work.withColumn("company", carried(F.col("_company"), [mail], order)).withColumn("country", carried(F.col("_country"), [mail, "record_no"], order))
    return work.where(F.col("service").isNotNull() & F.col("company").isNotNull()).select(mail, order, "record_no", "company", "country", "service")


def map_chunks(chunks: DataFrame, mail: str, chunk: str, company: str, project: str) -> DataFrame:
    """(mail, company, project, flagged): pairs inside a chunk; if a company or project of the mail is left
    without a partner, all pairs of the mail instead, flagged for review.

    The product is of one mail's companies and projects only, by joins on the mail.
    """
    c = chunks.where(F.col(company).isNotNull()).select(mail, chunk, company).distinct()
    p = chunks.where(F.col(project).isNotNull()).select(mail, chunk, project).distinct()
    inside = c.join(p, [mail, chunk]).select(mail, company, project).distinct()
    lone_c = c.select(mail, company).distinct().join(inside, [mail, company], "left_anti").select(mail)
    lone_p = p.select(mail, project).distinct().join(inside, [mail, project], "left_anti").select(mail)
    unclear = lone_c.union(lone_p).distinct()
    clear = inside.join(unclear, mail, "left_anti").withColumn("flagged", F.lit(False))
    product = c.select(mail, company).distinct().join(unclear, mail, "left_semi").join(p.select(mail, project).distinct(), mail)
    return clear.unionByName(product.withColumn("flagged", F.lit(True)))


def numbered_list(rows: DataFrame, key: list[str], pattern: str, stated: str | None = None, projects: DataFrame | None = None) -> DataFrame:
    """the lines that begin with a number or code, if there are two or more; flagged if a stated count differs.

    With projects, rows (key, project) of the subjects, only texts whose subject has exactly one project make rows, and
    each row has that project.
    """
    marked = rows.where(F.col("line").rlike(pattern))
    n = F.count("*").over(W.partitionBy(*key))
    out = marked.withColumn("n_lines", n).where("n_lines >= 2")
    flag = (F.col(stated) != F.col("n_lines")) if stated else F.lit(False)
    out = out.withColumn("flagged", F.coalesce(flag, F.lit(False)))
    if projects is None:
        return out
    one = projects.where("project is not null").groupBy(*key).agg(F.min("project").alias("project"), F.max("project").alias("_last")).where("project = _last").drop("_last")
    return out.join(one, key)


def scope_lines(rows: DataFrame, key: list[str], order: str, mine: Column, other: Column, label: Column) -> DataFrame:
    """a line that names the company opens a block, label lines inside stay, another company's line closes it."""
    mark = F.when(mine, True).when(other, False)
    work = rows.withColumn("_open", F.coalesce(carried(mark, key, order), F.lit(False))).withColumn("_keep", mine | (F.col("_open") & label & ~other))
    return work.where("_keep").drop("_open", "_keep")


def header_blocks(rows: DataFrame, key: list[str], order: str, header: Column) -> DataFrame:
    """F8: (key, block, place, label, value): a run of two or more header lines, then as many value lines.

    Runs are islands of equal kind in the order of the lines; the nth label takes the nth value.
    """
    per = W.partitionBy(*key).orderBy(order)
    work = rows.withColumn("_h", header).withColumn("_n", F.row_number().over(per))
    work = work.withColumn("_island", F.col("_n") - F.row_number().over(W.partitionBy(*key, "_h").orderBy(order)))
    runs = W.partitionBy(*key, "_h", "_island")
    work = work.withColumn("place", F.row_number().over(runs.orderBy(order))).withColumn("_size", F.count("*").over(runs)).withColumn("_start", F.min("_n").over(runs))
    labels = work.where("_h and _size >= 2").select(*key, "place", F.col("line").alias("label"), F.col("_size").alias("_hs"), (F.col("_start") + F.col("_size")).alias("_start"), F.col("_start").alias("block"))
    values = work.where("not _h").select(*key, "place", F.col("line").alias("value"), "_size", "_start")
    return labels.join(values, [*key, "place", "_start"]).where("_size >= _hs").select(*key, "block", "place", "label", "value")


def header_lines(rows: DataFrame, key: list[str], order: str, header: Column, least: int = 2) -> DataFrame:
    """F8, its other form: (key, block, place, label, value): a line of cells between tabs, bars or wide gaps of which
    `least` are headers, and the next line's cells, if they are as many and no header is among them.

    header is a Column over `cell`. block is the number of the header line among the text's lines.
    """
    cells = F.filter(F.transform(F.split("line", r"\t+|\s*\|\s*|\s{2,}"), trimmed), lambda x: x != "")
    per = W.partitionBy(*key).orderBy(order)
    work = rows.withColumn("_cells", cells).withColumn("block", F.row_number().over(per))
    heads = work.select(*key, "block", F.posexplode("_cells").alias("place", "cell")).withColumn("_h", header.cast("int"))
    count = heads.groupBy(*key, "block").agg(F.sum("_h").alias("_heads"))
    work = work.join(count, [*key, "block"], "left").withColumn("_heads", F.coalesce("_heads", F.lit(0)))
    after = {"_next": F.lead("_cells").over(W.partitionBy(*key).orderBy("block")), "_next_heads": F.lead("_heads").over(W.partitionBy(*key).orderBy("block"))}
    good = work.withColumns(after).where((F.col("_heads") >= least) & (F.size("_cells") == F.size("_next")) & (F.col("_next_heads") == 0))
    return good.select(*key, "block", F.posexplode(F.arrays_zip(F.col("_cells").alias("label"), F.col("_next").alias("value"))).alias("place", "_z")).select(*key, "block", F.col("place") + 1, "_z.label", "_z.value").toDF(*key, "block", "place", "label", "value")


def table_rows(lines: DataFrame, key: list[str], order: str, header: Callable[[Column], Column], least: int = 2) -> DataFrame:
    """F8 for tables of several lines: (key, header_no, line_no, place, label, value): each line below a header line with
    as many cells, down to the first line that has another number of them or is a header itself.

    A line's cells stand between tabs, bars or wide gaps, and empty ones between tabs or bars count. header is a
    function of a cell's Column; a line with `least` headers is one. line_no counts a text's lines from 1.
    """
    cells = F.transform(F.split(F.regexp_replace("line", r"^\s*\|\s*|\s*\|\s*$", ""), r"\t|\s*\|\s*|\s{2,}"), trimmed)
    named = lambda c: F.size(F.filter(c, lambda x: F.coalesce(header(x), F.lit(False))))
    per = W.partitionBy(*key).orderBy(order)
    work = lines.withColumns({"_cells": cells, "line_no": F.row_number().over(per)}).withColumn("_head", named("_cells") >= least)
    head = F.last(F.when(F.col("_head"), F.struct(F.col("line_no").alias("no"), F.col("_cells").alias("labels"))), True).over(per.rowsBetween(W.unboundedPreceding, W.currentRow))
    work = work.withColumn("_h", head).where("_h is not null").withColumn("_other", ~F.col("_head") & (F.size("_cells") != F.size("_h.labels")))
    broken = F.bool_or("_other").over(W.partitionBy(*key, "_h.no").orderBy("line_no").rowsBetween(W.unboundedPreceding, W.currentRow))
    good = work.withColumn("_broken", broken).where(~F.col("_head") & ~F.col("_broken"))
    pairs = F.posexplode(F.arrays_zip(F.col("_h.labels").alias("label"), F.col("_cells").alias("value"))).alias("place", "_z")
    return good.select(*key, F.col("_h.no").alias("header_no"), "line_no", pairs).select(*key, "header_no", "line_no", (F.col("place") + 1).alias("place"), "_z.label", "_z.value")


def zip_by_position(brands: Column, categories: Column) -> Column:
    """brand i with category i; the longer list's rest has null partners."""
    return F.transform(F.arrays_zip(brands.alias("brand"), categories.alias("category")), lambda x: F.struct(x["brand"].alias("brand"), x["category"].alias("category")))


def fit_budget(rows: DataFrame, owner: list[str], group: str, size: Column, priority: Column, order: str, budget: int) -> DataFrame:
    """the rows of each owner that fit its budget when every group gives the same number of rows.

    In each group, rows referenced by evidence (priority) come first. Rows of the same place in their groups enter
    together, so the largest equal count is where the running size still fits: one window, no search.
    """
    place = F.row_number().over(W.partitionBy(*owner, group).orderBy(priority.desc(), order))
    work = rows.withColumn("_size", size).withColumn("place", place)
    total = F.sum("_size").over(W.partitionBy(*owner).orderBy("place").rangeBetween(W.unboundedPreceding, W.currentRow))
    return work.withColumn("_total", total).where(F.col("_total") <= budget).drop("_size", "_total")
