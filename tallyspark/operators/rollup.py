"""Roll-ups (SURVEY E) and ordering (G): one grouping or window each, partial sums on the map side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .numbering import numbered


def outcome_class(found: Column, match: Column, lookup: Column, special: Column, items: Column) -> Column:
    """E1's ordered cases: special items first, then found, then definite misses, else pending."""
    miss = F.contains(F.coalesce(match, F.lit("")), F.lit("missing")) | ((found == "no") & ~F.coalesce(lookup, F.lit("")).rlike("failed|skipped|waiting"))
    return F.when(special & items.isin("missing"), "missing").when(special & items.isin("pending"), "pending").when(found == "yes", "found").when(miss, "missing").otherwise("pending")


def outcome_summary(df: DataFrame, key: list[str], kind: Column, checked: str) -> DataFrame:
    """Per key the counts found, missing, pending and total, the sorted distinct labels and the last check."""
    rows = df.withColumn("_kind", kind)
    n = lambda name: F.count_if(F.col("_kind") == name).alias(name)
    return rows.groupBy(*key).agg(n("found"), n("missing"), n("pending"), F.count("*").alias("total"), F.array_join(F.array_sort(F.collect_set("_kind")), ",").alias("labels"), F.max(checked).alias("last_check"))


def mail_status(df: DataFrame, key: str, status: str, ready: Column, company: str, project: str) -> DataFrame:
    """Partial if some details are ready, confirmed if all are, else review > returned > needs_info > ready."""
    rows = df.withColumn("_ready", ready)
    has = lambda s: F.bool_or(F.col(status) == s)
    value = F.when(F.bool_and("_ready"), "confirmed").when(F.bool_or("_ready"), "partial").when(has("review"), "review").when(has("returned"), "returned").when(has("needs_info"), "needs_info").otherwise("ready")
    filled = lambda c: F.count_distinct(F.nullif(F.trim(F.col(c)), F.lit("")))
    return rows.groupBy(key).agg(value.alias("mail_status"), F.count_if("_ready").alias("n_ready"), filled(company).alias("n_companies"), filled(project).alias("n_projects"), F.count("*").alias("n_details"))


def queue_counts(mails: DataFrame, excluded: DataFrame, status: str, scope: str) -> DataFrame:
    """One row of counts by status; exclusions that only concern a project are no mails of their own."""
    n = lambda s: F.count_if(F.col(status) == s).alias(f"n_{s}")
    active = mails.agg(F.count("*").alias("active"), n("valid"), n("uncertain"), n("filtered"))
    gone = excluded.agg(F.count_if(F.coalesce(F.col(scope), F.lit("")) == "").alias("whole_exclusions"), F.count_if(F.col(scope) == "project").alias("project_exclusions"))
    return active.withColumn("_one", F.lit(1)).join(gone.withColumn("_one", F.lit(1)), "_one").drop("_one").withColumn("total", F.col("active") + F.col("whole_exclusions"))


def ledger_summary(records: DataFrame, operations: DataFrame, names: DataFrame, dataset: str, day: str) -> DataFrame:
    """Rows per dataset, zero ones too, with the number of operations and the last day of any."""
    counted = records.groupBy(dataset).agg(F.count("*").alias("n"))
    log = operations.agg(F.count("*").alias("n_operations"), F.max(day).alias("last_day")).withColumn("_one", F.lit(1))
    out = names.join(counted, dataset, "left").withColumn("_one", F.lit(1)).join(log, "_one")
    return out.select(dataset, F.coalesce("n", F.lit(0)).alias("n"), "n_operations", "last_day")


def consensus(candidates: DataFrame, key: str, value: str, source: str, priority: str, least: int = 2) -> DataFrame:
    """E5: the best value of each key by (distinct sources, source priority, mentions, length, value); accepted
    only with `least` sources."""
    each = candidates.groupBy(key, value).agg(F.count_distinct(source).alias("n_sources"), F.max(priority).alias("best_priority"), F.count("*").alias("mentions"))
    rank = F.struct("n_sources", "best_priority", "mentions", F.length(value).alias("size"), F.col(value).alias("value"))
    best = each.groupBy(key).agg(F.max(rank).alias("b"))
    return best.select(key, F.col("b.value").alias(value), "b.n_sources", "b.mentions", (F.col("b.n_sources") >= least).alias("accepted"))


def count_check(df: DataFrame, key: str, expected: str) -> DataFrame:
    """Per key the expected number (the greatest stated), the actual one, and whether all statements agree with it."""
    out = df.groupBy(key).agg(F.max(expected).alias("n_expected"), F.min(expected).alias("_least"), F.count("*").alias("n_actual"))
    ok = (F.col("_least") == F.col("n_expected")) & (F.col("n_expected") == F.col("n_actual"))
    return out.withColumn("agrees", F.coalesce(ok, F.lit(False))).drop("_least")


def drop_placeholders(df: DataFrame, key: list[str], company: str, valid: Column) -> DataFrame:
    """Where a key has exactly one distinct valid company, its rows with an invalid one go."""
    per = W.partitionBy(*key)
    work = df.withColumn("_valid", valid)
    one = F.min(F.when(F.col("_valid"), F.col(company))).over(per) == F.max(F.when(F.col("_valid"), F.col(company))).over(per)
    return work.withColumn("_one", F.coalesce(one, F.lit(False))).where("_valid or not _one").drop("_valid", "_one")


def prune_umbrella(df: DataFrame, mail: str, country: str, umbrella: Column) -> DataFrame:
    """An umbrella row goes if its mail has a specific one of its country, else it is flagged."""
    work = df.withColumn("_umbrella", umbrella)
    specific = F.max((~F.col("_umbrella")).cast("int")).over(W.partitionBy(mail, country)) == 1
    return work.withColumn("_specific", specific).where("not (_umbrella and _specific)").withColumn("flagged", F.col("_umbrella")).drop("_umbrella", "_specific")


def history_projection(df: DataFrame, key: str, order: str, fields: list[str], checked: Column, sign: str = "、") -> DataFrame:
    """Per key the distinct values of each field in order, joined, and done if every row is checked."""
    work = df.withColumn("_checked", checked)
    rows = work.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, *fields))).alias("_rows"), F.bool_and("_checked").alias("_all"))
    values = {f: F.col("_rows").getField(f).cast("array<string>") for f in fields}
    joined = [F.array_join(F.array_distinct(F.filter(v, lambda x: x.isNotNull() & (x != ""))), sign).alias(f) for f, v in values.items()]
    return rows.select(key, *joined, F.when(F.col("_all"), "done").otherwise("open").alias("status"))


def batch_outcome(df: DataFrame, state: str) -> DataFrame:
    """Counts of a batch and its message, blank if all is done."""
    n = lambda s: F.count_if(F.col(state) == s).alias(f"n_{s}")
    out = df.agg(n("done"), n("unresolved"), n("blocked"), n("duplicate"))
    parts = F.array_compact(F.array(*[F.when(F.col(f"n_{s}") > 0, F.concat(F.col(f"n_{s}").cast("string"), F.lit(f" {s}"))) for s in ("unresolved", "blocked", "duplicate")]))
    return out.withColumn("message", F.array_join(parts, ", "))


def route_for_review(df: DataFrame, mail: str, reasons: dict[str, Column]) -> DataFrame:
    """Adds review_reasons, the names of the reasons that hold; a mail with several rows is one of them."""
    many = F.count("*").over(W.partitionBy(mail)) > 1
    tests = [F.when(F.col("_many"), F.lit("multi_row")), *[F.when(test, F.lit(name)) for name, test in reasons.items()]]
    return df.withColumn("_many", many).withColumn("review_reasons", F.array_compact(F.array(*tests))).drop("_many")


def review_reason_counts(df: DataFrame) -> DataFrame:
    """Rows (reason, n)."""
    return df.select(F.explode("review_reasons").alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


def merge_items(df: DataFrame, key: list[str], brand: str, category: str, source: str, seq: str) -> DataFrame:
    """Per key the first brand, the longest category, the distinct sources sorted and the number of mentions."""
    return df.groupBy(*key).agg(
        F.min_by(brand, seq).alias("brand"),
        F.max(F.struct(F.length(category), F.col(category).alias("c")))["c"].alias("category"),
        F.array_join(F.array_sort(F.collect_set(source)), ",").alias("sources"),
        F.count("*").alias("mentions"),
    )


def coverage_gap(declared: Column, emitted: Column) -> Column:
    """What was declared and not emitted, in order."""
    return F.array_except(declared, emitted)


def mapping_covers(proposed: Column, needed: Column) -> Column:
    """The proposal holds everything that is needed."""
    return F.size(F.array_except(needed, proposed)) == 0


def alias_index(df: DataFrame, official: str, aliases: Column, least: int = 2) -> DataFrame:
    """Rows (alias, officials): distinct sorted officials of each alias of `least` letters or more."""
    rows = df.select(F.col(official).alias("official"), F.explode(aliases).alias("alias")).withColumn("alias", F.lower(F.trim("alias")))
    return rows.where(F.length("alias") >= least).groupBy("alias").agg(F.array_sort(F.collect_set("official")).alias("officials"))


def newest_first(df: DataFrame, day: str, *ties: str | Column) -> DataFrame:
    """Newest first, undated last, then the ties; a total order, so the position can be stated."""
    return numbered(df, [F.col(day).desc_nulls_last(), *[F.col(t) if isinstance(t, str) else t for t in ties]], "position")


def missing_list(df: DataFrame, status: str, day: str, *ties: str | Column) -> DataFrame:
    """The definite misses, newest first, undated last, with their position."""
    return newest_first(df.where(F.col(status) == "missing"), day, *ties)


def top_per_key(df: DataFrame, key: list[str], order: list[Column], k: int = 1) -> DataFrame:
    """The first k rows of each key in the order, numbered."""
    return df.withColumn("place", F.row_number().over(W.partitionBy(*key).orderBy(*order))).where(F.col("place") <= k)


def within_cap(df: DataFrame, most: int) -> DataFrame:
    """The rows of a batch; more than `most` stop the query."""
    count = df.agg(F.count("*").alias("_n")).select(F.assert_true(F.col("_n") <= most, F.lit(f"a batch holds at most {most} rows")).alias("_ok"))
    return df.join(count.withColumn("_one", F.lit(1)), F.lit(1) == F.col("_one")).where("_ok is null").drop("_ok", "_one")
