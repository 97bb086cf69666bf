"""Exact dedup in three combining steps, each of which compares the whole content."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import BLANKS, cut

#: The most repeated texts' digests that are sent to every task instead of shuffling all texts by them.
SENT = 500_000


def normalised(text: Column) -> Column:
    """Each run of blanks becomes one space; null is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), f"[{BLANKS}]+", " ")


def exact_groups(docs: DataFrame, salts: int = 16, digest=lambda text: F.sha2(text, 256)) -> DataFrame:
    """One row (digest, mark, keep_id, group_size) for each different normalised text.

    Step 1, local: the map side of the salted grouping keeps one row for each text in its task. Step 2, salted:
    rows of a digest meet in `salts` tasks, whose number comes from the map task, so a group that holds a third
    of all rows sends one row from each map task. Step 3, global: the salts' winners of a digest meet, at most
    `salts` rows of one text. In each step the text itself is part of the grouping key, so texts that only share
    a digest stay apart; mark, a second fingerprint, tells them apart in the result. Two different texts that
    share both stop the query instead of giving a wrong answer.
    """
    texts = docs.select("doc_id", normalised(F.col("text")).alias("norm"))
    rows = texts.select(digest(F.col("norm")).alias("digest"), "norm", "doc_id", F.pmod(F.spark_partition_id(), F.lit(salts)).alias("salt"))
    salted = rows.groupBy("digest", "salt", "norm").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("n"))
    whole = salted.repartition("digest").groupBy("digest", "norm").agg(F.min("keep_id").alias("keep_id"), F.sum("n").alias("n"))
    named = whole.select("digest", mark(F.col("norm")).alias("mark"), "keep_id", "n")
    one = named.groupBy("digest", "mark").agg(F.min("keep_id").alias("keep_id"), F.sum("n").alias("group_size"), F.count("*").alias("texts"))
    sure = F.when(F.col("texts") > 1, F.raise_error(F.lit("two texts share a digest and a mark"))).otherwise(F.col("group_size"))
    return one.select("digest", "mark", "keep_id", sure.cast("long").alias("group_size"))


def mark(norm: Column) -> Column:
    return F.struct(F.xxhash64(norm).alias("x"), F.crc32(norm).alias("c"), F.length(norm).alias("n"))


def repeated(docs: DataFrame, slim: DataFrame, sent: int = SENT) -> DataFrame:
    """The rows of docs whose normalised text's digest occurs twice or more, in slim, which has (doc_id, tid, digest).

    They are found by tid, the digest of the raw text, which needs no normalising; a row more, of equal tid, does no
    harm. Up to `sent` tids of 8 bytes are broadcast, so that other texts stay where they are; more are joined.
    """
    each = slim.groupBy("digest", "tid").agg(F.count("*").alias("n"))
    twice = each.groupBy("digest").agg(F.sum("n").alias("rows")).where("rows > 1").select("digest")
    tids = cut(each.join(twice, "digest", "left_semi").select("tid").distinct())
    few = tids.limit(sent + 1).count() <= sent
    return docs.withColumn("tid", F.xxhash64("text")).join(F.broadcast(tids) if few else tids, "tid", "left_semi")


def exact_dedup(docs: DataFrame, salts: int = 16, digest=lambda text: F.sha2(text, 256)) -> DataFrame:
    """Which row of each group of equal texts stays: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are identical after each run of blanks became one space; null counts as empty.
    The smallest doc_id stays (null before all others only if the group has no other). Every row of docs has its
    row, repeated rows too: of two rows with the doc_id that stays, both say kept. Long texts are compared whole.
    Other columns are left out. An empty table gives an empty result. Only built-in functions are used.

    Digests are counted first: a text whose digest occurs once equals no other, so only the rest go through the three
    steps of exact_groups(), which compare whole contents.
    """
    texts = docs.select("doc_id", F.xxhash64("text").alias("tid"), normalised(F.col("text")).alias("norm"))
    slim = cut(texts.select("doc_id", "tid", digest(F.col("norm")).alias("digest"), mark(F.col("norm")).alias("mark"), F.sha2("norm", 256).alias("text_sha256")))
    groups = cut(exact_groups(repeated(docs.select("doc_id", "text"), slim), salts, digest))
    out = slim.join(groups, ["digest", "mark"], "left")
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return out.select("doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), F.col("doc_id").eqNullSafe(keep).alias("kept"), "text_sha256")
