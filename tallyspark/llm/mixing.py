"""Mixing sources to target weights by weighted sampling without replacement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tallyspark.operators.numbering import numbered, running

from .common import BLANKS, cut

#: The weights that sources take in turn, and the share of all words that the mix holds.
WEIGHTS = (3, 1, 2)
SHARE, MOST = 1.5, 2.0
#: Buckets of the sampling order within a source; each is sorted by itself.
BUCKETS = 2048


def words_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{BLANKS}]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """From rows (source, source_size) to (source, number, source_size, target).

    Sources in code point order, null last, take the weights in turn and share `share` of all words by weight;
    none gets over `most` times its size, and what is over goes to the others by weight. That end state has one
    level: each target is min(most x size, level x weight). With sources ordered by the level at which they fill
    up, the level follows from two running sums. Both orders are cut into ranges, so sources may be many.
    """
    ordered = numbered(sizes, [F.col("source").asc_nulls_last()], "number").withColumn("number", F.col("number") - 1)
    weight = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("number") % len(weights) + 1).cast("int"))
    caps = cut(ordered.withColumn("weight", weight).withColumn("cap", F.lit(most) * F.col("source_size")))
    words, weighed = caps.agg(F.sum("source_size"), F.sum("weight")).head()
    if not words:
        return caps.select("source", "number", "source_size", F.lit(0.0).alias("target"))
    filled = running(caps, [F.col("cap") / F.col("weight"), F.col("number")], {"cap_before": F.col("cap"), "weight_before": F.col("weight")})
    level = (F.lit(share * words) - F.col("cap_before")) / (F.lit(weighed) - F.col("weight_before"))
    first = filled.where(level <= F.col("cap") / F.col("weight")).agg(F.min(F.struct((F.col("cap") / F.col("weight")).alias("at"), "number", level.alias("level"))).alias("f")).head()
    found = first["f"]["level"] if first["f"] else 0.0
    return caps.select("source", "number", "source_size", F.least("cap", F.lit(found) * F.col("weight")).alias("target"))


def mix(docs: DataFrame, quality: DataFrame | None = None, seed: int = 7, buckets: int = BUCKETS, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """How often each document enters the mix: doc_id, source, size, source_size, target, taken, copies.

    quality has rows (doc_id, quality); the mean of a document's rows, q, gives the sampling weight 0.25 + q, and
    a document without one counts as q = 0.5. Each source gets floor(target / size) complete epochs first. What
    is left of the target is filled by Efraimidis-Spirakis sampling: documents in rising order of -ln(u) / weight,
    u from the digest of the seed and doc_id, as long as at least half of the document fits in what is left. So a
    source's taken words differ from its target by half a document at most, and no document is taken more than
    twice. Size counts runs of non-blanks; null or blank texts have size 0 and are taken for nothing. A null source
    is a source. Repeated rows are documents of their own; rows that agree in doc_id and size are alike, so it does
    not matter which of them is taken. Empty tables give an empty result.

    A source may hold a third of all rows: its order is cut into `buckets` ranges of the sampling key. Their word
    counts, summed on the map side, give each range its start, and each range is sorted by itself.
    """
    unit = (F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))), 1, 12), 16, 10).cast("double") + 0.5) / float(16**12)
    slim = docs.select("doc_id", "source", words_of(F.col("text")).alias("size"))
    if quality is not None:
        slim = slim.join(quality.where("doc_id is not null").groupBy("doc_id").agg(F.avg("quality").alias("q")), "doc_id", "left")
    else:
        slim = slim.withColumn("q", F.lit(None).cast("double"))
    slim = cut(slim.select("doc_id", "source", "size", (F.lit(0.25) + F.coalesce("q", F.lit(0.5))).alias("w"), unit.alias("u")))
    plan = targets(slim.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    plan = cut(plan.withColumn("epochs", epochs).withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size")))
    same = slim["source"].eqNullSafe(plan["source"])
    key = -F.log("u") / F.col("w")
    keyed = slim.join(plan, same).select("doc_id", slim["source"], "size", "number", "source_size", "target", "epochs", "rest", key.alias("key"))
    keyed = keyed.withColumn("bucket", F.floor(F.lit(buckets) * (1 - F.exp(-F.col("key")))).cast("int"))
    starts = keyed.groupBy("number", "bucket").agg(F.sum("size").alias("n"))
    starts = starts.select("number", "bucket", (F.sum("n").over(W.partitionBy("number").orderBy("bucket")) - F.col("n")).alias("start"))
    order = W.partitionBy("number", "bucket").orderBy("key", "doc_id", "size").rowsBetween(W.unboundedPreceding, W.currentRow)
    placed = keyed.withColumn("inside", F.sum("size").over(order) - F.col("size")).join(starts, ["number", "bucket"])
    fits = (F.col("start") + F.col("inside") + F.col("size") / 2 <= F.col("rest")) & (F.col("size") > 0)
    copies = F.col("epochs") + F.when(fits, 1).otherwise(0)
    return placed.select("doc_id", "source", "size", "source_size", "target", (copies * F.col("size")).alias("taken"), copies.alias("copies"))


def apply(docs: DataFrame, quality: DataFrame | None = None, **options) -> DataFrame:
    """The rows of docs, all columns, each as often as mix() takes a document of its doc_id, source and size.

    Repeated rows that agree in doc_id, source and size stand as often as mix() takes them all together.
    """
    plan = mix(docs, quality, **options).where("copies > 0").groupBy("doc_id", "source", "size").agg(F.sum("copies").alias("copies"))
    plan = plan.select(F.col("doc_id").alias("p_id"), F.col("source").alias("p_source"), F.col("size").alias("p_size"), F.col("copies").alias("p_copies"))
    rows = docs.select("doc_id", "source", words_of(F.col("text")).alias("size"), F.struct("*").alias("row"))
    number = F.row_number().over(W.partitionBy("doc_id", "source", "size").orderBy(F.xxhash64("row")))
    total = F.count("*").over(W.partitionBy("doc_id", "source", "size"))
    joined = rows.withColumn("no", number).withColumn("of", total).join(plan, F.col("doc_id").eqNullSafe(F.col("p_id")) & F.col("source").eqNullSafe(F.col("p_source")) & (F.col("size") == F.col("p_size")))
    share = F.floor(F.col("p_copies") / F.col("of")) + F.when(F.col("no") <= F.col("p_copies") % F.col("of"), 1).otherwise(0)
    return joined.withColumn("share", share.cast("int")).where("share > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("share")))).select("row.*")
