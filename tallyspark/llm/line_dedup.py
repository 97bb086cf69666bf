"""Line dedup by the number of distinct sites that carry a line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import BLANKS, cut, text_id

#: A line on this many sites is boilerplate; a line of fewer letters than SHORT needs TIMES as many.
MIN_SITES, SHORT, TIMES = 5, 20, 2
#: Shares that a line's rows are dealt to before they meet the table of lines.
SALTS = 16
#: Sketches have 2**LG_K registers; estimates within this part of the threshold are settled by an exact count.
LG_K, BAND = 10, 0.25


def plain(line: Column) -> Column:
    """A line with each run of blanks as one space and none at the ends; most lines need no pattern for that."""
    odd = F.contains(line, F.lit("  "))
    for blank in "\t\x0b\x0c\r":
        odd = odd | F.contains(line, F.lit(blank))
    return F.trim(F.when(odd, F.regexp_replace(line, f"[{BLANKS}]+", " ")).otherwise(line))


def lines_of(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, tid, line_no, line_hash, short, site) of the lines that are not blank; a null source is a site.

    tid is the text's digest, so the lines of two rows with one doc_id stay apart.
    """
    site = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("-"))
    lines = F.transform(F.split("text", "\n", -1), plain)
    whole = docs.where("text is not null").select("doc_id", text_id(F.col("text")).alias("tid"), site.alias("site"), "text")
    rows = whole.select("doc_id", "tid", "site", F.posexplode(lines).alias("line_no", "line"))
    return rows.where("line != ''").select("doc_id", "tid", "line_no", F.unhex(F.md5("line")).alias("line_hash"), (F.length("line") < SHORT).alias("short"), "site")


def meet(rows: DataFrame, lines: DataFrame, salts: int = SALTS) -> DataFrame:
    """The join of rows with a table that has one row a line; a frequent line's rows are dealt to `salts` tasks."""
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("tid", "line_no"), F.lit(salts)))
    return salted.join(lines.withColumn("salt", F.explode(F.expr(f"sequence(0L, {salts - 1}L)"))), ["line_hash", "salt"]).drop("salt")


def boilerplate(rows: DataFrame, min_sites: int = MIN_SITES, band: float = BAND) -> DataFrame:
    """Rows (line_hash, first) of the lines on enough sites; first is the (doc_id, tid, line_no) of one occurrence.

    rows are lines_of() documents. Enough is min_sites, TIMES as many for short lines, which different texts share by
    chance. One HyperLogLog sketch for each line digest, built on the map side and merged by aggregation, estimates
    the number of sites. An estimate within `band` of what is enough is replaced by an exact distinct count; the
    sketch's error at 2**LG_K registers is a small part of the band. Frequent lines need one sketch a task.
    """
    enough = F.when(F.first("short"), min_sites * TIMES).otherwise(min_sites)
    spread = rows.groupBy("line_hash").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", LG_K)).alias("sites"), enough.alias("enough"), F.min(F.struct("doc_id", "tid", "line_no")).alias("first"), F.count("*").alias("n"))
    spread = cut(spread.where((F.col("n") >= F.col("enough")) & (F.col("sites") >= F.col("enough") * (1 - band))))
    sure = F.col("sites") > F.col("enough") * (1 + band)
    near = spread.where(~sure).select("line_hash", "enough", "first")
    seen = meet(rows.select("tid", "line_no", "line_hash", "site"), near.select("line_hash")).groupBy("line_hash", "site").agg(F.lit(1).alias("one"))
    exact = seen.groupBy("line_hash").agg(F.count("*").alias("exactly"))
    return spread.where(sure).select("line_hash", "first").unionByName(near.join(exact, "line_hash").where("exactly >= enough").select("line_hash", "first"))


def line_dedup(docs: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """docs with their lines that stand on min_sites sites or more removed, but for each line's first occurrence.

    Lines are compared with runs of blanks as one space and without blanks at the ends; every line that is not blank
    is judged, and one of fewer than SHORT letters needs TIMES as many sites. The first occurrence is that with the
    least (doc_id, text digest, line_no), null ids first, so a text that many sites have copied stays whole once. Adds
    n_lines and n_removed; n_chars, where it exists, is counted anew. Null texts stay null with 0 lines; an empty text
    has one line. Rows that agree in doc_id and text are edited alike; those that share only a doc_id, or have none,
    are judged each by their own lines. Empty tables stay empty.
    """
    rows = cut(lines_of(docs))
    known = boilerplate(rows, min_sites)
    at = F.struct("doc_id", "tid", "line_no")
    gone = meet(rows.select("doc_id", "tid", "line_no", "line_hash"), known).where(~at.eqNullSafe(F.col("first")))
    gone = gone.groupBy(F.col("doc_id").alias("g_doc"), F.col("tid").alias("g_tid")).agg(F.collect_set("line_no").alias("gone_nos"))
    rest = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    slim = docs.select("doc_id", "text", text_id(F.col("text")).alias("tid"), F.struct(*rest).alias("row"))
    lines = F.split("text", "\n", -1)
    kept = F.filter(lines, lambda line, i: ~F.coalesce(F.array_contains("gone_nos", i), F.lit(False)))
    both = slim.join(gone, F.col("doc_id").eqNullSafe(F.col("g_doc")) & (F.col("tid") == F.col("g_tid")), "left")
    out = both.withColumn("kept_lines", kept).withColumn("n_lines", F.when(F.col("text").isNull(), 0).otherwise(F.size(lines)).cast("long"))
    out = out.withColumn("n_removed", F.when(F.col("text").isNull(), 0).otherwise(F.col("n_lines") - F.size("kept_lines")).cast("long"))
    out = out.withColumn("kept_text", F.array_join("kept_lines", "\n"))
    fresh = {"text": F.col("kept_text"), "n_chars": F.length("kept_text").cast("long")}
    return out.select(*[fresh[c].alias(c) if c in fresh else F.col(f"row.`{c}`").alias(c) for c in rest], "n_lines", "n_removed")
