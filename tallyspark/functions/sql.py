"""SQL names for the text functions (SURVEY K): temporary functions of a session."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.functions import udtf

from .similarity import partial_similarity_arrow, similarity_arrow
from .text import BLANK, NARROW, WIDE


class Segments:
    """F4 as a table function: group_segments(TABLE(t) PARTITION BY mail ORDER BY no), with columns mail, no, company, country
    and service. A mail's rows stream through; only the open record is kept."""

    def __init__(self) -> None:
        self.record, self.company, self.country = 0, None, None

    def eval(self, row: Row) -> Iterator[tuple]:
        if row["company"] is not None:
            self.record, self.company, self.country = self.record + 1, row["company"], None
        if row["country"] is not None:
            self.country = row["country"]
        if row["service"] is not None and self.company is not None:
            yield row["mail"], row["no"], self.record, self.company, self.country, row["service"]


def quoted(text: str) -> str:
    """A SQL string of the text; every letter that a literal could read otherwise is written by its number."""
    return "'" + "".join(c if c.isalnum() and c.isascii() else f"\\u{ord(c):04x}" for c in text) + "'"


def register(spark: SparkSession) -> list[str]:
    """Creates norm_text, identity_key, blank_to_null, domain_of, month_low, month_high and similarity for SQL.

    They are SQL expressions, so Catalyst inlines them; the similarity is the Indel ratio of functions.similarity. Besides,
    similarity_arrow and partial_similarity_arrow compute it and the partial one in Arrow batches, and group_segments is a
    table function.
    """
    lcs = (
        "element_at(aggregate(filter(split(a, ''), c -> c != ''), transform(concat(array(''), filter(split(b, ''), c -> c != '')), c -> 0), "
        "(p, x) -> aggregate(sequence(1, greatest(length(b), 1)), array(0), (acc, j) -> concat(acc, array(CASE WHEN length(b) = 0 THEN 0 WHEN substr(b, j, 1) = x THEN p[j - 1] + 1 ELSE greatest(p[j], element_at(acc, -1)) END)))), -1)"
    )
    bodies = {
        "norm_text(t STRING) RETURNS STRING": "lower(regexp_replace(translate(t, '（），。', '(),.'), '[\\\\s\\\\x{3000}\\\\x{00A0}]+', ''))",
        "identity_key(t STRING) RETURNS STRING": f"regexp_replace(lower(translate(t, {quoted(WIDE)}, {quoted(NARROW)})), '(?U)[\\\\W_]+', '')",
        "blank_to_null(t STRING) RETURNS STRING": f"nullif(trim(BOTH {quoted(BLANK)} FROM t), '')",
        "domain_of(t STRING) RETURNS STRING": "CASE WHEN contains(t, '@') THEN lower(substring_index(t, '@', -1)) END",
        "month_low(d DATE, n INT) RETURNS DATE": "add_months(d, -greatest(n, 0))",
        "month_high(d DATE, n INT) RETURNS DATE": "add_months(d, greatest(n, 0))",
        "similarity(a STRING, b STRING) RETURNS INT": f"CASE WHEN length(a) + length(b) = 0 THEN 100 WHEN length(a) = 0 OR length(b) = 0 THEN 0 ELSE CAST(floor(200 * {lcs} / (length(a) + length(b))) AS INT) END",
    }
    for head, body in bodies.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    for name, function in (("similarity_arrow", similarity_arrow), ("partial_similarity_arrow", partial_similarity_arrow)):
        spark.udf.register(name, function)
    returns = "mail long, no long, record_no long, company string, country string, service string"
    spark.udtf.register("group_segments", udtf(Segments, returnType=returns))
    return [*(head.split("(")[0] for head in bodies), "similarity_arrow", "partial_similarity_arrow", "group_segments"]


def query(spark: SparkSession, text: str, **tables: DataFrame) -> DataFrame:
    """The result of SQL over the given tables, with the functions above."""
    register(spark)
    return spark.sql(text, **tables)
