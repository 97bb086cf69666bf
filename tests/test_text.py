"""Edge cases of scalar functions, as literal rows."""

import datetime
import time

import pytest
from pyspark.sql import functions as F

from tallyspark.functions import company as C
from tallyspark.functions import similarity as S
from tallyspark.functions import sql as Q
from tallyspark.functions import text as T


def one(spark, column, **values):
    df = spark.range(1)
    for name, value in values.items():
        df = df.withColumn(name, F.lit(value) if value is not None else F.lit(None).cast("string"))
    return df.select(column.alias("v")).head()["v"]


@pytest.mark.parametrize(
    "fn, given, want",
    [
        (T.norm_text, "（A b）　c。", "(ab)c."),
        (T.norm_text, None, None),
        (T.identity_key, "Ａcme-Co. 12", "acmeco12"),
        (T.product_key, "10 平方厘米 &nbsp; [X]", "10cm2x"),
        (T.first_address, "Ann <Ann@X.org>", "ann@x.org"),
        (T.first_address, "write to b@c.de now", "b@c.de"),
        (T.first_address, " None ", "none"),
        (T.all_addresses, "b@c.de, a@c.de B@c.de", ["a@c.de", "b@c.de"]),
        (T.domain_of, "a@B.org", "b.org"),
        (T.domain_of, "nothing", None),
        (T.parse_ts, "2026/08/26", datetime.datetime(2026, 8, 26)),
        (T.parse_ts, "soon", None),
        (T.ts_key, "2026-08-26T01:02:03Z", "2026-08-26 01:02:03"),
        (T.ts_key, "soon", "soon"),
        (T.html_text, "<p>a&amp;b</p><script>x</script><br>c", "a&b\nc"),
        (T.strip_reply_prefix, "Re: FW：回复: hello", "hello"),
        (T.split_top_level, "a(b+c)+d", ["a(b+c)", "d"]),
        (T.split_values, "a,, b；c", ["a", "b", "c"]),
        (T.client_codes, "ab-1234 AB1234 C 999", ["AB1234", "C999"]),
        (T.size_cm, "1.2 m", 120.0),
        (T.size_cm, "500mm", 50.0),
        (T.size_cm, "none", 0.0),
        (T.dedupe_joined, "A / a / B", "A / B"),
        (C.sanitize_company, "x\tLong Name\ny", "Long Name"),
        (C.sanitize_company, "a@bcdefghijklmnop\tSea Ltd", "Sea Ltd"),
        (C.company_noise, "a@b", "email"),
        (C.company_noise, "Sea Trade", "person"),
        (C.company_noise, "Sea Trade Ltd", ""),
        (C.company_noise, None, "missing"),
        (T.blank_to_null, " 　", None),
    ],
)
def test_scalars(spark, fn, given, want):
    assert one(spark, fn(F.col("x")), x=given) == want


@pytest.mark.parametrize("a, b, want", [("abcd", "abxd", 75), ("kitten", "sitting", 61), ("", "", 100), ("a", "", 0), ("same", "same", 100)])
def test_similarity(spark, a, b, want):
    assert one(spark, S.similarity(F.col("a"), F.col("b")), a=a, b=b) == want


def test_text_match(spark):
    assert one(spark, S.text_match(F.col("a"), F.col("b")), a="sea trade", b="the sea trade ltd")
    assert not one(spark, S.text_match(F.col("a"), F.col("b")), a="", b="x")
    assert not one(spark, S.text_match(F.col("a"), F.col("b")), a="abcdef", b="uvwxyz")


@pytest.mark.parametrize("subject, body, want", [("cancel registration", "", "cancel"), ("do not cancel, register", "", "register"), ("hello", "please withdraw", "cancel"), ("add and register", "", "add"), (None, None, "")])
def test_need(spark, subject, body, want):
    column = T.need_of(F.col("s"), F.col("b"), ("cancel", "withdraw"), ("not",), (("register", "register"), ("add", "add")))
    assert one(spark, column, s=subject, b=body) == want


def test_month_window_clamps(spark):
    low, high = T.month_window(F.lit("2026-03-31").cast("date"), 1)
    assert one(spark, low) == datetime.date(2026, 2, 28)
    assert one(spark, high) == datetime.date(2026, 4, 30)
    low, high = T.month_window(F.lit("2026-03-31").cast("date"), 0)
    assert one(spark, low) == one(spark, high) == datetime.date(2026, 3, 31)


def test_sql_functions(spark):
    Q.register(spark)
    row = spark.sql("SELECT norm_text('（A b）'), identity_key('A-b'), similarity('kitten', 'sitting'), month_low(DATE'2026-03-31', 1), domain_of('a@B.c')").head()
    assert list(row) == ["(ab)", "ab", 61, datetime.date(2026, 2, 28), "b.c"]


def test_first_address_over_whole_texts(spark, tmp_path):
    import re

    from tallyspark import plans

    texts = ["Anna <Anna@Mail.org> x@y.org", "to a.b@C.org, d@e.fr", "  No Address, but MORE than twenty letters of it here \n", "a < b and c@d.org", "<> x@y.org", "<\n> x@y.org", "", " ", None, "x" * 3000 + " <In Brackets>"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r["v"] for r in plans.queries()["b5_first_address_whole"](spark, str(tmp_path)).collect()}
    for i, text in enumerate(texts):
        if text is None:
            assert got[i] is None
            continue
        inner, address = re.search(r"<([^<>]+)>", text), re.search(r"[A-Za-z0-9_.+-]+@[A-Za-z0-9_.-]+\.[A-Za-z]{2,}", text)
        assert got[i] == (inner[1] if inner else address[0] if address else text).strip().lower()


@pytest.mark.parametrize(
    "given, want",
    [
        ("AB-1234", "code"), ("ABCDEFGHI-1234", ""), ("AB-123", ""), ("030 / 1", ""), ("+49 (30) 12", "contact"), ("12345", ""), ("a.PDF", "file"), ("Attached you find", "sentence"), ("请查收", "sentence"), ("www.a.b", "link"),
        ("3 家公司：A", "count"), ("三家公司", "count"), ("3M Ltd", ""), ("Anna Maria de Vries", ""), ("Anna Maria Vries", "person"), ("Anna Vries GmbH", ""), ("Émile Zola", "person"), ("North Star Corp s. r. o", ""),
        ("You may not use a company", "form note"), ("明日科技 (香港) 有限公司", ""), ("安排深圳有限公司", ""), ("安排两个公司", "lead-in"), ("a (b", "unpaired"), ("x\ty", "control"), ("x" * 120, ""), ("x" * 121, "sentence"),
    ],
)
def test_company_noise(spark, given, want):
    assert one(spark, C.company_noise(F.col("x")), x=given) == want


def test_company_words_from_a_table(spark):
    words = C.Words.from_table([("placeholders", "TO BE SET"), ("leads", "siehe")])
    assert words.placeholders == ("to be set",) and words.endings == C.Words().endings
    assert one(spark, C.is_placeholder(F.col("x"), words), x="To-be set") is True
    assert one(spark, C.is_placeholder(F.col("x"), words), x="unknown") is False


def test_company_names_with_many_aliases(spark):
    aliases = tuple(f"Alias {i} (c++" for i in range(300)) + ("Sea", "Sea Agent")
    start = time.time()
    got = one(spark, C.company_names(F.col("x"), aliases=aliases), x="CH-1234 Sea Agent North Star Corp s. r. o, Alias 7 (c++ and 出海者 CHZ489 深圳市聚恒科技有限公司")
    assert got == ["North Star Corp s. r. o", "深圳市聚恒科技有限公司"]
    assert time.time() - start < 10


@pytest.mark.parametrize(
    "given, want",
    [("AXB Sea Ltd", "AXB Sea Ltd"), ("a.b Sea Ltd", "Sea Ltd"), ("A.B: Sea Ltd", "Sea Ltd"), ("c++(x-Sea Ltd", "Sea Ltd"), ("a.b c Sea Ltd", "Sea Ltd"), ("a.b c d", "a.b c d"), ("a.bc Ltd", "a.bc Ltd"), (None, None)],
)
def test_strip_alias_prefix_takes_aliases_as_they_are(spark, given, want):
    assert one(spark, T.strip_alias_prefix(F.col("x"), ("a.b", "c++(x", "a.b c"), ("ltd",)), x=given) == want


def test_words_are_no_patterns(spark):
    assert one(spark, T.company_key(F.col("x"), ("c.o",)), x="Sea cxo") == "seacxo"
    assert one(spark, T.suggested_value("a.b", F.col("x")), x="axb: 1\na.b: 2") == ["2"]
    assert one(spark, T.brand_values(F.col("x"), label="c++"), x="c++: Sea\nccc: No") == ["Sea"]
    assert one(spark, T.split_values(F.col("x"), "^]-"), x="a^b]c-d") == ["a", "b", "c", "d"]
    assert one(spark, T.search_variants(F.col("x"), "a.b", ("x.",)), x="xyz(axb)") == ["xyz(axb)"]


def test_arrow_similarities_agree_with_columns(spark):
    words = ["", "a", "ab", "kitten", "sitting", "the sitting", "Blue Sea Trading", "The Blue Sea Trading Ltd", "Bleu See Tradnig", "éß🙂", "x" * 70, "x" * 69 + "y"]
    df = spark.createDataFrame([(a, b) for a in [*words, None] for b in [*words, None]], "a string, b string")
    a, b = F.col("a"), F.col("b")
    same = lambda x, y: x.eqNullSafe(y)
    there = df.where("a is not null and b is not null")
    assert there.where(~same(S.similarity(a, b), S.similarity_arrow(a, b))).count() == 0
    assert there.where("a != '' and b != ''").where(~same(S.partial_similarity(a, b), S.partial_similarity_arrow(a, b))).count() == 0
    assert there.where(~same(S.text_match(a, b), S.text_match_arrow(a, b))).count() == 0
    assert df.where("a is null or b is null").where(S.text_match_arrow(a, b).isNotNull() | S.similarity_arrow(a, b).isNotNull()).count() == 0
