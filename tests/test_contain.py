import random

import pytest
from pyspark.sql import functions as F

from tallyspark.operators import contain


@pytest.fixture(scope="module")
def data(spark):
    rng = random.Random(7)
    letters = "abc, é"
    texts = ["".join(rng.choices(letters, k=rng.choice([0, 1, 5, 60, 300, 700]))) for _ in range(40)] + [None, "abc" * 12_000 + ",éab"]
    terms = sorted({"".join(rng.choices(letters, k=rng.randint(1, 11))) for _ in range(90)}) + ["", None]
    return spark.createDataFrame(list(enumerate(texts)), "id int, t string").repartition(4), texts, terms


def spots(text, term):
    return [i + 1 for i in range(len(text)) if text.startswith(term, i)]


@pytest.mark.parametrize("size", [{}, {"shard": 50}, {"sent": 0}])
def test_places(spark, data, size):
    df, texts, terms = data
    table = spark.createDataFrame([(w, i) for i, w in enumerate(terms)], "w string, no int")
    got = sorted((r["id"], r["at"], r["w"]) for r in contain.places(df, ["id"], "t", table, "w", **size).collect())
    assert got == sorted((i, at, w) for i, t in enumerate(texts) if t for w in terms if w for at in spots(t, w))
    edged = sorted((r["id"], r["at"], r["w"]) for r in contain.places(df, ["id"], "t", table, "w", edges="[, ]", **size).collect())
    assert edged == sorted((i, at, w) for i, t in enumerate(texts) if t for w in terms if w for at in spots(t, w) if at == 1 or t[at - 2] in ", ")
    near = sorted((r["id"], r["at"], r["w"], r["pre"], r["post"]) for r in contain.places(df, ["id"], "t", table, "w", head=3, context=4, **size).collect())
    pad = lambda t, at: ("    " + t)[at - 1 : at + 3]
    assert near == sorted((i, at, w, pad(t, at), t[at - 1 + len(w) : at + len(w)]) for i, t in enumerate(texts) if t for w in terms if w for at in spots(t, w) if at <= 3)

    first = sorted((r["id"], r["at"], r["w"]) for r in contain.places(df, ["id"], "t", table, "w", keep="first", edges="[, ]", **size).collect())
    assert first == sorted({(i, w): (i, at, w) for i, at, w in reversed(edged)}.values())
    best = sorted((r["id"], r["at"], r["w"]) for r in contain.places(df, ["id"], "t", table, "w", keep="best", edges="[, ]", **size).collect())
    assert best == sorted({i: (i, at, w) for i, at, _, w in sorted(((i, at, -len(w), w) for i, at, w in edged), reverse=True)}.values())


def test_edges_of_any_class(spark):
    df, table = spark.createDataFrame([(1, "ab;ab ab")], "id int, t string"), spark.createDataFrame([("ab",)], "w string")
    for size in ({}, {"sent": 0}):
        assert sorted(r["at"] for r in contain.places(df, ["id"], "t", table, "w", edges="[;]", **size).collect()) == [1, 4]


def test_a_large_dictionary(spark):
    table = spark.range(1_000_000).select(F.concat(F.lit("k"), F.lpad("id", 7, "0")).alias("w"), "id")
    df = spark.createDataFrame([(1, "a k0000007 k0999999"), (2, "k00000070 k1000000"), (3, None)], "n int, t string").repartition(2)
    got = contain.places(df, ["n"], "t", table, "w")
    assert sorted((r["n"], r["at"], r["id"]) for r in got.collect()) == [(1, 3, 7), (1, 12, 999_999), (2, 1, 7)]


@pytest.mark.parametrize("few", [0, 5, 90])
def test_held(spark, data, few):
    df, texts, terms = data
    some = terms[:few] + terms[-2:]
    table = spark.createDataFrame([(w, [w, "x"], 1) for w in some], "w string, l array<string>, n int")
    got = sorted((r["id"], r["w"], r["l"][0], r["at"]) for r in contain.held(df, ["id"], "t", table, "w").collect())
    assert got == sorted((i, w, w, t.index(w) + 1) for i, t in enumerate(texts) if t for w in some if w and w in t)


def test_no_products(spark, data):
    df, _, terms = data
    table = spark.createDataFrame([(w,) for w in terms], "w string")
    for size in ({}, {"sent": 0}):
        plan = contain.places(df, ["id"], "t", table, "w", **size)._jdf.queryExecution().toString()
        assert "Cartesian" not in plan and "NestedLoop" not in plan
