"""Orders as the work list, line items as the ledger."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tallyspark.functions.text import month_window
from tallyspark.operators import match

from .base import Plans, table

plans = Plans()
QUERIES, ORACLES = plans.queries, plans.oracles


def work(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderdate").alias("anchor"), "o_custkey")


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_shipdate").alias("entered"), "l_linenumber", "l_partkey", "l_suppkey")


#: Counts by order, as a relation to which the other statements add.
COUNTS = """
p AS (SELECT o_orderkey AS k, CAST(o_orderdate AS DATE) AS anchor, o_custkey,
             CAST(CAST(o_orderdate AS DATE) - INTERVAL 1 MONTH AS DATE) AS low, CAST(CAST(o_orderdate AS DATE) + INTERVAL 1 MONTH AS DATE) AS high FROM orders),
l AS (SELECT l_orderkey AS k, CAST({date} AS DATE) AS day FROM lineitem),
j AS (SELECT p.*, l.day, l.k AS there, l.day BETWEEN low AND high AS inside, abs(l.day - anchor) AS gap FROM p LEFT JOIN l ON p.k = l.k),
c AS (SELECT k, anchor, o_custkey,
             count(*) FILTER (inside) AS n_in,
             count(*) FILTER (there IS NOT NULL AND NOT inside) AS n_out,
             count(*) FILTER (there IS NOT NULL AND day IS NULL) AS n_unknown,
             min(gap) FILTER (inside) AS nearest_days FROM j GROUP BY ALL),
n AS (SELECT c.*, (SELECT min(day) FROM j WHERE j.k = c.k AND inside AND gap = nearest_days) AS nearest_date,
             (SELECT count(*) > 1 FROM j WHERE j.k = c.k AND inside AND gap = nearest_days) AS tie FROM c)
"""
SIMPLE = COUNTS.format(date="l_shipdate")
J1 = f"""WITH {SIMPLE} SELECT k, anchor, n_in, n_out, n_unknown, nearest_date, nearest_days,
CASE WHEN nearest_days IS NOT NULL THEN tie END AS nearest_tie,
CASE WHEN n_in + n_unknown = 0 THEN 'missing' WHEN n_in + n_unknown = 1 THEN 'recorded' ELSE 'review' END AS status FROM n"""


@plans.add("j1_reconcile_orders", J1)
def j1(spark, sf_dir):
    out = match.reconcile(work(spark, sf_dir), ledger(spark, sf_dir), ["k"], "anchor", "entered", 1)
    return out.withColumn("anchor", F.col("anchor").cast("date"))


@plans.add(
    "j2_window_verdict",
    f"""WITH {COUNTS.format(date="CASE WHEN l_linenumber <> 4 THEN l_shipdate END")} SELECT k, anchor, n_in, n_out, n_unknown,
CASE WHEN n_unknown > 0 THEN 'review_date' WHEN n_in = 0 AND n_out > 0 THEN 'none_in_range'
     WHEN n_in = 1 AND n_out > 0 AND o_custkey % 2 = 0 THEN 'review_items'
     WHEN n_in = 0 THEN 'missing' WHEN n_in = 1 THEN 'recorded' ELSE 'review' END AS verdict FROM c""",
)
def j2(spark, sf_dir):
    hidden = ledger(spark, sf_dir).withColumn("entered", F.when(F.col("l_linenumber") != 4, F.col("entered")))
    out = match.candidate_counts(work(spark, sf_dir), hidden, ["k"], "anchor", "entered", 1).join(work(spark, sf_dir).select("k", "o_custkey"), "k")
    verdict = match.window_verdict(F.col("n_in"), F.col("n_out"), F.col("n_unknown"), F.col("o_custkey") % 2 == 0)
    return out.select("k", F.col("anchor").cast("date").alias("anchor"), "n_in", "n_out", "n_unknown", verdict.alias("verdict"))


@plans.add(
    "d12_interval_join",
    """SELECT o_orderkey AS k, l_linenumber, l_partkey, l_suppkey, CAST(l_shipdate AS DATE) AS entered,
CAST(l_shipdate AS DATE) - CAST(o_orderdate AS DATE) AS days FROM orders JOIN lineitem ON o_orderkey = l_orderkey
WHERE CAST(l_shipdate AS DATE) BETWEEN CAST(o_orderdate AS DATE) - INTERVAL 1 MONTH AND CAST(o_orderdate AS DATE) + INTERVAL 1 MONTH""",
)
def d12(spark, sf_dir):
    out = match.interval_join(work(spark, sf_dir), ledger(spark, sf_dir), ["k"], "anchor", "entered", 1)
    return out.select("k", "l_linenumber", "l_partkey", "l_suppkey", F.col("entered").cast("date").alias("entered"), "days")


@plans.add(
    "f3_nearest",
    """WITH j AS (SELECT o_orderkey AS k, l_linenumber, l_partkey, l_suppkey, CAST(l_shipdate AS DATE) AS entered,
abs(CAST(l_shipdate AS DATE) - CAST(o_orderdate AS DATE)) AS days FROM orders JOIN lineitem ON o_orderkey = l_orderkey),
r AS (SELECT *, count(*) OVER (PARTITION BY k, days) > 1 AS tie,
row_number() OVER (PARTITION BY k ORDER BY days, entered, l_linenumber, l_partkey, l_suppkey) AS place FROM j)
SELECT k, entered, days, tie FROM r WHERE place = 1""",
)
def f3(spark, sf_dir):
    out = match.nearest_candidate(work(spark, sf_dir), ledger(spark, sf_dir), ["k"], "anchor", "entered", ["l_linenumber", "l_partkey", "l_suppkey"])
    return out.select("k", F.col("entered").cast("date").alias("entered"), "days", "tie")


#: Work rows that share keys: eight orders a case, so keys, and keys with dates, repeat; some have no date.
SHARED_WORK = "p AS (SELECT o_orderkey, o_orderkey // 8 AS k, CASE WHEN o_orderkey % 11 <> 0 THEN CAST(date_trunc('month', o_orderdate) AS DATE) END AS anchor FROM orders), l AS (SELECT l_orderkey // 8 AS k, l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_linenumber <> 5 THEN CAST(l_shipdate AS DATE) END AS day FROM lineitem)"


def shared_work(spark, sf_dir):
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.floor(k / 8).alias("k"), F.when(k % 11 != 0, F.trunc("o_orderdate", "month")).alias("anchor"))


def shared_ledger(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(F.floor(F.col("l_orderkey") / 8).alias("k"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.when(F.col("l_linenumber") != 5, F.col("l_shipdate").cast("date")).alias("entered"))


@plans.add("f3_nearest_shared_keys", f"""WITH {SHARED_WORK}, j AS (SELECT o_orderkey, p.k, anchor, day, l_orderkey, l_linenumber, l_partkey, l_suppkey, abs(day - anchor) AS days FROM p JOIN l ON p.k = l.k WHERE anchor IS NOT NULL AND day IS NOT NULL),
r AS (SELECT *, count(*) OVER (PARTITION BY o_orderkey, days) > 1 AS tie, row_number() OVER (PARTITION BY o_orderkey ORDER BY days, day, l_orderkey, l_linenumber, l_partkey, l_suppkey) AS place FROM j)
SELECT o_orderkey, day AS entered, l_orderkey, l_linenumber, days, tie FROM r WHERE place = 1""")
def f3_shared(spark, sf_dir):
    out = match.nearest_candidate(shared_work(spark, sf_dir), shared_ledger(spark, sf_dir), ["k"], "anchor", "entered", ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"])
    return out.select("o_orderkey", "entered", "l_orderkey", "l_linenumber", "days", "tie")


@plans.add("j1_reconcile_shared_keys", f"""WITH {SHARED_WORK}, j AS (SELECT o_orderkey, p.k, anchor, l.k IS NOT NULL AS there, day, coalesce(day BETWEEN CAST(anchor - INTERVAL 1 MONTH AS DATE) AND CAST(anchor + INTERVAL 1 MONTH AS DATE), false) AS inside, abs(day - anchor) AS gap FROM p LEFT JOIN l ON p.k = l.k),
c AS (SELECT o_orderkey, k, anchor, count(*) FILTER (inside) AS n_in, count(*) FILTER (there AND (day IS NULL OR anchor IS NULL)) AS n_unknown, count(*) FILTER (there AND day IS NOT NULL AND anchor IS NOT NULL AND NOT inside) AS n_out,
min(gap) FILTER (inside) AS nearest_days FROM j GROUP BY ALL)
SELECT k, anchor, n_in, n_out, n_unknown, nearest_days, (SELECT min(day) FROM j WHERE j.o_orderkey = c.o_orderkey AND inside AND gap = nearest_days) AS nearest_date,
CASE WHEN nearest_days IS NOT NULL THEN (SELECT count(*) > 1 FROM j WHERE j.o_orderkey = c.o_orderkey AND inside AND gap = nearest_days) END AS nearest_tie,
CASE WHEN n_in + n_unknown = 0 THEN 'missing' WHEN n_in + n_unknown = 1 THEN 'recorded' ELSE 'review' END AS status FROM c""")
def j1_shared(spark, sf_dir):
    return match.reconcile(shared_work(spark, sf_dir), shared_ledger(spark, sf_dir), ["k"], "anchor", "entered", 1)


ITEMS = """WITH i AS (SELECT l_orderkey AS owner, p_brand AS brand, p_type AS kind, l_returnflag = 'R' AS claim, l_linenumber, l_partkey, l_suppkey, l_shipdate
FROM lineitem JOIN part ON l_partkey = p_partkey),
g AS (SELECT owner, brand, kind, count(*) FILTER (claim) AS a, count(*) FILTER (NOT claim) AS b FROM i GROUP BY ALL),
s AS (SELECT owner, sum(least(a, b))::BIGINT AS n_matched, sum(a - least(a, b))::BIGINT AS n_missing, 0::BIGINT AS n_pending,
sum(b - least(a, b))::BIGINT AS n_extra FROM g GROUP BY owner)
SELECT *, CASE WHEN n_missing > 0 THEN 'missing' WHEN n_matched > 0 THEN 'matched' ELSE 'none' END AS overall FROM s"""


def items(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    rows = rows.select(F.col("l_orderkey").alias("owner"), F.col("p_brand").alias("brand"), F.col("p_type").alias("kind"), "l_returnflag", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate")
    claims, others = rows.where("l_returnflag = 'R'"), rows.where("l_returnflag != 'R'")
    return match.match_items(claims, others, "owner", [["brand", "kind"]], ["l_linenumber", "l_partkey", "l_suppkey", "l_shipdate"])


@plans.add("j4_item_match", ITEMS)
def j4(spark, sf_dir):
    return match.item_outcome(items(spark, sf_dir), "owner")


@plans.add(
    "j5_audit_label",
    ITEMS.replace("SELECT *, CASE", "SELECT owner, CASE").replace("'missing' WHEN n_matched", "'lacks items' WHEN n_matched").replace("'matched' ELSE 'none'", "'agrees' ELSE 'not audited'").replace("AS overall", "AS label"),
)
def j5(spark, sf_dir):
    return j4(spark, sf_dir).select("owner", match.audit_label(F.col("overall")).alias("label"))


@plans.add("j4_item_gate", """WITH o AS (SELECT l_orderkey, count(*) FILTER (l_returnflag = 'R') AS n FROM lineitem GROUP BY 1)
SELECT o_orderkey, coalesce(n, 0) AS n_orders, CASE WHEN coalesce(n, 0) = 0 THEN 'no order' WHEN n > 1 THEN 'several orders' WHEN o_orderkey % 5 = 0 THEN 'detail unread'
WHEN o_orderkey % 5 = 1 THEN 'columns missing' WHEN o_custkey % 2 = 0 THEN 'detail empty' ELSE '' END AS gate FROM orders LEFT JOIN o ON l_orderkey = o_orderkey""")
def j4_gate(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    found = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    columns = F.when(F.col("o_orderkey") % 5 == 1, F.array(F.lit("brand"))).otherwise(F.array(F.lit("class"), F.lit("brand"), F.lit("x")))
    read = orders.where("o_orderkey % 5 != 0").select("o_orderkey", columns.alias("columns"), (F.col("o_custkey") % 2).alias("n_rows"))
    return match.item_gate(orders, "o_orderkey", found, read, ["brand", "class"])


@plans.add("j4_gated_outcome", ITEMS.rsplit("SELECT *, CASE", 1)[0] + """, d AS (SELECT l_orderkey AS owner, CASE WHEN count(*) FILTER (l_returnflag = 'N') = 0 THEN 'no order' WHEN count(*) FILTER (l_returnflag = 'N') > 1 THEN 'several orders' ELSE '' END AS gate FROM lineitem GROUP BY 1)
SELECT s.*, gate, CASE WHEN gate <> '' THEN 'pending' WHEN n_missing > 0 THEN 'missing' WHEN n_matched > 0 THEN 'matched' ELSE 'none' END AS overall FROM s JOIN d USING (owner)""")
def j4_gated(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("owner"), "l_returnflag")
    read = rows.select("owner").distinct().select("owner", F.array(F.lit("brand")).alias("columns"), F.lit(1).alias("n_rows"))
    gates = match.item_gate(rows, "owner", rows.where("l_returnflag = 'N'"), read, ["brand"])
    return match.item_outcome(items(spark, sf_dir), "owner", gates)


@plans.add(
    "j19_missing_report",
    f"WITH {SIMPLE} SELECT k, anchor, row_number() OVER (ORDER BY anchor, k) AS report_no FROM c WHERE n_in + n_unknown = 0",
)
def j19(spark, sf_dir):
    return match.missing_report(j1(spark, sf_dir), "status", ["anchor", "k"]).select("k", "anchor", "report_no")


@plans.add(
    "b11_month_window",
    """WITH d AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders)
SELECT day, CAST(day - INTERVAL 1 MONTH AS DATE) AS low1, CAST(day + INTERVAL 1 MONTH AS DATE) AS high1,
CAST(day - INTERVAL 2 MONTH AS DATE) AS low2, CAST(day + INTERVAL 2 MONTH AS DATE) AS high2, day AS low0, day AS high0 FROM d""",
)
def b11(spark, sf_dir):
    days = table(spark, sf_dir, "orders").select(F.col("o_orderdate").cast("date").alias("day")).distinct()
    return days.select("day", *[c.alias(f"{side}{n}") for n in (1, 2, 0) for side, c in zip(("low", "high"), month_window(F.col("day"), n))])


@plans.add(
    "d11_first_variant",
    """WITH v AS (SELECT p_partkey, 0 AS no, p_name AS name FROM part UNION ALL SELECT p_partkey, 1, split_part(p_name, ' ', 2) FROM part
UNION ALL SELECT p_partkey, 2, split_part(p_name, ' ', 1) FROM part),
n AS (SELECT DISTINCT split_part(p_name, ' ', 2) AS name, p_brand FROM part WHERE p_size > 25),
h AS (SELECT v.p_partkey, v.no, v.name, part.p_brand FROM v JOIN part USING (p_partkey) JOIN n ON n.name = v.name AND n.p_brand = part.p_brand)
SELECT p_partkey, min(no) AS variant_no, arg_min(name, no) AS variant FROM h GROUP BY p_partkey""",
)
def d11(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    words = F.split("p_name", " ")
    known = part.where("p_size > 25").select(words[1].alias("name"), F.col("p_brand").alias("brand")).distinct()
    left = part.select("p_partkey", "p_name", F.col("p_brand").alias("w_brand"))
    return match.first_variant(left, known, F.array("p_name", words[1], words[0]), "name", ["brand"], ["p_partkey"]).select("p_partkey", "variant_no", "variant")



@plans.add(
    "j3_field_agree",
    """WITH o AS (SELECT o_orderkey, o_orderkey % 5 AS m FROM orders) SELECT o_orderkey, m IN (0, 1) AS agree FROM o""",
)
def j3(spark, sf_dir):
    """By order key: 0 blank agent, 1 all agree, 2 other agent, 3 other company, 4 blank project."""
    m = F.col("o_orderkey") % 5
    who = F.concat(F.lit("Agent "), F.col("o_custkey"))
    company = F.concat(F.lit("Company "), F.col("o_custkey"), F.lit(" Ltd"))
    other = F.when(m == 0, " ").when(m == 2, "quite another").otherwise(F.upper(who))
    their = F.when(m == 3, "Zzzzzz Qqqqqq").otherwise(F.concat(F.lit("the "), company))
    project = F.when(m == 4, "").otherwise(F.col("o_orderpriority"))
    ok = match.field_agree(who, other, company, their, F.col("o_orderpriority"), project)
    return table(spark, sf_dir, "orders").select("o_orderkey", ok.alias("agree"))


NOTED = """WITH w AS (SELECT o_orderkey, o_orderkey // 2 AS k, CASE WHEN o_orderkey % 23 <> 0 THEN CAST(o_orderdate AS DATE) END AS anchor, o_custkey FROM orders WHERE o_orderkey % 3 <> 0 OR o_custkey % 2 = 0),
l AS (SELECT l_orderkey // 2 AS k, CASE WHEN l_partkey % 9 <> 0 THEN CAST(l_shipdate AS DATE) END AS day, l_linenumber % 4 <> 3 AS agent, l_partkey % 3 <> 1 AS company, l_suppkey % 5 <> 0 AS project FROM lineitem WHERE l_quantity > 30),
j AS (SELECT w.o_orderkey, w.anchor, w.o_custkey, l.k IS NOT NULL AS there, day, agent, company, project, abs(day - anchor) AS gap, coalesce(day IS NOT NULL AND anchor IS NOT NULL AND NOT day BETWEEN CAST(anchor - INTERVAL 1 MONTH AS DATE) AND CAST(anchor + INTERVAL 1 MONTH AS DATE), false) AS outside FROM w LEFT JOIN l ON w.k = l.k),
c AS (SELECT o_orderkey, o_custkey, count(*) FILTER (there AND {take}) AS n, min(gap) FILTER (there AND {take}) AS nearest_days, count(*) FILTER (there AND {take} AND agent AND company AND project) AS good, coalesce(bool_or(outside) FILTER (there AND {take}), false) AS outside,
concat_ws('; ', CASE WHEN bool_or(NOT agent) FILTER (there AND {take}) THEN 'agent: Agent ' || o_custkey || ' / quite another' END, CASE WHEN bool_or(NOT company) FILTER (there AND {take}) THEN 'company: Blue Sea Trading / Zzzzzz Qqqqqq' END, CASE WHEN bool_or(NOT project) FILTER (there AND {take}) THEN 'project: Germany WEEE / ' END) AS differ FROM j GROUP BY o_orderkey, o_custkey),
t AS (SELECT c.*, (SELECT count(*) FROM j WHERE j.o_orderkey = c.o_orderkey AND there AND {take} AND gap = nearest_days) AS ties FROM c)
SELECT o_orderkey, CASE WHEN n = 0 THEN 'missing' WHEN n = 1 THEN 'recorded' ELSE 'review' END AS status, CASE WHEN n = 0 THEN 'missing' WHEN n > 1 THEN 'several' WHEN good = 0 THEN 'fields differ' WHEN outside THEN 'date outside' ELSE 'exact' END AS match_status, n, nearest_days,
CASE WHEN n = 0 THEN '' WHEN n > 1 THEN n || ' records' || coalesce('; the nearest is ' || nearest_days || ' days away' || CASE WHEN ties > 1 THEN ' (tied)' ELSE '' END, '; none has a date') || CASE WHEN good = 0 THEN '; none agrees in all fields' ELSE '' END
WHEN good = 0 THEN 'one record, but ' || differ WHEN outside THEN 'one record, but ' || nearest_days || ' days away' ELSE '' END AS note FROM t"""


def noted(spark, sf_dir, windowed):
    """Orders, two a key, against their line items of large quantity, whose fields agree or differ by their numbers."""
    k = F.col("o_orderkey")
    orders = table(spark, sf_dir, "orders").where("o_orderkey % 3 != 0 OR o_custkey % 2 = 0")
    work = orders.select("o_orderkey", F.floor(k / 2).alias("k"), F.when(k % 23 != 0, F.col("o_orderdate")).alias("anchor"), F.concat(F.lit("Agent "), "o_custkey").alias("agent"), F.lit("Blue Sea Trading").alias("company"), F.lit("Germany WEEE").alias("project"))
    agent = F.when(F.col("l_linenumber") % 4 == 3, "quite another").otherwise("")
    company = F.when(F.col("l_partkey") % 3 == 1, "Zzzzzz Qqqqqq").otherwise("The Blue Sea Trading Ltd")
    ledger = table(spark, sf_dir, "lineitem").where("l_quantity > 30").select(F.floor(F.col("l_orderkey") / 2).alias("k"), F.when(F.col("l_partkey") % 9 != 0, F.col("l_shipdate")).alias("entered"), agent.alias("agent"), company.alias("company"), F.when(F.col("l_suppkey") % 5 != 0, "Germany WEEE").alias("project"))
    return match.reconcile_notes(work, ledger, ["k"], ["o_orderkey"], "anchor", "entered", 1, windowed)


@plans.add("j1_reconcile_notes", NOTED.format(take="NOT outside"))
def j1_notes(spark, sf_dir):
    return noted(spark, sf_dir, True)


@plans.add("j1_reconcile_notes_all", NOTED.format(take="true"))
def j1_notes_all(spark, sf_dir):
    return noted(spark, sf_dir, False)


@plans.add("j4_items_in_order", ITEMS.rsplit("SELECT *, CASE", 1)[0] + "SELECT owner, n_matched, n_missing, n_extra FROM s")
def j4_in_order(spark, sf_dir):
    """With keys of which the second adds nothing, the ordered search matches as many as there are on both sides."""
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    each = rows.select(F.col("l_orderkey").alias("owner"), F.col("p_brand").alias("brand"), F.col("p_type").alias("kind"), "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_returnflag")
    parts = lambda mine: each.where((F.col("l_returnflag") == "R") == mine).drop("l_returnflag")
    out = match.match_items_in_order(parts(True), parts(False), "owner", [["brand", "kind"], ["kind", "brand"]], ["l_linenumber", "l_partkey", "l_suppkey", "l_shipdate"])
    return match.item_outcome(out, "owner").select("owner", "n_matched", "n_missing", "n_extra")
