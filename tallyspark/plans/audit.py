"""Sources, segments and audits over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyspark.functions.company import Words, company_noise
from tallyspark.operators import audit as A
from tallyspark.operators import segments as S
from tallyspark.sources import cells as C
from tallyspark.sources import messages as M

from .base import Plans, table

plans = Plans()
QUERIES, ORACLES = plans.queries, plans.oracles


def day(text: str):
    return F.lit(text).cast("date")


def mails(spark, sf_dir):
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.when(k % 5 > 1, F.col("o_orderdate")).alias("header"), F.when(k % 5 != 1, F.col("o_orderdate") + F.expr("interval 200 days")).alias("arrival"))


MAILS = "m AS (SELECT o_orderkey, CASE WHEN o_orderkey % 5 > 1 THEN o_orderdate END AS header, CASE WHEN o_orderkey % 5 <> 1 THEN o_orderdate + INTERVAL 200 DAY END AS arrival FROM orders), e AS (SELECT *, CAST(coalesce(header, arrival) AS DATE) BETWEEN DATE '1997-01-01' AND DATE '1997-12-31' AS inside FROM m)"


@plans.add("a1_scan_range", f"WITH {MAILS} SELECT o_orderkey FROM e WHERE inside")
def a1(spark, sf_dir):
    return M.scan_range(mails(spark, sf_dir), "header", "arrival", day("1997-01-01"), day("1997-12-31")).select("o_orderkey")


@plans.add("a2_range_metrics", f"WITH {MAILS} SELECT count(*) FILTER (inside AND header IS NOT NULL) AS header_hits, count(*) FILTER (inside AND header IS NULL) AS fallback_hits, count(*) FILTER (NOT inside) AS out_of_range, count(*) FILTER (inside IS NULL) AS unknown FROM e")
def a2(spark, sf_dir):
    return M.range_metrics(mails(spark, sf_dir), "header", "arrival", day("1997-01-01"), day("1997-12-31"))


@plans.add("a3_union_candidates", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' UNION SELECT o_orderkey FROM orders WHERE o_orderpriority = '5-LOW'")
def a3(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    return M.union_candidates(orders.where("o_orderstatus = 'F'"), orders.where("o_orderpriority = '5-LOW'"), "o_orderkey")


@plans.add("a4_require_complete", "SELECT n_nationkey FROM nation")
def a4(spark, sf_dir):
    rows = table(spark, sf_dir, "nation")
    return M.require_complete(rows, rows.count(), F.col("n_name").isNull()).select("n_nationkey")


@plans.add("a4_complete_orders", "SELECT o_orderkey FROM orders")
def a4_orders(spark, sf_dir):
    """The orders, published only if as many came as their customers' counts say and each has a date."""
    rows = table(spark, sf_dir, "orders")
    expected = rows.groupBy("o_custkey").count().agg(F.sum("count")).head()[0]
    return M.require_complete(rows, expected or 0, F.col("o_orderdate").isNull()).select("o_orderkey")


@plans.add("a5_import_addresses", "SELECT DISTINCT lower(s_name) || '@x' || s_nationkey AS email, 'x' || s_nationkey AS suffix FROM supplier WHERE s_suppkey % 3 <> 0")
def a5_import(spark, sf_dir):
    """The suppliers as an import form: a title, a header row, addresses in the second column, others beside it."""
    rows = table(spark, sf_dir, "supplier")
    head = spark.createDataFrame([(1, 1, "List of 2024, write to me@other.org"), (2, 1, "Name"), (2, 2, "E-Mail address"), (2, 3, "Note")], "row_no int, col_no int, value string")
    k = (F.col("s_suppkey") + 3).cast("int").alias("row_no")
    at = lambda n, value: F.struct(F.lit(n).alias("col_no"), value.alias("value"))
    mail = F.when(F.col("s_suppkey") % 3 != 0, F.concat(F.lit(" "), F.upper("s_name"), F.lit("@X"), F.col("s_nationkey"))).otherwise("none yet")
    body = rows.select(k, F.explode(F.array(at(1, F.col("s_name")), at(2, mail), at(3, F.concat(F.lit("old@"), "s_name")))).alias("c")).select("row_no", "c.*")
    return M.import_addresses(head.union(body), ("mail",))


@plans.add("a5_address_set", "SELECT DISTINCT lower(trim(c)) AS email FROM (SELECT unnest([s_name || '@x', 'no', CAST(s_suppkey % 3 AS VARCHAR) || '@y']) AS c FROM supplier) WHERE c LIKE '%@%'")
def a5(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier").select(F.concat("s_name", F.lit("@X ")).alias("a"), F.lit("no").alias("b"), F.concat(F.col("s_suppkey") % 3, F.lit("@y")).alias("c"))
    return M.load_address_set(rows)


@plans.add("a7_projects", "SELECT DISTINCT p_type FROM part")
def a7(spark, sf_dir):
    return M.load_projects(table(spark, sf_dir, "part"), "p_type")


@plans.add("a8_conform", "SELECT CAST(o_orderkey AS VARCHAR) AS id, CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority ELSE o_orderstatus END AS project, NULL::VARCHAR AS agent FROM orders")
def a8(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderstatus").alias("old_project"), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderpriority")).otherwise(" ").alias("Project Name"))
    return M.conform(rows, {"id": ["key", "O_ORDERKEY"], "project": ["old_project"], "agent": ["agent"]}, {"project": "project name"})


def queued(spark, sf_dir):
    queue = F.when(F.col("o_orderstatus") == "F", "work").when(F.col("o_orderstatus") == "O", "filtered")
    return table(spark, sf_dir, "orders").withColumn("queue", queue)


@plans.add("a14_three_way", "SELECT CASE o_orderstatus WHEN 'F' THEN 'work' WHEN 'O' THEN 'filtered' ELSE 'review' END AS list, count(*) AS n FROM orders GROUP BY 1")
def a14(spark, sf_dir):
    return M.list_sizes(queued(spark, sf_dir), "queue")


@plans.add("a14_work_list", "SELECT o_orderkey FROM orders WHERE o_orderstatus NOT IN ('F', 'O')")
def a14_review(spark, sf_dir):
    return M.split_stage1(queued(spark, sf_dir), "queue")["review"].select("o_orderkey")


@plans.add("a19_export_reviewed", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND year(o_orderdate) = 1998")
def a19(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").withColumn("mail_day", F.col("o_orderdate").cast("date")).withColumn("status", F.when(F.col("o_orderstatus") == "F", "confirmed").otherwise("open"))
    return M.export_reviewed(rows, rows, rows, edits(rows), rows, "mail_day", day("1998-01-01"), day("1998-12-31"))["confirmed"].select("o_orderkey")


def edits(rows):
    """A change of each third order's state and priority; the rest of the maps is equal."""
    k = F.col("o_orderkey")
    new = F.when(k % 3 == 0, "X").otherwise(F.col("o_orderstatus"))
    before = F.create_map(F.lit("state"), F.col("o_orderstatus"), F.lit("priority"), F.col("o_orderpriority"), F.lit("old"), F.lit(" "))
    after = F.create_map(F.lit("state"), new, F.lit("priority"), F.when(k % 5 != 0, F.col("o_orderpriority")), F.lit("note"), F.when(k % 7 == 0, "n"))
    return rows.select("mail_day", k.alias("record_id"), before.alias("before"), after.alias("after"))


@plans.add("a19_modified_fields", """WITH o AS (SELECT *, CAST(o_orderdate AS DATE) AS d FROM orders WHERE year(o_orderdate) = 1998)
SELECT d AS mail_day, o_orderkey AS record_id, 'state' AS field, o_orderstatus AS before, 'X' AS after FROM o WHERE o_orderkey % 3 = 0
UNION ALL SELECT d, o_orderkey, 'priority', o_orderpriority, NULL FROM o WHERE o_orderkey % 5 = 0 UNION ALL SELECT d, o_orderkey, 'note', NULL, 'n' FROM o WHERE o_orderkey % 7 = 0""")
def a19_modified(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").withColumn("mail_day", F.col("o_orderdate").cast("date")).withColumn("status", F.lit("confirmed"))
    return M.export_reviewed(rows, rows, rows, edits(rows), rows, "mail_day", day("1998-01-01"), day("1998-12-31"))["modified"]


@plans.add("a21_archives", "WITH y AS (SELECT year(o_orderdate) AS y, count(*) FILTER (o_orderstatus = 'F' AND o_custkey % 50 = 0 AND year(o_orderdate) % 2 = 0) AS w FROM orders GROUP BY 1) SELECT y AS run_id FROM y WHERE w > 0")
def a21(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").withColumn("run_id", F.year("o_orderdate"))
    work = F.count_if((F.col("o_orderstatus") == "F") & (F.col("o_custkey") % 50 == 0) & (F.col("run_id") % 2 == 0))
    manifest = rows.groupBy("run_id").agg(F.min("o_orderdate").alias("low"), F.max("o_orderdate").alias("high"), F.create_map(F.lit("work"), work).alias("counts"))
    return M.list_archives(manifest).select("run_id")


@plans.add("a22_project_report", "SELECT doc_id AS mail_key, lang AS subject, text[:300] AS body, concat_ws(', ', lang, source) AS names, 'r' AS reason FROM documents")
def a22(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("mail_key"), F.col("lang").alias("subject"), F.col("text").alias("body"), F.array("lang", "source").alias("names"), F.lit("r").alias("reason"))
    return M.project_report(rows, "filtered")


@plans.add("a22_stage_view", "SELECT o_orderkey AS mail_key, 'c' || o_custkey AS company, '' AS project, CASE o_orderstatus WHEN 'F' THEN 'yes' ELSE '' END AS found, '' AS order_no, '' AS match_status, o_orderstatus AS lookup, o_orderpriority AS note FROM orders")
def a22_stage(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("mail_key"), F.concat(F.lit("c"), "o_custkey").alias("company"), F.lit(None).cast("string").alias("project"), F.when(F.col("o_orderstatus") == "F", "yes").alias("found"), F.col("o_orderstatus").alias("state"), F.col("o_orderpriority").alias("reason"))
    return M.project_report(rows, "stage")


@plans.add("a22_result_list", "SELECT l_orderkey AS mail_key, l_returnflag AS company, l_linestatus AS project, '' AS found, CAST(l_linenumber AS VARCHAR) AS order_no FROM lineitem")
def a22_result(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("mail_key"), F.col("l_returnflag").alias("company"), F.col("l_linestatus").alias("project"), F.col("l_linenumber").alias("order_no"))
    return M.project_report(rows, "result")


# Cells: the lines of conversations as sheets, a line's words as columns.

CELLS = "w AS (SELECT conv_id AS file, turn AS sheet, string_split(text, chr(10)) AS l FROM conversations), r AS (SELECT file, sheet, unnest(l) AS line, generate_subscripts(l, 1) AS row_no FROM w), c AS (SELECT file, sheet, row_no, unnest(string_split(line, ' ')) AS value, generate_subscripts(string_split(line, ' '), 1) AS col_no FROM r)"


def cells(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("file"), F.col("turn").alias("sheet"), F.posexplode(F.split("text", "\n")).alias("row_no", "line"))
    return rows.select("file", "sheet", (F.col("row_no") + 1).alias("row_no"), F.posexplode(F.split("line", " ")).alias("col_no", "value")).withColumn("col_no", F.col("col_no") + 1)


@plans.add("a12_name_columns", f"""WITH {CELLS}, h AS (SELECT file, sheet, col_no, nullif(trim(value), '') AS h FROM c WHERE row_no = 1), u AS (SELECT file, sheet, col_no, bool_or(trim(value) <> '') AS u FROM c WHERE row_no > 1 GROUP BY ALL),
b AS (SELECT file, sheet, col_no, h, row_number() OVER (PARTITION BY file, sheet, h ORDER BY col_no) AS n FROM h FULL JOIN u USING (file, sheet, col_no) WHERE h IS NOT NULL OR u)
SELECT file, sheet, col_no, CASE WHEN h IS NULL THEN 'col_' || col_no WHEN n = 1 THEN h ELSE h || '#' || n END AS name FROM b""")
def a12(spark, sf_dir):
    return C.name_columns(cells(spark, sf_dir), 1)


@plans.add("a13_checked_pairs", "WITH m AS (SELECT DISTINCT l_orderkey AS form, l_linenumber AS row_no, l_returnflag AS label, l_returnflag = 'N' AS c FROM lineitem WHERE l_linestatus = 'F') SELECT a.form, a.row_no, a.label AS country, b.label AS service, CASE WHEN b.label IS NULL THEN 'unmatched' ELSE 'pair' END AS outcome FROM (SELECT * FROM m WHERE c) a LEFT JOIN (SELECT * FROM m WHERE NOT c) b USING (form, row_no) UNION ALL SELECT form, row_no, NULL, label, 'orphan' FROM m b WHERE NOT c AND NOT EXISTS (SELECT 1 FROM m a WHERE a.c AND a.form = b.form AND a.row_no = b.row_no)")
def a13(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    marks = rows.select(F.col("l_orderkey").alias("form"), F.col("l_linenumber").alias("row_no"), F.when(F.col("l_returnflag") == "N", "country").otherwise("service").alias("kind"), F.col("l_returnflag").alias("label"), (F.col("l_linestatus") == "F").alias("checked"))
    return C.checked_pairs(marks)


def sheets(spark, sf_dir):
    """Line items as sheets: a header row, then a row per item with brand, type and size."""
    part = table(spark, sf_dir, "part")
    values = [(1, "Brand", "p_brand"), (2, "Category", "p_type"), (3, "Size", F.col("p_size").cast("string"))]
    heads = part.select(F.col("p_type").alias("file")).distinct().select("file", F.lit(1).alias("sheet"), F.lit(1).alias("row_no"), F.explode(F.array(*[F.struct(F.lit(n).alias("col_no"), F.lit(h).alias("value")) for n, h, _ in values])).alias("c"))
    body = part.select(F.col("p_type").alias("file"), F.lit(1).alias("sheet"), (F.col("p_partkey") + 2).cast("int").alias("row_no"), F.explode(F.array(*[F.struct(F.lit(n).alias("col_no"), (F.col(v) if isinstance(v, str) else v).alias("value")) for n, _, v in values])).alias("c"))
    return heads.union(body).select("file", "sheet", "row_no", "c.*")


def roles(spark):
    return spark.createDataFrame([("brand", "brand"), ("category", "category"), ("size", "size")], "label string, role string")


@plans.add("a9_sectioned_records", "WITH v AS (SELECT p_type AS file, 1 AS sheet, CAST(p_partkey + 2 AS INTEGER) AS row_no, unnest([{'role': 'brand', 'value': p_brand}, {'role': 'category', 'value': p_type}, {'role': 'size', 'value': CAST(p_size AS VARCHAR)}]) AS x FROM part) SELECT file, sheet, row_no, x.role AS role, x.value AS value FROM v")
def a9(spark, sf_dir):
    return C.sectioned_records(sheets(spark, sf_dir), roles(spark), (("brand", "category"),))


@plans.add("a10_preferred_columns", """WITH h AS (SELECT l_orderkey AS file, l_suppkey % 2 AS sheet, l_linestatus AS role, l_linenumber AS col_no, CASE l_returnflag WHEN 'R' THEN 1 WHEN 'N' THEN 2 ELSE 1000000 END AS r FROM lineitem)
SELECT file, sheet, role, arg_min(col_no, (r, col_no)) AS col_no FROM h GROUP BY file, sheet, role""")
def a10(spark, sf_dir):
    heads = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("file"), (F.col("l_suppkey") % 2).alias("sheet"), F.col("l_linenumber").alias("col_no"), F.col("l_linestatus").alias("role"), F.col("l_returnflag").alias("label"))
    return C.preferred_columns(heads, spark.createDataFrame([("R", 1), ("N", 2)], "label string, rank int"))


@plans.add("a11_label_values", """SELECT o_orderkey AS file, 1 AS sheet, x.r AS row_no, x.f AS field, x.v AS value FROM (SELECT o_orderkey, unnest([{'r': 1, 'f': 'company', 'v': 'C' || o_custkey}, {'r': 2, 'f': 'status', 'v': o_orderstatus},
{'r': 3, 'f': 'priority', 'v': o_orderpriority}, {'r': 5, 'f': 'status', 'v': 'S2'}, {'r': 5, 'f': 'priority', 'v': 'P2'}]) AS x FROM orders)""")
def a11(spark, sf_dir):
    """Each order as a sheet: a value behind a colon, one to the right of a gap, one below, and labels side by side."""
    at = lambda row, col, value: F.struct(F.lit(row).alias("row_no"), F.lit(col).alias("col_no"), value.alias("value"))
    text = F.lit
    sheet = [
        at(1, 1, F.concat(text("Company: C"), F.col("o_custkey"))), at(2, 1, text("Status")), at(2, 2, text(" ")), at(2, 4, F.col("o_orderstatus")), at(2, 5, text("too far")), at(3, 1, text("Priority：")), at(4, 1, F.col("o_orderpriority")),
        at(5, 1, text("Status")), at(5, 2, text("Priority")), at(6, 1, text("S2")), at(6, 2, text("")), at(7, 2, text("P2")), at(8, 1, text("status")), at(9, 1, text("Company")),
    ]
    cells = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("file"), F.lit(1).alias("sheet"), F.explode(F.array(*sheet)).alias("c")).select("file", "sheet", "c.*")
    labels = spark.createDataFrame([("company", "company"), ("status", "status"), ("priority", "priority")], "label string, field string")
    return C.label_values(cells, labels)


# Segments


@plans.add("f2_split_items", "WITH g AS (SELECT l_orderkey, list(l_partkey ORDER BY l_linenumber, l_partkey) AS l FROM lineitem WHERE l_returnflag <> 'A' GROUP BY 1) SELECT l_orderkey, unnest(l) AS item, CASE WHEN len(l) > 1 THEN generate_subscripts(l, 1) || '/' || len(l) END AS split_no FROM g")
def f2(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_returnflag"))).alias("items"))
    kept = F.transform(F.filter("items", lambda i: i["l_returnflag"] != "A"), lambda i: i["l_partkey"])
    return S.split_items(rows, "items", kept).where("item is not null").select("l_orderkey", "item", "split_no")


SEGMENTS = "s AS (SELECT user_id, event_id, CASE WHEN event_id % 7 = 0 THEN 'c' || event_id END AS co, CASE WHEN event_id % 3 = 0 THEN 'n' || event_id % 5 END AS na, CASE WHEN event_id % 2 = 0 THEN event_type END AS service FROM events)"


@plans.add("f4_group_segments", f"""WITH {SEGMENTS}, n AS (SELECT *, count(co) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS record_no FROM s),
c AS (SELECT *, last_value(co IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS company, last_value(na IGNORE NULLS) OVER (PARTITION BY user_id, record_no ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS country FROM n)
SELECT user_id, event_id, record_no, company, country, service FROM c WHERE service IS NOT NULL AND company IS NOT NULL""")
def f4(spark, sf_dir):
    k = F.col("event_id")
    return S.group_segments(table(spark, sf_dir, "events"), "user_id", "event_id", F.when(k % 7 == 0, F.concat(F.lit("c"), k)), F.when(k % 3 == 0, F.concat(F.lit("n"), k % 5)), F.when(k % 2 == 0, F.col("event_type")))


CHUNKS = "x AS (SELECT o_custkey AS mail, o_orderkey // 10 AS chunk, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderstatus END AS company, CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority END AS project FROM orders), c AS (SELECT DISTINCT mail, chunk, company FROM x WHERE company IS NOT NULL), p AS (SELECT DISTINCT mail, chunk, project FROM x WHERE project IS NOT NULL), i AS (SELECT DISTINCT mail, company, project FROM c JOIN p USING (mail, chunk)), u AS (SELECT mail FROM c WHERE (mail, company) NOT IN (SELECT (mail, company) FROM i) UNION SELECT mail FROM p WHERE (mail, project) NOT IN (SELECT (mail, project) FROM i))"


@plans.add("f5_map_chunks", f"WITH {CHUNKS} SELECT mail, company, project, false AS flagged FROM i WHERE mail NOT IN (SELECT mail FROM u) UNION ALL SELECT DISTINCT c.mail, company, project, true FROM c JOIN p ON c.mail = p.mail WHERE c.mail IN (SELECT mail FROM u)")
def f5(spark, sf_dir):
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("mail"), F.floor(k / 10).alias("chunk"), F.when(k % 3 != 0, F.col("o_orderstatus")).alias("company"), F.when(k % 2 == 0, F.col("o_orderpriority")).alias("project"))
    return S.map_chunks(rows, "mail", "chunk", "company", "project")


LINES = r"k AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL), x AS (SELECT doc_id, trim(unnest(l), E' \t\r\n\x0B\x0C　') AS line, generate_subscripts(l, 1) - 1 AS line_no FROM k), n AS (SELECT * FROM x WHERE line <> '')"


def doc_lines(spark, sf_dir):
    return S.lines(table(spark, sf_dir, "documents"), ["doc_id"], "text")


@plans.add("f6_numbered_list", f"WITH {LINES}, m AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n FROM n WHERE regexp_matches(line, '^[A-D]')) SELECT doc_id, line_no, n AS n_lines, n <> doc_id % 4 AS flagged FROM m WHERE n >= 2")
def f6(spark, sf_dir):
    rows = doc_lines(spark, sf_dir).withColumn("stated", F.col("doc_id") % 4)
    return S.numbered_list(rows, ["doc_id"], "^[A-D]", "stated").select("doc_id", "line_no", "n_lines", "flagged")


@plans.add("f6_numbered_projects", f"WITH {LINES}, m AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n FROM n WHERE regexp_matches(line, '^[A-D]')), p AS (SELECT doc_id, CASE WHEN contains(text, 'tion') THEN 'a' END AS a, CASE WHEN contains(text, 'heit') THEN 'b' END AS b FROM documents) SELECT m.doc_id, line_no, n AS n_lines, coalesce(a, b) AS project FROM m JOIN p ON m.doc_id = p.doc_id AND (a IS NULL) <> (b IS NULL) WHERE n >= 2")
def f6_projects(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    found = docs.select("doc_id", F.explode(F.array(F.when(F.contains("text", F.lit("tion")), "a"), F.when(F.contains("text", F.lit("heit")), "b"))).alias("project"))
    return S.numbered_list(doc_lines(spark, sf_dir), ["doc_id"], "^[A-D]", projects=found).select("doc_id", "line_no", "n_lines", "project")


@plans.add("f8_header_lines", """SELECT p_partkey, 2 AS block, i AS place, ['Brand', 'Category', 'Note'][i] AS label, [p_brand, p_name, 'n' || p_size][i] AS value FROM part, range(1, 4) r(i) WHERE p_partkey % 3 = 0
UNION ALL SELECT p_partkey, 1, i, ['Brand', 'Category'][i], [p_brand, p_type][i] FROM part, range(1, 3) r(i) WHERE p_partkey % 3 = 1""")
def f8_lines(spark, sf_dir):
    """By part key: 0 tabs below a plain line, 1 bars, 2 headers twice and too few values."""
    k = F.col("p_partkey") % 3
    tabbed = F.concat_ws("\n", F.lit("see below"), F.lit("Brand\tCategory\tNote"), F.concat_ws("\t", "p_brand", "p_name", F.concat(F.lit("n"), "p_size")))
    barred = F.concat_ws("\n", F.lit("Brand | Category"), F.concat_ws(" | ", "p_brand", "p_type"))
    rest = F.concat_ws("\n", F.lit("Brand  Category"), F.lit("Brand  Category"), F.col("p_brand"))
    rows = table(spark, sf_dir, "part").select("p_partkey", F.when(k == 0, tabbed).when(k == 1, barred).otherwise(rest).alias("text"))
    return S.header_lines(S.lines(rows, ["p_partkey"], "text"), ["p_partkey"], "line_no", F.col("cell").isin("Brand", "Category"))


@plans.add("f7_scope_lines", f"""WITH {LINES}, f AS (SELECT *, contains(line, 'the') AS mine, contains(line, 'ing') AND NOT contains(line, 'the') AS other, contains(line, 'an') AS lab FROM n),
o AS (SELECT *, coalesce(last_value(CASE WHEN mine THEN true WHEN other THEN false END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING), false) AS open FROM f) SELECT doc_id, line_no FROM o WHERE mine OR (open AND lab AND NOT other)""")
def f7(spark, sf_dir):
    line = F.col("line")
    mine, other = F.contains(line, F.lit("the")), F.contains(line, F.lit("ing")) & ~F.contains(line, F.lit("the"))
    return S.scope_lines(doc_lines(spark, sf_dir), ["doc_id"], "line_no", mine, other, F.contains(line, F.lit("an"))).select("doc_id", "line_no")


QUERIES["f8_header_blocks"] = lambda spark, sf_dir: S.header_blocks(doc_lines(spark, sf_dir), ["doc_id"], "line_no", F.length("line") < 40)


ORACLES["f8_header_blocks"] = f"""WITH {LINES}, h AS (SELECT *, len(line) < 40 AS h, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS no FROM n), g AS (SELECT *, no - row_number() OVER (PARTITION BY doc_id, h ORDER BY line_no) AS island FROM h),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, h, island ORDER BY line_no) AS place, count(*) OVER (PARTITION BY doc_id, h, island) AS size, min(no) OVER (PARTITION BY doc_id, h, island) AS start FROM g)
SELECT a.doc_id, a.start AS block, a.place, a.line AS label, b.line AS value FROM r a JOIN r b ON a.doc_id = b.doc_id AND a.place = b.place AND b.start = a.start + a.size WHERE a.h AND NOT b.h AND a.size >= 2 AND b.size >= a.size"""


@plans.add("f9_zip_by_position", "SELECT item_id, list_transform(range(1, greatest(len(a), len(b)) + 1), lambda i: {'brand': a[i], 'category': b[i]}) AS v FROM (SELECT item_id, string_split(text, ' ')[:item_id % 4 + 1] AS a, string_split(text, ' ')[3:5] AS b FROM benchmark)")
def f9(spark, sf_dir):
    words = F.split("text", " ")
    return table(spark, sf_dir, "benchmark").select("item_id", S.zip_by_position(F.slice(words, F.lit(1), (F.col("item_id") % 4 + 1).cast("int")), F.slice(words, 3, 3)).alias("v"))


@plans.add("f12_fit_budget", """WITH p AS (SELECT user_id, event_type, event_id, len(props) AS size, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id % 5 = 0 DESC, event_id) AS place FROM events),
t AS (SELECT *, sum(size) OVER (PARTITION BY user_id ORDER BY place RANGE UNBOUNDED PRECEDING) AS total FROM p) SELECT event_id, place FROM t WHERE total <= 200""")
def f12(spark, sf_dir):
    return S.fit_budget(table(spark, sf_dir, "events"), ["user_id"], "event_type", F.length("props"), F.col("event_id") % 5 == 0, "event_id", 200).select("event_id", "place")


# Audits

#: A small dictionary for the parts' names, with one exclusion.
DICTIONARY = (("1", "red", False), ("2", "blue gear", False), ("2", "small", True), ("3", "ring", False), ("4", "large", False), ("5", "widget", False), ("6", "bolt", False), ("6", "gizmo", False), ("5", "gizmo", False))


def dictionary(spark):
    return spark.createDataFrame(DICTIONARY, "class string, term string, is_exclusion boolean")


TERMS = "VALUES " + ", ".join(f"('{c}', '{t.replace(' ', '')}', {str(x).lower()})" for c, t, x in DICTIONARY)


@plans.add("j6_classify_category", f"""WITH d(class, term, no) AS ({TERMS}), b AS (SELECT p_partkey, p_name, replace(lower(p_name), ' ', '') AS t, CASE WHEN p_size % 4 = 0 THEN p_size * 2.0 ELSE 0 END AS cm FROM part),
h AS (SELECT p_partkey, class, max(CASE WHEN NOT no THEN CASE WHEN len(term) <= 1 THEN 2 WHEN len(term) = 2 THEN CASE WHEN term = t THEN 12 ELSE 6 END WHEN len(term) <= 4 THEN greatest(3 * len(term), 12) ELSE 3 * len(term) END END) AS score, bool_or(no) AS no FROM b JOIN d ON contains(t, term) GROUP BY p_partkey, class),
g AS (SELECT p_partkey, class, score FROM h WHERE NOT no AND score IS NOT NULL), s AS (SELECT g.*, score >= 12 AND score > 1.35 * coalesce((SELECT max(score) FROM g o WHERE o.p_partkey = g.p_partkey AND o.class <> g.class), 0) AS strong FROM g),
a AS (SELECT p_partkey, list(class ORDER BY score DESC, class) AS candidates, max(score) AS top, bool_or(strong AND class = '1') AS s1, bool_or(strong AND class = '2') AS s2, bool_or(strong AND class = '3') AS s3, bool_or(strong AND class = '4') AS s4, bool_or(strong AND class = '5') AS s5, bool_or(strong AND class = '6') AS s6 FROM s GROUP BY 1),
r AS (SELECT b.p_partkey, coalesce(candidates, []) AS candidates, top, CASE WHEN s1 THEN '1' WHEN s2 THEN '2' WHEN s3 THEN '3' WHEN s4 THEN '4' WHEN cm > 0 THEN CASE WHEN cm > 50 THEN '4' WHEN s6 THEN '6' ELSE '5' END WHEN s6 THEN '6' WHEN s5 THEN '5' END AS k FROM b LEFT JOIN a ON a.p_partkey = b.p_partkey)
SELECT p_partkey, CASE WHEN k IS NOT NULL THEN 'matched' WHEN top >= 8 THEN 'ambiguous' ELSE 'unmatched' END AS status, coalesce(k, '') AS category_class, candidates FROM r""")
def j6(spark, sf_dir):
    rows = table(spark, sf_dir, "part").withColumn("size", F.when(F.col("p_size") % 4 == 0, F.concat(F.col("p_size") * 2, F.lit(" cm"))))
    return A.classify_category(rows, ["p_partkey"], "p_name", "size", dictionary(spark))


@plans.add("j7_exactly_one", "SELECT p_partkey, CASE WHEN (contains(p_name, 'ring'))::INT + contains(p_name, 're')::INT + contains(p_name, 'blue')::INT = 1 THEN CASE WHEN contains(p_name, 'ring') THEN 'r' WHEN contains(p_name, 're') THEN 'e' ELSE 'b' END ELSE '' END AS v FROM part")
def j7(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", A.classify_exactly_one(F.col("p_name"), {"r": "ring", "e": "re", "b": "blue"}).alias("v"))


VALUES = (" ", "Unknown", "a@b.de", "+49 30 1234", "AB-12345", "Max Meier", "form.pdf", "Please send", "Sea Trade Ltd", "德国WEEE EG0001 Sea Trade Ltd", "不能与其它公司", "2家公司-x", "ab\tcde", "EG-0001 Sea Trade Ltd")
KINDS = ("FIELD_MISSING", "COMPANY_PLACEHOLDER", "COMPANY_EMAIL", "COMPANY_CONTACT_OR_ID", "COMPANY_CODE_ONLY", "COMPANY_PERSON_NAME", "COMPANY_FILENAME", "COMPANY_SENTENCE", "COMPANY_EQUALS_AGENT", "COMPANY_CODE_MIXED", "COMPANY_FORM_NOTE", "COMPANY_PLACEHOLDER", "COMPANY_CONTROL_CHAR", "COMPANY_CODE_MIXED")
LIST = "[" + ", ".join("'" + v.replace("\t", "' || chr(9) || '") + "'" for v in VALUES) + "]"
CASES = f"d AS (SELECT o_orderkey AS k, {LIST}[o_orderkey % 14 + 1] AS company, CASE WHEN o_orderkey % 4 = 0 THEN 'TBD' ELSE 'agent' END AS agent, CASE WHEN o_orderstatus = 'P' THEN '' ELSE o_orderpriority END AS project, o_orderkey % 6 <> 0 AS matched, CASE WHEN o_orderkey % 5 = 0 THEN 'ask' ELSE 'register' END AS request FROM orders)"
CODES = f"list_filter([CASE WHEN k % 14 <> 8 OR k % 3 = 0 THEN {list(KINDS)}[k % 14 + 1] END, CASE WHEN agent = 'TBD' THEN 'AGENT_PLACEHOLDER' END, CASE WHEN project = '' THEN 'FIELD_MISSING' WHEN NOT matched THEN 'PROJECT_UNMATCHED' WHEN project NOT LIKE '%-%O%' THEN 'PROJECT_UNSUPPORTED' END, CASE WHEN request <> 'register' THEN 'INTENT_UNCERTAIN' END], lambda x: x IS NOT NULL)"


def cases(spark, sf_dir):
    k = F.col("o_orderkey")
    values = F.array(*[F.lit(v) for v in VALUES])
    rows = table(spark, sf_dir, "orders").select(k.alias("k"), F.element_at(values, (k % 14 + 1).cast("int")).alias("company"), F.when(k % 4 == 0, "TBD").otherwise("agent").alias("agent"), F.when(F.col("o_orderstatus") == "P", "").otherwise(F.col("o_orderpriority")).alias("project"), (k % 6 != 0).alias("matched"), F.when(k % 5 == 0, "ask").otherwise("register").alias("request"), F.lit("medium").alias("confidence"), F.lit("").alias("hint"))
    return A.validate(rows, {n: n for n in ("company", "agent", "project", "matched", "request")}, ("register", "add"), "-.*O", Words(placeholders=("unknown",), starts=("Please",)), ("tbd",), F.col("k") % 3 == 0)


@plans.add("j8_validate", f"WITH {CASES} SELECT k, {CODES} AS codes FROM d")
def j8(spark, sf_dir):
    return cases(spark, sf_dir).select("k", F.transform("issues", lambda i: i["code"]).alias("codes"))


@plans.add("j9_agent_as_company", "SELECT p_partkey, p_partkey % 3 <> 2 AS v FROM part")
def j9(spark, sf_dir):
    k = F.col("p_partkey") % 3
    names = F.when(k == 1, F.array(F.lit("Big One"), F.lit("")))
    company = F.when(k == 0, F.upper("p_name")).otherwise(F.lit("big-1"))
    agent = F.when(k == 1, F.lit("BIG ONE")).otherwise(F.col("p_name"))
    return table(spark, sf_dir, "part").select("p_partkey", A.agent_as_company(company, agent, names, F.lit(None).cast("array<string>")).alias("v"))


@plans.add("j10_apply_guard", f"WITH {CASES}, e AS (SELECT k, {CODES} AS c FROM d) SELECT k, CASE WHEN len(c) > 0 THEN 'review' ELSE 'passed' END AS rule_status, array_to_string(list_filter(c, lambda x, i: list_position(c, x) = i), '、') AS rule_codes, CASE WHEN len(c) > 0 THEN 'manual' ELSE 'medium' END AS confidence FROM e")
def j10(spark, sf_dir):
    return A.apply_guard(cases(spark, sf_dir), "confidence", "hint").select("k", "rule_status", "rule_codes", "confidence")


@plans.add("j30_recheck_company", f"WITH {CASES}, e AS (SELECT k, {CODES} AS c FROM d) SELECT k, list_filter(c, lambda x: starts_with(x, 'COMPANY')) AS codes FROM e")
def j30(spark, sf_dir):
    return cases(spark, sf_dir).select("k", F.transform(A.recheck_company(F.col("issues")), lambda i: i["code"]).alias("codes"))


@plans.add("j11_confidence", "SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' WHEN 2 THEN 'high' ELSE 'low' END AS v FROM orders")
def j11(spark, sf_dir):
    k = F.col("o_orderkey") % 4
    v = A.confidence(F.when(k == 0, "multi match"), F.lit("a"), F.when(k.isin(0, 2), "b"), F.when(k != 3, "c"))
    return table(spark, sf_dir, "orders").select("o_orderkey", v.alias("v"))


REASONS = (("no", "not looked up yet"), ("no", "by hand"), ("no", "filtered"), ("no", "skipped"), ("no", "timeout"), ("no", "several candidates"), ("no", "date differs"), ("no", "items missing"), ("no", "items pending"), ("yes", ""), ("no", "no order found"), ("no", "unclear"))


@plans.add("j17_outcome_reason", f"SELECT o_orderkey, {[r for r, _ in REASONS]}[o_orderkey % 12 + 1] AS recorded, {[w for _, w in REASONS]}[o_orderkey % 12 + 1] AS reason FROM orders".replace('"', "'"))
def j17(spark, sf_dir):
    k = F.col("o_orderkey") % 12
    pick = lambda **at: F.coalesce(*[F.when(k == int(n[1:]), F.lit(v)) for n, v in at.items()])
    state = F.coalesce(pick(k0="stage1_pending", k1="stage1_review", k2="stage1_filtered", k3="skipped"), F.lit("done"))
    match = pick(k5="multi match", k6="date differs")
    found = F.coalesce(pick(k10="no", k11="open"), F.lit("yes"))
    v = A.outcome_reason(state, pick(k4="lookup failed"), match, found, k.isin(7, 8), pick(k7="missing"), pick(k1="by hand", k4="timeout"))
    return table(spark, sf_dir, "orders").select("o_orderkey", v.alias("v")).select("o_orderkey", "v.*")


@plans.add("j18_report_rows", """WITH i AS (SELECT l_orderkey, p_type AS category, p_brand AS brand, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate) - 1 AS place FROM lineitem JOIN part ON p_partkey = l_partkey),
d AS (SELECT l_orderkey, category, brand, min(place) AS place FROM i GROUP BY ALL) SELECT l_orderkey, CAST(place AS INTEGER) AS place, category, brand AS brands FROM i WHERE l_orderkey % 2 = 0 UNION ALL SELECT l_orderkey, CAST(min(place) AS INTEGER), category, string_agg(brand, '、' ORDER BY place) FROM d WHERE l_orderkey % 2 <> 0 GROUP BY l_orderkey, category""")
def j18(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    items = rows.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", F.col("p_type").alias("category"), F.col("p_brand").alias("brand")))).alias("items"))
    return A.report_rows(items, "l_orderkey", "items", F.col("l_orderkey") % 2 == 0)


@plans.add("j20_bind_applicants", """WITH s AS (SELECT l_orderkey AS file, l_linenumber AS s, l_linenumber // 2 AS g, bool_or(l_linestatus = 'F') AS o, bool_or(l_linestatus = 'O') AS t FROM lineitem GROUP BY ALL),
j AS (SELECT file, g, count(*) FILTER (o) = 2 OR count(*) FILTER (t) = 2 AS one FROM s GROUP BY ALL),
r AS (SELECT s.file, s, CASE WHEN one THEN -s.g - 1 ELSE s END AS k, CASE WHEN o THEN 'Name ' || s.g ELSE 'Other ' || s.g END AS name, CASE WHEN o AND t THEN 'Other ' || s.g END AS alias FROM s JOIN j ON s.file = j.file AND s.g = j.g)
SELECT file, first(name ORDER BY alias IS NULL, s) AS name, first(alias ORDER BY alias IS NULL, s) AS alias, list(s ORDER BY s) AS sheets FROM r GROUP BY file, k""")
def j20(spark, sf_dir):
    """Line numbers as sheets: two in a row name the same applicant, in its own language or another."""
    pair = F.floor(F.col("l_linenumber") / 2)
    own = F.col("l_linestatus") == "F"
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("file"), F.col("l_linenumber").alias("sheet"), F.concat(F.when(own, "Name ").otherwise("Other "), pair).alias("name"), F.lit(1).alias("priority"), F.when(own, "own").otherwise("en").alias("lang"))
    return A.bind_applicants(rows, "file", "sheet", "name", "priority", "lang")


@plans.add("j20_applicant_chains", """WITH s AS (SELECT l_orderkey AS file, l_linenumber AS s, bool_or(l_quantity > 15) AS two FROM lineitem GROUP BY ALL),
p AS (SELECT *, coalesce(lag(two) OVER w AND lag(s) OVER w = s - 1, false) AS goes_on FROM s WINDOW w AS (PARTITION BY file ORDER BY s)),
g AS (SELECT *, count(*) FILTER (NOT goes_on) OVER (PARTITION BY file ORDER BY s) AS g FROM p)
SELECT file, 'Sea ' || first(s ORDER BY NOT two, s) AS name, CASE WHEN bool_or(two) THEN 'Sea ' || (min(s) FILTER (two) + 1) END AS alias, list(s ORDER BY s) AS sheets FROM g GROUP BY file, g""")
def j20_chains(spark, sf_dir):
    """Line numbers as sheets: some also name the next one's applicant, which chains sheets of any number."""
    lines = table(spark, sf_dir, "lineitem")
    at = [F.col("l_orderkey").alias("file"), F.col("l_linenumber").alias("sheet")]
    own = lines.select(*at, F.concat(F.lit("Sea "), "l_linenumber").alias("name"), F.lit(1).alias("priority"), F.lit("own").alias("lang"))
    next_one = lines.where("l_quantity > 15").select(*at, F.concat(F.lit("SEA "), F.col("l_linenumber") + 1).alias("name"), F.lit(1).alias("priority"), F.lit("en").alias("lang"))
    out = A.bind_applicants(own.union(next_one), "file", "sheet", "name", "priority", "lang")
    return out.withColumn("alias", F.initcap("alias"))


@plans.add("j20_bind_projects", """SELECT o_orderkey AS mail, 'f' || o_orderkey AS file, 'Sea ' || o_custkey AS name,
CASE o_orderkey % 6 WHEN 0 THEN 'form p' WHEN 1 THEN 'group p' WHEN 2 THEN 'group p' WHEN 3 THEN 'file p' WHEN 4 THEN 'declared p' END AS project, ['form', 'group', 'group', 'file', 'declared', 'none'][o_orderkey % 6 + 1] AS source FROM orders""")
def j20_projects(spark, sf_dir):
    """By order key: 0 has all sources, 1 to 4 lack the first ones, 5 has two declared projects only."""
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(k.alias("mail"), F.concat(F.lit("f"), k).alias("file"), F.concat(F.lit("Sea "), "o_custkey").alias("name"), F.when(k % 6 == 2, F.concat(F.lit("Other "), "o_custkey")).alias("alias"))
    up_to = lambda n: rows.where(F.col("mail") % 6 <= n)
    forms, files = up_to(0).select("file", F.lit("form p").alias("project")), up_to(3).select("file", F.lit("file p").alias("project"))
    groups = up_to(2).select("mail", F.upper(F.coalesce("alias", "name")).alias("company"), F.lit("group p").alias("project"))
    declared = rows.select("mail", F.explode(F.when(F.col("mail") % 6 == 5, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("declared p")))).alias("project"))
    return A.bind_projects(rows, "file", forms, groups, files, declared, "mail")


QUERIES["j21_rule_projects"] = lambda spark, sf_dir: A.rule_projects(table(spark, sf_dir, "part"), "p_partkey", "p_name", table(spark, sf_dir, "part").select(F.substring_index("p_name", " ", 1).alias("name"), F.substring_index("p_name", " ", 1).alias("alias")).distinct(), table(spark, sf_dir, "part").select(F.substring_index("p_name", " ", -1).alias("name"), F.substring_index("p_name", " ", -1).alias("alias")).distinct())
ORACLES["j21_rule_projects"] = "SELECT p_partkey, split_part(p_name, ' ', 1) AS country, split_part(p_name, ' ', 2) AS service FROM part"


@plans.add("j22_items_of_tables", """WITH v AS (SELECT p_partkey, p_partkey % 4 AS m FROM part)
SELECT p_partkey, 'Z' || p_partkey AS brand, 'red lamp' AS category, 'table' AS source, 1::BIGINT AS mentions, 'matched' AS status, '1' AS category_class FROM v WHERE m IN (0, 1) UNION ALL SELECT p_partkey, 'Second', 'ring', 'table', 1, 'matched', '3' FROM v WHERE m IN (0, 1)
UNION ALL SELECT p_partkey, 'Labelled', 'bolt', 'text', 1, 'matched', '6' FROM v WHERE m = 2""")
def j22_tables(spark, sf_dir):
    """By part key: a table between bars, one between tabs with a third column, labels that beat a table, no table."""
    m, brand = F.col("p_partkey") % 4, F.concat(F.lit("Z"), "p_partkey")
    bars = F.concat(F.lit("we ask for\n| Brand | Category |\n| "), brand, F.lit(" | red lamp |\nSecond | ring\nthanks\nThird | bolt"))
    tabs = F.concat(F.lit("No\tCategory\tBrand\n1\tred lamp\t"), brand, F.lit("\n2\tring\tSecond\nTotal\t2\n3\tbolt\tThird"))
    text = F.when(m == 0, bars).when(m == 1, tabs).when(m == 2, "Brand: Labelled\nCategory: bolt\nBrand | Category\nx | y").otherwise("Brand | Colour\nx | y")
    rows = table(spark, sf_dir, "part").select("p_partkey", text.alias("text"))
    return A.extract_items(rows.limit(0).select("p_partkey", F.lit("").alias("brand"), F.lit("").alias("category")), rows, "p_partkey", dictionary(spark))


@plans.add("j22_extract_items", """WITH v AS (SELECT p_partkey, p_partkey % 6 AS m, p_brand FROM part)
SELECT p_partkey, p_brand AS brand, 'red item' AS category, 'record' AS source, 2::BIGINT AS mentions, 'matched' AS status, '1' AS category_class FROM v WHERE m = 0
UNION ALL SELECT p_partkey, unnest(['Zed', 'Yak']), 'red lamp', 'text', 1, 'matched', '1' FROM v WHERE m = 1
UNION ALL SELECT p_partkey, 'Zed', 'class 3', 'text', 1, 'matched', '3' FROM v WHERE m = 2
UNION ALL SELECT p_partkey, 'A1', 'ring', 'text', 1, 'matched', '3' FROM v WHERE m = 3 UNION ALL SELECT p_partkey, 'B2', 'bolt', 'text', 1, 'matched', '6' FROM v WHERE m = 3
UNION ALL SELECT p_partkey, NULL, 'gizmo', 'text', 1, 'ambiguous', '' FROM v WHERE m = 5""")
def j22(spark, sf_dir):
    """By part key: 0 has two records of one item and a text that doesn't count, 1 to 5 only texts, 4 without items."""
    part = table(spark, sf_dir, "part")
    texts = ("Brand: not used", "Brand: Zed, Yak\nCategory: red lamp", "we add brand Zed class 3", "Brand: A1, B2; Category: ring, bolt", "nothing at all", "Category: gizmo")
    rows = part.select("p_partkey", F.element_at(F.array(*[F.lit(t) for t in texts]), (F.col("p_partkey") % 6 + 1).cast("int")).alias("text"))
    records = part.where("p_partkey % 6 = 0").select("p_partkey", F.col("p_brand").alias("brand"), F.explode(F.array(F.lit("red item"), F.lit("Red-item"))).alias("category"))
    found = A.extract_items(records.union(part.where("p_partkey % 6 = 1").select("p_partkey", F.lit(" "), F.lit(None))), rows, "p_partkey", dictionary(spark))
    return found.withColumn("category", F.when(F.col("source") == "record", F.lower(F.translate("category", "-", " "))).otherwise(F.col("category")))


@plans.add("j23_repair_company", """SELECT o_orderkey, CASE o_orderkey % 8 WHEN 0 THEN 'Sea' || o_custkey || ' Trade Ltd' WHEN 1 THEN 'Sun Trade GmbH' WHEN 2 THEN 'Old Mill Ltd' WHEN 3 THEN 'Blue Sea Ltd' WHEN 4 THEN 'Sea Trade Ltd' WHEN 5 THEN 'Own Ltd' WHEN 6 THEN '深圳太阳有限公司' END AS company,
['body', 'body', 'subject', 'file', 'split', 'own', 'record', NULL][o_orderkey % 8 + 1] AS company_source FROM orders""")
def j23(spark, sf_dir):
    """By order key: a label in the body, a label over its value, the subject, a file's name, a code in front, its own, the
    located record (the agent's name in front), nothing."""
    k = F.col("o_orderkey")
    m = k % 8
    rows = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.when(m == 3, "tbd").when(m == 4, "AB-1234 Sea Trade Ltd").when(m == 5, "Own Ltd").when(m != 2, " ").alias("company"),
        F.when(m == 0, F.concat(F.lit("dear all\nCompany: Sea"), F.col("o_custkey"), F.lit(" Trade Ltd\nbye"))).when(m == 1, "Company name:\n\nSun Trade GmbH").when(m == 6, "company: Wrong Ltd").otherwise("hello").alias("body"),
        F.when(m == 2, "register Old Mill Ltd now").otherwise("hi").alias("subject"), F.when(m == 3, F.array(F.lit("de-Blue Sea Ltd-form.pdf"))).alias("files"), F.concat(F.lit("f"), k).alias("file"), F.lit("Acme").alias("agent"),
    )
    records = rows.where("o_orderkey % 8 = 6").select("file", F.lit("Acme深圳太阳有限公司").alias("company")).union(rows.where("o_orderkey % 8 = 7").select("file", F.explode(F.array(F.lit("A One Ltd"), F.lit("B Two Ltd")))))
    found = A.company_evidence(rows, "o_orderkey", "body", "subject", "files").unionByName(A.located_records(rows, records, "o_orderkey", ["file"], "agent"))
    return A.repair_company(rows, found, "o_orderkey", "company").select("o_orderkey", "company", "company_source")


@plans.add("j24_snapshot_guard", "SELECT o_orderkey, o_orderkey % 5 > 2 AND o_orderstatus <> 'F' AND o_custkey % 2 = 0 AS v FROM orders")
def j24(spark, sf_dir):
    v = A.snapshot_guard(F.col("o_orderkey") % 5, F.lit(2), F.col("o_orderstatus") == "F", F.col("o_custkey") % 2, F.lit(True), F.lit(True))
    return table(spark, sf_dir, "orders").select("o_orderkey", v.alias("v"))


@plans.add("j25_attach_suggestions", "SELECT p_partkey, CASE WHEN p_size % 3 <> 0 AND p_partkey % 2 = 0 THEN ['1', p_type] ELSE ['1'] END AS candidates FROM part")
def j25(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", F.element_at(F.array(F.lit("matched"), F.lit("ambiguous"), F.lit("unmatched")), (F.col("p_size") % 3 + 1).cast("int")).alias("status"), F.array(F.lit("1")).alias("candidates"))
    offered = table(spark, sf_dir, "part").where("p_partkey % 2 = 0").select("p_partkey", F.col("p_type").alias("suggested_class"))
    return A.attach_suggestions(rows, offered, "p_partkey").select("p_partkey", "candidates")


@plans.add("j26_accept_reextraction", "SELECT p_partkey, CASE WHEN p_partkey % 3 <> 0 AND p_partkey % 2 = 0 THEN p_brand ELSE p_type END AS value, CASE WHEN p_partkey % 3 = 0 THEN 'rule' WHEN p_partkey % 2 = 0 THEN 'fresh' ELSE 'rule, unproven' END AS origin FROM part")
def j26(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    old = part.select("p_partkey", F.col("p_type").alias("value"))
    new = part.select("p_partkey", F.col("p_brand").alias("value"), F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("has "), F.lower("p_brand"))).otherwise("nothing").alias("source"))
    review = part.select("p_partkey", F.when(F.col("p_partkey") % 3 == 0, "valid").otherwise("unsure").alias("verdict"), F.lit("high").alias("confidence"))
    return A.accept_reextraction(old, new, review, "p_partkey", "value", "source")


@plans.add("j27_item_set_status", "WITH g AS (SELECT l_orderkey, bool_and(l_returnflag <> 'A' AND l_linestatus <> 'O') AS ok FROM lineitem GROUP BY 1) SELECT o_orderkey AS owner, CASE WHEN ok THEN 'ready' ELSE 'pending' END AS item_status FROM orders LEFT JOIN g ON l_orderkey = o_orderkey")
def j27(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("owner"), F.when(F.col("l_returnflag") != "A", F.col("l_returnflag")).alias("category"), F.when(F.col("l_linestatus") == "O", "unmatched").otherwise("matched").alias("s"))
    return A.item_set_status(rows, table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("owner")), "owner", "category", "s")


@plans.add("j28_quarantine_company", f"WITH {CASES}, q AS (SELECT k, company, k % 14 IN (0, 2, 3, 4, 5, 6, 10, 11, 12) AS bad FROM d) SELECT k, CASE WHEN bad THEN company END AS company_original, bad AS quarantined, CASE WHEN bad THEN '' ELSE company END AS company FROM q")
def j28(spark, sf_dir):
    rows = cases(spark, sf_dir).select("k", "company")
    return A.quarantine_company(rows, "company", company_noise(F.col("company"))).select("k", "company_original", "quarantined", "company")


@plans.add("j29_sanitize_groups", f"WITH {CASES} SELECT k, CASE WHEN k % 14 = 12 THEN 'cde' ELSE trim(company) END AS company, trim(company) = '' AS flagged FROM d WHERE NOT starts_with(lower(company), 'please')")
def j29(spark, sf_dir):
    return A.sanitize_groups(cases(spark, sf_dir).select("k", "company"), "company", ("please",))
