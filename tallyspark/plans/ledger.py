"""Resolution and ledger operators over events, orders, parts and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyspark.functions.text import distinct_by
from tallyspark.operators import ledger as L
from tallyspark.operators import audit as A
from tallyspark.operators import resolve as R

from .base import Plans, table

plans = Plans()
QUERIES, ORACLES = plans.queries, plans.oracles

ADDRESSES = r"a AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[A-Za-z0-9_.+-]+@[A-Za-z0-9_.-]+\.[A-Za-z]{2,}')) AS email FROM documents)"


def addresses(spark, sf_dir):
    from tallyspark.functions.text import all_addresses

    return table(spark, sf_dir, "documents").select(F.explode(all_addresses(F.col("text"))).alias("email")).distinct()


def directory(spark, sf_dir):
    return addresses(spark, sf_dir).withColumn("agent", F.concat(F.lit("agent "), F.length("email") % 7))


DIRECTORY = ADDRESSES + ", d AS (SELECT email, 'agent ' || len(email) % 7 AS agent FROM a)"


@plans.add("d1_lookup_exact", f"WITH {DIRECTORY} SELECT email, CASE WHEN len(email) % 2 = 0 THEN agent END AS agent FROM d")
def d1(spark, sf_dir):
    known = directory(spark, sf_dir).where(F.length("email") % 2 == 0)
    return R.lookup_exact(addresses(spark, sf_dir).withColumn("email", F.upper("email")), "email", known).select(F.lower("email").alias("email"), "agent")


@plans.add("a6_directory_load", "SELECT lower(p_brand) || '@x.org' AS email, arg_max(p_name, p_partkey) AS agent FROM part GROUP BY p_brand UNION ALL SELECT 'all@x.org', arg_max(p_name, p_partkey) FROM part")
def a6(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(F.concat("p_brand", F.lit("@X.org; ALL@x.org；")).alias("mails"), "p_name", "p_partkey")
    return R.load_directory(rows, "mails", "p_name", "p_partkey").withColumnRenamed("p_name", "agent")


ALIASES = "i AS (SELECT lower(split_part(text, ' ', 1)) AS alias, list_sort(list(DISTINCT 'o' || item_id % 3)) AS officials FROM benchmark WHERE len(split_part(text, ' ', 1)) >= 3 GROUP BY 1)"


def aliases(spark, sf_dir):
    first = F.lower(F.substring_index("text", " ", 1))
    rows = table(spark, sf_dir, "benchmark").select(first.alias("alias"), F.concat(F.lit("o"), F.col("item_id") % 3).alias("o")).where("length(alias) >= 3")
    return rows.groupBy("alias").agg(F.array_sort(F.collect_set("o")).alias("officials"))


@plans.add("d2_alias_match", rf"""WITH {ALIASES}, t AS (SELECT doc_id, lower(text) AS t, chr(1) || regexp_replace(lower(text), '[\s\x0B,，;；:：/|()（）_-]', chr(1), 'g') AS m FROM documents),
n AS (SELECT *, chr(1) || regexp_replace(alias, '[\s\x0B,，;；:：/|()（）_-]', chr(1), 'g') AS name FROM i),
h AS (SELECT doc_id, alias, officials, least(CASE WHEN position(alias IN t) BETWEEN 1 AND 8 THEN position(alias IN t) END, nullif(position(name IN m), 0)) AS pos FROM t JOIN n ON contains(t, alias) OR contains(m, name)),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos, len(alias) DESC, encode(alias)) AS no FROM h WHERE pos IS NOT NULL)
SELECT doc_id, alias, array_to_string(officials, '、') AS officials, pos AS "at", len(officials) > 1 AS ambiguous FROM r WHERE no = 1""")
def d2(spark, sf_dir):
    return R.match_alias(table(spark, sf_dir, "documents"), "text", ["doc_id"], aliases(spark, sf_dir))


@plans.add("d3_unique_by_domain", f"WITH {DIRECTORY}, g AS (SELECT split_part(email, '@', 2) AS domain, min(agent) AS agent, count(DISTINCT agent) AS n FROM d GROUP BY 1) SELECT domain, agent FROM g WHERE n = 1 AND domain <> 'mail1.example.com'")
def d3(spark, sf_dir):
    return R.unique_by_domain(directory(spark, sf_dir), ["mail1.example.com"])


@plans.add("d4_resolve", "SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN NULL WHEN o_orderkey % 2 = 0 THEN 'exact' WHEN o_orderkey % 3 = 0 THEN 'alias' END AS agent, CASE WHEN o_orderkey % 10 = 0 THEN 'conflict' WHEN o_orderkey % 2 = 0 THEN 'directory' WHEN o_orderkey % 3 = 0 THEN 'subject' ELSE 'none' END AS method FROM orders")
def d4(spark, sf_dir):
    k = F.col("o_orderkey")
    value, method = R.resolve([("directory", F.when(k % 2 == 0, "exact")), ("subject", F.when(k % 3 == 0, "alias").otherwise(" "))], k % 10 == 0)
    return table(spark, sf_dir, "orders").select("o_orderkey", value.alias("agent"), method.alias("method"))


AGENTS = ("Agent One", None, "Agent Two", None, "Agent Two", "Agent Two", "Agent Three", "Agent Two", None, None, None, "Agent One")
METHODS = ("exact", "conflict", "subject", "ambiguous", "body", "body", "signature", "fuzzy", "none", "fuzzy_unsure", "fuzzy_unsure", "subject")
NEAR_AGENTS = "CASE o_orderkey % 12 WHEN 1 THEN ['Agent Two'] WHEN 3 THEN ['Agent One', 'Agent Two'] WHEN 9 THEN ['Agent One'] WHEN 10 THEN ['Agent Four'] ELSE [] END"


@plans.add("d4_resolve_agents", f"""SELECT o_orderkey, {[a or '' for a in AGENTS]}[o_orderkey % 12 + 1] AS agent, {list(METHODS)}[o_orderkey % 12 + 1] AS method, {NEAR_AGENTS} AS candidates FROM orders""")
def d4_agents(spark, sf_dir):
    """By order key: each kind of evidence; a domain that disagrees with the subject, one that settles it and one that
    says nothing by itself; addresses like one other, like two and like one not well enough; and none."""
    m = F.col("o_orderkey") % 12
    senders = ("A <A@one.org>", "new@one.org", "new@two.org", "x@else.org", "x@one.org", "x@else.org", "x@else.org", "cc@two.org", None, "sale@shop.org", "d@quartzmill.net", "q@one.org")
    sender = F.element_at(F.array(*[F.lit(s) for s in senders]), (m + 1).cast("int"))
    subject = F.when(m == 1, "order for acme now").when(m.isin(2, 3, 11), "all of it: shared goods").when(m == 0, "acme").otherwise("hello")
    body = F.when(m.isin(4, 5), F.concat(F.lit("write to nobody@no.org or C@two.org, order "), "o_orderkey")).when(m == 6, "hello\nregards\n\nzed team")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", sender.alias("sender"), subject.alias("subject"), body.alias("body"))
    listed = [("a@one.org", "Agent One"), ("b@one.org", "Agent One"), ("c@two.org", "Agent Two"), ("d@mail.com", "Agent Three"), ("sales@shop.org", "AGENT ONE"), ("sale2@shop.org", "Agent One"), ("f@quartzmall.net", "Agent Four")]
    directory = spark.createDataFrame(listed, "email string, agent string")
    aliases = spark.createDataFrame([("acme", ["Agent Two"]), ("shared", ["Agent One", "Agent Two"]), ("zed", ["Agent Three"])], "alias string, officials array<string>")
    return R.resolve_agents(rows, "o_orderkey", "sender", "subject", "body", directory, aliases, ["mail.com"]).withColumn("agent", F.coalesce("agent", F.lit("")))


@plans.add("d5_body_addresses", rf"WITH {DIRECTORY}, x AS (SELECT doc_id, regexp_extract_all(lower(text), '[A-Za-z0-9_.+-]+@[A-Za-z0-9_.-]+\.[A-Za-z]{{2,}}') AS l FROM documents), e AS (SELECT doc_id, unnest(l) AS email, generate_subscripts(l, 1) AS pos FROM x) SELECT doc_id, arg_min(e.email, pos) AS email, arg_min(agent, pos) AS agent FROM e JOIN d USING (email) WHERE len(email) % 2 = 0 GROUP BY doc_id")
def d5(spark, sf_dir):
    return R.lookup_body_addresses(table(spark, sf_dir, "documents"), "doc_id", F.col("text"), directory(spark, sf_dir).where(F.length("email") % 2 == 0))


@plans.add("d6_signature", rf"""WITH {ALIASES}, k AS (SELECT doc_id, list_filter(list_transform(string_split(lower(text), chr(10)), lambda x: trim(x, E' \t\r\n\x0B\x0C　')), lambda x: x <> '') AS l FROM documents WHERE text IS NOT NULL),
t AS (SELECT doc_id, l[greatest(len(l) - 9, 1):] AS l FROM k), e AS (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS no FROM t), h AS (SELECT * FROM e JOIN i ON contains(line, alias)),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY no DESC, len(alias) DESC, encode(alias) DESC) AS place FROM h) SELECT doc_id, alias, officials FROM r WHERE place = 1""")
def d6(spark, sf_dir):
    return R.match_signature(table(spark, sf_dir, "documents"), "doc_id", "text", aliases(spark, sf_dir))


#: Common subsequences of every pair of names that can reach 80, by a recursive table.
LCS = """t(a, b, i, line) AS (SELECT a, b, 0, list_transform(range(len(b) + 1), lambda x: 0) FROM p
UNION ALL SELECT a, b, i + 1, list_reduce(range(1, len(b) + 1), lambda acc, j: list_append(acc, CASE WHEN b[j] = a[i + 1] THEN line[j] + 1 ELSE greatest(line[j + 1], acc[len(acc)]) END), [0]) FROM t WHERE i < len(a)),
s AS (SELECT a, b, CAST(floor(200 * line[len(line)] / (len(a) + len(b))) AS INTEGER) AS score FROM t WHERE i = len(a))"""


def names(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_name").distinct()


FUZZY = f"""WITH RECURSIVE n AS (SELECT DISTINCT p_name AS name, replace(lower(p_name), ' ', '') AS k FROM part), p AS (SELECT DISTINCT x.k AS a, y.k AS b FROM n x, n y WHERE 200 * least(len(x.k), len(y.k)) >= 80 * (len(x.k) + len(y.k))), {LCS}
SELECT x.name AS p_name, y.name AS other, score, row_number() OVER (PARTITION BY x.name ORDER BY score DESC, encode(y.name)) AS place, max(score) OVER (PARTITION BY x.name) >= 90 AS certain FROM s JOIN n x ON x.k = a JOIN n y ON y.k = b WHERE score >= 80"""


@plans.add("d8_fuzzy_search", FUZZY)
def d8(spark, sf_dir):
    rows = names(spark, sf_dir)
    return R.fuzzy_lookup(rows, rows.withColumnRenamed("p_name", "other"), "p_name", "other", 80, 90)


QUERIES["d7_fuzzy_lookup"] = lambda spark, sf_dir: d8(spark, sf_dir).where("certain and place = 1").select("p_name", "other", "score")
ORACLES["d7_fuzzy_lookup"] = f"WITH RECURSIVE {FUZZY.split('WITH RECURSIVE ', 1)[1].rsplit('SELECT x.name', 1)[0].rstrip()}, q AS (SELECT x.name AS p_name, y.name AS other, score, row_number() OVER (PARTITION BY x.name ORDER BY score DESC, encode(y.name)) AS place FROM s JOIN n x ON x.k = a JOIN n y ON y.k = b WHERE score >= 90) SELECT p_name, other, score FROM q WHERE place = 1"


@plans.add("d9_standardize_projects", """WITH b AS (SELECT p_partkey, p_brand || CASE WHEN p_partkey % 3 = 0 THEN ' + ' || p_type || ' + odd' ELSE '' END AS raw FROM part),
n AS (SELECT DISTINCT p_brand AS name FROM part UNION SELECT DISTINCT p_type FROM part), x AS (SELECT p_partkey, 0 AS part_no, raw AS part, raw AS project, 'exact' AS stage FROM b WHERE p_partkey % 3 <> 0),
y AS (SELECT p_partkey, i - 1 AS part_no, trim(string_split(raw, '+')[i]) AS part FROM b, range(1, 4) r(i) WHERE p_partkey % 3 = 0)
SELECT *, true AS matched FROM x UNION ALL SELECT p_partkey, part_no, part, part, CASE WHEN part_no = 2 THEN 'unmatched' ELSE 'part' END, part_no <> 2 FROM y""")
def d9(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    raw = F.when(F.col("p_partkey") % 3 == 0, F.concat_ws(" + ", "p_brand", "p_type", F.lit("odd"))).otherwise(F.col("p_brand"))
    projects = part.select(F.col("p_brand").alias("name")).union(part.select("p_type")).distinct()
    combos = part.where("false").select(F.col("p_name").alias("name"), F.col("p_name").alias("part"), F.lit(0).alias("part_no"))
    return R.standardize_projects(part.select("p_partkey", raw.alias("raw")), "p_partkey", "raw", projects, combos)


#: Raw values and what they become: (raw, context, [(part, project, stage, matched), ...]).
RAW = (
    ("Germany WEEE", "", (("Germany WEEE", "Germany WEEE", "exact", True),)),
    ("big set", "", (("Germany WEEE", "Germany WEEE", "combo", True), ("France WEEE", "France WEEE", "combo", True))),
    ("germany  weee + Poland battery", "", (("germany  weee", "Germany WEEE", "part", True), ("Poland battery", "Poland battery", "part", True))),
    ("Germany and France WEEE", "", (("GermanyWEEE", "Germany WEEE", "part", True), ("FranceWEEE", "France WEEE", "part", True))),
    ("Germany WEEEE", "", (("Germany WEEEE", "Germany WEEE", "similar", True),)),
    ("WEEE", "for France please", (("WEEE", "France WEEE", "service", True),)),
    ("Poland", "the battery law", (("Poland", "Poland battery", "country", True),)),
    ("German WEEX", "", (("German WEEX", "Germany WEEE", "whole", True),)),
    ("quite unknown", "Germany", (("quite unknown", "quite unknown", "unmatched", False),)),
    ("odd / Germany WEEE", "", (("odd", "odd", "unmatched", False), ("Germany WEEE", "Germany WEEE", "part", True))),
    (" ", "Germany WEEE", ()),
)
MADE = ", ".join(f"({i}, {no}, '{part}', '{project}', '{stage}', {str(matched).lower()})" for i, (_, _, parts) in enumerate(RAW) for no, (part, project, stage, matched) in enumerate(parts))


@plans.add("d9_projects_by_stage", f"SELECT p_partkey, part_no, part, project, stage, matched FROM part JOIN (VALUES {MADE}) v(i, part_no, part, project, stage, matched) ON i = p_partkey % {len(RAW)}")
def d9_stages(spark, sf_dir):
    pick = lambda n: F.element_at(F.array(*[F.lit(row[n]) for row in RAW]), (F.col("p_partkey") % len(RAW) + 1).cast("int"))
    rows = table(spark, sf_dir, "part").select("p_partkey", pick(0).alias("raw"), pick(1).alias("about"))
    projects = spark.createDataFrame([("Germany WEEE",), ("France WEEE",), ("Germany packaging",), ("Poland battery",)], "name string")
    combos = spark.createDataFrame([("Big Set", "Germany WEEE", 0), ("Big Set", "France WEEE", 1)], "name string, part string, part_no int")
    countries = spark.createDataFrame([(n, n) for n in ("Germany", "France", "Poland")], "name string, alias string")
    services = spark.createDataFrame([("WEEE", "weee", 1), ("battery", "battery", 2), ("packaging", "packaging", 3)], "name string, alias string, rank int")
    return R.standardize_projects(rows, "p_partkey", "raw", projects, combos, countries, services, "about")


QUERIES["d10_model_projects"] = lambda spark, sf_dir: R.match_model_projects(names(spark, sf_dir), table(spark, sf_dir, "part").select(F.substring_index("p_name", " ", -1).alias("word")).distinct(), "p_name", "word")


ORACLES["d10_model_projects"] = "SELECT DISTINCT replace(lower(p_name), ' ', '') AS p_name, lower(split_part(p_name, ' ', 2)) AS word, 100 AS score FROM part"


@plans.add("b21_country_of", "SELECT o_orderkey, ['Germany', 'Germany', 'Guinea-Bissau', 'Guinea', 'France', 'Poland'][o_orderkey % 7 + 1] AS name FROM orders WHERE o_orderkey % 7 < 6")
def b21(spark, sf_dir):
    """By order key: an own prefix before another language's, a prefix in another language, the longer and the shorter of
    two prefixes, a contained name, the longer of two contained ones, none."""
    texts = ("GERMANY needs Frankreich", "deutschland, not france", "Guinea-Bissau order", "guinea order", "order for France", "an oman or Poland order", "nothing")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.element_at(F.array(*[F.lit(t) for t in texts]), (F.col("o_orderkey") % 7 + 1).cast("int")), F.lit(" "), F.col("o_custkey")).alias("t"))
    names = [("Germany", "Germany", "own"), ("Germany", "Deutschland", "de"), ("France", "France", "own"), ("France", "Frankreich", "de"), ("Guinea", "Guinea", "own"), ("Guinea-Bissau", "Guinea-Bissau", "own"), ("Poland", "Poland", "own"), ("Oman", "Oman", "own")]
    return R.country_of(rows, "o_orderkey", "t", spark.createDataFrame(names, "name string, alias string, lang string"))


SIBLINGS = "r AS (SELECT l_orderkey AS mail, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_returnflag AS v, CASE WHEN l_linestatus = 'O' THEN 'a' ELSE 'n' END AS suggested, l_linestatus = 'F' AS ok FROM lineitem)"


def siblings(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("mail"), "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", F.col("l_returnflag").alias("v"), F.when(F.col("l_linestatus") == "O", "a").otherwise("n").alias("suggested"), (F.col("l_linestatus") == "F").alias("ok"))


@plans.add("d16_hide_superseded", f"WITH {SIBLINGS} SELECT mail, l_linenumber, l_partkey, l_suppkey, v FROM r WHERE ok OR NOT EXISTS (SELECT 1 FROM r s WHERE s.ok AND s.mail = r.mail AND lower(s.v) = r.suggested)")
def d16(spark, sf_dir):
    return R.hide_superseded(siblings(spark, sf_dir), "mail", "v", "suggested", F.col("ok")).select("mail", "l_linenumber", "l_partkey", "l_suppkey", "v")


QUERIES["d17_move_brands"] = lambda spark, sf_dir: R.move_brands(siblings(spark, sf_dir).where("ok").withColumn("brands", F.array(F.col("l_partkey").cast("string"))), siblings(spark, sf_dir).where("not ok").withColumn("brands", F.array(F.col("l_suppkey").cast("string"))), "mail", "v", "suggested", "brands").select("mail", "l_linenumber", "l_partkey", "v", "brands")
ORACLES["d17_move_brands"] = f"""WITH {SIBLINGS}, h AS (SELECT mail, suggested, list_sort(list(CAST(l_suppkey AS VARCHAR))) AS m FROM r WHERE NOT ok GROUP BY ALL), e AS (SELECT r.*, list_concat([CAST(l_partkey AS VARCHAR)], coalesce(m, [])) AS l FROM r LEFT JOIN h ON r.mail = h.mail AND lower(v) = h.suggested WHERE ok)
SELECT mail, l_linenumber, l_partkey, v, list_filter(l, lambda x, i: list_position(l, x) = i) AS brands FROM e"""


@plans.add("d18_donor_fill", "WITH d AS (SELECT p_brand, p_type, max(p_name) AS n FROM part WHERE p_size > 40 GROUP BY ALL), a AS (SELECT p_brand, max(p_name) AS s FROM part WHERE p_size > 40 GROUP BY 1 HAVING count(*) = 1) SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_name ELSE coalesce(n, s) END AS p_name FROM part LEFT JOIN d USING (p_brand, p_type) LEFT JOIN a USING (p_brand)")
def d18(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    blank = part.select("p_partkey", "p_brand", "p_type", F.when(F.col("p_size") % 2 == 0, F.col("p_name")).otherwise(" ").alias("p_name"))
    return R.donor_fill(blank, part.where("p_size > 40"), ["p_brand"], "p_type", ["p_name"]).select("p_partkey", "p_name")


@plans.add("d22_record_scope", "SELECT p_partkey FROM part WHERE contains(replace(lower(p_name), ' ', ''), 'redbolt')")
def d22(spark, sf_dir):
    return R.record_scope(table(spark, sf_dir, "part"), "p_brand", "p_name", F.lit("Red BOLT")).select("p_partkey")


SCOPES = """r AS (SELECT p_brand AS mail, p_type AS file, p_partkey, p_name, replace(p_name, ' ', '') || replace(p_type, ' ', '') AS t FROM part),
c AS (SELECT DISTINCT p_brand AS mail, CASE WHEN p_size % 25 = 0 THEN '' ELSE p_name END AS company FROM part WHERE p_size % 5 = 0),
s AS (SELECT mail, company, file, p_partkey, company <> '' AS scoped FROM r JOIN c USING (mail) WHERE contains(lower(t), lower(replace(company, ' ', ''))))"""


def scopes(spark, sf_dir):
    """Parts as records: the brand is the mail, the type the file; every fifth size gives a company, some are blank."""
    records = table(spark, sf_dir, "part").select(F.col("p_brand").alias("mail"), F.col("p_type").alias("file"), "p_partkey", "p_name")
    part = table(spark, sf_dir, "part").where("p_size % 5 = 0")
    companies = part.select(F.col("p_brand").alias("mail"), F.when(F.col("p_size") % 25 != 0, F.upper("p_name")).alias("company"))
    return records, R.record_scopes(records, companies, "mail", "file", "p_name", "company")


@plans.add("d22_record_scopes", f"WITH {SCOPES} SELECT mail, company, p_partkey, scoped FROM s")
def d22_scopes(spark, sf_dir):
    return scopes(spark, sf_dir)[1].select("mail", F.lower("company").alias("company"), "p_partkey", "scoped")


@plans.add("d22_scope_files", f"WITH {SCOPES}, f AS (SELECT mail, file, count(*) AS n_records FROM r GROUP BY ALL), u AS (SELECT mail, company, file, count(*) AS n FROM s GROUP BY ALL) SELECT f.mail, n.company, f.file, n_records, coalesce(u.n, 0) AS n_used FROM f JOIN (SELECT DISTINCT mail, company FROM s) n USING (mail) LEFT JOIN u ON u.mail = f.mail AND u.file = f.file AND u.company = n.company")
def d22_files(spark, sf_dir):
    records, found = scopes(spark, sf_dir)
    return R.scope_files(records, found, "mail", "file", "company").withColumn("company", F.lower("company"))


@plans.add("d23_record_groups", "WITH o AS (SELECT p_brand, min(p_type) AS a, max(p_type) AS b FROM part WHERE p_size > 48 GROUP BY 1) SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_name WHEN a = b THEN a END AS project, p_partkey % 2 <> 0 AND coalesce(a <> b, true) AS flagged FROM part LEFT JOIN o USING (p_brand)")
def d23(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    records = part.select("p_brand", "p_partkey", F.when(F.col("p_partkey") % 2 == 0, F.col("p_name")).otherwise(" ").alias("project"))
    return R.record_groups(records.union(records), part.where("p_size > 48").select("p_brand", F.col("p_type").alias("project")), "p_brand", ["p_partkey"], "project").select("p_partkey", "project", "flagged")


@plans.add("d24_project_source", "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber FROM lineitem l WHERE l_linenumber = (SELECT min(l_linenumber) FROM lineitem m WHERE m.l_orderkey = l.l_orderkey)")
def d24(spark, sf_dir):
    return R.best_source(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")


@plans.add("d23_text_groups", "WITH r AS (SELECT p_brand, p_partkey, p_name AS project FROM part WHERE p_size < 3), c AS (SELECT p_brand, count(*) AS n FROM r GROUP BY 1) SELECT r.p_brand, project, n AS n_expected, 'record' AS origin FROM r JOIN c USING (p_brand) UNION ALL SELECT p_brand, p_type, NULL, 'text' FROM part WHERE p_size > 45 AND p_brand NOT IN (SELECT p_brand FROM c)")
def d23_groups(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    records = part.where("p_size < 3").select("p_brand", "p_partkey", F.col("p_name").alias("project"))
    texts = part.where("p_size > 45").select("p_brand", F.col("p_type").alias("project"))
    return R.record_groups(records, texts.where("false"), "p_brand", ["p_partkey"], "project", texts).select("p_brand", "project", "n_expected", "origin")


@plans.add("d24_project_sources", """WITH f AS (SELECT DISTINCT l_orderkey AS m, l_returnflag AS p FROM lineitem WHERE l_orderkey % 6 IN (1, 2, 3)), n AS (SELECT m, count(*) AS n, bool_or(p = 'R') AS r FROM f GROUP BY m), k AS (SELECT DISTINCT l_orderkey AS m FROM lineitem)
SELECT m AS mail, 'B' AS project, 'bound form' AS source, false AS flagged FROM k WHERE m % 6 = 0
UNION ALL SELECT m, p, 'checked form', false FROM f WHERE m % 6 = 1
UNION ALL SELECT f.m, p, 'checked form', n >= 2 AND NOT r FROM f JOIN n ON f.m = n.m WHERE f.m % 6 = 2 AND (NOT (n >= 2 AND r) OR p = 'R')
UNION ALL SELECT f.m, p, 'checked form', n >= 2 FROM f JOIN n ON f.m = n.m WHERE f.m % 6 = 3
UNION ALL SELECT m, 'extra', 'checked form', false FROM k WHERE m % 6 = 3
UNION ALL SELECT m, 'R', 'declared', false FROM k WHERE m % 6 = 4 UNION ALL SELECT m, 'r', 'rules', false FROM k WHERE m % 6 = 5""")
def d24_sources(spark, sf_dir):
    """By order key: 0 bound, 1 a form alone, 2 a form narrowed by what is declared, 3 one that declares nothing in common
    and plain files, 4 declared, 5 rules only; every mail has rules."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("mail"), F.col("l_returnflag").alias("project"))
    of = lambda name, *rest: rows.where(F.col("mail") % 6 == rest[0] if len(rest) == 1 else (F.col("mail") % 6).isin(*rest)).select("mail", F.lit(name).alias("project"))
    form = rows.where((F.col("mail") % 6).isin(1, 2, 3))
    declared = of("R", 2, 4).union(of("extra", 3)).union(of(" ", 1))
    every = rows.select("mail", F.lit("r").alias("project"))
    return R.project_source("mail", of("B", 0), form, of("s", 0), declared, of("t", 0), every, plain=of("extra", 3).union(of("more", 3)))


@plans.add("d25_company_source", "SELECT l_orderkey, arg_min(l_returnflag, (l_linenumber, l_returnflag)) AS l_returnflag, min(l_linenumber) AS l_linenumber FROM lineitem WHERE l_returnflag <> 'N' GROUP BY 1")
def d25(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", F.regexp_replace("l_returnflag", "N", " ").alias("l_returnflag"), "l_linenumber")
    return R.first_source(rows, "l_orderkey", "l_returnflag", "l_linenumber")


@plans.add("d25_company_evidence", """SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN 'Blue Sea' || o_custkey || ' Ltd' WHEN 1 THEN 'Old Mill GmbH' WHEN 2 THEN 'Green Hill Ltd' WHEN 3 THEN 'Deep Well' || o_custkey || ' Inc' WHEN 4 THEN 'Sand Dune GmbH' END AS value,
o_orderkey % 6 // 1 + CASE WHEN o_orderkey % 6 = 4 THEN 0 ELSE 1 END AS rank, ['body', 'subject', 'file', 'file text', 'file text'][o_orderkey % 6 + 1] AS source FROM orders WHERE o_orderkey % 6 < 5""")
def d25_evidence(spark, sf_dir):
    """By order key: a labelled company beats all, a subject beats files, a file's name beats texts; the first of two texts;
    5 has no evidence."""
    k = F.col("o_orderkey") % 6
    orders = table(spark, sf_dir, "orders")
    body = F.when(k == 0, F.concat(F.lit("hello\nCompany: Blue Sea"), "o_custkey", F.lit(" Ltd\nbye"))).otherwise("nothing to see")
    rows = orders.select("o_orderkey", body.alias("body"), F.when(k < 2, "about Old Mill GmbH").alias("subject"))
    name = F.when((k < 3) & (F.col("no") == 2), "form_Green Hill Ltd_2.pdf").otherwise("form.pdf")
    text = F.when((k < 4) & (F.col("no") == 1), F.concat(F.lit("we, Deep Well"), "o_custkey", F.lit(" Inc, ask"))).when((k == 4) & (F.col("no") == 2), "for Sand Dune GmbH")
    files = orders.withColumn("no", F.explode(F.array(F.lit(1), F.lit(2)))).select("o_orderkey", "no", name.alias("file"), text.alias("text"))
    return A.company_source(rows, files, "o_orderkey", "body", "subject", "file", "text", "no")


@plans.add("d26_current_batch", "SELECT o_orderkey FROM orders WHERE year(o_orderdate) = (SELECT max(year(o_orderdate)) FROM orders)")
def d26(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    batches = orders.groupBy(F.year("o_orderdate").alias("published_at")).agg(F.min("o_orderdate").alias("low"), F.max("o_orderdate").alias("high"))
    return R.current_batch(orders, "o_orderdate", batches).select("o_orderkey")


@plans.add("d27_merge_back", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN o_orderpriority ELSE 'not compared' END AS status FROM orders")
def d27(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    return R.merge_back(orders.withColumn("status", F.lit("")), orders.where("o_orderstatus = 'F'").select("o_orderkey", F.col("o_orderpriority").alias("status")), "o_orderkey", "status").select("o_orderkey", "status")


# The ledger: events by day.


def events(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value", F.col("ts").cast("date").alias("day"))


@plans.add("f1_occurrence_no", "SELECT event_id, CAST(row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) - 1 AS BIGINT) AS occurrence FROM events")
def f1(spark, sf_dir):
    return L.occurrence_no(events(spark, sf_dir).withColumn("base", F.concat_ws("|", "user_id", "event_type")), "base", "event_id").select("event_id", F.col("occurrence").cast("long").alias("occurrence"))


KEYED = "k AS (SELECT *, sha1('mail|' || user_id || '|' || event_type || '|' || (row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) - 1))[:24] AS record_key, upper(sha1(user_id || '|' || event_type || '|' || (row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) - 1))[:24]) AS detail_number FROM events)"


@plans.add("i1_record_key", f"WITH {KEYED} SELECT event_id, record_key, detail_number FROM k")
def i1_key(spark, sf_dir):
    return L.keyed(events(spark, sf_dir).withColumn("base", F.concat_ws("|", "user_id", "event_type")), "base", "event_id", "mail").select("event_id", "record_key", "detail_number")


@plans.add("i1_upsert", "SELECT event_id, CASE WHEN day(ts) > 20 OR day(ts) < 10 THEN value ELSE 0 END AS value, CASE WHEN day(ts) > 20 THEN 'inserted' WHEN day(ts) < 10 THEN 'updated' ELSE 'kept' END AS change, day(ts) <= 20 AS old FROM events")
def i1(spark, sf_dir):
    rows = events(spark, sf_dir).select("event_id", "day", "value")
    old = rows.where(F.dayofmonth("day") <= 20).withColumn("value", F.lit(0.0)).withColumn("first_seen", F.lit("2024-02-01").cast("timestamp")).withColumn("updated_at", F.col("first_seen"))
    batch = rows.where((F.dayofmonth("day") > 20) | (F.dayofmonth("day") < 10))
    now = F.lit("2024-03-01 00:00:00").cast("timestamp")
    out = L.upsert(old, batch, "event_id", now)
    return out.select("event_id", "value", "change", (F.col("first_seen") < now).alias("old"))


@plans.add("i1_batch_log", "SELECT 'mail' AS dataset, 'b1' AS batch, 'a file' AS source, count(*) FILTER (day(ts) > 20) AS n_inserted, count(*) FILTER (day(ts) < 10) AS n_updated FROM events")
def i1_log(spark, sf_dir):
    return L.batch_log(i1(spark, sf_dir), "mail", "b1", "a file", F.lit("2024-03-01").cast("timestamp")).drop("logged_at")


@plans.add("i2_replace_range", "SELECT event_id, CASE WHEN day(ts) BETWEEN 5 AND 9 THEN 'new' ELSE 'old' END AS origin FROM events WHERE NOT (day(ts) BETWEEN 5 AND 9 AND event_id % 3 <> 0)")
def i2(spark, sf_dir):
    rows = events(spark, sf_dir).select("event_id", "day").withColumn("origin", F.lit("old"))
    low, high = F.lit("2024-01-05").cast("date"), F.lit("2024-01-09").cast("date")
    batch = rows.where(F.col("day").between(low, high) & (F.col("event_id") % 3 == 0)).withColumn("origin", F.lit("new"))
    return L.replace_range(rows, batch, "day", low, high)[0].select("event_id", "origin")


@plans.add("i3_drop_refreshed", "SELECT event_id FROM events WHERE day(ts) NOT BETWEEN 5 AND 9")
def i3(spark, sf_dir):
    rows = events(spark, sf_dir)
    days = L.replace_range(rows, rows.where("false"), "day", F.lit("2024-01-05").cast("date"), F.lit("2024-01-09").cast("date"))[2]
    return L.drop_refreshed(rows, days, "day").select("event_id")


@plans.add("i4_operations", "SELECT CAST(ts AS DATE) AS day, event_type AS action, CAST(event_id AS VARCHAR) AS record_id, CASE WHEN event_id % 3 = 0 THEN 'r' || user_id ELSE '' END AS reason FROM events WHERE CAST(ts AS DATE) = DATE '2024-01-07'")
def i4(spark, sf_dir):
    """The first half of the events is the log, the second is appended; one day is read."""
    rows = events(spark, sf_dir)
    text = F.lit("")
    log = rows.where("event_id % 2 = 0").select("day", F.col("event_type").alias("action"), F.col("event_id").cast("string").alias("record_id"), text.alias("mail_id"), F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("r"), "user_id")).otherwise("").alias("reason"), text.alias("result"), F.col("ts").cast("timestamp").alias("at"))
    fresh = rows.where("event_id % 2 != 0").select(F.col("event_type").alias("action"), F.col("event_id").cast("string").alias("record_id"), F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("r"), "user_id")).alias("reason"), F.col("ts").cast("timestamp").alias("at"))
    both = L.log_operation(log, fresh, F.lit("2030-01-01").cast("timestamp"))
    return L.operations(both, F.lit("2024-01-07").cast("date")).select("day", "action", "record_id", "reason")


@plans.add("i5_once", "SELECT min(event_id) AS event_id FROM events GROUP BY user_id, event_type, CAST(ts AS DATE)")
def i5(spark, sf_dir):
    rows = events(spark, sf_dir).withColumn("request", F.concat_ws("|", "user_id", "event_type", "day"))
    return L.once(rows, "request", ["event_id"]).select("event_id")




def reviews(spark, sf_dir):
    kinds = events(spark, sf_dir)
    action = F.element_at(F.array(F.lit("edit"), F.lit("confirm"), F.lit("agent_confirm"), F.lit("return"), F.lit("needs_info"), F.lit("edit"), F.lit("reset")), (F.col("event_id") % 7 + 1).cast("int"))
    fields = F.create_map(F.element_at(F.array(F.lit("agent"), F.lit("company"), F.lit("project")), (F.col("event_id") % 3 + 1).cast("int")), F.col("event_type"))
    return kinds.select(F.col("user_id").alias("record_id"), F.col("event_id").alias("seq"), F.col("ts").alias("at"), action.alias("action"), fields.alias("fields"))


FOLD = """e AS (SELECT user_id AS record_id, event_id AS seq, ts AS t, ['edit','confirm','agent_confirm','return','needs_info','edit','reset'][event_id % 7 + 1] AS action, ['agent','company','project'][event_id % 3 + 1] AS field, event_type AS v FROM events),
l AS (SELECT * FROM e WHERE seq > coalesce((SELECT max(seq) FROM e x WHERE x.record_id = e.record_id AND x.action = 'reset'), -1)),
s AS (SELECT record_id, arg_max(CASE action WHEN 'edit' THEN 'review' WHEN 'confirm' THEN 'confirmed' WHEN 'return' THEN 'returned' WHEN 'needs_info' THEN 'needs_info' WHEN 'agent_confirm' THEN CASE WHEN field = 'agent' THEN 'ready' ELSE 'review' END END, seq) AS status,
arg_max(CASE WHEN field = 'agent' THEN v END, CASE WHEN field = 'agent' AND action IN ('edit', 'agent_confirm') THEN seq END) AS agent, arg_max(v, CASE WHEN field = 'company' AND action IN ('edit', 'agent_confirm') THEN seq END) AS company, count(*) AS n_events, max(t) AS last_at FROM l GROUP BY record_id)"""


@plans.add("i6_fold_reviews", f"WITH {FOLD} SELECT * FROM s")
def i6(spark, sf_dir):
    out = L.fold_reviews(reviews(spark, sf_dir))
    return out.select("record_id", "status", F.col("fields")["agent"].alias("agent"), F.col("fields")["company"].alias("company"), "n_events", "last_at")


@plans.add("i7_effective_status", "SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 'confirmed' WHEN o_orderkey % 4 = 1 OR o_orderstatus = 'P' OR o_orderpriority = '5-LOW' THEN 'review' ELSE 'ready' END AS status FROM orders")
def i7(spark, sf_dir):
    k = F.col("o_orderkey") % 4
    status = L.effective_status(F.when(k == 0, "confirmed"), F.when(k == 1, F.array(F.lit("x"))).otherwise(F.expr("cast(array() as array<string>)")), F.lit(" "), F.when(F.col("o_orderstatus") == "P", "invalid"), F.when(F.col("o_orderpriority") == "5-LOW", "low"), F.lit("a"))
    return table(spark, sf_dir, "orders").select("o_orderkey", status.alias("status"))


@plans.add("i8_merge_saved_fields", "SELECT o_orderkey, CASE o_orderkey % 5 WHEN 1 THEN 'mine' WHEN 2 THEN '' ELSE o_orderpriority END AS v FROM orders")
def i8(spark, sf_dir):
    k = F.col("o_orderkey") % 5
    saved = F.when(k == 1, "mine").when(k.isin(2, 3), "").when(k == 4, "TBD")
    return table(spark, sf_dir, "orders").select("o_orderkey", L.merge_saved_fields(F.col("o_orderpriority"), saved, k == 2, ("tbd",)).alias("v"))


ORDER_ITEMS = "g AS (SELECT l_orderkey, list(l_linestatus = 'F') AS l FROM lineitem GROUP BY 1)"


@plans.add("i9_confirm_ready", f"WITH {ORDER_ITEMS} SELECT l_orderkey, CASE WHEN l_orderkey % 2 = 0 THEN len(list_filter(l, lambda x: NOT x)) = 0 ELSE l_orderkey % 3 = 0 END AS v FROM g")
def i9(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct((F.col("l_linestatus") == "F").alias("confirmed"))).alias("items"))
    return rows.select("l_orderkey", L.confirm_ready(F.when(F.col("l_orderkey") % 3 == 0, "confirmed").otherwise("ready"), F.col("l_orderkey") % 2 == 0, F.col("items")).alias("v"))


@plans.add("i10_confirm_items", "SELECT p_partkey, p_partkey % 2 = 0 AND p_partkey % 3 <> 0 AND p_partkey % 5 <> 0 AS confirmed FROM part")
def i10(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_partkey", F.lit(1).alias("owner"), "p_brand", F.when(F.col("p_partkey") % 5 == 0, "").otherwise(F.col("p_type")).alias("p_type"))
    old = part.withColumn("confirmed", F.col("p_partkey") % 2 == 0)
    new = part.withColumn("p_brand", F.when(F.col("p_partkey") % 3 == 0, "other").otherwise(F.col("p_brand")))
    return L.confirm_items(old, new, "owner", "p_partkey", ["p_brand", "p_type"]).select("p_partkey", "confirmed")


@plans.add("i11_bulk_confirm", "SELECT o_custkey, bool_and(o_orderstatus <> 'P') AS eligible, count(*) FILTER (o_orderstatus = 'P') AS blocked FROM orders GROUP BY 1")
def i11(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").withColumn("s", F.when(F.col("o_orderstatus") == "P", "review").when(F.col("o_orderstatus") == "F", "ready").otherwise("confirmed"))
    return L.bulk_confirm(rows, "o_custkey", "s")


@plans.add("i12_route_overrides", "WITH e AS (SELECT user_id, arg_max(event_type, event_id) AS r, count(*) AS n FROM events WHERE event_type <> 'view' GROUP BY 1) SELECT c_custkey, coalesce(r, c_mktsegment) AS route, coalesce(n, 0) AS n_route_events FROM customer LEFT JOIN e ON user_id = c_custkey")
def i12(spark, sf_dir):
    mails = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("route"))
    changes = events(spark, sf_dir).where("event_type != 'view'").select(F.col("user_id").alias("c_custkey"), "event_id", F.col("event_type").alias("route"))
    return L.route_overrides(mails, changes, "c_custkey", "event_id", "route")


@plans.add("i13_tombstones", "SELECT o_orderkey, o_custkey IN (SELECT user_id FROM events WHERE event_type = 'error') AS deleted FROM orders")
def i13(spark, sf_dir):
    gone = events(spark, sf_dir).where("event_type = 'error'").select(F.col("user_id").alias("o_custkey"))
    live, audit = L.tombstones(table(spark, sf_dir, "orders"), gone, "o_custkey")
    return live.select("o_orderkey", F.lit(False).alias("deleted")).union(audit.select("o_orderkey", F.lit(True)))


@plans.add("i14_add_detail", "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'rejected' WHEN p_type IN (SELECT p_type FROM part WHERE p_size = 1 AND p_partkey % 2 = 0) THEN 'added' ELSE 'warned' END AS outcome FROM part")
def i14(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    there = part.where("p_partkey % 2 = 0")
    return L.add_detail(there.select("p_partkey"), part.select("p_partkey", "p_type"), ["p_partkey"], there.where("p_size = 1"), "p_type").select("p_partkey", "outcome")


@plans.add("i15_fresh_lookup", "SELECT event_id FROM events WHERE DATE '2024-01-15' - CAST(ts AS DATE) < 7 AND NOT (event_id % 3 < 2 AND value < 5)")
def i15(spark, sf_dir):
    rows = events(spark, sf_dir).withColumn("version", F.col("event_id") % 3).withColumn("found", F.when(F.col("value") < 5, 0).otherwise(1))
    return L.fresh_lookup(rows, F.lit("2024-01-15"), "ts", 7, "version", 2, "found").select("event_id")


@plans.add("i15_collapsed_lookup", "WITH g AS (SELECT user_id, event_type, count(*) AS n FROM events WHERE DATE '2024-01-15' - CAST(ts AS DATE) < 7 GROUP BY ALL) SELECT event_id FROM events e JOIN g ON e.user_id = g.user_id AND e.event_type = g.event_type WHERE DATE '2024-01-15' - CAST(ts AS DATE) < 7 AND NOT (e.user_id % 3 + 1 > 1 AND n < e.user_id % 3 + 1)")
def i15_collapsed(spark, sf_dir):
    rows = events(spark, sf_dir).withColumns({"version": F.lit(2), "found": F.lit(1), "n_orders": F.col("user_id") % 3 + 1})
    return L.fresh_lookup(rows, F.lit("2024-01-15"), "ts", 7, "version", 2, "found", ["user_id", "event_type"], "n_orders").select("event_id")


@plans.add("i16_history_events", "SELECT user_id, event_type || day(ts) AS g, min(ts) AS ts FROM events GROUP BY ALL")
def i16_events(spark, sf_dir):
    rows = events(spark, sf_dir).select("user_id", F.concat("event_type", F.dayofmonth("day")).alias("g"), "ts")
    return L.history_events(rows, rows, "user_id", "g", "ts")


@plans.add("i16_sync_history", "WITH s AS (SELECT user_id, event_type || day(ts) AS g, min(ts) AS ts FROM events GROUP BY ALL) SELECT user_id, min(ts) AS first_seen, max(ts) AS last_seen, count(*) AS n_events FROM s GROUP BY user_id")
def i16(spark, sf_dir):
    rows = events(spark, sf_dir).withColumn("g", F.concat("event_type", F.dayofmonth("day")))
    return L.sync_history(rows.where("event_id % 2 = 0"), rows.where("event_id % 3 != 0").union(rows.where("event_id % 3 = 0")), "user_id", "g", "ts")


@plans.add("i17_replace_mails", "SELECT event_id, CASE WHEN user_id % 10 = 0 THEN 'new' ELSE 'old' END AS origin FROM events WHERE user_id % 10 <> 0 OR event_id % 2 = 0")
def i17(spark, sf_dir):
    rows = events(spark, sf_dir).select("event_id", "user_id", F.lit("old").alias("origin"))
    keys = rows.where("user_id % 10 = 0").select("user_id")
    fresh = rows.where("user_id % 10 = 0 and event_id % 2 = 0").withColumn("origin", F.lit("new"))
    return L.replace_mails(rows, fresh, keys, "user_id", ["event_id"]).select("event_id", "origin")


@plans.add("i18_reset_overlay", "SELECT event_id FROM events WHERE NOT (day(ts) BETWEEN 5 AND 9) OR event_id % 4 = 0")
def i18(spark, sf_dir):
    rows = events(spark, sf_dir)
    return L.reset_overlay(rows, rows.where("dayofmonth(day) between 5 and 9"), rows.where("event_id % 4 = 0"), "event_id").select("event_id")


@plans.add("i19_item_state", "SELECT l_orderkey, CASE WHEN bool_and(l_linestatus = 'F' AND l_returnflag <> 'N') THEN 'confirmed' WHEN bool_or(l_linestatus = 'F' AND l_returnflag <> 'N') THEN 'partial' ELSE 'pending' END AS item_status, count(*) AS n_items FROM lineitem GROUP BY 1")
def i19(spark, sf_dir):
    return L.item_state(table(spark, sf_dir, "lineitem").withColumn("confirmed", F.col("l_linestatus") == "F"), "l_orderkey", ("R", "A"), "l_returnflag")


ITEM = "i AS (SELECT p_brand AS owner, p_partkey AS item, p_name AS brand, p_type AS category, CAST(p_size % 8 AS VARCHAR) AS k, p_partkey % 2 = 0 AS c FROM part)"


def part_items(spark, sf_dir):
    kind = (F.col("p_size") % 8).cast("string")
    return table(spark, sf_dir, "part").select(F.col("p_brand").alias("owner"), F.col("p_partkey").alias("item"), F.col("p_name").alias("brand"), F.col("p_type").alias("category"), kind.alias("category_class"), F.concat(F.lit("class "), kind).alias("class_name"), F.lit("matched").alias("status"), (F.col("p_partkey") % 2 == 0).alias("confirmed"))


@plans.add("i19_item_draft", f"""WITH {ITEM}, d AS (SELECT owner, item FROM i WHERE item % 3 = 0), j AS (SELECT i.*, item % 3 = 0 AS d, item % 9 = 0 AS o, k IN ('1', '2', '3') AS known FROM i)
SELECT owner, item, CASE WHEN o THEN 'New' ELSE brand END AS brand, CASE WHEN d AND NOT known THEN '' ELSE k END AS category_class, CASE WHEN d THEN CASE WHEN known THEN 'c' || k ELSE '' END ELSE 'class ' || k END AS class_name,
CASE WHEN d AND NOT known THEN 'unmatched' ELSE 'matched' END AS status, CASE WHEN d THEN c AND known AND NOT o ELSE c END AS confirmed FROM j UNION ALL SELECT owner, -1 - item, 'Added', '', '', 'unmatched', false FROM i WHERE item % 10 = 1""")
def i19_draft(spark, sf_dir):
    """Each third item has a draft: each ninth with another brand; classes beyond 3 are unknown; each tenth adds an item."""
    rows = part_items(spark, sf_dir)
    drafts = rows.where("item % 3 = 0").select("owner", "item", F.when(F.col("item") % 9 == 0, " New ").otherwise(F.col("brand")).alias("brand"), "category", "category_class")
    new = rows.where("item % 10 = 1").select("owner", (-1 - F.col("item")).alias("item"), F.lit("Added"), F.lit(None).cast("string"), F.lit("9"))
    return L.save_item_draft(rows, drafts.union(new), "owner", "item", {"1": "c1", "2": "c2", "3": "c3"}).drop("category")


@plans.add("i19_delete_item", f"WITH {ITEM} SELECT owner, item, CASE WHEN item % 4 = 0 THEN 'delete_item' ELSE 'kept' END AS action, brand || ' / ' || category AS reason FROM i")
def i19_delete(spark, sf_dir):
    rows = part_items(spark, sf_dir)
    gone = rows.where("item % 4 = 0").select("owner", "item").union(rows.select("owner", -1 - F.col("item")))
    left, events = L.delete_item(rows, gone, "owner", "item", F.lit("2024-01-01").cast("timestamp"))
    return events.drop("at").union(left.select("owner", "item", F.lit("kept"), F.concat_ws(" / ", "brand", "category")))


ANSWER = "a AS (SELECT o_orderkey AS seq, 's' || o_custkey % 40 AS sender, CAST(date_trunc('year', o_orderdate) AS DATE) AS sent, o_orderpriority AS subject, 'c' || o_custkey % 5 AS company, 'p' AS project, CASE o_orderstatus WHEN 'F' THEN 'yes' WHEN 'O' THEN 'no' ELSE 'review' END AS found, CASE WHEN o_orderkey % 7 = 0 THEN 'own words' END AS said FROM orders)"


def answers(spark, sf_dir):
    found = F.when(F.col("o_orderstatus") == "F", "yes").when(F.col("o_orderstatus") == "O", "no").otherwise("review")
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("seq"), F.concat(F.lit("s"), F.col("o_custkey") % 40).alias("sender"), F.trunc("o_orderdate", "year").alias("sent"), F.col("o_orderpriority").alias("subject"), F.concat(F.lit("c"), F.col("o_custkey") % 5).alias("company"), F.lit("p").alias("project"),
        found.alias("found"), F.when(F.col("o_orderkey") % 7 == 0, "own words").otherwise(" ").alias("match_status"), F.lit("").alias("note"), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderkey").cast("string")).alias("record_id"),
    )


def manual(spark, sf_dir):
    """Answers of keys divisible by 5 are the overlay of an earlier day, the others come now."""
    rows = answers(spark, sf_dir)
    stamp = lambda day: F.lit(day).cast("timestamp")
    none = rows.limit(0).select(*L.IDENTITY, "found", "match_status", "note", F.lit(None).cast("timestamp").alias("checked_at"), F.lit("").alias("detail_key"), *[F.lit(None).cast("timestamp").alias(c) for c in ("first_seen", "updated_at")])
    old, _ = L.record_manual_outcome(none, rows.where("seq % 5 = 0"), stamp("2024-01-01"))
    return L.record_manual_outcome(old.drop("change"), rows.where("seq % 5 != 0"), stamp("2024-02-01"))


@plans.add("i20_manual_outcome", f"""WITH {ANSWER}, o AS (SELECT sender, sent, subject, company, project, arg_max({{'f': found, 's': said}}, seq) AS v FROM a WHERE seq % 5 = 0 GROUP BY ALL), n AS (SELECT sender, sent, subject, company, project, arg_max({{'f': found, 's': said}}, seq) AS v FROM a WHERE seq % 5 <> 0 GROUP BY ALL),
b AS (SELECT coalesce(n.sender, o.sender) AS sender, coalesce(n.sent, o.sent) AS sent, coalesce(n.subject, o.subject) AS subject, coalesce(n.company, o.company) AS company, coalesce(n.v, o.v) AS v, CASE WHEN o.sender IS NULL THEN 'inserted' WHEN n.sender IS NULL THEN 'kept' ELSE 'updated' END AS change FROM n FULL JOIN o ON n.sender = o.sender AND n.sent = o.sent AND n.subject = o.subject AND n.company = o.company)
SELECT sender, sent, subject, company, v.f AS found, coalesce(v.s, CASE v.f WHEN 'yes' THEN 'found by hand' WHEN 'no' THEN 'missing by hand' ELSE 'open by hand' END) AS match_status, change FROM b""")
def i20(spark, sf_dir):
    return manual(spark, sf_dir)[0].select("sender", "sent", "subject", "company", "found", "match_status", "change")


@plans.add("i20_manual_events", f"WITH {ANSWER} SELECT CAST(seq AS VARCHAR) AS record_id, seq, 'manual_outcome' AS action, coalesce(said, CASE found WHEN 'yes' THEN 'found by hand' WHEN 'no' THEN 'missing by hand' ELSE 'open by hand' END) AS reason FROM a WHERE seq % 5 <> 0 AND seq % 2 = 0")
def i20_events(spark, sf_dir):
    return manual(spark, sf_dir)[1].drop("at")


@plans.add("i21_enqueue_retry", "WITH r AS (SELECT o_custkey, o_orderpriority, arg_max(o_orderkey, (CASE WHEN o_orderkey % 4 = 0 THEN 0 ELSE 1 END, o_orderdate, o_orderkey)) AS o_orderkey FROM orders GROUP BY ALL) SELECT o_custkey, o_orderpriority, o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 'asked' ELSE 'pending' END AS status FROM r")
def i21(spark, sf_dir):
    """Orders divisible by 4 are the queue, from before; the others are asked for now, some for keys that wait already."""
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderpriority", "o_orderkey", F.when(F.col("o_orderkey") % 4 == 0, F.col("o_orderdate") - F.expr("interval 100 years")).otherwise(F.col("o_orderdate")).alias("at"))
    queue = rows.where("o_orderkey % 4 = 0").withColumn("status", F.lit("asked"))
    return L.enqueue_retry(queue, rows.where("o_orderkey % 4 != 0"), ["o_custkey", "o_orderpriority"], "at").drop("at")


@plans.add("d15_scoped_aliases", """WITH x AS (SELECT event_id, user_id || '' AS a, CASE WHEN event_id % 4 = 0 THEN 'project' ELSE '' END AS s, event_type AS p FROM events), t AS (SELECT a FROM x WHERE event_id % 50 = 1), f AS (SELECT *, a || CASE WHEN s = 'project' THEN '|' || p ELSE '' END AS k FROM x WHERE event_id % 50 <> 1)
SELECT event_id FROM f WHERE (s = 'project' OR a NOT IN (SELECT a FROM t)) AND event_id = (SELECT min(event_id) FROM f g WHERE g.k = f.k AND g.s = f.s)""")
def d15_scoped(spark, sf_dir):
    rows = events(spark, sf_dir).select("event_id", F.col("user_id").cast("string").alias("a"), F.when(F.col("event_id") % 4 == 0, "project").alias("scope"), F.col("event_type").alias("project"))
    return L.alias_dedupe(rows.where("event_id % 50 = 1"), rows.where("event_id % 50 != 1"), ["a"], "event_id", "scope", "project").select("event_id")


@plans.add("d13_overlay_newest", "SELECT event_id, CASE WHEN day(ts) > 20 OR (day(ts) > 10 AND event_id % 2 = 0) THEN 'manual' ELSE 'auto' END AS origin FROM events")
def d13(spark, sf_dir):
    rows = events(spark, sf_dir).select("event_id", "ts", "day")
    auto = rows.where("dayofmonth(day) <= 20")
    manual = rows.where("dayofmonth(day) > 10").withColumn("ts", F.when(F.col("event_id") % 2 == 0, F.col("ts")).otherwise(F.col("ts") - F.expr("interval 1 day")))
    return L.overlay_newest(auto, manual, "event_id", "ts").select("event_id", "origin")


@plans.add("d14_backfill", "SELECT o_orderkey, CASE WHEN o_custkey % 2 = 0 THEN 'seen' ELSE o_orderpriority END AS o_orderpriority FROM orders")
def d14(spark, sf_dir):
    got = table(spark, sf_dir, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("o_custkey"), F.lit("seen").alias("o_orderpriority"))
    return L.backfill(table(spark, sf_dir, "orders"), got, ["o_custkey"], ["o_orderpriority"]).select("o_orderkey", "o_orderpriority")


@plans.add("d15_alias_dedupe", """WITH RECURSIVE x AS (SELECT event_id, user_id || '' AS a, event_type || floor(value) AS b FROM events), t AS (SELECT * FROM x WHERE event_id % 50 = 0),
f AS (SELECT * FROM x WHERE event_id % 50 <> 0 AND a NOT IN (SELECT a FROM t) AND b NOT IN (SELECT b FROM t)),
r(n, id, a, b, s) AS (SELECT 0, event_id, a, b, 'open' FROM f UNION ALL
SELECT n + 1, id, a, b, CASE WHEN s <> 'open' THEN s WHEN k THEN 'kept' WHEN bool_or(k) OVER (PARTITION BY a) OR bool_or(k) OVER (PARTITION BY b) THEN 'gone' ELSE 'open' END
FROM (SELECT *, coalesce(s = 'open' AND id = min(id) FILTER (s = 'open') OVER (PARTITION BY a) AND id = min(id) FILTER (s = 'open') OVER (PARTITION BY b), false) AS k, bool_or(s = 'open') OVER () AS going FROM r) WHERE going)
SELECT id AS event_id FROM r WHERE n = (SELECT max(n) FROM r) AND s = 'kept'""")
def d15(spark, sf_dir):
    rows = events(spark, sf_dir).select("event_id", F.col("user_id").cast("string").alias("a"), F.concat("event_type", F.floor("value")).alias("b"))
    return L.alias_dedupe(rows.where("event_id % 50 = 0"), rows.where("event_id % 50 != 0"), ["a", "b"], "event_id").select("event_id")


@plans.add("d19_retry", "WITH q AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'error'), d AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'P') SELECT o_orderkey, o_custkey IN (SELECT user_id FROM q) AS retry, o_custkey IN (SELECT user_id FROM q WHERE user_id NOT IN (SELECT o_custkey FROM d)) AS waits FROM orders")
def d19(spark, sf_dir):
    """retry: the customer is in the queue; waits: it still is when the definite results have left the queue."""
    queue = events(spark, sf_dir).where("event_type = 'error'").select(F.col("user_id").alias("o_custkey"))
    orders = table(spark, sf_dir, "orders")
    left = L.retry_ack(queue, orders, ["o_custkey"], "o_orderstatus", ("P",))
    rows = L.retry_mark(L.retry_mark(orders, queue, ["o_custkey"]).withColumnRenamed("retry", "first"), left, ["o_custkey"])
    return rows.select("o_orderkey", F.col("first").alias("retry"), F.col("retry").alias("waits"))


@plans.add("d19_retry_ack", "SELECT DISTINCT user_id FROM events WHERE user_id NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def d19_ack(spark, sf_dir):
    queue = events(spark, sf_dir).select("user_id").distinct()
    return L.retry_ack(queue, table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "user_id"), ["user_id"], "o_orderstatus", ("F",))


@plans.add("d20_migrate_state", """WITH r AS (SELECT *, concat_ws('-', event_type, CAST(event_id % 7 AS VARCHAR)) AS base FROM events),
o AS (SELECT user_id, base, count(*) AS n, CASE WHEN count(*) = 1 THEN max(event_id // 4) END AS s, max(day(ts)) AS w, bool_or(event_id % 9 <> 0) AS e FROM r WHERE event_id % 5 <> 0 GROUP BY ALL),
m AS (SELECT user_id, CASE WHEN event_id % 6 = 1 THEN base || 'x' ELSE base END AS base, CASE WHEN event_id % 11 = 0 THEN NULL WHEN event_id % 13 = 0 THEN -1 ELSE event_id // 4 END AS s, day(ts) AS w FROM r WHERE event_id % 17 <> 0 AND event_id % 5 <> 0),
k AS (SELECT user_id, base, count(*) AS n, CASE WHEN count(*) = 1 THEN max(s) END AS s, max(w) AS w FROM m GROUP BY ALL),
b AS (SELECT coalesce(o.user_id, k.user_id) AS user_id, o.base AS o_base, k.base AS k_base, coalesce(o.n, 0) AS o_n, coalesce(k.n, 0) AS k_n, o.s AS o_s, k.s AS k_s, o.w AS o_w, k.w AS k_w, o.e AS e, coalesce(o.n = 1 AND k.n = 1, false) AS met FROM o FULL JOIN k ON o.user_id = k.user_id AND o.base = k.base),
p AS (SELECT user_id, sum(o_n) AS o_left, sum(k_n) AS k_left, max(o_s) AS o_s, max(k_s) AS k_s, max(k_base) FILTER (k_n > 0) AS to_base, bool_or(e AND o_n > 0) AS e FROM b WHERE NOT met GROUP BY user_id),
c AS (SELECT *, coalesce(o_left = 1 AND k_left = 1 AND o_s = k_s, false) AS changed FROM p),
x AS (SELECT b.user_id, o_base AS base, CASE WHEN NOT b.e THEN 'none' WHEN met AND b.o_s = b.k_s THEN 'carry' WHEN met AND (b.o_s IS NULL OR b.k_s IS NULL) AND o_w = k_w THEN 'draft' WHEN met THEN 'drop' WHEN changed THEN 'draft' ELSE 'left' END AS d,
CASE WHEN met THEN b.k_base WHEN changed THEN to_base END AS t, coalesce(c.e AND NOT changed, false) AS downgraded FROM b LEFT JOIN c USING (user_id) WHERE o_n > 0)
SELECT user_id, base, CASE WHEN d = 'carry' AND downgraded THEN 'draft' ELSE d END AS decision, CASE WHEN d IN ('carry', 'draft') THEN t END AS to_base, downgraded FROM x""")
def d20(spark, sf_dir):
    """Rows of a user as a mail: unchanged, without a strong fingerprint, with another one, under a changed base, gone."""
    rows = events(spark, sf_dir).withColumn("w", F.dayofmonth("day")).where("event_id % 5 != 0").withColumn("base", F.concat_ws("-", "event_type", (F.col("event_id") % 7).cast("string")))
    i = F.col("event_id")
    old = rows.select("user_id", "base", F.floor(i / 4).alias("s"), "w", (i % 9 != 0).alias("held"))
    strong = F.when(i % 11 == 0, None).when(i % 13 == 0, -1).otherwise(F.floor(i / 4))
    new = rows.where(i % 17 != 0).select("user_id", F.when(i % 6 == 1, F.concat("base", F.lit("x"))).otherwise(F.col("base")).alias("base"), strong.alias("s"), "w")
    return L.migrate_state(old, new, "user_id", "base", "s", "w", "held")


@plans.add("d21_multiset_except", "WITH r AS (SELECT event_id, user_id, event_type, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS no FROM events WHERE event_id % 3 <> 0), b AS (SELECT user_id, event_type, count(*) AS n FROM events WHERE event_id % 3 = 0 GROUP BY ALL) SELECT event_id FROM r LEFT JOIN b USING (user_id, event_type) WHERE no > coalesce(n, 0)")
def d21(spark, sf_dir):
    rows = events(spark, sf_dir)
    return L.multiset_except(rows.where("event_id % 3 != 0"), rows.where("event_id % 3 = 0"), ["user_id", "event_type"], ["event_id"]).select("event_id")


@plans.add("h1_union_queues", "SELECT c_custkey AS id, c_mktsegment AS segment, NULL::INTEGER AS nation FROM customer UNION ALL SELECT s_suppkey, NULL, s_nationkey FROM supplier")
def h1(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("segment"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("nation"))
    return L.union_queues(c, s).select("id", "segment", "nation")


@plans.add("h2_prefer_fresh", """WITH e AS (SELECT event_id, user_id, CASE WHEN value > 30 THEN event_type END AS company, event_id % 4 = 0 AS f FROM events), g AS (SELECT user_id, bool_or(company IS NOT NULL) FILTER (f) AS a, bool_or(company IS NOT NULL) FILTER (NOT f) AS b FROM e GROUP BY 1)
SELECT event_id, CASE WHEN f THEN 'fresh' ELSE 'stored' END AS origin FROM e JOIN g USING (user_id) WHERE f = CASE WHEN a THEN true WHEN b THEN false ELSE a IS NOT NULL END""")
def h2(spark, sf_dir):
    rows = events(spark, sf_dir).select("event_id", "user_id", F.when(F.col("value") > 30, F.col("event_type")).alias("company"))
    return L.prefer_fresh(rows.where("event_id % 4 = 0"), rows.where("event_id % 4 != 0"), "user_id", "company").select("event_id", "origin")


@plans.add("h3_bag_difference", "SELECT user_id, event_type FROM events WHERE event_id % 3 <> 0 EXCEPT ALL SELECT user_id, event_type FROM events WHERE event_id % 3 = 0")
def h3(spark, sf_dir):
    rows = events(spark, sf_dir)
    left = rows.where("event_id % 3 != 0").select("user_id", "event_type")
    return L.multiset_except(left, rows.where("event_id % 3 = 0"), ["user_id", "event_type"], ["user_id"])


@plans.add("h4_field_changes", "SELECT o_orderkey, 'o_orderstatus' AS field, o_orderstatus AS before, 'X' AS after FROM orders WHERE o_orderkey % 3 = 0 UNION ALL SELECT o_orderkey, 'o_orderpriority', o_orderpriority, NULL FROM orders WHERE o_orderkey % 5 = 0")
def h4(spark, sf_dir):
    rows = table(spark, sf_dir, "orders")
    after = rows.withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 3 == 0, "X").otherwise(F.col("o_orderstatus"))).withColumn("o_orderpriority", F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderpriority")))
    return L.field_changes(rows, after, "o_orderkey", ["o_orderstatus", "o_orderpriority"])


@plans.add("h5_distinct_lists", "WITH w AS (SELECT item_id, string_split(lower(text), ' ') AS l FROM benchmark) SELECT item_id, list_filter(l, lambda x, i: list_position(l, x) = i) AS v FROM w")
def h5(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", distinct_by(F.split(F.lower("text"), " "), lambda x: x).alias("v"))


@plans.add("f10_last_event", "SELECT arg_max(event_id, (ts, event_type)) AS event_id, user_id FROM events GROUP BY user_id")
def f10(spark, sf_dir):
    return L.last_event(events(spark, sf_dir), "user_id", ["ts", "event_type"]).select("event_id", "user_id")


@plans.add("f11_keep_last", "SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS no FROM events) WHERE no <= 20")
def f11(spark, sf_dir):
    return L.keep_last(events(spark, sf_dir), [F.col("ts").desc(), F.col("event_id")], 20, ["user_id"]).select("event_id")


@plans.add("a17_read_ledger", "SELECT event_id, row_number() OVER (ORDER BY CASE WHEN event_id % 10 <> 0 THEN CAST(ts AS DATE) END DESC NULLS LAST, ts DESC, event_id) AS position FROM events WHERE event_type = 'click'")
def a17(spark, sf_dir):
    from tallyspark.operators.rollup import newest_first

    rows = events(spark, sf_dir).where("event_type = 'click'").withColumn("mail_day", F.when(F.col("event_id") % 10 != 0, F.col("day")))
    return newest_first(rows, "mail_day", F.col("ts").desc(), "event_id").select("event_id", "position")
