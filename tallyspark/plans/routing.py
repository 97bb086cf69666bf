"""Routing, verdicts and roll-ups over documents, labels and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyspark.operators import rollup, rules

from .base import Plans, table
from . import reconcile

plans = Plans()
QUERIES, ORACLES = plans.queries, plans.oracles

#: Ranked keyword groups for the tables' four languages.
GROUPS = {
    "strict": ("invoice", "quotation", "licensed under"),
    "change": ("anthe", "verlich", "leaux"),
    "soft": ("osque", "onhe"),
    "action": ("tion", "keit"),
    "request": ("ando", "ring"),
    "explicit": ("apply", "inthe"),
    "form": ("form",),
    "scope": ("the the", "und die"),
    "other_scope": ("license", "password"),
    "notice": ("that", "sich"),
    "completed": ("with", "nicht"),
    "irrelevant": ("eau", "schpf"),
    "business": ("ción", "heit", "édes", "tha"),
}


def mails(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.substring_index("text", "\n", 1).alias("subject"), F.expr("substring(text, length(substring_index(text, '\n', 1)) + 2)").alias("body"), F.lit("").alias("extra"), "lang", "source")


MAILS = "m AS (SELECT doc_id, split_part(coalesce(text, ''), chr(10), 1) AS subject, substr(coalesce(text, ''), len(split_part(text, chr(10), 1)) + 2) AS body, '' AS extra, lang, coalesce(source, '') AS source FROM documents)"


def hit(text: str, *names: str) -> str:
    return "(" + " OR ".join(f"contains(lower({text}), '{t}')" for n in names for t in GROUPS[n]) + ")"


NEAR, WHOLE = "(subject || ' ' || body)", "(subject || ' ' || body || ' ')"
ROUTED = f"""{MAILS},
f AS (SELECT *, source = 'src1' AS f_self, source = 'src2' AS f_sender, source = 'src3' AS f_all, source = 'src4' AS f_address,
{hit('subject', 'action', 'request')} AS sa, {hit('subject', 'strict')} AS st, {hit('subject', 'change')} AS ch, {hit('subject', 'soft')} AS so, {hit('body[:5000]', 'change')} AS bc,
{hit(NEAR, 'action', 'request')} AS asked, {hit(NEAR, 'explicit')} AS ex, {hit(WHOLE, 'scope')} AND NOT {hit(WHOLE, 'other_scope')} AS sc, {hit(NEAR, 'notice')} AS nt, {hit(NEAR, 'completed')} AS cp,
{hit(WHOLE, 'business')} AS bu, {hit(WHOLE, 'irrelevant')} AS ir FROM m),
w AS (SELECT *, CASE WHEN f_self THEN 1 WHEN f_sender THEN 2 WHEN f_all THEN 3 WHEN st OR ch OR (so AND NOT sa) THEN 4 WHEN bc THEN 5 WHEN asked AND sc THEN 6
WHEN nt AND ((cp AND NOT ex) OR NOT asked) THEN 7 WHEN ir AND NOT bu AND NOT asked THEN 8 WHEN asked AND bu THEN 9 WHEN asked AND sa THEN 10 WHEN bu AND ir AND NOT asked THEN 11
WHEN bu THEN 12 WHEN f_address AND NOT bu AND NOT asked THEN 13 WHEN NOT bu AND NOT asked THEN 14 ELSE 15 END AS no FROM f),
r AS (SELECT doc_id, lang, source, ['filtered','filtered','filtered','filtered','filtered','filtered','filtered','filtered','valid','valid','filtered','uncertain','filtered','filtered','uncertain'][no] AS status,
['self sent','internal sender','internal recipients','off topic','change in body','excluded scope','notice','irrelevant','action and business','action in subject','business and irrelevant','business only','internal, nothing else','nothing','rest'][no] AS reason,
no IN (2, 6) AS hard, no NOT IN (1, 2, 3, 4, 6, 7) AS eligible FROM w)"""


def routed(spark, sf_dir):
    source = F.coalesce("source", F.lit(""))
    flags = {"self_sent": source == "src1", "internal_sender": source == "src2", "internal_recipients": source == "src3", "internal_address": source == "src4"}
    return rules.route(mails(spark, sf_dir), "subject", "body", "extra", GROUPS, flags).drop("subject", "body", "extra")


@plans.add("c2_route", f"WITH {ROUTED} SELECT doc_id, status, reason, hard, eligible FROM r")
def c2(spark, sf_dir):
    return routed(spark, sf_dir).select("doc_id", "status", "reason", "hard", "eligible")


TERMS = ("password", "token", "license", "ción", "heit", "éau", "the ")


@plans.add("c1_first_hit", "SELECT doc_id, CASE " + " ".join(f"WHEN contains(lower(text), '{t}') THEN '{t}'" for t in TERMS) + " END AS term FROM documents")
def c1(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", rules.first_hit(F.col("text"), TERMS).alias("term"))


@plans.add("c1_first_hit_by_table", "WITH t AS (SELECT item_id AS rank, lower(split_part(text, ' ', 1)) AS term FROM benchmark), h AS (SELECT doc_id, rank, term FROM documents JOIN t ON contains(lower(text), term)) SELECT doc_id, arg_min(term, (rank, term)) AS term FROM h GROUP BY doc_id")
def c1_table(spark, sf_dir):
    terms = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("rank"), F.lower(F.substring_index("text", " ", 1)).alias("term"))
    return rules.first_hit_by_table(table(spark, sf_dir, "documents"), "text", "doc_id", terms)


@plans.add("c3_all_internal", r"""WITH a AS (SELECT doc_id, list_filter(list_distinct(regexp_extract_all(lower(text), '[A-Za-z0-9_.+-]+@[A-Za-z0-9_.-]+\.[A-Za-z]{2,}')), lambda x: x <> 'a@b.cd') AS l FROM documents)
SELECT doc_id, coalesce(len(l) > 0, false) AND len(list_filter(l, lambda x: NOT (suffix(x, '@mail3.example.com') OR suffix(x, '@mail4.example.com')))) = 0 AS v FROM a""")
def c3(spark, sf_dir):
    from tallyspark.functions.text import all_addresses

    rows = table(spark, sf_dir, "documents")
    return rows.select("doc_id", rules.all_internal(all_addresses(F.col("text")), ["a@b.cd"], ["mail3.example.com", "mail4.example.com"]).alias("v"))


@plans.add("c4_internal_sender", "SELECT doc_id, coalesce(source IN ('src1', 'src2'), false) AS v FROM documents")
def c4(spark, sf_dir):
    from tallyspark.functions.text import domain_in

    rows = table(spark, sf_dir, "documents")
    return rows.select("doc_id", domain_in(F.concat(F.lit("x@"), "source"), ("src1", "src2")).alias("v"))


@plans.add("c5_near", r"SELECT doc_id, regexp_matches(text, '(?is)(?:license).{0,48}(?:version)') OR regexp_matches(text, '(?is)(?:version).{0,48}(?:license)') AS v FROM documents")
def c5(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", rules.near(F.col("text"), "license", "version").alias("v"))


def turns(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text", rules.any_hit(F.col("text"), ("tion", "ción", "heit")).alias("out"))


TURNS = "t AS (SELECT conv_id, turn, role, text, coalesce(contains(lower(text), 'tion') OR contains(lower(text), 'ción') OR contains(lower(text), 'heit'), false) AS gone FROM conversations)"


@plans.add("c6_scope_exclude", f"WITH {TURNS} SELECT DISTINCT conv_id, role, 'project' AS scope FROM t WHERE gone")
def c6(spark, sf_dir):
    return rules.scope_exclude(turns(spark, sf_dir), "conv_id", "role", F.col("out"))[1]


@plans.add("c7_downgrade_orphans", f"WITH {TURNS} SELECT DISTINCT conv_id, role, CASE WHEN conv_id IN (SELECT conv_id FROM t WHERE NOT gone) THEN 'project' ELSE '' END AS scope FROM t WHERE gone")
def c7(spark, sf_dir):
    kept, gone = rules.scope_exclude(turns(spark, sf_dir), "conv_id", "role", F.col("out"))
    return rules.downgrade_orphans(gone, kept, "conv_id")


@plans.add("c8_settled", "SELECT doc_id, reason IN ('notice', 'off topic') AS v FROM r".join([f"WITH {ROUTED} ", ""]))
def c8(spark, sf_dir):
    return routed(spark, sf_dir).select("doc_id", rules.is_settled(F.col("reason"), ("notice", "off topic")).alias("v"))


DETAIL = """SELECT o_orderkey, o_orderkey % 5 AS m, CASE WHEN o_orderkey % 5 = 0 THEN ' ' ELSE 'agent ' || o_custkey % 50 END AS agent,
CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE 'company ' || o_custkey END AS company, o_orderpriority AS project, CASE WHEN o_orderstatus = 'P' THEN 'ask' ELSE 'register' END AS request,
CASE WHEN o_orderkey % 11 = 0 THEN 'low' ELSE 'medium' END AS confidence FROM orders"""


def details(spark, sf_dir):
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", F.when(k % 5 == 0, " ").otherwise(F.concat(F.lit("agent "), F.col("o_custkey") % 50)).alias("agent"), F.when(k % 7 != 0, F.concat(F.lit("company "), "o_custkey")).alias("company"),
        F.col("o_orderpriority").alias("project"), F.when(F.col("o_orderstatus") == "P", "ask").otherwise("register").alias("request"), F.when(k % 11 == 0, "low").otherwise("medium").alias("confidence"),
    )


def gate(rows):
    none = F.lit(None).cast("string")
    return {"agent": F.col("agent"), "company": F.col("company"), "project": F.col("project"), "request": F.col("request"), "method": none, "confidence": F.col("confidence"), "semantic": none, "rules": none}


@plans.add("c9_queue_of", f"WITH d AS ({DETAIL}) SELECT o_orderkey, CASE WHEN trim(agent) <> '' AND company IS NOT NULL AND request = 'register' AND confidence <> 'low' THEN 'work' ELSE 'review' END AS queue FROM d")
def c9(spark, sf_dir):
    rows = details(spark, sf_dir)
    return rows.select("o_orderkey", rules.queue_of(gate(rows), ("register", "add")).alias("queue"))


@plans.add("c10_review_hint", f"WITH d AS ({DETAIL}) SELECT o_orderkey, array_to_string(list_distinct_in_order, '；') AS hint FROM d".replace("list_distinct_in_order", "list_filter([CASE WHEN trim(agent) = '' THEN 'agent' END, CASE WHEN company IS NULL THEN 'company' END, CASE WHEN request <> 'register' THEN 'request' END], lambda x: x IS NOT NULL)"))
def c10(spark, sf_dir):
    hints = [(F.trim("agent") == "", "agent"), (F.col("company").isNull(), "company"), (F.col("request") != "register", "request"), (F.trim("agent") == "", "agent")]
    return details(spark, sf_dir).select("o_orderkey", rules.review_hint(hints).alias("hint"))


@plans.add("c11_prequery", f"""WITH d AS ({DETAIL}), s AS (SELECT *, CASE WHEN trim(agent) = '' THEN 'skip_no_agent' WHEN confidence = 'low' THEN 'skip_low' END AS skip FROM d),
n AS (SELECT *, row_number() OVER (PARTITION BY skip, agent, company, project ORDER BY o_orderkey) AS no FROM s)
SELECT o_orderkey, coalesce(skip, CASE WHEN no > 1 THEN 'duplicate' ELSE 'query' END) AS lookup FROM n""")
def c11(spark, sf_dir):
    return rules.prequery(details(spark, sf_dir), "agent", "company", "project", "confidence", "o_orderkey", lambda c: F.lower(F.regexp_replace(c, " ", ""))).select("o_orderkey", "lookup")


@plans.add("c12_required_fields", f"WITH d AS ({DETAIL}) SELECT o_orderkey, list_filter([CASE WHEN trim(agent) = '' THEN 'agent' END, CASE WHEN company IS NULL THEN 'company' END], lambda x: x IS NOT NULL) AS lacking FROM d")
def c12(spark, sf_dir):
    return details(spark, sf_dir).select("o_orderkey", rules.required_fields(["agent", "company", "project"]).alias("lacking"))


@plans.add("c13_day_between", "SELECT o_orderkey FROM orders WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '1997-01-01' AND DATE '1998-06-30'")
def c13(spark, sf_dir):
    keep = rules.day_between(F.col("o_orderdate").cast("date"), F.lit("1998-06-30").cast("date"), F.lit("1997-01-01").cast("date"))
    return table(spark, sf_dir, "orders").where(keep).select("o_orderkey")


@plans.add("c14_confirmed_only", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F'")
def c14(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").withColumn("state", F.when(F.col("o_orderstatus") == "F", "confirmed").otherwise("open"))
    return rules.confirmed_only(rules.confirmed_only(rows, "state"), "no such column").select("o_orderkey")


@plans.add("c15_is_special", f"WITH {MAILS} SELECT doc_id, CASE WHEN lang = 'en' THEN false ELSE contains(lower(subject || ' ' || body), 'heit') END AS v FROM m")
def c15(spark, sf_dir):
    rows = mails(spark, sf_dir)
    return rows.select("doc_id", rules.is_special(F.when(F.col("lang") == "en", F.lit("plain")), F.col("subject"), F.col("body"), ("heit",)).alias("v"))


@plans.add("e3_queue_counts", f"""WITH {ROUTED}, {TURNS}, x AS (SELECT DISTINCT conv_id, role, CASE WHEN conv_id IN (SELECT conv_id FROM t WHERE NOT gone) THEN 'project' ELSE '' END AS scope FROM t WHERE gone),
a AS (SELECT count(*) AS active, count(*) FILTER (status = 'valid') AS n_valid, count(*) FILTER (status = 'uncertain') AS n_uncertain, count(*) FILTER (status = 'filtered') AS n_filtered FROM r),
b AS (SELECT count(*) FILTER (scope = '') AS whole_exclusions, count(*) FILTER (scope = 'project') AS project_exclusions FROM x)
SELECT *, active + whole_exclusions AS total FROM a, b""")
def e3(spark, sf_dir):
    return rollup.queue_counts(routed(spark, sf_dir), c7(spark, sf_dir), "status", "scope")


VERDICTS = "v AS (SELECT doc_id, max(quality) = 1 AND max(toxic) = 0 AS is_target, CASE WHEN max(toxic) = 1 THEN 'low' ELSE 'high' END AS confidence FROM labels GROUP BY doc_id)"


def verdicts(spark, sf_dir):
    return table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("q"), F.max("toxic").alias("t")).select("doc_id", ((F.col("q") == 1) & (F.col("t") == 0)).alias("is_target"), F.when(F.col("t") == 1, "low").otherwise("high").alias("confidence"))


@plans.add("j12_intent_verdict", f"""WITH {ROUTED}, {VERDICTS} SELECT r.doc_id,
CASE WHEN hard THEN status WHEN v.doc_id IS NULL THEN 'uncertain' WHEN is_target THEN 'valid' WHEN confidence = 'low' THEN 'uncertain' ELSE 'filtered' END AS final_status,
CASE WHEN hard THEN reason WHEN v.doc_id IS NULL THEN 'no verdict, manual' WHEN is_target THEN CASE WHEN status = 'valid' THEN reason ELSE 'verdict: target' END WHEN confidence = 'low' THEN 'verdict unsure' ELSE 'verdict: no target' END AS final_reason
FROM r LEFT JOIN v ON r.doc_id = v.doc_id""")
def j12(spark, sf_dir):
    return rules.merge_intent_verdict(routed(spark, sf_dir), verdicts(spark, sf_dir), "doc_id").select("doc_id", "final_status", "final_reason")


@plans.add("j13_field_verdict", """WITH v AS (SELECT doc_id, max(toxic) AS t, min(quality) AS q FROM labels GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN v.doc_id IS NULL THEN 'failed' WHEN t = 1 THEN 'invalid' ELSE 'valid' END AS semantic,
coalesce(concat_ws('、', CASE WHEN t = 1 THEN 'TOXIC' END, CASE WHEN q = 0 THEN 'QUALITY' END), '') AS issue_codes,
CASE WHEN v.doc_id IS NULL OR t = 1 THEN 'manual' ELSE 'medium' END AS confidence FROM documents d LEFT JOIN v ON d.doc_id = v.doc_id""")
def j13(spark, sf_dir):
    label = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("toxic").alias("t"), F.min("quality").alias("q"))
    issue = lambda test, code: F.when(test, F.struct(F.lit(code).alias("code"), F.lit("text").alias("field"), F.lit("label").alias("reason")))
    given = label.select("doc_id", F.when(F.col("t") == 1, "invalid").otherwise("valid").alias("verdict"), F.array_compact(F.array(issue(F.col("t") == 1, "TOXIC"), issue(F.col("q") == 0, "QUALITY"))).alias("issues"))
    rows = table(spark, sf_dir, "documents").select("doc_id", F.lit("medium").alias("confidence"))
    return rules.merge_field_verdict(rows, given, "doc_id").select("doc_id", "semantic", "issue_codes", "confidence")


@plans.add("j14_verdict_ids", "WITH a AS (SELECT DISTINCT doc_id FROM documents WHERE doc_id % 2 = 0), g AS (SELECT doc_id, count(*) AS n FROM labels GROUP BY doc_id) SELECT coalesce(a.doc_id, g.doc_id) AS doc_id, CASE WHEN g.doc_id IS NULL THEN 'absent' WHEN a.doc_id IS NULL THEN 'not asked' ELSE 'repeated' END AS problem FROM a FULL JOIN g ON a.doc_id = g.doc_id WHERE g.doc_id IS NULL OR a.doc_id IS NULL OR n > 1")
def j14(spark, sf_dir):
    asked = table(spark, sf_dir, "documents").where("doc_id % 2 = 0").select("doc_id")
    return rules.check_verdict_ids(asked, table(spark, sf_dir, "labels").select("doc_id"), "doc_id")


@plans.add("j15_share_decision", "SELECT o_orderkey, first_value(o_orderstatus) OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderkey) AS decision FROM orders")
def j15(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.array("o_orderpriority", F.lit("x")).alias("options"), F.col("o_orderstatus").alias("decision"))
    return rules.share_decision(rows, "o_custkey", "options", "decision", "o_orderkey").select("o_orderkey", "decision")


@plans.add("j16_promote", f"WITH d AS ({DETAIL}) SELECT o_orderkey, CASE WHEN m = 1 AND company IS NOT NULL AND confidence <> 'low' THEN 'high' ELSE confidence END AS confidence, CASE WHEN m = 1 AND company IS NOT NULL AND confidence <> 'low' THEN '' WHEN m = 0 THEN 'not reviewed' ELSE 'look' END AS hint FROM d")
def j16(spark, sf_dir):
    m = F.col("o_orderkey") % 5
    confidence, hint = rules.promote(F.col("confidence"), F.lit("look"), F.when(m != 0, m == 1), F.col("company").isNotNull(), F.lit(True))
    return details(spark, sf_dir).select("o_orderkey", confidence.alias("confidence"), hint.alias("hint"))


OUT = f"WITH {reconcile.SIMPLE}, s AS (SELECT k, anchor, o_custkey, n_in, CASE WHEN n_in + n_unknown = 0 THEN 'missing' WHEN n_in + n_unknown = 1 THEN 'recorded' ELSE 'review' END AS status FROM c)"


def outcomes(spark, sf_dir):
    out = reconcile.j1(spark, sf_dir).select("k", "anchor", "n_in", "status")
    return out.join(reconcile.work(spark, sf_dir).select("k", "o_custkey"), "k")


@plans.add("e1_outcome_summary", OUT + """, t AS (SELECT *, CASE status WHEN 'recorded' THEN 'found' WHEN 'missing' THEN 'missing' ELSE 'pending' END AS kind FROM s)
SELECT o_custkey, count(*) FILTER (kind = 'found') AS found, count(*) FILTER (kind = 'missing') AS missing, count(*) FILTER (kind = 'pending') AS pending, count(*) AS total,
string_agg(DISTINCT kind, ',' ORDER BY kind) AS labels, max(anchor) AS last_check FROM t GROUP BY o_custkey""")
def e1(spark, sf_dir):
    status = F.col("status")
    none = F.lit(None).cast("string")
    kind = rollup.outcome_class(F.when(status == "recorded", "yes").when(status == "missing", "no").otherwise("open"), none, none, F.lit(False), none)
    return rollup.outcome_summary(outcomes(spark, sf_dir), ["o_custkey"], kind, "anchor")


@plans.add("e2_owner_status", OUT + """ SELECT o_custkey, CASE WHEN bool_and(status = 'recorded') THEN 'confirmed' WHEN bool_or(status = 'recorded') THEN 'partial' WHEN bool_or(status = 'review') THEN 'review' ELSE 'ready' END AS mail_status,
count(*) FILTER (status = 'recorded') AS n_ready, count(DISTINCT year(anchor)) AS n_companies, count(DISTINCT month(anchor)) AS n_projects, count(*) AS n_details FROM s GROUP BY o_custkey""")
def e2(spark, sf_dir):
    rows = outcomes(spark, sf_dir).withColumn("y", F.year("anchor").cast("string")).withColumn("m", F.month("anchor").cast("string"))
    return rollup.mail_status(rows, "o_custkey", "status", F.col("status") == "recorded", "y", "m")


@plans.add("e4_ledger_summary", "SELECT event_type AS dataset, count(*) AS n, (SELECT count(*) FROM orders) AS n_operations, (SELECT max(CAST(o_orderdate AS DATE)) FROM orders) AS last_day FROM events GROUP BY 1 UNION ALL SELECT 'none', 0, (SELECT count(*) FROM orders), (SELECT max(CAST(o_orderdate AS DATE)) FROM orders)")
def e4(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("dataset"))
    ops = table(spark, sf_dir, "orders").select(F.col("o_orderdate").cast("date").alias("day"))
    return rollup.ledger_summary(rows, ops, rows.distinct().union(spark.createDataFrame([("none",)], "dataset string")), "dataset", "day")


@plans.add("e5_consensus", """WITH w AS (SELECT conv_id, role, unnest(string_split(lower(text), ' ')) AS value FROM conversations), c AS (SELECT conv_id, role, value, CASE role WHEN 'user' THEN 3 WHEN 'assistant' THEN 2 ELSE 1 END AS p FROM w WHERE len(value) > 3),
e AS (SELECT conv_id, value, count(DISTINCT role) AS s, max(p) AS p, count(*) AS m FROM c GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY s DESC, p DESC, m DESC, len(value) DESC, encode(value) DESC) AS no FROM e)
SELECT conv_id, value, s AS n_sources, m AS mentions, s >= 2 AS accepted FROM r WHERE no = 1""")
def e5(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "role", F.explode(F.split(F.lower("text"), " ")).alias("value")).where("length(value) > 3")
    return rollup.consensus(rows.withColumn("p", F.when(F.col("role") == "user", 3).when(F.col("role") == "assistant", 2).otherwise(1)), "conv_id", "value", "role", "p")


@plans.add("e6_count_check", "SELECT l_orderkey, max(l_linenumber) AS n_expected, count(*) AS n_actual, min(l_linenumber) = max(l_linenumber) AND max(l_linenumber) = count(*) AS agrees FROM lineitem GROUP BY 1")
def e6(spark, sf_dir):
    return rollup.count_check(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber")


@plans.add("e7_drop_placeholders", "WITH p AS (SELECT p_partkey, p_brand, p_type, p_name, p_size > 25 AS ok FROM part), g AS (SELECT p_brand, p_type, count(DISTINCT p_name) FILTER (ok) AS n FROM p GROUP BY ALL) SELECT p_partkey FROM p JOIN g USING (p_brand, p_type) WHERE ok OR n <> 1")
def e7(spark, sf_dir):
    return rollup.drop_placeholders(table(spark, sf_dir, "part"), ["p_brand", "p_type"], "p_name", F.col("p_size") > 25).select("p_partkey")


@plans.add("e8_prune_umbrella", "WITH p AS (SELECT p_partkey, p_brand, p_type, p_size < 20 AS u FROM part), q AS (SELECT *, bool_or(NOT u) OVER (PARTITION BY p_brand, p_type) AS s FROM p) SELECT p_partkey, u AS flagged FROM q WHERE NOT (u AND s)")
def e8(spark, sf_dir):
    return rollup.prune_umbrella(table(spark, sf_dir, "part"), "p_brand", "p_type", F.col("p_size") < 20).select("p_partkey", "flagged")


@plans.add("e9_history_projection", """WITH r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS no FROM orders),
s AS (SELECT o_custkey, o_orderstatus AS v, min(no) AS no FROM r GROUP BY ALL), p AS (SELECT o_custkey, o_orderpriority AS v, min(no) AS no FROM r GROUP BY ALL)
SELECT o_custkey, (SELECT string_agg(v, '、' ORDER BY no) FROM s WHERE s.o_custkey = o.o_custkey) AS o_orderstatus, (SELECT string_agg(v, '、' ORDER BY no) FROM p WHERE p.o_custkey = o.o_custkey) AS o_orderpriority,
CASE WHEN bool_and(o_orderstatus <> 'P') THEN 'done' ELSE 'open' END AS status FROM orders o GROUP BY o_custkey""")
def e9(spark, sf_dir):
    return rollup.history_projection(table(spark, sf_dir, "orders"), "o_custkey", "o_orderkey", ["o_orderstatus", "o_orderpriority"], F.col("o_orderstatus") != "P")


@plans.add("e10_batch_outcome", "WITH a AS (SELECT count(*) FILTER (o_orderstatus = 'F') AS n_done, count(*) FILTER (o_orderstatus = 'O') AS n_unresolved, count(*) FILTER (o_orderstatus = 'P') AS n_blocked, 0::BIGINT AS n_duplicate FROM orders) SELECT *, n_unresolved || ' unresolved, ' || n_blocked || ' blocked' AS message FROM a")
def e10(spark, sf_dir):
    state = F.when(F.col("o_orderstatus") == "F", "done").when(F.col("o_orderstatus") == "O", "unresolved").otherwise("blocked")
    return rollup.batch_outcome(table(spark, sf_dir, "orders").select(state.alias("state")), "state")


REASONS = f"WITH d AS ({DETAIL}), e AS (SELECT d.*, count(*) OVER (PARTITION BY orders.o_custkey) > 1 AS many FROM d JOIN orders USING (o_orderkey)), r AS (SELECT o_orderkey, list_filter([CASE WHEN many THEN 'multi_row' END, CASE WHEN company IS NULL THEN 'no_company' END, CASE WHEN confidence = 'low' THEN 'unsure' END], lambda x: x IS NOT NULL) AS review_reasons FROM e)"


@plans.add("e11_route_for_review", REASONS + " SELECT * FROM r")
def e11(spark, sf_dir):
    rows = details(spark, sf_dir).join(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_orderkey")
    return rollup.route_for_review(rows, "o_custkey", {"no_company": F.col("company").isNull(), "unsure": F.col("confidence") == "low"}).select("o_orderkey", "review_reasons")


@plans.add("e11_reason_counts", REASONS + " SELECT unnest(review_reasons) AS reason, count(*) AS n FROM r GROUP BY 1")
def e11_counts(spark, sf_dir):
    return rollup.review_reason_counts(e11(spark, sf_dir))


@plans.add("e12_merge_items", "WITH i AS (SELECT l_orderkey, p_brand AS b, p_name AS c, l_returnflag AS s, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate) AS seq FROM lineitem JOIN part ON l_partkey = p_partkey) SELECT l_orderkey, b AS k, b AS brand, max(c) FILTER (true) AS category0, string_agg(DISTINCT s, ',' ORDER BY s) AS sources, count(*) AS mentions FROM i GROUP BY l_orderkey, b".replace("max(c) FILTER (true) AS category0", "arg_max(c, (len(c), c)) AS category"))
def e12(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey")).withColumn("k", F.col("p_brand"))
    return rollup.merge_items(rows, ["l_orderkey", "k"], "p_brand", "p_name", "l_returnflag", "l_linenumber")


@plans.add("e13_coverage_gap", "SELECT o_orderkey, list_filter(['F', 'O', 'P'], lambda x: x <> o_orderstatus) AS gap, o_orderstatus = 'F' AS covers FROM orders")
def e13(spark, sf_dir):
    declared = F.array(F.lit("F"), F.lit("O"), F.lit("P"))
    return table(spark, sf_dir, "orders").select("o_orderkey", rollup.coverage_gap(declared, F.array("o_orderstatus")).alias("gap"), rollup.mapping_covers(F.array("o_orderstatus", F.lit("G")), F.array(F.lit("F"), F.lit("G"))).alias("covers"))


QUERIES["e14_mapping_covers"] = lambda spark, sf_dir: e13(spark, sf_dir).select("o_orderkey", "covers")
ORACLES["e14_mapping_covers"] = "SELECT o_orderkey, o_orderstatus = 'F' AS covers FROM orders"


@plans.add("e15_alias_index", "WITH a AS (SELECT p_brand AS official, unnest(string_split(lower(p_name), ' ')) AS alias FROM part) SELECT alias, list_sort(list(DISTINCT official)) AS officials FROM a WHERE len(alias) >= 2 GROUP BY alias")
def e15(spark, sf_dir):
    return rollup.alias_index(table(spark, sf_dir, "part"), "p_brand", F.split("p_name", " "))


@plans.add("g1_newest_first", "SELECT event_id, row_number() OVER (ORDER BY CASE WHEN event_id % 10 <> 0 THEN ts END DESC NULLS LAST, event_id) AS position FROM events")
def g1(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 10 != 0, F.col("ts")).alias("at"))
    return rollup.newest_first(rows, "at", "event_id").select("event_id", "position")


@plans.add("g2_missing_newest", OUT + " SELECT k, anchor, row_number() OVER (ORDER BY anchor DESC NULLS LAST, k) AS position FROM s WHERE status = 'missing'")
def g2(spark, sf_dir):
    return rollup.missing_list(outcomes(spark, sf_dir), "status", "anchor", "k").select("k", "anchor", "position")


@plans.add("g3_top_per_key", "SELECT user_id, event_id, place FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS place FROM events) WHERE place <= 3")
def g3(spark, sf_dir):
    return rollup.top_per_key(table(spark, sf_dir, "events"), ["user_id"], [F.col("value").desc(), F.col("event_id")], 3).select("user_id", "event_id", "place")


@plans.add("g4_within_cap", "SELECT n_nationkey FROM nation")
def g4(spark, sf_dir):
    return rollup.within_cap(table(spark, sf_dir, "nation"), 200).select("n_nationkey")
