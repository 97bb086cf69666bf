"""Text functions over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyspark.functions import company as C
from tallyspark.functions import similarity as S
from tallyspark.functions import text as T

from .base import Plans, table

plans = Plans()
QUERIES, ORACLES = plans.queries, plans.oracles

#: Fixed value: phrases that mark a line as boilerplate, and words that stand for a service.
PHRASES = ("licensed under", "rights reserved", "cookie", "subscribe")
SERVICES = (("license", ("license", "licensed")), ("contact", ("@", "phone")), ("code", ("token", "password", "key")))
SUFFIXES = ("inc", "ltd", "gmbh", "llc")


def names(spark, sf_dir):
    customer = table(spark, sf_dir, "customer").select(F.lit("c").alias("kind"), F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    supplier = table(spark, sf_dir, "supplier").select(F.lit("s").alias("kind"), F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    part = table(spark, sf_dir, "part").select(F.lit("p").alias("kind"), F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    return customer.union(supplier).union(part)


NAMES = """WITH n AS (SELECT 'c' AS kind, c_custkey AS id, c_name AS name FROM customer UNION ALL
SELECT 's', s_suppkey, s_name FROM supplier UNION ALL SELECT 'p', p_partkey, p_name FROM part)"""


def on_names(name: str, sql: str, fn):
    plans.add(name, f"{NAMES} SELECT kind, id, {sql} AS v FROM n")(lambda spark, sf_dir: names(spark, sf_dir).select("kind", "id", fn(F.col("name")).alias("v")))


on_names("b1_norm_text", "lower(replace(replace(name, ' ', ''), '（', '('))", T.norm_text)
on_names("b3_product_key", r"regexp_replace(lower(name), '[\s\-_/.,:;|+()\[\]{}''\x22]+', '', 'g')", T.product_key)
on_names("b4_company_key", r"regexp_replace(regexp_replace(lower(replace(name || ' GmbH.', ' ', '')), '(?:gmbh|inc|ltd|llc)\.?$', ''), '^[.,;:()-]+|[.,;:()-]+$', '', 'g')", lambda c: T.company_key(F.concat(c, F.lit(" GmbH.")), SUFFIXES))
on_names("b14_strip_reply_prefix", "name", lambda c: T.strip_reply_prefix(F.concat(F.lit("RE: Fwd: "), c)))
on_names("b16_split_top_level", "[name || ' (a+b)', 'z']", lambda c: T.split_top_level(F.concat(c, F.lit(" (a+b) + + z"))))
on_names("b18_client_codes", "['AB1234', 'C' || lpad(CAST(id + 1000 AS VARCHAR), 8, '0')]", lambda c: T.client_codes(F.concat(F.lit("ab-1234 c "), F.lpad((F.col("id") + 1000).cast("string"), 8, "0"), F.lit(" AB 1234"))))
on_names("b19_code_near", "CASE WHEN id % 2 = 0 THEN 'XY9876' END", lambda c: T.code_near(F.concat(F.when(F.col("id") % 2 == 0, "AA-1111 xy-9876 of ").otherwise("none of "), c, F.lit(" ZZ-5555")), c))
on_names("b26_split_multi_cell", "CASE WHEN id % 2 = 0 THEN [name || ', Inc.'] ELSE [name, 'other'] END", lambda c: T.split_multi_cell(F.concat(c, F.when(F.col("id") % 2 == 0, ", Inc.").otherwise(", other")), SUFFIXES))
on_names("b27_junk_value", "id % 3 = 0 OR id % 3 = 1", lambda c: T.is_junk_value(F.when(F.col("id") % 3 == 0, "none").when(F.col("id") % 3 == 1, "12.5 kg").otherwise(F.concat(c, F.lit("!"))), ("none", "tbd")))
on_names("b28_dedupe_joined", "name || ' / b'", lambda c: T.dedupe_joined(F.concat(c, F.lit("/"), F.upper(c), F.lit("/ b / B"))))
on_names("b29_unique_join", "name || '、x'", lambda c: T.unique_join(F.array(c, F.lit(" "), F.lower(c), F.lit("x"), F.lit("X"))))
on_names("b33_sanitize_company", "CASE WHEN id % 2 = 0 THEN name ELSE trim(name) END", lambda c: C.sanitize_company(F.when(F.col("id") % 2 == 0, F.concat(F.lit("a\tbc\n"), c)).otherwise(F.concat(F.lit(" "), c, F.lit("　")))))
on_names("b34_repair_truncated", "CASE WHEN id % 2 = 0 THEN 'New ' || name ELSE name END", lambda c: T.repair_truncated(c, F.when(F.col("id") % 2 == 0, F.array(F.concat(F.lit("New "), c), F.lit("z"))).otherwise(F.array(F.concat(F.lit("New "), c), F.concat(F.lit("Old "), c)))))
on_names("b35_strip_alias_prefix", "CASE WHEN id % 2 = 0 THEN name || ' ltd' ELSE 'acme ' || name END", lambda c: T.strip_alias_prefix(F.concat(F.lit("acme "), c, F.when(F.col("id") % 2 == 0, " ltd").otherwise("")), ("acme", "ac"), SUFFIXES))
on_names("b36_decompose_category", "{'family': lower(regexp_replace(name, '(?i)small|large|mini', 'x', 'g')), 'size_word': 'small', 'exclusions': ['tv', 'pc']}", lambda c: T.decompose_category(F.concat(F.lit("Small "), F.regexp_replace(c, "(?i)small|large|mini", "x"), F.lit(" (except TV, PC)"))))
on_names("b37_display_class", "CASE WHEN id % 3 = 0 THEN 'portable' WHEN id % 3 = 1 THEN 'class 1' ELSE name END", lambda c: T.display_class(F.when(F.col("id") % 3 == 0, "p").otherwise(c), F.when(F.col("id") % 3 == 1, F.lit(1)), {"p": "portable"}))
on_names("b38_label_of", "CASE kind WHEN 'c' THEN 'buyer' WHEN 's' THEN 'seller' ELSE 'p' END", lambda c: T.label_of(F.col("kind"), {"c": "buyer", "s": "seller"}))
on_names("b41_evidence_within", "id % 2 = 0", lambda c: T.evidence_within(F.array(F.upper(c), F.lit("")), F.when(F.col("id") % 2 == 0, F.concat(F.lit("the "), c, F.lit(" here"))).otherwise("nothing")))
on_names("b45_clean_candidate", "CASE WHEN id % 2 = 0 THEN name ELSE '' END", lambda c: T.clean_candidate(F.when(F.col("id") % 2 == 0, F.concat(F.lit(", ("), c, F.lit(" https://x.y/z ;"))).otherwise(F.lit("tbd.")), ("tbd",)))
on_names("b46_merge_dimensions", "[name || ' 20 cm', 'x', 'y 3 m']", lambda c: T.merge_dimensions(F.array(F.lit("5cm"), c, F.lit("20 cm"), F.lit("x"), F.lit("y"), F.lit("3 m"))))
on_names("b47_accept_company", "CASE WHEN id % 2 = 0 THEN name || ' GmbH' ELSE '' END", lambda c: C.accept_company(F.concat(c, F.when(F.col("id") % 2 == 0, " GmbH").otherwise(" page")), SUFFIXES))
on_names("b49_stored_number", "CASE id % 3 WHEN 0 THEN 'N' || id WHEN 1 THEN 'key' ELSE upper(sha1(name)[:24]) END", lambda c: T.stored_number(F.when(F.col("id") % 3 == 0, F.concat(F.lit("N"), F.col("id"))).otherwise(" "), F.when(F.col("id") % 3 == 1, F.lit("key")), c))
on_names("b50_item_id", "upper(sha1(kind || '|' || name)[:24])", lambda c: T.stored_number(F.lit(None).cast("string"), F.lit(""), F.concat_ws("|", "kind", c)))
on_names("b51_suggested_value", "[name, 'other']", lambda c: T.suggested_value("company", F.lit("  "), F.concat(F.lit("please set Company: "), c, F.lit(" | other; then go"))))
on_names("b52_values_by_alias", "[name, 'b']", lambda c: T.values_by_alias(F.create_map(F.lit("Main Brand"), F.concat(c, F.lit(", b")), F.lit("brand 2"), F.lit("b"), F.lit("size"), F.lit("9")), ("brand",)))
on_names("b53_status_label", "id % 4 IN (0, 1)", lambda c: T.is_complete(F.element_at(F.array(F.lit("confirmed"), F.lit("filtered"), F.lit("ready"), F.lit(None)), (F.col("id") % 4 + 1).cast("int"))))
on_names("b22_service_of", "CASE WHEN lower(name) LIKE '%gear%' OR lower(name) LIKE '%bolt%' THEN 'metal' WHEN lower(name) LIKE '%0000%' THEN 'early' ELSE 'other' END", lambda c: T.case_on(c, (("metal", ("gear", "BOLT")), ("early", ("0000",))), "other"))
on_names("b32_company_noise", "CASE id % 7 WHEN 0 THEN 'missing' WHEN 1 THEN 'email' WHEN 2 THEN 'contact' WHEN 3 THEN 'code' WHEN 4 THEN 'file' WHEN 5 THEN 'sentence' ELSE '' END", lambda c: C.company_noise(F.when(F.col("id") % 7 == 0, " ").when(F.col("id") % 7 == 1, F.concat(c, F.lit("@x"))).when(F.col("id") % 7 == 2, F.lit("+49 (30) 123")).when(F.col("id") % 7 == 3, F.lit("AB-12345")).when(F.col("id") % 7 == 4, F.concat(c, F.lit(".PDF"))).when(F.col("id") % 7 == 5, F.rpad(F.concat(F.lit("x"), c), 121, "x")).otherwise(F.concat(c, F.lit(" Ltd")))))
on_names("b20_size_cm", "CASE id % 4 WHEN 0 THEN id * 100.0 WHEN 1 THEN id / 10.0 WHEN 2 THEN id ELSE 0 END::DOUBLE", lambda c: T.size_cm(F.concat(F.lit("width "), F.col("id"), F.element_at(F.array(F.lit(" m"), F.lit("mm"), F.lit(".0 cm"), F.lit(" kg")), (F.col("id") % 4 + 1).cast("int")))))
on_names("b30_search_variants", "CASE WHEN position(' ' IN name) > 0 THEN ['X ' || name, 'X' || replace(name, ' ', ''), replace(name, ' ', ''), 'X ' || name || ' (branch)'] ELSE ['X ' || name, 'X' || name, name, 'X ' || name || ' (branch)'] END", lambda c: T.search_variants(F.concat(F.lit("X "), c, F.lit(" (branch)")), "branch|office", ("X", "Y")))
on_names("b40_json_items", "CASE WHEN id % 2 = 0 THEN 1 ELSE 0 END", lambda c: F.size(T.json_items(F.when(F.col("id") % 2 == 0, F.concat(F.lit('[{"brand":"'), F.regexp_replace(c, '"', ""), F.lit('"}]'))).otherwise("not json"), "array<struct<brand:string>>")))
on_names("b48_evidence_json", "'[{\"sheet\":\"' || kind || '\",\"row\":' || id || '},{\"sheet\":\"' || kind || '\",\"row\":' || (id + 1) || '}]'", lambda c: T.evidence_json(F.transform(F.sequence(F.col("id"), F.col("id") + 8), lambda i: F.struct(F.col("kind").alias("sheet"), i.alias("row"))), 2))
on_names("b24_brand_values", "[name, 'zed']", lambda c: T.brand_values(F.concat(F.lit("Brand: "), c, F.lit(", zed, none category: 4")), "brand", "category|code", ("none",)))
on_names("b25_label_pairs", "[{'label': 'Name', 'value': name}, {'label': 'Size', 'value': '4 cm'}]", lambda c: T.label_pairs(F.concat(F.lit("Name: "), c, F.lit("\nno label here\nSize: 4 cm; rest"))))
on_names("b31_company_names", """CASE id % 4 WHEN 0 THEN ['Blue Sea' || id || ' Trading GmbH', 'Old Mill Ltd'] WHEN 1 THEN ['深圳市' || id || '科技有限公司'] WHEN 2 THEN ['Sun' || id || ' Co., Ltd', 'Moon Ltd'] ELSE [] END""", lambda c: C.company_names(F.element_at(F.array(F.concat(F.lit("we ask for Blue Sea"), F.col("id"), F.lit(" Trading GmbH and Old Mill Ltd, not Acme Ltd.")), F.concat(F.lit("客户 深圳市"), F.col("id"), F.lit("科技有限公司，联系人 王")), F.concat(F.lit("AB1234 Sun"), F.col("id"), F.lit(" Co., Ltd and Acme Moon Ltd")), F.concat(c, F.lit(" is no company, call Max Meier"))), (F.col("id") % 4 + 1).cast("int")), aliases=("Acme Ltd", "Acme")))
on_names("b33_sanitize_note", "CASE id % 3 WHEN 0 THEN 'kept one of 2 parts' ELSE '' END", lambda c: C.sanitize_note(F.when(F.col("id") % 3 == 0, F.concat(F.lit("a\t"), c)).when(F.col("id") % 3 == 1, F.concat(c, F.lit("\n \t")))))
on_names("b32_company_tests", "CASE id % 6 WHEN 0 THEN 'count' WHEN 1 THEN 'form note' WHEN 2 THEN 'label' WHEN 3 THEN 'unpaired' WHEN 4 THEN 'lead-in' ELSE 'person' END", lambda c: C.company_noise(F.element_at(F.array(F.concat(F.col("id").cast("string"), F.lit("家公司-x")), F.concat(F.lit("不能与"), F.lit("其它公司申请"), F.col("id")), F.concat(F.lit("公司地址 "), c), F.concat(c, F.lit(" (GmbH")), F.concat(F.lit("麻烦安排"), F.col("id"), F.lit("以下公司")), F.lit("Max Peter Meier")), (F.col("id") % 6 + 1).cast("int"))))
on_names("b25_inline_pairs", "[{'label': 'Brand', 'value': 'Zed' || id}, {'label': 'Category', 'value': 'lamps'}]", lambda c: T.inline_pairs(F.concat(F.lit("we add Brand Zed"), F.col("id"), F.lit(" class 3, any category; Category: lamps | rest")), ("brand",), ("category",)))
on_names("b25_class_pairs", "CASE WHEN id % 2 = 0 THEN [{'label': 'class', 'value': 'class ' || (id % 6 + 1)}, {'label': 'class', 'value': '第三类'}] ELSE [] END", lambda c: T.class_pairs(F.when(F.col("id") % 2 == 0, F.concat(F.lit("in class "), F.col("id") % 6 + 1, F.lit(" and 第三类, CLASS "), F.col("id") % 6 + 1)).otherwise(F.concat(c, F.lit(" class 31")))))
on_names("b27_value_shape", "id % 4 IN (0, 3)", lambda c: T.value_shape_ok(F.element_at(F.array(F.lit("太阳"), F.lit("x"), F.concat(c, F.lit("@b")), F.concat(F.lit("Zed & Co "), F.col("id"))), (F.col("id") % 4 + 1).cast("int"))))
on_names("b38_canonical_agent", "CASE WHEN id % 2 = 0 THEN 'One' ELSE name END", lambda c: T.canonical_agent(F.when(F.col("id") % 2 == 0, " Big One / big one").otherwise(c), F.create_map(F.lit("bigone"), F.lit("One"), F.lit("other"), F.lit(" "))))
on_names("b48_file_index", """'[{"file":"' || kind || id || '.xlsx","n":2,"at":["s!' || id || '"]},{"file":"b","n":0,"at":[]}]'""", lambda c: T.file_index(F.array(F.struct(F.concat("kind", F.col("id"), F.lit(".xlsx")).alias("file"), F.array(F.struct(F.lit("s").alias("sheet"), F.col("id").cast("int").alias("row")), F.struct(F.lit("s").alias("sheet"), F.lit(2).alias("row"))).alias("records")), F.struct(F.lit(" ").alias("file"), F.expr("cast(null as array<struct<sheet:string,row:int>>)").alias("records")), F.struct(F.lit("b").alias("file"), F.expr("cast(null as array<struct<sheet:string,row:int>>)").alias("records"))), 5, 1))
on_names("b23_need_of", "CASE id % 4 WHEN 0 THEN 'cancel' WHEN 1 THEN 'add' WHEN 2 THEN 'register' ELSE '' END", lambda c: T.need_of(F.element_at(F.array(F.lit("Cancel the registration"), F.lit("please add it, then register"), F.lit("do not cancel, register"), F.lit("hello")), (F.col("id") % 4 + 1).cast("int")), F.lit("best wishes"), ("cancel", "withdraw"), ("not", "never"), (("register", "register"), ("add", "add"))))

plans.add(
    "b2_identity_key",
    NAMES + " , k AS (SELECT kind, id, regexp_replace(lower(name), '[^a-z0-9]+', '', 'g') AS key FROM n) SELECT kind, key, count(*) AS n FROM k GROUP BY ALL",
)(lambda spark, sf_dir: names(spark, sf_dir).groupBy("kind", T.identity_key(F.col("name")).alias("key")).agg(F.count("*").alias("n")))


def docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


FIRST_ADDRESS = r"""SELECT doc_id, lower(trim(coalesce(nullif(regexp_extract(text, '<([^<>]+)>', 1), ''), nullif(regexp_extract(text, '[A-Za-z0-9_.+-]+@[A-Za-z0-9_.-]+\.[A-Za-z]{2,}'), ''), text), E' \t\r\n\x0B\x0C　')) AS v FROM documents"""


@plans.add("b5_first_address", FIRST_ADDRESS)
def b5(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", T.first_address(F.col("text")).alias("v"))


QUERIES["b5_first_address_whole"], ORACLES["b5_first_address_whole"] = b5, FIRST_ADDRESS


@plans.add("b6_all_addresses", r"""SELECT doc_id, list_sort(list_distinct(regexp_extract_all(lower(text), '[A-Za-z0-9_.+-]+@[A-Za-z0-9_.-]+\.[A-Za-z]{2,}'))) AS v FROM documents""")
def b6(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", T.all_addresses(F.col("text")).alias("v"))


@plans.add("b7_domains", r"""WITH a AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[A-Za-z0-9_.+-]+@[A-Za-z0-9_.-]+\.[A-Za-z]{2,}')) AS address FROM documents)
SELECT address, split_part(address, '@', 2) AS domain, split_part(address, '@', 2) = 'mail3.example.com' OR suffix(split_part(address, '@', 2), '.mail3.example.com') OR contains(split_part(address, '@', 2), 'mail5') AS inside FROM a""")
def b7(spark, sf_dir):
    rows = docs(spark, sf_dir).select(F.explode(T.all_addresses(F.col("text"))).alias("address")).distinct()
    return rows.select("address", T.domain_of(F.col("address")).alias("domain"), T.domain_in(F.col("address"), ("mail3.example.com",), ("mail5",)).alias("inside"))


@plans.add("b8_recipients", r"""SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '[A-Za-z0-9_.+-]+@[A-Za-z0-9_.-]+\.[A-Za-z]{2,}')).len() AS n FROM documents WHERE text IS NOT NULL UNION ALL SELECT doc_id, 0 FROM documents WHERE text IS NULL""")
def b8(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.size(T.recipients(F.lit(None).cast("array<string>"), F.col("text"))).cast("long").alias("n"))


@plans.add("b9_parse_ts", """SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN o_orderdate WHEN 1 THEN o_orderdate + INTERVAL 45 MINUTE WHEN 2 THEN o_orderdate END AS v,
CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') WHEN 1 THEN strftime(o_orderdate + INTERVAL 45 MINUTE, '%Y-%m-%d %H:%M:%S')
WHEN 2 THEN strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') ELSE 'soon' END AS key FROM orders""")
def b9(spark, sf_dir):
    day = F.col("o_orderdate")
    shape = F.col("o_orderkey") % 4
    text = F.when(shape == 0, F.date_format(day, "yyyy/MM/dd")).when(shape == 1, F.date_format(day, "yyyy-MM-dd'T'00:45:00.123'Z'")).when(shape == 2, F.date_format(day, "dd.MM.yyyy")).otherwise("soon")
    return table(spark, sf_dir, "orders").select("o_orderkey", T.parse_ts(text).alias("v"), T.ts_key(text).alias("key"))


ORACLES["b10_ts_key"] = "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS v FROM events"
QUERIES["b10_ts_key"] = lambda spark, sf_dir: table(spark, sf_dir, "events").select("event_id", T.ts_key(F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS")).alias("v"))


@plans.add("b12_html_text", r"""WITH a AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(?:style|script)\b[^>]*>.*?</(?:style|script)\s*>', chr(10), 'g'), '(?s)<!--.*?-->', chr(10), 'g'), '<[^>]*>', chr(10), 'g') AS t FROM pages),
b AS (SELECT page_id, replace(replace(replace(replace(replace(replace(t, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&') AS t FROM a)
SELECT page_id, array_to_string(list_filter(list_transform(string_split(t, chr(10)), lambda x: trim(x, E' \t\r\n\x0B\x0C　')), lambda x: x <> ''), chr(10)) AS v FROM b""")
def b12(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.html_text(F.col("html")).alias("v"))


@plans.add("b13_boilerplate", r"""WITH a AS (SELECT doc_id, text, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, E' \t\r\n\x0B\x0C　')), lambda x: x <> '' AND NOT contains(lower(x), 'licensed under') AND NOT contains(lower(x), 'rights reserved') AND NOT contains(lower(x), 'cookie') AND NOT contains(lower(x), 'subscribe')) AS kept FROM documents)
SELECT doc_id, CASE WHEN len(kept) > 0 THEN array_to_string(kept, chr(10)) ELSE text[:500] END AS v FROM a""")
def b13(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", T.strip_boilerplate(F.col("text"), PHRASES).alias("v"))


@plans.add("b17_split_values", "SELECT p_partkey, list_filter(string_split(p_name || ' ' || p_type, ' '), lambda x: x <> '') AS v FROM part")
def b17(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", T.split_values(F.translate(F.concat_ws(" ", "p_name", "p_type"), " ", ",")).alias("v"))


QUERIES["b15_split_glued"] = lambda spark, sf_dir: names(spark, sf_dir).select("kind", "id", T.split_glued_records(F.concat(F.lit("first company ltd"), F.lit("AB-12345 "), F.col("name"))).alias("v"))
ORACLES["b15_split_glued"] = NAMES + " SELECT kind, id, 'first company ltd' || chr(10) || 'AB-12345 ' || name AS v FROM n"


@plans.add("b39_fingerprint", """WITH a AS (SELECT doc_id, sha256('{"p0":' || to_json(lang) || ',"p1":' || doc_id || '}') AS v FROM documents) SELECT * FROM a""")
def b39(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", T.fingerprint(F.col("lang"), F.col("doc_id")).alias("v"))


def word_pairs(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    words = F.split("p_name", " ")
    return part.select(words[0].alias("a"), F.concat(words[1], F.lit(" "), words[0]).alias("b")).distinct()


LCS = """WITH RECURSIVE p AS (SELECT DISTINCT split_part(p_name, ' ', 1) AS a, split_part(p_name, ' ', 2) || ' ' || split_part(p_name, ' ', 1) AS b FROM part),
t(a, b, i, row) AS (SELECT a, b, 0, list_transform(range(len(b) + 1), lambda x: 0) FROM p
UNION ALL SELECT a, b, i + 1, list_reduce(range(1, len(b) + 1), lambda acc, j: list_append(acc, CASE WHEN b[j] = a[i + 1] THEN row[j] + 1 ELSE greatest(row[j + 1], acc[len(acc)]) END), [0]) FROM t WHERE i < len(a))
SELECT a, b, CAST(floor(200 * row[len(row)] / (len(a) + len(b))) AS INTEGER) AS v FROM t WHERE i = len(a)"""


@plans.add("b42_similarity", LCS)
def b42(spark, sf_dir):
    return word_pairs(spark, sf_dir).select("a", "b", S.similarity(F.col("a"), F.col("b")).alias("v"))


#: Pairs of the words of the parts' names, and each with both; windows of the longer one; common subsequences of all.
NEAR = """WITH RECURSIVE w AS (SELECT DISTINCT split_part(p_name, ' ', 1) AS a, split_part(p_name, ' ', 2) AS b FROM part UNION SELECT split_part(p_name, ' ', 1), p_name || 's' FROM part),
o AS (SELECT a AS x, b AS y, CASE WHEN len(a) <= len(b) THEN a ELSE b END AS s, CASE WHEN len(a) <= len(b) THEN b ELSE a END AS l FROM w),
p AS (SELECT s AS a, l[i:i + len(s) - 1] AS b FROM o, range(1, 40) r(i) WHERE i <= len(l) - len(s) + 1 UNION SELECT a, b FROM w),
t(a, b, i, row) AS (SELECT a, b, 0, list_transform(range(len(b) + 1), lambda x: 0) FROM p
UNION ALL SELECT a, b, i + 1, list_reduce(range(1, len(b) + 1), lambda acc, j: list_append(acc, CASE WHEN b[j] = a[i + 1] THEN row[j] + 1 ELSE greatest(row[j + 1], acc[len(acc)]) END), [0]) FROM t WHERE i < len(a)),
c AS (SELECT a, b, CAST(floor(200 * row[len(row)] / (len(a) + len(b))) AS INTEGER) AS v FROM t WHERE i = len(a)),
m AS (SELECT x, y, max(v) AS v FROM o JOIN c ON c.a = s AND len(c.b) = len(s) AND contains(l, c.b) GROUP BY x, y)"""


def near_pairs(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    words = F.split("p_name", " ")
    return part.select(words[0].alias("a"), words[1].alias("b")).union(part.select(words[0], F.concat("p_name", F.lit("s")))).distinct()


@plans.add("b43_partial_similarity", NEAR + " SELECT x AS a, y AS b, v FROM m")
def b43(spark, sf_dir):
    return near_pairs(spark, sf_dir).select("a", "b", S.partial_similarity(F.col("a"), F.col("b")).alias("v"))


@plans.add("b44_text_match", NEAR + " SELECT x AS a, y AS b, contains(x, y) OR contains(y, x) OR c.v >= 85 OR (least(len(x), len(y)) >= 2 AND m.v >= 90) AS v FROM m JOIN c ON c.a = x AND c.b = y")
def b44(spark, sf_dir):
    return near_pairs(spark, sf_dir).select("a", "b", S.text_match(F.col("a"), F.col("b")).alias("v"))
