"""The operators' queries over their whole tables, and the SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import bpe, exact_dedup, jaccard_join, kd_search, line_dedup, lm_scoring, mixing, pii, source_audit, suffix_dedup, token_align, toxicity, url_filters
from .common import read

#: The rules that op1 applies, as host, path and action.
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))


def tokenizer(name: str = "byte_bpe_50k.json") -> str:
    """The file of a public tokenizer, by default the byte-level one that the queries use; operators take any path."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, action string")
    return url_filters.judge(read(spark, sf_dir, "pages"), rules)


def op2_kd_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kd_search.top_k(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(read(spark, sf_dir, "documents"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.suffix_dedup(read(spark, sf_dir, "documents"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(read(spark, sf_dir, "documents"), tokenizer())


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(read(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, read(spark, sf_dir, "labels")))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")).drop("copies")


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.detect(read(spark, sf_dir, "documents"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.line_dedup(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op11_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, out = read(spark, sf_dir, "documents"), lm_scoring.held_out(F.col("doc_id")).alias("held_out")
    model = lm_scoring.train(docs.where(~out))
    return lm_scoring.score(docs, model).select("doc_id", out, "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op12_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_audit.audit(read(spark, sf_dir, "documents"))


def op13_token_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_align.align(read(spark, sf_dir, "documents"), tokenizer(), tokenizer("piece_bpe_32k.model"))


QUERIES = {
    f.__name__: f
    for f in (op1_url_filters, op2_kd_search, op3_jaccard_join, op4_suffix_dedup, op5_bpe, op6_exact_dedup, op7_toxicity, op8_mixing, op9_pii, op10_line_dedup, op11_lm_scoring, op12_source_audit, op13_token_align)
}

#: Host, path and key of a column that holds an address.
PARTS_SQL = r"""CASE WHEN contains({u}, '://') THEN substr({u}, instr({u}, '://') + 3) END"""
HOST_SQL = f"coalesce(translate(regexp_extract({PARTS_SQL}, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '')"
PATH_SQL = f"coalesce(regexp_extract({PARTS_SQL}, '^[^/?#]*([^?#]*)', 1), '')"
KEY_SQL = rf"""CASE WHEN {HOST_SQL} <> '' THEN {HOST_SQL} || regexp_replace({PATH_SQL}, '/+$', '') || coalesce(regexp_extract({{u}}, '^[^?#]*(\?[^#]*)', 1), '') END"""
SQL_RULES = "VALUES " + ", ".join(f"('{h}', '{p}', '{a}')" for h, p, a in RULES)

OP1_SQL = rf"""
WITH RECURSIVE rules(r_host, r_path, action) AS ({SQL_RULES}),
l AS (SELECT url, unnest([
  regexp_extract(regexp_extract(html, '(?is)<link\b[^>]*\brel\s*=\s*["'']?canonical\b[^>]*>'), '(?is)\bhref\s*=\s*["'']?([^"''\s>]+)', 1),
  regexp_extract(regexp_extract(html, '(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*["'']?refresh\b[^>]*>'), '(?is)\burl\s*=\s*["'']?([^"''\s>]+)', 1)]) AS link
  FROM pages WHERE url IS NOT NULL AND html IS NOT NULL),
t AS (SELECT url, CASE WHEN link = '' THEN NULL WHEN regexp_matches(link, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN link
  WHEN starts_with(link, '//') THEN split_part(url, '://', 1) || ':' || link
  WHEN starts_with(link, '/') THEN split_part(url, '://', 1) || '://' || {HOST_SQL.format(u="url")} || link
  ELSE split_part(url, '://', 1) || '://' || {HOST_SQL.format(u="url")} || coalesce(nullif(regexp_replace({PATH_SQL.format(u="url")}, '[^/]*$', ''), ''), '/') || link END AS target FROM l),
e AS (SELECT {KEY_SQL.format(u="url")} AS u, {KEY_SQL.format(u="target")} AS v, target FROM t WHERE target IS NOT NULL),
g AS (SELECT u, v FROM e WHERE u IS NOT NULL AND v IS NOT NULL UNION SELECT v, u FROM e WHERE u IS NOT NULL AND v IS NOT NULL),
reach(node, other) AS (SELECT u, u FROM g UNION SELECT reach.node, g.v FROM reach JOIN g ON g.u = reach.other),
roots AS (SELECT node, min(other) AS root FROM reach GROUP BY node),
n AS (SELECT DISTINCT url FROM (SELECT url FROM pages UNION ALL SELECT target FROM e WHERE v IS NOT NULL) WHERE url IS NOT NULL),
p AS (SELECT url, {HOST_SQL.format(u="url")} AS host, {PATH_SQL.format(u="url")} AS path FROM n),
f AS (SELECT url, r_host || r_path AS rule, action, row_number() OVER (PARTITION BY url ORDER BY len(r_host || r_path) DESC, action) AS place
  FROM p JOIN rules ON (host = r_host OR ends_with(host, '.' || r_host)) AND starts_with(path, r_path) WHERE host <> ''),
b AS (SELECT url, rule, action FROM f WHERE place = 1),
s AS (SELECT root, bool_or(action = 'block') AND NOT bool_or(action = 'allow') AS blocked
  FROM (SELECT {KEY_SQL.format(u="url")} AS k, action FROM b) JOIN roots ON node = k GROUP BY 1),
x AS (SELECT page_id, url, {KEY_SQL.format(u="url")} AS k FROM pages)
SELECT page_id, {HOST_SQL.format(u="x.url")} AS host, {PATH_SQL.format(u="x.url")} AS path, rule,
  coalesce(action, CASE WHEN s.root IS NOT NULL THEN 'block' END, 'allow') AS verdict, s.root AS blocked_with
FROM x LEFT JOIN b ON b.url = x.url LEFT JOIN roots ON node = k LEFT JOIN s ON s.blocked AND s.root = roots.root
"""

OP2_SQL = """
WITH v AS (SELECT vec_id, row_number() OVER () AS n, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS query_id, a.n, b.vec_id, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.n <> b.n),
r AS (SELECT *, row_number() OVER (PARTITION BY n ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""

OP3_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(text, '[^\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) > 0 THEN list_sort(list_distinct(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i + 4], ' ')))) END AS s FROM w),
t AS (SELECT s, min(doc_id) AS rep FROM s WHERE s IS NOT NULL GROUP BY s),
x AS (SELECT rep, len(s) AS n, unnest(s) AS g FROM t),
c AS (SELECT a.rep AS u, b.rep AS v, count(*) AS k, any_value(a.n) AS n, any_value(b.n) AS m FROM x a JOIN x b ON a.g = b.g AND a.rep <> b.rep GROUP BY a.rep, b.rep),
l AS (SELECT u, v FROM c WHERE k >= 0.8 * (n + m - k)),
reach(node, other) AS (SELECT rep, rep FROM t UNION SELECT node, v FROM reach JOIN l ON u = other),
r AS (SELECT node, min(other) AS class_id FROM reach GROUP BY node),
d AS (SELECT u, count(*) AS n_links FROM l GROUP BY u)
SELECT s.doc_id, coalesce(rep, s.doc_id) AS text_class, coalesce(class_id, s.doc_id) AS class_id, coalesce(n_links, 0) AS n_links
FROM s LEFT JOIN t ON t.s = s.s LEFT JOIN r ON node = rep LEFT JOIN d ON d.u = rep
"""

OP6_SQL = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents),
g AS (SELECT norm, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY norm)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, sha256(norm) AS text_sha256
FROM t JOIN g USING (norm)
"""

OP10_SQL = r"""
WITH d AS (SELECT doc_id, text, md5(text) AS tid, coalesce('=' || source, '-') AS site, string_split(text, chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, tid, site, generate_subscripts(lines, 1) - 1 AS line_no, unnest(lines) AS raw FROM d WHERE text IS NOT NULL),
c AS (SELECT doc_id, tid, site, line_no, raw, regexp_replace(regexp_replace(raw, '[\x20\x09-\x0D]+', ' ', 'g'), '^ | $', '', 'g') AS line FROM l),
b AS (SELECT line, min((doc_id, tid, line_no)) AS first FROM c WHERE line <> '' GROUP BY line
      HAVING count(DISTINCT site) >= CASE WHEN length(line) < 20 THEN 10 ELSE 5 END),
m AS (SELECT DISTINCT c.doc_id, c.tid, c.line_no, c.raw, b.line IS NOT NULL AND (c.doc_id, c.tid, c.line_no) <> b.first AS gone
      FROM c LEFT JOIN b ON c.line = b.line),
k AS (SELECT doc_id, tid, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed,
             coalesce(string_agg(raw, chr(10) ORDER BY line_no) FILTER (NOT gone), '') AS kept FROM m GROUP BY doc_id, tid)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k ON d.doc_id = k.doc_id AND d.tid = k.tid
"""

OP8_SQL = r"""
WITH q AS (SELECT doc_id, avg(quality) AS q FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size,
             0.25 + coalesce(q, 0.5) AS w,
             (CAST('0x' || md5('7:' || doc_id)[:12] AS BIGINT) + 0.5) / 281474976710656.0 AS u
      FROM documents LEFT JOIN q USING (doc_id)),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1 AS number
      FROM d GROUP BY source),
c AS (SELECT *, CASE number % 3 WHEN 0 THEN 3.0 WHEN 1 THEN 1.0 ELSE 2.0 END::DOUBLE AS weight, 2.0::DOUBLE * source_size AS cap FROM s),
v AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER o, 0.0))
             / (sum(weight) OVER () - coalesce(sum(weight) OVER o, 0.0)) AS level,
             row_number() OVER (ORDER BY cap / weight, number) AS place
      FROM c WINDOW o AS (ORDER BY cap / weight, number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT arg_min(level, place) AS level FROM v WHERE level <= cap / weight),
p AS (SELECT source, number, source_size, least(cap, coalesce((SELECT level FROM f), 0.0) * weight) AS target FROM v),
e AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS epochs FROM p),
k AS (SELECT d.doc_id, d.size, e.source_size, e.target, e.epochs, e.target - e.epochs * e.source_size AS rest,
             sum(d.size) OVER (PARTITION BY e.number ORDER BY -ln(u) / w, d.doc_id, d.size ROWS UNBOUNDED PRECEDING) - d.size AS inside
      FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, source, size, source_size, target,
       CAST((epochs + CASE WHEN size > 0 AND inside + size / 2.0 <= rest THEN 1 ELSE 0 END) * size AS BIGINT) AS taken
FROM (SELECT k.*, documents.source FROM k JOIN documents USING (doc_id))
"""

OP12_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
t AS (SELECT r, lang, source, unnest(terms) AS term FROM d),
k AS (SELECT lang, term, count(*) AS n FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= 30),
c AS (SELECT lang, source, term, count(*) AS n FROM t JOIN k USING (lang, term) GROUP BY lang, source, term),
g AS (SELECT DISTINCT lang, source FROM d),
l AS (SELECT lang, CAST(sum(n) AS HUGEINT) AS total, count(*) AS v FROM k GROUP BY lang),
s AS (SELECT g.lang, g.source, CAST(coalesce(sum(c.n), 0) AS HUGEINT) AS total FROM g LEFT JOIN c USING (lang, source) GROUP BY g.lang, g.source),
p AS (SELECT s.lang, s.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000 * (CAST(coalesce(c.n, 0) AS HUGEINT) + 5)) // (s.total + 5 * l.v) AS p,
  1 + (1000000000 * (CAST(k.n AS HUGEINT) + 5)) // (l.total + 5 * l.v) AS q
  FROM s JOIN k USING (lang) JOIN l USING (lang) LEFT JOIN c ON c.lang = s.lang AND c.source = s.source AND c.term = k.term),
x AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(sum(abs(a.p - b.p)) AS BIGINT) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source
  UNION ALL SELECT a.lang, a.source, 'pair', b.source, 0 FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source WHERE a.lang NOT IN (SELECT lang FROM l)
  UNION ALL SELECT lang, source, 'term', term, CAST(p - q AS BIGINT) FROM p WHERE n > 0 AND p > q),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS INTEGER) AS rank FROM x)
SELECT lang, source, part, item, value, rank FROM r WHERE part = 'pair' OR rank <= 50
"""

ORACLES = {"op1_url_filters": OP1_SQL, "op2_kd_search": OP2_SQL, "op3_jaccard_join": OP3_SQL, "op6_exact_dedup": OP6_SQL, "op10_line_dedup": OP10_SQL, "op8_mixing": OP8_SQL, "op12_source_audit": OP12_SQL}
