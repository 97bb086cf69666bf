"""URL filters: rules by host and path, spread over redirect and canonical-link equivalence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import components

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def behind_scheme(url: Column) -> Column:
    """What follows the first ://; null without one."""
    return F.when(F.contains(url, F.lit("://")), F.substr(url, F.length(F.substring_index(url, "://", 1)) + 4))


def host_of(url: Column) -> Column:
    """What stands between the first :// and the next /, ? or #, A-Z lower-cased; empty for null or no ://."""
    return F.coalesce(F.translate(F.regexp_extract(behind_scheme(url), r"^[^/?#]*", 0), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ?, # or the end; empty for null or no ://."""
    return F.coalesce(F.regexp_extract(behind_scheme(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def address_key(url: Column, loose: bool = False) -> Column:
    """What names an address in a link: host, path without slashes at the end, query; no scheme and no fragment.

    With loose=True also no www. or m., no tracking parameters and sorted parameters. Null without a host.
    """
    query = F.regexp_extract(url, r"^[^?#]*(\?[^#]*)", 1)
    host, path = host_of(url), F.regexp_replace(path_of(url), r"/+$", "")
    if loose:
        kept = F.filter(F.split(F.substr(query, F.lit(2)), "&"), lambda x: (x != "") & ~x.rlike(r"^(?:utm_[a-z]+|ref|fbclid|gclid)="))
        query = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(F.array_sort(kept), "&"))).otherwise("")
        host = F.regexp_replace(host, r"^(?:www|m)\.", "")
    return F.when(host != "", F.concat(host, path, query))


def resolved(link: Column, url: Column) -> Column:
    """A link's whole address, seen from the page at url; null for an empty link."""
    scheme = F.substring_index(url, "://", 1)
    host = host_of(url)
    folder = F.regexp_replace(path_of(url), r"[^/]*$", "")
    return (
        F.when(link == "", None)
        .when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), link)
        .when(link.startswith("//"), F.concat(scheme, F.lit(":"), link))
        .when(link.startswith("/"), F.concat(scheme, F.lit("://"), host, link))
        .otherwise(F.concat(scheme, F.lit("://"), host, F.when(folder == "", "/").otherwise(folder), link))
    )


def alias_edges(pages: DataFrame) -> DataFrame:
    """Rows (url, target) for each canonical link and each meta-refresh redirect in a page's html."""
    link = F.regexp_extract(F.regexp_extract("html", r"""(?is)<link\b[^>]*\brel\s*=\s*["']?canonical\b[^>]*>""", 0), r"""(?is)\bhref\s*=\s*["']?([^"'\s>]+)""", 1)
    jump = F.regexp_extract(F.regexp_extract("html", r"""(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*["']?refresh\b[^>]*>""", 0), r"""(?is)\burl\s*=\s*["']?([^"'\s>]+)""", 1)
    found = pages.where(F.col("url").isNotNull() & F.col("html").rlike(r"(?i)\b(?:canonical|refresh)\b")).select("url", link.alias("link"), jump.alias("jump"))
    # Addresses are made before they are dealt to rows: a test on them then reads a column and doesn't repeat their making.
    targets = F.array(*[resolved(F.col(c), F.col("url")) for c in ("link", "jump")])
    return found.select("url", F.explode(targets).alias("target")).where("target is not null")


def matched(nodes: DataFrame, rules: DataFrame) -> DataFrame:
    """Rows (url, rule, verdict) of the urls that a rule fits: the longest rule, allow before block among equals.

    A rule (host, path, action) fits its host and every subdomain of it if the url's path starts with the rule's.
    The join is on the host's suffixes, so rules may be as many as there are hosts.
    """
    parts = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    urls = nodes.select("url").distinct().select("url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    named = rules.select(F.col("host").alias("r_host"), F.col("path").alias("r_path"), "action")
    fits = urls.where("host != ''").select("url", "path", F.explode(suffixes).alias("r_host")).join(named, "r_host").where(F.expr("startswith(path, r_path)"))
    rule = F.concat("r_host", "r_path")
    best = fits.groupBy("url").agg(F.max(F.struct(F.length(rule), F.col("action") == "allow", rule.alias("rule"), "action")).alias("b"))
    return best.select("url", "b.rule", F.col("b.action").alias("verdict"))


def judge(pages: DataFrame, rules: DataFrame, loose: bool = False) -> DataFrame:
    """Decide for every page whether to keep it: page_id, host, path, rule, verdict, component.

    A page's own rule decides. A page without one takes part in its equivalence class: the connected component,
    over redirect and canonical-link edges, of addresses that name the same page. If a rule blocks any member,
    listed page or bare link target, and none is explicitly allowed, the class is blocked. All else is allowed: a page
    without an edge to another address inherits nothing. Link ends are matched by address_key(), `loose` as there.
    A null url has an empty host and path, no rule and the verdict allow. Rows of pages are kept as they are,
    repeated ones too; other columns are left out. Empty tables give empty results.
    """
    key = lambda name: address_key(F.col(name), loose)
    edges = alias_edges(pages).where(key("target").isNotNull())
    roots = components(edges.select(key("url").alias("u"), key("target").alias("v")))
    nodes = pages.select("url").union(edges.select(F.col("target").alias("url"))).where("url is not null")
    ruled = matched(nodes, rules)
    stand = ruled.select(key("url").alias("node"), "verdict").where("node is not null").groupBy("node").agg(F.bool_or(F.col("verdict") == "block").alias("b"), F.bool_or(F.col("verdict") == "allow").alias("a"))
    spread = stand.join(roots, "node").groupBy("root").agg(F.bool_or("b").alias("b"), F.bool_or("a").alias("a")).where("b and not a").select("root")
    blocked = spread.join(roots, "root").select(F.col("root").alias("blocked"), "node")
    rows = pages.select("page_id", "url", key("url").alias("node"))
    out = rows.join(ruled, "url", "left").join(blocked, "node", "left")
    verdict = F.coalesce("verdict", F.when(F.col("blocked").isNotNull(), "block"), F.lit("allow"))
    return out.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "rule", verdict.alias("verdict"), F.col("blocked").alias("blocked_with"))
