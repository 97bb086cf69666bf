"""Entity resolution: joins against dictionaries, each with its own precedence."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tallyspark.functions.similarity import letters, partial_similarity_arrow, similarity_arrow
from tallyspark.functions.text import blank_to_null, domain_of, first_address, norm_text, product_key, trimmed

from tallyspark.sources.shared import cut

from .contain import held, places


def lookup_exact(df: DataFrame, address: str, directory: DataFrame) -> DataFrame:
    """Adds agent by the lower-cased address; directory has (email, agent), one row an address."""
    named = directory.select(F.lower("email").alias("_email"), "agent")
    return df.join(named, F.lower(F.trim(F.col(address))) == F.col("_email"), "left").drop("_email")


def load_directory(rows: DataFrame, emails: str, agent: str, seq: str) -> DataFrame:
    """(email, agent) of `;`-separated addresses; the last row by seq wins on a repeated address."""
    each = rows.select(F.explode(F.split(emails, "[;；]")).alias("email"), agent, seq).withColumn("email", F.lower(trimmed(F.col("email")))).where("email != ''")
    return each.groupBy("email").agg(F.max_by(agent, seq).alias("agent"))


def match_alias(df: DataFrame, text: str, key: list[str], aliases: DataFrame, head: int = 8, edges: str = r"[\s,，;；:：/|()（）_-]") -> DataFrame:
    """The alias a text holds at a separator edge, or within its first `head` letters: (key, alias, officials,
    at, ambiguous). The earliest place wins, then the longest alias; several officials are joined and flagged.

    aliases has (alias, officials) in lower case; all separators count as one letter behind an edge. Texts are read once
    by an automaton of the aliases and once more at their head; each gives its best hit at most.
    """
    mark = lambda c: F.regexp_replace(c, edges, "\u0001")
    low = df.select(*key, F.lower(F.col(text)).alias("_t"))
    names = aliases.withColumn("_name", mark(F.col("alias")))
    edged = places(low.withColumn("_t", mark(F.col("_t"))), key, "_t", names, "_name", edges="\u0001", keep="best")
    longest = names.agg(F.coalesce(F.max(F.length("alias")), F.lit(0))).head()[0]
    good = edged.unionByName(places(low.withColumn("_t", F.substring("_t", 1, head + longest)), key, "_t", names, "alias", head=head, keep="best"))
    best = good.groupBy(*key).agg(F.min(F.struct("at", (-F.length("alias")).alias("n"), "alias", "officials")).alias("_b"))
    return best.select(*key, "_b.alias", F.array_join("_b.officials", "、").alias("officials"), "_b.at", (F.size("_b.officials") > 1).alias("ambiguous"))


def unique_by_domain(directory: DataFrame, public: list[str]) -> DataFrame:
    """D3: (domain, agent) of domains with exactly one agent; public domains are taken out before grouping."""
    rows = directory.select(F.substring_index(F.lower("email"), "@", -1).alias("domain"), "agent").where(~F.col("domain").isin(*public))
    return rows.groupBy("domain").agg(F.min("agent").alias("agent"), F.max("agent").alias("_other")).where("agent = _other").drop("_other")


def lookup_body_addresses(df: DataFrame, key: str, text: Column, directory: DataFrame) -> DataFrame:
    """(key, email, agent) of the first known address in the text; the text's own addresses meet the directory."""
    from tallyspark.functions.text import ADDRESS

    found = df.select(key, F.posexplode(F.regexp_extract_all(F.lower(text), F.lit(ADDRESS), F.lit(0))).alias("_at", "email"))
    known = found.join(directory.select(F.lower("email").alias("email"), "agent"), "email")
    return known.groupBy(key).agg(F.min(F.struct("_at", "email", "agent")).alias("_b")).select(key, "_b.email", "_b.agent")


def match_signature(df: DataFrame, key: str, text: str, aliases: DataFrame, lines: int = 10) -> DataFrame:
    """The alias in the last non-blank lines: (key, alias, officials); the latest line, then the longest alias."""
    kept = F.filter(F.transform(F.split(F.lower(F.col(text)), "\n"), trimmed), lambda x: x != "")
    tail = df.select(key, F.posexplode(F.slice(kept, F.greatest(F.size(kept) - lines + 1, F.lit(1)), lines)).alias("_no", "_line"))
    hits = held(tail, [key, "_no"], "_line", aliases, "alias")
    best = hits.groupBy(key).agg(F.max(F.struct("_no", F.length("alias").alias("n"), "alias", "officials")).alias("_b"))
    return best.select(key, "_b.alias", "_b.officials")


def first_told(evidence: list[tuple[str, Column]]) -> tuple[Column, Column]:
    """The first evidence, in order, that isn't null, and its name; without one null and `none`."""
    return F.coalesce(*[c for _, c in evidence]), F.coalesce(*[F.when(c.isNotNull(), F.lit(name)) for name, c in evidence], F.lit("none"))


def resolve(evidence: list[tuple[str, Column]], conflict: Column | None = None) -> tuple[Column, Column]:
    """The first evidence, in order, that is there, and its name; a conflict makes it blank."""
    value, method = first_told([(name, blank_to_null(c)) for name, c in evidence])
    if conflict is None:
        return value, method
    bad = F.coalesce(conflict, F.lit(False))
    return F.when(~bad, value), F.when(bad, "conflict").otherwise(method)


def resolve_agents(mails: DataFrame, key: str, sender: str, subject: str, body: str, directory: DataFrame, aliases: DataFrame, public: list[str], medium: int = 80, high: int = 90) -> DataFrame:
    """(key, agent, method, candidates) by evidence in order, each found by its own join.

    `exact`: the sender's address is in the directory. `subject`: an alias in the subject; if the sender's domain
    belongs to one agent alone and that is none of the alias's, the result is blank with `conflict`; an alias of several
    officials takes the one that the domain confirms, else it is blank with `ambiguous`. The domain is no evidence by
    itself. `body`: the first known address in the body. `signature`: an alias in the last lines. `fuzzy`: one address
    of the directory alone is like the sender's, from `medium` on, and reaches `high`; otherwise the agents of all such
    addresses are candidates, the most alike first, and the result is blank with `fuzzy_unsure`. `none` otherwise. Blank
    or null evidence is no evidence; each key gives one row, of repeated keys the least texts.

    directory has (email, agent), one row an address; aliases (alias, officials) in lower case.
    """
    texts = F.struct(F.lower(trimmed(F.coalesce(sender, F.lit("")))).alias("_from"), F.coalesce(subject, F.lit("")).alias("_subject"), F.coalesce(body, F.lit("")).alias("_body"))
    base = mails.groupBy(key).agg(F.min(texts).alias("_m")).select(key, "_m.*")
    address = first_address(F.col("_from"))
    base = cut(base.withColumn("_address", address).withColumn("_domain", domain_of(F.col("_address"))))
    exact = lookup_exact(base.select(key, "_address"), "_address", directory).select(key, F.col("agent").alias("_exact"))
    named = match_alias(base, "_subject", [key], aliases).select(key, F.split("officials", "、").alias("_officials"))
    owner = unique_by_domain(directory, public).select(F.col("domain").alias("_domain"), F.col("agent").alias("_owner"))
    inside = lookup_body_addresses(base, key, F.col("_body"), directory).select(key, F.col("agent").alias("_in_body"))
    signed = match_signature(base, key, "_body", aliases).where(F.size("officials") == 1).select(key, F.col("officials")[0].alias("_signed"))
    listed = directory.select(F.lower("email").alias("email"), "agent")
    strange = base.select("_address").distinct().join(listed.select(F.col("email").alias("_address")), "_address", "left_anti").where("_address != ''")
    alike = fuzzy_lookup(strange, listed.select("email").distinct(), "_address", "email", medium, high).join(listed, "email")
    alike = alike.groupBy("_address", norm_text(F.col("agent")).alias("_same")).agg(F.min(F.struct((-F.col("score")).alias("s"), "place", "agent")).alias("_b"), F.count("*").alias("n"))
    ranked = F.transform(F.array_sort(F.collect_list("_b")), lambda x: x["agent"])
    alike = alike.groupBy("_address").agg(ranked.alias("_near"), F.sum("n").alias("_n"), F.max(-F.col("_b.s")).alias("_score"))
    out = base.select(key, "_domain", "_address").join(exact, key, "left").join(named, key, "left").join(owner, "_domain", "left").join(inside, key, "left").join(signed, key, "left").join(alike, "_address", "left")
    # Step by step: a column that the next step takes more than once is computed once a row.
    confirmed = F.array_contains("_officials", F.col("_owner"))
    by_subject = F.when(F.size("_officials") == 1, F.col("_officials")[0]).when(confirmed, F.col("_owner"))
    open_ = F.col("_exact").isNull() & F.col("_officials").isNotNull()
    sure = F.when((F.col("_n") == 1) & (F.col("_score") >= high), F.col("_near")[0])
    out = out.withColumns({"_by_subject": by_subject, "_conflict": F.coalesce(open_ & F.col("_owner").isNotNull() & ~confirmed, F.lit(False))})
    unclear = open_ & F.col("_by_subject").isNull() & F.col("_owner").isNull()
    evidence = {"exact": F.col("_exact"), "subject": F.col("_by_subject"), "body": F.col("_in_body"), "signature": F.col("_signed"), "fuzzy": sure}
    out = out.withColumns({"_unclear": unclear} | {f"_as_{name}": blank_to_null(c) for name, c in evidence.items()})
    first, name = first_told([(name, F.col(f"_as_{name}")) for name in evidence])
    bad, unclear = F.col("_conflict"), F.col("_unclear")
    out = out.withColumns({"_value": F.when(~bad, first), "_method": F.when(bad, "conflict").otherwise(name)})
    value, method = F.col("_value"), F.col("_method")
    unsure = value.isNull() & (method == "none") & F.col("_near").isNotNull()
    shown = F.when(unclear | (method == "conflict"), F.col("_officials")).when(unsure, F.col("_near"))
    said = F.when(unclear, "ambiguous").when(unsure, "fuzzy_unsure").otherwise(method)
    return out.select(key, F.when(~unclear, value).alias("agent"), said.alias("method"), F.coalesce(shown, F.expr("cast(array() as array<string>)")).alias("candidates"))


#: So many of the most frequent letters (with their number among equal ones) are put in order; all others are rarer.
ORDERED = 4096


def counted_letters(text: Column) -> Column:
    """The letters of a text, each with its number among equal ones; two such lists share as many as the letters do."""
    kinds = F.array_distinct(letters(text))
    return F.flatten(F.transform(kinds, lambda c: F.transform(F.sequence(F.lit(1), F.length(text) - F.length(F.replace(text, c, F.lit("")))), lambda i: F.concat(c, i.cast("string")))))


def ranked_letters(*texts: DataFrame) -> list[DataFrame]:
    """Each table of (text) with its distinct texts and `tokens`, their counted letters, rarest in all tables first.

    The order is one for all texts: tokens that aren't among the ORDERED most frequent ones, by name, then those by
    rising frequency. Any order of all tokens gives the same pairs; this one gives few candidates.
    The tables should be kept ones of different texts: Spark moves filters on tokens in front of a distinct(), where they
    list the letters of every row.
    """
    each = [df.select(F.col(df.columns[0]).alias("text")).where("text != ''").distinct().withColumn("tokens", counted_letters(F.col("text"))) for df in texts]
    counts = reduce(lambda a, b: a.unionByName(b), [df.select(F.explode("tokens").alias("token")) for df in each]).groupBy("token").count()
    order = [r["token"] for r in counts.orderBy(F.desc("count"), "token").limit(ORDERED).collect()]
    frequent = F.split(F.lit("\u0001".join(order[::-1])), "\u0001")
    sort = lambda tokens: F.concat(F.array_sort(F.array_except(tokens, frequent)), F.array_intersect(frequent, tokens))
    return [df.withColumn("tokens", sort(F.col("tokens"))) for df in each]


def needed(n: Column, m: Column, least: int) -> Column:
    """The letters that texts of n and m letters must have in common for a similarity of `least`."""
    return F.ceil(F.lit(least) * (n + m) / 200).cast("int")


def meetings(left: DataFrame, right: DataFrame) -> DataFrame:
    """(a, b, all_a, all_b): pairs that meet on a token of their prefixes, each pair at its first common one only.

    Both have (text, tokens, prefix), in one order of tokens. _i and _j are the token's places, n and m the lengths.
    """
    x = left.select(F.col("text").alias("a"), F.col("tokens").alias("all_a"), F.col("prefix").alias("_p"), F.posexplode("prefix").alias("_i", "_t"))
    y = right.select(F.col("text").alias("b"), F.col("tokens").alias("all_b"), F.col("prefix").alias("_q"), F.posexplode("prefix").alias("_j", "_t"))
    both = x.join(y, "_t").withColumns({"n": F.size("all_a"), "m": F.size("all_b")})
    return both.where(F.get(F.array_intersect("_p", "_q"), F.lit(0)) == F.col("_t"))


def blocked_pairs(left: DataFrame, right: DataFrame, a: str, b: str, least: int) -> DataFrame:
    """Pairs (a, b) of distinct texts that can reach a similarity of `least`; none that can is left out.

    A text of n letters that is `least` alike to another one has c letters in common with it, and c follows from n for the
    shortest one possible. So both have a token in common within their first n - c + 1 tokens in one order of all tokens,
    rarest first: only on those do texts meet. Of the pairs that meet, the lengths, then the places of the first common
    token (what is behind it must suffice), then all common letters are tested before any similarity is computed.
    """
    prefixed = lambda df: df.withColumn("_n", F.size("tokens")).withColumn("prefix", F.slice("tokens", F.lit(1), F.col("_n") - needed(F.col("_n"), F.ceil(F.col("_n") * least / (200 - least)), least) + 1))
    x, y = (prefixed(df) for df in ranked_letters(left.select(a), right.select(b)))
    common = needed(F.col("n"), F.col("m"), least)
    met = meetings(x, y).where((F.least("n", "m") >= common) & (F.least(F.col("n") - F.col("_i"), F.col("m") - F.col("_j")) >= common))
    return met.where(F.size(F.array_intersect("all_a", "all_b")) >= common).select("a", "b")


def window_pairs(left: DataFrame, right: DataFrame, a: str, b: str, least: int) -> DataFrame:
    """Pairs (a, b) of distinct texts of which the shorter can be `least` alike to a window of the longer, or to all of it.

    A text of s letters has at least c = least x s / 100 in common with its window, so one of its s - c + 1 rarest tokens
    is among the longer text's tokens; the longer one has no shorter prefix.
    """
    x, y = (df.withColumn("_n", F.size("tokens")) for df in ranked_letters(left.select(a), right.select(b)))
    prefix = F.slice("tokens", F.lit(1), F.col("_n") - F.ceil(F.col("_n") * least / 100).cast("int") + 1)
    short = lambda df: df.withColumn("prefix", prefix)
    whole = lambda df: df.withColumn("prefix", F.col("tokens"))
    met = meetings(short(x), whole(y)).where("n <= m").unionByName(meetings(whole(x), short(y)).where("n > m"))
    return met.where(F.size(F.array_intersect("all_a", "all_b")) >= F.ceil(F.least("n", "m") * least / 100)).select("a", "b")


def fuzzy_lookup(queries: DataFrame, candidates: DataFrame, a: str, b: str, medium: int = 80, high: int = 90) -> DataFrame:
    """(a, b, score, place, certain): candidates of similarity `medium` or more, ranked; certain if the best
    reaches `high`. Both sides are compared as norm_text; the texts as they came are returned.

    The different texts of both sides are kept, so that letters are listed for each text, not for each row.
    """
    q = cut(queries.select(F.col(a).alias("q")).distinct()).withColumn("a", norm_text(F.col("q")))
    c = cut(candidates.select(F.col(b).alias("c")).distinct()).withColumn("b", norm_text(F.col("c")))
    pairs = blocked_pairs(q, c, "a", "b", medium).withColumn("score", similarity_arrow("a", "b")).where(F.col("score") >= medium)
    rows = q.join(pairs, "a").join(c, "b")
    place = F.row_number().over(W.partitionBy("q").orderBy(F.col("score").desc(), "c"))
    best = F.max("score").over(W.partitionBy("q"))
    return rows.select(F.col("q").alias(a), F.col("c").alias(b), "score", place.alias("place"), (best >= high).alias("certain"))


def match_model_projects(queries: DataFrame, projects: DataFrame, a: str, b: str, least: int = 88) -> DataFrame:
    """The best project of each text: the greater of whole and partial similarity, 95 at least where one holds
    the other; accepted from `least`, at most 95. Pairs come from window_pairs().
    """
    q = cut(queries.select(norm_text(F.col(a)).alias("a")).distinct().where("a != ''"))
    p = cut(projects.select(norm_text(F.col(b)).alias("b")).distinct().where("b != ''"))
    pairs = window_pairs(q, p, "a", "b", least)
    holds = F.contains("a", "b") | F.contains("b", "a")
    score = F.greatest(F.when(holds, 95).otherwise(0), similarity_arrow("a", "b"), partial_similarity_arrow("a", "b"))
    best = pairs.withColumn("score", score).where(F.col("score") >= least).groupBy("a").agg(F.max(F.struct("score", F.col("b"))).alias("_b"))
    return best.select(F.col("a").alias(a), F.col("_b.b").alias(b), "_b.score")


def standardize_projects(df: DataFrame, key: str, raw: str, projects: DataFrame, combos: DataFrame, countries: DataFrame | None = None, services: DataFrame | None = None, context: str | None = None) -> DataFrame:
    """Rows (key, part_no, part, project, stage, matched): standard projects of a raw value, by stages in order.

    The value as a whole: `exact`, it is a project; `combo`, a known combination's parts. Else its parts between
    separators, or, where it has none and names two countries or more with one service, each country with that service.
    A part: `part`, it is a project; `similar`, one is 90 alike or more; `service`, it is a service and nothing else, and
    each country of the context (the other parts, then the context column) gives a project with it; `country`, it is a
    country and nothing else, and the first service of the context gives one. Then the value as a whole: `whole`, if no
    part was found, the best project from 75 on, matched from 85. Else `unmatched`, the part as it is. An exact answer
    beats a similar one (from 80) for what a country and a service make. matched is false for unsure answers.

    projects has (name); combos (name, part, part_no); countries and services (name, alias), services with a rank. Names
    are compared as norm_text. Blank values give no row.
    """
    spark = df.sparkSession
    blank = spark.createDataFrame([], "name string, alias string, rank int")
    lands = (countries if countries is not None else blank.drop("rank")).select("name", norm_text(F.col("alias")).alias("_alias"))
    works = (services if services is not None else blank).select("name", norm_text(F.col("alias")).alias("_alias"), "rank")
    about = F.coalesce(F.col(context), F.lit("")) if context else F.lit("")
    base = df.select(key, F.col(raw).alias("_raw"), norm_text(F.col(raw)).alias("_n"), about.alias("_about")).where("_n != ''")
    projects = cut(projects.select("name").distinct())
    names = projects.select(F.col("name").alias("_project"), norm_text(F.col("name")).alias("_p")).groupBy("_p").agg(F.min("_project").alias("_project"))
    shown = lambda rows, stage, matched=True: rows.select(key, "part_no", "part", "project", F.lit(stage).alias("stage"), (F.lit(matched) if isinstance(matched, bool) else matched).alias("matched"))

    exact = base.join(names, F.col("_n") == F.col("_p"), "left")
    whole = shown(exact.where("_p is not null").withColumns({"part_no": F.lit(0), "part": F.col("_raw"), "project": F.col("_project")}), "exact")
    known = combos.select(norm_text(F.col("name")).alias("_c"), F.col("part").alias("_part"), F.col("part_no").cast("int").alias("part_no"))
    rest = exact.where("_p is null").select(key, "_raw", "_n", "_about")
    combo = shown(rest.join(known, F.col("_n") == F.col("_c")).withColumns({"part": F.col("_part"), "project": F.col("_part")}), "combo")
    rest = rest.join(known.select("_c").distinct(), F.col("_n") == F.col("_c"), "left_anti")

    pieces = F.filter(F.transform(F.split("_raw", r"[+＋/／,，、;；&]"), trimmed), lambda x: x != "")
    rest = rest.withColumn("_cut", pieces)
    split = rest.where(F.size("_cut") > 1).select(key, "_raw", "_about", F.posexplode("_cut").alias("part_no", "part"))
    single = rest.where(F.size("_cut") == 1)
    inside = held(single, [key], "_n", lands, "_alias").groupBy(key).agg(F.array_sort(F.collect_set(F.struct("at", "name"))).alias("_lands"))
    doing = held(single, [key], "_n", works, "_alias").groupBy(key).agg(F.min(F.struct("rank", "name")).alias("_s"))
    spread = single.join(inside, key, "left").join(doing, key, "left")
    several = (F.size("_lands") > 1) & F.col("_s").isNotNull()
    made = F.transform("_lands", lambda c: F.concat(c["name"], F.col("_s.name")))
    multiplied = spread.where(several).select(key, "_raw", "_about", F.posexplode(made).alias("part_no", "part"))
    alone = spread.where(~F.coalesce(several, F.lit(False))).select(key, "_raw", "_about", F.lit(0).alias("part_no"), F.col("_raw").alias("part"))
    parts = split.unionByName(multiplied).unionByName(alone).withColumn("_n", norm_text(F.col("part")))

    # Three tables are kept: the different projects, the parts, and the best project of every text that a later stage may ask for, from one join.
    found = cut(parts.join(names, F.col("_n") == F.col("_p"), "left"))
    done = shown(found.where("_p is not null").withColumn("project", F.col("_project")), "part")
    open_ = found.where("_p is null").select(key, "_raw", "_about", "part_no", "part", "_n")
    scene = open_.withColumn("_scene", norm_text(F.concat_ws(" ", "_raw", "_about"))).select(key, "part_no", "part", "_n", "_scene")
    told = held(scene.select(key, "_scene").distinct(), [key], "_scene", lands, "_alias").select(key, F.col("name").alias("_land")).distinct()
    said = held(scene.select(key, "_scene").distinct(), [key], "_scene", works, "_alias").groupBy(key).agg(F.min(F.struct("rank", "name"))["name"].alias("_work"))
    pure_work = scene.join(works.groupBy("_alias").agg(F.min(F.struct("rank", "name"))["name"].alias("_own")), F.col("_n") == F.col("_alias")).join(told, key).select(key, "part_no", "part", F.concat("_land", "_own").alias("_made"), F.lit("service").alias("stage"))
    pure_land = scene.join(lands.groupBy("_alias").agg(F.min("name").alias("_own")), F.col("_n") == F.col("_alias")).join(said, key).select(key, "part_no", "part", F.concat("_own", "_work").alias("_made"), F.lit("country").alias("stage"))
    built = pure_work.unionByName(pure_land).withColumn("_m", norm_text(F.col("_made"))).join(names, F.col("_m") == F.col("_p"), "left")
    texts = open_.select(F.explode(F.array("part", "_raw")).alias("_text")).union(built.where("_p is null").select("_made")).distinct()
    best = fuzzy_lookup(texts, projects.select(F.col("name").alias("_near")), "_text", "_near", 75).where("place = 1")
    best = cut(best.select("_text", "_near", "score"))
    near = open_.join(best, F.col("part") == F.col("_text"), "left").withColumn("_sure", F.coalesce(F.col("score") >= 90, F.lit(False)))
    close = shown(near.where("_sure").withColumn("project", F.col("_near")), "similar")
    open_ = near.where("not _sure").select(key, "_raw", "part_no", "part")

    # What a country and a service make: an exact project beats a similar one.
    likely = built.join(best, F.col("_made") == F.col("_text"), "left").join(open_.select(key, "part_no"), [key, "part_no"], "left_semi")
    offered = likely.where("_p is not null or score >= 80").withColumn("_exact", F.col("_p").isNotNull())
    offered = offered.withColumn("_any", F.max("_exact").over(W.partitionBy(key, "part_no"))).where("_exact = _any")
    placed_ = offered.select(key, "part_no", "part", F.when(F.col("_exact"), F.col("_project")).otherwise(F.col("_near")).alias("project"), "stage", (F.col("_exact") | (F.col("score") >= 90)).alias("matched")).distinct()
    open_ = open_.join(placed_.select(key, "part_no").distinct(), [key, "part_no"], "left_anti")

    results = whole.unionByName(combo).unionByName(done).unionByName(close).unionByName(placed_)
    lost = open_.join(results.select(key).distinct(), key, "left_anti").select(key, F.col("_raw").alias("part")).distinct()
    last = lost.join(best, F.col("part") == F.col("_text")).select(key, F.lit(0).alias("part_no"), "part", F.col("_near").alias("project"), F.lit("whole").alias("stage"), (F.col("score") >= 85).alias("matched"))
    left = shown(open_.join(last.select(key).distinct(), key, "left_anti").withColumn("project", F.col("part")), "unmatched", False)
    return results.unionByName(last).unionByName(left)


def country_of(df: DataFrame, key: str, text: str, countries: DataFrame) -> DataFrame:
    """(key, name): the longest country prefix, then another language's prefix, then a contained name.

    countries has (name, alias, lang); lang `own` is the first kind.
    """
    low = df.select(key, F.lower(F.col(text)).alias("_t"))
    hits = held(low, [key], "_t", countries.select("name", F.lower("alias").alias("alias"), "lang"), "alias")
    prefix = F.col("at") == 1
    kind = F.when(prefix & (F.col("lang") == "own"), 0).when(prefix, 1).otherwise(2)
    return hits.groupBy(key).agg(F.min(F.struct(kind.alias("k"), (-F.length("alias")).alias("n"), "name")).alias("_b")).select(key, "_b.name")


def hide_superseded(rows: DataFrame, mail: str, value: str, suggested: str, valid: Column) -> DataFrame:
    """Without the invalid rows whose suggested value is that of a valid row of the same mail."""
    work = rows.withColumn("_valid", F.coalesce(valid, F.lit(False)))
    good = work.where("_valid").select(F.col(mail).alias("_mail"), F.lower(F.trim(F.col(value))).alias("_value")).where("_value != ''").distinct()
    test = (F.col(mail) == F.col("_mail")) & (F.lower(F.trim(F.col(suggested))) == F.col("_value")) & ~F.col("_valid")
    return work.join(good, test, "left_anti").drop("_valid")


def move_brands(rows: DataFrame, hidden: DataFrame, mail: str, value: str, suggested: str, brands: str) -> DataFrame:
    """The brands of hidden rows join those of the row that superseded them, distinct, own ones first."""
    moved = hidden.groupBy(F.col(mail).alias("_mail"), F.lower(F.trim(F.col(suggested))).alias("_value")).agg(F.array_sort(F.flatten(F.collect_list(brands))).alias("_moved"))
    out = rows.join(moved, (F.col(mail) == F.col("_mail")) & (F.lower(F.trim(F.col(value))) == F.col("_value")), "left")
    both = F.array_distinct(F.concat(brands, F.coalesce("_moved", F.expr("cast(array() as array<string>)"))))
    return out.withColumn(brands, F.filter(both, lambda x: x != "")).drop("_mail", "_value", "_moved")


def donor_fill(rows: DataFrame, donors: DataFrame, key: list[str], brand: str, fields: list[str]) -> DataFrame:
    """Blank fields take the donor's of the same key and brand; a key's only donor item fills any brand."""
    names = {f: f"_d_{f}" for f in fields}
    exact = donors.groupBy(*key, brand).agg(*[F.max(blank_to_null(F.col(f))).alias(names[f]) for f in fields])
    alone = donors.groupBy(*key).agg(F.count("*").alias("_n"), *[F.max(blank_to_null(F.col(f))).alias(f"_s_{f}") for f in fields]).where("_n = 1").drop("_n")
    out = rows.join(exact, [*key, brand], "left").join(alone, key, "left")
    return out.select(*[F.coalesce(blank_to_null(F.col(c)), names[c], f"_s_{c}").alias(c) if c in fields else F.col(c) for c in rows.columns])


def record_scope(records: DataFrame, file: str, text: str, company: Column) -> DataFrame:
    """The records that mention the company; where a file has none, none of its records is used."""
    return records.where(F.contains(norm_text(F.col(text)), norm_text(company)))


def record_scopes(records: DataFrame, companies: DataFrame, mail: str, file: str, text: str, company: str) -> DataFrame:
    """D22 for all companies of all mails: a row for each company of a mail and each record that it may use, `scoped` telling
    whether the record mentions it, in its text or its file's name.

    records has mail, file and text; companies (mail, company), of which repeated ones count once. A blank company may
    use all records of its mail. Of a file whose records don't mention a company it may use none (scope_files()). Records
    and companies meet on their mail only, so a mail with many of both makes the most rows. Names are compared as
    product keys.
    """
    names = companies.select(F.col(mail).alias("_mail"), F.coalesce(F.trim(F.col(company)), F.lit("")).alias(company)).distinct().withColumn("_key", product_key(F.col(company)))
    told = records.withColumn("_text", product_key(F.concat_ws(" ", F.coalesce(F.col(text), F.lit("")), F.coalesce(F.col(file), F.lit("")))))
    both = told.join(names, F.col(mail) == F.col("_mail")).where((F.col("_key") == "") | F.contains("_text", F.col("_key")))
    return both.withColumn("scoped", F.col("_key") != "").drop("_mail", "_key", "_text")


def scope_files(records: DataFrame, scopes: DataFrame, mail: str, file: str, company: str) -> DataFrame:
    """(mail, company, file, n_records, n_used) of each file of a mail that has companies; n_used 0: the file tells
    nothing of the company, and none of its records is used."""
    files = records.groupBy(mail, file).agg(F.count("*").alias("n_records"))
    used = scopes.groupBy(mail, file, company).agg(F.count("*").alias("n_used"))
    names = scopes.select(mail, company).distinct()
    out = files.join(names, mail).join(used, [mail, file, company], "left")
    return out.select(mail, company, file, "n_records", F.coalesce("n_used", F.lit(0)).cast("long").alias("n_used"))


def record_groups(records: DataFrame, mail_projects: DataFrame, mail: str, locator: list[str], project: str, text_groups: DataFrame | None = None) -> DataFrame:
    """One row per physical record, of repeated ones the least, with its own project, else the mail's only one, else
    flagged.

    Records replace the text groups of their mail and set the number of groups that is expected of it; with text_groups,
    which have the mail and project, mails without records keep these, and n_expected is null there.
    """
    one = mail_projects.groupBy(mail).agg(F.min(project).alias("_only"), F.max(project).alias("_last"))
    same = [mail, *locator]
    rest = [c for c in records.columns if c not in same]
    rows = records.groupBy(*same).agg(F.min(F.struct(*rest)).alias("_r")).select(*same, "_r.*").join(one, mail, "left")
    only = F.when(F.col("_only") == F.col("_last"), F.col("_only"))
    out = rows.withColumn("_own", blank_to_null(F.col(project))).withColumn(project, F.coalesce("_own", only))
    out = out.withColumns({"flagged": F.col(project).isNull(), "origin": F.lit("record")}).drop("_only", "_last", "_own")
    counts = out.groupBy(mail).agg(F.count("*").alias("n_expected"))
    out = out.join(counts, mail)
    if text_groups is None:
        return out
    rest = text_groups.join(counts.select(mail), mail, "left_anti").withColumns({"flagged": blank_to_null(F.col(project)).isNull(), "origin": F.lit("text")})
    return out.unionByName(rest, allowMissingColumns=True)


def best_source(candidates: DataFrame, key: str, rank: str) -> DataFrame:
    """All candidates of the best-ranked source of each key."""
    best = candidates.groupBy(key).agg(F.min(rank).alias("_best"))
    return candidates.join(best, key).where(F.col(rank) == F.col("_best")).drop("_best")


#: The sources of a mail's projects in their order.
PROJECT_SOURCES = ("bound form", "checked form", "segments", "declared", "table names", "rules")


def project_source(mail: str, bound: DataFrame, checked: DataFrame, segments: DataFrame, declared: DataFrame, names: DataFrame, ruled: DataFrame, plain: DataFrame | None = None, wide: int = 2) -> DataFrame:
    """(mail, project, source, flagged): the projects of each mail from its best source, in PROJECT_SOURCES' order.

    Each table has (mail, project): bound forms, checked forms, segmented groups, what subject and body declare, project
    names found in all text, and what the rules find there. A checked form of `wide` projects or more that has declared
    ones is narrowed to these; the mail's plain files (plain), if the subject declares their projects, join in. A checked
    form that declares nothing in common stays whole and is flagged. Blank projects are none.
    """
    tables = dict(zip(PROJECT_SOURCES, (bound, checked, segments, declared, names, ruled)))
    clean = {source: df.select(mail, trimmed(F.col("project")).alias("project")).where("project != ''").distinct() for source, df in tables.items()}
    said = clean["declared"].withColumn("_said", F.lit(True))
    form = clean["checked form"].join(said, [mail, "project"], "left")
    size = form.groupBy(mail).agg(F.count("*").alias("_n"), F.count("_said").alias("_both")).join(said.select(mail).distinct().withColumn("_any", F.lit(True)), mail, "left")
    form = form.join(size, mail)
    narrow = (F.col("_n") >= wide) & (F.col("_both") > 0)
    form = form.where(~narrow | F.col("_said").isNotNull()).select(mail, "project", ((F.col("_n") >= wide) & (F.col("_both") == 0) & F.col("_any").isNotNull()).alias("flagged"))
    if plain is not None:
        more = plain.select(mail, trimmed(F.col("project")).alias("project")).where("project != ''").distinct()
        more = more.join(clean["declared"], [mail, "project"], "left_semi").join(form.select(mail).distinct(), mail, "left_semi").withColumn("flagged", F.lit(False))
        form = form.unionByName(more).groupBy(mail, "project").agg(F.bool_or("flagged").alias("flagged"))
    ranked = [(form if source == "checked form" else clean[source].withColumn("flagged", F.lit(False))).withColumns({"_rank": F.lit(i), "source": F.lit(source)}) for i, source in enumerate(PROJECT_SOURCES)]
    return best_source(reduce(lambda x, y: x.unionByName(y), ranked), mail, "_rank").select(mail, "project", "source", "flagged")


def first_source(candidates: DataFrame, key: str, value: str, rank: str) -> DataFrame:
    """One non-blank value per key, from the best-ranked source."""
    there = candidates.where(blank_to_null(F.col(value)).isNotNull())
    return there.groupBy(key).agg(F.min_by(value, F.struct(rank, value)).alias(value), F.min(rank).alias(rank))


def current_batch(rows: DataFrame, day: str, manifests: DataFrame) -> DataFrame:
    """The rows in the day range of the latest published batch; manifests has (published_at, low, high)."""
    latest = manifests.agg(F.max_by(F.struct("low", "high"), "published_at").alias("_m")).select("_m.*")
    return rows.join(latest, F.col(day).between(F.col("low"), F.col("high"))).drop("low", "high")


def merge_back(rows: DataFrame, outcomes: DataFrame, seq: str, status: str, otherwise: str = "not compared") -> DataFrame:
    """Outcomes of the queried rows return to all rows by their number."""
    got = outcomes.select(F.col(seq).alias("_seq"), F.col(status).alias("_status"))
    return rows.join(got, rows[seq] == F.col("_seq"), "left").withColumn(status, F.coalesce("_status", F.lit(otherwise))).drop("_seq", "_status")
