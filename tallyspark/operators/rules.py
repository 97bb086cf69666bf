"""Filters, predicates and first-match routing (SURVEY C), and the verdicts that refine it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tallyspark.functions.company import sanitize_company
from tallyspark.functions.text import blank_to_null, domain_in, trimmed

from .contain import held


def any_hit(text: Column, terms) -> Column:
    """Whether the text holds one of the terms, blind to case; false for null."""
    low = F.lower(text)
    return F.coalesce(reduce(lambda a, b: a | b, [F.contains(low, F.lit(t.lower())) for t in terms], F.lit(False)), F.lit(False))


def first_hit(text: Column, terms) -> Column:
    """The first of the ranked terms that the text holds; null if none."""
    low = F.lower(text)
    return F.coalesce(*[F.when(F.contains(low, F.lit(t.lower())), F.lit(t)) for t in terms], F.lit(None))


def first_hit_by_table(df: DataFrame, text: str, key: str, terms: DataFrame) -> DataFrame:
    """C1 for large groups: terms has (rank, term); rows (key, term) with the lowest rank contained in the text.

    A small dictionary is tested in the row, a large one by an automaton (contain.held).
    """
    low = df.select(key, F.lower(F.col(text)).alias("_t"))
    hits = held(low, [key], "_t", terms.select("rank", "term", F.lower("term").alias("_low")), "_low")
    return hits.groupBy(key).agg(F.min(F.struct("rank", "term")).alias("_best")).select(key, F.col("_best.term").alias("term"))


def all_internal(listed: Column, audit: list[str], domains: list[str]) -> Column:
    """After the audit boxes are taken out there are recipients, and all are internal."""
    rest = F.filter(listed, lambda x: ~F.lower(x).isin(*audit))
    return F.coalesce((F.size(rest) > 0) & F.forall(rest, lambda x: domain_in(x, tuple(domains))), F.lit(False))


def near(text: Column, first: str, second: str, reach: int = 48) -> Column:
    """The two patterns within `reach` letters of each other, in either order, blind to case."""
    return text.rlike(rf"(?is)(?:{first}).{{0,{reach}}}(?:{second})") | text.rlike(rf"(?is)(?:{second}).{{0,{reach}}}(?:{first})")


def route(df: DataFrame, subject: str, body: str, extra: str, groups: dict[str, tuple[str, ...]], flags: dict[str, Column]) -> DataFrame:
    """Adds status, reason, hard and eligible by the first rule that holds; the order of rules is fixed.

    groups holds the terms: strict, change, soft, action, request, explicit, form, scope, other_scope, notice,
    completed, irrelevant, business. flags holds Columns self_sent, internal_sender, internal_recipients and
    internal_address. subject, body and extra (attachment text) are column names; null counts as empty.
    """
    none = F.lit("")
    s, b, x = (F.coalesce(F.col(c), none) for c in (subject, body, extra))
    near_text = F.concat_ws(" ", s, b)
    whole = F.concat_ws(" ", s, b, x)
    hit = lambda text, *names: reduce(lambda p, q: p | q, [any_hit(text, groups[n]) for n in names])
    asked = F.col("_asked")
    work = df.withColumns({
        "_subject_asks": hit(s, "action", "request"), "_strict": hit(s, "strict"), "_change": hit(s, "change"), "_soft": hit(s, "soft"), "_body_change": hit(F.substring(b, 1, 5000), "change"),
        "_asked": hit(near_text, "action", "request") | hit(x, "form"), "_explicit": hit(near_text, "explicit") | hit(x, "form"),
        "_scope": hit(whole, "scope") & ~hit(whole, "other_scope"), "_notice": hit(near_text, "notice"), "_completed": hit(near_text, "completed"),
        "_business": hit(whole, "business"), "_irrelevant": hit(whole, "irrelevant"),
    })
    c = F.col
    rules = [
        (flags["self_sent"], "filtered", "self sent", False, False),
        (flags["internal_sender"], "filtered", "internal sender", True, False),
        (flags["internal_recipients"], "filtered", "internal recipients", False, False),
        (c("_strict") | c("_change") | (c("_soft") & ~c("_subject_asks")), "filtered", "off topic", False, False),
        (c("_body_change"), "filtered", "change in body", False, True),
        (asked & c("_scope"), "filtered", "excluded scope", True, False),
        (c("_notice") & ((c("_completed") & ~c("_explicit")) | ~asked), "filtered", "notice", False, False),
        (c("_irrelevant") & ~c("_business") & ~asked, "filtered", "irrelevant", False, True),
        (asked & c("_business"), "valid", "action and business", False, True),
        (asked & c("_subject_asks"), "valid", "action in subject", False, True),
        (c("_business") & c("_irrelevant") & ~asked, "filtered", "business and irrelevant", False, True),
        (c("_business"), "uncertain", "business only", False, True),
        (flags["internal_address"] & ~c("_business") & ~asked, "filtered", "internal, nothing else", False, True),
        (~c("_business") & ~asked, "filtered", "nothing", False, True),
    ]
    made = lambda status, reason, hard, eligible: F.struct(F.lit(status).alias("status"), F.lit(reason).alias("reason"), F.lit(hard).alias("hard"), F.lit(eligible).alias("eligible"))
    chain = F.when(rules[0][0], made(*rules[0][1:]))
    for test, *rest in rules[1:]:
        chain = chain.when(test, made(*rest))
    out = work.withColumn("_route", chain.otherwise(made("uncertain", "rest", False, True)))
    return out.select(*[df[col] for col in df.columns], "_route.*")


def scope_exclude(details: DataFrame, mail: str, project: str, excluded: Column) -> tuple[DataFrame, DataFrame]:
    """(kept rows, excluded (mail, project) once each with the scope `project`)."""
    gone = details.where(excluded).select(mail, project).dropDuplicates([mail, project]).withColumn("scope", F.lit("project"))
    return details.where(~excluded), gone


def downgrade_orphans(excluded: DataFrame, surviving: DataFrame, mail: str) -> DataFrame:
    """An excluded row whose mail has no surviving row loses its scope, so the mail counts as a whole exclusion."""
    alive = surviving.select(F.col(mail).alias("_alive")).distinct()
    out = excluded.join(alive, excluded[mail] == F.col("_alive"), "left")
    return out.withColumn("scope", F.when(F.col("_alive").isNull(), "").otherwise(F.col("scope"))).drop("_alive")


def queue_of(row: dict[str, Column], requests: tuple[str, ...]) -> Column:
    """Work iff agent, company and project are there, the request is known and no gate is down; else review."""
    there = reduce(lambda a, b: a & b, [blank_to_null(row[n]).isNotNull() for n in ("agent", "company", "project")])
    text = lambda n: F.coalesce(row[n], F.lit(""))
    open_ = ~any_hit(text("method"), ("multi", "unsure")) & ~text("confidence").isin("low", "manual") & ~text("semantic").isin("uncertain", "invalid", "failed") & (text("rules") != "review")
    return F.when(there & F.coalesce(trimmed(row["request"]).isin(*requests), F.lit(False)) & open_, "work").otherwise("review")


def review_hint(hints: list[tuple[Column, str]], sign: str = "；") -> Column:
    """The texts of the hints that hold, distinct in order, joined."""
    return F.array_join(F.array_distinct(F.array_compact(F.array(*[F.when(test, F.lit(text)) for test, text in hints]))), sign)


def required_fields(fields: list[str]) -> Column:
    """The names of the fields that are blank, in order."""
    return F.array_compact(F.array(*[F.when(blank_to_null(F.col(f).cast("string")).isNull(), F.lit(f)) for f in fields]))


def prequery(df: DataFrame, agent: str, company: str, project: str, confidence: str, seq: str, key) -> DataFrame:
    """C11: the rows worth a lookup, with their lookup state: skip_no_agent, skip_low, duplicate or query.

    Rows agree when agent, company and project have the same key(); the first by seq is asked for. Rows blank in
    both company and project never merge.
    """
    work = df.withColumn(company, sanitize_company(F.col(company)))
    skip = F.when(blank_to_null(F.col(agent)).isNull(), "skip_no_agent").when(F.coalesce(F.col(confidence), F.lit("")) == "low", "skip_low")
    work = work.withColumn("_skip", skip)
    parts = [F.coalesce(key(F.col(c)), F.lit("")) for c in (agent, company, project)]
    alone = (parts[1] == "") & (parts[2] == "")
    group = F.when(alone, F.concat(F.lit("row "), F.col(seq).cast("string"))).otherwise(F.concat_ws("\u0001", *parts))
    number = F.row_number().over(W.partitionBy(group, F.col("_skip")).orderBy(seq))
    return work.withColumn("lookup", F.coalesce("_skip", F.when(number > 1, "duplicate").otherwise("query"))).drop("_skip")


def day_between(day: Column, start: Column, end: Column) -> Column:
    """Inclusive; swapped bounds are put right; undated rows are out if a bound is set, and no bounds let all in."""
    low, high = F.least(start, end), F.greatest(start, end)
    return F.when(start.isNull() & end.isNull(), True).otherwise(F.coalesce(day.between(low, high), F.lit(False)))


def confirmed_only(df: DataFrame, status: str) -> DataFrame:
    """C14: the confirmed rows if the status column exists, else all rows."""
    return df.where(F.col(status) == "confirmed") if status in df.columns else df


def is_special(project: Column, subject: Column, body: Column, words: tuple[str, ...]) -> Column:
    """A project decides alone if there is one, else subject and body do."""
    return F.when(blank_to_null(project).isNotNull(), any_hit(project, words)).otherwise(any_hit(F.concat_ws(" ", subject, body), words))


def is_settled(reason: Column, phrases: tuple[str, ...]) -> Column:
    """The reason holds a settled phrase."""
    return any_hit(reason, phrases)


def merge_intent_verdict(routed: DataFrame, verdicts: DataFrame, key: str) -> DataFrame:
    """Hard rows keep their route; no verdict makes uncertain; a target is valid and keeps a valid rule's
    reason; low confidence is uncertain; the rest is filtered. verdicts has (key, is_target, confidence).
    """
    v = verdicts.select(F.col(key).alias("_key"), "is_target", "confidence")
    out = routed.join(v, routed[key] == F.col("_key"), "left")
    final = F.when(F.col("hard"), F.col("status")).when(F.col("_key").isNull(), "uncertain").when(F.col("is_target"), "valid").when(F.col("confidence") == "low", "uncertain").otherwise("filtered")
    why = F.when(F.col("hard"), F.col("reason")).when(F.col("_key").isNull(), "no verdict, manual").when(F.col("is_target"), F.when(F.col("status") == "valid", F.col("reason")).otherwise("verdict: target")).when(F.col("confidence") == "low", "verdict unsure").otherwise("verdict: no target")
    return out.withColumn("final_status", final).withColumn("final_reason", why).drop("_key")


def merge_field_verdict(details: DataFrame, verdicts: DataFrame, key: str) -> DataFrame:
    """Adds semantic, issue_codes, issue_text and the lowered confidence; verdicts has (key, verdict,
    issues array<struct<code,field,reason>>). No verdict is failed and needs a person.
    """
    v = verdicts.select(F.col(key).alias("_key"), F.col("verdict").alias("_verdict"), F.col("issues").alias("_issues"))
    out = details.join(v, details[key] == F.col("_key"), "left")
    semantic = F.when(F.col("_key").isNull(), "failed").otherwise(F.col("_verdict"))
    codes = F.coalesce(F.array_join(F.array_distinct(F.transform("_issues", lambda i: i["code"])), "、"), F.lit(""))
    texts = F.coalesce(F.array_join(F.transform("_issues", lambda i: F.concat(i["field"], F.lit(": "), i["reason"])), "；"), F.lit(""))
    out = out.withColumns({"semantic": semantic, "issue_codes": codes, "issue_text": texts})
    return out.withColumn("confidence", F.when(F.col("semantic").isin("failed", "unsure", "invalid"), "manual").otherwise(F.col("confidence"))).drop("_key", "_verdict", "_issues")


def check_verdict_ids(asked: DataFrame, given: DataFrame, key: str) -> DataFrame:
    """Rows (key, problem) of ids asked for and absent, given and not asked for, or given more than once."""
    a = asked.select(key).distinct().withColumn("_asked", F.lit(True))
    g = given.groupBy(key).agg(F.count("*").alias("_given"))
    both = a.join(g, key, "full")
    problem = F.when(F.col("_given").isNull(), "absent").when(F.col("_asked").isNull(), "not asked").when(F.col("_given") > 1, "repeated")
    return both.select(key, problem.alias("problem")).where("problem is not null")


def share_decision(rows: DataFrame, mail: str, candidates: str, decision: str, seq: str) -> DataFrame:
    """The first decision, by seq, of a (mail, candidate set) goes to all rows that have the same."""
    same = W.partitionBy(mail, F.xxhash64(F.array_sort(candidates))).orderBy(seq).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    return rows.withColumn(decision, F.first(decision, ignorenulls=True).over(same))


def promote(confidence: Column, hint: Column, reviewed: Column, complete: Column, rules_ok: Column) -> tuple[Column, Column]:
    """Reviewed valid, complete, rules kept and confidence not low: high and no hint; unreviewed rows say so."""
    good = reviewed & complete & rules_ok & (F.coalesce(confidence, F.lit("")) != "low")
    return F.when(good, "high").otherwise(confidence), F.when(good, "").when(reviewed.isNull(), "not reviewed").otherwise(hint)
