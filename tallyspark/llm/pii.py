"""Personal data: base patterns, and contextual patterns that are bootstrapped from what these find."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import cut

#: The kinds in their order. Possessive forms match what the greedy forms match, without deep stacks.
PATTERNS = (
    ("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    ("ip", r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"),
    ("card", r"(?<![0-9])[0-9](?:[\x20-]?[0-9]){11,}+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
)
KINDS = (*(kind for kind, _ in PATTERNS), "context")
PART = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"
#: A string of letters, digits and signs with a digit or @ in it, behind opening signs; it ends with a letter or digit.
VALUE = r"[\"'(<\[{]*+\+?(?=[A-Za-z._%+/-]*+[0-9@])[A-Za-z0-9](?:[A-Za-z0-9@._%+/-]*[A-Za-z0-9])?"
#: What stands before a value on its line: two words; one word from the line's start; nothing. Only one letter is
#: consumed, so that contexts overlap.
LINE = r"(?<![^\n\r\x0B\f])[ \t]*+"
CONTEXTS = (rf"(?<!\S)(?=(\S++[ \t]++\S++[ \t]++{VALUE}))\S", rf"{LINE}(?=(\S++[ \t]++{VALUE}))\S", rf"{LINE}(?=({VALUE}))\S")
#: Rounds of scoring between two promotions; confidence and known instances that a pattern needs.
ROUNDS, CONFIDENCE, SUPPORT = 2, 0.7, 3


def found(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches as (start, end, value), in code points, end exclusive.

    The pieces between matches and the matches alternate, so their lengths add up to the places.
    """
    pieces, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    kind = "struct<at:int,out:array<struct<start:int,end:int,value:string>>>"
    none = F.from_json(F.lit('{"at":0,"out":[]}'), kind)

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["pieces"])
        end = start + F.length(x["hits"])
        one = F.struct(start.alias("start"), end.alias("end"), x["hits"].alias("value"))
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(one)).alias("out"))

    both = F.arrays_zip(F.slice(pieces, 1, F.size(hits)).alias("pieces"), hits.alias("hits"))
    return F.aggregate(both, none, step, lambda acc: acc["out"])


def near(text: Column) -> Column:
    """Every candidate value with its pattern, as (start, end, value, pattern), end exclusive.

    The pattern is the two words before the value on its line, in small letters and with 0 for each digit; a line
    break stands for each word that the line lacks.
    """

    def candidate(lacks: int, at: Column, group: Column) -> Column:
        words = F.split(group, r"[ \t]+")
        value = F.regexp_replace(F.element_at(words, -1), r"^[\"'(<\[{]+", "")
        end = at + F.length(group)
        before = F.array_join(F.concat(F.array_repeat(F.lit("\n"), lacks), F.slice(words, 1, 2 - lacks)), " ")
        pattern = F.regexp_replace(F.lower(before), "[0-9]", "0")
        return F.struct((end - F.length(value)).alias("start"), end.alias("end"), value.alias("value"), F.when(F.length(pattern) > 200, F.md5(pattern)).otherwise(pattern).alias("pattern"))

    def candidates(lacks: int) -> Column:
        both = F.arrays_zip(found(text, CONTEXTS[lacks]).alias("places"), F.regexp_extract_all(text, F.lit(CONTEXTS[lacks]), F.lit(1)).alias("groups"))
        return F.transform(both, lambda x: candidate(lacks, x["places"]["end"] - 1, x["groups"]))

    none = F.expr("cast(array() as array<struct<start:int,end:int,value:string,pattern:string>>)")
    return F.when(text.rlike("[0-9@]"), F.concat(*map(candidates, range(len(CONTEXTS))))).otherwise(none)


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    n = F.length(number)
    values = F.transform(F.sequence(F.lit(1), n), lambda i: F.substr(number, i, F.lit(1)).cast("int") * (1 + (n - i) % 2))
    return F.aggregate(values, F.lit(0), lambda a, x: a + F.when(x > 9, x - 9).otherwise(x)) % 10 == 0


def valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return value.rlike(rf"^{PART}(?:\.{PART}){{3}}$")
    if kind == "card":
        return F.length(digits(value)).between(12, 19) & luhn(digits(value))
    if kind == "phone":
        return F.length(digits(value)).between(9, 15)
    return F.lit(True)


def base_spans(text: Column) -> Column:
    """The base kinds' spans as (start, rank, end), rank the kind's place, by start and then kind."""
    parts = []
    for rank, (kind, pattern) in enumerate(PATTERNS):
        hint = {"email": text.contains("@"), "phone": text.contains("+")}.get(kind, text.rlike("[0-9]"))
        hits = F.filter(found(text, pattern), lambda x: valid(kind, x["value"]))
        spans = F.transform(hits, lambda x: F.struct(x["start"].alias("start"), F.lit(rank).alias("rank"), x["end"].alias("end")))
        parts.append(F.when(hint, spans).otherwise(F.expr("cast(array() as array<struct<start:int,rank:int,end:int>>)")))
    return F.array_sort(F.concat(*parts))


def described(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["rank"] + 1), s["start"], s["end"])), ",")


def scored(graph: DataFrame, facts: DataFrame, rounds: int) -> DataFrame:
    """Rows (pattern, support, confidence) after some rounds; facts has (value, known)."""
    facts = facts.withColumn("score", F.col("known").cast("double"))
    for last in range(rounds):
        rows = graph.select("pattern", "value").join(facts, "value")
        found = rows.groupBy("pattern").agg(F.avg("score").alias("mean"), F.sum("known").alias("support"))
        found = cut(found.select("pattern", "support", (F.col("mean") * F.col("support") / (F.col("support") + 1)).alias("confidence")).where("support > 0"))
        if last + 1 < rounds:
            doubt = graph.join(found, "pattern").groupBy("value").agg(F.sum(F.log(1 - F.least("confidence", F.lit(0.999)))).alias("doubt"))
            facts = facts.select("value", "known").join(doubt, "value", "left")
            facts = facts.select("value", "known", F.when(F.col("known") == 1, 1.0).otherwise(1 - F.exp(F.coalesce("doubt", F.lit(0.0)))).alias("score"))
    return found


def patterns(edges: DataFrame, rounds: int = ROUNDS, confidence: float = CONFIDENCE, support: int = SUPPORT) -> DataFrame:
    """High-confidence patterns (pattern, confidence, support) of a graph of rows (pattern, value, known).

    In each round a pattern's confidence is the mean score of its distinct instances, lowered by k / (k + 1) where
    k known instances support it; an unseen instance's score is the chance that at least one of its patterns is
    right. Known instances score 1. After `rounds` rounds the instances of the good patterns become known, and
    this repeats until none is new; scores only grow, so no pattern is lost on the way. Each repetition but the
    last makes at least one value known for good, so there are no more of them than unseen values. Both sides are
    sums by key, so a frequent word pair needs no group of its own.
    """
    graph = cut(edges.groupBy("pattern", "value").agg(F.max(F.col("known").cast("int")).alias("known")))
    facts = cut(graph.groupBy("value").agg(F.max("known").alias("known")))
    while True:
        good = cut(scored(graph, facts, rounds).where((F.col("confidence") >= confidence) & (F.col("support") >= support)))
        behind = graph.join(good.select("pattern"), "pattern", "left_semi").select("value").distinct()
        fresh = cut(facts.where("known = 0").join(behind, "value", "left_semi").select(F.col("value").alias("fresh")))
        if fresh.isEmpty():
            return good
        facts = facts.join(fresh, F.col("value") == F.col("fresh"), "left")
        facts = cut(facts.select("value", F.when(F.col("fresh").isNotNull(), 1).otherwise(F.col("known")).alias("known")))


def detect(docs: DataFrame, rounds: int = ROUNDS, confidence: float = CONFIDENCE, support: int = SUPPORT) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans (base and added, kind:start:end).

    Base spans are the patterns' matches that pass their checks. Around every string of letters and digits the two
    words before it on its line, or the line's start, are its lexical pattern (see near()); strings that overlap a
    base span are known, and a base span is one instance, blanks included. Patterns that mostly precede known
    strings are kept, what stands behind them is known to the next patterns (see patterns()), and all strings
    behind them are added with the kind `context`. Null counts as empty: no spans, the digest of nothing. Texts
    are read whole. Repeated rows get equal rows; other columns are left out; an empty table gives an empty
    result. Only built-in functions.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.xxhash64("text", F.lit(1)).alias("tid"), text.alias("text"))
    slim = rows.select("doc_id", "tid", "text", base_spans(F.col("text")).alias("base"), near(F.col("text")).alias("near"))
    inside = lambda x: F.exists("base", lambda s: (s["start"] < x["start"]) & (s["end"] > x["start"]))
    over = lambda x: F.filter("base", lambda s: (s["start"] < x["end"]) & (s["end"] > x["start"]))

    def instance(x: Column) -> Column:
        last = F.array_max(F.transform(over(x), lambda s: s["end"]))
        value = F.when(last > x["end"], F.substr(F.col("text"), x["start"] + 1, last - x["start"])).otherwise(x["value"])
        return F.struct(x["start"].alias("start"), x["end"].alias("end"), value.alias("value"), x["pattern"].alias("pattern"), last.isNotNull().alias("known"))

    slim = cut(slim.select("doc_id", "tid", "base", F.transform(F.filter("near", lambda x: ~inside(x)), instance).alias("near")))
    each = slim.where(F.size("near") > 0).select("doc_id", "tid", F.explode("near").alias("x")).select("doc_id", "tid", "x.*")
    good = patterns(each, rounds, confidence, support)
    fresh = each.where("not known").join(good.select("pattern"), "pattern", "left_semi").select("doc_id", "tid", F.struct("start", F.lit(len(PATTERNS)).alias("rank"), "end").alias("s"))
    fresh = fresh.groupBy(F.col("doc_id").alias("a_doc"), F.col("tid").alias("a_tid")).agg(F.collect_set("s").alias("added"))
    both = slim.join(fresh, F.col("doc_id").eqNullSafe(F.col("a_doc")) & (F.col("tid") == F.col("a_tid")), "left")
    count = lambda rank: F.size(F.filter("base", lambda s: s["rank"] == rank)).cast("long")
    everything = F.when(F.col("added").isNull(), F.col("base")).otherwise(F.array_sort(F.concat("base", "added")))
    return both.select("doc_id", *[count(rank).alias(f"n_{kind}") for rank, (kind, _) in enumerate(PATTERNS)], F.sha2(described(F.col("base")), 256).alias("base_sha256"), described(everything).alias("spans"))
