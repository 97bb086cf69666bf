"""Work list against ledger: interval joins, verdicts, one-to-one item matching."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from tallyspark.functions.similarity import text_match_arrow
from tallyspark.functions.text import month_window
from tallyspark.sources.shared import dealt, tasks_of

from .grouped import by_group
from .numbering import numbered


def interval_join(work: DataFrame, ledger: DataFrame, on: list[str], anchor: str, date: str, months: int, side: str = "in") -> DataFrame:
    """Ledger rows of the same key around each work row's date, with window_class in / out / unknown and days.

    The window is inclusive on both ends. A missing date on either side is unknown: such candidates stay, since
    absence of a date is no evidence. side keeps one class, or all with "all". Keys are compared with =, so a null
    key matches nothing. Only the keys are shuffled on.
    """
    low, high = month_window(F.col(anchor), months)
    day = F.col(date).cast("date")
    kind = F.when(F.col(date).isNull() | F.col(anchor).isNull(), "unknown").when(day.between(low, high), "in").otherwise("out")
    pairs = work.join(ledger, on).withColumn("window_class", kind).withColumn("days", F.datediff(day, F.col(anchor).cast("date")))
    return pairs if side == "all" else pairs.where(F.col("window_class") == side)


def candidate_counts(work: DataFrame, ledger: DataFrame, on: list[str], anchor: str, date: str, months: int) -> DataFrame:
    """Counts n_in, n_out, n_unknown for every work row, and the nearest in-window date with its distance and ties.

    Work rows may repeat a key, and a key and anchor: each has its row. Both sides are counted by key and day first,
    so a key with many rows joins as many days as it has, not as many rows; no group is collected. Keys are dealt to as
    many tasks as the tables have rows for.
    """
    low, high = month_window(F.col(anchor), months)
    entries = ledger.select(*on, F.col(date).cast("date").alias("_day"), F.col(date).isNotNull().alias("_dated")).groupBy(*on, "_day", "_dated").agg(F.count("*").alias("_n"))
    tasks = tasks_of(work, ledger)
    rows = dealt(work.groupBy(*on, anchor).agg(F.count("*").alias("_copies")), *on, tasks=tasks).join(dealt(entries, *on, tasks=tasks), on, "left").withColumn("_n", F.coalesce("_n", F.lit(0)))
    unknown = ~F.col("_dated") | F.col(anchor).isNull()
    kind = F.when(F.col("_dated").isNull(), "none").when(unknown, "unknown").when(F.coalesce(F.col("_day").between(low, high), F.lit(False)), "in").otherwise("out")
    gap = F.abs(F.datediff("_day", F.col(anchor).cast("date")))
    rows = rows.withColumn("_kind", kind).withColumn("_gap", F.when(F.col("_kind") == "in", gap))
    near = rows.groupBy(*on, anchor, "_kind", "_gap").agg(F.sum("_n").alias("_n"), F.min("_day").alias("_day"), F.max("_copies").alias("_copies"))
    count = lambda name: F.coalesce(F.sum(F.when(F.col("_kind") == name, F.col("_n"))), F.lit(0)).alias(f"n_{name}")
    best = F.min(F.when(F.col("_kind") == "in", F.struct("_gap", "_day", "_n"))).alias("_near")
    out = near.groupBy(*on, anchor).agg(count("in"), count("out"), count("unknown"), best, F.max("_copies").alias("_copies"))
    out = out.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int"))))
    return out.select(*on, anchor, "n_in", "n_out", "n_unknown", F.col("_near._day").alias("nearest_date"), F.col("_near._gap").alias("nearest_days"), (F.col("_near._n") > 1).alias("nearest_tie"))


def cardinality_status(n: Column) -> Column:
    """None is missing, one is recorded, more need review."""
    return F.when(n == 0, "missing").when(n == 1, "recorded").otherwise("review")


def window_verdict(n_in: Column, n_out: Column, n_unknown: Column, nested: Column | None = None) -> Column:
    """An unknown date needs review; none inside but some outside is none_in_range; a lone survivor of many with
    a nested audit needs review; else by cardinality."""
    lone = (n_in == 1) & (n_out > 0) & (nested if nested is not None else F.lit(False))
    return F.when(n_unknown > 0, "review_date").when((n_in == 0) & (n_out > 0), "none_in_range").when(lone, "review_items").otherwise(cardinality_status(n_in))


def reconcile(work: DataFrame, ledger: DataFrame, on: list[str], anchor: str, date: str, months: int = 1) -> DataFrame:
    """candidate_counts() with the status by the number of candidates in the window or without a date."""
    out = candidate_counts(work, ledger, on, anchor, date, months)
    return out.withColumn("status", cardinality_status(F.col("n_in") + F.col("n_unknown")))


#: The fields whose agreement J1 notes, as (name, how two values agree).
FIELDS = ("agent", "company", "project")


def agreements(least: int = 85) -> dict[str, Column]:
    """J3, field by field, of work (w_) and ledger (l_) columns: agents are equal or one is blank, companies match,
    projects are both there and match."""
    blank = lambda c: F.coalesce(F.trim(F.col(c)), F.lit("")) == ""
    same = F.lower(F.trim("w_agent")) == F.lower(F.trim("l_agent"))
    match = lambda f, t: F.coalesce(text_match_arrow(F.col(f"w_{f}"), F.col(f"l_{f}"), t), F.lit(False))
    return {"agent": blank("w_agent") | blank("l_agent") | same, "company": match("company", least), "project": ~blank("w_project") & ~blank("l_project") & match("project", 85)}


def reconcile_notes(work: DataFrame, ledger: DataFrame, on: list[str], key: list[str], anchor: str, date: str, months: int = 1, windowed: bool = True) -> DataFrame:
    """For each work row (key) status, match_status, n, nearest_days and note, what a clerk reads beside the verdict.

    work has agent, company and project besides key, on and anchor; so has ledger besides on and date. With `windowed`,
    candidates outside the window take no part, as in reconcile(); without it all count, and a lone one outside is noted.
    No candidate is `missing`. One is recorded: `exact`, `fields differ` (the note names them, with both sides' values) or
    `date outside` (with the days). Several need review, `several`: the note has their number, the distance of the
    nearest dated one and whether it is tied, or that none has a date, and whether no candidate agrees in all fields.

    Both sides are counted by key, day and fields first, agreement is computed once for each pair of them, and all notes
    come from one grouping; no list of candidates is made.
    """
    low, high = month_window(F.col("_anchor"), months)
    mine = work.select(*on, F.col(anchor).cast("date").alias("_anchor"), *[F.coalesce(F.col(f), F.lit("")).alias(f"w_{f}") for f in FIELDS])
    day = F.col(date).cast("date")
    theirs = ledger.select(*on, day.alias("_day"), *[F.coalesce(F.col(f), F.lit("")).alias(f"l_{f}") for f in FIELDS])
    theirs = theirs.groupBy(*theirs.columns).agg(F.count("*").alias("_n"))
    pairs = mine.distinct().join(theirs, on)
    outside = F.col("_day").isNotNull() & F.col("_anchor").isNotNull() & ~F.coalesce(F.col("_day").between(low, high), F.lit(False))
    pairs = pairs.withColumn("_outside", outside)
    pairs = pairs.where(~F.col("_outside")) if windowed else pairs
    pairs = pairs.withColumns({f"_{f}": c for f, c in agreements().items()})
    whole = F.col("_agent") & F.col("_company") & F.col("_project")
    gap = F.abs(F.datediff("_day", "_anchor"))
    differ = F.concat_ws("; ", *[F.when(~F.col(f"_{f}"), F.concat(F.lit(f"{f}: "), F.col(f"w_{f}"), F.lit(" / "), F.col(f"l_{f}"))) for f in FIELDS])
    per = [*on, "_anchor", *[f"w_{f}" for f in FIELDS]]
    near = pairs.groupBy(*per, gap.alias("_gap")).agg(F.sum("_n").alias("_n"), F.sum(F.when(whole, F.col("_n")).otherwise(0)).alias("_whole"), F.min(differ).alias("_differ"), F.bool_or("_outside").alias("_outside"))
    best = F.min(F.when(F.col("_gap").isNotNull(), F.struct("_gap", "_n"))).alias("_near")
    sums = near.groupBy(*per).agg(F.sum("_n").alias("n"), F.sum("_whole").alias("_whole"), F.min("_differ").alias("_differ"), F.bool_or("_outside").alias("_outside"), best)
    rows = work.select(*key, *mine.columns[: len(on)], F.col(anchor).cast("date").alias("_anchor"), *[F.coalesce(F.col(f), F.lit("")).alias(f"w_{f}") for f in FIELDS])
    match = F.lit(True)
    left, right = rows.alias("w"), sums.alias("s")
    for c in per:
        match = match & F.col(f"w.{c}").eqNullSafe(F.col(f"s.{c}"))
    n, days, text = F.coalesce("n", F.lit(0)), F.col("_near._gap"), lambda c: c.cast("string")
    lone = F.when(F.col("_whole") == 0, "fields differ").when(F.col("_outside"), "date outside").otherwise("exact")
    tied = F.when(F.col("_near._n") > 1, " (tied)").otherwise("")
    many = F.concat(text(n), F.lit(" records"), F.coalesce(F.concat(F.lit("; the nearest is "), text(days), F.lit(" days away"), tied), F.lit("; none has a date")), F.when(F.col("_whole") == 0, "; none agrees in all fields").otherwise(""))
    note = F.when(n == 0, "").when(n > 1, many).when(F.col("_whole") == 0, F.concat(F.lit("one record, but "), F.col("_differ"))).when(F.col("_outside"), F.concat(F.lit("one record, but "), text(days), F.lit(" days away"))).otherwise("")
    status = F.when(n == 0, "missing").when(n > 1, "several").otherwise(lone)
    return left.join(right, match, "left").select(*[F.col(f"w.{c}").alias(c) for c in key], cardinality_status(n).alias("status"), status.alias("match_status"), n.cast("long").alias("n"), days.alias("nearest_days"), note.alias("note"))


def nearest_candidate(work: DataFrame, ledger: DataFrame, on: list[str], anchor: str, date: str, ties: list[str]) -> DataFrame:
    """for each work row the ledger row whose date is nearest, with days and whether others are as near.

    Work rows may repeat a key. Rows without a date take no part; equal distances are ordered by the date and then by
    `ties`. The answer depends on key and anchor alone, so it is found once for each pair of them: the ledger's days of
    a key are counted with the first row of each, and the nearest day is a minimum, not a sort.
    """
    rest = [c for c in ledger.columns if c not in (*on, date, *ties)]
    first = F.min(F.struct(date, *dict.fromkeys(ties), *rest)).alias("_first")
    entries = ledger.where(F.col(date).isNotNull()).withColumn("_day", F.col(date).cast("date")).groupBy(*on, "_day").agg(first, F.count("*").alias("_n"))
    asked = work.where(F.col(anchor).isNotNull()).select(*on, F.col(anchor).alias("_anchor")).distinct()
    tasks = tasks_of(work, ledger)
    pairs = dealt(asked, *on, tasks=tasks).join(dealt(entries, *on, tasks=tasks), on).withColumn("days", F.abs(F.datediff("_day", F.col("_anchor").cast("date"))))
    near = pairs.groupBy(*on, "_anchor", "days").agg(F.sum("_n").alias("_n"), F.min("_first").alias("_first"))
    best = near.groupBy(*on, "_anchor").agg(F.min(F.struct("days", "_n", "_first")).alias("_b"))
    found = best.select(*on, "_anchor", *[F.col(f"_b._first.{c}") for c in ledger.columns if c not in on], F.col("_b.days").alias("days"), (F.col("_b._n") > 1).alias("tie"))
    return work.withColumn("_anchor", F.col(anchor)).join(found, [*on, "_anchor"]).drop("_anchor")


def first_variant(work: DataFrame, ledger: DataFrame, variants: Column, name: str, on: list[str], key: list[str]) -> DataFrame:
    """Candidates of the first spelling, in order, that has any; later spellings are not looked at.

    variants is an array of spellings of a work row, `name` the ledger's column. key names a work row.
    """
    tries = work.withColumn("_variants", variants).select("*", F.posexplode("_variants").alias("variant_no", "variant")).drop("_variants")
    hits = tries.join(ledger, [*[F.col(f"w_{c}") == F.col(c) for c in on], F.col("variant") == F.col(name)])
    first = F.min("variant_no").over(W.partitionBy(*key))
    return hits.withColumn("first_no", first).where("variant_no = first_no").drop("first_no")


def field_agree(agent_a: Column, agent_b: Column, company_a: Column, company_b: Column, project_a: Column, project_b: Column, least: int = 85) -> Column:
    """Agents are equal or one is blank, companies match, projects are both there and match at 85.

    Texts are compared in Arrow batches; a missing company matches nothing.
    """
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    agents = blank(agent_a) | blank(agent_b) | (F.lower(F.trim(agent_a)) == F.lower(F.trim(agent_b)))
    match = lambda a, b, t: F.coalesce(text_match_arrow(a, b, t), F.lit(False))
    return agents & match(company_a, company_b, least) & ~blank(project_a) & ~blank(project_b) & match(project_a, project_b, 85)


def match_items(claims: DataFrame, registered: DataFrame, owner: str, keys: list[list[str]], order: list[str]) -> DataFrame:
    """One-to-one matching of claimed with registered items of the same owner; rows (owner, item columns, outcome).

    keys are tried in turn, for example brand with class, then brand with text: in each pass the nth claim of a key
    takes the nth registered item of that key, and the rest goes on to the next pass. Equal items are told apart by
    their number in `order`, so a pair claimed twice and registered once matches once. Outcomes: matched, missing
    (claimed only), extra (registered only). A claim with a blank key is pending and takes no part. It differs from
    the ordered search of match_items_in_order() only where one registered item could serve two claims by different keys.
    """
    items = claims.select(F.lit("claim").alias("side"), "*").unionByName(registered.select(F.lit("registered").alias("side"), "*"))
    blank = lambda c: F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) == ""
    items = items.withColumn("outcome", F.when((F.col("side") == "claim") & blank(keys[0][0]), "pending"))
    for key in keys:
        lonely = F.col("outcome").isNull() & ~(blank(key[0]) if len(key) == 1 else blank(key[0]) | blank(key[-1]))
        number = F.row_number().over(W.partitionBy(owner, *key, "side", "_open").orderBy(*order))
        items = dealt(items.withColumn("_open", lonely), owner, *key).withColumn("_no", number)
        both = F.count("*").over(W.partitionBy(owner, *key, "_open", "_no")) == 2
        items = items.withColumn("outcome", F.when(F.col("_open") & both, "matched").otherwise(F.col("outcome"))).drop("_open", "_no")
    return items.withColumn("outcome", F.coalesce("outcome", F.when(F.col("side") == "claim", "missing").otherwise("extra")))


#: Items of an owner that are searched in one group; a larger owner is matched by passes.
MOST_ITEMS = 10_000


def claimed_in_order(claims: list[tuple], free: list[tuple], largest: bool) -> list[int | None]:
    """For each claim the place of its registered item: the first one still free that agrees in one of the keys.

    Both are tuples of one value for each key, None where it is blank. With `largest`, claims that find nothing free move
    earlier ones to other items (augmenting paths), so as many as possible are matched.
    """
    by_key: dict[tuple[int, object], list[int]] = {}
    for place, item in enumerate(free):
        for k, value in enumerate(item):
            if value is not None:
                by_key.setdefault((k, value), []).append(place)
    fits = [sorted({p for k, value in enumerate(claim) if value is not None for p in by_key.get((k, value), ())}) for claim in claims]
    holder: dict[int, int] = {}
    for claim, places in enumerate(fits):
        first = next((p for p in places if p not in holder), None)
        if first is not None:
            holder[first] = claim
        elif largest:
            # Breadth first over items, each reached from the claim that would take it.
            came, queue, end = {p: (claim, None) for p in places}, list(places), None
            for p in queue:
                if p not in holder:
                    end = p
                    break
                for q in fits[holder[p]]:
                    if q not in came:
                        came[q] = (holder[p], p)
                        queue.append(q)
            while end is not None:
                holder[end], end = came[end]
    out: list[int | None] = [None] * len(claims)
    for place, claim in holder.items():
        out[claim] = place
    return out


def match_items_in_order(claims: DataFrame, registered: DataFrame, owner: str, keys: list[list[str]], order: list[str], largest: bool = False, most: int = MOST_ITEMS) -> DataFrame:
    """match_items() by the ordered search: each claim, in order, takes the first free registered item of its owner, in
    order, that agrees in any of the keys, so an item that could serve two claims goes to the first. With `largest`, as
    many claims as possible are matched.

    Adds outcome and partner, the number of the other side's item (from 0, in order) for matched rows. A claim whose first
    or last key column is blank in all keys is pending. Owners are searched in Arrow batches of many; owners with more than `most` items, which
    no message has, are matched by match_items() and have no partner.
    """
    items = claims.select(F.lit("claim").alias("side"), "*").unionByName(registered.select(F.lit("registered").alias("side"), "*"))
    blank = lambda c: F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) == ""
    key = lambda cols: F.when(~(blank(cols[0]) | blank(cols[-1])), F.to_json(F.struct(*cols)))
    many = items.groupBy(owner).count().where(F.col("count") > most).select(owner)
    columns = items.columns
    schema = StructType([StructField(f.name, f.dataType) for f in items.schema]).add("outcome", StringType()).add("partner", IntegerType())

    def search(table: pa.Table, groups: list[range]) -> pa.Table:
        side, tags = table["side"].to_pylist(), list(zip(*(table[f"_k{i}"].to_pylist() for i in range(len(keys)))))
        outcome = ["extra" if s == "registered" else "pending" for s in side]
        partner: list[int | None] = [None] * len(side)
        for group in groups:
            claimed, theirs = [i for i in group if side[i] == "claim"], [i for i in group if side[i] == "registered"]
            mine = [i for i in claimed if any(x is not None for x in tags[i])]
            found = claimed_in_order([tags[i] for i in mine], [tags[i] for i in theirs], largest)
            number = {i: n for n, i in enumerate(claimed)}
            for i, place in zip(mine, found):
                outcome[i] = "missing" if place is None else "matched"
                if place is not None:
                    outcome[theirs[place]] = "matched"
                    partner[i], partner[theirs[place]] = place, number[i]
        return table.select(columns).append_column("outcome", pa.array(outcome, pa.string())).append_column("partner", pa.array(partner, pa.int32()))

    small = items.join(many, owner, "left_anti").withColumns({f"_k{i}": key(k) for i, k in enumerate(keys)})
    out = by_group(small, owner, [F.asc_nulls_last(c) for c in order], search, schema)
    large = match_items(claims.join(many, owner, "left_semi"), registered.join(many, owner, "left_semi"), owner, keys, order)
    return out.unionByName(large.withColumn("partner", F.lit(None).cast("int")))


def item_gate(owners: DataFrame, owner: str, orders: DataFrame, details: DataFrame, needed: list[str]) -> DataFrame:
    """(owner, n_orders, gate): why an owner's items can't be compared, blank if they can.

    Only a single order can be compared: none is `no order`, several are `several orders`. Then its detail table must
    be read (`detail unread`), have the columns needed (`columns missing`) and rows (`detail empty`). orders has one
    row an order of the owner; details one row an owner that was read: columns (array of names) and n_rows.
    """
    counted = orders.groupBy(owner).agg(F.count("*").alias("n_orders"))
    read = details.select(owner, F.col("columns").alias("_columns"), F.col("n_rows").alias("_rows"), F.lit(True).alias("_read"))
    out = owners.select(owner).distinct().join(counted, owner, "left").join(read, owner, "left").withColumn("n_orders", F.coalesce("n_orders", F.lit(0)))
    lacks = F.size(F.array_except(F.array(*[F.lit(c) for c in needed]), F.coalesce("_columns", F.expr("cast(array() as array<string>)")))) > 0
    gate = F.when(F.col("n_orders") == 0, "no order").when(F.col("n_orders") > 1, "several orders").when(F.col("_read").isNull(), "detail unread").when(lacks, "columns missing").when(F.coalesce("_rows", F.lit(0)) == 0, "detail empty").otherwise("")
    return out.select(owner, "n_orders", gate.alias("gate"))


def item_outcome(items: DataFrame, owner: str, gates: DataFrame | None = None) -> DataFrame:
    """Per owner the counts of claims matched, missing and pending, of extra items, and the overall outcome.

    gates are item_gate() rows: an owner that can't be compared is pending whatever its items say, and the gate says
    why; owners that only the gates name have their row too.
    """
    claim = F.col("side") == "claim"
    count = lambda outcome: F.count_if(claim & (F.col("outcome") == outcome)).alias(f"n_{outcome}")
    out = items.groupBy(owner).agg(count("matched"), count("missing"), count("pending"), F.count_if(F.col("outcome") == "extra").alias("n_extra"))
    overall = F.when(F.col("n_missing") > 0, "missing").when(F.col("n_pending") > 0, "pending").when(F.col("n_matched") > 0, "matched").otherwise("none")
    if gates is None:
        return out.withColumn("overall", overall)
    out = out.join(gates.select(owner, "gate"), owner, "full").withColumn("gate", F.coalesce("gate", F.lit("")))
    out = out.withColumns({n: F.coalesce(n, F.lit(0)) for n in ("n_matched", "n_missing", "n_pending", "n_extra")})
    return out.withColumn("overall", F.when(F.col("gate") != "", "pending").otherwise(overall))


def audit_label(result: Column, forced: Column | None = None) -> Column:
    """The label of an audit result; a forced reason makes it pending."""
    label = F.when(result == "matched", "agrees").when(result == "missing", "lacks items").when(result == "pending", "needs review").otherwise("not audited")
    return F.when(forced.isNotNull() & (forced != ""), F.concat(F.lit("needs review: "), forced)).otherwise(label) if forced is not None else label


def missing_report(outcomes: DataFrame, status: str, order: list[str], lookup: str | None = None) -> DataFrame:
    """Definite misses, numbered in `order`. A failed or skipped lookup is no miss."""
    sure = F.col(status) == "missing"
    if lookup:
        sure = sure & (F.col(lookup) == "done")
    return numbered(outcomes.where(sure), [F.col(c) for c in order], "report_no")
