"""The keyed ledger: versions of a table, overlays, folds of events. Tables in, tables out."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tallyspark.functions.text import blank_to_null, short_hash
from tallyspark.sources.shared import cut


def occurrence_no(df: DataFrame, base: str, seq: str) -> DataFrame:
    """adds occurrence, the 0-based place among equal bases by seq."""
    return df.withColumn("occurrence", F.row_number().over(W.partitionBy(base).orderBy(seq)) - 1)


def keyed(df: DataFrame, base: str, seq: str, dataset: str) -> DataFrame:
    """Adds record_key and detail_number: the hash of dataset, base and occurrence, and the same without the dataset."""
    out = occurrence_no(df, base, seq)
    key = short_hash(F.concat_ws("|", F.lit(dataset), base, F.col("occurrence").cast("string")))
    return out.withColumn("record_key", key).withColumn("detail_number", F.upper(short_hash(F.concat_ws("|", base, F.col("occurrence").cast("string"))))).drop("occurrence")


def upsert(snapshot: DataFrame, batch: DataFrame, key: str, stamp: Column) -> DataFrame:
    """The next version: batch rows replace those of their key and keep first_seen; others stay. Adds change,
    inserted / updated / kept. Applying a batch twice gives the same rows but for updated_at.

    snapshot has the batch's columns and first_seen, updated_at. One full outer join on the key.
    """
    cols = batch.columns
    old = snapshot.select(F.col(key).alias("_key"), F.struct(*cols).alias("_old"), "first_seen", "updated_at")
    new = batch.select(F.col(key).alias("_new_key"), F.struct(*cols).alias("_new"))
    both = old.join(new, F.col("_key") == F.col("_new_key"), "full")
    fresh = F.col("_new_key").isNotNull()
    row = F.when(fresh, F.col("_new")).otherwise(F.col("_old"))
    change = F.when(F.col("_key").isNull(), "inserted").when(fresh, "updated").otherwise("kept")
    return both.select(row.alias("_row"), F.coalesce("first_seen", stamp).alias("first_seen"), F.when(fresh, stamp).otherwise(F.col("updated_at")).alias("updated_at"), change.alias("change")).select("_row.*", "first_seen", "updated_at", "change")


def batch_log(changes: DataFrame, dataset: str, batch: str, source: str, stamp: Column) -> DataFrame:
    """The one row that logs a batch: dataset, batch, source, n_inserted, n_updated, logged_at; kept rows are none."""
    n = lambda kind: F.count_if(F.col("change") == kind).alias(f"n_{kind}")
    return changes.agg(n("inserted"), n("updated")).select(F.lit(dataset).alias("dataset"), F.lit(batch).alias("batch"), F.lit(source).alias("source"), "n_inserted", "n_updated", stamp.alias("logged_at"))


def log_operation(log: DataFrame, actions: DataFrame, stamp: Column) -> DataFrame:
    """I4: the log with the actions of people and of the system appended, each under the day it counts for.

    The log has (day, action, record_id, mail_id, reason, result, at), result as JSON. actions has action and any of the
    others; a day or time that is absent or null is the stamp's, blanks stand for other absent values.
    """
    at = F.coalesce(F.col("at"), stamp) if "at" in actions.columns else stamp
    day = F.coalesce(F.col("day"), at.cast("date")) if "day" in actions.columns else at.cast("date")
    text = lambda c: (F.coalesce(F.col(c), F.lit("")) if c in actions.columns else F.lit("")).alias(c)
    rows = actions.select(day.alias("day"), *map(text, ("action", "record_id", "mail_id", "reason", "result")), at.alias("at"))
    return log.unionByName(rows)


def operations(log: DataFrame, day: Column | None = None) -> DataFrame:
    """I4: the log's rows of one day, or of all, newest first; a log that is partitioned by day is read there alone."""
    rows = log.where(F.col("day") == day) if day is not None else log
    return rows.orderBy(F.col("day").desc(), F.col("at").desc(), "action", "record_id", "mail_id")


#: The answers of a manual check and what they say about the match.
OUTCOMES = {"yes": "found by hand", "no": "missing by hand", "review": "open by hand"}
IDENTITY = ("sender", "sent", "subject", "company", "project")


def record_manual_outcome(overlay: DataFrame, answers: DataFrame, stamp: Column) -> tuple[DataFrame, DataFrame]:
    """(the overlay's next version, events): answers of a manual check go to the overlay of overlay_newest(), never
    to the automatic result, so the next reading of both lets the newer one win.

    answers has IDENTITY, found (yes, no or review), match_status, note, record_id and seq. An answer without its whole
    identity or with another word stops the query before anything is written. The last answer by seq of an identity counts
    and replaces the overlay's row of that identity; first_seen stays. events has one row for each answer with a
    record_id: record_id, seq, at, action `manual_outcome`, reason (the note, else the match status).
    """
    whole = reduce(lambda a, b: a & b, [blank_to_null(F.col(c).cast("string")).isNotNull() for c in IDENTITY])
    known = F.coalesce(F.col("found").isin(*OUTCOMES), F.lit(False))
    stop = F.when(~known, F.raise_error(F.lit("an outcome is yes, no or review"))).when(~whole, F.raise_error(F.lit("sender, sent, subject, company and project are needed")))
    checked = answers.where(stop.otherwise(F.lit(True)))
    status = F.coalesce(blank_to_null(F.col("match_status")), F.create_map(*[F.lit(x) for pair in OUTCOMES.items() for x in pair])[F.col("found")])
    rows = checked.withColumns({"match_status": status, "checked_at": stamp, "detail_key": short_hash(F.concat_ws("|", *[F.col(c).cast("string") for c in IDENTITY]))})
    kept = [*IDENTITY, "found", "match_status", "note", "checked_at", "detail_key"]
    last = rows.groupBy("detail_key").agg(F.max_by(F.struct(*kept), "seq").alias("_r")).select("_r.*")
    events = rows.where(blank_to_null(F.col("record_id")).isNotNull()).select("record_id", "seq", F.col("checked_at").alias("at"), F.lit("manual_outcome").alias("action"), F.coalesce(blank_to_null(F.col("note")), F.col("match_status")).alias("reason"))
    return upsert(overlay, last, "detail_key", stamp), events


def enqueue_retry(queue: DataFrame, requests: DataFrame, key: list[str], at: str) -> DataFrame:
    """The queue with one pending entry for each detail identity: the newest request replaces older ones.

    requests has the key's columns and at; a request with a blank part of its key stops the query. Of requests of one
    time the one with the greatest values counts. queue has the requests' columns and status; entries of other keys stay.
    """
    whole = reduce(lambda a, b: a & b, [blank_to_null(F.col(c).cast("string")).isNotNull() for c in key])
    checked = requests.where(F.when(~whole, F.raise_error(F.lit("a retry needs its whole identity"))).otherwise(F.lit(True)))
    rows = queue.unionByName(checked.withColumn("status", F.lit("pending")))
    cols = rows.columns
    return rows.groupBy(*[F.col(c).alias(f"_k_{c}") for c in key]).agg(F.max_by(F.struct(*cols), F.struct(at, *[c for c in cols if c != at])).alias("_r")).select("_r.*")


def save_item_draft(items: DataFrame, drafts: DataFrame, owner: str, item: str, classes: dict[str, str]) -> DataFrame:
    """The items with drafts put in: same owner and item id replace brand, category and class, new ids are added.

    Items have owner, item, brand, category, category_class, class_name, status and confirmed. A class outside `classes`
    becomes blank and the status unmatched; a draft never confirms: an item keeps its confirmation only if it is as before.
    No event is written and no status of the detail changes. Drafts repeat an item at most once.
    """
    kind = F.when(F.col("category_class").isin(*classes), F.col("category_class")).otherwise("")
    text = lambda c: F.coalesce(F.trim(F.col(c)), F.lit(""))
    fresh = drafts.select(F.col(owner).alias("_o"), F.col(item).alias("_i"), text("brand").alias("_b"), text("category").alias("_c"), kind.alias("_k"))
    both = items.join(fresh, (F.col(owner) == F.col("_o")) & (F.col(item) == F.col("_i")), "full")
    there = F.col("_o").isNotNull()
    same = F.col("brand").eqNullSafe(F.col("_b")) & F.col("category").eqNullSafe(F.col("_c")) & F.col("category_class").eqNullSafe(F.col("_k"))
    names = F.create_map(*[F.lit(x) for pair in classes.items() for x in pair])
    put = {
        owner: F.coalesce(F.col(owner), F.col("_o")), item: F.coalesce(F.col(item), F.col("_i")),
        "brand": F.when(there, F.col("_b")).otherwise(F.col("brand")), "category": F.when(there, F.col("_c")).otherwise(F.col("category")),
        "category_class": F.when(there, F.col("_k")).otherwise(F.col("category_class")), "class_name": F.when(there, F.coalesce(F.try_element_at(names, F.col("_k")), F.lit(""))).otherwise(F.col("class_name")),
        "status": F.when(there, F.when(F.col("_k") != "", "matched").otherwise("unmatched")).otherwise(F.col("status")), "confirmed": F.when(there, F.coalesce(same & F.col("confirmed"), F.lit(False))).otherwise(F.col("confirmed")),
    }
    return both.select(*[put[c].alias(c) for c in items.columns if c in put])


def delete_item(items: DataFrame, deleted: DataFrame, owner: str, item: str, stamp: Column) -> tuple[DataFrame, DataFrame]:
    """(items without the deleted ones, events): each item that was there and is deleted leaves an event with its
    owner, item id, action `delete_item`, brand and category as reason, and time. Unknown ids change nothing."""
    gone = deleted.select(owner, item).distinct()
    there = items.join(gone, [owner, item], "left_semi")
    events = there.select(owner, item, F.lit("delete_item").alias("action"), F.concat_ws(" / ", "brand", "category").alias("reason"), stamp.alias("at"))
    return items.join(gone, [owner, item], "left_anti"), events


def replace_range(snapshot: DataFrame, batch: DataFrame, day: str, low: Column, high: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(next version, archived rows, refreshed days). All rows of the days low to high go to the archive and the
    batch takes their place; a batch row outside the range stops the query before anything is written. Every day of
    the range counts as refreshed, also for an empty batch.
    """
    inside = F.col(day).between(low, high)
    checked = batch.where(F.when(~F.coalesce(inside, F.lit(False)), F.raise_error(F.lit("a row is outside the range"))).otherwise(F.lit(True)))
    spark = snapshot.sparkSession
    days = spark.range(1).select(F.explode(F.sequence(low, high)).alias(day))
    kept = snapshot.where(~F.coalesce(inside, F.lit(False)))
    return kept.unionByName(checked, allowMissingColumns=True), snapshot.where(inside), days


def drop_refreshed(batch: DataFrame, refreshed: DataFrame, day: str) -> DataFrame:
    """Rows of a refreshed day can't come back through a later import; undated rows pass."""
    return batch.join(refreshed.select(day).distinct(), day, "left_anti")


def once(requests: DataFrame, request: str, order: list[str]) -> DataFrame:
    """A repeated request keeps its first reply; rows without a request id all stay."""
    named = F.col(request).isNotNull()
    first = F.row_number().over(W.partitionBy(request).orderBy(*order)) == 1
    kept = requests.where(named).withColumn("_first", first).where("_first").drop("_first")
    return kept.unionByName(requests.where(~named))


#: Fixed value: what each action makes of a record's status.
STATUS = {"edit": "review", "confirm": "confirmed", "confirm_detail": "confirmed", "return": "returned", "needs_info": "needs_info"}


def fold_reviews(events: DataFrame, record: str = "record_id", seq: str = "seq") -> DataFrame:
    """(record_id, status, fields, n_events, last_at) after all events, in the order of seq.

    events has action, fields (map) and at. A reset forgets everything before it; a record whose last event is a
    reset has no row. edit sets fields and makes review; agent_confirm sets the agent and makes ready, or review
    without one; other actions make their status. Later fields win. streaming.reviews folds by the same rules.
    """
    reset = F.max(F.when(F.col("action") == "reset", F.col(seq))).over(W.partitionBy(record))
    live = events.withColumn("_reset", F.coalesce(reset, F.lit(-1))).where(F.col(seq) > F.col("_reset"))
    agent = F.coalesce(blank_to_null(F.col("fields")["agent"]), F.lit(""))
    status = F.when(F.col("action") == "agent_confirm", F.when(agent != "", "ready").otherwise("review"))
    for action, value in STATUS.items():
        status = status.when(F.col("action") == action, value)
    sets = F.col("action").isin("edit", "agent_confirm") & F.col("fields").isNotNull()
    rows = live.withColumn("_status", status)
    out = rows.groupBy(record).agg(
        F.max_by("_status", F.when(F.col("_status").isNotNull(), F.col(seq))).alias("status"),
        F.array_sort(F.collect_list(F.when(sets, F.struct(F.col(seq).alias("seq"), F.map_entries("fields").alias("entries"))))).alias("_sets"),
        F.count("*").alias("n_events"),
        F.max("at").alias("last_at"),
    )
    none = F.expr("cast(map() as map<string,string>)")

    def put(acc: Column, one: Column) -> Column:
        fresh = F.map_from_entries(one["entries"])
        return F.map_concat(F.map_filter(acc, lambda k, _: ~F.map_contains_key(fresh, k)), fresh)

    return out.select(record, "status", F.aggregate("_sets", none, put).alias("fields"), "n_events", "last_at")


def effective_status(saved: Column, issues: Column, needs: Column, semantic: Column, confidence: Column, agent: Column) -> Column:
    """The saved state, else review for rule issues, hints, bad semantics, low or medium confidence or no agent."""
    doubt = (F.size(issues) > 0) | blank_to_null(needs).isNotNull() | F.coalesce(semantic, F.lit("")).isin("uncertain", "invalid", "failed") | F.coalesce(confidence, F.lit("")).isin("low", "medium") | blank_to_null(agent).isNull()
    return F.when(saved.isin("review", "ready", "confirmed", "returned", "needs_info"), saved).when(doubt, "review").otherwise("ready")


def merge_saved_fields(auto: Column, saved: Column, cleared: Column, placeholders: tuple[str, ...]) -> Column:
    """I8: a saved value overrides; a blank one only if it was cleared on purpose; placeholders never do."""
    given = blank_to_null(saved)
    return F.when(F.lower(given).isin(*placeholders), auto).when(given.isNotNull(), given).when(saved.isNotNull() & cleared, "").otherwise(auto)


def confirm_ready(status: Column, special: Column, items: Column) -> Column:
    """A special detail is ready if it has items and every one is confirmed, others by their status."""
    return F.when(special, (F.size(items) > 0) & F.forall(items, lambda i: F.coalesce(i["confirmed"], F.lit(False)))).otherwise(status == "confirmed")


def confirm_items(old: DataFrame, new: DataFrame, owner: str, item: str, fields: list[str]) -> DataFrame:
    """Adds confirmed to the new items: the old confirmation, if all fields are unchanged and none is blank."""
    was = old.select(F.col(owner).alias("_o"), F.col(item).alias("_i"), *[F.col(f).alias(f"_{f}") for f in fields], F.col("confirmed").alias("_c"))
    out = new.join(was, (F.col(owner) == F.col("_o")) & (F.col(item) == F.col("_i")), "left")
    same = reduce(lambda a, b: a & b, [F.col(f).eqNullSafe(F.col(f"_{f}")) & blank_to_null(F.col(f)).isNotNull() for f in fields])
    return out.select(*[F.col(c) for c in new.columns if c != "confirmed"], (same & F.coalesce("_c", F.lit(False))).alias("confirmed"))


def bulk_confirm(details: DataFrame, mail: str, status: str) -> DataFrame:
    """(mail, eligible, blocked): a mail is eligible if all details are ready or confirmed."""
    good = F.col(status).isin("ready", "confirmed")
    return details.groupBy(mail).agg(F.bool_and(good).alias("eligible"), F.count_if(~good).alias("blocked"))


def route_overrides(mails: DataFrame, events: DataFrame, mail: str, seq: str, route: str) -> DataFrame:
    """The latest route event of a mail wins over its own route; history counts both directions."""
    last = events.groupBy(F.col(mail).alias("_mail")).agg(F.max_by(route, seq).alias("_route"), F.count("*").alias("n_route_events"))
    out = mails.join(last, mails[mail] == F.col("_mail"), "left")
    return out.withColumn(route, F.coalesce("_route", route)).withColumn("n_route_events", F.coalesce("n_route_events", F.lit(0))).drop("_mail", "_route")


def tombstones(queue: DataFrame, deleted: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(live rows, audit rows): deleted keys leave the queue and stay in the audit table."""
    gone = deleted.select(key).distinct()
    return queue.join(gone, key, "left_anti"), queue.join(gone, key, "left_semi")


def add_detail(details: DataFrame, added: DataFrame, key: list[str], projects: DataFrame, project: str) -> DataFrame:
    """Added rows with outcome rejected (their key is there already), warned (unknown project) or added."""
    there = details.select(*key).distinct().withColumn("_there", F.lit(True))
    known = projects.select(F.col(project)).distinct().withColumn("_known", F.lit(True))
    out = added.join(there, key, "left").join(known, project, "left")
    return out.withColumn("outcome", F.when(F.col("_there"), "rejected").when(F.col("_known").isNull(), "warned").otherwise("added")).drop("_there", "_known")


def fresh_lookup(results: DataFrame, now: Column, at: str, days: int, version: str, current: int, found: str, key: list[str] | None = None, n_orders: str | None = None) -> DataFrame:
    """Results younger than `days`; empty results of an older matcher version are invalid.

    With key and n_orders, collapsed rows go too: where a lookup says that it found several orders and only one row of it
    was kept, the detail of which order is lost, so it has to be asked again.
    """
    young = F.datediff(now.cast("date"), F.col(at).cast("date")) < days
    good = results.where(young & ~((F.col(version) < current) & (F.col(found) == 0)))
    if key is None or n_orders is None:
        return good
    lost = good.groupBy(*key).agg(F.max(n_orders).alias("_n"), F.count("*").alias("_rows")).where("_n > 1 and _rows < _n").select(*key)
    return good.join(lost, key, "left_anti")


def history_events(history: DataFrame, batch: DataFrame, mail: str, signature: str, at: str) -> DataFrame:
    """I16: the event table itself: the events of both tables, once for each mail and signature; the earlier row stays."""
    both = history.unionByName(batch.select(*history.columns))
    cols = both.columns
    return both.groupBy(F.col(mail).alias("_m"), F.col(signature).alias("_s")).agg(F.min_by(F.struct(*cols), F.struct(at, *[c for c in cols if c != at])).alias("_r")).select("_r.*")


def sync_history(history: DataFrame, batch: DataFrame, mail: str, signature: str, at: str) -> DataFrame:
    """I16: per mail the first and last time and the number of distinct events of both tables together."""
    both = history.select(mail, signature, at).unionByName(batch.select(mail, signature, at)).groupBy(mail, signature).agg(F.min(at).alias(at))
    return both.groupBy(mail).agg(F.min(at).alias("first_seen"), F.max(at).alias("last_seen"), F.count("*").alias("n_events"))


def replace_mails(rows: DataFrame, fresh: DataFrame, keys: DataFrame, mail: str, identity: list[str]) -> DataFrame:
    """The rows of the selected mails are replaced by the fresh ones; foreign or repeated fresh rows stop it."""
    allowed = keys.select(mail).distinct().withColumn("_ok", F.lit(True))
    checked = fresh.join(allowed, mail, "left").withColumn("_n", F.count("*").over(W.partitionBy(*identity)))
    bad = F.col("_ok").isNull() | (F.col("_n") > 1)
    checked = checked.where(F.when(bad, F.raise_error(F.lit("a foreign or repeated row"))).otherwise(F.lit(True))).drop("_ok", "_n")
    return rows.join(keys.select(mail).distinct(), mail, "left_anti").unionByName(checked.select(*rows.columns))


def reset_overlay(state: DataFrame, in_range: DataFrame, migrated: DataFrame, record: str) -> DataFrame:
    """The state without that of records in the range, except migrated ones."""
    gone = in_range.select(record).distinct().join(migrated.select(record).distinct(), record, "left_anti")
    return state.join(gone, record, "left_anti")


def item_state(items: DataFrame, owner: str, classes: tuple[str, ...], kind: str) -> DataFrame:
    """Per owner confirmed if all items are, partial if some, else pending; an unlisted class counts as blank."""
    ok = F.coalesce(F.col("confirmed"), F.lit(False)) & F.coalesce(F.col(kind).isin(*classes), F.lit(False))
    return items.groupBy(owner).agg(F.when(F.bool_and(ok), "confirmed").when(F.bool_or(ok), "partial").otherwise("pending").alias("item_status"), F.count("*").alias("n_items"))


def overlay_newest(auto: DataFrame, manual: DataFrame, key: str, at: str) -> DataFrame:
    """Per key the row checked last; a tie goes to manual; manual-only rows are appended. Adds origin."""
    cols = auto.columns
    a = auto.select(F.col(key).alias("_a"), F.struct(*cols).alias("_auto"))
    m = manual.select(F.col(key).alias("_m"), F.struct(*cols).alias("_manual"))
    both = a.join(m, F.col("_a") == F.col("_m"), "full")
    use = F.col("_m").isNotNull() & (F.col("_a").isNull() | F.coalesce(F.col(f"_manual.{at}") >= F.col(f"_auto.{at}"), F.col(f"_auto.{at}").isNull()))
    return both.select(F.when(use, F.col("_manual")).otherwise(F.col("_auto")).alias("_r"), F.when(use, "manual").otherwise("auto").alias("origin")).select("_r.*", "origin")


def backfill(details: DataFrame, results: DataFrame, key: list[str], fields: list[str]) -> DataFrame:
    """Results join by identity; a detail keeps its own value where the result has none."""
    got = results.select(*key, *[F.col(f).alias(f"_{f}") for f in fields])
    out = details.join(got, key, "left")
    return out.select(*[F.coalesce(f"_{c}", c).alias(c) if c in fields else F.col(c) for c in details.columns])


def alias_dedupe(active: DataFrame, filtered: DataFrame, aliases: list[str], seq: str, scope: str | None = None, project: str | None = None, rounds: int = 100) -> DataFrame:
    """Filtered rows no alias of which is in the active list, nor in an earlier filtered row that stays.

    Each row has several alias keys; blank ones match nothing, and a row without any stays. With scope and project, a
    row whose scope is `project` concerns only that project of its mail: it is compared with rows of the same project
    alone, by alias and project together, and never with whole mails, active ones included.

    A row that goes hides nobody. Rows are settled in rounds: one that is the first open row of all its aliases stays,
    and open rows that share an alias with it go. Most rows have aliases of their own and are settled in the first
    round; a chain of n rows, each sharing an alias with the next, takes n / 2. More than `rounds` is an error. seq is
    unique.
    """
    narrow = (F.coalesce(F.col(scope), F.lit("")) == "project") if scope else F.lit(False)
    tail = F.when(narrow, F.concat(F.lit("|project="), F.coalesce(F.col(project), F.lit("")))).otherwise("") if project else F.lit("")
    keys = lambda end: F.array_compact(F.array(*[F.when(blank_to_null(F.col(a)).isNotNull(), F.concat(F.lit(a + "="), F.col(a), end)) for a in aliases]))
    taken = active.select(F.explode(keys(F.lit(""))).alias("_alias")).distinct()
    each = filtered.select(F.col(seq).alias("_seq"), F.explode(keys(tail)).alias("_alias")).distinct()
    gone = cut(each.join(taken, "_alias", "left_semi").select("_seq").distinct())
    open_ = cut(each.join(gone, "_seq", "left_anti"))
    for _ in range(rounds):
        first = open_.groupBy("_alias").agg(F.min("_seq").alias("_first"))
        stays = open_.join(first, "_alias").groupBy("_seq").agg(F.bool_and(F.col("_seq") == F.col("_first")).alias("_all")).where("_all").select("_seq")
        held = open_.join(stays, "_seq", "left_semi").select("_alias").distinct()
        rest = open_.join(stays, "_seq", "left_anti")
        struck = cut(rest.join(held, "_alias", "left_semi").select("_seq").distinct())
        gone = cut(gone.union(struck))
        open_ = cut(rest.join(struck, "_seq", "left_anti"))
        if open_.isEmpty():
            return filtered.join(gone, filtered[seq] == F.col("_seq"), "left_anti")
    raise RuntimeError(f"aliases form chains that {rounds} rounds didn't settle")


def retry_mark(rows: DataFrame, queue: DataFrame, key: list[str]) -> DataFrame:
    """Adds retry, whether the row's key is in the queue."""
    return rows.join(queue.select(*key).distinct().withColumn("_q", F.lit(True)), key, "left").withColumn("retry", F.coalesce("_q", F.lit(False))).drop("_q")


def retry_ack(queue: DataFrame, results: DataFrame, key: list[str], status: str, definite: tuple[str, ...]) -> DataFrame:
    """The queue without entries that have a definite result."""
    return queue.join(results.where(F.col(status).isin(*definite)).select(*key).distinct(), key, "left_anti")


def migrate_state(old: DataFrame, new: DataFrame, mail: str, base: str, strong: str, weak: str, entry: str | None = None) -> DataFrame:
    """(mail, base, decision, to_base, downgraded) for each base of the old rows: what becomes of a reviewer's state.

    A base that is one row on both sides matches. The evidence is the same if both strong fingerprints are there and
    equal; if one is absent, the weak ones say so, weakly. `carry`: same base and same evidence. `draft`: same base,
    weakly the same; or a changed base, if the mail has exactly one old and one new row left over and these have the same
    strong evidence. `drop`: the evidence of a matched base changed. `left`: no row matches. `none`: entry, a flag of
    the old rows, says that there is no state. to_base is where a carried state or a draft goes. Old rows with a state
    that are left downgrade their whole mail, which turns what it carries into drafts.

    Rows are grouped by mail and base, then by mail; a mail's rows never meet in a list. Null keys match nothing.
    """
    def one(df: DataFrame, tag: str, *more) -> DataFrame:
        alone = F.when(F.count("*") == 1, F.max(strong)).alias(f"_{tag}_s")
        return df.groupBy(F.col(mail).alias(f"_{tag}_mail"), F.col(base).alias(f"_{tag}_base")).agg(F.count("*").alias(f"_{tag}_n"), alone, F.max(weak).alias(f"_{tag}_w"), *more)

    there = F.coalesce(F.bool_or(F.col(entry)), F.lit(False)) if entry else F.lit(True)
    both = one(old, "o", there.alias("_e")).join(one(new, "n"), (F.col("_o_mail") == F.col("_n_mail")) & (F.col("_o_base") == F.col("_n_base")), "full")
    both = both.withColumns({"_mail": F.coalesce("_o_mail", "_n_mail"), "_met": F.coalesce((F.col("_o_n") == 1) & (F.col("_n_n") == 1), F.lit(False))})
    rest = both.where(~F.col("_met")).groupBy("_mail").agg(
        *[F.sum(F.coalesce(f"_{t}_n", F.lit(0))).alias(f"_{t}_left") for t in "on"], F.max("_o_s").alias("_l_s"), F.max("_n_s").alias("_r_s"),
        F.max(F.when(F.col("_n_n") > 0, F.col("_n_base"))).alias("_to"), F.coalesce(F.bool_or(F.col("_e") & (F.col("_o_n") > 0)), F.lit(False)).alias("_state"),
    )
    changed = F.coalesce((F.col("_o_left") == 1) & (F.col("_n_left") == 1) & (F.col("_l_s") == F.col("_r_s")), F.lit(False))
    rest = rest.select("_mail", "_to", changed.alias("_changed"), (F.col("_state") & ~changed).alias("downgraded"))
    rows = both.where("_o_n > 0").join(rest, "_mail", "left").withColumn("downgraded", F.coalesce("downgraded", F.lit(False)))
    weakly = (F.col("_o_s").isNull() | F.col("_n_s").isNull()) & (F.col("_o_w") == F.col("_n_w"))
    decision = F.when(~F.col("_e"), "none").when(F.col("_met"), F.when(F.col("_o_s") == F.col("_n_s"), F.when(F.col("downgraded"), "draft").otherwise("carry")).when(weakly, "draft").otherwise("drop"))
    rows = rows.withColumn("decision", decision.when(F.col("_changed"), "draft").otherwise("left"))
    goes = F.when(F.col("decision").isin("carry", "draft"), F.when(F.col("_met"), F.col("_n_base")).otherwise(F.col("_to")))
    return rows.select(F.col("_o_mail").alias(mail), F.col("_o_base").alias(base), "decision", goes.alias("to_base"), "downgraded")


def multiset_except(left: DataFrame, right: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The left rows less as many copies of each key as the right side has, the first ones by order."""
    mine = left.withColumn("_no", F.row_number().over(W.partitionBy(*key).orderBy(*order)))
    theirs = right.groupBy(*key).agg(F.count("*").alias("_n"))
    return mine.join(theirs, key, "left").where(F.col("_no") > F.coalesce("_n", F.lit(0))).select(*left.columns)


def union_queues(*queues: DataFrame) -> DataFrame:
    """H1: one table of queues with different columns; absent ones are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), queues)


def prefer_fresh(fresh: DataFrame, stored: DataFrame, mail: str, company: str) -> DataFrame:
    """H2: per mail fresh rows if one has a company, else stored rows if one has, else fresh if any, else stored."""
    there = F.max(blank_to_null(F.col(company)).isNotNull().cast("int"))
    flags = fresh.groupBy(mail).agg(there.alias("_f")).join(stored.groupBy(mail).agg(there.alias("_s")), mail, "full")
    pick = F.when(F.col("_f") == 1, "fresh").when(F.col("_s") == 1, "stored").when(F.col("_f").isNotNull(), "fresh").otherwise("stored")
    chosen = flags.select(mail, pick.alias("origin"))
    rows = fresh.withColumn("origin", F.lit("fresh")).unionByName(stored.withColumn("origin", F.lit("stored")), allowMissingColumns=True)
    return rows.join(chosen, [mail, "origin"], "left_semi")


def field_changes(before: DataFrame, after: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """H4: (key, field, before, after), one row per changed field; null and blank are different values."""
    b = before.select(key, *[F.col(f).cast("string").alias(f"_{f}") for f in fields])
    both = b.join(after.select(key, *[F.col(f).cast("string").alias(f) for f in fields]), key)
    each = both.select(key, F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"_{f}").alias("before"), F.col(f).alias("after")) for f in fields])).alias("_c"))
    return each.select(key, "_c.*").where(~F.col("before").eqNullSafe(F.col("after")))


def last_event(events: DataFrame, record: str, order: list[str]) -> DataFrame:
    """the last event of each record by (at, signature)."""
    cols = [F.col(c) for c in events.columns]
    return events.groupBy(record).agg(F.max_by(F.struct(*cols), F.struct(*order)).alias("_e")).select("_e.*")


def keep_last(log: DataFrame, order: list[Column], most: int, per: list[str] | None = None) -> DataFrame:
    """the newest `most` rows, of the whole log or of each key."""
    if not per:
        return log.orderBy(*order).limit(most)
    return log.withColumn("_no", F.row_number().over(W.partitionBy(*per).orderBy(*order))).where(F.col("_no") <= most).drop("_no")
