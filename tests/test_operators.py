"""Fixtures and invariants of the operators, in our own data."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from tallyspark.operators import audit as A
from tallyspark.operators import ledger as L
from tallyspark.operators import match as M
from tallyspark.operators import resolve as R
from tallyspark.operators import rules
from tallyspark.operators import segments as S
from tallyspark.sources import cells as C
from tallyspark.sources import messages

D = datetime.date


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_interval_bounds(spark):
    work = spark.createDataFrame([("w", D(2026, 8, 26))], "k string, anchor date")
    days = [D(2026, 7, 26), D(2026, 9, 26), D(2026, 7, 25), D(2026, 9, 27), None]
    ledger = spark.createDataFrame([("w", d) for d in days], "k string, day date")
    out = M.candidate_counts(work, ledger, ["k"], "anchor", "day", 1).head()
    assert (out["n_in"], out["n_out"], out["n_unknown"]) == (2, 2, 1)
    assert out["nearest_tie"]
    assert M.reconcile(work, ledger.limit(0), ["k"], "anchor", "day").head()["status"] == "missing"
    assert M.reconcile(work.limit(0), ledger, ["k"], "anchor", "day").count() == 0


def test_item_bag(spark):
    kind = "owner string, brand string, kind string, pos int"
    claims = spark.createDataFrame([("o", "a", "1", 1), ("o", "a", "1", 2), ("o", "b", "2", 3), ("o", "", "2", 4)], kind)
    there = spark.createDataFrame([("o", "a", "1", 1), ("o", "c", "2", 2), ("p", "b", "2", 1)], kind)
    out = M.item_outcome(M.match_items(claims, there, "owner", [["brand", "kind"]], ["pos"]), "owner")
    assert rows(out, "owner", "n_matched", "n_missing", "n_pending", "n_extra") == [("o", 1, 2, 1, 1), ("p", 0, 0, 0, 1)]


def test_downgrade(spark):
    gone = spark.createDataFrame([("a", "x", "project"), ("b", "x", "project"), ("b", "y", "project")], "mail string, project string, scope string")
    alive = spark.createDataFrame([("a",)], "mail string")
    assert rows(rules.downgrade_orphans(gone, alive, "mail"), "mail", "scope") == [("a", "project"), ("b", ""), ("b", "")]
    assert rules.downgrade_orphans(gone.limit(0), alive, "mail").count() == 0


def test_upsert_twice_is_once(spark):
    batch = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    empty = batch.limit(0).withColumns({"first_seen": F.lit(None).cast("timestamp"), "updated_at": F.lit(None).cast("timestamp")})
    first = L.upsert(empty, batch, "k", F.lit("2026-01-01").cast("timestamp"))
    again = L.upsert(first.drop("change"), batch, "k", F.lit("2026-02-01").cast("timestamp"))
    assert rows(first, "k", "v", "first_seen") == rows(again, "k", "v", "first_seen")
    assert {r["change"] for r in again.collect()} == {"updated"}


def test_replace_range(spark):
    old = spark.createDataFrame([("a", D(2026, 1, 1)), ("b", D(2026, 1, 2))], "k string, day date")
    new = spark.createDataFrame([("c", D(2026, 1, 1))], "k string, day date")
    low = F.lit("2026-01-01").cast("date")
    version, archive, days = L.replace_range(old, new, "day", low, low)
    assert rows(version, "k") == [("b",), ("c",)]
    assert rows(archive, "k") == [("a",)]
    again, _, _ = L.replace_range(version, new, "day", low, low)
    assert rows(again, "k") == rows(version, "k")
    nothing, _, days = L.replace_range(old, new.limit(0), "day", low, low)
    assert rows(nothing, "k") == [("b",)]
    assert rows(L.drop_refreshed(new, days, "day"), "k") == []
    with pytest.raises(Exception, match="outside the range"):
        L.replace_range(old, old, "day", low, low)[0].collect()


def test_fold_reset(spark):
    kind = "record_id long, seq long, at timestamp, action string, fields map<string,string>"
    now = datetime.datetime(2026, 1, 1)
    events = [(1, 1, now, "edit", {"agent": "x"}), (1, 2, now, "reset", None), (1, 3, now, "edit", {"company": "c"}), (1, 4, now, "confirm", None), (2, 1, now, "confirm", None), (2, 2, now, "reset", None), (3, 1, now, "agent_confirm", {"agent": " "})]
    out = L.fold_reviews(spark.createDataFrame(events, kind))
    assert sorted((r["record_id"], r["status"], r["fields"], r["n_events"]) for r in out.collect()) == [(1, "confirmed", {"company": "c"}, 2), (3, "review", {"agent": " "}, 1)]


def test_stream_fold_agrees():
    from tallyspark.streaming.ledger_stream import fold_one

    state = (None, {}, 0)
    for action, given in (("edit", {"agent": "x"}), ("reset", None), ("edit", {"company": "c"}), ("confirm", None)):
        state = fold_one(*state, action, given)
    assert state == ("confirmed", {"company": "c"}, 2)


def test_scan_range(spark):
    t = datetime.datetime
    kind = "id int, header timestamp, arrival timestamp"
    data = [(1, t(2026, 1, 2), t(2026, 5, 1)), (2, t(2026, 5, 1), t(2026, 1, 2)), (3, None, t(2026, 1, 31)), (4, None, None)]
    df = spark.createDataFrame(data, kind)
    low, high = F.lit("2026-01-01").cast("date"), F.lit("2026-01-31").cast("date")
    assert rows(messages.scan_range(df, "header", "arrival", low, high), "id") == [(1,), (3,)]
    assert tuple(messages.range_metrics(df, "header", "arrival", low, high).head()) == (1, 1, 1, 1)


def test_incomplete_is_not_published(spark):
    df = spark.range(3)
    assert messages.require_complete(df, 3, F.lit(False)).count() == 3
    with pytest.raises(Exception, match="incomplete"):
        messages.require_complete(df, 4, F.lit(False)).collect()


def test_sections_and_labels(spark):
    kind = "file string, sheet string, row_no int, col_no int, value string"
    sheet = [["Brand", "Category"], ["a", "1"], ["Total", "9"], ["Category", "Brand"], ["2", "b"], ["Phone: 123", ""], ["Name", "", "Ann"]]
    cells = spark.createDataFrame([("f", "s", r, c, v) for r, row in enumerate(sheet, 1) for c, v in enumerate(row, 1)], kind)
    roles = spark.createDataFrame([("brand", "brand"), ("category", "category")], "label string, role string")
    out = C.sectioned_records(cells.where("row_no < 6"), roles, (("brand", "category"),))
    assert rows(out, "row_no", "role", "value") == [(2, "brand", "a"), (2, "category", "1"), (5, "brand", "b"), (5, "category", "2")]
    labels = spark.createDataFrame([("phone", "phone"), ("name", "name")], "label string, field string")
    assert rows(C.label_values(cells, labels), "field", "value") == [("name", "Ann"), ("phone", "123")]


def test_alias_precedence(spark):
    aliases = spark.createDataFrame([("acme", ["A"]), ("acme sea", ["B", "C"]), ("zed", ["Z"])], "alias string, officials array<string>")
    df = spark.createDataFrame([(1, "order from acme sea now"), (2, "the big bezed zed"), (3, "nothing")], "id int, t string")
    assert rows(R.match_alias(df, "t", ["id"], aliases), "id", "alias", "ambiguous") == [(1, "acme sea", True), (2, "zed", False)]


def test_segments_carry(spark):
    kind = "mail int, no int, company string, country string, service string"
    data = [(1, 1, None, "de", "x"), (1, 2, "c", None, None), (1, 3, None, "fr", "w"), (1, 4, None, None, "p"), (1, 5, "d", None, "w")]
    out = S.group_segments(spark.createDataFrame(data, kind), "mail", "no", F.col("company"), F.col("country"), F.col("service"))
    assert [tuple(r) for r in out.orderBy("no").select("no", "company", "country").collect()] == [(3, "c", "fr"), (4, "c", "fr"), (5, "d", None)]


@pytest.mark.parametrize("text, size, want", [("class 3 item", None, ("matched", "3")), ("red thing", None, ("matched", "1")), ("none", None, ("unmatched", "")), ("none", "60 cm", ("matched", "4")), ("none", "50 cm", ("matched", "5")), ("bolt", "500 mm", ("matched", "6")), ("small blue gear", None, ("unmatched", "")), ("ring bolt", None, ("ambiguous", ""))])
def test_classify(spark, text, size, want):
    terms = [("1", "red", False), ("2", "blue gear", False), ("2", "small", True), ("3", "ring", False), ("6", "bolt", False)]
    dictionary = spark.createDataFrame(terms, "class string, term string, is_exclusion boolean")
    df = spark.createDataFrame([(1, text, size)], "id int, t string, s string")
    out = A.classify_category(df, ["id"], "t", "s", dictionary).head()
    assert (out["status"], out["category_class"]) == want


def test_every_message_in_one_list(spark):
    df = spark.createDataFrame([(i, q) for i, q in enumerate(["work", "review", "filtered", None, "work"])], "id int, queue string")
    parts = messages.split_stage1(df, "queue")
    assert sorted(r["id"] for p in parts.values() for r in p.collect()) == [0, 1, 2, 3, 4]


def test_rule_projects_finds_every_pair(spark):
    countries = spark.createDataFrame([("DE", "Germany"), ("FR", "France"), ("PL", "Poland"), ("PL", "pl"), ("NL", "Netherlands"), ("IT", "it"), ("X", "old"), ("Y", "cold")], "name string, alias string")
    services = spark.createDataFrame([("W", "WEEE"), ("W", "eee"), ("P", "packaging"), ("B", "battery")], "name string, alias string")
    texts = {
        "Germany WEEE, France WEEE": "DE W,FR W", "Poland  Netherlands packaging": "NL P,PL P", "Germany and France WEEE": "DE W,FR W", "IT battery & WEEE": "IT B,IT W",
        "WEEE Germany; packaging\nFrance": "DE W,FR P", "packaging with it: split, plain WEEE": "IT P,IT W", "split plain packaging": "", "Germany, France WEEE + packaging": "DE W,FR P,FR W",
        "cold WEEE": "Y W", "Germany needs WEEE": "DE W", "Germany" + " x" * 20 + " WEEE": "", "packaging of Poland": "PL P", "WEEE": "", "": "", "pl-WEEE": "PL W", "Poland WEEE. Poland WEEE": "PL W",
    }
    df = spark.createDataFrame([(t,) for t in texts] + [(None,)], "t string").withColumn("id", F.col("t"))
    got = {t: [] for t in texts}
    for r in A.rule_projects(df, "id", "t", countries, services).collect():
        got[r["id"]].append(f"{r['country']} {r['service']}")
    assert {t: ",".join(sorted(v)) for t, v in got.items()} == texts


def test_work_rows_that_share_a_key(spark):
    kind = "id int, k string, anchor date"
    work = spark.createDataFrame([(1, "w", D(2026, 3, 1)), (2, "w", D(2026, 3, 1)), (3, "w", D(2026, 6, 1)), (4, "w", None), (5, None, D(2026, 3, 1)), (6, "x", D(2026, 3, 1))], kind)
    ledger = spark.createDataFrame([("w", D(2026, 2, 27), 1), ("w", D(2026, 3, 3), 2), ("w", D(2026, 6, 2), 3), ("w", None, 4), (None, D(2026, 3, 1), 5)], "k string, day date, no int")
    out = rows(M.candidate_counts(work.drop("id"), ledger, ["k"], "anchor", "day", 1).na.fill("none", ["k"]).withColumn("anchor", F.coalesce(F.col("anchor").cast("string"), F.lit(""))), "k", "anchor", "n_in", "n_out", "n_unknown")
    assert out == [("none", "2026-03-01", 0, 0, 0), ("w", "", 0, 0, 4), ("w", "2026-03-01", 2, 1, 1), ("w", "2026-03-01", 2, 1, 1), ("w", "2026-06-01", 1, 2, 1), ("x", "2026-03-01", 0, 0, 0)]
    near = M.nearest_candidate(work, ledger, ["k"], "anchor", "day", ["no"])
    assert rows(near, "id", "no", "days", "tie") == [(1, 1, 2, True), (2, 1, 2, True), (3, 3, 1, False)]


def test_numbers_and_sums_over_ranges(spark):
    import random

    from tallyspark.operators import numbering

    rng = random.Random(3)
    data = [(i, rng.choice([None, rng.randrange(50)]), rng.randrange(9)) for i in range(500)]
    df = spark.createDataFrame(data, "id int, v int, n int").repartition(7)
    order = [F.col("v").desc_nulls_last(), F.col("id")]
    want = sorted(data, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))
    got = sorted(numbering.numbered(df, order, "no").collect(), key=lambda r: r["no"])
    assert [(r["id"], r["no"]) for r in got] == [(r[0], i) for i, r in enumerate(want, 1)]
    sums = {r["id"]: r["before"] for r in numbering.running(df, order, {"before": F.col("n")}).collect()}
    total = 0
    for i, _, n in want:
        assert sums[i] == total
        total += n
    assert numbering.numbered(df.limit(0), order, "no").count() == 0 and numbering.running(df.limit(0), order, {"x": F.col("n")}).count() == 0


def common(a, b):
    line = [0] * (len(b) + 1)
    for x in a:
        fresh = [0]
        for j, y in enumerate(b, 1):
            fresh.append(line[j - 1] + 1 if x == y else max(line[j], fresh[-1]))
        line = fresh
    return line[-1]


@pytest.mark.parametrize("least", [60, 80, 95])
def test_blocked_pairs_lose_nothing(spark, least):
    import random

    rng = random.Random(least)
    base = ["".join(rng.choices("abcde", k=rng.randint(1, 14))) for _ in range(25)]
    texts = set(base)
    for text in base:
        for _ in range(3):
            at = rng.randrange(len(text) + 1)
            texts.add(rng.choice([text[:at] + rng.choice("abcde") + text[at:], text[:at] + text[at + 1 :]]))
    texts = sorted(texts - {""})
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    pairs = {(r["a"], r["b"]) for r in R.blocked_pairs(df, df, "t", "t", least).collect()}
    reach = {(a, b) for a in texts for b in texts if 200 * common(a, b) // (len(a) + len(b)) >= least}
    assert reach <= pairs and len(pairs) < 0.6 * len(texts) ** 2


def test_model_projects_against_plain_python(spark):
    names, projects = ["x", "germany weee", "weee", "battery law", "packaging", "pack", "ab"], ["xyz", "Germany WEEE", "Battery", "packagin g", "y", "zzab"]
    plain = lambda t: t.lower().replace(" ", "")
    ratio = lambda a, b: 200 * common(a, b) // (len(a) + len(b))

    def score(a, b):
        short, long = sorted((a, b), key=len)
        part = max(ratio(short, long[i : i + len(short)]) for i in range(len(long) - len(short) + 1))
        return max(ratio(a, b), part, 95 if a in b or b in a else 0)

    want = []
    for a in map(plain, names):
        best = max((score(a, b), b) for b in map(plain, projects))
        if best[0] >= 88:
            want.append((a, *best[::-1]))
    out = R.match_model_projects(spark.createDataFrame([(n,) for n in names], "a string"), spark.createDataFrame([(p,) for p in projects], "b string"), "a", "b")
    assert rows(out, "a", "b", "score") == sorted(want)
    assert ("x", "xyz", 100) in want


def test_versions_by_attempt(spark, tmp_path):
    from tallyspark.streaming import ledger_stream as S

    path = str(tmp_path / "ledger")
    one = spark.createDataFrame([(i, i) for i in range(200)], "k long, v long")
    stamp = F.lit("2026-01-01").cast("timestamp")

    def put(batch, df):
        touched = [r["b"] for r in df.select(S.bucket_of("k").alias("b")).distinct().collect()]
        old = S.snapshot(spark, path, df, batch, touched).select(*df.columns, "first_seen", "updated_at")
        S.publish(spark, path, batch, "k", L.upsert(old, df, "k", stamp).drop("change"), touched)

    put(0, one)
    two = spark.createDataFrame([(1, 100), (500, 5)], "k long, v long")
    put(1, two)
    before = S.current(spark, path)
    put(1, two)  # the same batch again reads batch 0 and writes a folder of its own
    after = S.current(spark, path)
    assert sum(before[b] != after[b] for b in after) <= 2 and len(after) == len(before)
    want = {i: i for i in range(200)} | {1: 100, 500: 5}
    assert {r["k"]: r["v"] for r in S.snapshot(spark, path, one).collect()} == want
    assert S.current(spark, str(tmp_path / "none")) == {}


def test_identities_are_needed(spark):
    kind = "seq int, sender string, sent string, subject string, company string, project string, found string, match_status string, note string, record_id string"
    good = (1, "s", "d", "t", "c", "p", "yes", "", "", None)
    none = spark.createDataFrame([good], kind)
    overlay = none.limit(0).select(*L.IDENTITY, "found", "match_status", "note", F.lit(None).cast("timestamp").alias("checked_at"), F.lit("").alias("detail_key"), *[F.lit(None).cast("timestamp").alias(c) for c in ("first_seen", "updated_at")])
    stamp = F.lit("2026-01-01").cast("timestamp")
    assert L.record_manual_outcome(overlay, none, stamp)[0].head()["match_status"] == "found by hand"
    for bad in ((1, " ", *good[2:]), (*good[:6], "maybe", *good[7:])):
        with pytest.raises(Exception, match="needed|yes, no or review"):
            L.record_manual_outcome(overlay, spark.createDataFrame([bad], kind), stamp)[0].collect()
    queue = spark.createDataFrame([("a", 1, "asked")], "k string, at int, status string")
    with pytest.raises(Exception, match="whole identity"):
        L.enqueue_retry(queue, spark.createDataFrame([(None, 2)], "k string, at int"), ["k"], "at").collect()
    assert rows(L.enqueue_retry(queue, spark.createDataFrame([("a", 2), ("a", 3), ("b", 1)], "k string, at int"), ["k"], "at"), "k", "at", "status") == [("a", 3, "pending"), ("b", 1, "pending")]


def test_meetings_are_few(spark):
    """Candidates on part names: at least ten times fewer than by any shared pair of letters."""
    df = spark.read.parquet("/root/testdata/sf0.001/part.parquet").select(F.concat("p_name", F.lit(" "), "p_brand").alias("t")).distinct()
    pairs = lambda c: F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - 1), lambda i: F.substr(c, i, F.lit(2))))
    old = df.select(F.explode(pairs("t")).alias("g")).groupBy("g").count().agg(F.sum(F.col("count") * F.col("count"))).head()[0]
    x, y = R.ranked_letters(df, df)
    tokens = F.size("tokens")
    prefix = F.slice("tokens", F.lit(1), tokens - R.needed(tokens, F.ceil(tokens * 90 / 110), 90) + 1)
    met = R.meetings(x.withColumn("prefix", prefix), y.withColumn("prefix", prefix)).count()
    kept = R.blocked_pairs(df, df, "t", "t", 90).count()
    print("rows that meet:", old, "by pairs of letters,", met, "by prefixes,", kept, "after the bounds")
    assert met * 10 < old


def migrated(old, new):
    """D20 for one mail in plain Python: old rows (base, strong, weak, entry), new rows (base, strong, weak)."""
    same = lambda a, b: ("strong" if a[1] == b[1] else "changed") if a[1] is not None and b[1] is not None else "weak" if a[2] is not None and a[2] == b[2] else "changed"
    left, right, out = list(range(len(old))), list(range(len(new))), {}
    for base in {r[0] for r in old}:
        a, b = [i for i, r in enumerate(old) if r[0] == base], [i for i, r in enumerate(new) if r[0] == base]
        if len(a) == len(b) == 1:
            left.remove(a[0])
            right.remove(b[0])
            out[a[0]] = ({"strong": "carry", "weak": "draft", "changed": "drop"}[same(old[a[0]], new[b[0]])], base)
    if len(left) == len(right) == 1 and same(old[left[0]], new[right[0]]) == "strong":
        out[left.pop()] = ("draft", new[right.pop()][0])
    down = any(old[i][3] for i in left)
    rows = set()
    for i, r in enumerate(old):
        decision, to = out.get(i, ("left", None))
        bases = [x[3] for x in old if x[0] == r[0]]
        decision = "none" if not any(bases) else "draft" if decision == "carry" and down else decision
        rows.add((r[0], decision, to if decision in ("carry", "draft") else None, down))
    return rows


def test_migrate_state_against_plain_python(spark):
    rng = random.Random(23)
    evidence = lambda: (rng.choice([None, 1, 2, 3]), rng.choice([None, 7, 8]))
    old = [(mail, rng.choice("ABCD"), *evidence(), rng.random() < 0.8) for mail in range(600) for _ in range(rng.choice([1, 1, 2, 3]))]
    new = []
    for mail, base, s, w, _ in old:
        if rng.random() < 0.85:
            s, w = (s, w) if rng.random() < 0.7 else evidence()
            new.append((mail, base if rng.random() < 0.75 else rng.choice("ABCDEF"), s, w))
    # A base that stands twice has no strong evidence of its own, on either side.
    out = L.migrate_state(spark.createDataFrame(old, "mail int, base string, s int, w int, held boolean"), spark.createDataFrame(new, "mail int, base string, s int, w int"), "mail", "base", "s", "w", "held")
    got = {(r["mail"], r["base"], r["decision"], r["to_base"], r["downgraded"]) for r in out.collect()}
    want = {(m, *row) for m in range(600) for row in migrated([r[1:] for r in old if r[0] == m], [r[1:] for r in new if r[0] == m])}
    assert got == want
    assert {d for _, _, d, _, _ in got} == {"carry", "draft", "drop", "left", "none"}
    assert any(d == "draft" and to not in (b, None) for _, b, d, to, _ in got)


def test_resolve_agents_against_plain_python(spark):
    from tallyspark.functions.similarity import ratio

    rng = random.Random(29)
    listed = [("ann@north.org", "North"), ("bob@north.org", "North"), ("cy@south.org", "South"), ("sea@mail.com", "Sea"), ("info@eastern.org", "East"), ("inf0@eastern.org", "East"), ("info@western.org", "West")]
    names = [("northy", ["North"]), ("southy", ["South"]), ("both", ["North", "South"])]
    senders = [e for e, _ in listed] + ["new@north.org", "x@south.org", "cyy@south.org", "info@easter.org", "info@estern.org", "sae@mail.com", "", None, "nobody@nowhere.net", "ann@north.orgs"]
    subjects = ["", None, "northy order", "southy order", "all: both things", "plain"]
    bodies = ["", None, "mail cy@south.org or ann@north.org", "text\n\nregards\nnorthy", "x info@unknown.org"]
    mails = [(i, rng.choice(senders), rng.choice(subjects), rng.choice(bodies)) for i in range(900)]
    agents, owners = dict(listed), {"north.org": "North", "south.org": "South", "eastern.org": "East", "western.org": "West"}

    def want(sender, subject, body):
        sender, subject, body = sender or "", subject or "", body or ""
        if sender in agents:
            return agents[sender], "exact", ()
        officials = next((o for a, o in names if a in subject), None)
        owner = owners.get(sender.rpartition("@")[2])
        if officials:
            if owner and owner not in officials:
                return None, "conflict", tuple(officials)
            if len(officials) == 1 or owner:
                return owner or officials[0], "subject", ()
            return None, "ambiguous", tuple(officials)
        if "cy@south.org" in body:
            return "South", "body", ()
        if "northy" in body:
            return "North", "signature", ()
        near = sorted((-ratio(sender, e), e) for e, _ in listed if sender and ratio(sender, e) >= 80)
        if len(near) == 1 and -near[0][0] >= 90:
            return agents[near[0][1]], "fuzzy", ()
        return None, "fuzzy_unsure" if near else "none", tuple(dict.fromkeys(agents[e] for _, e in near))

    directory, aliases = spark.createDataFrame(listed, "email string, agent string"), spark.createDataFrame(names, "alias string, officials array<string>")
    df = spark.createDataFrame(mails, "id int, sender string, subject string, body string")
    got = {r["id"]: (r["agent"], r["method"], tuple(r["candidates"])) for r in R.resolve_agents(df, "id", "sender", "subject", "body", directory, aliases, ["mail.com"]).collect()}
    assert got == {i: want(*rest) for i, *rest in mails}
    assert {m for _, m, _ in got.values()} == {"exact", "conflict", "subject", "ambiguous", "body", "signature", "fuzzy", "fuzzy_unsure", "none"}


def test_alias_dedupe_is_the_running_search(spark):
    rng = random.Random(6)
    rows_ = [(i, *(rng.choice([None, " ", *[f"{c}{rng.randrange(60)}" for _ in range(4)]]) for c in "xyz")) for i in range(300)]
    rows_ += [(1000 + i, f"chain{i}", f"chain{i + 1}", None) for i in range(40)]  # each shares an alias with the next
    active = [("x1", "y2", None), (None, "y9", " ")]
    taken, want = {(n, v) for r in active for n, v in zip("abc", r) if v and v.strip()}, []
    rows_ = [(i, a, b if i < 1000 else None, c) if i < 1000 else (i, a, None, None) for i, a, b, c in rows_[:300]] + [(i, f"k{i // 2}", f"m{(i + 1) // 2}", None) for i in range(1000, 1040)]
    for i, *r in rows_:
        keys = {(n, v) for n, v in zip("abc", r) if v and v.strip()}
        if not keys & taken:
            want.append(i)
            taken |= keys
    kind = "a string, b string, c string"
    out = L.alias_dedupe(spark.createDataFrame(active, kind), spark.createDataFrame(rows_, f"n int, {kind}").repartition(4), ["a", "b", "c"], "n")
    assert sorted(r["n"] for r in out.collect()) == want
    with pytest.raises(RuntimeError, match="chains"):
        L.alias_dedupe(spark.createDataFrame([], kind), spark.createDataFrame(rows_[300:], f"n int, {kind}"), ["a", "b", "c"], "n", rounds=3)


def test_items_in_order(spark):
    rng = random.Random(14)
    make = lambda n: [(o, i, rng.choice(["a", "b", None]), rng.choice(["1", "2", "3", ""]), rng.choice(["s", "t", None])) for o in range(120) for i in range(rng.randrange(n))]
    claims, registered = make(6), make(6)
    # The first claim takes the only item that the second one could have, and could do with another.
    claims += [(119, 90, "z", "1", "s"), (119, 91, "z", "1", None)]
    registered += [(119, 90, "z", "1", None), (119, 91, "z", "9", "s")]
    keys = [["brand", "cls"], ["brand", "text"]]
    value = lambda r: [None if not r[2] or not x else (r[2], x) for x in (r[3], r[4])]
    kind = "owner int, pos int, brand string, cls string, text string"
    frames = spark.createDataFrame(claims, kind), spark.createDataFrame(registered, kind)
    want, most = {}, {}
    for o in range(120):
        mine, theirs = [r for r in claims if r[0] == o], [r for r in registered if r[0] == o]
        free = list(range(len(theirs)))
        for r in mine:
            tags = value(r)
            hit = next((j for j in free if any(t is not None and t == u for t, u in zip(tags, value(theirs[j])))), None)
            if hit is not None:
                free.remove(hit)
            want[o, r[1]] = "pending" if tags == [None, None] else "missing" if hit is None else "matched"
        holder = {}

        def grow(i, seen):
            for j, r in enumerate(theirs):
                if j not in seen and any(t is not None and t == u for t, u in zip(value(mine[i]), value(r))):
                    seen.add(j)
                    if j not in holder or grow(holder[j], seen):
                        holder[j] = i
                        return True
            return False

        most[o] = sum(grow(i, set()) for i in range(len(mine)))
    got = M.match_items_in_order(*frames, "owner", keys, ["pos"])
    assert {(r["owner"], r["pos"]): r["outcome"] for r in got.where("side = 'claim'").collect()} == want
    pairs = got.where("outcome = 'matched'").groupBy("owner", "side").count().groupBy("owner").agg(F.min("count").alias("a"), F.max("count").alias("b"))
    assert pairs.where("a != b").count() == 0
    largest = M.match_items_in_order(*frames, "owner", keys, ["pos"], largest=True).where("side = 'claim' AND outcome = 'matched'")
    counts = {r["owner"]: r["count"] for r in largest.groupBy("owner").count().collect()}
    assert counts == {o: n for o, n in most.items() if n} and sum(counts.values()) > sum(v == "matched" for v in want.values())
    passes = M.match_items_in_order(*frames, "owner", keys, ["pos"], most=0)
    assert passes.count() == got.count() and passes.where("partner IS NOT NULL").count() == 0


def test_notes_of_a_hot_key(spark):
    """Thousands of candidates of one key: their distinct days and fields are joined, not the rows."""
    work = spark.createDataFrame([(1, "k", datetime.date(2026, 5, 10), "A", "Sea Ltd", "P"), (2, "k", None, "A", "Sea Ltd", "P"), (3, "none", None, None, None, None)], "id int, k string, at date, agent string, company string, project string")
    ledger = spark.range(5000).select(F.lit("k").alias("k"), F.date_add(F.lit(datetime.date(2026, 5, 1)), (F.col("id") % 5).cast("int")).alias("d"), F.lit("A").alias("agent"), F.lit("Other").alias("company"), F.lit("P").alias("project"))
    out = {r["id"]: (r["status"], r["n"], r["note"]) for r in M.reconcile_notes(work, ledger, ["k"], ["id"], "at", "d").collect()}
    assert out[1] == ("review", 5000, "5000 records; the nearest is 5 days away (tied); none agrees in all fields")
    assert out[2] == ("review", 5000, "5000 records; none has a date; none agrees in all fields") and out[3] == ("missing", 0, "")


def test_applicant_chains(spark):
    rng = random.Random(3)
    kind = "file string, sheet int, name string, priority int, lang string"
    given = []
    for n in range(40):
        for sheet in range(rng.randrange(1, 9)):
            given.append((f"f{n}" if n else None, sheet, f"Sea {rng.randrange(9)}", 1, "own"))
            if rng.random() < 0.7:
                given.append((f"f{n}" if n else None, sheet, f"sea-{rng.randrange(9)}", 1, "en"))
    given += [("long", i, f"N {i}", 1, "own") for i in range(50)] + [("long", i, f"N {i + 1}", 1, "en") for i in range(49)]
    given += given[:5] + [("f1", 90, " ", 1, "own"), ("f1", 91, None, 2, "en")]
    expected = {}
    for file, sheet, name, _, _ in set(given):
        if (name or "").strip():
            expected.setdefault(file, []).append((sheet, name.lower().replace(" ", "").replace("-", "")))
    groups = set()
    for file, pairs in expected.items():
        sheets = {s: {k for t, k in pairs if t == s} for s, _ in pairs}
        while sheets:
            first = min(sheets)
            members, keys = {first}, sheets.pop(first)
            while near := [s for s in sheets if sheets[s] & keys]:
                for s in near:
                    members.add(s)
                    keys = keys | sheets.pop(s)
            groups.add((file, tuple(sorted(members))))
    df = spark.createDataFrame(given, kind)
    out = A.bind_applicants(df, "file", "sheet", "name", "priority", "lang").collect()
    assert len(out) == len(groups) and {(r["file"], tuple(r["sheets"])) for r in out} == groups
    assert ("long", tuple(range(50))) in groups
    assert A.bind_applicants(df.limit(0), "file", "sheet", "name", "priority", "lang").count() == 0
