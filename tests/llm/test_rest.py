import collections
import hashlib
import random
import re
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyspark.llm import bpe, common, kd_search, mixing, pii, toxicity, url_filters
from tallyspark.llm.queries import RULES, tokenizer


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 460)] + [(500, i) for i in range(501, 560)] + [(7, None)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if b is not None and a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    df = spark.createDataFrame(edges, "u long, v long")
    got = {r["node"]: r["root"] for r in common.components(df).collect()}
    assert got == {n: find(n) for n in list(root)}
    assert common.components(df.limit(0)).count() == 0


def test_url_filters(spark):
    link = '<link rel="canonical" href="{}">'
    jump = '<meta http-equiv="refresh" content="0; url={}">'
    pages = [
        (1, "http://m.a.example.org/es/1?x#y", None), (2, "https://b.example.net/x", link.format("http://c.example.org/es/9")), (3, "https://d.example.net/y", jump.format("https://b.example.net/x/")),
        (4, "http://e.example.com/fr/3", link.format("https://b.example.net/x")), (5, None, link.format("x")), (6, "no scheme", ""), (7, "http://F.Example.COM/de/", ""), (8, "http://example.org/en/12", ""), (9, "http://example.org/en/2", ""),
        (10, "http://g.example.net/p", link.format("/q")), (11, "http://g.example.net/q", "nothing"), (11, "http://g.example.net/q", "nothing"), (12, "http://h.example.net?x", None),
    ]
    rules = spark.createDataFrame(RULES, "host string, path string, action string")
    df = spark.createDataFrame([(*p, "z", 1) for p in pages], "page_id long, url string, html string, rule string, node int")
    out = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filters.judge(df, rules).collect()}
    assert url_filters.judge(df, rules).count() == len(pages)
    assert out[1] == ("m.a.example.org", "/es/1", "example.org/es/", "block")
    assert out[4] == ("e.example.com", "/fr/3", "com/fr/", "allow")
    assert out[2][2:] == (None, "allow") and out[3][2:] == (None, "allow")  # their class holds an explicit allow
    assert out[5] == ("", "", None, "allow") and out[6] == ("", "", None, "allow")
    assert out[7] == ("f.example.com", "/de/", "com/de/", "block")
    assert out[8][2:] == ("example.org/en/1", "block") and out[9][2:] == ("org/", "allow")
    assert out[12] == ("h.example.net", "", None, "allow")
    out = {r["page_id"]: r["verdict"] for r in url_filters.judge(df.where("page_id != 4"), rules).collect()}
    assert out[2] == out[3] == "block" and out[10] == out[11] == "allow"
    assert url_filters.judge(df.limit(0), rules).count() == 0


def test_blocks_spread_over_edges_only(spark):
    rng = random.Random(31)
    hosts = ["x.example.org", "y.example.net", "www.y.example.net", "z.example.com"]
    urls = sorted({f"http{rng.choice(['', 's'])}://{rng.choice(hosts)}{rng.choice(['/es/', '/de/', '/fr/', '/p', '/q', '/q'])}{rng.choice(['', rng.randrange(90)])}{rng.choice(['', '', '/', '?ref=1', '?ref=2', '#f'])}" for _ in range(500)})
    html = ['<link rel=canonical href="{}">', '<meta http-equiv="refresh" content="0;url={}">', "canonical {}"]
    pages = [(i, u, rng.choice(html).format(rng.choice(urls)) if rng.random() < 0.5 else None) for i, u in enumerate(urls)]

    def key(u):
        host, _, rest = u.split("://")[1].split("#")[0].partition("/")
        path, mark, query = rest.partition("?")
        return host + ("/" + path).rstrip("/") + mark + query

    def rule(u):
        host, _, path = u.split("://")[1].split("?")[0].split("#")[0].partition("/")
        fits = [(len(h + p), a == "allow", a) for h, p, a in RULES if ("." + host).endswith("." + h) and ("/" + path).startswith(p)]
        return max(fits)[2] if fits else None

    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for _, u, h in pages:
        if h and not h.startswith("canonical"):
            target = re.search(r"https?://[^\">]+", h)[0]
            root[find(key(u))] = find(key(target))
    groups, linked = collections.defaultdict(set), collections.Counter(find(x) for x in list(root))
    for u in urls:
        if rule(u) and key(u) in root and linked[find(key(u))] > 1:
            groups[find(key(u))].add(rule(u))
    want = {i: rule(u) or ("block" if key(u) in root and groups[find(key(u))] == {"block"} else "allow") for i, u, _ in pages}
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(5)
    got = {r["page_id"]: r["verdict"] for r in url_filters.judge(df, spark.createDataFrame(RULES, "host string, path string, action string")).collect()}
    assert got == want
    assert sum(v == "block" and rule(urls[i]) is None for i, v in got.items()) > 5


def test_loose_address_keys(spark):
    urls = [("http://www.a.b/x/?utm_s=1&c=2&b=1#f", "a.b/x?b=1&c=2", "www.a.b/x?utm_s=1&c=2&b=1"), ("https://M.a.b", "a.b", "m.a.b"), ("x", None, None), (None, None, None)]
    df = spark.createDataFrame(urls, "u string, loose string, plain string")
    u = F.col("u")
    assert df.where(~url_filters.address_key(u, True).eqNullSafe(F.col("loose")) | ~url_filters.address_key(u).eqNullSafe(F.col("plain"))).count() == 0


def test_url_sql_agrees_on_links(spark):
    import duckdb
    import pandas as pd

    from tallyspark.llm.queries import OP1_SQL

    rng = random.Random(12)
    hosts = ["a.example.org", "b.example.net", "c.example.com", "m.b.example.net"]
    paths = ["/es/1", "/en/1", "/en/2", "/de/3", "/fr/4", "/x", "/x/", "", "/y?ref=1&b=2", "/y?b=2#t"]
    urls = [f"http{rng.choice(['', 's'])}://{rng.choice(hosts)}{rng.choice(paths)}" for _ in range(20)] + [f"http://h{i}.example.net/z" for i in range(40)] + ["http://q.example.com/de/1", None, "plain"]
    link = lambda: rng.choice([None, None, "", '<link rel="canonical" href="{}">', '<meta http-equiv=refresh content="1;url={}">'])
    pages = [(i, u, h.format(rng.choice([rng.choice(urls) or "", "/es/1", "rel", "//b.example.net/x"])) if (h := link()) else h) for i, u in enumerate(urls)]
    frame = pd.DataFrame(pages, columns=["page_id", "url", "html"]).astype({"url": "string", "html": "string"})  # noqa: F841
    con = duckdb.connect()
    con.register("pages", frame)
    want = con.execute(OP1_SQL)
    names = [c[0] for c in want.description]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    out = url_filters.judge(df, spark.createDataFrame(RULES, "host string, path string, action string"))
    assert sorted(map(repr, (tuple(r[n] for n in names) for r in out.collect()))) == sorted(map(repr, want.fetchall()))
    assert out.where("blocked_with is not null and verdict = 'block' and rule is null").count() > 0


def brute_top(vectors, k, asks=lambda i: i % 50 == 0):
    """Sorted rows (query_id, ((vec_id, score), ...)) for a list of (vec_id, whole numbers)."""
    width = max(len(v) for _, v in vectors)
    table = [[*v, *[0] * (width - len(v))] for _, v in vectors]
    out = []
    for q, (query, _) in enumerate(vectors):
        if asks(query):
            scores = sorted((-sum(a * b for a, b in zip(table[q], table[i])), vec) for i, (vec, _) in enumerate(vectors) if i != q)[:k]
            out.append((query, tuple((vec, -s) for s, vec in scores)))
    return sorted(out)


def answers(rows, k):
    """The rows of a result as brute_top() gives them; repeated queries can't be told apart, so they must agree."""
    found = collections.defaultdict(lambda: collections.defaultdict(list))
    for r in rows:
        found[r["query_id"]][r["rank"]].append((r["vec_id"], r["score"]))
    return {q: {rank: sorted(v) for rank, v in ranks.items()} for q, ranks in found.items()}


def expected(brute):
    found = collections.defaultdict(lambda: collections.defaultdict(list))
    for q, best in brute:
        for rank, pair in enumerate(best, 1):
            found[q][rank].append(pair)
    return {q: {rank: sorted(v) for rank, v in ranks.items()} for q, ranks in found.items()}


@pytest.mark.parametrize("shard", [8192, 60, 7])
def test_top_k(spark, shard):
    rng = np.random.default_rng(4)
    data = [(int(i), [float(x) for x in rng.normal(size=6)]) for i in range(300)] + [(300, [0.5] * 6), (301, [0.5] * 6), (302, [0.5] * 6)]
    data += [(i, [1.5] * 6) for i in range(400, 430)] + [(450, []), (451, [2.0])] + [(7, [5.0, 5.0]), (50, [0.25] * 6), (50, data[50][1]), data[0]]
    bad = [(1000, None), (1050, [float("nan")] * 6), (1100, [None, 1.0]), (1150, [float("inf")] * 6), (None, [1.0] * 6)]
    df = spark.createDataFrame([(*d, 1, 2) for d in data + bad], "vec_id long, embedding array<float>, shard int, query int").repartition(5)
    whole = [(i, [int(np.floor(256 * float(np.float32(x)))) for x in v]) for i, v in data]
    got = kd_search.top_k(df, F.col("vec_id") % 50 == 0, shard=shard, sent=3).collect()
    assert answers(got, 5) == expected(brute_top(whole, 5))
    assert kd_search.top_k(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_top_k_visits_only_cells_in_reach(spark):
    rng = np.random.default_rng(5)
    centre = rng.normal(size=(16, 4)) * 20
    data = [(i, [float(x) for x in centre[i % 16] + rng.normal(size=4)]) for i in range(800)]
    low, high, numbers = [], [], []
    table = np.floor(256 * np.array([v for _, v in data]))
    nodes = kd_search.top_splits(table, 16)
    cell = kd_search.cells_of(table, nodes)
    assert len(set(cell)) == 16 and max(collections.Counter(cell.tolist()).values()) <= 60
    for c in sorted(set(cell)):
        numbers.append(c)
        low.append(table[cell == c].min(axis=0))
        high.append(table[cell == c].max(axis=0))
    scores = table @ table.T
    floors = np.sort(np.where(cell[:, None] == cell[None, :], scores, -np.inf), axis=1)[:, -6]
    seen = kd_search.reach(table, np.array(low), np.array(high)) >= floors[:, None]
    assert seen.mean() < 0.7
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    got = kd_search.top_k(df, F.col("vec_id") % 50 == 0, shard=50, sent=4).collect()
    assert answers(got, 5) == expected(brute_top([(i, [int(x) for x in row]) for i, row in enumerate(table)], 5))


def test_top_k_large_numbers(spark):
    df = spark.createDataFrame([(0, [3e7, 1.0]), (1, [3e7, 2.0]), (2, [3e7, 3.0]), (3, [])], "vec_id long, embedding array<double>")
    got = [(r["vec_id"], r["score"]) for r in kd_search.top_k(df, F.col("vec_id") == 0, k=3).orderBy("rank").collect()]
    big = (256 * 30_000_000) ** 2
    exact = [(2, big + 3 * 256 * 256), (1, big + 2 * 256 * 256), (3, 0)]
    most = 2**63 - 1
    assert got == sorted(((i, min(s, most)) for i, s in exact), key=lambda x: (-x[1], x[0]))


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer())


def test_bpe_agrees_with_the_library(library):
    rng, ours = random.Random(2), bpe.load(tokenizer())
    letters = list("abcdefg  \n\t'stremd019!?.é中　\x85\x1c\x1f\x00\xa0ß😀٣²") + ["<|endoftext|>"]
    for _ in range(3000):
        text = "".join(rng.choices(letters, k=rng.randint(0, 40)))
        ids = library.encode(text, add_special_tokens=False).ids
        assert ours.encode(text) == ids, text
        assert ours.decode(ids) == library.decode(ids, skip_special_tokens=False) == text


@pytest.mark.parametrize("text", ["a" * 5000, " " * 5000, "!" * 4000 + "a", "ab" * 3000])
def test_bpe_long_pieces(library, text):
    assert bpe.load(tokenizer()).encode(text) == library.encode(text, add_special_tokens=False).ids


def test_bpe_frames(odd, nothing, library):
    rows = bpe.digests(odd, tokenizer()).collect()
    want = collections.Counter()
    for d in odd.collect():
        ids = library.encode(d["text"] or "", add_special_tokens=False).ids
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        want[d["doc_id"], len(ids), sha(",".join(map(str, ids))), sha(d["text"] or "")] += 1
    assert collections.Counter(tuple(r) for r in rows) == want
    assert bpe.digests(nothing, tokenizer()).count() == 0
    back = bpe.decoded(bpe.encoded(odd, tokenizer()), tokenizer())
    assert sorted(r["text"] for r in back.collect()) == sorted(d["text"] or "" for d in odd.collect())
    known = library.encode("two words", add_special_tokens=False).ids
    strange = odd.sparkSession.createDataFrame([(1, [-1, *known, 10**9, None]), (2, [-7]), (3, [])], "doc_id long, ids array<int>")
    assert sorted(tuple(r) for r in bpe.decoded(strange, tokenizer()).collect()) == [(1, "two words"), (2, ""), (3, "")]


def test_rank_tree_gives_the_leftmost_lowest():
    rng = random.Random(1)
    for n in (1, 2, 5, 16, 33):
        keys = [rng.randrange(6) * 64 + i for i in range(n)]
        tree = bpe.RankTree(list(keys))
        for _ in range(50):
            at = rng.randrange(n)
            keys[at] = rng.choice([bpe.NONE, rng.randrange(6) * 64 + at])
            tree.put(at, keys[at])
            assert tree.tree[1] == min(keys)


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(9)
    vocabulary = [f"{a}{b}{c}" for a in "bdfgk" for b in "aeio" for c in ("ran", "lem", "tos")]
    docs, labels = [], []
    for i in range(900):
        words = rng.choices(vocabulary, k=rng.randint(20, 80))
        low, bad = i % 5 == 0, i % 7 == 0
        if low:
            words[3:6] = ["lorem", "junk", "spam"]
        if bad:
            words[7] = rng.choice(["wretch", "wretchen", "fiend"])
        docs.append((i, " ".join(words)))
        if i % 3:
            labels.append((i, 0 if low else 1, int(bad)))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels + [(5000, 1, None), (None, 1, 1), labels[0]], "doc_id long, quality int, toxic int")


def test_toxicity_on_held_out(labelled):
    docs, labels = labelled
    chain = toxicity.fit(docs, labels)
    assert chain.names == ["low_quality", "toxic"] and len(chain.links[1]) == 1
    rows = toxicity.score(docs, chain).where("doc_id % 3 = 0").collect()
    right = sum(r["toxic"] == (r["doc_id"] % 7 == 0) for r in rows)
    assert right >= 0.97 * len(rows)
    assert sum((r["p_low_quality"] >= 0.5) == (r["doc_id"] % 5 == 0) for r in rows) >= 0.97 * len(rows)
    again = toxicity.fit(docs.repartition(3), labels)
    assert np.allclose(chain.weights, again.weights)


def plain_model(sets, extra, y, min_docs, min_z, steps=200):
    """A link of the chain by plain loops: (weight of each word, weights of the extras, constant)."""
    n, share = len(sets), sum(y) / len(sets)
    seen, inside = collections.Counter(w for s in sets for w in s), collections.Counter(w for s, v in zip(sets, y) if v for w in s)
    error = lambda k: max(k * share * (1 - share) * (1 - k / n), 1e-9) ** 0.5
    good = sorted(w for w, k in seen.items() if k >= min_docs and 0 < share < 1 and abs(inside[w] - k * share) / error(k) >= min_z)
    rows = [{**{w: 1.0 for w in good if w in s}, **{("extra", i): x for i, x in enumerate(e)}, "one": 1.0} for s, e in zip(sets, extra)]
    names = [*good, *[("extra", i) for i in range(len(extra[0]))], "one"]
    theta, m, v = dict.fromkeys(names, 0.0), dict.fromkeys(names, 0.0), dict.fromkeys(names, 0.0)
    theta["one"] = np.log((sum(y) + 1) / (n - sum(y) + 1))
    for step in range(1, steps + 1):
        slope = {name: 0.5 * theta[name] if name != "one" else 0.0 for name in names}
        for row, label in zip(rows, y):
            off = 1 / (1 + np.exp(-sum(theta[k] * x for k, x in row.items()))) - label
            for k, x in row.items():
                slope[k] += off * x
        for k in names:
            g = slope[k] / n
            m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.99 * v[k] + 0.01 * g * g
            theta[k] -= 0.1 * (m[k] / (1 - 0.9**step)) / ((v[k] / (1 - 0.99**step)) ** 0.5 + 1e-8)
    return theta


def plain_logit(theta, words, extra):
    return theta["one"] + sum(theta.get(w, 0.0) for w in words) + sum(theta["extra", i] * x for i, x in enumerate(extra))


def test_toxicity_recall_and_precision(spark):
    """The chain, fitted on four fifths of the driver's labels, on the other fifth."""
    folder = "/root/testdata/sf0.1"
    if not Path(folder).exists():
        pytest.skip("no driver tables here")
    docs, labels = (spark.read.parquet(f"{folder}/{name}.parquet") for name in ("documents", "labels"))
    kept = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    chain = toxicity.fit(docs, labels.where(~kept))
    found = toxicity.score(docs, chain).join(labels.where(kept & F.col("toxic").isNotNull()).select("doc_id", F.col("toxic").alias("truth")), "doc_id")
    n = {(r["truth"], r["toxic"]): r["count"] for r in found.groupBy("truth", "toxic").count().collect()}
    caught, missed, wrong = n.get((1, True), 0), n.get((1, False), 0), n.get((0, True), 0)
    print(f"toxicity on held-out labels: recall {caught / (caught + missed):.3f} of {caught + missed}, precision {caught / (caught + wrong):.3f}, clean left alone {n.get((0, False), 0) / (n.get((0, False), 0) + wrong):.4f}")
    assert caught >= 0.85 * (caught + missed) and wrong <= 0.01 * n.get((0, False), 0)


def test_toxicity_agrees_with_plain_loops(spark, labelled):
    docs, labels = labelled
    docs, labels = docs.where("doc_id < 120"), labels.where("doc_id < 120")
    chain = toxicity.fit(docs, labels, min_z=2.0)
    known = {r["doc_id"]: (int(r["quality"] == 0), r["toxic"]) for r in labels.where("toxic is not null and doc_id is not null").collect()}
    ids = sorted(known)
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    sets = [toxicity.words(text[i]) for i in ids]
    none = [()] * len(ids)
    first = plain_model(sets, none, [known[i][0] for i in ids], 3, 2.0)
    clip = lambda z: min(max(z, -8), 8)
    seen = [()] * len(ids)
    for f in range(toxicity.FOLDS):
        inside = [p for p in range(len(ids)) if p % toxicity.FOLDS != f]
        part = plain_model([sets[p] for p in inside], [()] * len(inside), [known[ids[p]][0] for p in inside], 3, 2.0)
        for p in range(f, len(ids), toxicity.FOLDS):
            seen[p] = (clip(plain_logit(part, sets[p], ())),)
    second = plain_model(sets, seen, [known[i][1] for i in ids], 3, 2.0)
    for r in toxicity.score(docs, chain).collect():
        low = plain_logit(first, toxicity.words(text[r["doc_id"]]), ())
        bad = plain_logit(second, toxicity.words(text[r["doc_id"]]), (clip(low),))
        assert abs(r["p_low_quality"] - 1 / (1 + np.exp(-low))) < 1e-6 and abs(r["p_toxic"] - 1 / (1 + np.exp(-bad))) < 1e-6
        assert r["toxic"] == (bad >= 0)


def test_out_of_fold_rows_shape_nothing():
    rng = np.random.default_rng(2)
    n, width = 60, 30
    at, of = rng.integers(0, width, 400), np.sort(rng.integers(0, n, 400))
    y = (rng.random(n) < 0.4).astype(float)
    before = toxicity._out_of_fold(at, of, n, width, np.zeros((n, 0)), y, 1, 1.0, 4)
    for fold in range(4):
        other = y.copy()
        other[fold::4] = 1 - other[fold::4]
        after = toxicity._out_of_fold(at, of, n, width, np.zeros((n, 0)), other, 1, 1.0, 4)
        assert np.allclose(before[fold::4], after[fold::4]) and not np.allclose(before, after)


def test_toxicity_odd(odd, nothing, labelled):
    docs, labels = labelled
    chain = toxicity.fit(docs, labels)
    assert toxicity.score(odd, chain).count() == odd.count()
    assert toxicity.score(nothing, chain).count() == 0
    kept = toxicity.keep_clean(odd, chain)
    assert kept.columns == odd.columns and sorted(map(str, kept.collect())) == sorted(map(str, odd.collect()))
    blank = toxicity.fit(docs, labels.limit(0))
    assert toxicity.score(odd, blank).count() == odd.count()


def fill(sizes, share=1.5, most=2.0):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    target = dict.fromkeys(names, 0.0)
    left, open_ = share * sum(sizes.values()), set(names)
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > most * sizes[s]}
        if not over:
            return target | {s: level * weight[s] for s in open_}
        for s in over:
            target[s] = most * sizes[s]
            left -= target[s]
        open_ -= over
    return target


@pytest.mark.parametrize("buckets", [1, 64])
def test_mixing(spark, buckets):
    rng = random.Random(8)
    data = [(i, " ".join("w" for _ in range(rng.randint(0, 60))), rng.choice(["b", "a", "a", "a", "a", "é", None, "z"])) for i in range(600)] + [(601, None, "none"), (602, " ", "a")]
    docs = spark.createDataFrame([(*d, 1, 2) for d in data], "doc_id long, text string, source string, size int, key int")
    quality = spark.createDataFrame([(i, i % 2) for i in range(0, 600, 3)] + [(None, 1), (0, 1)], "doc_id long, quality int")
    rows = mixing.mix(docs, quality, buckets=buckets).collect()
    assert len(rows) == len(data)
    sizes, taken = collections.Counter(), collections.Counter()
    for i, t, s in data:
        sizes[s] += len((t or "").split())
    goal = fill(sizes)
    for r in rows:
        assert r["source_size"] == sizes[r["source"]] and abs(r["target"] - goal[r["source"]]) < 1e-6
        assert r["taken"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
    for s in sizes:
        assert abs(taken[s] - goal[s]) <= 60
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix(docs.repartition(7), quality, buckets=9).collect()))
    assert mixing.mix(docs.limit(0), quality).count() == 0


def test_mixing_rows(odd, nothing):
    plan = {(r["doc_id"], r["size"]): 0 for r in mixing.mix(odd).collect()}
    for r in mixing.mix(odd).collect():
        plan[r["doc_id"], r["size"]] += r["copies"]
    out = mixing.apply(odd)
    assert out.columns == odd.columns
    assert out.count() == sum(plan.values())
    assert mixing.apply(nothing).count() == 0


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(number):
    values = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(number))]
    return sum(v - 9 if v > 9 else v for v in values) % 10 == 0


def base(text):
    out = []
    for rank, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text):
            n = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".") if p), "card": 12 <= len(n) <= 19 and luhn(n), "phone": 9 <= len(n) <= 15}[kind]
            if good:
                out.append((m.start(), rank, f"{kind}:{m.start()}:{m.end()}"))
    return [s for _, _, s in sorted(out)]


def test_pii_base(spark, odd, nothing):
    rng = random.Random(6)
    bits = ["a@b.co", "a.b%c@d-e.f.gh", "@", ".", "x@y", "1.2.3.4", "256.1.1.1", "001.02.3.4.5", "4111 1111 1111 1111", "4111111111111112", "5500-0000-0000-0004", "+1 (988) 555-2485", "+49 30 12", "😀é", " ", " ", ",", "123", "-", "a@b.c_d@e.fg", "0" * 30 + "1.1.1.1", "12 "]
    texts = ["".join(rng.choices(bits, k=rng.randint(0, 14))) for _ in range(400)] + ["a." * 3000 + "a@" + "b." * 3000 + "c", "9" * 5000, "+1" + "-" * 3000 + "2", "x" * 50_000, None, ""]
    df = spark.createDataFrame([(i, t, "k", 3) for i, t in enumerate(texts)], "doc_id long, text string, base string, near int").repartition(4)
    for r in pii.detect(df).collect():
        want = base(texts[r["doc_id"]] or "")
        got = [s for s in r["spans"].split(",") if s and not s.startswith("context")]
        assert got == want, texts[r["doc_id"]][:200]
        assert r["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert [r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]] == [sum(s.startswith(k) for s in want) for k in PATTERNS]
    assert pii.detect(odd).count() == odd.count()
    assert pii.detect(nothing).count() == 0


def test_pii_addresses_with_zero_parts(spark):
    rng = random.Random(13)
    parts = ["0", "00", "000", "0" * 40, "1", "10", "010", "255", "256", "0255", "0256", "99", "100"]
    texts = ["10.0.0.1", "0.0.0.0", "00.1.2.3", "at 192.168.0.5, 127.0.0.1"] + [" ".join(".".join(rng.choices(parts, k=rng.randint(3, 5))) for _ in range(6)) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in pii.detect(df).collect():
        want = base(texts[r["doc_id"]])
        assert [s for s in r["spans"].split(",") if s and not s.startswith("context")] == want, texts[r["doc_id"]]
        assert r["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest()


def test_pii_bootstraps_contexts(spark):
    known = [(i, f"please write to user{i}@mail.org today") for i in range(8)]
    fresh = [(20, "please write to user77(at)mail or please write to acct-99182 today"), (21, "he paid 12345 for it"), (22, "we write code 12345 here")]
    df = spark.createDataFrame(known + fresh, "doc_id long, text string")
    out = {r["doc_id"]: r["spans"] for r in pii.detect(df).collect()}
    text = fresh[0][1]
    at = text.index("acct-99182")
    assert f"context:{at}:{at + 10}" in out[20].split(",")
    assert out[21] == "" and out[22] == ""
    assert all(s.startswith("email:") and "," not in s for i, s in out.items() if i < 8)


def test_pii_contexts_at_line_starts_and_overlaps(spark):
    texts = ["id acct-99182\nplease write to user1@mail.org or acct-7\n\tx9 (y8) call me +1 (988) 555-2485 now", "w" * 60 + " at  " + "v1" * 50 + ". Anna anna@mail.org", "7", "", "none here"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = df.select("doc_id", F.explode(pii.near(F.col("text"))).alias("x")).select("doc_id", "x.*").collect()
    assert all(texts[r["doc_id"]][r["start"] : r["end"]] == r["value"] for r in rows)
    want = [(0, "\n id", "acct-99182"), (0, "write to", "user1@mail.org"), (0, "user0@mail.org or", "acct-7"), (0, "\n \n", "x9"), (0, "\n x0", "y8"), (0, "call me", "+1"), (0, "me +0", "988"), (0, "+0 (000)", "555-2485")]
    want += [(1, "w" * 60 + " at", "v1" * 50), (1, f"{'v0' * 50}. anna", "anna@mail.org"), (2, "\n \n", "7")]
    assert sorted((r["doc_id"], r["pattern"], r["value"]) for r in rows) == sorted(want)


def test_pii_bootstraps_over_several_hops(spark):
    texts = [f"please write to user{i}@mail.org today" for i in range(30)]
    texts += [f"please write to acct-{i} today" for i in range(900, 905)]
    texts += [f"account no acct-{i} is open" for i in range(900, 905)] + ["account no key-77 is open"]
    texts += [f"holder\nref acct-{i} is open" for i in range(900, 905)] + ["holder\nref zed-1 is open"]
    texts += ["ring me +1 (988) 555-2485"] + ["he paid 12345 for it"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {r["doc_id"]: r["spans"] for r in pii.detect(df).collect()}
    for i, text in enumerate(texts):
        values = re.findall(r"(?:acct|key|zed)-[0-9]+", text)
        got = [text[int(a) : int(b)] for kind, a, b in (s.split(":") for s in out[i].split(",") if s) if kind == "context"]
        assert got == values, text
    assert out[len(texts) - 1] == ""


def plain_near(text):
    """Every candidate of a text as (start, end, value, pattern), by plain loops."""
    out = []
    if not re.search("[0-9@]", text):
        return out
    for lacks, pattern in enumerate(pii.CONTEXTS):
        for m in re.finditer(pattern, text, re.A):
            words = re.split(r"[ \t]+", m[1])
            value = re.sub(r"^[\"'(<\[{]+", "", words[-1])
            end = m.end() - 1 + len(m[1])
            before = re.sub("[0-9]", "0", " ".join(["\n"] * lacks + words[: 2 - lacks]).lower())
            out.append((end - len(value), end, value, hashlib.md5(before.encode()).hexdigest() if len(before) > 200 else before))
    return out


def plain_patterns(graph):
    """Good patterns of a set of (pattern, value, known)."""
    known = collections.defaultdict(bool)
    for _, value, k in graph:
        known[value] |= k
    edges = {(p, v) for p, v, _ in graph}
    by_pattern = collections.defaultdict(set)
    for p, v in edges:
        by_pattern[p].add(v)
    while True:
        score = {v: float(k) for v, k in known.items()}
        for last in (False, True):
            found = {}
            for p, values in by_pattern.items():
                support = sum(known[v] for v in values)
                if support:
                    found[p] = (sum(score[v] for v in values) / len(values) * support / (support + 1), support)
            if not last:
                doubt = collections.Counter()
                for p, v in edges:
                    if p in found:
                        doubt[v] += np.log(1 - min(found[p][0], 0.999))
                score = {v: 1.0 if known[v] else 1 - np.exp(doubt[v]) for v in known}
        good = {p for p, (confidence, support) in found.items() if confidence >= 0.7 and support >= 3}
        fresh = {v for p in good for v in by_pattern[p] if not known[v]}
        if not fresh:
            return good
        known.update(dict.fromkeys(fresh, True))


def plain_spans(texts):
    bases, each = {}, []
    for i, text in texts.items():
        bases[i] = [(int(a), int(b), kind) for kind, a, b in (s.split(":") for s in base(text))]
        for start, end, value, pattern in plain_near(text):
            if any(a < start < b for a, b, _ in bases[i]):
                continue
            over = [b for a, b, _ in bases[i] if a < end and b > start]
            each.append((i, start, end, text[start : max(over)] if over and max(over) > end else value, pattern, bool(over)))
    good = plain_patterns({(p, v, k) for _, _, _, v, p, k in each})
    rank = [*PATTERNS, "context"]
    out = {}
    for i in texts:
        added = {(start, end, "context") for j, start, end, _, p, k in each if j == i and not k and p in good}
        spans = sorted([*bases[i], *added], key=lambda s: (s[0], rank.index(s[2]), s[1]))
        out[i] = ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_pii_contexts_against_plain_python(spark, seed):
    rng = random.Random(seed)
    leads = ["write to", "call me", "account no", "id", "paid", "ref", "see (page", "émail à"]
    values = ["user{}@mail.org", "+1 (988) 555-24{:02d}", "10.0.{}.0", "acct-{}", "key_{}", "{}", "\"x{}\"", "4111 1111 1111 1111"]
    own = {lead: rng.sample(values, 2) for lead in leads}
    texts = {}
    for i in range(160):
        parts = []
        for _ in range(rng.randint(0, 5)):
            lead = rng.choice(leads)
            value = rng.choice(own[lead] if rng.random() < 0.9 else values).format(rng.randrange(12))
            parts.append(f"{lead}{rng.choice([' ', '  ', chr(9)])}{value}{rng.choice([' ', chr(10), ', then ', '. Or '])}")
        texts[i] = "".join(parts)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r["spans"] for r in pii.detect(df).collect()}
    want = plain_spans(texts)
    assert got == want
    assert sum(s.count("context") for s in want.values()) > 20
