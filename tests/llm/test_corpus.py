"""Language-model scores, source divergence and token alignment against plain Python."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallyspark.llm import lm_scoring, queries, source_audit, token_align

END = b" "


def words(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower()) + [END]


def docs_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3)


@pytest.fixture(scope="module")
def prose(spark):
    rng = random.Random(41)
    vocab = [f"w{i}" for i in range(60)] + ["É", "x\x1cy", "A"]
    texts = [" ".join(rng.choice(vocab) + rng.choice(["", "", "\t", " "]) for _ in range(rng.choice([0, 1, 5, 40, 400]))) for _ in range(250)]
    return [(i, t) for i, t in enumerate(texts)] + [(300, None), (301, ""), (302, " \n"), (303, "w1 " * 50_000), (5, "another text with id 5"), (304, "never seen words")]


def counted(rows, order):
    grams = collections.Counter()
    for _, text in rows:
        tokens = words(text)
        grams.update(tuple(tokens[i : i + n]) for n in range(1, order + 1) for i in range(len(tokens) - n + 1))
    return grams


@pytest.mark.parametrize("order", [1, 2, 3])
def test_lm_scores(spark, prose, order, monkeypatch):
    """Every column against plain Python, whose counts are the levels of a filter with room enough for no errors."""
    monkeypatch.setattr(lm_scoring, "SEGMENT", 20_000)
    train = [r for r in prose if zlib.crc32(str(r[0]).encode()) % 7 != 2]
    grams = counted(train, order)
    total, types = sum(c for g, c in grams.items() if len(g) == 1), sum(len(g) == 1 for g in grams)
    least, middle = lm_scoring.thresholds().tolist(), lm_scoring.estimates().tolist()
    level = lambda g: sum(t <= grams[g] for t in least) if g in grams else 0

    def expected(text):
        tokens, out = words(text), 0.0
        for i in range(len(tokens)):
            p, below = (middle[level((tokens[i],))] + 1) / (total + types + 1), level((tokens[i],))
            for n in range(2, min(order, i + 1) + 1):
                gram = tuple(tokens[i - n + 1 : i + 1])
                h = level(gram[:-1])
                below = min(level(gram), h, below)
                if h:
                    p = (min(middle[below], middle[h]) + lm_scoring.PRIOR * p) / (middle[h] + lm_scoring.PRIOR)
            out += math.log10(p)
        return out

    model = lm_scoring.train(docs_of(spark, train), order=order, bits=400)
    assert (model.tokens, model.types) == (total, types) and (model.segments > 1) == (order > 1 or total > 20_000)
    rows = lm_scoring.score(docs_of(spark, prose), model).collect()
    assert len(rows) == len(prose)
    want = collections.defaultdict(list)
    for i, text in prose:
        tokens = words(text)
        base = sum(math.log10((grams[(t,)] + 1) / (total + types + 1)) for t in tokens)
        want[i].append((len(tokens), sum((t,) in grams for t in tokens), total, base, expected(text)))
    wrong = 0
    for r in rows:
        near = min(want[r["doc_id"]], key=lambda w: abs(w[0] - r["n_tokens"]))
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == near[:3]
        assert math.isclose(r["base_score"], near[3], rel_tol=1e-9)
        wrong += not math.isclose(r["score"], near[4], rel_tol=1e-9)
        assert abs(r["score"] - near[4]) <= 0.1 * near[0]
    assert wrong <= len(rows) // 100
    asked = {(r["doc_id"], r["n_tokens"]): r["score"] for r in lm_scoring.score(docs_of(spark, prose), model, broadcast=0).collect()}
    assert asked == {(r["doc_id"], r["n_tokens"]): r["score"] for r in rows}


def test_lm_parts_of_texts(prose):
    """Chunks of a few bytes, long texts in several parts: the same words as in plain Python."""
    texts = [(t or "").encode() if i % 2 else t and t.encode() for i, t in prose] + [b"x" * 40, b" " * 30, b"a " * 30]
    batch = pa.record_batch([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.binary())], ["doc_id", "text"])
    for size in (1, 7, 100, 1 << 20):
        seen = {}
        for chunk in lm_scoring.chunks(iter([batch.slice(3), batch.slice(0, 3), batch.slice(0, 0)]), size):
            for row, at, n in zip(chunk.rows.to_pylist(), chunk.starts, chunk.lengths):
                seen[row] = [chunk.listed[k] for k in chunk.ids[at : at + n]]
        assert seen == {i: words((t or b"").decode()) for i, t in enumerate(texts)}


def test_lm_remembered_levels(monkeypatch):
    """What a task remembers of an n-gram is what the filter tells, also where many n-grams share a slot."""
    monkeypatch.setattr(lm_scoring, "RECENT", 1 << 16)
    rng = np.random.default_rng(5)
    grams = rng.integers(0, 1 << 63, 200_000, dtype=np.uint64)
    _, data = lm_scoring.segment([np.repeat(grams, rng.integers(0, 9, len(grams))).tobytes()], [])
    held = lm_scoring.Filter.of(data, np.array([len(data) // 8]))
    most = rng.integers(0, 6, len(grams)).astype(np.uint8)
    recent = lm_scoring.Recent(held)
    for _ in range(20):
        at = rng.integers(0, rng.choice([50, 5_000, len(grams)]), 30_000)
        assert (recent.levels(2, grams[at], most[at]) == held.levels(grams[at], most[at])).all()


def test_lm_rare_tokens_are_not_sorted(spark, prose, monkeypatch):
    """Occurrences of rare tokens meet the counts in a hash table; frequent and rare tokens give the same numbers."""
    model = lm_scoring.train(docs_of(spark, prose))
    out = lm_scoring.score(docs_of(spark, prose), model)
    assert "ShuffledHashJoin [token" in out._jdf.queryExecution().toString()
    row = lambda df: sorted((r["doc_id"], r["n_tokens"], r["n_known"], round(r["base_score"], 6), r["score"]) for r in df.collect())
    monkeypatch.setattr(lm_scoring, "HOT", 1)
    assert row(lm_scoring.score(docs_of(spark, prose), model)) == row(out)
    few = lm_scoring.by_segments(docs_of(spark, prose), model, 1_000).select("doc_id", "n_tokens", "score").collect()
    assert sorted(map(tuple, few)) == sorted((r[0], r[1], r[4]) for r in row(out))


def test_lm_filter_never_loses_a_count():
    rng = np.random.default_rng(3)
    grams = np.unique(rng.integers(0, 1 << 63, 30_000, dtype=np.uint64))
    counts = np.maximum(1, (rng.pareto(0.7, len(grams))).astype(np.uint64))
    many = counts > 1
    entries, data = lm_scoring.segment([grams[~many].tobytes()], [grams[many].tobytes() + counts[many].tobytes(), b""])
    held = lm_scoring.Filter.of(data, np.array([len(data) // 8]))
    levels = np.searchsorted(lm_scoring.thresholds(), counts, "right")
    got = held.levels(grams)
    assert entries == levels.sum() and (got >= levels).all() and (got > levels).mean() < 0.05
    assert (held.levels(rng.integers(0, 1 << 63, 30_000, dtype=np.uint64)) > 0).mean() < 0.05
    assert (held.levels(grams, np.full(len(grams), 2, np.uint8)) == np.minimum(got, 2)).all()
    assert len(lm_scoring.Filter.of(b"", np.array([0])).levels(grams)) == len(grams)


def test_lm_predicts_held_out_text(spark):
    """Words that follow each other: with contexts the model must do better than with single words on texts that it has
    not seen."""
    rng = random.Random(8)
    after = {w: [f"t{(w * 7 + k) % 40}" for k in (1, 2)] for w in range(40)}

    def text():
        at, out = rng.randrange(40), []
        for _ in range(60):
            word = rng.choice(after[at])
            out.append(word)
            at = int(word[1:])
        return " ".join(out)

    model = lm_scoring.train(docs_of(spark, [(i, text()) for i in range(200)]))
    row = lm_scoring.score(docs_of(spark, [(i, text()) for i in range(50)]), model).agg(F.sum("score").alias("s"), F.sum("base_score").alias("b"), F.sum("n_tokens").alias("n")).head()
    print("log10 of a held-out token:", row["s"] / row["n"], "without contexts", row["b"] / row["n"])
    assert row["s"] / row["n"] > row["b"] / row["n"] + 0.8


def test_lm_odd_rows(spark, odd, nothing):
    model = lm_scoring.train(odd)
    rows = lm_scoring.score(odd, model).collect()
    assert len(rows) == odd.count() and all(r["n_tokens"] >= 1 and r["n_known"] == r["n_tokens"] for r in rows)
    assert lm_scoring.score(nothing, model).count() == 0
    empty = lm_scoring.train(nothing)
    assert (empty.tokens, empty.types, empty.size) == (0, 0, 0)
    for way in ({}, {"broadcast": 0}):
        got = {r["doc_id"]: r for r in lm_scoring.score(odd.where("doc_id in (1, 2)"), empty, **way).collect()}
        assert (got[1]["n_known"], got[1]["base_score"], got[1]["score"]) == (0, 0.0, 0.0) and got[2]["n_tokens"] == 1
    flags = {r["doc_id"]: r["h"] for r in spark.createDataFrame([(i,) for i in range(60)] + [(None,)], "doc_id long").select("doc_id", lm_scoring.held_out(F.col("doc_id")).alias("h")).collect()}
    assert flags == {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in range(60)} | {None: False}


def audited(rows, min_docs, top):
    """The audit in plain Python: rows (doc_id, text, lang, source)."""
    per, docs, groups = collections.Counter(), collections.Counter(), collections.defaultdict(set)
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups[lang].add(source)
        terms = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]
        per.update((lang, source, t) for t in terms)
        docs.update((lang, t) for t in set(terms))
    out = set()
    for lang, sources in groups.items():
        kept = [t for (x, t), n in docs.items() if x == lang and n >= min_docs]
        count = lambda s, t: per[lang, s, t] if s is not None else sum(per[lang, x, t] for x in sources)
        def shares(s):
            total = sum(count(s, t) for t in kept)
            return {t: 1 + 10**9 * (count(s, t) + 5) // (total + 5 * len(kept)) for t in kept}
        p, q = {s: shares(s) for s in sources}, shares(None)
        for s in sources:
            pairs = sorted((-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode(), o) for o in sources if o != s)
            more = sorted((q[t] - p[s][t], t.encode(), t) for t in kept if count(s, t) and p[s][t] > q[t])[:top]
            out |= {(lang, s, part, x, -v, i) for part, found in (("pair", pairs), ("term", more)) for i, (v, _, x) in enumerate(found, 1)}
    return out


@pytest.mark.parametrize("small", [False, True])
def test_source_audit(spark, small, monkeypatch):
    rng = random.Random(17)
    if small:  # several blocks of terms and groups
        for name, value in (("TERMS", 3), ("TERMS_A_TASK", 7), ("GROUPS", 2), ("ENTRIES", 20)):
            monkeypatch.setattr(source_audit, name, value)
    vocab = ["Alpha", "ALPHA", "bäta", "Ω", "ω", "g", "x1y", "ß"] + [f"t{chr(97 + i)}{chr(97 + j)}" for i in range(6) for j in range(6)]
    kind = "doc_id long, text string, lang string, source string, value long, rank int"
    rows = [(i, rng.choice([None, "", "12 - 34"]) if rng.random() < 0.1 else " ".join(rng.choices(vocab, weights=range(1, len(vocab) + 1), k=rng.randrange(30))), rng.choice(["en", "en", "en", None, "de"]), rng.choice(["s1", "S2", "s10", None, "é", "z"])) for i in range(300)]
    rows += [(900, "alone", "fr", "s1"), (901, None, "it", "a"), (902, "", "it", "b"), (1, "repeated Alpha", "en", "s1"), (1, "repeated Alpha", "en", "s1"), (None, "Alpha " * 20_000, "de", "z")]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], kind).repartition(4)
    got = [tuple(r) for r in source_audit.audit(df, min_docs=5, top=4).collect()]
    assert len(got) == len(set(got)) and set(got) == audited(rows, 5, 4)
    assert {r[2] for r in got} == {"pair", "term"} and ("it", "a", "pair", "b", 0, 1) in got
    assert source_audit.audit(df.limit(0)).count() == 0


def test_one_hot_products_are_exact():
    rng = np.random.default_rng(5)
    a, b = rng.integers(0, 5, (50, 4)), rng.integers(0, 10**12, (50, 3))
    totals = [a.sum(axis=0).tolist(), b.sum(axis=0).tolist()]
    share = lambda n, total: 1 + 10**9 * (int(n) + 5) // (total + 5 * 50)
    want = [[sum(abs(share(x, totals[0][i]) - share(y, totals[1][j])) for x, y in zip(a[:, i], b[:, j])) for j in range(3)] for i in range(4)]
    assert source_audit.differences(a, b, *totals, 50).tolist() == want
    matrix, shares, starts = source_audit.priced(a, totals[0], 50)
    assert matrix.sum(axis=0).min() >= 1 and (np.add.reduceat(matrix, starts, axis=1) == 1).all()


@pytest.fixture(scope="module")
def both():
    sentencepiece, tokenizers = pytest.importorskip("sentencepiece"), pytest.importorskip("tokenizers")
    a = tokenizers.Tokenizer.from_file(queries.tokenizer())
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=queries.tokenizer("piece_bpe_32k.model"))


def aligned(both, text):
    """Groups of ids of one text, or none where its bytes don't come back."""
    from tallyspark.llm.bpe import byte_letters

    byte_of = {c: b for b, c in enumerate(byte_letters())}
    a, b = both[0].encode(" " + text, add_special_tokens=False).ids, both[1].encode(text)
    parts = [[bytes(byte_of[c] for c in both[0].id_to_token(i)) for i in a], [bytes([int(p[3:-1], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p := both[1].id_to_piece(i)) else p.replace("▁", " ").encode() for i in b]]
    if not text or any(b"".join(p) != (" " + text).encode() for p in parts):
        return None
    ends = [np.cumsum([len(x) for x in p]).tolist() for p in parts]
    groups, i, j = [], 0, 0
    for end in sorted({*ends[0]} & {*ends[1]}):
        x, y = ends[0].index(end) + 1, ends[1].index(end) + 1
        groups.append((a[i:x], b[j:y]))
        i, j = x, y
    return a, b, groups


def test_token_align(spark, both, monkeypatch):
    monkeypatch.setattr(token_align, "PAIRS", 50)
    monkeypatch.setattr(token_align, "HOT", 40)
    rng = random.Random(2)
    bits = ["hello ", "wörld", "  ", "\n\n", "日本語テキスト", "don't", " 12345", "<|endoftext|>", "<s>", "▁", "🙂", "====", "\t", "an", "\x00", "é", "   x", "http://a.b/c?d=1", "<0x41>"]
    texts = ["".join(rng.choices(bits, k=rng.choice([1, 2, 5, 30, 200]))) for _ in range(150)] + ["", None, " ", "=" * 3001, "a" * 20_000, "the same text", "the same text", "▁", " x"]
    rows = list(enumerate(texts)) + [(3, texts[3]), (None, "no id"), (3, "another text")]
    found = [aligned(both, t) if t else None for _, t in rows]
    links = [collections.Counter((x, y) for g in (f[2] if f else []) for x in g[0] for y in g[1]) for f in found]
    held = collections.Counter(p for c in links for p in c)
    best = collections.defaultdict(int)
    for (x, _), n in held.items():
        best[x] = max(best[x], n)
    want = []
    for (i, _), f, c in zip(rows, found, links):
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in f[2]) if f else ""
        digest = hashlib.sha256(text.encode()).hexdigest() if f else ""
        want.append((i, *((len(f[0]), len(f[1]), len(f[2])) if f else (0, 0, 0)), sum(c.values()), sum(n for p, n in c.items() if held[p] == best[p[0]]), sum(n * held[p] for p, n in c.items()), digest))
    df = spark.createDataFrame([(i, t, 1, "z") for i, t in rows], "doc_id long, text string, row int, pair string").repartition(3)
    out = token_align.align(df, queries.tokenizer(), queries.tokenizer("piece_bpe_32k.model"))
    assert sorted(map(repr, map(tuple, out.collect()))) == sorted(map(repr, want))
    assert any(f is None and t for f, (_, t) in zip(found, rows)), "a text whose bytes don't come back"
    assert token_align.align(df.limit(0), queries.tokenizer(), queries.tokenizer("piece_bpe_32k.model")).count() == 0


def test_coalesced():
    rng = random.Random(4)
    for _ in range(200):
        spans = sorted((s, s + rng.randint(1, 6)) for s in rng.choices(range(40), k=rng.randint(0, 15)))
        groups, reach, group = [], None, -1
        for s, e in spans:
            if reach is None or s >= reach:
                group += 1
            reach = max(e, reach or 0)
            groups.append(group)
        starts, ends = (np.array([x[i] for x in spans], np.int64) for i in (0, 1))
        assert token_align.coalesced(starts, ends).tolist() == groups
