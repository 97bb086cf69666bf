import collections
import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyspark.llm import exact_dedup as E
from tallyspark.llm import jaccard_join as J
from tallyspark.llm import line_dedup as L
from tallyspark.llm import suffix_dedup as S


def norm(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def check_exact(docs, out):
    groups = collections.defaultdict(list)
    for d in docs:
        groups[norm(d["text"])].append(d["doc_id"])
    want = []
    for d in docs:
        ids = [i for i in groups[norm(d["text"])] if i is not None]
        keep = min(ids) if ids else None
        want.append((d["doc_id"], keep, len(groups[norm(d["text"])]), d["doc_id"] == keep, hashlib.sha256(norm(d["text"]).encode()).hexdigest()))
    got = [(r["doc_id"], r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in out.collect()]
    assert collections.Counter(got) == collections.Counter(want)


def test_exact(odd, nothing):
    check_exact(odd.collect(), E.exact_dedup(odd))
    assert E.exact_dedup(nothing).count() == 0


def test_exact_keeps_colliding_digests_apart(odd):
    check_exact(odd.collect(), E.exact_dedup(odd, digest=lambda t: F.substring(F.sha2(t, 256), 1, 1)))


def brute_lines(docs, min_sites=5):
    """Rows (doc_id, n_lines, n_removed, text) in the order of docs."""
    plain = lambda line: norm(line).strip(" ")
    tid = lambda text: hashlib.md5(text.encode()).hexdigest()
    sites, first = collections.defaultdict(set), {}
    for d in docs:
        for no, line in enumerate(d["text"].split("\n") if d["text"] is not None else []):
            if plain(line):
                place = (d["doc_id"] is not None, d["doc_id"] or 0, tid(d["text"]), no)
                sites[plain(line)].add(d["source"])
                first[plain(line)] = min(first.get(plain(line), place), place)
    out = []
    for d in docs:
        if d["text"] is None:
            out.append((d["doc_id"], 0, 0, None))
            continue
        lines, kept = d["text"].split("\n"), []
        for no, line in enumerate(lines):
            enough = min_sites * (2 if len(plain(line)) < 20 else 1)
            gone = plain(line) and len(sites[plain(line)]) >= enough and first[plain(line)] != (d["doc_id"] is not None, d["doc_id"] or 0, tid(d["text"]), no)
            if not gone:
                kept.append(line)
        out.append((d["doc_id"], len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def check_lines(docs):
    got = collections.Counter((r["doc_id"], r["n_lines"], r["n_removed"], r["text"]) for r in L.line_dedup(docs).collect())
    assert got == collections.Counter(brute_lines(docs.collect()))


def test_line_dedup(spark, odd, nothing):
    shared = "this is shared everywhere"
    data = [(i, f"{shared}\nown words of {i}\nshort\n {shared} \t", f"s{i}") for i in range(6)] + [(10, "rare but twice here\nx", "a"), (11, "rare but twice here", "b"), (12, None, "c"), (13, "", None)]
    docs = spark.createDataFrame([(*d, 0, 9) for d in data], "doc_id long, text string, source string, n_chars long, n_lines int")
    out = {r["doc_id"]: r for r in L.line_dedup(docs, min_sites=5).collect()}
    assert out[0]["text"] == f"{shared}\nown words of 0\nshort"
    assert out[3]["text"] == "own words of 3\nshort" and out[3]["n_removed"] == 2 and out[3]["n_chars"] == len(out[3]["text"])
    check_lines(docs)
    check_lines(odd)
    assert L.line_dedup(nothing).count() == 0


def test_lines_of_rows_that_share_a_doc_id(spark):
    rng = random.Random(21)
    pool = ["boilerplate that stands on many sites", "Privacy Policy", "", "  ", "中文样板句子没有空格也要判断的一整行文字内容", "a line of its own"]
    data = []
    for i in range(300):
        lines = [rng.choice([*pool, f"precious line {rng.randrange(400)} of some text"]) for _ in range(rng.randint(1, 5))]
        data.append((rng.choice([None, rng.randrange(40), i]), rng.choice(["\n".join(lines), "\n".join(lines), None]), rng.choice([None, *[f"s{k}" for k in range(12)]])))
    docs = spark.createDataFrame(data + data[:20], "doc_id long, text string, source string").repartition(6)
    check_lines(docs)
    assert any(n and i is None for i, _, n, _ in brute_lines(docs.collect()))


def test_line_threshold_is_exact(spark):
    sites = {"four sites only carry this": 4, "five sites do carry this": 5, "very many sites carry this": 60, "Read more": 9, "Terms": 10}
    data = [(n * 100 + i, line, f"site{i}") for n, (line, k) in enumerate(sites.items()) for i in range(k)]
    docs = spark.createDataFrame(data, "doc_id long, text string, source string")
    removed = {r["line"]: r["n"] for r in L.line_dedup(docs, min_sites=5).groupBy((F.col("doc_id") / 100).cast("int").alias("line")).agg(F.sum("n_removed").alias("n")).collect()}
    assert removed == {0: 0, 1: 4, 2: 59, 3: 0, 4: 9}


def jaccard(docs, threshold=0.8):
    sets = {}
    for d in docs:
        words = (d["text"] or "").split()
        k = min(5, len(words))
        sets[d["doc_id"], d["text"]] = frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1)) if k else None
    return sets


def brute_join(docs):
    sets = jaccard(docs)
    least = {}
    for (i, _), s in sets.items():
        if s is not None and i is not None:
            least[s] = min(least.get(s, i), i)
    reps = list(least)
    root = {s: s for s in reps}

    def find(s):
        while root[s] is not s:
            s = root[s]
        return s

    n = collections.Counter()
    for x in range(len(reps)):
        for y in range(x):
            a, b = reps[x], reps[y]
            shared = len(a & b)
            if shared >= 0.8 * (len(a) + len(b) - shared):
                n[a] += 1
                n[b] += 1
                root[find(a)] = find(b)
    lowest = {}
    for s in reps:
        lowest[find(s)] = min(lowest.get(find(s), least[s]), least[s])
    return {key: (key[0], key[0], 0) if s is None else (least.get(s, key[0]), lowest[find(s)] if s in root else key[0], n[s]) for key, s in sets.items()}


@pytest.fixture(scope="module")
def similar(spark):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(500)]
    base = [rng.choices(vocabulary, k=120) for _ in range(8)]
    data = []
    for i in range(240):
        words = list(base[i % 8])
        for _ in range(rng.choice([0, 1, 1, 2, 4, 9])):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        data.append((i, " ".join(words)))
    data += [(300, None), (301, ""), (302, "only three words"), (303, "only  three words"), (304, "x " * 5000)]
    return spark.createDataFrame(data, "doc_id long, text string")


@pytest.mark.parametrize("block, size", [(1024, 1 << 24), (7, 1 << 24), (1024, 20_000)])
def test_jaccard(similar, block, size):
    want = brute_join(similar.collect())
    got = {r["doc_id"]: (r["text_class"], r["class_id"], r["n_links"]) for r in J.join(similar, block=block, size=size).collect()}
    assert got == {i: v for (i, _), v in want.items()}


def test_jaccard_recall_at_the_threshold(spark, capsys):
    """Pairs of texts whose similarity is 0.80 to 0.83 and that resemble no other text."""
    rng = random.Random(17)
    data = []
    for i in range(600):
        words = [f"w{i}_{rng.randrange(10**6)}" for _ in range(104)]
        other = list(words)
        for at in rng.sample([20, 60], 2):
            other[at] = "changed"
        data += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(other))]
    docs = spark.createDataFrame(data, "doc_id long, text string").repartition(8)
    assert all(0.8 <= len(a & b) / len(a | b) < 0.83 for a, b in zip(*[iter(jaccard(docs.orderBy("doc_id").collect()).values())] * 2))
    found = J.join(docs).where("n_links = 1 and class_id = doc_id - doc_id % 2").count() / len(data)
    with capsys.disabled():
        print(f"recall of links at the threshold: {found:.4f}")
    assert found >= 0.995


def test_jaccard_of_a_chain_of_boilerplate(spark):
    """Texts that share half of their words with the next one hang together by candidates, but hold no link."""
    parts = [" ".join(f"p{i}w{k}" for k in range(40)) for i in range(301)]
    docs = spark.createDataFrame([(i, f"{parts[i]} {parts[i + 1]}") for i in range(300)] + [(900, f"{parts[0]} {parts[1]} end")], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in J.join(docs, block=16).collect()}
    assert rows[900]["class_id"] == 0 and rows[0]["n_links"] == 1
    assert all(r["class_id"] == i and r["n_links"] == 0 for i, r in rows.items() if i not in (0, 900))


def test_jaccard_matrix_path(similar):
    known = J.Digests()
    texts = [r["text"] for r in similar.where("doc_id < 240").collect()]
    sets = [J.shingles(t, known) for t in texts]
    everyone = np.arange(len(sets))
    whole = J._links(sets, np.ones((len(sets), len(sets)), bool), everyone, everyone, 0.8)
    exact = np.array([[i != j and len(np.intersect1d(x, y)) >= 0.8 * len(np.union1d(x, y)) for j, y in enumerate(sets)] for i, x in enumerate(sets)])
    assert (whole == exact).all() and whole.sum() > 2000


def test_a_pair_meets_once():
    rng = np.random.default_rng(3)
    a, b = rng.integers(0, 3, (9, 5)), rng.integers(0, 3, (7, 5))
    each = sum(J._shared(a, b, t).astype(int) for t in range(5))
    assert (each == J._shared(a, b, -1)).all()
    assert (J._shared(a, b, -1) == (a[:, None] == b[None]).any(axis=2)).all()


def test_jaccard_odd(odd, nothing):
    assert J.join(odd).count() == odd.count()
    assert J.join(nothing).count() == 0
    kept = J.keep_one(odd)
    assert kept.columns == odd.columns
    assert [r["doc_id"] for r in kept.where("doc_id in (1, 5, 6)").collect()] == [1]
    assert J.keep_one(nothing).count() == 0


def test_keep_one_when_doc_ids_repeat(spark):
    one, other = "a b c d e f g h i j", "k l m n o p q r s t"
    data = [(1, one, "x"), (5, one, "x"), (5, other, "x"), (5, other, "y"), (5, other.replace(" ", "  "), "x"), (None, other, "z"), (None, "quite another text of more words", "z"), (3, None, "x"), (3, None, "x"), (3, "", "x"), (3, " \u3000 ", "x")]
    docs = spark.createDataFrame(data, "doc_id long, text string, row string")
    rows = J.keep_one(docs).collect()
    kept = collections.Counter(" ".join(sorted((r["text"] or "").split())) for r in rows)
    assert kept == {one: 1, other: 1, " ".join(sorted("quite another text of more words".split())): 1, "": 4}
    assert {(r["doc_id"], r["text"]) for r in rows if r["text"] in (one, other)} == {(1, one), (None, other)}


def test_prefixes_shorten(spark):
    depths = [J.shallowest(0.8, recall=r) for r in (0.5, 0.99, 0.9995, 0.99999)]
    assert depths == sorted(depths, reverse=True)
    assert J.met(0.8, depths[2]) >= 0.9995

    def depth_of(changes):
        rng = random.Random(changes)
        data = []
        for i in range(200):
            words = [f"w{i}_{rng.randrange(10**6)}" for _ in range(104)]
            data.append((2 * i, " ".join(words)))
            for at in ([50], [20, 60])[changes - 1]:
                words[at] = "changed"
            data.append((2 * i + 1, " ".join(words)))
        docs = spark.createDataFrame(data, "doc_id long, text string")
        return J.candidates(J.described(docs, 5, J.TREES, J.DEPTH), J.TREES, J.DEPTH, 0.8, 0.9999)[2]

    assert J.shallowest(0.8, recall=0.9999) <= depth_of(2) < depth_of(1)


def brute_repeats(texts, length):
    seen = collections.Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        cover = np.zeros(len(t) + 2, np.int8)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                cover[i + 1 : i + length + 1] = 1
        kept = bytes(np.frombuffer(t, np.uint8)[cover[1:-1] == 0])
        out.append((len(t), int(cover.sum()), int((np.diff(cover) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def random_texts(seed, n=60):
    rng = random.Random(seed)
    alphabet = rng.choice(["ab", "abcd", "abcdefgh é"])
    pool = ["".join(rng.choices(alphabet, k=rng.randint(1, 120))) for _ in range(8)]
    texts = ["".join(rng.choice(pool) if rng.random() < 0.6 else "".join(rng.choices(alphabet, k=rng.randint(0, 60))) for _ in range(rng.randint(0, 6))) for _ in range(n)]
    return [*texts, "", None, "a" * 300, "ab" * 200, texts[0], texts[1]]


@pytest.mark.parametrize("seed, bucket", [(1, 20_000), (2, 20_000), (3, 2)])
def test_suffix_dedup(spark, seed, bucket):
    texts = random_texts(seed)
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, low string, spans int").repartition(5)
    out = sorted(S.suffix_dedup(docs, length=24, gram=4, bucket=bucket).collect())
    want = brute_repeats([(t or "").encode() for t in texts], 24)
    assert [tuple(r)[1:] for r in out] == want


def test_suffix_dedup_at_the_defaults(spark):
    """Real lengths, a text of more than one block, and copies with small edits around shared passages."""
    rng = random.Random(41)
    word = lambda: "".join(rng.choices("abcdefgh é", k=rng.randint(2, 9)))
    passage = [" ".join(word() for _ in range(80)) for _ in range(6)]
    texts = [" ".join(rng.choice([word(), rng.choice(passage)[rng.randrange(40) :]]) for _ in range(rng.randint(1, 12))) for _ in range(60)]
    huge = "".join(rng.choices("abcdefghij", k=(1 << 20) + 5000))
    texts += [huge[:700] + "Z" * 10 + huge, "x" * 199, "y" * 200, "y" * 200 + "z", None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    out = sorted(S.suffix_dedup(docs).collect())
    assert [tuple(r)[1:] for r in out] == brute_repeats([(t or "").encode() for t in texts], 200)
    assert out[60]["n_removed"] == 1400


def test_suffix_odd(odd, nothing):
    out = S.suffix_dedup(odd, texts=True).collect()
    assert len(out) == odd.count()
    long = next(r for r in out if r["doc_id"] == 7)
    assert long["n_bytes"] == 150_000 and long["n_removed"] == 150_000 and long["n_spans"] == 1
    assert S.suffix_dedup(nothing).count() == 0


def test_blocks_of_long_texts_agree():
    rng = np.random.default_rng(1)
    data = rng.integers(97, 100, 5000).astype(np.uint8)
    whole, parts = S.anchors(data, 40, 8), S.anchors_whole(data, 40, 8, chunk=333)
    for a, b in zip(whole, parts):
        assert (a == b).all()


def test_shards_of_a_bucket_agree():
    rng = np.random.default_rng(2)
    texts = rng.integers(0, 2, (40, 30)).astype(np.uint16)
    bucket = np.sort(rng.integers(0, 4, 40))
    one = np.concatenate(S.merged([S.shard_bwt(texts, bucket)], [bucket], 6, 20))
    cuts = [slice(0, 7), slice(7, 25), slice(25, 40)]
    many = np.concatenate(S.merged([S.shard_bwt(texts[c], bucket[c]) for c in cuts], [bucket[c] for c in cuts], 6, 20))
    assert (one == many).all()
    for i in range(40):
        for j in range(20):
            twin = any(k != i and bucket[k] == bucket[i] and (texts[k, j : j + 6] == texts[i, j : j + 6]).all() and j + 6 <= 30 for k in range(40))
            assert one[i, j] == twin
