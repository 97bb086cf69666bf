import collections
import hashlib
import math

import corpus_pipeline as P
import pytest
from pyspark.sql import functions as F

from tallyspark.llm import toxicity
from tallyspark.llm.queries import tokenizer

from .test_dedup import brute_lines, jaccard
from .test_rest import fill


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    import random

    rng = random.Random(11)
    vocabulary = [f"{a}{b}{c}" for a in "bdfgkmn" for b in "aeiou" for c in ("ran", "lem", "tos", "vi")]
    docs, labels = [], []
    for i in range(400):
        words = rng.choices(vocabulary, k=60)
        if i % 8 == 0:
            words[5] = words[40] = "wretch"
        docs.append((i, " ".join(words[:30]) + "\n" + " ".join(words[30:]) + "\nshared boilerplate line here", "en", f"s{i % 6}", 0))
        labels.append((i, 1, int(i % 8 == 0)))
    docs += [(1000 + i, docs[i][1], "en", "s9", 0) for i in range(1, 6)] + [(2000, None, "en", "s1", None), (2001, "", "en", None, 0)]
    where = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
    return where


def test_stages_one_by_one(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    n = {}
    for name, stage in P.STAGES:
        out = stage(spark, docs, corpus)
        rows = out.collect()
        if name != "bpe":
            assert out.columns == docs.columns
        ids = collections.Counter(r["doc_id"] for r in rows)
        if name == "toxicity":
            assert not any(i % 8 == 0 for i in ids if i < 400)
            assert all(ids[i] == 1 for i in range(400) if i % 8) and 2000 in ids and 2001 in ids
        if name == "line_dedup":
            assert len(rows) == docs.count()
            lines = sum((r["text"] or "").count("shared boilerplate line here") for r in rows)
            assert lines == 1
        if name == "ngram_jaccard_join":
            assert all(1000 + i not in ids for i in range(1, 6) if i % 8) and all(i in ids for i in range(400) if i % 8)
        if name == "mixing":
            assert max(ids.values()) <= 2 and set(ids) <= {r["doc_id"] for r in docs.collect()}
        if name == "bpe":
            assert len(rows) == docs.count()
        n[name] = len(rows)
        path = f"{corpus}/stage-{name}"
        out.write.mode("overwrite").parquet(path)
        docs = spark.read.parquet(path)
    assert P.run(spark, corpus).count() > 0


def plain_clean(spark, docs, where):
    chain = toxicity.fit(spark.createDataFrame(docs, KIND), spark.read.parquet(f"{where}/labels.parquet"))
    bad = lambda t: chain.probabilities([chain.index[w] for w in sorted(chain.index.keys() & toxicity.words(t or ""))])[-1]
    return [d for d in docs if bad(d["text"]) < 0.5]


def plain_lines(docs):
    rows = brute_lines(docs)
    return [{**d, "text": r[3], "n_chars": None if r[3] is None else len(r[3])} for d, r in zip(docs, rows)]


def plain_groups(docs):
    sets, classes = jaccard(docs), []
    for d in docs:
        mine = sets[d["doc_id"], d["text"]]
        near = [c for c in classes if mine is not None and any(s is not None and len(mine & s) >= 0.8 * len(mine | s) for s, _ in c)]
        classes = [c for c in classes if c not in near] + [[(mine, d), *[x for c in near for x in c]]]
    return [min((d for _, d in c), key=lambda d: d["doc_id"]) for c in classes]


def plain_mix(docs, quality):
    size = {d["doc_id"]: len((d["text"] or "").split()) for d in docs}
    sizes = collections.Counter()
    for d in docs:
        sizes[d["source"]] += size[d["doc_id"]]
    out = collections.Counter()
    for source, target in fill(sizes).items():
        epochs, inside = (int(target // sizes[source]) if sizes[source] else 0), 0
        rest = target - epochs * sizes[source]
        unit = lambda i: (int(hashlib.md5(f"7:{i}".encode()).hexdigest()[:12], 16) + 0.5) / 16**12
        mine = [d["doc_id"] for d in docs if d["source"] == source]
        for i in sorted(mine, key=lambda i: (-math.log(unit(i)) / (0.25 + quality.get(i, 0.5)), i)):
            out[i] = epochs + (size[i] > 0 and inside + size[i] / 2 <= rest)
            inside += size[i]
    return [d for d in docs for _ in range(out[d["doc_id"]])]


KIND = "doc_id long, text string, lang string, source string, n_chars long"


def test_pipeline_against_plain_python(spark, corpus):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer())
    docs = [r.asDict() for r in spark.read.parquet(f"{corpus}/documents.parquet").collect()]
    quality = {r["doc_id"]: float(r["quality"]) for r in spark.read.parquet(f"{corpus}/labels.parquet").collect()}
    rows = plain_mix(plain_groups(plain_lines(plain_clean(spark, docs, corpus))), quality)
    sha = lambda text: hashlib.sha256(text.encode()).hexdigest()
    want = collections.Counter()
    for d in rows:
        ids = library.encode(d["text"] or "", add_special_tokens=False).ids
        want[d["doc_id"], len(ids), sha(",".join(map(str, ids))), sha(d["text"] or "")] += 1
    assert collections.Counter(map(tuple, P.run(spark, corpus).collect())) == want


def test_pipeline_of_nothing(spark, corpus, tmp_path):
    for name in ("documents", "labels"):
        spark.read.parquet(f"{corpus}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert P.run(spark, str(tmp_path)).count() == 0
