"""How sources of a language differ in their words: prices of all joint tables of count levels, by one-hot products."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tallyspark.operators.numbering import numbered

from .common import stored

#: A term is kept in a language with at least this many documents of it.
MIN_DOCS = 30
#: Fixed values of the shares: what is added to each count, and by how much a share is scaled.
ADDED, SCALE = 5, 1_000_000_000
#: Ranks of the terms that a group has more of than its language.
TOP = 50
#: Terms of one product, terms and groups of one task. A product has at most TERMS x GROUPS columns on a side.
TERMS, TERMS_A_TASK, GROUPS = 64, 512, 32
#: Different (language, source, term) that a task counts before it passes them on.
ENTRIES = 1 << 19
#: Fixed value: letters of terms are A to Z, which become small, a to z and all that isn't ASCII; others separate.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
KEYS = ["lang", "source"]


def counts(docs: DataFrame) -> DataFrame:
    """Rows (lang, source, term, n, docs): occurrences, and documents that have the term; null texts, languages and
    sources are ''. Each group has a row without a term besides. Tasks count their own rows first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        held = 0

        def out() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, docs) in seen.items():
                terms = [None, *(x.decode() for x in n)]
                columns = [[lang] * len(terms), [source] * len(terms), terms, [0, *n.values()], [0, *map(docs.__getitem__, n)]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(),) * 3 + (pa.int64(),) * 2)], ["lang", "source", "term", "n", "docs"])

        for batch in batches:
            for lang, source, text in zip(*(batch[c] for c in (*KEYS, "text"))):
                n, docs = seen.setdefault((lang.as_py(), source.as_py()), (Counter(), Counter()))
                before, words = len(n), text.as_py().translate(LETTERS).split()
                n.update(words)
                docs.update(set(words))
                held += len(n) - before
                if held >= ENTRIES:
                    yield from out()
                    seen.clear()
                    held = 0
        yield from out()

    plain = [F.coalesce(c, F.lit("")).alias(c) for c in KEYS]
    rows = docs.select(*plain, F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    rows = rows.mapInArrow(run, "lang string, source string, term string, n long, docs long")
    return rows.groupBy(*KEYS, "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(n: str, total: str, terms: str) -> Column:
    """1 + floor(SCALE x (n + ADDED) / (total + ADDED x terms)), exact at any size."""
    whole = lambda x: f"cast({x} as decimal(28,0))"
    return F.expr(f"1 + ({SCALE} * ({whole(n)} + {ADDED})) div ({whole(total)} + {ADDED} * {whole(terms)})")


def priced(cells: np.ndarray, totals: list[int], terms: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a block's counts (a row for each term, a column for each group): the one-hot matrix with a column for each
    (group, count level), the level's share in its group, and where each group's columns start."""
    columns, starts, shares = [], [], []
    for group, total in enumerate(totals):
        levels, place = np.unique(cells[:, group], return_inverse=True)
        starts.append(sum(c.shape[1] for c in columns))
        columns.append((place.reshape(-1, 1) == np.arange(len(levels))).astype(np.float32))
        shares += [1 + SCALE * (n + ADDED) // (total + ADDED * terms) for n in levels.tolist()]
    return np.concatenate(columns, axis=1), np.array(shares, np.int64), np.array(starts)


def differences(left: np.ndarray, right: np.ndarray, left_totals: list[int], right_totals: list[int], terms: int) -> np.ndarray:
    """For each group of the left and of the right side, the sum over a block's terms of the difference of their shares.

    The product of the transposed one-hot matrices is the joint table of every pair of groups: how many terms have
    one level here and another there. It is exact, as no entry exceeds the number of terms. Each entry is priced by the
    difference of its two shares.
    """
    a, a_shares, a_starts = priced(left, left_totals, terms)
    b, b_shares, b_starts = priced(right, right_totals, terms)
    joint = (a.T @ b).astype(np.int64)
    joint *= np.abs(a_shares[:, None] - b_shares[None, :])
    return np.add.reduceat(np.add.reduceat(joint, a_starts, axis=0), b_starts, axis=1)


def pair_sums(cells: DataFrame, tasks: DataFrame) -> DataFrame:
    """Rows (lang, a, b, value) for all pairs of a language's groups, by their numbers, a < b.

    cells are the counts above 0, (lang, term number, group number, n); tasks say which blocks of terms and groups there
    are, (lang, part, one, two, n_terms, terms, one_totals, two_totals). Terms come in the order of their counts, so a
    block of TERMS rows has few levels. Blocks are summed within a task, tasks by aggregation.
    """

    def run(key: tuple, table: pa.Table, task: pa.Table) -> pa.Table:
        lang, _, one, two = (k.as_py() for k in key)
        task = task.to_pylist()[0]
        at, group, n = (table[c].to_numpy() for c in ("at", "group", "n"))
        totals = [task["one_totals"], task["two_totals"]]
        sides = []
        for block, total in zip((one, two), totals):
            side, mine = np.zeros((task["n_terms"], len(total)), np.int64), group // GROUPS == block
            side[at[mine], group[mine] % GROUPS] = n[mine]
            sides.append(side)
        value = np.zeros((len(totals[0]), len(totals[1])), np.int64)
        for start in range(0, task["n_terms"], TERMS):
            value += differences(sides[0][start : start + TERMS], sides[1][start : start + TERMS], *totals, task["terms"])
        a, b = (x.ravel() for x in np.indices(value.shape))
        a, b = a + one * GROUPS, b + two * GROUPS
        kept = a < b
        return pa.table({"lang": pa.array([lang] * int(kept.sum()), pa.string()), "a": a[kept], "b": b[kept], "value": value.ravel()[kept]})

    blocks = tasks.groupBy("lang").agg(F.max("two").alias("last"))
    spread = cells.join(blocks, "lang").withColumn("block", F.floor(F.col("group") / GROUPS)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), "last")))
    key = [F.floor(F.col("number") / TERMS_A_TASK).alias("part"), F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two")]
    spread = spread.select("lang", *key, (F.col("number") % TERMS_A_TASK).alias("at"), "group", "n")
    names = ["lang", "part", "one", "two"]
    out = spread.groupBy(*names).cogroup(tasks.groupBy(*names)).applyInArrow(run, "lang string, a long, b long, value long")
    return out.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value and rank: how far each source is from the others of its language, and in which terms.

    Each language keeps the terms that at least min_docs of its documents have. A group (language and source) and the
    language itself give each kept term a share of a thousand million, smoothed; part `pair` has the sum of the shares'
    differences to each other source, part `term` the terms whose share is larger than the language's, the first `top`
    of them. Ranks go by value, then by item. A group without kept terms has N = 0; in a language without any, pairs
    differ by 0. A language with one source has no pairs. Repeated rows count each; doc_id and other columns aren't
    read. An empty table gives an empty result.

    Only counts are shuffled: one row for each term, group and task. Terms are numbered in the order of their counts by
    ranges; no window or task sees more than a group's terms at once, and those are cut to the best `top` in each task
    before they meet.
    """
    found = stored(counts(docs))
    kept = found.where("term is not null").groupBy("lang", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")).where(F.col("docs") >= min_docs)
    kept = stored(numbered(kept, [F.col("lang"), F.col("n"), F.col("term")], "number").select("lang", "term", "n", "number"))
    langs = kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("n").alias("l_total"), F.min("number").alias("first"))
    kept = kept.join(langs, "lang").withColumn("number", F.col("number") - F.col("first"))
    cells = stored(found.where("term is not null").join(kept.select("lang", "term", "number", F.col("n").alias("l_n")), ["lang", "term"]).select(*KEYS, "term", "number", "n", "l_n"))
    groups = found.where("term is null").select(*KEYS).join(cells.groupBy(*KEYS).agg(F.sum("n").alias("total")), KEYS, "left").join(langs.drop("first"), "lang", "left")
    groups = groups.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("total", "terms", "l_total")})
    groups = stored(groups.withColumn("group", F.row_number().over(W.partitionBy("lang").orderBy("source")).cast("long") - 1))

    blocks = groups.groupBy("lang", "terms", F.floor(F.col("group") / GROUPS).alias("block")).agg(F.sort_array(F.collect_list(F.struct("group", "total"))).alias("totals"))
    blocks = blocks.withColumn("totals", F.col("totals.total"))
    two = blocks.select("lang", F.col("block").alias("two"), F.col("totals").alias("two_totals"))
    tasks = blocks.select("lang", "terms", F.col("block").alias("one"), F.col("totals").alias("one_totals")).join(two, "lang").where("one <= two")
    tasks = tasks.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.floor((F.col("terms") - 1) / TERMS_A_TASK), F.lit(0)))))
    tasks = tasks.withColumn("n_terms", F.least(F.col("terms") - F.col("part") * TERMS_A_TASK, F.lit(TERMS_A_TASK)))

    numbers = groups.select(*KEYS, "group")
    sums = stored(pair_sums(cells.join(numbers, KEYS).select("lang", "number", "group", "n"), tasks))
    name = lambda side: numbers.select("lang", F.col("source").alias(f"{side}_source"), F.col("group").alias(side))
    both = sums.join(name("a"), ["lang", "a"]).join(name("b"), ["lang", "b"])
    pairs = both.select("lang", F.explode(F.array(F.struct(F.col("a_source").alias("source"), F.col("b_source").alias("item")), F.struct(F.col("b_source").alias("source"), F.col("a_source").alias("item")))).alias("x"), "value")
    pairs = pairs.select("lang", "x.source", F.lit("pair").alias("part"), "x.item", "value")

    shares = cells.join(groups, KEYS).where("n > 0").withColumns({"p": share("n", "total", "terms"), "q": share("l_n", "l_total", "terms")})
    more = shares.where("p > q").select(*KEYS, F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    place = F.row_number().over(W.partitionBy(*KEYS).orderBy(F.desc("value"), "item"))
    return pairs.withColumn("rank", place).unionByName(more.withColumn("rank", place).where(F.col("rank") <= top))
