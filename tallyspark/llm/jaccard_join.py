"""N-gram Jaccard join: a forest of sorted MinHash prefix tries finds candidates, exact set comparison decides."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from .common import components, cut, slices, stored

#: Words of a shingle, the least similarity of a link.
WIDTH, THRESHOLD = 5, 0.8
#: Tries, their depth (the values of a full path), and the share of links that must be met.
TREES, DEPTH, RECALL = 24, 8, 0.9999
#: Texts and bytes of shingles of a block: a task compares two blocks at a time, STRIP texts with a block at once.
BLOCK, BYTES, STRIP = 4096, 16 << 20, 512
#: Word digests that a worker keeps.
KEEP = 250_000
ODD = np.uint64(0x9E3779B97F4A7C15)


class Digests(dict):
    """word -> 64-bit digest, remembered for the first KEEP words."""

    def __missing__(self, word: str) -> int:
        value = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        if len(self) < KEEP:
            self[word] = value
        return value


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * ODD
    return x ^ (x >> np.uint64(29))


def shingles(text: str, known: Digests, width: int = WIDTH) -> np.ndarray:
    """The sorted distinct digests of a text's shingles; fewer words than `width` make one shingle of them all."""
    words = text.split()
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    span = min(width, len(h))
    if not span:
        return h
    n = len(h) - span + 1
    x = np.full(n, np.uint64(span))
    for i in range(span):
        x = mixed(x) + h[i : n + i]
    return np.unique(mixed(x))


def seeds(count: int) -> tuple[np.ndarray, np.ndarray]:
    x = mixed(np.arange(1, 2 * count + 1, dtype=np.uint64) * ODD)
    return x[:count] | np.uint64(1), x[count:]


def signature(found: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of the hash functions the least value over all shingles, the upper 16 bits."""
    low = np.full(len(a), np.uint64(2**64 - 1))
    for start in range(0, len(found), 512):
        np.minimum(low, (found[start : start + 512, None] * a + b).min(axis=0), out=low)
    return (low >> np.uint64(48)).astype(">u2")


def met(similarity: float, depth: int, trees: int = TREES) -> float:
    """The chance that two texts share a prefix of `depth` values in one trie or more."""
    return 1 - (1 - similarity**depth) ** trees


def shallowest(threshold: float, trees: int = TREES, depth: int = DEPTH, recall: float = RECALL) -> int:
    """The depth at which even pairs at the threshold meet with probability `recall`; prefixes get no shorter."""
    for length in range(depth, 1, -1):
        if met(threshold, length, trees) >= recall:
            return length
    return 1


def described(docs: DataFrame, width: int, trees: int, depth: int) -> DataFrame:
    """doc_id, tid (digest of the text), sid (digest of the shingle set; null if empty), n (shingles), sig (the paths)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, (a, b) = Digests(), seeds(trees * depth)
        for batch in slices(batches):
            sids, counts, sigs = [], [], []
            for text in batch["text"]:
                found = shingles(text.as_py() or "", known, width)
                sids.append(xxhash.xxh3_128_digest(found.tobytes()) if len(found) else None)
                counts.append(len(found))
                sigs.append(signature(found, a, b).tobytes() if len(found) else None)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["tid"], pa.array(sids, pa.binary()), pa.array(counts, pa.int64()), pa.array(sigs, pa.binary())], ["doc_id", "tid", "sid", "n", "sig"])

    return docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("tid"), "text").mapInArrow(run, "doc_id long, tid long, sid binary, n long, sig binary")


def nodes(trees: int, depth: int, length: int) -> Column:
    """The trie nodes on a text's paths at depth `length`: digests of the tree and the first values of its path.

    A node is the run of texts with one prefix in the trie's sorted order.
    """
    return F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.xxhash64(t, F.substr("sig", t * (2 * depth) + 1, F.lit(2 * length))))


def crowded(rows: DataFrame) -> DataFrame:
    """Rows (node, v) of the nodes with more than one text, from rows (sid, node); v is the least of the texts."""
    return rows.groupBy("node").agg(F.min("sid").alias("v"), F.max("sid").alias("w")).where("v != w").select("node", "v")


def stars(rows: DataFrame) -> DataFrame:
    """Edges (u, v) that tie the texts of each node to the least of them, so a node of many texts makes no pairs."""
    return rows.join(crowded(rows), "node").where("sid != v").select(F.col("sid").alias("u"), "v").distinct()


def seen_share(edges: DataFrame, forest: DataFrame, trees: int, length: int, threshold: float) -> float:
    """The estimated share of links that meet at depth `length`, from the similarities of the pairs that do.

    A pair of similarity s is met with probability p(s), so it stands for 1 / p(s) pairs. The similarity is estimated
    from the signatures, and pairs below the threshold are no links. Without any, pairs at the threshold are assumed.
    """
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch[name].to_pylist()), np.uint16).reshape(batch.num_rows, -1) for name in ("a", "b"))
            yield pa.RecordBatch.from_arrays([pa.array((a == b).mean(axis=1) if batch.num_rows else [], pa.float64())], ["s"])

    sigs = forest.select("sid", "sig")
    pairs = edges.join(sigs.toDF("u", "a"), "u").join(sigs.toDF("v", "b"), "v").select("a", "b").mapInArrow(compare, "s double")
    chance = 1 - F.pow(1 - F.pow("s", F.lit(length)), F.lit(trees))
    row = pairs.where(F.col("s") >= threshold).agg(F.count("*"), F.sum(1 / chance)).head()
    return row[0] / row[1] if row[0] else met(threshold, length, trees)


def candidates(base: DataFrame, trees: int, depth: int, threshold: float, recall: float) -> tuple[DataFrame, DataFrame, int]:
    """The texts that meet others, their edges, and the depth: (forest, edges, length).

    Prefixes start at full depth and are shortened, level by level, until the estimated share of links that meet
    reaches `recall`; shallowest() is the last level. A text alone at that level is alone at every deeper one, so only
    the others take part: forest has (sid, sig, n, rep), one row for each different set, rep its least doc_id.
    """
    last = shallowest(threshold, trees, depth, recall)
    there = base.where("sid is not null")
    rows = there.select("sid", F.explode(nodes(trees, depth, last)).alias("node"))
    alive = rows.join(crowded(rows).select("node"), "node").select("sid").distinct()
    forest = stored(there.join(alive, "sid", "left_semi").groupBy("sid").agg(F.first("sig").alias("sig"), F.max("n").alias("n"), F.min("doc_id").alias("rep")))
    for length in range(depth, last - 1, -1):
        edges = cut(stars(forest.select("sid", F.explode(nodes(trees, depth, length)).alias("node"))))
        if length == last or seen_share(edges, forest, trees, length, threshold) >= recall:
            return forest, edges, length
    raise AssertionError("unreachable: the last level returns")


def _shared(left: np.ndarray, right: np.ndarray, tree: int) -> np.ndarray:
    """Which of left x right share a node; in a group of one node only if no earlier tree has one for them."""
    out = np.zeros((len(left), len(right)), dtype=bool)
    for t in range(left.shape[1] if tree < 0 else tree):
        out |= left[:, t, None] == right[None, :, t]
    return out if tree < 0 else ~out & (left[:, tree, None] == right[None, :, tree])


def _links(sets: list[np.ndarray], maybe: np.ndarray, left: np.ndarray, right: np.ndarray, threshold: float) -> np.ndarray:
    """Which of left x right are linked, among those that `maybe` marks; sizes only rule out what can't be linked."""
    sizes = np.array([len(s) for s in sets])
    linked = np.zeros((len(left), len(right)), dtype=bool)
    n, m = sizes[left], sizes[right]
    maybe = maybe & (np.minimum.outer(n, m) >= threshold * np.maximum.outer(n, m)) & (left[:, None] != right[None, :])
    pairs = np.argwhere(maybe)
    if len(pairs) > 2000:
        used = np.unique(pairs[:, 0]), np.unique(pairs[:, 1])
        both = np.concatenate([left[used[0]], right[used[1]]])
        words, number = np.unique(np.concatenate([sets[i] for i in both]), return_inverse=True)
        owner = np.repeat(np.arange(len(both)), sizes[both])
        shared = np.zeros((len(used[0]), len(used[1])), dtype=np.float32)
        order = np.argsort(number, kind="stable")
        number, owner = number[order], owner[order]
        for start in range(0, len(words), 1024):
            lo, hi = np.searchsorted(number, [start, start + 1024])
            table = np.zeros((len(both), 1024), dtype=np.float32)
            table[owner[lo:hi], number[lo:hi] - start] = 1
            shared += table[: len(used[0])] @ table[len(used[0]) :].T
        total = np.add.outer(n[used[0]], m[used[1]]) - shared
        linked[np.ix_(*used)] = maybe[np.ix_(*used)] & (shared >= threshold * total)
        return linked
    for i, j in pairs:
        a, b = sets[left[i]], sets[right[j]]
        shared = len(np.intersect1d(a, b, assume_unique=True))
        linked[i, j] = shared >= threshold * (len(a) + len(b) - shared)
    return linked


def _compare(rows: list[dict], threshold: float) -> Iterator[tuple[bytes, bytes, int]]:
    """(sid, least sid that it hangs together with, links) for the linked texts of one pair of blocks."""
    side, tree = np.array([r["side"] for r in rows]), rows[0]["tree"]
    sids, sets = [r["sid"] for r in rows], [np.frombuffer(r["words"], np.uint64) for r in rows]
    at = np.array([r["nodes"] for r in rows], np.int64)
    left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    if not len(right):
        right = left
    linked = np.zeros((len(left), len(right)), dtype=bool)
    for start in range(0, len(left), STRIP):
        part = left[start : start + STRIP]
        linked[start : start + STRIP] = _links(sets, _shared(at[part], at[right], tree), part, right, threshold)
    counts = np.zeros(len(rows), dtype=int)
    counts[left] += linked.sum(axis=1)
    if right is not left:
        counts[right] += linked.sum(axis=0)
    root = np.full(len(rows), -1)
    for start in np.flatnonzero(counts):
        if root[start] >= 0:
            continue
        root[start], front = start, np.array([start])
        while len(front):
            near = np.concatenate([right[linked[np.isin(left, front)].any(axis=0)], left[linked[:, np.isin(right, front)].any(axis=1)]])
            front = np.unique(near[root[near] < 0])
            root[front] = start
    for i in np.flatnonzero(counts):
        yield sids[i], sids[root[i]], int(counts[i])


def placed(forest: DataFrame, edges: DataFrame, trees: int, depth: int, length: int, block: int, size: int) -> DataFrame:
    """Where each text is compared: (sid, rep, nodes, places), places being a list of (key, tree, blocks).

    Texts that hang together by shared nodes and fit into one block meet once, with tree -1, so that a text travels
    once; only pairs that share a node are compared there too. Larger sets are not compared as a whole: their texts
    meet node by node, in as many blocks as a node's texts and bytes need.
    """
    amount = lambda: (F.count("*").alias("k"), F.sum("n").alias("words"))
    blocks = F.greatest(F.ceil(F.col("k") / block), F.ceil(F.col("words") * 8 / size)).cast("int").alias("blocks")
    rows = forest.select("sid", "rep", "n", nodes(trees, depth, length).alias("nodes"))
    rooted = cut(rows.join(components(edges), F.col("sid") == F.col("node")).drop("node"))
    sizes = rooted.groupBy("root").agg(*amount()).select("root", blocks)
    slim = cut(rooted.select("sid", "root", "n", "nodes").join(sizes, "root"))
    whole = slim.where("blocks = 1").select("sid", F.hex("root").alias("key"), F.lit(-1).alias("tree"), "blocks")
    single = slim.where("blocks > 1").select("sid", "n", F.posexplode("nodes").alias("tree", "node"))
    many = single.groupBy("node").agg(*amount()).where("k > 1").select("node", blocks)
    parts = single.join(many, "node").select("sid", F.col("node").cast("string").alias("key"), "tree", "blocks")
    places = whole.unionByName(parts).groupBy("sid").agg(F.collect_list(F.struct("key", "tree", "blocks")).alias("places"))
    return rooted.select("sid", "rep", "nodes").join(places, "sid")


def verified(docs: DataFrame, members: DataFrame, width: int, threshold: float) -> DataFrame:
    """Exact links between the texts that share a node: rows (u, v, n), v hangs together with u, n links found here.

    members are placed() texts. A place's texts are dealt to blocks by digest; each pair of blocks is one group. A
    pair that shares nodes in several trees is compared in the first of them.
    """

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Digests()
        for batch in slices(batches):
            good, found = [], []
            for i, (text, sid) in enumerate(zip(batch["text"], batch["sid"])):
                one = shingles(text.as_py(), known, width)
                if len(one) and xxhash.xxh3_128_digest(one.tobytes()) == sid.as_py():
                    good.append(i)
                    found.append(one.tobytes())
            some = batch.take(pa.array(good, pa.int32()))
            yield pa.RecordBatch.from_arrays([some["sid"], some["nodes"], some["places"], pa.array(found, pa.binary())], ["sid", "nodes", "places", "words"])

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in slices(batches) for row in batch.to_pylist())
        for _, group in groupby(rows, key=lambda r: r["pair"]):
            one = {row["sid"]: row for row in group}
            out = list(_compare(list(one.values()), threshold)) if len(one) > 1 else []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.binary(), pa.binary(), pa.int64()))], ["u", "v", "n"])

    place = "places array<struct<key:string,tree:int,blocks:int>>"
    texts = docs.where("text is not null").select("doc_id", "text").join(members, F.col("doc_id").eqNullSafe(F.col("rep")))
    rows = texts.select("text", "sid", "nodes", "places").mapInArrow(sets, f"sid binary, nodes array<long>, {place}, words binary")
    each = rows.select("sid", "nodes", "words", F.explode("places").alias("p")).select("sid", "nodes", "words", "p.*")
    dealt = each.withColumn("b", F.pmod(F.xxhash64("sid"), "blocks").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pair = F.concat_ws(":", "key", "tree", F.least("b", "other"), F.greatest("b", "other")).alias("pair")
    dealt = dealt.select(pair, (F.col("b") > F.col("other")).cast("int").alias("side"), "tree", "sid", "nodes", "words")
    return dealt.repartition("pair").sortWithinPartitions("pair").mapInArrow(pairs, "u binary, v binary, n long")


def classes(docs: DataFrame, width: int = WIDTH, threshold: float = THRESHOLD, trees: int = TREES, depth: int = DEPTH, recall: float = RECALL, block: int = BLOCK, size: int = BYTES) -> tuple[DataFrame, DataFrame]:
    """(base, sets): described() documents, and (sid, rep, root, n_links) of each different set, root naming its class."""
    base = stored(described(docs, width, trees, depth))
    forest, edges, length = candidates(base, trees, depth, threshold, recall)
    members = placed(forest, edges, trees, depth, length, block, size)
    links = cut(verified(docs, members, width, threshold))
    counts = links.groupBy(F.col("u").alias("sid")).agg(F.sum("n").alias("n_links"))
    roots = components(links.select("u", "v")).withColumnRenamed("node", "sid")
    reps = base.where("sid is not null").groupBy("sid").agg(F.min("doc_id").alias("rep"))
    sets = reps.join(counts, "sid", "left").join(roots, "sid", "left")
    return base, cut(sets.select("sid", "rep", F.coalesce("root", "sid").alias("root"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")))


def join(docs: DataFrame, **options) -> DataFrame:
    """One row per document: doc_id, text_class, class_id, n_links.

    A text is its set of shingles of `width` blank-separated words. text_class is the least doc_id with the same
    set; n_links is how many other sets have a Jaccard similarity of threshold or more with it; class_id is the
    least doc_id of all texts that hang together by such links. Null, empty and blank texts have no shingles: each
    is its own class without links. Texts of fewer words than width are one shingle. Long texts are compared
    whole. Repeated rows get equal rows; other columns are left out; an empty table gives an empty result.

    Equal sets are one text from the start. The prefixes that must match are shortened level by level until links
    meet with the share `recall` (see candidates()); every pair that shares a node is decided exactly. So a link is
    lost only if its texts share no node in any of the trees. Options are those of classes().
    """
    base, sets = classes(docs, **options)
    least = sets.groupBy("root").agg(F.min("rep").alias("class_id"))
    named = sets.join(least, "root").select("sid", F.col("rep").alias("text_class"), "class_id", "n_links")
    out = base.select("doc_id", "sid").join(named, "sid", "left")
    alone = F.col("sid").isNull()
    return out.select("doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("text_class")).alias("text_class"), F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """One row of docs for each class: that with the least (doc_id, shingle set, text); all rows without shingles stay.

    Rows that agree in doc_id and text are one row here. A null doc_id comes before all others.
    """
    base, sets = classes(docs, **options)
    rows = base.where("sid is not null").select("sid", "doc_id", "tid")
    best = rows.join(sets.select("sid", "root"), "sid").groupBy("root").agg(F.min(F.struct("doc_id", "sid", "tid")).alias("b"))
    kept = cut(best.select(F.col("b.doc_id").alias("k_doc"), F.col("b.tid").alias("k_tid")).unionByName(base.where("sid is null").select(F.col("doc_id").alias("k_doc"), F.col("tid").alias("k_tid")).distinct()))
    same = F.col("doc_id").eqNullSafe(F.col("k_doc")) & (F.xxhash64("text") == F.col("k_tid"))
    out = docs.select("doc_id", "text", F.struct("*").alias("row")).join(kept, same, "left_semi")
    if not rows.groupBy("doc_id", "tid").count().where("count > 1").isEmpty():
        words = F.coalesce(F.trim(F.regexp_replace("text", r"[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x1C-\x1F]+", "")), F.lit("")) != ""
        out = out.where(words).dropDuplicates(["doc_id", "text"]).unionByName(out.where(~words))
    return out.select("row.*")
