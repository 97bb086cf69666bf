"""Alignment of two tokenizers' tokens over the bytes of a text, by coalescing their intervals."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from .bpe import PIECES, load
from .common import stored

#: A pair of ids as one number: the first tokenizer's id times this, plus the second's.
WIDTH = 1 << 20
#: Bytes of text that are aligned at a time; a longer text by itself. Pairs that are expanded at a time.
CHUNK, PAIRS = 1 << 20, 1 << 20
#: Pairs with at least this part of all (document, pair) rows are broadcast: never more than HOT of them.
HOT = 1 << 16
#: What stands before a token in a document's groups: the first of a group, the first of its second side, another one.
MARKS = ((";", ","), ("|", ","))
ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, links array<long>"


@lru_cache(maxsize=2)
def pieces(path: str):
    """A sentencepiece model, the bytes of each of its ids and what a space is in them."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    plain = lambda i: bytes([int(model.id_to_piece(i)[3:-1], 16)]) if model.is_byte(i) else model.id_to_piece(i).replace("▁", " ").encode()
    return model, [plain(i) for i in range(model.get_piece_size())]


@lru_cache(maxsize=2)
def encoder(path: str):
    """The byte-level tokenizer's encoder of plain text, in which a special token's string is text like any other.

    Where the file's merges come in the order of the ids that they make, ranks are ids and a compiled encoder serves; it
    holds no pieces of texts. Another file is encoded by bpe.Bpe.
    """
    import tiktoken

    bpe = load(path)
    made = [merged for _, merged in sorted(bpe.merges.values())]
    if any(a >= b for a, b in zip(made, made[1:])) or (made and max(bpe.first) >= made[0]):
        return bpe.encode_plain
    ranks = {token: i for i, token in bpe.text_of.items() if i not in set(bpe.added.values())}
    return tiktoken.Encoding("plain", pat_str=PIECES.replace(r"\p{White_Space}", r"\s").replace(r"\P{White_Space}", r"\S"), mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def coalesced(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The group of each interval, from 0, intervals being sorted by start: a group breaks where a start reaches the
    largest end so far."""
    reach = np.maximum.accumulate(ends)
    return np.cumsum(np.concatenate([[False], starts[1:] >= reach[:-1]])[: len(starts)])


def summed(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each key once, in rising order, with the sum of its values."""
    order = np.argsort(keys)
    keys, values = keys[order], values[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])[: len(keys)])
    return keys[first], np.add.reduceat(values, first) if len(first) else values


#: A document of a batch and a pair as one number; a batch has fewer documents than 2**22.
DOC = 1 << 41


def linked(group: np.ndarray, ids: np.ndarray, second: np.ndarray, doc_of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, pair, links): how often each pair of ids shares a group of each document.

    A group of one token on each side is a pair; both sides come in the order of their groups. In other groups equal ids are counted first, so a long group of few
    different ids costs little; different ones are expanded a part at a time.
    """
    many = np.bincount(group, minlength=len(doc_of)) > 2
    large = many[group]
    keys = [doc_of[~many] * DOC + ids[~large & ~second] * WIDTH + ids[~large & second]]
    links = [np.ones(len(keys[0]), np.int64)]
    sides = []
    for side in (False, True):
        mine = large & (second == side)
        own, times = summed(group[mine] * WIDTH + ids[mine], np.ones(int(mine.sum()), np.int64))
        sides.append((own // WIDTH, own % WIDTH, times))
    (ga, a, na), (gb, b, nb) = sides
    first, last = np.searchsorted(gb, ga), np.searchsorted(gb, ga, "right")
    sizes = last - first
    done = np.concatenate([[0], np.cumsum(sizes)])
    at = 0
    while at < len(ga):
        to = max(at + 1, int(np.searchsorted(done, done[at] + PAIRS, "right")) - 1)
        own = np.repeat(np.arange(at, to), sizes[at:to])
        other = np.arange(len(own)) - np.repeat(done[at:to] - done[at], sizes[at:to]) + first[own]
        key, times = doc_of[ga[own]] * DOC + a[own] * WIDTH + b[other], na[own] * nb[other]
        if to < len(ga):
            key, times = summed(key, times)
        keys.append(key)
        links.append(times)
        at = to
    key, times = summed(np.concatenate(keys), np.concatenate(links))
    return key // DOC, key % DOC, times


class Aligner:
    """Both tokenizers, the bytes of their ids, and the text of each id behind each mark."""

    def __init__(self, a_path: str, b_path: str) -> None:
        known = load(a_path).text_of
        self.encode, (self.model, self.b_bytes) = encoder(a_path), pieces(b_path)
        self.a_bytes = [known.get(i, b"") for i in range(max(known) + 1)]
        self.lengths = [np.array([len(x) for x in table]) for table in (self.a_bytes, self.b_bytes)]
        self.size = max(map(len, (self.a_bytes, self.b_bytes)))
        self.texts = [f"{mark}{i}" for marks in MARKS for mark in marks for i in range(self.size)]

    def tokens(self, text: str) -> tuple[list[int], list[int]]:
        """The ids of both sides; none where the text is empty or one side's bytes aren't those of a space and the text."""
        if text:
            a, b = self.encode(" " + text), self.model.encode(text, num_threads=1)
            whole = (" " + text).encode()
            if b"".join(map(self.a_bytes.__getitem__, a)) == whole and b"".join(map(self.b_bytes.__getitem__, b)) == whole:
                return a, b
        return [], []

    def batch(self, rows: list, tokens: list[tuple[list[int], list[int]]]) -> pa.RecordBatch:
        """One row for each text: sizes, the digest of its groups, and its pairs with their number of links."""
        docs = np.arange(len(rows))
        n = [np.array([len(t[side]) for t in tokens], np.int64) for side in (0, 1)]
        ids, doc, starts, ends = [], [], [], []
        for side in (0, 1):
            flat = np.fromiter(chain.from_iterable(t[side] for t in tokens), np.int64, int(n[side].sum()))
            end = np.cumsum(self.lengths[side][flat]) if len(flat) else np.zeros(0, np.int64)
            ids.append(flat)
            doc.append(np.repeat(docs, n[side]))
            starts.append(end - self.lengths[side][flat] if len(flat) else end)
            ends.append(end)
        ids, doc, starts, ends = (np.concatenate(x) for x in (ids, doc, starts, ends))
        second = np.arange(len(ids)) >= n[0].sum()
        order = np.lexsort((second, starts))
        group = np.empty(len(order), np.int64)
        group[order] = coalesced(starts[order], ends[order])
        n_groups = int(group.max(initial=-1)) + 1
        doc_of = np.empty(n_groups, np.int64)
        doc_of[group] = doc
        sizes = [np.bincount(group[second == side], minlength=n_groups) for side in (False, True)]
        links = np.bincount(doc_of, weights=None, minlength=len(rows)), np.zeros(len(rows), np.int64)
        np.add.at(links[1], doc_of, sizes[0] * sizes[1])
        at, pair, times = linked(group, ids, second, doc_of)
        cuts = pa.array(np.searchsorted(at, np.arange(len(rows) + 1)), pa.int32())
        columns = {
            "doc_id": pa.array(rows, pa.int64()), "n_a": n[0], "n_b": n[1], "n_groups": links[0], "n_links": links[1], "groups_sha256": self.digests(ids, second, group, doc, len(rows)),
            "pairs": pa.ListArray.from_arrays(cuts, pa.array(pair, pa.int64())), "links": pa.ListArray.from_arrays(cuts, pa.array(times, pa.int64())),
        }
        return pa.RecordBatch.from_pydict(columns)

    def digests(self, ids: np.ndarray, second: np.ndarray, group: np.ndarray, doc: np.ndarray, rows: int) -> pa.Array:
        """The digest of each document's groups, written as a1,a2|b1;a3|b2,b3; '' for a document without tokens."""
        order = np.lexsort((second, group))  # stable, so tokens of one side stay in their order
        ids, second, group, doc = ids[order], second[order], group[order], doc[order]
        later = np.concatenate([[False], (group[1:] == group[:-1]) & (second[1:] == second[:-1])])[: len(ids)]
        texts = list(map(self.texts.__getitem__, ((second * 2 + later) * self.size + ids).tolist()))
        at = np.searchsorted(doc, np.arange(rows + 1)).tolist()
        return pa.array([hashlib.sha256("".join(texts[a:b])[1:].encode()).hexdigest() if b > a else "" for a, b in zip(at, islice(at, 1, None))], pa.string())


@lru_cache(maxsize=1)
def aligner(a_path: str, b_path: str) -> Aligner:
    return Aligner(a_path, b_path)


def aligned(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """A row for each row of docs: doc_id, the numbers of tokens, groups and links, the groups' digest, the different
    pairs of linked ids (a x WIDTH + b) and how many links each has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = aligner(a_path, b_path)
        rows, tokens, held = [], [], 0
        for batch in batches:
            for row, text in zip(batch["doc_id"], batch["text"]):
                text = text.as_py() or ""
                rows.append(row.as_py())
                tokens.append(own.tokens(text))
                held += len(text)
                if held >= CHUNK:
                    yield own.batch(rows, tokens)
                    rows, tokens, held = [], [], 0
        if rows:
            yield own.batch(rows, tokens)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, ALIGNED)


def pair_counts(rows: DataFrame) -> DataFrame:
    """Rows (pair, docs, best): how many documents hold a pair of ids linked, and whether none of its first id's pairs is
    in more. An id has at most as many pairs as the other vocabulary has ids."""
    held = rows.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("docs"))
    most = F.max("docs").over(W.partitionBy(F.floor(F.col("pair") / WIDTH)))
    return held.select("pair", "docs", (F.col("docs") == most).alias("best"))


def align(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every row of docs, whole texts.

    a_path is a byte-level tokenizer file, which encodes a space and the text, special tokens' strings as plain text;
    b_path a sentencepiece model, which adds the space. Tokens are intervals of bytes; those of both sides, sorted by
    start, fall into groups at the offsets where both sides end a token. All tokens of a group are linked across the
    sides. A text that is null, empty or not given back by the bytes of either side has no tokens, zeros and ''.
    n_best counts links whose pair no other pair of its first id exceeds in documents, count_sum adds the pairs'
    documents over all links. Repeated rows are documents each; other columns are left out.

    Texts are encoded once; their pairs are kept as numbers. Pairs of frequent tokens stand in most documents: those with
    at least one in HOT of all rows (document, pair) are broadcast, at most HOT, and only the others are joined, none
    of which is a hot key.
    """
    rows = stored(aligned(docs, a_path, b_path).withColumn("row", F.monotonically_increasing_id()))
    known = stored(pair_counts(rows))
    total = known.agg(F.coalesce(F.sum("docs"), F.lit(0))).head()[0]
    often = F.col("docs") * HOT >= total
    each = rows.select("row", F.explode(F.arrays_zip("pairs", "links")).alias("x")).select("row", F.col("x.pairs").alias("pair"), F.col("x.links").alias("n"))
    each = each.join(F.broadcast(known.where(often)), "pair", "left")
    found = each.where("docs is not null").unionByName(each.where("docs is null").select("pair", "row", "n").join(known.where(~often), "pair"))
    sums = found.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("docs")).alias("count_sum"))
    out = rows.drop("pairs", "links").join(sums, "row", "left")
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_best", "count_sum")], "groups_sha256")
