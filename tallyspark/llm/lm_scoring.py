"""Language-model scores from a log-frequency Bloom filter that holds quantised n-gram counts."""

from __future__ import annotations

import math
import re
import string
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from tallyspark.sources.shared import ROWS, dealt

from .common import BLANK_CHARS, BLANKS, stored

#: The token behind the last word; no word holds a blank.
END = b" "
#: Words of an n-gram; and the pseudo-count with which the shorter context weighs in.
ORDER, PRIOR = 2, 2.0
#: Counts are kept as levels, whose thresholds grow by this factor.
BASE = 1.5
#: Bits of the filter for each of its entries, and how many of them an entry sets, all in one 64-bit word.
BITS, PROBES = 10, 4
#: n-grams of the corpus that a segment of the filter answers for, on average at most.
SEGMENT = 1 << 20
#: A filter of up to this many bytes is broadcast; beyond it the n-grams travel to the segments, with the same result.
BROADCAST = 256 << 20
#: Tokens with at least this part of all occurrences are broadcast with their counts: never more than HOT of them.
HOT = 1 << 20
#: Bytes of texts that a task handles at a time; n-grams and tokens that it counts before it passes them on.
CHUNK, GRAMS, TOKENS = 1 << 20, 1 << 22, 1 << 22
#: n-grams that are looked up at a time, so that what is made of them stays near the processor; and how many levels a
#: task remembers, a power of two from 2**16 on.
PROBED, RECENT = 1 << 16, 1 << 18
#: Bytes of the texts that travel together where the filter is too large to be broadcast.
BLOCK = 8 << 20

BLANK = re.compile(f"[{BLANKS}]".encode())
#: What stands for each byte: A to Z lower-cased, and one blank for all.
FOLDED = bytes(ord(END) if chr(b) in BLANK_CHARS else b + 32 if chr(b) in string.ascii_uppercase else b for b in range(256))
GOLDEN, MIX_A, MIX_B = 0x9E3779B97F4A7C15, np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
SCORED = "doc_id long, n_tokens long, score double, hot_known long, hot_base double, rest array<binary>, rest_n array<long>"


def thresholds(base: float = BASE) -> np.ndarray:
    """The least count of each level: 1, then by the factor, rounded up, each above the one before."""
    out = [1]
    while out[-1] < 1 << 60:
        out.append(max(out[-1] + 1, math.ceil(out[-1] * base)))
    return np.array(out, np.uint64)


def estimates(base: float = BASE) -> np.ndarray:
    """The count that stands for each level, 0 for none: the middle of the counts that have it."""
    least = thresholds(base).astype(float)
    return np.concatenate([[0.0], (least[:-1] + least[1:] - 1) / 2])


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * MIX_A
    x = (x ^ (x >> np.uint64(27))) * MIX_B
    return x ^ (x >> np.uint64(31))


def scaled(x: np.ndarray, to: np.ndarray | np.uint64) -> np.ndarray:
    """The upper half of x as a part of `to`, a number below 2**32."""
    return ((x >> np.uint64(32)) * to) >> np.uint64(32)


def spots(grams: np.ndarray, level: int, words: np.ndarray | np.uint64) -> tuple[np.ndarray, np.ndarray]:
    """The word of a segment and the bits in it for entries (n-gram, level)."""
    x = mix(grams + np.uint64(level * GOLDEN % (1 << 64)))
    bits = np.zeros(len(x), np.uint64)
    for i in range(PROBES):
        bits |= np.uint64(1) << ((x >> np.uint64(6 * i)) & np.uint64(63))
    return scaled(x, words).astype(np.int64), bits


def slices(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[pa.Array, list[tuple[bytes, np.ndarray]]]]:
    """Some whole texts each, of up to `size` bytes or one text: their doc_id and texts end to end with the places of
    their ends, from 0. A longer text alone comes in several such parts, cut at blanks. Null texts are empty."""
    for batch in batches:
        texts = pc.fill_null(batch["text"], b"").cast(pa.large_binary())
        ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
        row = 0
        while row < len(texts):
            to = max(row + 1, int(np.searchsorted(ends, ends[row] + size, "right")) - 1)
            data, at, parts = texts.buffers()[2].slice(ends[row], ends[to] - ends[row]).to_pybytes() if ends[to] > ends[row] else b"", 0, []
            while len(data) - at > size:
                stop = BLANK.search(data, at + size)
                cut = stop.start() if stop else len(data)
                parts.append((data[at:cut], np.array([0, cut - at])))
                at = cut
            parts.append((data[at:], ends[row : to + 1] - ends[row] if not at else np.array([0, len(data) - at])))
            yield batch["doc_id"].slice(row, to - row), parts
            row = to


def words_in(data: bytes, ends: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The words of texts that lie end to end, A to Z lower-cased, and how many each text has."""
    folded = np.frombuffer(data.translate(FOLDED), np.uint8)
    inside = folded != ord(END)
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    heads = ends[:-1][ends[:-1] < len(folded)]
    first[heads] = inside[heads]
    counts = np.diff(np.searchsorted(np.flatnonzero(first), ends))
    letters = folded[inside]
    starts = np.append(np.flatnonzero(first[inside]), len(letters)).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(starts) - 1, [None, pa.py_buffer(starts), pa.py_buffer(letters)]), counts


@dataclass
class Chunk:
    """Some whole texts as numbers: each token's place in `names`, text after text, an END behind each."""

    rows: pa.Array
    names: pa.Array
    ids: np.ndarray
    lengths: np.ndarray

    @property
    def starts(self) -> np.ndarray:
        return np.cumsum(self.lengths) - self.lengths

    def place(self) -> np.ndarray:
        """Each token's place in its text, from 0."""
        return np.arange(len(self.ids)) - np.repeat(self.starts, self.lengths)

    @cached_property
    def listed(self) -> list[bytes]:
        return self.names.to_numpy(zero_copy_only=False).tolist()

    @cached_property
    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each name."""
        return hashed(self.listed)


def chunks(batches: Iterator[pa.RecordBatch], size: int = CHUNK) -> Iterator[Chunk]:
    """Chunks of batches with columns text (binary) and, as a chunk's rows, doc_id; null texts are empty."""
    for rows, parts in slices(batches, size):
        found = [words_in(*part) for part in parts]
        # The parts of a long text have its words one after the other; the END is the last name.
        coded = pa.chunked_array([words for words, _ in found] + [pa.array([END])]).dictionary_encode().combine_chunks()
        words = found[0][1] if len(found) == 1 else np.array([sum(counts.sum() for _, counts in found)])
        ids = np.asarray(coded.indices, np.int64)
        yield Chunk(rows, coded.dictionary, np.insert(ids[:-1], np.cumsum(words), ids[-1]), words + 1)


def hashed(names: Iterable[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(map(xxhash.xxh3_64_digest, names)), ">u8").astype(np.uint64)


def longer(grams: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Hashes of the n-grams that end at each token, from those of one word less; the first has no meaning."""
    out = np.zeros_like(grams)
    out[1:] = mix(grams[:-1] * MIX_B + hashes[1:])
    return out


def counted(grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each n-gram once, in rising order, and how often it is there."""
    grams = np.sort(grams)
    first = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]])[: len(grams)])
    return grams[first], np.diff(first, append=len(grams)).astype(np.uint64)


def training_text(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))


def vocabulary(docs: DataFrame) -> DataFrame:
    """Rows (token, c) of all tokens of docs, ends included; counted within each task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, total, ends = [], 0, 0

        def out(words: list[pa.Array]) -> pa.RecordBatch:
            seen = pc.value_counts(pa.chunked_array(words, pa.binary()))
            return pa.RecordBatch.from_arrays([seen.field("values"), seen.field("counts")], ["token", "c"])

        for rows, parts in slices(batches, CHUNK):
            ends += len(rows)
            for part in parts:
                kept.append(words_in(*part)[0])
                total += len(kept[-1])
                if total >= TOKENS:
                    yield out(kept)
                    kept, total = [], 0
        if kept:
            yield out(kept)
        if ends:
            yield pa.RecordBatch.from_arrays([pa.array([END]), pa.array([ends], pa.int64())], ["token", "c"])

    return training_text(docs).mapInArrow(run, "token binary, c long").groupBy("token").agg(F.sum("c").alias("c"))


def gram_counts(docs: DataFrame, order: int, segments: int) -> DataFrame:
    """Rows (seg, ones, many): packed hashes of a task's n-grams of up to `order` words for each segment of the filter;
    `many` has the counts of those that the task met more than once."""

    def packed(parts: list[np.ndarray]) -> pa.RecordBatch:
        grams, counts = counted(np.concatenate(parts))
        at = scaled(grams, np.uint64(segments))
        once = counts == 1
        held = np.unique(at)
        cut = lambda mask: (grams[mask], counts[mask], np.searchsorted(at[mask], held), np.searchsorted(at[mask], held, "right"))
        one, _, one_from, one_to = cut(once)
        many, sums, many_from, many_to = cut(~once)
        blobs = [one[a:b].tobytes() for a, b in zip(one_from, one_to)], [many[a:b].tobytes() + sums[a:b].tobytes() for a, b in zip(many_from, many_to)]
        return pa.RecordBatch.from_arrays([pa.array(held.astype(np.int64)), *(pa.array(x, pa.binary()) for x in blobs)], ["seg", "ones", "many"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, total = [], 0
        for chunk in chunks(batches):
            hashes, place = chunk.hashes[chunk.ids], chunk.place()
            grams = mix(hashes)
            for n in range(1, order + 1):
                grams = grams if n == 1 else longer(grams, hashes)
                parts.append(grams[place >= n - 1])
                total += len(parts[-1])
            if total >= GRAMS:
                yield packed(parts)
                parts, total = [], 0
        if parts:
            yield packed(parts)

    return training_text(docs).mapInArrow(run, "seg long, ones binary, many binary")


def segment(ones: list[bytes], many: list[bytes], base: float = BASE, bits: int = BITS) -> tuple[int, bytes]:
    """The entries and the words of one segment: an n-gram of level q has the entries (n-gram, 1) to (n-gram, q)."""
    single = np.frombuffer(b"".join(ones), np.uint64)
    pairs = [np.frombuffer(x, np.uint64).reshape(2, -1) for x in many if x]
    grams, counts = counted(np.concatenate([single, *(p[0] for p in pairs)]))
    for several, times in pairs:
        counts[np.searchsorted(grams, several)] += times - np.uint64(1)
    levels = np.searchsorted(thresholds(base), counts, "right")
    size = np.uint64(max(1, -(-int(levels.sum()) * bits // 64)))
    words = np.zeros(int(size), np.uint64)
    for level in range(1, int(levels.max(initial=0)) + 1):
        entered = grams[levels >= level]
        for i in range(0, len(entered), PROBED):
            np.bitwise_or.at(words, *spots(entered[i : i + PROBED], level, size))
    return int(levels.sum()), words.tobytes()


@dataclass
class Filter:
    """Segments of the filter, those that a worker holds: words end to end, where each segment starts and how long it is."""

    words: np.ndarray
    starts: np.ndarray
    sizes: np.ndarray

    @classmethod
    def of(cls, words: bytes | bytearray, sizes: np.ndarray) -> Filter:
        return cls(np.frombuffer(words, np.uint64), np.cumsum(sizes) - sizes, sizes.astype(np.uint64))

    def levels(self, grams: np.ndarray, most: np.ndarray | None = None) -> np.ndarray:
        """The level of each n-gram: probes for level 1, 2 and so on until one misses or `most` is reached."""
        parts = [self.some(grams[i : i + PROBED], None if most is None else most[i : i + PROBED]) for i in range(0, len(grams), PROBED)]
        return np.concatenate([np.zeros(0, np.uint8), *parts])

    def some(self, grams: np.ndarray, most: np.ndarray | None) -> np.ndarray:
        segments = scaled(grams, np.uint64(len(self.starts))).view(np.int64)
        start, size = self.starts.take(segments), self.sizes.take(segments)
        out = np.zeros(len(grams), np.uint8)
        more = live = np.flatnonzero(size if most is None else (size > 0) & (most > 0))
        level = 0
        while len(live):
            level += 1
            grams, start, size, most = grams.take(more), start.take(more), size.take(more), None if most is None else most.take(more)
            at, bits = spots(grams, level, size)
            there = (self.words.take(start + at) & bits) == bits
            out[live.compress(there)] = level
            more = np.flatnonzero(there if most is None else there & (most > level))
            live = live.take(more)
        return out


class Recent:
    """Levels of n-grams that a task has looked up lately: a word for each slot, which the low bits of an n-gram name, with
    the n-gram's upper 56 bits and its level. The limit of an n-gram is the same wherever it stands, as are its parts."""

    def __init__(self, filter: Filter) -> None:
        slots = np.arange(RECENT, dtype=np.uint64)
        self.filter, self.low = filter, np.uint64(0xFF)
        # No n-gram of a slot has these bits.
        self.held = ~slots & np.uint64(0xFF00)

    def levels(self, n: int, grams: np.ndarray, most: np.ndarray) -> np.ndarray:
        slots = (grams & np.uint64(RECENT - 1)).view(np.int64)
        held = self.held.take(slots)
        out = np.minimum((held & self.low).astype(np.uint8), most)
        new = np.flatnonzero(((held ^ grams) > self.low) & (most > 0))
        out[new] = found = self.filter.levels(grams.take(new), most.take(new))
        self.held[slots.take(new)] = (grams.take(new) & ~self.low) | found
        return out


@dataclass
class Model:
    """What training leaves: token counts and the filter's segments as tables, and a few numbers.

    tokens and types count all training tokens and the different ones; size is the filter's length in bytes.
    """

    vocab: DataFrame
    filter: DataFrame
    tokens: int
    types: int
    segments: int
    size: int
    order: int = ORDER
    prior: float = PRIOR
    base: float = BASE

    def gathered(self) -> tuple[bytearray, np.ndarray]:
        """All segments end to end, and the words of each; one partition's segments come to the driver at a time."""
        sizes = np.zeros(self.segments, np.int64)
        for r in self.filter.select("seg", (F.octet_length("words") / 8).cast("long").alias("n")).toLocalIterator():
            sizes[r["seg"]] = r["n"]
        starts, words = (np.cumsum(sizes) - sizes) * 8, bytearray(self.size)
        for r in self.filter.select("seg", "words").toLocalIterator():
            words[starts[r["seg"]] : starts[r["seg"]] + len(r["words"])] = r["words"]
        return words, sizes

    def hot(self) -> Hot:
        """The tokens that have at least one in HOT of all occurrences."""
        return Hot({bytes(r["token"]): r["c"] for r in self.vocab.where(F.col("c") * HOT >= self.tokens).collect()})


def train(docs: DataFrame, order: int = ORDER, prior: float = PRIOR, base: float = BASE, bits: int = BITS) -> Model:
    """A model of the whole texts of docs.

    Tasks count tokens and n-grams of their own rows first. n-grams travel as packed hashes to the segment of the
    filter that their hash names, where counts are summed, quantised and entered; segments grow in number with the
    corpus, not in size, and hashes fall evenly, so no frequent n-gram makes a large group. A null text counts as
    empty, which is one end; an empty table gives a model that knows nothing.
    """
    vocab = stored(vocabulary(docs))
    tokens, types = vocab.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).head()
    segments = max(1, -(-tokens * order // SEGMENT))

    def build(key: tuple, table: pa.Table) -> pa.Table:
        entries, words = segment(table["ones"].to_pylist(), table["many"].to_pylist(), base, bits)
        return pa.table({"seg": pa.array([key[0].as_py()], pa.int64()), "entries": pa.array([entries], pa.int64()), "words": pa.array([words], pa.binary())})

    parts = stored(gram_counts(docs, order, segments).groupBy("seg").applyInArrow(build, "seg long, entries long, words binary"))
    size = parts.agg(F.coalesce(F.sum(F.octet_length("words")), F.lit(0))).head()[0]
    return Model(vocab, parts, tokens, types, segments, size, order, prior, base)


def grams_of(chunk: Chunk, order: int) -> Iterator[np.ndarray]:
    """The hashes of the n-grams that end at each token, for 1 to `order` words."""
    hashes = chunk.hashes[chunk.ids]
    grams = mix(hashes)
    yield grams
    for _ in range(1, order):
        grams = longer(grams, hashes)
        yield grams


def log_probabilities(chunk: Chunk, names: np.ndarray, levels: Callable[[int, np.ndarray, np.ndarray], np.ndarray], tokens: int, types: int, order: int, prior: float, estimate: np.ndarray) -> np.ndarray:
    """log10 of each token's probability; names are the levels of the chunk's names, levels(n, grams, most) gives those of longer n-grams.

    With one word it is (c + 1) / (N + V + 1); each longer context h takes p to (c(h w) + prior x p) / (c(h) + prior).
    Counts are those of the filter. An n-gram is no more frequent than its two parts, so probes stop at their level.
    """
    place = chunk.place()
    known = p = None
    for n, grams in enumerate(grams_of(chunk, order)):
        if not n:
            known = names[chunk.ids]
            p = (estimate[known] + 1) / (tokens + types + 1)
            continue
        before = np.concatenate([[0], known[:-1]]).astype(np.uint8)
        before[place < n] = 0
        known = levels(n, grams, np.minimum(before, known))
        context = estimate[before]
        p = np.where(before > 0, (np.minimum(estimate[known], context) + prior * p) / (context + prior), p)
    return np.log10(p)


class Hot:
    """The frequent tokens: each token's number, and their counts; the last is 0, of all other tokens."""

    def __init__(self, counts: dict[bytes, int]) -> None:
        self.number = {token: i for i, token in enumerate(counts)}
        self.counts = np.array([*counts.values(), 0], np.int64)

    def of(self, chunk: Chunk) -> np.ndarray:
        """The number of each of the chunk's names."""
        get, other = self.number.get, len(self.number)
        return np.fromiter((get(name, other) for name in chunk.listed), np.int64, len(chunk.names))


def scored(chunk: Chunk, logs: np.ndarray, of: np.ndarray, whole: int) -> pa.RecordBatch:
    """A row for each text: its score, the base score of its hot tokens and the other tokens with their number; `of` has
    the counts of the chunk's hot names."""
    counts, starts = of[chunk.ids], chunk.starts
    base = np.where(of > 0, np.log10((of + 1) / whole), 0.0)[chunk.ids]
    rare = np.flatnonzero(counts == 0)
    rows = np.repeat(np.arange(len(starts)), chunk.lengths)[rare]
    pairs, times = np.unique(rows * len(chunk.names) + chunk.ids[rare], return_counts=True)
    ends = np.searchsorted(pairs // len(chunk.names), np.arange(len(starts) + 1))
    offsets = pa.array(ends, pa.int32())
    rest = chunk.names.take(pa.array(pairs % len(chunk.names)))
    columns = {
        "doc_id": chunk.rows, "n_tokens": pa.array(chunk.lengths, pa.int64()), "score": np.add.reduceat(logs, starts),
        "hot_known": np.add.reduceat((counts > 0).astype(np.int64), starts), "hot_base": np.add.reduceat(base, starts),
        "rest": pa.ListArray.from_arrays(offsets, rest), "rest_n": pa.ListArray.from_arrays(offsets, pa.array(times, pa.int64())),
    }
    return pa.RecordBatch.from_pydict(columns)


def by_broadcast(docs: DataFrame, model: Model) -> DataFrame:
    """Score with the whole filter on every worker."""
    context, order, prior, estimate = docs.sparkSession.sparkContext, model.order, model.prior, estimates(model.base)
    tokens, types = model.tokens, model.types
    held, frequent = context.broadcast(model.gathered()), context.broadcast(model.hot())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filter, hot = Filter.of(*held.value), frequent.value
        recent = Recent(filter)
        # Frequent tokens have the highest levels; they are looked up once, not in each chunk.
        known = np.append(filter.levels(mix(hashed(hot.number))), np.uint8(0))
        for chunk in chunks(batches):
            number = hot.of(chunk)
            names, rare = known[number], np.flatnonzero(number == len(hot.number))
            names[rare] = filter.levels(mix(chunk.hashes[rare]))
            logs = log_probabilities(chunk, names, recent.levels, tokens, types, order, prior, estimate)
            yield scored(chunk, logs, hot.counts[number], tokens + types + 1)

    return training_text(docs).mapInArrow(run, SCORED)


def by_segments(docs: DataFrame, model: Model, block: int = BLOCK) -> DataFrame:
    """Score where the filter is too large for a worker: blocks of documents send their different n-grams to the segments
    and get the levels back, in the n-grams' order. A segment answers all blocks at once."""
    context, order, prior, estimate = docs.sparkSession.sparkContext, model.order, model.prior, estimates(model.base)
    tokens, types, segments, frequent = model.tokens, model.types, model.segments, context.broadcast(model.hot())
    end = mix(hashed([END]))[0]

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, total = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            ends = total + np.cumsum(np.asarray(pc.binary_length(batch["text"]), np.int64))
            yield batch.append_column("block", pa.array(first + ends // block, pa.int64()))
            total = ends[-1] if len(ends) else total

    def all_grams(parts: list[Chunk]) -> list[list[np.ndarray]]:
        """For each chunk those of its names, then those of two words and more that end at each token. What reaches over a
        text's start is put as the END, so that the order of the texts, which Spark may change, adds none."""
        return [[np.where(chunk.place() >= n, g, end) if n else mix(chunk.hashes) for n, g in enumerate(grams_of(chunk, order))] for chunk in parts]

    def ask(key: tuple, table: pa.Table) -> pa.Table:
        found = counted(np.concatenate(sum(all_grams(list(chunks(iter(table.to_batches())))), [])))[0]
        at = scaled(found, np.uint64(segments)).astype(np.int64)
        held = np.unique(at)
        blobs = [found[a:b].tobytes() for a, b in zip(np.searchsorted(at, held), np.searchsorted(at, held, "right"))]
        return pa.table({"block": pa.array([key[0].as_py()] * len(held), pa.int64()), "seg": pa.array(held, pa.int64()), "grams": pa.array(blobs, pa.binary())})

    def answer(asked: pa.Table, held: pa.Table) -> pa.Table:
        words = held["words"][0].as_py() if len(held) else b""
        blobs = asked["grams"].to_pylist()
        levels = Filter.of(words, np.array([len(words) // 8])).levels(np.frombuffer(b"".join(blobs), np.uint64))
        ends = np.cumsum([0, *(len(x) // 8 for x in blobs)]).tolist()
        return asked.select(["block", "seg"]).append_column("levels", pa.array([levels[a:b].tobytes() for a, b in zip(ends, ends[1:])], pa.binary()))

    def finish(rows: pa.Table, answers: pa.Table) -> pa.Table:
        parts, hot = list(chunks(iter(rows.to_batches()))), frequent.value
        grams = all_grams(parts)
        levels = np.frombuffer(b"".join(answers.sort_by("seg")["levels"].to_pylist()), np.uint8)
        found = iter(np.split(levels[np.unique(np.concatenate(sum(grams, [])), return_inverse=True)[1]], np.cumsum([len(g) for g in sum(grams, [])])))
        out = []
        for chunk, own in zip(parts, grams):
            told = [next(found) for _ in own]
            logs = log_probabilities(chunk, told[0], lambda n, _, most: np.minimum(told[n], most), tokens, types, order, prior, estimate)
            out.append(scored(chunk, logs, hot.counts[hot.of(chunk)], tokens + types + 1))
        return pa.Table.from_batches(out)

    blocks = stored(training_text(docs).mapInArrow(numbered, "doc_id long, text binary, block long"))
    asked = blocks.groupBy("block").applyInArrow(ask, "block long, seg long, grams binary")
    answers = asked.groupBy("seg").cogroup(model.filter.groupBy("seg")).applyInArrow(answer, "block long, seg long, levels binary")
    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(finish, SCORED)


def score(docs: DataFrame, model: Model, broadcast: int = BROADCAST) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score and score of every row of docs, whole texts.

    A text's tokens are its words, A to Z lower-cased, and one end. base_score is the sum of log10((c + 1) / (N + V + 1))
    with exact training counts: those of tokens with at least one in HOT of all occurrences are broadcast, at most HOT
    numbers, the others are joined, and none of these is a hot key. score is the sum of the model's log10 probabilities,
    whose counts all come from the filter. Repeated rows are scored each, a null text as the empty one (one end), and
    other columns are left out. The filter is broadcast if it has at most `broadcast` bytes, else its segments are
    asked; the scores are the same.
    """
    rows = by_broadcast(docs, model) if model.size <= broadcast else by_segments(docs, model)
    rows = stored(rows.withColumn("row", F.monotonically_increasing_id()))
    whole = F.lit(float(model.tokens + model.types + 1))
    rest = rows.select("row", F.explode(F.arrays_zip("rest", "rest_n")).alias("t")).select("row", F.col("t.rest").alias("token"), F.col("t.rest_n").alias("n"))
    # A task has the rare tokens in a hash table, so that their occurrences, which are many more, are not sorted.
    tasks = max(-(-model.types // ROWS), docs.sparkSession.sparkContext.defaultParallelism)
    rare = dealt(model.vocab.where(F.col("c") * HOT < model.tokens), "token", tasks=tasks).hint("shuffle_hash")
    found = dealt(rest, "token", tasks=tasks).join(rare, "token")
    sums = found.groupBy("row").agg(F.sum("n").alias("known"), F.sum(F.col("n") * F.log10((F.col("c") + 1) / whole)).alias("base"))
    known: Column = F.col("hot_known") + F.coalesce("known", F.lit(0))
    both = rows.drop("rest", "rest_n").join(sums, "row", "left").withColumn("n_known", known.cast("long"))
    base = F.col("hot_base") + F.coalesce("base", F.lit(0.0)) - (F.col("n_tokens") - F.col("n_known")) * F.log10(whole)
    return both.select("doc_id", "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), base.alias("base_score"), "score")


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept out of training: crc32 of its id as text leaves 2 when divided by 7; a null id isn't."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 7 == 2, F.lit(False))
