"""Suffix-array dedup: repeated byte strings found by merging shards' Burrows-Wheeler transforms."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import stored

#: Bytes of a repeat; bytes of an anchor's own string.
LENGTH, GRAM = 200, 64
#: Contexts of one bucket that one task merges, in about 200 MB; a larger bucket is split by the letters around its anchor.
BUCKET = 60_000
#: Contexts of a shard, contexts merged at a time, bytes of a text that are hashed at a time.
SHARD, BATCH, CHUNK = 1024, 4096, 1 << 20
#: Anchors that leave a worker at a time.
ROWS = 100_000
#: The letter beyond a text's ends; no byte equals it.
END = 256
ODD = np.uint64(0x9E3779B97F4A7C15)


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = (a ^ (a >> np.uint64(32))) * ODD + b
    return (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    done = 1
    while done < width:
        step = min(done, width - done)
        x = np.minimum(x[:-step], x[step:])
        done += step
    return x


def _packed(data: np.ndarray, width: int) -> np.ndarray:
    """The `width` (1, 2, 4 or 8) bytes from each place on, as one number."""
    x = data
    for size, kind in ((1, np.uint16), (2, np.uint32), (4, np.uint64)):
        if size >= width:
            break
        wide = x.astype(kind)
        x = wide[:-size] | (wide[size:] << kind(8 * size))
    return x.astype(np.uint64)


def anchors(data: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Position, digest and context digest of every anchor of a text.

    An anchor is a string of `gram` bytes (a power of two) whose digest is the least in some window of `length` bytes.
    What is an anchor in a window depends on the window's bytes alone, so equal windows have equal anchors at equal
    places, and every window has one. The context is all that windows with the anchor can reach: length - gram bytes
    before it to length bytes from its start, cut at the text's ends. Its digest takes it in units of up to 8 bytes,
    each with a multiplier of its own.
    """
    n, reach, unit = len(data), length - gram, min(gram, 8)
    if n < length:
        none = np.zeros(0, np.int64)
        return none, none, none
    units = _mix(_packed(data, unit), np.uint64(length))
    h, size = units, unit
    while size < gram:
        h = _mix(h[:-size], h[size:])
        size *= 2
    order = (h >> np.uint64(32)).astype(np.uint32)
    low = _sliding_min(order, reach + 1)
    edge = np.zeros(reach, np.uint32)
    high = ~_sliding_min(~np.concatenate([edge, low, edge]), reach + 1)
    at = np.flatnonzero(order == high)
    start, end = np.maximum(at - reach, 0), np.minimum(at + length, n)
    steps = np.arange(0, reach + length, unit)
    places = np.minimum(start[:, None] + steps, (end - unit)[:, None])
    each = units[places] * (_mix(steps.astype(np.uint64), ODD) | np.uint64(1))
    context = _mix((each ^ (each >> np.uint64(32))).sum(axis=1, dtype=np.uint64), ((at - start) * 4096 + (end - at)).astype(np.uint64))
    return at, h[at].view(np.int64), context.view(np.int64)


def anchors_whole(data: np.ndarray, length: int = LENGTH, gram: int = GRAM, chunk: int = CHUNK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """anchors() of a text of any length: blocks overlap so far that each anchor is seen with its whole context."""
    n, lap = len(data), 3 * length
    if n <= chunk + 2 * lap:
        return anchors(data, length, gram)
    parts = []
    for start in range(0, n, chunk):
        low, high = max(0, start - lap), min(n, start + chunk + lap)
        at, h, c = anchors(data[low:high], length, gram)
        mine = (at + low >= start) & (at + low < start + chunk)
        parts.append((at[mine] + low, h[mine], c[mine]))
    return tuple(np.concatenate(p) for p in zip(*parts))


def _column_order(order: np.ndarray, bucket: np.ndarray, letters: np.ndarray) -> np.ndarray:
    """The stable order by bucket and letter: one step of LF mapping inside each bucket."""
    return np.argsort(bucket * (END + 1) + letters, kind="stable")


def shard_bwt(texts: np.ndarray, bucket: np.ndarray) -> np.ndarray:
    """For each column, the letters in the order of the suffixes that start behind it, bucket by bucket."""
    n, width = texts.shape
    out, order = np.empty((width, n), np.uint16), np.arange(n)
    for j in range(width - 1, -1, -1):
        out[j] = texts[order, j]
        order = order[_column_order(order, bucket, out[j].astype(np.int64))]
    return out


def merged(bwts: list[np.ndarray], buckets: list[np.ndarray], length: int, columns: int) -> list[np.ndarray]:
    """Merge shards' transforms: for each shard, a table (row, column) of windows that a row elsewhere repeats.

    The interleave says which shard each place of the merged order belongs to. Going through the columns from the
    last, it is refined by a stable sort on the letters that the shards' transforms give in its order; no suffix is
    compared. The common prefix of neighbours follows from the last column's: one more than the least between
    their old places if their letters agree, else nothing. Where it reaches `length`, the interval repeats.
    """
    start = np.argsort(np.concatenate(buckets), kind="stable")
    shard = np.repeat(np.arange(len(bwts)), [b.shape[1] for b in bwts])[start]
    row = np.concatenate([np.arange(b.shape[1]) for b in bwts])[start]
    bucket = np.concatenate(buckets)[start]
    n = len(bucket)
    first = np.concatenate([[True], bucket[1:] != bucket[:-1]])
    common = np.zeros(n + 1, np.int64)
    out = [np.zeros((b.shape[1], columns), bool) for b in bwts]
    letters = np.empty(n, np.int64)
    for j in range(bwts[0].shape[0] - 1, -1, -1):
        for s, bwt in enumerate(bwts):
            letters[shard == s] = bwt[j]
        order = np.argsort(bucket * (END + 1) + letters, kind="stable")
        same = ~first[1:] & (letters[order[1:]] == letters[order[:-1]])
        low, high = order[:-1][same] + 1, order[1:][same] + 1
        fresh = np.zeros(n + 1, np.int64)
        if len(low):
            spans = np.minimum.reduceat(common, np.column_stack([low, high]).ravel())[::2]
            fresh[1:n][same] = 1 + spans
        common, shard, row = fresh, shard[order], row[order]
        if j < columns:
            hit = (common[:-1] >= length) | (common[1:] >= length)
            for s in range(len(bwts)):
                mine = hit & (shard == s)
                out[s][row[mine], j] = True
    return out


def _runs(flags: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return [(int(a), int(b)) for a, b in zip(edge[::2], edge[1::2])]


def repeats(rows: list[tuple], length: int = LENGTH, gram: int = GRAM, shard: int = SHARD) -> Iterator[tuple[int, int, int, int]]:
    """(h, c, low, high): windows of context c that start low to high - 1 bytes from the anchor are repeated.

    rows (key, h, c, n, low, high, left, context) hold whole buckets in the order of key; n is how often the context
    occurs, and a row asks for windows from low to high - 1 only.
    """
    reach = length - gram
    bucket = np.cumsum([0] + [a[0] != b[0] for a, b in zip(rows, rows[1:])])
    texts = np.full((len(rows), reach + length), END, np.uint16)
    for i, (*_, left, context) in enumerate(rows):
        texts[i, reach - left : reach - left + len(context)] = np.frombuffer(context, np.uint8)
    parts = [slice(s, s + shard) for s in range(0, len(rows), shard)]
    found = np.concatenate(merged([shard_bwt(texts[p], bucket[p]) for p in parts], [bucket[p] for p in parts], length, reach + 1))
    for i, (_, h, c, n, low, high, left, context) in enumerate(rows):
        starts = np.zeros(reach + 1, bool)
        starts[max(reach - left, reach + low) : max(reach - left, min(reach - left + len(context) - length + 1, reach + high))] = True
        for a, b in _runs(starts if n > 1 else found[i] & starts):
            yield h, c, a - reach, b - reach


def halved(row: tuple, length: int = LENGTH) -> Iterator[tuple]:
    """A row (key, h, c, n, low, high, left, context) for each half of its windows, if the context has one of them: the key
    is the digest of the bytes that all windows of the half share, so equal windows stay together."""
    _, h, c, n, low, high, left, context = row
    middle = (low + high) // 2
    for a, b in ((low, middle), (middle, high)):
        if max(a, -left) <= min(b - 1, len(context) - left - length):
            shared = context[left + b - 1 : left + a + length]
            key = int.from_bytes(hashlib.md5(b"%d,%d:%b" % (h, a, shared)).digest()[:8], "big", signed=True)
            yield key, h, c, n, a, b, left, context


def _bytes(text: pa.Scalar) -> np.ndarray:
    return np.frombuffer((text.as_py() or "").encode("utf-8", "surrogatepass"), np.uint8)


def _marks(keyed: DataFrame, length: int, gram: int, bucket: int, found: DataFrame) -> DataFrame:
    """(h, c, low, high) of repeated windows for the anchors in `found` (doc_id, tid, pos, h, c), each h with more
    than one context."""
    reach = length - gram
    contexts = found.groupBy("h", "c").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "tid", "pos")).alias("at"))
    kinds = contexts.groupBy("h").agg(F.count("*").alias("kinds"))
    contexts = stored(contexts.join(kinds, "h"))
    many = contexts.select("at.doc_id", "at.tid", F.struct("at.pos", "h", "c", "n", (F.col("kinds") > bucket).alias("big")).alias("a"))
    wanted = many.groupBy("doc_id", "tid").agg(F.collect_list("a").alias("a")).withColumnsRenamed({"doc_id": "w_doc", "tid": "w_tid"})
    there = keyed.join(wanted, F.col("doc_id").eqNullSafe(F.col("w_doc")) & (F.col("tid") == F.col("w_tid"))).select("text", "a")
    names = ("key", "h", "c", "n", "low", "high", "left", "context")
    types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary())
    schema = "key long, h long, c long, n long, low int, high int, left int, context binary"

    def emit(out: list[tuple], more: tuple = (), kinds: tuple = ()) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((*types, *kinds))], [*names, *more])

    def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for batch in batches:
            for text, marks in zip(batch["text"], batch["a"]):
                data = _bytes(text).tobytes()
                for a in marks.as_py():
                    left = min(a["pos"], reach)
                    out.append((a["h"], a["h"], a["c"], a["n"], -reach, 1, left, data[a["pos"] - left : a["pos"] + length], a["big"]))
                if len(out) >= BATCH:
                    yield emit(out, ("big",), (pa.bool_(),))
                    out = []
        if out:
            yield emit(out, ("big",), (pa.bool_(),))

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        return (row for batch in batches for row in zip(*(batch[c].to_pylist() for c in names)))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(rows: list[tuple]) -> pa.RecordBatch:
            out = list(repeats(rows, length, gram))
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int32(), pa.int32()))], ["h", "c", "low", "high"])

        held: list[tuple] = []
        for _, group in groupby(rows_of(batches), key=lambda r: r[0]):
            held += {row[1:3]: row for row in group}.values()
            if len(held) >= BATCH:
                yield done(held)
                held = []
        if held:
            yield done(held)

    def halve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for row in rows_of(batches):
            out += halved(row, length)
            if len(out) >= BATCH:
                yield emit(out)
                out = []
        if out:
            yield emit(out)

    settled = lambda df: df.repartition("key").sortWithinPartitions("key").mapInArrow(merge, "h long, c long, low int, high int")
    pieces = there.mapInArrow(cut_out, schema + ", big boolean")
    if contexts.where(F.col("kinds") > bucket).isEmpty():
        return settled(pieces.drop("big"))
    pieces = stored(pieces)
    parts = [settled(pieces.where("not big").drop("big"))]
    rest, width = pieces.where("big").drop("big").dropDuplicates(["h", "c"]), reach + 1
    while width > 1 and not rest.isEmpty():
        width = (width + 1) // 2
        rest = stored(rest.mapInArrow(halve, schema))
        large = stored(rest.groupBy("key").agg(F.count("*").alias("kinds")).where(F.col("kinds") > bucket).select("key"))
        parts.append(settled(rest.join(large, "key", "left_anti").select(*names)))
        rest = stored(rest.join(large, "key", "left_semi").select(*names))
    # What is left has one window a row, and a bucket is one window: that of more than `bucket` contexts.
    return reduce(DataFrame.unionByName, [*parts, rest.select("h", "c", "low", "high")])


def suffix_dedup(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, bucket: int = BUCKET, texts: bool = False) -> DataFrame:
    """Cut out every byte that a `length`-byte string covers which also starts anywhere else.

    Returns doc_id, n_bytes, n_removed, n_spans (maximal removed runs) and kept_sha256 of the bytes that stay;
    with texts=True also kept, those bytes. Texts are UTF-8 bytes, null and empty ones have none; strings do not
    cross documents; both may stand in one document and overlap; all is judged on the input. Every copy goes, the
    first one too, so each of two equal rows longer than length loses all. Long texts are read whole, in blocks.
    Other columns are left out; an empty table gives an empty result.

    Anchors cut the suffixes into buckets: equal windows share an anchor, so a bucket of equal anchor strings
    holds all windows that can be equal to one of its own. Counting digests settles two cases without a merge: an
    anchor string that occurs once has no repeat, and one whose occurrences all have the same context is one repeated
    interval; most repeats of whole copies end there. In the other buckets, equal contexts are one row with a count.
    The different ones are split into shards, each has its Burrows-Wheeler transform over contexts aligned at the
    anchor, and the shards' transforms are merged by interleave refinement. A bucket of more than `bucket` contexts is
    split by the letters around the anchor: its windows are halved by where they start, and each half's contexts go by
    the bytes that all its windows share, again and again, until a bucket is small enough to be merged. Where one window
    is left, its bucket is that window's.
    """
    reach = length - gram
    keyed = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text", F.lit(1)).alias("tid"), "text")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.int64(), pa.int64())
        for batch in batches:
            parts: list[tuple] = []
            held = 0
            for i, text in enumerate(batch["text"]):
                data = _bytes(text)
                at, h, c = anchors_whole(data, length, gram)
                parts.append((np.full(len(at), i), at, h, c))
                held += len(at)
                if held >= ROWS or i + 1 == batch.num_rows:
                    columns = [np.concatenate(x) for x in zip(*parts)]
                    of = pa.array(columns[0])
                    yield pa.RecordBatch.from_arrays([batch["doc_id"].take(of), batch["tid"].take(of), *(pa.array(x, t) for x, t in zip(columns[1:], kinds))], ["doc_id", "tid", "pos", "h", "c"])
                    parts, held = [], 0

    every = keyed.mapInArrow(find, "doc_id long, tid long, pos long, h long, c long")
    counted = every.groupBy("h").agg(F.count("*").alias("n"), F.min("c").alias("a"), F.max("c").alias("b"))
    hot = stored(counted.where("n > 1").select("h", (F.col("a") == F.col("b")).alias("alone")))
    found = stored(every.join(hot, "h").select("doc_id", "tid", "pos", F.when(~F.col("alone"), F.col("h")).alias("h"), F.when(~F.col("alone"), F.col("c")).alias("c")))
    shared = found.where("h is not null")
    marks = _marks(keyed, length, gram, bucket, shared)
    span = lambda low, end: F.struct(low.alias("s"), end.alias("e")).alias("span")
    whole = found.where("h is null").select("doc_id", "tid", span(F.col("pos") - reach, F.col("pos") + length))
    spans = shared.join(marks, ["h", "c"]).select("doc_id", "tid", span(F.col("pos") + F.col("low"), F.col("pos") + F.col("high") - 1 + length)).unionByName(whole)
    gone = spans.groupBy("doc_id", "tid").agg(F.collect_set("span").alias("spans")).withColumnsRenamed({"doc_id": "w_doc", "tid": "w_tid"})
    both = keyed.join(gone, F.col("doc_id").eqNullSafe(F.col("w_doc")) & (F.col("tid") == F.col("w_tid")), "left").select("doc_id", "text", "spans")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, spans in zip(batch["text"], batch["spans"]):
                data = _bytes(text).tobytes()
                keep, at, runs, gone = [], 0, 0, 0
                for s, e in sorted((max(x["s"], 0), min(x["e"], len(data))) for x in spans.as_py() or []):
                    if runs == 0 or s > at:
                        keep.append(data[at:s])
                        runs += 1
                        gone += e - s
                    elif e > at:
                        gone += e - at
                    at = max(at, e)
                left = b"".join([*keep, data[at:]])
                rows.append((len(data), gone, runs, hashlib.sha256(left).hexdigest(), left if texts else None))
            columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()))]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *columns], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    out = both.mapInArrow(finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    return out if texts else out.drop("kept")
