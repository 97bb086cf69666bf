"""Which terms of a table a text holds, and where: automata of the terms, run over each text once."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F
from pyspark.sql.types import IntegerType, StringType, StructType

#: Letters of the terms that one automaton holds; a larger dictionary is cut into shards, each of which passes over the texts.
SHARD = 4_000_000
#: A dictionary of up to this many letters goes to the workers; a larger one is joined with the texts on first letters.
SENT = 64_000_000
#: Rows of hits that a task passes on at a time.
ROWS = 50_000

#: A table of up to this many terms becomes a list in the expression; a larger one is joined.
FEW = 64
#: Terms are joined on their first 8, 4, 2 or 1 letters, the most that they have.
KEYS = (8, 4, 2, 1)
#: Letters of a piece of text, in steps, so that no small piece is sought from the start of a long text.
PIECES = (32_768, 1_024, 64)


def pieces(df: DataFrame, size: int, over: int) -> DataFrame:
    """df with one row for each `size` places of _t; a piece of text goes on for `over` letters beyond its places.

    _at is added to the places of _t, and _own tells how many of them are a row's own.
    """
    starts = F.sequence(F.lit(0), F.floor((F.col("_own") - 1) / size).cast("int"))
    own = lambda i: F.least(F.lit(size), F.col("_own") - i * size).alias("own")
    parts = F.transform(starts, lambda i: F.struct((i * size + F.col("_at")).alias("at"), own(i), F.substr("_t", i * size + 1, F.lit(size + over)).alias("t")))
    rest = [c for c in df.columns if c not in ("_t", "_at", "_own")]
    return df.withColumn("_p", F.explode(parts)).select(*rest, F.col("_p.t").alias("_t"), F.col("_p.at").alias("_at"), F.col("_p.own").alias("_own"))


def key_size(term: Column) -> Column:
    n, size = F.length(term), F.lit(1)
    for k in sorted(KEYS):
        size = F.when(n >= k, k).otherwise(size)
    return size


def shards(words: list[str], size: int) -> list[list[str]]:
    """Words in lists of up to `size` letters, at least one word each."""
    out, room = [], 0
    for word in words:
        if len(word) > room:
            out.append([])
            room = size
        out[-1].append(word)
        room -= len(word)
    return out


_built: dict[str, ahocorasick.Automaton] = {}


def automaton(name: str, words: list[str]) -> ahocorasick.Automaton:
    """The automaton of a shard; a worker keeps the last one that it built."""
    if name not in _built:
        _built.clear()
        machine = ahocorasick.Automaton()
        for word in words:
            machine.add_word(word, len(word))
        machine.make_automaton()
        _built[name] = machine
    return _built[name]


def scanned(df: DataFrame, key: list[str], text: str, words: list[str], edges: str | None, head: int, context: int, keep: str, size: int) -> DataFrame:
    """Rows (key, at, _term, pre, post) of the places of words; `keep` is all, first (of each word) or best (the earliest
    place, then the longest word). One pass for each shard of the words, in which only hits leave a task."""
    rows = df.select(*key, F.col(text).alias("_t"))
    schema = StructType(list(df.select(*key).schema.fields)).add("at", IntegerType()).add("_term", StringType())
    schema = schema.add("pre", StringType()).add("post", StringType()) if context else schema
    context_of, edge = df.sparkSession.sparkContext, re.compile(edges) if edges else None

    def over(shard: list[str]) -> DataFrame:
        sent, name = context_of.broadcast(shard), uuid.uuid4().hex

        def found(machine: ahocorasick.Automaton, text: str) -> list[tuple[int, str]]:
            hits: list[tuple[int, str]] = []
            first: dict[str, int] = {}
            for end, length in machine.iter(text):
                at = end - length + 1
                if (head and at >= head) or (edge and at and not edge.fullmatch(text[at - 1])):
                    continue
                if keep == "best":
                    if not hits or (at, -length) < (hits[0][0], -len(hits[0][1])):
                        hits = [(at, text[at : end + 1])]
                elif keep == "first":
                    first.setdefault(text[at : end + 1], at)
                else:
                    hits.append((at, text[at : end + 1]))
            return hits if keep != "first" else [(at, term) for term, at in first.items()]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            machine = automaton(name, sent.value)

            def out(batch: pa.RecordBatch, of: list[int], hits: list[tuple]) -> pa.RecordBatch:
                columns = [pa.array([h[i] for h in hits], pa.int32() if not i else pa.string()) for i in range(4 if context else 2)]
                return pa.RecordBatch.from_arrays([*(batch[k].take(pa.array(of, pa.int64())) for k in key), *columns], schema.names)

            for batch in batches:
                of, hits = [], []
                for row, text in enumerate(batch["_t"]):
                    text = text.as_py()
                    for at, term in found(machine, text) if text else ():
                        of.append(row)
                        pad = text[max(at - context, 0) : at].rjust(context) if context else ""
                        hits.append((at + 1, term, pad, text[at + len(term) : at + len(term) + 1]))
                    if len(hits) >= ROWS:
                        yield out(batch, of, hits)
                        of, hits = [], []
                if hits:
                    yield out(batch, of, hits)

        return rows.mapInArrow(run, schema)

    parts = [over(shard) for shard in shards(words, size)]
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    if keep == "best" and len(parts) > 1:
        out = out.groupBy(*key).agg(F.min(F.struct("at", (-F.length("_term")).alias("n"), "_term")).alias("_b")).select(*key, "_b.at", "_b._term")
    return out


def places(df: DataFrame, key: list[str], text: str, terms: DataFrame, term: str, edges: str | None = None, head: int = 0, context: int = 0, keep: str = "all", sent: int = SENT, shard: int = SHARD) -> DataFrame:
    """Rows (key, at, the columns of terms) for the places, from 1, of the terms in the text; blank terms have none.

    With `edges`, a class of letters, only places at the text's start or behind such a letter count; with `head`, only
    those within the first `head` letters. With `context`, pre has up to that many letters before the place (filled
    with blanks at the text's start) and post the letter behind it. `keep` says which places: all, the first of each
    term, or the best, which is the earliest one and there the longest term. Text and terms are compared as they are; terms
    that agree give a row each.

    The different terms, up to `sent` letters in all, go to the workers as automata of up to `shard` letters, and each
    text is read once for each automaton, whatever the number of terms. Hits meet the dictionary's columns again by an
    equality join. A dictionary beyond that is joined by joined_places(), with the same rows.
    """
    known = terms.where(F.length(term) > 0)
    letters = known.agg(F.coalesce(F.sum(F.length(term)), F.lit(0))).head()[0]
    if letters > sent:
        hits = joined_places(df, key, text, terms, term, edges, head, context)
        if keep == "all":
            return hits
        best = F.col("at") if keep == "first" else F.struct("at", -F.length(term))
        order = W.partitionBy(*key, *([term] if keep == "first" else [])).orderBy(best)
        return hits.withColumn("_rank", F.rank().over(order)).where("_rank = 1").drop("_rank")
    words = [r[0] for r in known.select(term).distinct().collect()]
    if not words:
        rest = ["at", *terms.columns, *(["pre", "post"] if context else [])]
        kinds = {f.name: f.dataType for f in terms.schema} | {"at": IntegerType(), "pre": StringType(), "post": StringType()}
        return df.select(*key, *[F.lit(None).cast(kinds[c]).alias(c) for c in rest]).where("false")
    hits = scanned(df, key, text, words, edges, head, context, keep, shard)
    named = known.withColumn("_term", F.col(term))
    return hits.join(named, "_term").select(*key, "at", *terms.columns, *(["pre", "post"] if context else []))


def joined_places(df: DataFrame, key: list[str], text: str, terms: DataFrame, term: str, edges: str | None = None, head: int = 0, context: int = 0) -> DataFrame:
    """places() for a dictionary of any size: an equality join on first letters.

    Each place gives a row for each length in KEYS, with no more of the text than the longest term, and meets the terms
    that begin with the same letters; no text is paired with a term that it doesn't share letters with.
    """
    known = terms.where(F.length(term) > 0)
    longest, sizes = known.agg(F.coalesce(F.max(F.length(term)), F.lit(1)), F.collect_set(key_size(F.col(term)))).head()
    # Some letters stand before the text, so that each place has letters before it; an edge letter, if edges count.
    pad, own = max(context, 1), F.length(text)
    front = "\u0001" if edges else " "
    edges = rf"(?:{edges}|\u0001)" if edges else None
    rows = df.where(own > 0).select(*key, F.concat(F.lit(front * pad), F.col(text)).alias("_t"), F.lit(0).alias("_at"), (F.least(own, F.lit(head)) if head else own).alias("_own"))
    for size in PIECES:
        rows = pieces(rows, size, longest + pad + 1)
    if edges:
        # What is left of the piece from an edge on tells its place.
        found = F.regexp_extract_all("_t", F.lit(rf"(?s)(?=((?:{edges}).*))"), F.lit(1))
        each = rows.select(*key, "_at", "_own", F.length("_t").alias("_n"), F.explode(found).alias("_x")).withColumn("_i", F.col("_n") - F.length("_x") + 1)
    else:
        found = F.regexp_extract_all("_t", F.lit(rf"(?s)(?=(.{{{pad}}}.{{0,{longest + 1}}}))"), F.lit(1))
        each = rows.select(*key, "_at", "_own", F.posexplode(found).alias("_i", "_x")).withColumn("_i", F.col("_i") + 1)
    each = each.where(F.col("_i") <= F.col("_own")).select(*key, (F.col("_at") + F.col("_i")).alias("at"), F.substr("_x", F.lit(pad + 1), F.lit(longest + 1)).alias("rest"), *([F.substr("_x", F.lit(1), F.lit(pad)).alias("pre")] if context else []))
    keyed = each.withColumn("_k", F.explode(F.array(*[F.when(F.length("rest") >= k, F.substr("rest", F.lit(1), F.lit(k))) for k in sorted(sizes) or [1]])))
    named = known.withColumn("_k", F.substr(F.col(term), F.lit(1), key_size(F.col(term)))).withColumn("_term", F.col(term))
    hits = keyed.join(named, "_k").where(F.startswith("rest", F.col("_term")))
    if context:
        hits = hits.withColumn("post", F.substr("rest", F.length("_term") + 1, F.lit(1)))
    return hits.drop("_k", "_term", "rest")


def literal(value) -> Column:
    if isinstance(value, (list, tuple)):
        return F.array(*[literal(v) for v in value])
    return F.lit(value)


def held(df: DataFrame, key: list[str], text: str, terms: DataFrame, term: str) -> DataFrame:
    """Distinct rows (key, at, the columns of terms) of the terms that each text holds, at being the first place.

    Up to FEW terms are tested one after the other in the row, which needs no Python; more go through places().
    """
    few = terms.where(F.length(term) > 0).distinct().limit(FEW + 1).collect()
    names = terms.columns
    if len(few) > FEW:
        hits = places(df, key, text, terms.distinct(), term, keep="first")
    elif not few:
        return df.select(*key, F.lit(0).alias("at"), *[F.lit(None).cast(f.dataType).alias(f.name) for f in terms.schema]).where("false")
    else:
        listed = F.array(*[F.struct(*[literal(row[f.name]).cast(f.dataType).alias(f.name) for f in terms.schema]) for row in few])
        texts = df.select(*key, F.col(text).alias("_t"))
        each = texts.select(*key, "_t", F.explode(F.filter(listed, lambda x: F.contains("_t", x[term]))).alias("_h"))
        hits = each.withColumn("at", F.call_function("locate", F.col(f"_h.{term}"), F.col("_t"))).select(*key, "at", "_h.*")
    return hits.groupBy(*key, *names).agg(F.min("at").alias("at")).select(*key, "at", *names)
