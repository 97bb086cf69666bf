"""Exact top-k search by inner product with a KD-tree for each shard."""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .common import cut

#: Rows of a shard and queries sent to it at a time, on average; rows of a leaf; queries bounded at a time.
SHARD, SENT, LEAF, BLOCK = 8192, 4096, 128, 256
#: The top splits: rows that they are fitted on, and the most cells that they make. More shards share a cell.
SAMPLE, CELLS = 16_384, 1024
LONG = (-(2**63), 2**63 - 1)


def quantised(vector: Column, scale: int = 256) -> Column:
    """floor(scale x component) as double; null if a component is null or not finite."""
    whole = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.when(whole, F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("double")))


class KdTree:
    """Median splits along the widest side; every node has the tight bounding box of its rows."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, leaf: int = LEAF, numbers: np.ndarray | None = None) -> None:
        order = np.arange(len(ids))
        lows, highs, kids, spans = [], [], [], []
        todo = [(0, len(ids), -1, 0)]
        while todo:
            start, end, parent, side = todo.pop()
            part = rows[order[start:end]]
            low, high = part.min(axis=0), part.max(axis=0)
            me = len(kids)
            lows.append(low)
            highs.append(high)
            spans.append((start, end))
            kids.append([-1, -1])
            if parent >= 0:
                kids[parent][side] = me
            widest = int(np.argmax(high - low)) if rows.shape[1] else 0
            if end - start > leaf and rows.shape[1] and high[widest] > low[widest]:
                middle = (end - start) // 2
                order[start:end] = order[start:end][np.argpartition(part[:, widest].astype(float), middle)]
                todo += [(start, start + middle, me, 0), (start + middle, end, me, 1)]
        self.ids, self.rows = ids[order], rows[order]
        self.numbers = self.ids if numbers is None else numbers[order]
        self.low, self.high, self.kids, self.spans = np.array(lows), np.array(highs), kids, spans

    def search(self, query: np.ndarray, bounds: np.ndarray, k: int, skip: int, floor: float) -> list[tuple[int, int]]:
        """The k best (score, vec_id), ties to the smaller id; a node whose bound is under the kth score is left out.

        bounds: the most that a row in each node's box can score; skip: the query's own row number; floor: a score
        that k rows elsewhere reach.
        """
        best: list[tuple[int, int]] = []
        heap = [(-bounds[0], 0)]
        while heap:
            bound, node = heapq.heappop(heap)
            if -bound < floor:
                break
            start, end = self.spans[node]
            left, right = self.kids[node]
            if left >= 0:
                heapq.heappush(heap, (-bounds[left], left))
                heapq.heappush(heap, (-bounds[right], right))
                continue
            scores = self.rows[start:end] @ query
            good = np.flatnonzero(scores >= floor)
            if len(good) > 4 * k:
                good = good[scores[good] >= np.sort(scores[good])[-k - 1]]
            if len(good) > 4 * k:  # ties: the smallest ids, and one more in case the query is among them
                better = good[scores[good] > scores[good].min()]
                equal = good[scores[good] == scores[good].min()]
                good = np.concatenate([better, equal[np.argsort(self.ids[start:end][equal], kind="stable")[: k + 1]]])
            best += [(min(max(int(scores[i]), LONG[0]), LONG[1]), -int(self.ids[start + i])) for i in good if self.numbers[start + i] != skip]
            if len(best) > k:
                best = heapq.nlargest(k, best)
            if len(best) >= k:
                floor = max(floor, min(best)[0])
        return [(score, -i) for score, i in heapq.nlargest(k, best)]


def _matrix(values, wide: int) -> np.ndarray:
    """Rows of one width: shorter vectors are filled with zeros. Whole numbers beyond float's become Python's."""
    sizes = np.array([len(v) for v in values], int)
    out = np.zeros((len(values), wide))
    if sizes.any():
        column = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        out[np.repeat(np.arange(len(values)), sizes), column] = np.concatenate([np.asarray(v, float) for v in values if len(v)])
    return out


def _exact(rows: np.ndarray, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both as float64 if every score is a whole number below 2**53, else as Python's integers."""
    most = np.abs(rows).max(initial=0) * np.abs(queries).max(initial=0) * max(1, rows.shape[1])
    if most < 2**53:
        return rows, queries
    whole = np.frompyfunc(int, 1, 1)
    return whole(rows), whole(queries)


def _search(left: pd.DataFrame, right: pd.DataFrame, k: int) -> pd.DataFrame:
    """One shard's tree against the queries that were sent to it, block after block."""
    out: dict[str, list] = {"asked": [], "vec_id": [], "score": []}
    if len(left) and len(right):
        wide = max(left["vector"].map(len).max(), right["query"].map(len).max())
        rows, queries = _exact(_matrix(left["vector"].tolist(), wide), _matrix(right["query"].tolist(), wide))
        tree = KdTree(left["vec_id"].to_numpy(), rows, numbers=left["number"].to_numpy())
        floors = right["floor"].astype(float).fillna(-np.inf).to_numpy() if "floor" in right else np.full(len(right), -np.inf)
        asked = right["asked"].to_numpy()
        for start in range(0, len(right), BLOCK):
            block = queries[start : start + BLOCK]
            bounds = reach(block, tree.low, tree.high)
            for j, query in enumerate(block):
                i = start + j
                for score, vec in tree.search(query, bounds[j], k, asked[i], floors[i]):
                    out["asked"].append(int(asked[i]))
                    out["vec_id"].append(vec)
                    out["score"].append(score)
    return pd.DataFrame(out).astype("int64")


def reach(queries: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """For each query and box the most that a row in the box can score."""
    return np.where(queries > 0, queries, 0) @ high.T + np.where(queries < 0, queries, 0) @ low.T


def top_splits(rows: np.ndarray, cells: int) -> list[tuple[int, float, int, int]]:
    """Median splits of a sample along the widest side: nodes (side, value, left, right); a cell is -1 - its number."""
    nodes: list[list] = []
    todo, made = [(np.arange(len(rows)), -1, 0)], 0
    while todo:
        part, parent, branch = todo.pop(0)
        child = -1 - made
        if made + len(todo) + 1 < cells and len(part) > 1 and rows.shape[1]:
            values = rows[part]
            side = int(np.argmax(values.max(axis=0) - values.min(axis=0)))
            middle = float(np.median(values[:, side]))
            below = values[:, side] < middle
            if below.any():
                child = len(nodes)
                nodes.append([side, middle, 0, 0])
                todo += [(part[below], child, 2), (part[~below], child, 3)]
        if child < 0:
            made += 1
        if parent >= 0:
            nodes[parent][branch] = child
    return [tuple(n) for n in nodes]


def cells_of(rows: np.ndarray, nodes: list[tuple[int, float, int, int]]) -> np.ndarray:
    """The cell of each row; a side beyond a row's width counts as 0."""
    out = np.zeros(len(rows), int)
    todo = [(0, np.arange(len(rows)))] if nodes else []
    while todo:
        at, part = todo.pop()
        side, value, left, right = nodes[at]
        below = (rows[part, side] if side < rows.shape[1] else np.zeros(len(part))) < value
        for child, some in ((left, part[below]), (right, part[~below])):
            if child < 0:
                out[some] = -1 - child
            elif len(some):
                todo.append((child, some))
    return out


def _cells(nodes: list, wide: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell = cells_of(_matrix(batch["vector"].to_pylist(), wide), nodes)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32())], [*batch.schema.names, "cell"])

    return run


def _visits(cells: np.ndarray, low: np.ndarray, high: np.ndarray) -> Callable:
    """Which cells each query must see: those whose box reaches the query's floor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            most = reach(_matrix(batch["query"].to_pylist(), low.shape[1]), low, high)
            floors = np.array([-np.inf if f is None else f for f in batch["floor"].to_pylist()])
            # A float product may be off in the last places; a box within that of the floor is seen.
            seen = most + 1e-9 * np.abs(most) + 1 >= floors[:, None]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([cells[row].tolist() for row in seen], pa.list_(pa.int32()))], [*batch.schema.names, "cells"])

    return run


def top_k(vectors: DataFrame, queries: Column, k: int = 5, scale: int = 256, shard: int = SHARD, sent: int = SENT, cells: int = CELLS) -> DataFrame:
    """The k best rows by inner product for every row that `queries` holds for: query_id, rank, vec_id, score.

    Vectors (vec_id, embedding) are cut to whole numbers floor(scale x component). Null vectors and those with a
    null or non-finite component take no part; an empty vector scores 0 and a shorter one is filled with zeros.
    Ties go to the smaller vec_id. Every row but the query's own is a candidate, so rows that repeat a vec_id count
    each, and a repeated query row is answered each time. Fewer candidates than k give fewer rows; empty tables give
    none. Null ids are left out, other columns too. A score beyond a long counts as the nearest long.

    Median splits, fitted on SAMPLE rows at most (chosen by digest; every row is then dealt by them), part the space
    into cells; a cell of more than `shard` rows is dealt to several shards. Each shard gets a KD-tree. A query first
    searches one shard of its own cell; its kth score there goes with it as the floor, and it is sent only to shards
    in cells whose tight box can reach the floor. The boxes' table, two numbers for each
    component of each of at most `cells` cells, comes to the driver. A shard meets its queries in blocks of about `sent`, and returns k rows a query.
    """
    rows = vectors.where("vec_id is not null").select(F.col("vec_id").cast("long"), quantised(F.col("embedding"), scale).alias("vector"), F.coalesce(queries, F.lit(False)).alias("asks"))
    rows = cut(rows.where("vector is not null").withColumn("number", F.monotonically_increasing_id()))
    count, wide = rows.agg(F.count("*"), F.coalesce(F.max(F.size("vector")), F.lit(0))).head()
    wanted = min(cells, max(1, -(-count // shard)))
    sample = [r["vector"] for r in rows.orderBy(F.xxhash64("number", "vec_id")).limit(SAMPLE).select("vector").collect()] if wanted > 1 else []
    nodes = top_splits(_matrix(sample, wide), wanted) if sample else []
    celled = cut(rows.mapInArrow(_cells(nodes, wide), "vec_id long, vector array<double>, asks boolean, number long, cell int"))
    parts = celled.groupBy("cell").agg(F.ceil(F.count("*") / shard).cast("int").alias("parts"))
    part = F.pmod(F.xxhash64("number"), F.col("parts")).cast("int")
    home = cut(celled.join(F.broadcast(parts), "cell").withColumn("part", part))
    asked = home.where("asks").select(F.col("number").alias("asked"), F.col("vec_id").alias("query_id"), F.col("vector").alias("query"), "cell", "part")
    kind = "asked long, vec_id long, score long"
    near = cut(home.groupBy("cell", "part").cogroup(asked.groupBy("cell", "part")).applyInPandas(lambda a, b: _search(a, b, k), kind))
    found = near
    if home.select("cell", "part").distinct().count() > 1:
        filled = F.transform(F.sequence(F.lit(0), F.lit(max(wide, 1) - 1)), lambda i: F.coalesce(F.get("vector", i), F.lit(0.0)))
        sides = home.select("cell", F.posexplode(filled).alias("side", "x")).groupBy("cell", "side").agg(F.min("x").alias("low"), F.max("x").alias("high")).collect()
        numbers = sorted({r["cell"] for r in sides})
        place = {cell: i for i, cell in enumerate(numbers)}
        low, high = np.zeros((2, len(numbers), max(wide, 1)))
        for r in sides:
            at = place[r["cell"]], r["side"]
            low[at], high[at] = r["low"], r["high"]
        floors = near.groupBy("asked").agg(F.count("*").alias("n"), F.min("score").alias("least")).where(F.col("n") >= k)
        going = asked.join(floors.select("asked", F.col("least").cast("double").alias("floor")), "asked", "left")
        kinds = "asked long, query array<double>, cell int, part int, floor double, cells array<int>"
        going = going.select("asked", "query", "cell", "part", "floor").mapInArrow(_visits(np.array(numbers), low, high), kinds)
        there = going.select("asked", "query", "floor", F.col("cell").alias("own"), F.col("part").alias("own_part"), F.explode("cells").alias("cell")).join(F.broadcast(parts), "cell")
        there = there.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).where("cell != own or part != own_part")
        guests = cut(there.select("asked", "query", "floor", "cell", "part"))
        blocks = guests.groupBy("cell", "part").agg(F.ceil(F.count("*") / sent).cast("int").alias("blocks"))
        left = home.join(blocks, ["cell", "part"]).select("vec_id", "vector", "number", "cell", "part", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
        right = guests.join(blocks, ["cell", "part"]).select("asked", "query", "floor", "cell", "part", F.pmod(F.hash("asked"), F.col("blocks")).alias("block"))
        found = near.union(left.groupBy("cell", "part", "block").cogroup(right.groupBy("cell", "part", "block")).applyInPandas(lambda a, b: _search(a, b, k), kind))
    rank = F.row_number().over(W.partitionBy("asked").orderBy(F.col("score").desc(), "vec_id"))
    best = found.withColumn("rank", rank).where(F.col("rank") <= k)
    return best.join(asked.select("asked", "query_id"), "asked").select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
