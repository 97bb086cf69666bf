"""Toxicity by a chain of linear models over word features."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: The chain: each category's name and the label column and value that mean it. Later models see earlier ones.
CATEGORIES = (("low_quality", "quality", 0), ("toxic", "toxic", 1))
#: Defaults of fit(): the most labelled rows, and the least documents and z-score of a word with a weight.
MAX_ROWS, MIN_DOCS, MIN_Z = 8_000, 3, 4.0
FOLDS, STEM = 4, 4
WORD = re.compile(r"[^\W\d_]+")


def words(text: str) -> set[str]:
    """The distinct words of a text and, with a hyphen, the stems of STEM letters that inflected words share."""
    found = set(WORD.findall(text.lower()))
    return found | {w[:STEM] + "-" for w in found if len(w) > STEM}


@dataclass
class Chain:
    """The fitted models: weights[c][w] of word w, bias[c], and links[c] for the earlier categories' logits."""

    names: list[str]
    index: dict[str, int]
    weights: np.ndarray
    bias: np.ndarray
    links: list[np.ndarray]

    def probabilities(self, found: list[int]) -> list[float]:
        logits: list[float] = []
        for c in range(len(self.names)):
            earlier = np.clip(np.array(logits), -8, 8)
            logits.append(float(self.bias[c] + self.weights[c][found].sum() + self.links[c] @ earlier))
        return [1 / (1 + float(np.exp(-np.clip(z, -30, 30)))) for z in logits]


def _logistic(at: np.ndarray, of: np.ndarray, n: int, width: int, extra: np.ndarray, y: np.ndarray, steps: int = 200) -> np.ndarray:
    """Ridge logistic regression by Adam over presence features (row of[i] has feature at[i]) and dense extras.

    Returns the weights of the features, the extras and the constant.
    """
    theta = np.zeros(width + extra.shape[1] + 1)
    theta[-1] = np.log((y.sum() + 1) / (n - y.sum() + 1))
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        z = np.bincount(of, theta[at], minlength=n) + extra @ theta[width:-1] + theta[-1]
        off = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y
        slope = np.concatenate([np.bincount(at, off[of], minlength=width), extra.T @ off, [off.sum()]])
        slope[:-1] += 0.5 * theta[:-1]
        slope /= n
        m, v = 0.9 * m + 0.1 * slope, 0.99 * v + 0.01 * slope**2
        theta -= 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return theta


def _telling(at: np.ndarray, of: np.ndarray, n: int, width: int, y: np.ndarray, min_docs: int, min_z: float) -> np.ndarray:
    """Which words' share of the category's rows differs from their share of all by min_z standard errors."""
    seen, inside = np.bincount(at, minlength=width), np.bincount(at, y[of], minlength=width)
    share = y.mean() if n else 0.0
    if not 0 < share < 1:
        return np.zeros(width, bool)
    z = np.abs(inside - seen * share) / np.sqrt(np.maximum(seen * share * (1 - share) * (1 - seen / n), 1e-9))
    return (seen >= min_docs) & (z >= min_z)


def _model(at: np.ndarray, of: np.ndarray, n: int, width: int, extra: np.ndarray, y: np.ndarray, min_docs: int, min_z: float) -> np.ndarray:
    """One link of the chain: the words are chosen from these rows alone; the others' weights are 0."""
    good = np.flatnonzero(_telling(at, of, n, width, y, min_docs, min_z))
    place = np.full(width, -1)
    place[good] = np.arange(len(good))
    kept = place[at] >= 0
    theta = _logistic(place[at[kept]], of[kept], n, len(good), extra, y)
    out = np.zeros(width + extra.shape[1] + 1)
    out[good], out[width:] = theta[: len(good)], theta[len(good) :]
    return out


def _logits(theta: np.ndarray, at: np.ndarray, of: np.ndarray, n: int, width: int, extra: np.ndarray) -> np.ndarray:
    return np.bincount(of, theta[at], minlength=n) + extra @ theta[width:-1] + theta[-1]


def _out_of_fold(at: np.ndarray, of: np.ndarray, n: int, width: int, extra: np.ndarray, y: np.ndarray, min_docs: int, min_z: float, folds: int) -> np.ndarray:
    """Each row's logit from a model, words included, that is fitted without the rows of its fold."""
    fold, out = np.arange(n) % folds, np.zeros(n)
    for f in range(folds):
        inside = fold != f
        kept, place = inside[of], np.cumsum(inside) - 1
        theta = _model(at[kept], place[of[kept]], int(inside.sum()), width, extra[inside], y[inside], min_docs, min_z)
        out[~inside] = _logits(theta, at, of, n, width, extra)[~inside]
    return out


def fit(docs: DataFrame, labels: DataFrame, categories=CATEGORIES, max_rows: int = MAX_ROWS, folds: int = FOLDS, min_docs: int = MIN_DOCS, min_z: float = MIN_Z) -> Chain:
    """Fit the chain on at most max_rows labelled documents, chosen by the digest of doc_id.

    The sample's ids and labels are bounded by max_rows, so they may be broadcast; the documents' word sets come
    to the driver. Each model but the first gets the earlier categories' logits from models that did not see the
    row, neither for their weights nor for their choice of words: out-of-fold predictions over `folds` folds. A word
    has a weight if min_docs rows hold it and its share differs by min_z standard errors. Rows without one of the
    labels, null ids or null texts take no part. Without any labelled row each category's probability is one half at
    every document.
    """
    needed = [column for _, column, _ in categories]
    wanted = [(F.col(column) == value).cast("int").alias(f"y{i}") for i, (_, column, value) in enumerate(categories)]
    known = labels.where(F.col("doc_id").isNotNull()).dropna(subset=needed).select("doc_id", *wanted)
    known = known.groupBy("doc_id").agg(*[F.max(f"y{i}").alias(f"y{i}") for i in range(len(categories))])
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    rows = docs.where("text is not null").select("doc_id", "text").join(F.broadcast(sample), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([sorted(words(t.as_py())) for t in batch["text"]], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], found, *[batch[f"y{i}"] for i in range(len(categories))]], ["doc_id", "words", *[f"y{i}" for i in range(len(categories))]])

    kind = "doc_id long, words array<string>, " + ", ".join(f"y{i} int" for i in range(len(categories)))
    got = rows.select(F.col("doc_id").cast("long"), "text", *[f"y{i}" for i in range(len(categories))]).mapInArrow(run, kind).toArrow().sort_by("doc_id")
    y = np.array([got[f"y{i}"].to_numpy() for i in range(len(categories))], dtype=float).T.reshape(got.num_rows, len(categories))
    names = [name for name, _, _ in categories]
    n = got.num_rows
    if not n:
        return Chain(names, {}, np.zeros((len(names), 0)), np.zeros(len(names)), [np.zeros(c) for c in range(len(names))])
    column = got["words"].combine_chunks()
    coded = column.flatten().dictionary_encode()
    at, of = coded.indices.to_numpy(), np.repeat(np.arange(n), np.diff(column.offsets.to_numpy()))
    width, logits = len(coded.dictionary), np.zeros((n, 0))
    thetas = []
    for c in range(len(names)):
        extra = np.clip(logits, -8, 8)
        thetas.append(_model(at, of, n, width, extra, y[:, c], min_docs, min_z))
        if c + 1 < len(names):
            logits = np.column_stack([logits, _out_of_fold(at, of, n, width, extra, y[:, c], min_docs, min_z, folds)])
    used = np.flatnonzero(np.any([theta[:width] != 0 for theta in thetas], axis=0))
    spelt = coded.dictionary.take(pa.array(used)).to_pylist()
    order = np.argsort(np.array(spelt, dtype=object))
    index = {spelt[i]: place for place, i in enumerate(order)}
    weights = np.array([theta[:width][used][order] for theta in thetas])
    return Chain(names, index, weights, np.array([theta[-1] for theta in thetas]), [theta[width:-1] for theta in thetas])


def score(docs: DataFrame, chain: Chain, threshold: float = 0.5) -> DataFrame:
    """doc_id, p_<category> for each category of the chain in its order, and toxic: the last one is over threshold.

    Whole texts are read. A null or empty text has no words, so it gets the chain's base rates. Repeated rows are
    scored each; other columns are left out; an empty table gives an empty result. Nothing is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = chain.index.keys()
        for batch in batches:
            rows = [chain.probabilities([chain.index[w] for w in sorted(known & words(t.as_py() or ""))]) for t in batch["text"]]
            columns = [pa.array([r[c] for r in rows], pa.float64()) for c in range(len(chain.names))]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *columns], ["doc_id", *[f"p_{x}" for x in chain.names]])

    kind = "doc_id long, " + ", ".join(f"p_{x} double" for x in chain.names)
    out = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, kind)
    return out.withColumn("toxic", F.col(f"p_{chain.names[-1]}") >= threshold)


def keep_clean(docs: DataFrame, chain: Chain, threshold: float = 0.5) -> DataFrame:
    """The rows of docs, all columns, that the chain does not reject; every other row is untouched."""
    columns = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = chain.index.keys()
        for batch in batches:
            good = [chain.probabilities([chain.index[w] for w in sorted(known & words(t.as_py() or ""))])[-1] < threshold for t in batch["text"]]
            yield batch.filter(pa.array(good, pa.bool_()))

    return docs.select(*columns).mapInArrow(run, docs.schema)
