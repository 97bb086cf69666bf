"""Byte-level BPE encoding with a segment tree over pair ranks, and decoding."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

#: Fixed value: how the byte-level pre-tokenizer cuts a text.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
#: A worker keeps the encodings of the first so many pieces, and none of a longer piece.
KEEP, SHORT = 400_000, 64
#: The key of a pair that can't be merged.
NONE = 1 << 62


def byte_letters() -> list[str]:
    """The letter that stands for each byte in vocabulary files: itself if printable, else the next from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return [chr(b) if b in plain else chr(0x100 + rest.index(b)) for b in range(256)]


class RankTree:
    """A minimum segment tree over the adjacent pairs of a piece: the root is the leftmost pair of lowest rank.

    A leaf holds rank x width + position, so equal ranks order by position. A point update climbs to the root.
    """

    def __init__(self, keys: list[int]) -> None:
        self.width = 1 << max(0, len(keys) - 1).bit_length()
        tree = [NONE] * self.width + keys + [NONE] * (self.width - len(keys))
        for i in range(self.width - 1, 0, -1):
            a, b = tree[2 * i], tree[2 * i + 1]
            tree[i] = a if a < b else b
        self.tree = tree

    def put(self, at: int, key: int) -> None:
        tree, i = self.tree, at + self.width
        tree[i] = key
        i >>= 1
        while i:
            a, b = tree[2 * i], tree[2 * i + 1]
            key = a if a < b else b
            if tree[i] == key:
                break
            tree[i] = key
            i >>= 1


class Bpe:
    """A tokenizer file's vocabulary, merges and added tokens."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        letters = byte_letters()
        byte_of = {c: b for b, c in enumerate(letters)}
        vocab = spec["model"]["vocab"]
        self.first = [vocab[c] for c in letters]
        pairs = (tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"])
        self.merges = {(vocab[a], vocab[b]): (rank, vocab[a + b]) for rank, (a, b) in enumerate(pairs)}
        self.text_of = {i: bytes(byte_of[c] for c in token) for token, i in vocab.items()}
        self.added = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.text_of |= {i: content.encode() for content, i in self.added.items()}
        self.digits = {i: str(i) for i in self.text_of}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.pieces = regex.compile(PIECES)
        self.kept: dict[str, tuple[int, ...]] = {}

    def merge(self, piece: str) -> tuple[int, ...]:
        """Merge the leftmost pair of lowest rank until no pair of the piece has a rank."""
        ids = [self.first[b] for b in piece.encode("utf-8", "surrogatepass")]
        n, merges = len(ids), self.merges
        if n < 2:
            return tuple(ids)
        width = 1 << (n - 1).bit_length()

        def key(a: int, b: int, at: int) -> int:
            found = merges.get((a, b))
            return NONE if found is None else found[0] * width + at

        tree = RankTree([key(ids[i], ids[i + 1], i) for i in range(n - 1)])
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while (low := tree.tree[1]) != NONE:
            at = low % width
            gone = after[at]
            ids[at] = merges[ids[at], ids[gone]][1]
            ids[gone] = -1
            behind = after[gone]
            after[at] = behind
            if gone < n - 1:
                tree.put(gone, NONE)
            if behind < n:
                before[behind] = at
                tree.put(at, key(ids[at], ids[behind], at))
            else:
                tree.put(at, NONE)
            if (front := before[at]) >= 0:
                tree.put(front, key(ids[front], ids[at], front))
        return tuple(i for i in ids if i >= 0)

    def piece(self, piece: str) -> tuple[int, ...]:
        found = self.merge(piece)
        if len(piece) <= SHORT and len(self.kept) < KEEP:
            self.kept[piece] = found
        return found

    def encode(self, text: str) -> list[int]:
        """The ids of a whole text; an added token's own spelling becomes its id."""
        out: list[int] = []
        for part in self.cut.split(text) if self.cut else [text]:
            if part in self.added:
                out.append(self.added[part])
                continue
            kept, extend = self.kept, out.extend
            for piece in self.pieces.findall(part):
                extend(kept.get(piece) or self.piece(piece))
        return out

    def encode_plain(self, text: str) -> list[int]:
        """The ids of a whole text in which an added token's own spelling is text like any other."""
        kept, out = self.kept, []
        for piece in self.pieces.findall(text):
            out.extend(kept.get(piece) or self.piece(piece))
        return out

    def decode(self, ids: list[int]) -> str:
        """The text of ids, added tokens included; bytes that are no UTF-8 become U+FFFD."""
        return b"".join(map(self.text_of.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def load(path: str) -> Bpe:
    return Bpe(path)


def _digest(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every document.

    A null text counts as empty: no tokens, the digest of nothing. Texts of any length are encoded whole. Repeated
    rows are encoded each; other columns are left out. Nothing is shuffled, and a worker loads the file at `path`,
    which each machine must have, once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            counts, ids_of, texts = [], [], []
            for text in batch["text"]:
                ids = bpe.encode(text.as_py() or "")
                counts.append(len(ids))
                ids_of.append(_digest(",".join(map(bpe.digits.__getitem__, ids))))
                texts.append(_digest(bpe.decode(ids)))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(counts, pa.int64()), pa.array(ids_of, pa.string()), pa.array(texts, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and ids, an array of token ids, of every document; a null text has no tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            ids = pa.array([bpe.encode(text.as_py() or "") for text in batch["text"]], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], ids], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, ids array<int>")


def decoded(tokens: DataFrame, path: str) -> DataFrame:
    """doc_id and text from rows (doc_id, ids); null ids count as none, ids that the file doesn't know give no text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            texts = pa.array([bpe.decode([i for i in ids.as_py() or [] if i in bpe.text_of]) for ids in batch["ids"]], pa.string())
            yield pa.RecordBatch.from_arrays([batch["doc_id"], texts], ["doc_id", "text"])

    return tokens.select(F.col("doc_id").cast("long"), "ids").mapInArrow(run, "doc_id long, text string")
