"""Toxicity: subword-bag embeddings, averaged into a linear softmax, trained jointly in numpy."""

from __future__ import annotations

import uuid
from array import array
from dataclasses import dataclass, field
from zlib import crc32

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyloom.llm.bpe_prefix import Remembered
from storyloom.llm.common import map_texts

_EDGES = b".,;:!?\"'()[]{}|*#$%&<>-_~"


@dataclass(frozen=True)
class Settings:
    """buckets: rows of the shared n-gram table. smooth: words added to a text's length before averaging, so that a
    very short text isn't judged by one word alone."""

    sizes: tuple[int, ...] = (3, 4, 5)
    buckets: int = 1 << 17
    width: int = 8
    epochs: int = 120
    rate: float = 0.15
    decay: float = 1e-6
    smooth: int = 4
    most_rows: int = 4000
    most_bytes: int = 128_000_000
    folds: int = 4
    held_fold: int = 2
    threshold: float = 0.3
    seed: int = 11


def ngrams(word: bytes, sizes: tuple[int, ...], buckets: int) -> list[int]:
    """Buckets of the character n-grams of a word in its marks (over its UTF-8 bytes), and of the word as a whole."""
    bare = word.strip(_EDGES)
    if not bare.isascii():
        bare = bare.decode("utf-8", "replace").lower().encode()
    if not bare:
        return []
    marked = b"<%b>" % bare
    size = len(marked)
    parts = [crc32(marked[i : i + n]) % buckets for n in sizes for i in range(size - n + 1)]
    parts.append(crc32(b"=" + bare) % buckets)
    return parts


def words(text: str | None) -> list[bytes]:
    return text.encode().lower().split() if text else []


class _Sparse:
    """A sparse matrix, for products with a vector from either side."""

    def __init__(self, rows: np.ndarray, columns: np.ndarray, weights: np.ndarray, shape: tuple[int, int]) -> None:
        self.rows, self.columns, self.weights, self.shape = rows, columns, weights, shape

    def dot(self, x: np.ndarray) -> np.ndarray:
        return np.bincount(self.rows, self.weights * x[self.columns], self.shape[0])

    def t_dot(self, x: np.ndarray) -> np.ndarray:
        return np.bincount(self.columns, self.weights * x[self.rows], self.shape[1])


@dataclass
class Model:
    """What scoring needs: each bucket's part of the logit, and the bias. The embedding of a text is the mean over its
    words of the mean over their n-grams, so the logit is that mean of parts."""

    parts: np.ndarray
    bias: float
    settings: Settings
    name: str = field(default_factory=lambda: uuid.uuid4().hex)


def train(texts: list[str], toxic: list[int], settings: Settings = Settings()) -> Model:
    """Embeddings and softmax by full-batch Adam on the cross entropy. The two-class softmax is trained as the
    difference of its logits. Without rows of both classes the model is the smoothed share of toxic rows."""
    s = settings
    y = np.array(toxic, np.float64)
    prior = (y.sum() + 0.5) / (len(y) + 1)
    bias = float(np.log(prior / (1 - prior)))
    if not len(y) or y.min() == y.max():
        return Model(np.zeros(s.buckets, np.float32), bias, s)
    number: dict[bytes, int] = {}
    doc_rows, doc_words, weights = [], [], []
    for d, t in enumerate(texts):
        ids = [number.setdefault(w, len(number)) for w in words(t)]
        unique, counts = np.unique(np.array(ids, np.int64), return_counts=True)
        doc_rows.append(np.full(len(unique), d))
        doc_words.append(unique)
        weights.append(counts / (len(ids) + s.smooth))
    used: dict[int, int] = {}
    gram_rows, gram_columns, gram_weights = array("q"), array("q"), array("d")  # millions: numbers, not objects
    for w, i in number.items():
        own = ngrams(w, s.sizes, s.buckets)
        gram_rows.extend([i] * len(own))
        gram_columns.extend([used.setdefault(g, len(used)) for g in own])
        gram_weights.extend([1 / max(1, len(own))] * len(own))
    by_doc = _Sparse(np.concatenate(doc_rows), np.concatenate(doc_words), np.concatenate(weights), (len(y), len(number)))
    by_word = _Sparse(
        np.frombuffer(gram_rows, np.int64), np.frombuffer(gram_columns, np.int64), np.frombuffer(gram_weights), (len(number), len(used))
    )
    rng = np.random.default_rng(s.seed)
    table = rng.normal(0, 0.3, (len(used), s.width))
    head = rng.normal(0, 1.0, s.width)
    offset = np.array([bias])
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in (table, head, offset)]
    for step in range(1, s.epochs + 1):
        # Averaging is linear, so each bucket's embedding meets the softmax before the averages, not after: the same
        # products and gradients, with vectors in place of matrices.
        logit = by_doc.dot(by_word.dot(table @ head)) * SCALE + offset[0]
        error = (1 / (1 + np.exp(-logit)) - y) / len(y)
        by_gram = by_word.t_dot(by_doc.t_dot(error)) * SCALE
        slopes = (np.outer(by_gram, head), table.T @ by_gram, np.array([error.sum()]))
        for p, g, (m, v) in zip((table, head, offset), slopes, moments, strict=True):
            g = g + s.decay * p
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= s.rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    parts = np.zeros(s.buckets, np.float32)
    parts[np.fromiter(used, np.int64)] = table @ head * SCALE
    return Model(parts, float(offset[0]), s)


#: Averages of hundreds of words are small numbers; the softmax sees them times this.
SCALE = 20.0


class Scorer:
    def __init__(self, model: Model) -> None:
        parts, s = model.parts, model.settings

        def part(word: bytes) -> float:
            own = ngrams(word, s.sizes, s.buckets)
            return float(parts[own].mean()) if own else 0.0

        self.bias, self.smooth, self.known = model.bias, s.smooth, Remembered(part)

    def score(self, text: str | None) -> float:
        own = words(text)
        logit = self.bias + sum(map(self.known.__getitem__, own)) / (len(own) + self.smooth)
        return float(1 / (1 + np.exp(-np.clip(logit, -40, 40))))


_scorers: dict[str, Scorer] = {}


def fold(id_col: Column, folds: int) -> Column:
    return F.crc32(id_col.cast("string")) % folds


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str, text_col: str, label_col: str, settings: Settings) -> Model:
    """Trains on at most settings.most_rows labelled rows outside the held fold, taken in hash order of their ids, with at
    most most_bytes of text.

    Labels are chosen first, so what is joined to the documents has that bound. Of the rows found, which are more if ids
    repeat, as many are taken in hash order of id and text, each distinct text of an id once, and whole texts up to
    most_bytes together: only their hashes and sizes are sorted, and only the texts taken are sent to the driver.
    """
    s = settings
    rows = (
        labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y"))
        .where("id is not null and y is not null")
        .where(fold(F.col("id"), s.folds) != s.held_fold)
        .groupBy("id")
        .agg(F.max("y").alias("y"))
        .orderBy(F.xxhash64("id"))
        .limit(s.most_rows)
    )
    text = F.coalesce(text_col, F.lit(""))
    texts = docs.select(F.col(id_col).alias("id"), text.alias("text")).join(F.broadcast(rows), "id").withColumn("h", F.xxhash64("id", "text"))
    sizes = texts.groupBy("h").agg(F.first(F.octet_length("text")).alias("n")).orderBy("h").limit(s.most_rows).collect()
    fits = np.cumsum([r["n"] for r in sizes]) <= s.most_bytes
    taken = texts.sparkSession.createDataFrame([(r["h"],) for r, ok in zip(sizes, fits, strict=True) if ok], "h long")
    found = texts.join(F.broadcast(taken), "h").groupBy("h").agg(F.first(F.struct("id", "y", "text")).alias("x")).select("x.*")
    seen = sorted((r["id"], r["y"], r["text"]) for r in found.toLocalIterator())
    return train([t for _, _, t in seen], [y for _, y, _ in seen], s)


def score_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    settings: Settings = Settings(),
) -> DataFrame:
    """id_col, held_out (no label of it was learned from), score (0 to 1), predicted (1 from the threshold on).

    Only the text enters a score: equal texts score alike, null ones as empty. One row for each row of docs, none for
    none; rows that repeat an id are scored each. Texts of any length are scored whole, word by word. A null id
    is not held out. Without labels of both classes all scores are the share of toxic rows. Other columns are ignored.
    The model, 4 bytes a bucket, is broadcast; scoring is one pass without a shuffle.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(
        fit(docs, labels, id_col=id_col, text_col=text_col, label_col=label_col, settings=settings)
    )

    def run(texts: list[str | None]) -> dict[str, list]:
        model = shared.value
        if model.name not in _scorers:
            _scorers.clear()
            _scorers[model.name] = Scorer(model)
        return {"score": list(map(_scorers[model.name].score, texts))}

    out = map_texts(docs, id_col, text_col, "score double", run)
    held = F.coalesce(fold(F.col(id_col), settings.folds) == settings.held_fold, F.lit(False))
    return out.select(
        id_col,
        held.alias("held_out"),
        "score",
        (F.col("score") >= settings.threshold).cast("int").alias("predicted"),
    )
