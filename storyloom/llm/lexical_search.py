"""Ranked lexical search: a document-partitioned index, term-at-a-time scoring with a limit on accumulators."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from storyloom.llm.common import staged

#: Terms: runs of ASCII letters and digits and of all other characters outside ASCII; A-Z in lower case.
TERM = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
#: Bytes of item texts whose terms are sent to all tasks at once; more are searched in blocks of that size.
BLOCK_BYTES = 4_000_000
#: Documents whose accumulators a task holds at once: 8 bytes each, for one item at a time.
BATCH_ROWS = 4096
#: Documents in the rarest terms' lists, in multiples of k, from which the first bound on the k-th score is taken.
FIRST_LISTS = 40


@dataclass(frozen=True)
class Items:
    """The items of one block: their ids, the number of each term, and each item's term numbers."""

    ids: list
    terms: dict[bytes, int]
    of: list[np.ndarray]


@dataclass(frozen=True)
class Weights:
    """What scoring needs of the corpus: N, L, and each term's df, weight and largest impact on any document."""

    documents: int
    length: int
    df: np.ndarray
    weight: np.ndarray
    most: np.ndarray


def terms_of(text: str | None) -> list[bytes]:
    return TERM.findall((text or "").encode().lower())


def impacts(tf: np.ndarray, n: np.ndarray, documents: int, length: int) -> np.ndarray:
    """What a term's weight is multiplied by in a document of n terms that holds it tf times; integers, rounded down."""
    m = 50 + (50 * n * documents) // max(1, length)
    return (1_000_000_000 * tf) // (1000 * tf + 20 * m)


def search(
    docs: DataFrame,
    items: DataFrame,
    *,
    k: int = 50,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """item_col, rank (int, from 1), id_col, score (long): each item's k best documents with a score above 0, equal scores
    by ascending id.

    A term's weight w is floor(1000 ln((2N+2) / (2df+1))); a document's score sums w * (10^9 tf div (1000 tf + 20 m)) over
    the item's distinct terms, with m = 50 + 50 n N div L: all whole numbers but the logarithm. N counts the documents
    with a term, L all their terms, n one document's, df and tf as usual.

    1. Documents become an index that stays partitioned by document: the item terms of each with their tf, and n. Sums
       for each term (df, largest impact) leave a task as one row for each term.
    2. Each task goes through the lists of its documents term by term, rarest first, with an accumulator for each
       document met. It stops making new ones as soon as the terms that are left can't bring a document to the k-th
       score, drops those that can't get there either, and updates the survivors exactly. The k-th score is the best
       bound there is: that of the whole corpus over the lists of the rarest terms, which a first, cheap round finds, and
       later that of the documents the task has finished.
    3. Of each task k documents for an item at most go through the one shuffle, and only if they reach that bound.

    Null and empty texts have no terms: they count for nothing and are never found; items without terms find nothing. Rows
    without an id take no part, on either side. Rows that repeat an id are documents of their own, each with its rank;
    rows that repeat an item id are one item with the terms of all. Texts of any length are read whole. Empty tables give
    an empty result. Other columns are ignored. Items over BLOCK_BYTES are searched in blocks, each a pass over docs.
    """
    spark = docs.sparkSession
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    wanted = items.where(F.col(item_col).isNotNull() & F.col(item_text).isNotNull())
    size = wanted.agg(F.sum(F.length(item_text))).first()[0] or 0
    blocks = max(1, -(-size // BLOCK_BYTES))
    place = F.pmod(F.xxhash64(item_col), F.lit(blocks))
    id_type = rows.schema["id"].dataType.simpleString()
    item_type = items.schema[item_col].dataType.simpleString()
    found = None
    for b in range(blocks):
        block = _items(wanted.where(place == b).select(item_col, item_text).toLocalIterator())
        best = _search_block(spark, rows, block, k, id_type)
        names = spark.createDataFrame(list(enumerate(block.ids)), f"item int, name {item_type}")
        named = best.join(F.broadcast(names), "item").select(F.col("name").alias(item_col), "rank", F.col("id").alias(id_col), "score")
        found = named if found is None else found.union(named)
    return found


def _items(rows: Iterator) -> Items:
    held: dict = {}
    for item, text in rows:
        held.setdefault(item, set()).update(terms_of(text))
    terms = {t: i for i, t in enumerate(sorted(set().union(*held.values())))} if held else {}
    return Items(list(held), terms, [np.array(sorted(terms[t] for t in own), np.int64) for own in held.values()])


def _search_block(spark, rows: DataFrame, items: Items, k: int, id_type: str) -> DataFrame:
    sent = spark.sparkContext.broadcast(items)
    index = staged(_index(rows, sent, id_type))
    total = index.agg(F.count("*"), F.sum("n")).first()
    documents, length = total[0], total[1] or 0
    weights = _weights(index, documents, length, len(items.terms))
    shared = spark.sparkContext.broadcast(weights)
    # the first round: what the rarest terms of each item alone give
    rare = [_rarest(own, weights.df, FIRST_LISTS * k) for own in items.of]
    first = _scored(index, sent, shared, k, id_type, rare, np.zeros(len(rare), np.int64))
    at_k = _best(first, k).groupBy("item").agg(F.min("score").alias("score"), F.count("*").alias("n")).where(F.col("n") == k)
    bounds = np.zeros(len(rare), np.int64)
    for r in at_k.collect():  # one row for each item of the block
        bounds[r["item"]] = r["score"]
    return _best(_scored(index, sent, shared, k, id_type, items.of, bounds), k)


def _index(rows: DataFrame, items, id_type: str) -> DataFrame:
    """(id, n, terms, tfs) of the documents with a term: numbers of the item terms that each holds, and how often."""
    schema = f"id {id_type}, n bigint, terms array<int>, tfs array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = items.value.terms
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                keep, n, terms, tfs = [], [], [], []
                for i, text in enumerate(part.column(1).to_pylist()):
                    words = terms_of(text)
                    if words:
                        count = Counter(words)
                        held = sorted((known[t], count[t]) for t in count.keys() & known.keys())
                        keep.append(i)
                        n.append(len(words))
                        terms.append([t for t, _ in held])
                        tfs.append([c for _, c in held])
                lists = [pa.array(x, pa.list_(pa.int32())) for x in (terms, tfs)]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(keep, pa.int64())), pa.array(n, pa.int64()), *lists], names=["id", "n", "terms", "tfs"])

    return rows.mapInArrow(run, schema)


def _lists(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(n of each document, and document, term and tf of each posting) of a part of the index."""
    column = part.column("terms")
    sizes = np.diff(column.offsets.to_numpy())
    flat = lambda name: part.column(name).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return part.column("n").to_numpy(), np.repeat(np.arange(part.num_rows), sizes), flat("terms"), flat("tfs")


def _weights(index: DataFrame, documents: int, length: int, n_terms: int) -> Weights:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, most = np.zeros(n_terms, np.int64), np.zeros(n_terms, np.int64)
        for batch in batches:
            n, doc, term, tf = _lists(batch)
            df += np.bincount(term, minlength=n_terms)
            np.maximum.at(most, term, impacts(tf, n[doc], documents, length))
        held = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(df[held]), pa.array(most[held])], names=["term", "df", "most"])

    df, most = np.zeros(n_terms, np.int64), np.zeros(n_terms, np.int64)
    sums = index.select("n", "terms", "tfs").mapInArrow(run, "term bigint, df bigint, most bigint")
    for r in sums.groupBy("term").agg(F.sum("df").alias("df"), F.max("most").alias("most")).collect():  # terms of one block
        df[r["term"]], most[r["term"]] = r["df"], r["most"]
    weight = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)
    return Weights(documents, length, df, weight, most)


def _rarest(own: np.ndarray, df: np.ndarray, postings: int) -> np.ndarray:
    """The rarest of an item's terms, until their lists have so many documents together."""
    order = own[np.lexsort((own, df[own]))]
    return order[: np.searchsorted(np.cumsum(df[order]), postings) + 1]


def _scored(index: DataFrame, items, weights, k: int, id_type: str, of: list[np.ndarray], bounds: np.ndarray) -> DataFrame:
    """(item, id, score) of documents that may be among an item's k best by the given terms, from its bound on."""
    terms_sent = index.sparkSession.sparkContext.broadcast((of, bounds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, least = terms_sent.value
        scorer = Scorer(own, weights.value, least.copy(), k)
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH_ROWS):
                part = batch.slice(at, BATCH_ROWS)
                rows, docs, scores = scorer.score(*_lists(part))
                if len(rows):
                    yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int32()), part.column("id").take(pa.array(docs)), pa.array(scores)], names=["item", "id", "score"])

    return index.mapInArrow(run, f"item int, id {id_type}, score bigint")


class Scorer:
    """Term-at-a-time over one batch of documents after the other."""

    def __init__(self, of: list[np.ndarray], weights: Weights, least: np.ndarray, k: int) -> None:
        self.w, self.k, self.least = weights, k, least
        self.best: list[np.ndarray] = [np.zeros(0, np.int64)] * len(of)  # the k best scores that this task has finished
        self.order = [own[np.lexsort((own, weights.df[own]))] for own in of]  # rarest first
        bound = weights.weight * weights.most
        #: What the terms from each place on can add to a document at most.
        self.left = [np.append(np.cumsum(bound[own][::-1])[::-1], 0) for own in self.order]

    def score(self, n: np.ndarray, doc: np.ndarray, term: np.ndarray, tf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(item, document, score) of what reaches its item's bound: k for an item at most, and ties with the last."""
        by_term = np.argsort(term, kind="stable")
        doc = doc[by_term]
        gain = self.w.weight[term[by_term]] * impacts(tf[by_term], n[doc], self.w.documents, self.w.length)
        starts = np.searchsorted(term[by_term], np.arange(len(self.w.df) + 1))
        out = []
        for item in range(len(self.order)):
            docs, scores = self._one(item, doc, gain, starts, len(n))
            if len(docs):
                out.append((np.full(len(docs), item), docs, scores))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 3

    def _one(self, item: int, doc: np.ndarray, gain: np.ndarray, starts: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
        least, order, left = self.least[item], self.order[item], self.left[item]
        held = np.zeros(n_docs, np.int64)
        open_to_new, alive = True, None
        for place, t in enumerate(order):
            s, e = starts[t], starts[t + 1]
            if open_to_new and left[place] < least:  # a document without an accumulator can't reach the k-th score any more
                open_to_new, alive = False, (held > 0) & (held + left[place] >= least)
                if not alive.any():
                    return np.zeros(0, np.int64), held[:0]
            if s == e:
                continue
            if open_to_new:
                held[doc[s:e]] += gain[s:e]
            else:
                on = alive[doc[s:e]]
                held[doc[s:e][on]] += gain[s:e][on]
        if alive is not None:
            held[~alive] = 0
        docs = np.flatnonzero(held >= max(1, least))
        if len(docs) > self.k:
            edge = np.partition(held[docs], len(docs) - self.k)[len(docs) - self.k]
            docs = docs[held[docs] >= edge]  # ties stay: ids decide between them
        finished = np.concatenate([self.best[item], held[docs]])
        if len(finished) >= self.k:
            finished = np.partition(finished, len(finished) - self.k)[len(finished) - self.k :]
            self.least[item] = max(least, finished.min())
        self.best[item] = finished
        return docs, held[docs]


def _best(scored: DataFrame, k: int) -> DataFrame:
    """The k best of each item (item, id, score), with their rank; no more than k of a task are shuffled."""
    w = Window.partitionBy("item").orderBy(F.desc("score"), F.asc("id"))
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
