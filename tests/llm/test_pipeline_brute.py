"""The whole pipeline against a version in plain Python, on documents of the smallest table and edge rows."""

from __future__ import annotations

import collections

import public_tokenizers
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from storyloom.llm.common import staged
from tests.llm.brute import LOW, WHITE, components, item_hits, lower, words_of

SF = "/root/testdata/sf0.001"


def passes(text: str | None) -> bool:
    """The quality rules, one after the other."""
    t = text or ""
    w = words_of(t)
    windows = collections.Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
    hit = {k + d for k in range(len(w) - 7) if windows[tuple(w[k : k + 8])] > 1 for d in range(8)}
    every = t.split("\n")
    lines = [x for x in every if x.strip(WHITE)]
    chars = sum(map(len, w))
    return not (
        len(w) < 20
        or 100 * len(hit) > 30 * len(w)
        or 100 * sum(map(t.count, "#*$%&|<>")) > 20 * len(w)
        or 100 * sum(c.isupper() for c in t) > 50 * chars
        or (len(every) >= 5 and 100 * (len(lines) - len(set(lines))) > 60 * len(every))
        or chars < 2 * len(w)
        or chars > 25 * len(w)
    )


def drop_lines(docs: dict[int, str]) -> dict[int, str]:
    key = lambda x: x.strip(WHITE).translate(LOW)
    holders = collections.defaultdict(set)
    for i, t in docs.items():
        for x in t.split("\n"):
            if len(key(x)) >= 10:
                holders[key(x)].add(i)
    out = {}
    for i, t in docs.items():
        lines = t.split("\n")
        kept = [x for x in lines if len(holders[key(x)]) < 2 or min(holders[key(x)]) == i]
        if len(kept) == len(lines) or "\n".join(kept).strip(WHITE):
            out[i] = "\n".join(kept)
    return out


def test_pipeline_is_brute_force(spark):
    long = " ".join(f"word{i}" for i in range(9000))
    edges = [(900_001, None), (900_002, ""), (900_003, long), (900_004, long + " end"), (900_005, "one two three")]
    given = spark.read.parquet(f"{SF}/documents.parquet")
    extra = spark.createDataFrame(edges, "doc_id long, text string").select(
        "doc_id", "text", F.lit("en").alias("lang"), F.lit("s").alias("source"), F.length("text").cast("long").alias("n_chars"))
    docs = given.unionByName(extra).withColumn("_", F.lit("x")).withColumn("words", F.lit(1))
    out = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = staged(stage(spark, out, SF))
        assert out.columns == docs.columns, name
    last = corpus_pipeline.STAGES[-1][1](spark, out, SF)

    want = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect() if passes(r["text"])}
    want = drop_lines(want)
    groups = components(want, 5)
    want = {i: t for i, t in want.items() if groups[i][1] == i}
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    want = {i: t for i, t in want.items() if not item_hits(t, items)}
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    assert {r["doc_id"]: (r["ids"], r["decoded"]) for r in last.collect()} == {i: (sp.encode(t), t) for i, t in want.items()}
    assert 900_003 in want and 900_004 not in want and lower("A") == "a"
