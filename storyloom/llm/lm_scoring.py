"""LM scoring: deleted interpolation of n-gram estimates, with weights by context frequency from held-out counts."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyloom.llm.common import staged
from storyloom.llm.word_hash import chunks, mix, word_hashes

#: n-gram keys are the low bits of 64-bit hashes: enough to tell n-grams apart, and a byte less to shuffle for each.
_BITS = 56
_KEY = np.uint64((1 << _BITS) - 1)
_END, _START = np.uint64(0x5DEECE66D1234567), np.uint64(0x3C6EF372FE94F82B)
_LEFT, _RIGHT = np.uint64(0x9FB21C651E98DF25), np.uint64(0xD1B54A32D192ED03)
#: Rows that score without being counted, rows that give the mixture weights, rows that are counted.
SCORED, TUNED, COUNTED = 0, 1, 2


@dataclass(frozen=True)
class Settings:
    """folds: crc32(id) modulo; fold 0 is held out, fold 1 tunes the weights and is then counted too. least_bytes: texts
    of a batch and of a range of keys. row_bytes: of texts that stand behind one exchanged row of keys."""

    folds: int = 10
    alpha: float = 0.1
    least_bytes: int = 1_000_000
    row_bytes: int = 8192

    def unit(self, size: int) -> float:
        """Bytes of a batch for a corpus of `size` bytes. Batches times ranges is the number of rows exchanged, so both
        grow with the root of the corpus and that number with the corpus: 16 MB at 30 GB, 900 MB at 100 TB."""
        return max(self.least_bytes, (size * self.row_bytes) ** 0.5)

    em_rounds: int = 50
    #: Steps a natural-log unit in the table of likelihood ratios that EM works on.
    resolution: int = 20


class Tokens:
    """Tokens of a batch of texts: the words of each and its end, with their keys and those of the bigrams before them."""

    def __init__(self, texts: list[str | None]) -> None:
        current, sizes = [], []
        for a, b in chunks(texts):
            hashes, bounds = word_hashes(texts[a:b])
            current.append(np.insert(hashes, bounds[1:], _END))
            sizes.append(np.diff(bounds) + 1)
        self.sizes = np.concatenate(sizes)
        words = np.concatenate(current)
        firsts = np.cumsum(self.sizes) - self.sizes
        before = np.empty_like(words)
        before[1:] = words[:-1]
        before[firsts] = _START
        self.is_first = np.zeros(len(words), bool)
        self.is_first[firsts] = True
        self.words, self.word_at = np.unique(words & _KEY, return_inverse=True)
        pairs = mix(before * _LEFT + words * _RIGHT) & _KEY
        self.pairs, self.pair_at = np.unique(pairs, return_inverse=True)
        #: By token, where the word before it is in self.words; for a first token, where the end is (as many starts).
        ends = np.cumsum(self.sizes) - 1
        self.before_at = np.empty(len(words), np.int64)
        self.before_at[1:] = self.word_at[:-1]
        self.before_at[firsts] = self.word_at[ends]


def pack(values: np.ndarray) -> bytes:
    """Sorted keys as byte planes of their differences; high planes are zeros, which compression removes."""
    steps = np.diff(values, prepend=np.uint64(0))
    return steps.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes()


def unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(8, -1).T
    return np.cumsum(np.ascontiguousarray(planes).view("<u8").ravel())


def _planes(counts: np.ndarray) -> bytes:
    return counts.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _counts(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(4, -1).T
    return np.ascontiguousarray(planes).view("<u4").ravel().astype(np.int64)


def _table(columns: dict[str, list], kinds: dict[str, pa.DataType]) -> pa.Table:
    return pa.table({k: pa.array(columns[k], t) for k, t in kinds.items()})


_ASKED = {"batch": pa.int64(), "kind": pa.int32(), "part": pa.int64(), "role": pa.int32(), "keys": pa.binary(), "n": pa.binary()}
_TOLD = {"batch": pa.int64(), "kind": pa.int32(), "part": pa.int64(), "total": pa.binary(), "counted": pa.binary(), "tokens": pa.int64(), "counted_tokens": pa.int64(), "types": pa.int64(), "counted_types": pa.int64()}


def _ddl(kinds: dict[str, pa.DataType]) -> str:
    names = {pa.int64(): "bigint", pa.int32(): "int", pa.binary(): "binary"}
    return ", ".join(f"{k} {names[t]}" for k, t in kinds.items())


def exchange(batched: DataFrame, parts: int) -> DataFrame:
    """Corpus-wide counts of each batch's n-grams, by batch.

    Each batch sends its sorted distinct keys with their own counts to ranges of keys; a range adds up what all batches
    sent and answers each batch with the totals, in the order of its keys. A frequent n-gram is one key of a batch.
    """
    width = (1 << _BITS) // parts + 1

    def ask(table: pa.Table) -> pa.Table:
        batch, role = table["batch"][0].as_py(), table["role"][0].as_py()
        t = Tokens(table["text"].to_pylist())
        out: dict[str, list] = {k: [] for k in _ASKED}
        for kind, keys, at in ((1, t.words, t.word_at), (2, t.pairs, t.pair_at)):
            n = np.bincount(at, minlength=len(keys))
            part = (keys // np.uint64(width)).astype(np.int64)
            cuts = np.flatnonzero(np.diff(part, prepend=-1))
            for a, b in zip(cuts, [*cuts[1:], len(keys)], strict=True):
                row = (batch, kind, int(part[a]), role, pack(keys[a:b]), _planes(n[a:b]))
                for k, v in zip(_ASKED, row, strict=True):
                    out[k].append(v)
        return _table(out, _ASKED)

    def add_up(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        keys = [unpack(r["keys"]) for r in rows]
        unique, at = np.unique(np.concatenate(keys), return_inverse=True)
        n = np.concatenate([_counts(r["n"]) for r in rows])
        role = np.repeat([r["role"] for r in rows], [len(k) for k in keys])
        counted = np.bincount(at, n * (role == COUNTED), len(unique)).astype(np.int64)
        total = np.bincount(at, n * (role >= TUNED), len(unique)).astype(np.int64)
        out: dict[str, list] = {k: [] for k in _TOLD}
        sums = (int(total.sum()), int(counted.sum()), int((total > 0).sum()), int((counted > 0).sum()))
        start = 0
        for i, (r, k) in enumerate(zip(rows, keys, strict=True)):
            mine = at[start : start + len(k)]
            start += len(k)
            own = sums if i == 0 and r["kind"] == 1 else (0, 0, 0, 0)
            second = _planes(counted[mine]) if r["role"] == TUNED else b""
            row = (r["batch"], r["kind"], r["part"], _planes(total[mine]), second, *own)
            for name, v in zip(_TOLD, row, strict=True):
                out[name].append(v)
        return _table(out, _TOLD)

    asked = batched.select("batch", "role", "text").groupBy("batch").applyInArrow(ask, _ddl(_ASKED))
    return staged(asked.groupBy("kind", "part").applyInArrow(add_up, _ddl(_TOLD)))


def _told(answers: pa.Table, column: str) -> tuple[np.ndarray, np.ndarray]:
    """Counts of the batch's words and bigrams in the order of their keys."""
    rows = sorted(answers.select(["kind", "part", column]).to_pylist(), key=lambda r: (r["kind"], r["part"]))
    join = lambda kind: np.concatenate([_counts(r[column]) for r in rows if r["kind"] == kind])
    return join(1), join(2)


def _level(context: np.ndarray) -> np.ndarray:
    """Bucket of a context by its frequency: the number of its binary digits."""
    return np.frexp(context.astype(np.float64))[1]


LEVELS = 64


def learn_weights(ratios: np.ndarray, resolution: int, rounds: int) -> np.ndarray:
    """Weight of the bigram estimate for each bucket of contexts, by expectation-maximisation.

    ratios[level, i]: how often, in the held-out counts, the bigram's estimate was exp((i - middle) / resolution) times
    the unigram's; i = 0: it was zero. A bucket without held-out counts takes the weight of the one below.
    """
    middle = ratios.shape[1] // 2
    r = np.exp((np.arange(ratios.shape[1]) - middle) / resolution)
    r[0] = 0
    weights = np.zeros(len(ratios))
    for level in range(1, len(ratios)):
        seen = ratios[level]
        w = 0.5 if seen.sum() else weights[level - 1]
        for _ in range(rounds if seen.sum() else 0):
            w = float((seen * (w * r / (w * r + 1 - w))).sum() / seen.sum())
            w = min(max(w, 1e-6), 1 - 1e-6)
        weights[level] = w
    return weights


def score_texts(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", settings: Settings = Settings()
) -> DataFrame:
    """id_col, held_out, n_tokens, n_known, train_tokens, base_score, score (log10 probabilities of the whole text).

    Tokens: words with A-Z in lower case, then one end. Unigram: (c + alpha) / (N + alpha * (V + 1)). Score: a mixture of
    the bigram's maximum-likelihood estimate and that unigram, the weight by the frequency of the context (the word
    before; at the start, the start of a text). Weights are learned on fold 1 with counts of the other training folds;
    then all training folds are counted.

    A null text is empty: one end. Rows without an id are not learned from: held_out. Repeated rows count each. Without
    training rows the unigram is uniform. Other columns are ignored. No rows in, none out.

    Texts are dealt by hash into batches of a bounded size, once to count and once to score; between them goes one row
    of keys for each batch and range of keys, so nothing depends on how frequent a word is, and no model is collected.
    """
    s = settings
    fold = F.crc32(F.col(id_col).cast("string")) % s.folds
    role = F.when(F.col(id_col).isNull() | (fold == 0), SCORED).when(fold == 1, TUNED).otherwise(COUNTED)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), role.alias("role"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    unit = s.unit(size)
    small = max(1, round(size / unit / s.folds))
    large = max(1, round(size * (s.folds - 2) / unit / s.folds))
    h = F.xxhash64("id", "text")
    batch = F.when(F.col("role") == COUNTED, 2 * small + F.pmod(h, F.lit(large))).otherwise(
        F.col("role") * small + F.pmod(h, F.lit(small))
    )
    batched = rows.withColumn("batch", batch.cast("bigint"))
    told = exchange(batched, max(1, round(size / unit / 2)))
    sums = told.agg(*[F.sum(c) for c in ("tokens", "counted_tokens", "types", "counted_types")]).first()
    n_all, n_counted, v_all, v_counted = (x or 0 for x in sums)
    alpha = s.alpha
    bins = 2 * 40 * s.resolution + 1

    def unigram(c: np.ndarray, n: int, v: int) -> np.ndarray:
        return (c + alpha) / (n + alpha * (v + 1))

    def ratios(table: pa.Table, answers: pa.Table) -> pa.Table:
        out: dict[str, list] = {"level": [], "i": [], "n": []}
        if table.num_rows:
            t = Tokens(table["text"].to_pylist())
            words, pairs = _told(answers, "counted")
            context = words[t.before_at]
            p2 = pairs[t.pair_at] / np.maximum(context, 1)
            ratio = p2 / unigram(words[t.word_at], n_counted, v_counted)
            with np.errstate(divide="ignore"):
                i = np.clip(np.round(np.log(ratio) * s.resolution) + bins // 2, 0, bins - 1).astype(np.int64)
            cell, n = np.unique(_level(context) * bins + i, return_counts=True)
            out = {"level": list(cell // bins), "i": list(cell % bins), "n": list(n)}
        return _table(out, {"level": pa.int64(), "i": pa.int64(), "n": pa.int64()})

    seen = np.zeros((LEVELS, bins))
    tuned = batched.where(F.col("role") == TUNED).select("batch", "text")
    of_tuned = told.where((F.col("batch") >= small) & (F.col("batch") < 2 * small)).select("batch", "kind", "part", "counted")
    cells = (
        tuned.groupBy("batch")
        .cogroup(of_tuned.groupBy("batch"))
        .applyInArrow(ratios, "level bigint, i bigint, n bigint")
        .groupBy("level", "i")
        .agg(F.sum("n").alias("n"))
    )
    for r in cells.collect():  # at most LEVELS * bins cells, whatever the corpus
        seen[r["level"], r["i"]] = r["n"]
    weights = learn_weights(seen, s.resolution, s.em_rounds)

    id_type = rows.schema["id"].dataType

    def score(table: pa.Table, answers: pa.Table) -> pa.Table:
        t = Tokens(table["text"].to_pylist())
        words, pairs = _told(answers, "total")
        c, context = words[t.word_at], words[t.before_at]
        p1 = unigram(c, n_all, v_all)
        w = weights[_level(context)]
        p = w * pairs[t.pair_at] / np.maximum(context, 1) + (1 - w) * p1
        firsts = np.cumsum(t.sizes) - t.sizes
        return pa.table(
            {
                "id": table["id"],
                "role": table["role"],
                "n_tokens": pa.array(t.sizes, pa.int64()),
                "n_known": pa.array(np.add.reduceat((c > 0).astype(np.int64), firsts), pa.int64()),
                "base_score": pa.array(np.add.reduceat(np.log10(p1), firsts), pa.float64()),
                "score": pa.array(np.add.reduceat(np.log10(p), firsts), pa.float64()),
            }
        )

    made = f"id {id_type.simpleString()}, role int, n_tokens bigint, n_known bigint, base_score double, score double"
    scored = (
        batched.select("batch", "id", "role", "text")
        .groupBy("batch")
        .cogroup(told.select("batch", "kind", "part", "total").groupBy("batch"))
        .applyInArrow(score, made)
    )
    return scored.select(
        F.col("id").alias(id_col),
        (F.col("role") == SCORED).alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(n_all).cast("bigint").alias("train_tokens"),
        "base_score",
        "score",
    )
