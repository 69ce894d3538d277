"""Token counts: exact counts at every prefix of a text, for truncation and budgets without encoding again."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyloom.llm.bpe_prefix import PrefixTable, Remembered
from storyloom.llm.common import map_texts

#: Fixed value: how byte-level BPE cuts a text into pieces.
PIECES = regex.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""")

#: Where pieces depend on more than their own word.
GAP = re.compile(r"\s\s")

#: A space or line end where pieces end whatever follows: between two other characters.
LONE = re.compile(r"(?<=\S)[ \n](?=\S)")

#: White space as PIECES has it, which leaves out some characters of str.isspace().
RUN = regex.compile(r"\s+")
WHITE = frozenset(c for c in map(chr, range(0x3001)) if RUN.match(c))

#: Letters of the longest piece of the form 's; cut off, its letters are pieces of their own.
LONGEST_FORM = 3


def _byte_of() -> dict[str, int]:
    """Characters that stand for bytes in such vocabularies: printable ones for themselves, others from U+0100 up."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(other)}


def as_symbols(text: str) -> str:
    """The UTF-8 bytes of a text, one character for each."""
    return text if text.isascii() else text.encode().decode("latin-1")


class Counter:
    """Exact counts for one byte-level BPE vocabulary, as its library gives them by default (special strings inside a
    text are one token each; none are added)."""

    def __init__(self, definition: dict) -> None:
        byte = _byte_of()
        raw = lambda s: "".join(chr(byte[c]) for c in s)
        model = definition["model"]
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        ranks = {(raw(a), raw(b)): i for i, (a, b) in enumerate(pairs)}
        self.table = PrefixTable(map(raw, model["vocab"]), lambda a, b: ranks.get((a, b)))
        special = sorted((t["content"] for t in definition["added_tokens"]), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.pieces = Remembered(lambda piece: self.table.total(as_symbols(piece)))
        self.bare = Remembered(self._whole)  # of words that follow nothing or a line end
        self.spaced = Remembered(lambda word: self._whole(" " + word))

    def _whole(self, text: str) -> int:
        return sum(map(self.pieces.__getitem__, PIECES.findall(text)))

    def _plain(self, text: str) -> int:
        """Pieces never reach over a lone space or line end between other characters, so those cut the work."""
        if GAP.search(text):
            return self._whole(text)
        n = text.count("\n")
        for line in text.split("\n"):
            first, *others = line.split(" ")
            n += self.bare[first] + sum(map(self.spaced.__getitem__, others))
        return n

    def _spans(self, text: str) -> Iterator[tuple[str, bool]]:
        """(part, whether it is one special token) over the whole text."""
        at = 0
        for m in self.special.finditer(text) if self.special else ():
            yield text[at : m.start()], False
            yield m[0], True
            at = m.end()
        yield text[at:], False

    def total(self, text: str) -> int:
        """Tokens of the whole text: the last entry of its prefix table."""
        return sum(1 if special else self._plain(part) for part, special in self._spans(text))

    def prefixes(self, text: str) -> list[int]:
        """Token counts of text[:p] for p from 0 to len(text), each as if that prefix alone were encoded."""
        out, done, tail, head = [0], 0, "", 0
        for part, special in self._spans(text):
            if special:  # a cut inside is ordinary text that continues the last word before
                out += [head + self._plain(tail + part[:q]) for q in range(1, len(part))]
                done += 1
                out.append(done)
                tail, head = "", done
            else:
                start = len(out) - 1
                out += self._inside(part, done)
                done += self._plain(part)
                cut = max((m.start() for m in LONE.finditer(part)), default=0)
                tail, head = part[cut:], out[start + cut]
        return out

    def _inside(self, part: str, done: int) -> list[int]:
        """Counts at each cut of a part without special tokens, after done tokens."""
        out: list[int] = []
        run = end = 0  # where the white space that the cut is in begins and ends
        run_done, run_counts, run_size = done, [0], 0  # tokens before it, of its prefixes, its bytes up to the cut
        for m in PIECES.finditer(part):
            piece, start = m[0], m.start()
            form = piece[0] == "'" and len(piece) <= LONGEST_FORM
            counts = None if form or piece[-1] in WHITE else self.table.counts(as_symbols(piece))
            size = 0
            for q, c in enumerate(piece, 1):
                size += len(c.encode())
                if c in WHITE:  # all white space up to the cut is one piece: a prefix of the whole run
                    if start + q > end:
                        run = start + q - 1
                        end = RUN.match(part, run).end()
                        run_done, run_counts, run_size = out[-1] if out else done, self.table.counts(as_symbols(part[run:end])), 0
                    run_size += len(c.encode())
                    out.append(run_done + run_counts[run_size])
                else:
                    out.append(done + (counts[size] if counts else self._plain(piece[:q])))
            done += self.pieces[piece]
        return out

    def fit(self, text: str, limit: int) -> int:
        """Code points in the longest prefix of at most limit tokens, read from the prefix table."""
        return max(p for p, n in enumerate(self.prefixes(text)) if n <= limit)


@lru_cache(maxsize=2)
def counter(definition: str) -> Counter:
    """One Counter for each worker process and vocabulary."""
    return Counter(json.loads(definition))


def read_vocabulary(path: str) -> str:
    """Text of a tokenizer file, read once on the driver and sent with the tasks (1.5 MB)."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def count_tokens(
    docs: DataFrame, vocabulary: str, *, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024
) -> DataFrame:
    """id_col, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit) of each whole text, one row for each row.

    Null and empty texts have no tokens. Other columns are ignored; null ids and repeated rows stay as they are; an empty
    table gives none. Texts of any length are counted whole. No shuffle; memory is one Arrow batch, the table of the
    longest piece and a bounded table of pieces for each worker.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def count(texts: list[str | None]) -> dict[str, list]:
        total = counter(shared.value).total
        return {"n_bytes": [len((t or "").encode()) for t in texts], "n_tokens": [total(t) if t else 0 for t in texts]}

    out = map_texts(docs, id_col, text_col, "n_bytes bigint, n_tokens bigint", count)
    return out.withColumn("over_limit", F.col("n_tokens") > limit)


def prefix_counts(docs: DataFrame, vocabulary: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col and prefix_tokens: the exact token count of each prefix, by its code points from 0 to the whole text.

    With it, get(prefix_tokens, p) is the cost of a prefix and the array's last entry the cost of the text, so budgets
    are answered in Spark without encoding again. Null texts are taken as empty: one entry, 0. The table of a text has an
    entry for each code point, whatever its length, and is filled in one pass; ids, repeated rows, other columns and empty
    tables as in count_tokens().
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def table(texts: list[str | None]) -> dict[str, list]:
        return {"prefix_tokens": [counter(shared.value).prefixes(t or "") for t in texts]}

    return map_texts(docs, id_col, text_col, "prefix_tokens array<int>", table, step=50)


def truncate(
    docs: DataFrame, vocabulary: str, limit: int, *, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """id_col and text cut to its longest prefix of at most limit tokens; a null text becomes empty. Texts of any length,
    ids, repeated rows, other columns and empty tables as in prefix_counts()."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def cut(texts: list[str | None]) -> dict[str, list]:
        return {"text": [(t or "")[: counter(shared.value).fit(t or "", limit)] for t in texts]}

    return map_texts(docs, id_col, text_col, "text string", cut)
