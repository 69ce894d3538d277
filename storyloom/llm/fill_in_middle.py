"""Fill-in-the-middle: texts as piece tables, cut at hashed places and rearranged by moving descriptors, not text."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyloom.llm.common import map_texts

#: The sentinels of prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
SENTINELS = PREFIX + SUFFIX + MIDDLE
SENTINEL = re.compile(b"<[PSM]>")
#: The order of parts and sentinels in each form.
ORDER = {"psm": (PREFIX, "prefix", SUFFIX, "suffix", MIDDLE, "middle"), "spm": (SUFFIX, "suffix", PREFIX, "prefix", MIDDLE, "middle")}
PARTS = ("prefix", "middle", "suffix")
_WHITE = np.zeros(256, bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True


@dataclass(frozen=True)
class Piece:
    """Bytes start to end of one of the table's buffers."""

    buffer: int
    start: int
    end: int


class PieceTable:
    """A sequence of pieces over buffers that never change: the text's bytes and the sentinels'."""

    def __init__(self, text: bytes, pieces: list[Piece] | None = None) -> None:
        self.buffers = (memoryview(text), memoryview(SENTINELS))
        self.pieces = [Piece(0, 0, len(text))] if pieces is None else pieces

    def cut(self, *places: int) -> PieceTable:
        """The same bytes with a piece's end at each of the places, given in order; a place may cut off an empty piece."""
        out, left, places = [], 0, list(places)
        for p in self.pieces:
            size = p.end - p.start
            while places and places[0] <= left + size:
                at = p.start + places.pop(0) - left
                out.append(Piece(p.buffer, p.start, at))
                left, size, p = left + at - p.start, p.end - at, Piece(p.buffer, at, p.end)
            out.append(p)
            left += size
        return PieceTable(self.buffers[0].obj, out)

    def arrange(self, form: str) -> PieceTable:
        """Of a table of prefix, middle and suffix: a form's order, with sentinels."""
        named = dict(zip(PARTS, self.pieces, strict=True))
        at = lambda s: Piece(1, SENTINELS.index(s), SENTINELS.index(s) + len(s))
        return PieceTable(self.buffers[0].obj, [named[x] if isinstance(x, str) else at(x) for x in ORDER[form]])

    def restore(self, form: str) -> PieceTable:
        """The inverse: of a table in a form's order, prefix, middle and suffix without sentinels."""
        return PieceTable(self.buffers[0].obj, [self.pieces[ORDER[form].index(part)] for part in PARTS])

    def stream(self) -> Iterator[memoryview]:
        for p in self.pieces:
            yield self.buffers[p.buffer][p.start : p.end]

    def sha256(self) -> str:
        """Of all bytes in order; they are never put together."""
        h = hashlib.sha256()
        for part in self.stream():
            h.update(part)
        return h.hexdigest()

    def __bytes__(self) -> bytes:
        return b"".join(self.stream())


def unit_ends(text: bytes) -> np.ndarray:
    """Byte offsets at which the text's units end: a word with the white space before it, or white space at the end."""
    data = np.frombuffer(text, np.uint8)
    if not len(data):
        return np.zeros(0, np.int64)
    white = _WHITE[data]
    ends = np.flatnonzero(~white[:-1] & white[1:]) + 1
    return np.append(ends, len(data))


def points(part: memoryview | bytes) -> int:
    """Code points of UTF-8 bytes."""
    return int((np.frombuffer(part, np.uint8) & 0xC0 != 0x80).sum())


def draws(seed: int, key) -> list[int]:
    """Four numbers of 32 bits from the hash of a seed and an id."""
    digest = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()
    return [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]


def opened(output: bytes, form: str) -> PieceTable:
    """An output of a form as a piece table over it, cut where its sentinels are. Their texts hold none, so the first
    three found are theirs."""
    found = [m.span() for m in SENTINEL.finditer(output)]
    if [output[s:e] for s, e in found] != [x for x in ORDER[form] if isinstance(x, bytes)]:
        raise ValueError(f"not an output of form {form}")
    return PieceTable(output).cut(*[place for span in found for place in span][1:])


def fill_in_middle(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", seed: int = 42, rate: int = 50, spm: int = 80, output: bool = True
) -> DataFrame:
    """id_col, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256 and, unless left out, output.

    A whole text is cut into n units (a word with the white space before it; white space at its end). The hash of seed and
    id draws two places, and the form: `rate` in a hundred are rearranged, `spm` in a hundred of those with the suffix
    first. Texts that are empty, null (taken as empty) or hold a sentinel stay plain: their output is the text,
    prefix_chars and middle_chars are null. restored_sha256 is of the text that unfilled() makes of output and form.

    One row for each row, none for none; rows that repeat an id and a text have equal results; a null id draws as an
    empty one. Memory is one Arrow batch and the longest text, twice: pieces are descriptors, only the output is put
    together. Other columns are ignored. No shuffle.
    """
    made = "n bigint, form string, prefix_chars bigint, middle_chars bigint, output_sha256 string, restored_sha256 string"
    made += ", output string" if output else ""
    keyed = docs.select(id_col, F.struct(F.col(id_col).alias("key"), F.col(text_col).alias("text")).alias(f"{id_col}_row"))

    def of(rows: list[dict]) -> dict[str, list]:
        out = [_filled((r["text"] or "").encode(), draws(seed, r["key"]), rate, spm, output) for r in rows]
        return {name: [x[name] for x in out] for name in out[0]} if out else {}

    return map_texts(keyed, id_col, f"{id_col}_row", made, of)


def _filled(text: bytes, drawn: list[int], rate: int, spm: int, output: bool) -> dict:
    h1, h2, h3, h4 = drawn
    ends = unit_ends(text)
    n = len(ends)
    row = {"n": n, "form": "plain", "prefix_chars": None, "middle_chars": None}
    table = PieceTable(text)
    if text and h3 % 100 < rate and not SENTINEL.search(text):
        lo, hi = sorted((h1 % (n + 1), h2 % (n + 1)))
        places = [int(ends[k - 1]) if k else 0 for k in (lo, hi)]
        parts = table.cut(*places)
        prefix, middle, _ = parts.stream()
        row |= {"form": "spm" if h4 % 100 < spm else "psm", "prefix_chars": points(prefix), "middle_chars": points(middle)}
        table = parts.arrange(row["form"])
    whole = bytes(table)
    back = PieceTable(whole) if row["form"] == "plain" else opened(whole, row["form"]).restore(row["form"])
    row |= {"output_sha256": table.sha256(), "restored_sha256": back.sha256()}
    return row | ({"output": whole.decode()} if output else {})


def unfilled(rows: DataFrame, *, id_col: str = "doc_id", output_col: str = "output", form_col: str = "form") -> DataFrame:
    """id_col and text: what fill_in_middle() was given, from its output and form alone. A null output becomes empty; an
    output that doesn't have its form's sentinels is an error. Rows, repeats and other columns as there."""
    keyed = rows.select(id_col, F.struct(F.col(output_col).alias("output"), F.col(form_col).alias("form")).alias(f"{id_col}_row"))

    def of(values: list[dict]) -> dict[str, list]:
        pairs = [((v["output"] or "").encode(), v["form"]) for v in values]
        return {"text": [(x if form == "plain" else bytes(opened(x, form).restore(form))).decode() for x, form in pairs]}

    return map_texts(keyed, id_col, f"{id_col}_row", "text string", of)
