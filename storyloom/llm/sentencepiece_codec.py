"""SentencePiece encoding and decoding by a streaming Viterbi pass over a bounded window."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import sentencepiece
from pyspark.sql import DataFrame

from storyloom.llm.bpe_prefix import PrefixTable, Remembered
from storyloom.llm.common import map_texts

#: Fixed value: the mark that stands for a space.
SPACE = "▁"


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of a protocol-buffer message: numbers, or the bytes of strings and messages."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = number()
        size = {0: None, 1: 8, 5: 4}.get(key & 7, 0)
        if size is None:
            yield key >> 3, number()
            continue
        size = size or number()
        yield key >> 3, data[at : at + size]
        at += size


def check_model(model: bytes) -> None:
    """Raises ValueError unless the model is byte-pair encoded with byte fallback, and its normaliser leaves a text as it
    is but for one space put before it and the mark written for each space."""
    # Field numbers and defaults of the model format.
    messages = {n: dict(_fields(v)) for n, v in _fields(model) if n in (2, 3)}
    trainer, normaliser = messages.get(2, {}), messages.get(3, {})
    if trainer.get(3, 1) != 2:
        raise ValueError("only byte-pair models can be encoded here")
    if not trainer.get(35, 0):
        raise ValueError("the model has no byte fallback")
    if normaliser.get(2) or not normaliser.get(3, 1) or normaliser.get(4, 1) or not normaliser.get(5, 1) or trainer.get(24, 0):
        raise ValueError("the model's normaliser changes texts in ways that aren't done here")


class Codec:
    """Encoder and decoder of a BPE model with byte fallback, with the text's spaces kept as they are.

    The lattice has an arc for each piece between two boundaries. A boundary's surviving path is the one whose last
    pieces are what merging makes of them (see PrefixTable), which is the model's own best segmentation of the prefix.

    No piece reaches over the beginning of white space, so all surviving paths meet there. With remember, the window's
    run between two such boundaries is looked up if the same run of text was met before; without, the window runs over
    the text from end to end and finds where paths meet by following them back.
    """

    def __init__(self, model: bytes, remember: bool = True) -> None:
        check_model(model)
        self.remember = remember
        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        self.bytes = {int(self.pieces[i][1:-1], 16): i for i in range(len(self.pieces)) if sp.is_byte(i)}
        normal = [
            i for i in range(len(self.pieces)) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))
        ]
        self.ids = {self.pieces[i]: i for i in normal}
        #: What an id adds to a decoded text; bytes from 0x80 as lone surrogates until they are put together.
        self.shown = ["" if sp.is_control(i) else p.replace(SPACE, " ") for i, p in enumerate(self.pieces)]
        for b, i in self.bytes.items():
            self.shown[i] = chr(b) if b < 0x80 else chr(0xDC00 + b)
        scores = {self.pieces[i]: (-sp.get_score(i)) for i in normal}
        self.table = PrefixTable(self.ids, lambda a, b: scores.get(a + b))
        #: All paths meet where white space begins, as no piece reaches over that, and around symbols without a piece.
        self.crossing = any(SPACE in p.lstrip(SPACE) for p in self.ids)
        inner = "".join(re.escape(c) for c in sorted(self.ids) if len(c) == 1 and c != SPACE)
        self.chunk = re.compile(
            f"[{SPACE}{inner}]+|." if self.crossing or not remember else f"{SPACE}+[{inner}]*|[{inner}]+|.", re.S
        )
        self.chunks = Remembered(lambda chunk: tuple(self.stream(chunk)))
        self.bare = Remembered(self._whole)
        self.spaced = Remembered(lambda word: self._whole(SPACE + word))
        self.line_end = self._whole("\n")
        #: Most boundaries that a window has held.
        self.widest = 0

    def stream(self, text: str) -> Iterator[int]:
        """Ids of a chunk. Arcs start within the longest piece's length; ids are committed as soon as the paths back
        from all boundaries that a later piece can start from share a boundary."""
        if len(text) == 1:
            yield from self._token_ids(text)
            return
        reach, tokens = self.table.longest, self.table.tokens
        last = {0: 0}
        done = 0
        for end in self.table.boundaries(text, last):
            if end < len(text) and (end - done < 2 * reach or end % reach):
                continue  # paths are followed back every `reach` characters: a window holds about three times that
            self.widest = max(self.widest, len(last))
            fronts = [end] if end == len(text) else range(end - reach + 1, end + 1)
            paths = [self._path(last, front, done) for front in fronts]
            for ends in zip(*paths):
                if len(set(ends)) > 1:
                    break
                yield from self._token_ids(tokens[last[ends[0]]])
                for passed in range(done, min(ends[0], end - reach + 1)):
                    last.pop(passed, None)
                done = ends[0]

    def _path(self, last: dict, front: int, done: int) -> list[int]:
        """Boundaries after done on the surviving path to front, in order."""
        path = []
        while front > done:
            path.append(front)
            front -= len(self.table.tokens[last[front]])
        return path[::-1]

    def _token_ids(self, token: str) -> list[int]:
        known = self.ids.get(token)
        return [known] if known is not None else [self.bytes[b] for b in token.encode()]

    def encode(self, text: str) -> list[int]:
        """Ids of a text. Lone spaces and line ends are boundaries of all paths, so words can be looked up."""
        if not text:
            return []
        if not self.remember:
            return list(chain.from_iterable(map(self.stream, self.chunk.findall(SPACE + text.replace(" ", SPACE)))))
        if text[0] == " " or "  " in text or SPACE in text or self.crossing or len(self.line_end) != 1:
            return list(self._whole(SPACE + text.replace(" ", SPACE)))
        out: list[int] = []
        for k, line in enumerate(text.split("\n")):
            first, *others = line.split(" ")
            if k:
                out += self.line_end
                out += self.bare[first]
            else:
                out += self.spaced[first]
            out += chain.from_iterable(map(self.spaced.__getitem__, others))
        return out

    def _whole(self, marked: str) -> tuple[int, ...]:
        return tuple(chain.from_iterable(map(self.chunks.__getitem__, self.chunk.findall(marked))))

    def decode(self, ids: list[int]) -> str:
        """The text of ids. Byte pieces are read as UTF-8, each broken byte as U+FFFD; control ids are silent."""
        text = "".join(map(self.shown.__getitem__, ids))
        if not text.isascii():
            text = text.encode("utf-8", "surrogateescape").decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


@lru_cache(maxsize=2)
def codec(model: bytes) -> Codec:
    """One Codec for each worker process and model."""
    return Codec(model)


def read_model(path: str) -> bytes:
    """Bytes of a model file, read once on the driver and sent with the tasks (0.5 MB)."""
    with open(path, "rb") as f:
        return f.read()


def encode(docs: DataFrame, model: bytes, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, ids array<int>, n_ids, decoded, round_trip: the ids of each whole text, what they decode to, and whether
    that is the text itself. One row for each row, none for none; rows that repeat an id or a text are encoded each. Texts
    of any length are encoded whole.

    A null or empty text has no ids and decodes to an empty text. The space mark itself, U+2581, reads as a space, as
    in the model's library; only texts with it do not come back unchanged. Other columns are ignored. No shuffle.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(texts: list[str | None]) -> dict[str, list]:
        c = codec(shared.value)
        whole = [t or "" for t in texts]
        ids = [c.encode(t) for t in whole]
        decoded = [c.decode(i) for i in ids]
        return {
            "ids": [np.array(i, np.int32) for i in ids],
            "n_ids": [len(i) for i in ids],
            "decoded": decoded,
            "round_trip": [a == b for a, b in zip(whole, decoded, strict=True)],
        }

    made = "ids array<int>, n_ids bigint, decoded string, round_trip boolean"
    return map_texts(docs, id_col, text_col, made, run, step=200)
