"""Benchmark decontamination: a generalised suffix automaton of the items, along which document words are streamed."""

from __future__ import annotations

import hashlib
import re
import uuid
from collections import OrderedDict
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Words of the contract: ASCII letters and digits, and everything beyond ASCII. bytes.lower() changes A-Z only.
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def words(text: str | None) -> list[bytes]:
    return WORD.findall(text.encode().lower()) if text else []


class ItemAutomaton:
    """All substrings of word sequences. A document is read word by word; the state and the length of the longest match
    that ends there tell which windows end there.

    A window is `window` consecutive words of an item; an item of fewer words, but not none, is one window.
    """

    def __init__(self, items: Iterable[tuple[int, list[bytes]]], window: int = 13) -> None:
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link: list[int] = [-1]
        self.length: list[int] = [0]
        own: list[tuple[int, int, int]] = []  # (state, words matched, item): windows by where they end
        for item, tokens in items:
            state = 0
            numbers = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in tokens]
            for k, c in enumerate(numbers, 1):
                state = self._add(state, c)
                if k >= window:
                    own.append((state, window, item))
            if 0 < len(numbers) < window:
                own.append((state, len(numbers), item))
        #: By state, the windows that are its own suffixes' lengths: {words: items}. Found at the state whose range of
        #: lengths holds the window's, so that one occurrence names all items with that window.
        at: dict[int, dict[int, set[int]]] = {}
        for state, n, item in own:
            while self.length[self.link[state]] >= n:
                state = self.link[state]
            at.setdefault(state, {}).setdefault(n, set()).add(item)
        #: By state, all (words, items) on its way to the root, longest first.
        self.windows: list[tuple[tuple[int, frozenset], ...]] = [()] * len(self.next)
        for state in sorted(range(len(self.next)), key=self.length.__getitem__):
            mine = sorted(((n, frozenset(x)) for n, x in at.get(state, {}).items()), key=lambda w: -w[0])
            above = self.windows[self.link[state]] if state else ()
            self.windows[state] = (*mine, *above)

    def _add(self, last: int, c: int) -> int:
        """The state for the match `last` extended by the word c; new states as needed."""
        if (known := self.next[last].get(c)) is not None:
            return known if self.length[known] == self.length[last] + 1 else self._split(last, c, known)
        new = self._state({}, self.length[last] + 1)
        at = last
        while at >= 0 and c not in self.next[at]:
            self.next[at][c] = new
            at = self.link[at]
        if at < 0:
            self.link[new] = 0
        else:
            known = self.next[at][c]
            self.link[new] = known if self.length[known] == self.length[at] + 1 else self._split(at, c, known)
        return new

    def _split(self, at: int, c: int, known: int) -> int:
        """A state for the shorter strings of `known`, those that end the longest string of `at` and c."""
        part = self._state(dict(self.next[known]), self.length[at] + 1)
        self.link[part], self.link[known] = self.link[known], part
        while at >= 0 and self.next[at].get(c) == known:
            self.next[at][c] = part
            at = self.link[at]
        return part

    def _state(self, moves: dict[int, int], length: int) -> int:
        self.next.append(moves)
        self.link.append(0)
        self.length.append(length)
        return len(self.next) - 1

    def hits(self, tokens: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Spans [from, to) of the words inside occurring windows, merged and in order; the items of these windows."""
        spans: list[tuple[int, int]] = []
        found: set[int] = set()
        moves, link, length, windows = self.next, self.link, self.length, self.windows
        state = matched = 0
        for k, c in enumerate(map(self.vocabulary.get, tokens), 1):
            if c is None:
                state = matched = 0
                continue
            while state and c not in moves[state]:
                state = link[state]
                matched = length[state]
            if (to := moves[state].get(c)) is None:
                continue
            state, matched = to, matched + 1
            reach = 0
            for n, items in windows[state]:
                if n <= matched:
                    reach = reach or n
                    found |= items
            if reach:
                start = k - reach
                while spans and spans[-1][1] >= start:
                    start = min(start, spans.pop()[0])
                spans.append((start, k))
        return spans, found


#: Automata of the blocks used last, by worker process.
_built: OrderedDict[tuple[str, int], ItemAutomaton] = OrderedDict()
MOST_BUILT = 4


def _automaton(name: str, number: int, items: tuple[tuple[int, str], ...], window: int) -> ItemAutomaton:
    key = (name, number)
    if key not in _built:
        while len(_built) >= MOST_BUILT:
            _built.popitem(last=False)
        _built[key] = ItemAutomaton(((i, words(t)) for i, t in items), window)
    _built.move_to_end(key)
    return _built[key]


def item_blocks(items: DataFrame, *, id_col: str, text_col: str, block_bytes: int) -> Iterator[tuple[tuple[int, str], ...]]:
    """The items in blocks of at most block_bytes of text (more only for one larger item), one at a time on the driver.
    Items without an id or without text hold no windows."""
    block: list[tuple[int, str]] = []
    size = 0
    rows = items.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("id is not null and text is not null")
    for row in rows.distinct().toLocalIterator():
        n = len(row["text"].encode())
        if block and size + n > block_bytes:
            yield tuple(block)
            block, size = [], 0
        block.append((row["id"], row["text"]))
        size += n
    if block:
        yield tuple(block)


class Items:
    """Benchmark items in the tasks: broadcast texts in blocks, of which each task builds automata."""

    def __init__(self, items: DataFrame, *, id_col: str, text_col: str, window: int, block_bytes: int) -> None:
        context = items.sparkSession.sparkContext
        self.blocks = [context.broadcast(b) for b in item_blocks(items, id_col=id_col, text_col=text_col, block_bytes=block_bytes)]
        self.window, self.name = window, uuid.uuid4().hex

    def hits(self, texts: list[str | None]) -> list[tuple[int, list[tuple[int, int]], set]]:
        """(number of words, merged spans, items) of each text. All texts pass one block before the next is built."""
        out: list[tuple[int, list[tuple[int, int]], set]] = [(0, [], set())] * len(texts)
        for number, block in enumerate(self.blocks):
            automaton = _automaton(self.name, number, block.value, self.window)
            for i, text in enumerate(texts):
                tokens = words(text)
                spans, found = automaton.hits(tokens)
                _, before, ids = out[i]
                out[i] = (len(tokens), merged([*before, *spans]) if before and spans else before or spans, ids | found)
        return out if self.blocks else [(len(words(t)), [], set()) for t in texts]


def _held(batches: Iterator[pa.RecordBatch], place: int, most_bytes: int) -> Iterator[pa.RecordBatch]:
    """The batches joined up to most_bytes (more only for one larger row), so that a block is built for many texts."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        n = batch.column(place).nbytes
        if held and size + n > most_bytes:
            yield pa.concat_batches(held)
            held, size = [], 0
        held.append(batch)
        size += n
    if held:
        yield pa.concat_batches(held)


#: Bytes of texts that a task holds where there are more blocks than automata it keeps.
HELD_BYTES = 32_000_000
#: Rows that are turned into Python objects at once elsewhere.
STEP = 500


def _through(rows: DataFrame, place: int, items: Items, schema: StructType, made: Callable) -> DataFrame:
    """made(batch, hits) of all rows, whose texts are in the column at `place`."""
    many = len(items.blocks) > MOST_BUILT

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _held(batches, place, HELD_BYTES) if many else batches:
            step = batch.num_rows if many else STEP
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                yield made(part, items.hits(part.column(place).to_pylist()))

    return rows.mapInArrow(run, schema)


def _bad(n_words: int, spans: list[tuple[int, int]], max_percent: int) -> bool:
    hit = sum(b - a for a, b in spans)
    return hit > 0 and 100 * hit >= max_percent * n_words


def find_contamination(
    docs: DataFrame,
    items: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = 13,
    max_percent: int = 5,
    block_bytes: int = 1_000_000,
) -> DataFrame:
    """id_col, n_words, n_hit, n_items, item_ids (sorted as strings), items_sha256, contaminated (n_hit > 0 and at least
    max_percent of the words), spans (merged word ranges [from, to) that are hit). One row for each row of docs.

    A null or empty text has no words and is clean; long ones are read whole. Rows that repeat are answered alike. An
    item without id or text is no item; repeated items count once; without items all is clean. Other columns are ignored.

    Automata are built in the tasks from broadcast item texts of at most block_bytes each. Documents pass the blocks in
    one stream of batches; a task keeps four automata, and with more blocks holds 32 MB of texts for each it builds, so
    time grows with documents times blocks and memory doesn't. What is broadcast is the items' text. No shuffle.
    """
    made = (
        "n_words bigint, n_hit bigint, n_items bigint, item_ids array<string>, items_sha256 string, "
        "contaminated boolean, spans array<struct<`from`: int, `to`: int>>"
    )
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = StructType([rows.schema["id"], *StructType.fromDDL(made).fields])
    arrow = to_arrow_schema(schema)

    def answer(batch: pa.RecordBatch, hits: list) -> pa.RecordBatch:
        ids = [sorted(map(str, found)) for _, _, found in hits]
        columns = (
            [n for n, _, _ in hits],
            [sum(b - a for a, b in spans) for _, spans, _ in hits],
            [len(x) for x in ids],
            ids,
            [hashlib.sha256(",".join(x).encode()).hexdigest() for x in ids],
            [_bad(n, spans, max_percent) for n, spans, _ in hits],
            [[{"from": a, "to": b} for a, b in spans] for _, spans, _ in hits],
        )
        return pa.RecordBatch.from_arrays(
            [batch.column(0), *(pa.array(v, f.type) for v, f in zip(columns, list(arrow)[1:], strict=True))], schema=arrow
        )

    shared = Items(items, id_col=item_col, text_col=item_text_col, window=window, block_bytes=block_bytes)
    return _through(rows, 1, shared, schema, answer).withColumnRenamed("id", id_col)


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and out[-1][1] >= a:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def cut_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of the spans and what lies between those words."""
    data = text.encode()
    places = [m.span() for m in WORD.finditer(data.lower())]
    keep, at = [], 0
    for a, b in spans:
        keep.append(data[at : places[a][0]])
        at = places[b - 1][1]
    keep.append(data[at:])
    return b"".join(keep).decode()


def decontaminate(
    docs: DataFrame,
    items: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = 13,
    max_percent: int = 5,
    cut: bool = False,
    block_bytes: int = 1_000_000,
) -> DataFrame:
    """The rows of docs that are not contaminated, with all their columns, whatever their names. Nulls, repeats, long
    texts and empty tables as in find_contamination().

    With cut, hit spans of the documents that stay (those under the coverage limit) are removed from text_col.
    """
    place = docs.columns.index(text_col)

    def keep(batch: pa.RecordBatch, hits: list) -> pa.RecordBatch:
        if cut:
            texts = batch.column(place).to_pylist()
            columns = list(batch.columns)
            columns[place] = pa.array([cut_spans(t, spans) if spans else t for t, (_, spans, _) in zip(texts, hits, strict=True)], columns[place].type)
            batch = pa.RecordBatch.from_arrays(columns, schema=batch.schema)
        return batch.filter(pa.array([not _bad(n, spans, max_percent) for n, spans, _ in hits], pa.bool_()))

    shared = Items(items, id_col=item_col, text_col=item_text_col, window=window, block_bytes=block_bytes)
    return _through(docs, place, shared, docs.schema, keep)
