"""HTML extraction: suffix arrays over the token streams of a host's pages find substrings that repeat across pages, which
are removed; page structure drops what is surely no article and guards what is surely one."""

from __future__ import annotations

import hashlib
import html
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from storyloom.llm.common import map_texts, staged

# HTML's own element names, and the usual names of page parts.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style title textarea noscript iframe template svg math xmp noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body br center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hr html li main menu nav ol option p pre section select summary table tbody td tfoot "
    "th thead tr ul".split()
)
STRONG = frozenset("p h1 h2 h3 h4 h5 h6 li blockquote pre td th dd dt figcaption summary".split())
DROPPED = frozenset("head nav header footer aside form menu dialog button select object canvas audio video".split())
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())
DROPPED_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion nav navbar navigation menu sidebar "
    "footer header masthead topbar toolbar breadcrumb breadcrumbs cookie cookies consent gdpr notice notification popup "
    "modal newsletter subscribe subscription signup login paywall social share sharing comment comments disqus respond "
    "reply replies related recommended recommendations widget pagination pager skip hidden".split()
)
#: Words that only say what kind of part a name is of: inside an article, names of these and DROPPED_NAMES alone count.
PART_NAMES = frozenset(
    "area bar block box button buttons container content form group holder inner item items link links list module outer panel post posts "
    "section slot story stories article articles unit widget wrap wrapper".split()
)
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/\"']+)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"']+)))?")
_MAIN = re.compile(r"role\s*=\s*[\"']?main\b")
_RAW_END = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in RAW}
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")


def _names_boilerplate(value: str, in_article: bool) -> bool:
    """Whether a class or id names a dropped part. Outside articles a word of it is enough; inside, all words of one of its
    names must: related-posts and share are no text of an article, related-work and notice-period may be."""
    if not in_article:
        return any(p.lower() in DROPPED_NAMES for p in _PART.findall(value))
    for name in value.split():
        words = [p.lower() for p in _PART.findall(name)]
        if any(w in DROPPED_NAMES for w in words) and all(w in DROPPED_NAMES or w in PART_NAMES or w.isdigit() for w in words):
            return True
    return False


def _is_dropped(tag: str, attributes: str, in_article: bool = False) -> bool:
    """An article's own header holds its title and stays."""
    if tag in DROPPED and not (tag == "header" and in_article):
        return True
    if not attributes or attributes == "/":
        return False
    for name, a, b, c in _ATTRIBUTE.findall(attributes):
        value, name = a or b or c, name.lower()
        if name == "hidden" or (name == "aria-hidden" and value == "true"):
            return True
        if name == "role" and value.lower() in DROPPED_ROLES:
            return True
        if name in ("class", "id") and _names_boilerplate(value, in_article):
            return True
    return False


@dataclass(frozen=True)
class Block:
    """A run of text between block boundaries. strong: in a text element; place: 2 in an article, 1 in main, else 0."""

    text: str
    strong: bool
    place: int


def blocks(page: str) -> list[Block]:
    """All blocks of a page outside dropped parts, in page order, white space turned into single spaces."""
    out: list[Block] = []
    parts: list[str] = []
    stack: list[tuple[str, bool]] = []  # open elements; whether each is dropped
    dropped = articles = mains = strong = 0
    at = 0

    def end_block() -> None:
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            parts.clear()
            if text:
                inner = next((name for name, _ in reversed(stack) if name in BLOCK), "")
                out.append(Block(text, strong > 0 or inner in ("article", "main"), 2 if articles else 1 if mains else 0))

    def close(depth: int) -> None:
        nonlocal dropped, articles, mains, strong
        while len(stack) > depth:
            name, off = stack.pop()
            dropped -= off
            articles -= name == "article"
            mains -= name == "main"
            strong -= name in STRONG

    while m := _TOKEN.search(page, at):
        if not dropped and m.start() > at:
            parts.append(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if tag in BLOCK:
            end_block()
        if m[1]:
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][0] == tag:
                    close(depth)
                    break
            continue
        if tag in RAW:
            ended = _RAW_END[tag].search(page, at)
            at = ended.end() if ended else len(page)
            continue
        if tag in VOID:
            continue
        if tag in BLOCK and stack and stack[-1][0] == "p" or tag == "li" and stack and stack[-1][0] == "li":
            close(len(stack) - 1)
        off = _is_dropped(tag, m[3], articles > 0)
        name = "main" if "role" in m[3] and tag != "article" and _MAIN.search(m[3]) else tag
        stack.append((name, off))
        dropped += off
        articles += name == "article"
        mains += name == "main"
        strong += name in STRONG
    if not dropped and at < len(page):
        parts.append(page[at:])
    end_block()
    return out


def candidates(page: str | None) -> tuple[list[str], list[bool]]:
    """Texts of the blocks of the page's main part, and whether each is weak: kept only if it doesn't repeat.

    The main part is what articles hold, else what main elements hold, else the page. In the first two, blocks of text
    elements and bare text are surely content; others, as in a div of its own, are weak. In the last all are weak.
    """
    found = blocks(page or "")
    best = max((b.place for b in found), default=0)
    mine = [b for b in found if b.place == best]
    return [b.text for b in mine], [best == 0 or not b.strong for b in mine]


def lengthen(rank: np.ndarray, length: int, target: int) -> np.ndarray:
    """Ranks of the substrings of `target` tokens at each position from those of `length` tokens, by prefix doubling:
    the suffix array's order as far as target; equal ranks are equal substrings."""
    n = len(rank)
    while length < target:
        step = min(length, target - length)
        later = np.full(n, -1, np.int64)
        later[: n - step] = rank[step:]
        pair = rank * (n + 1) + later + 1
        order = np.argsort(pair, kind="stable")
        fresh = np.ones(n, np.int64)
        fresh[1:] = pair[order[1:]] != pair[order[:-1]]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(fresh) - 1
        length += step
    return rank


def class_pages(rank: np.ndarray, pages: np.ndarray) -> np.ndarray:
    """On how many pages each rank occurs."""
    most = int(pages.max()) + 1
    return np.bincount(np.unique(rank * most + pages) // most, minlength=int(rank.max()) + 1)


def repeated_tokens(streams: list[list[str]], *, least_tokens: int, least_pages: int, least_share: float) -> list[np.ndarray]:
    """For each page's token stream, which tokens lie in a substring of at least least_tokens tokens that occurs on at
    least least_pages pages and on least_share of them. An end mark of its own closes each page."""
    number = Numbers()
    flat: list[int] = []
    page_of: list[int] = []
    for p, stream in enumerate(streams):
        flat += map(number.__getitem__, stream)
        flat.append(-1 - p)
        page_of += [p] * (len(stream) + 1)
    if not flat:
        return []
    rank = lengthen(np.unique(np.array(flat), return_inverse=True)[1].astype(np.int64), 1, least_tokens)
    starts = class_pages(rank, np.array(page_of))[rank] >= max(least_pages, least_share * len(streams))
    covered = _covered(starts, least_tokens)
    ends = np.flatnonzero(np.array(flat) < 0)
    bounds = [0, *(ends + 1)]
    return [covered[bounds[i] : bounds[i + 1] - 1] for i in range(len(streams))]


def _covered(starts: np.ndarray, width: int) -> np.ndarray:
    change = np.zeros(len(starts) + 1, np.int64)
    at = np.flatnonzero(starts)
    change[at] += 1
    np.add.at(change, np.minimum(at + width, len(starts)), -1)
    return np.cumsum(change[:-1]) > 0


#: Bits of the filters that leave out substrings which can't repeat. A wrong hit only adds a candidate.
_FILTER_BITS = 1 << 27


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def _hash_of(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")


def page_stream(blocks_of: list[str], weak: list[bool], least_tokens: int) -> tuple[list[str], np.ndarray]:
    """All tokens of a page's blocks, and whether each is weak. End marks close each block; a short sure block gets as
    many as make it a substring of its own."""
    tokens: list[str] = []
    flags: list[bool] = []
    for block, w in zip(blocks_of, weak, strict=True):
        mine = block.split(" ")
        mine += ["\n"] * (1 if w else max(1, least_tokens - len(mine)))
        tokens += mine
        flags += [w] * len(mine)
    return tokens, np.array(flags, bool)


class HostStreams:
    """The token streams of some pages of one host as one array. Hashes depend on host and tokens alone, so they are
    the same in every task. Streams are numbers of tokens, `known` the tokens' hashes by number. `valid`: starts of whole substrings of least_tokens tokens within one page."""

    def __init__(self, host: str, streams: list[np.ndarray], known: np.ndarray, least_tokens: int):
        self.width = least_tokens
        lengths = np.array([len(s) + 1 for s in streams])
        self.pages = np.repeat(np.arange(len(streams)), lengths)
        self.ends = np.cumsum(lengths) - 1  # of the page's end mark
        self.flat = np.concatenate([x for p, s in enumerate(streams) for x in (s, [-1 - p])]).astype(np.int64)
        self.valid = np.arange(len(self.flat)) + least_tokens <= self.ends[self.pages]
        self.token_hash = known[np.maximum(self.flat, 0)]
        self.seed = np.uint64(_hash_of(host))

    def _rolled(self, length: int) -> np.ndarray:
        out = np.zeros(len(self.flat), np.uint64)
        for j in range(length):
            out *= np.uint64(0x100000001B3)
            out[: len(out) - j] += self.token_hash[j:]
        return _mixed(_mixed(out) ^ self.seed)

    def keys(self) -> np.ndarray:
        """The hash of the substring of least_tokens tokens at each position."""
        return self._rolled(self.width)

    def minimizers(self) -> np.ndarray:
        """The least hash of the half as long substrings in each of least_tokens tokens. Equal substrings have equal
        ones, so a substring is on no more pages than its minimizer is."""
        half = (self.width + 1) // 2
        parts = self._rolled(half)
        out = parts.copy()
        for j in range(1, self.width - half + 1):
            out[: len(out) - j] = np.minimum(out[: len(out) - j], parts[j:])
        return out

    def minimizer_counts(self) -> tuple[np.ndarray, np.ndarray]:
        least, pages = self.minimizers()[self.valid], self.pages[self.valid]
        if not len(least):
            return least, pages
        fresh = np.append(True, (least[1:] != least[:-1]) | (pages[1:] != pages[:-1]))  # neighbours mostly share theirs
        found, at = np.unique(least[fresh], return_inverse=True)
        return found, class_pages(at, pages[fresh])

    def substring_counts(self, usual: np.ndarray, weak: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each distinct substring whose minimizer passes the filter: hash, pages, whether it holds a weak token. Only
        the streams of pages with such a substring are sorted; all its occurrences are on these."""
        hit = self.valid & _in_filter(usual, self.minimizers())
        if not hit.any():
            return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, bool)
        mine = np.bincount(self.pages[hit], minlength=int(self.pages[-1]) + 1)[self.pages] > 0
        flat, pages, hit, keys = self.flat[mine], self.pages[mine], hit[mine], self.keys()[mine]
        rank = lengthen(np.unique(flat, return_inverse=True)[1].astype(np.int64), 1, self.width)
        at = np.flatnonzero(hit)
        counts = class_pages(rank, pages)
        sums = np.concatenate([[0], np.cumsum(weak[mine])])
        loose = np.zeros(len(counts), bool)
        np.logical_or.at(loose, rank[at], sums[at + self.width] > sums[at])
        first = np.unique(rank[at], return_index=True)[1]
        return keys[at[first]], counts[rank[at[first]]], loose[rank[at[first]]]


class Numbers(dict):
    """Numbers of tokens in the order in which they are met."""

    def __missing__(self, token: str) -> int:
        self[token] = n = len(self)
        return n


def _in_filter(words: np.ndarray, keys: np.ndarray) -> np.ndarray:
    bit = keys % np.uint64(_FILTER_BITS)
    return (words[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1) == 1


def _filter_rows(keys: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The filter of a table of keys: its words that aren't 0. At most 2^21 rows, whatever the input."""
    bit = F.col("key").bitwiseAND(F.lit(_FILTER_BITS - 1))
    word, value = F.shiftright(bit, 6), F.expr("shiftleft(1L, cast(key & 63 as int))")
    got = keys.groupBy(word.alias("word")).agg(F.bit_or(value).alias("bits")).toArrow()
    return got["word"].to_numpy().astype(np.int64), got["bits"].to_numpy().astype(np.int64)


def _filter(rows: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    words = np.zeros(_FILTER_BITS >> 6, np.uint64)
    words[rows[0]] = rows[1].view(np.uint64)
    return words


def long_runs(covered: np.ndarray, least: int) -> list[bool]:
    """Of a block's covered tokens, those in runs of at least `least`, or all if the whole block is covered. What a
    repeated substring merely reaches into from the block before stays."""
    flags = covered.tolist()
    if all(flags):
        return flags
    start = 0
    for value, run in groupby(flags):
        n = len(list(run))
        if value and n < least:
            flags[start : start + n] = [False] * n
        start += n
    return flags


def _chunks(batches: Iterator[pa.RecordBatch], most_tokens: int, width: int) -> Iterator[tuple[list[dict], list[np.ndarray], list[tuple[list[int], HostStreams]]]]:
    """Rows of a task in chunks of about most_tokens tokens: the rows with their blocks, whether their tokens are weak,
    and for each host the places of its rows and their streams."""

    def made(rows: list[dict], streams: list[np.ndarray], weak: list[np.ndarray]):
        known = np.array([_hash_of(t) for t in number] or [0], np.uint64)
        places: dict[str, list[int]] = {}
        for i, r in enumerate(rows):
            places.setdefault(r["host"], []).append(i)
        return rows, weak, [(at, HostStreams(h, [streams[i] for i in at], known, width)) for h, at in places.items()]

    rows, streams, weak, size = [], [], [], 0
    number = Numbers()
    for batch in batches:
        for row in batch.to_pylist():
            row["blocks"], row["weak"] = candidates(row.pop("html"))
            tokens, flags = page_stream(row["blocks"], row["weak"], width)
            if rows and size + len(tokens) > most_tokens:
                yield made(rows, streams, weak)
                rows, streams, weak, size = [], [], [], 0
                number.clear()
            rows.append(row)
            streams.append(np.fromiter(map(number.__getitem__, tokens), np.int64, len(tokens)))
            weak.append(flags)
            size += len(tokens)
    if rows:
        yield made(rows, streams, weak)


def kept_text(blocks_of: list[str], weak: list[bool], keys: np.ndarray, loose: np.ndarray, sure: np.ndarray, width: int) -> str:
    """A page's text without repeated substrings: in weak blocks those in `loose`, in sure blocks those in `sure`. A page
    most of whose sure tokens would go is a copy of others: it keeps them."""
    gone_loose = _covered(np.isin(keys, loose), width)
    gone_sure = _covered(np.isin(keys, sure), width)
    at, parts, sure_tokens, sure_gone = 0, [], 0, 0
    for block, w in zip(blocks_of, weak, strict=True):
        tokens = block.split(" ")
        n = len(tokens)
        gone = long_runs((gone_loose if w else gone_sure)[at : at + n], width)
        parts.append((tokens, gone, w))
        if not w:
            sure_tokens += n
            sure_gone += sum(gone)
        at += n + (1 if w else max(1, width - n))
    copy = 2 * sure_gone > sure_tokens
    return " ".join(t for tokens, gone, w in parts for t, g in zip(tokens, gone, strict=True) if not g or (copy and not w))


def extract_text(
    pages: DataFrame,
    *,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    least_tokens: int = 8,
    least_pages: int = 3,
    sure_pages: int = 10,
    chunk_tokens: int = 300_000,
) -> DataFrame:
    """id_col, url_col, text of each page's article: blocks in page order, joined by spaces. One row for each row.

    A null or empty page has an empty text. Null ids and urls stay; pages without a host are one host. Repeated rows
    are pages like others. A page of any length is parsed whole, in memory of its own size. No pages give no rows. Other
    columns are ignored.

    A substring of least_tokens tokens repeats if at least least_pages pages of its host hold it. It then goes from weak
    blocks; from text elements of an article only if at least half of the host's pages and sure_pages of them hold it, which copies and quotes
    of real text don't reach. Suffix arrays of chunks find the distinct substrings and their pages; pages of chunks
    are distinct, so the sums over all chunks are exact, whatever the partitions. Only substrings whose minimizer is
    on least_pages pages leave their task. Pages are read once a pass and parsed again: only those that lose text are
    written out.
    """
    host = F.lower(F.coalesce(F.regexp_extract(F.col(url_col), r"^\w+://([^/?#]*)", 1), F.lit("")))
    rows = pages.select(
        F.struct(F.col(id_col).alias("id"), F.col(url_col).alias("url")).alias("key"), host.alias("host"), F.col(html_col).alias("html")
    )
    signed = lambda x: pa.array(x.view(np.int64))

    def minimizers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, hosts in _chunks(batches, chunk_tokens, least_tokens):
            for _, h in hosts:
                found, n = h.minimizer_counts()
                yield pa.RecordBatch.from_arrays([signed(found), pa.array(n.astype(np.int64))], names=["key", "n"])

    def counted(function, schema: str) -> DataFrame:
        return rows.select("host", "html").mapInArrow(function, schema)

    usual = _filter_rows(counted(minimizers, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") >= least_pages))

    def substrings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _filter(usual)
        for chunk, weak, hosts in _chunks(batches, chunk_tokens, least_tokens):
            for at, h in hosts:
                flags = np.concatenate([np.append(weak[i], False) for i in at])
                keys, n, loose = h.substring_counts(words, flags)
                names = pa.array([chunk[at[0]]["host"]] * len(keys), pa.string())
                yield pa.RecordBatch.from_arrays([names, signed(keys), pa.array(n.astype(np.int64)), pa.array(loose)], names=["host", "key", "n", "loose"])

    found = counted(substrings, "host string, key long, n long, loose boolean").groupBy("host", "key").agg(F.sum("n").alias("n"), F.max("loose").alias("loose"))
    sizes = rows.groupBy("host").agg(F.count("*").alias("pages"))
    repeats = found.where(F.col("n") >= least_pages).join(sizes, "host").select("key", "loose", ((2 * F.col("n") >= F.col("pages")) & (F.col("n") >= sure_pages)).alias("sure"))
    repeats = staged(repeats.where("loose or sure"))
    wanted = _filter_rows(repeats)
    kind = rows.schema["key"].dataType
    key_type = to_arrow_type(kind)

    def hits(chunk: list[dict], hosts: list[tuple[list[int], HostStreams]], words: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each row the hashes at its positions, and which of these pass the filter."""
        out: list = [None] * len(chunk)
        for at, h in hosts:
            keys = h.keys()
            ok = h.valid & _in_filter(words, keys)
            begin = 0
            for i, end in zip(at, h.ends, strict=True):
                out[i] = keys[begin:end], ok[begin:end]
                begin = end + 1
        return out

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _filter(wanted)
        for chunk, _, hosts in _chunks(batches, chunk_tokens, least_tokens):
            mine = [r for r, (_, ok) in zip(chunk, hits(chunk, hosts, words), strict=True) if not ok.any()]
            texts = pa.array([" ".join(r["blocks"]) for r in mine], pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([r["key"] for r in mine], key_type), texts], names=["key", "text"])

    def join_blocks(texts: list[str | None]) -> dict[str, list]:
        return {"text": [" ".join(candidates(t)[0]) for t in texts]}

    made = f"key {kind.simpleString()}, text string"
    if not len(wanted[0]):  # no page loses anything
        return map_texts(rows, "key", "html", "text string", join_blocks).select("key.id", "key.url", "text").toDF(id_col, url_col, "text")
    plain = rows.mapInArrow(whole, made).select("key.id", "key.url", "text")

    def doubtful(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _filter(wanted)
        for chunk, _, hosts in _chunks(batches, chunk_tokens, least_tokens):
            mine = [(r, k, ok) for r, (k, ok) in zip(chunk, hits(chunk, hosts, words), strict=True) if ok.any()]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([r["key"] for r, _, _ in mine], key_type),
                    pa.array([r["blocks"] for r, _, _ in mine], pa.list_(pa.string())),
                    pa.array([r["weak"] for r, _, _ in mine], pa.list_(pa.bool_())),
                    # 0 stands at positions that no repeated substring starts at
                    pa.array([np.where(ok, k, np.uint64(0)).view(np.int64) for _, k, ok in mine], pa.list_(pa.int64())),
                ],
                names=["key", "blocks", "weak", "starts"],
            )

    schema = f"key {kind.simpleString()}, blocks array<string>, weak array<boolean>, starts array<bigint>"
    open_rows = staged(rows.mapInArrow(doubtful, schema).withColumn("row", F.monotonically_increasing_id()))
    held = staged(open_rows.select("row", F.explode(F.array_distinct("starts")).alias("hit")).where("hit <> 0"))
    sets = held.join(repeats.withColumnRenamed("key", "hit"), "hit").groupBy("row").agg(
        F.collect_list(F.when(F.col("loose"), F.col("hit"))).alias("loose_keys"), F.collect_list(F.when(F.col("sure"), F.col("hit"))).alias("sure_keys"))

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [
                kept_text(r["blocks"], r["weak"], np.array(r["starts"], np.int64), *(np.array(r[c] or [], np.int64) for c in ("loose_keys", "sure_keys")), least_tokens)
                for r in batch.to_pylist()
            ]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(texts, pa.string())], names=["key", "text"])

    cleaned = open_rows.join(sets, "row", "left").mapInArrow(clean, made).select("key.id", "key.url", "text")
    return plain.union(cleaned).toDF(id_col, url_col, "text")
