"""SimHash near-dedup: fingerprints of word shingles, meet-in-the-middle ball hashing of radius 1 and 2, components."""

from __future__ import annotations

import itertools

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyloom.llm.common import map_texts, staged
from storyloom.operators.components import connected_components

#: Links reach over so many differing bits.
RADIUS = 3
#: Shingles that are hashed and counted at once.
STEP = 50_000


def fingerprint(text: str | None, *, width: int = 3, seed: int = 42) -> int:
    """64-bit SimHash as an unsigned number: a bit is 1 if set in over half the XXH64 hashes of the text's word shingles.

    Words are runs without white space, A-Z in lower case; shingles count as often as they occur. Fewer words than width
    are one shingle; without words the fingerprint is 0. Long texts are hashed STEP shingles at a time.
    """
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = list(itertools.accumulate((len(w) + 1 for w in words), initial=-1))[1:]
    n = max(1, len(words) - width + 1)
    starts, last = [0, *(e + 1 for e in ends)], ends[len(words) - n :]
    counts = np.zeros(64, np.int64)
    for at in range(0, n, STEP):
        of = [xxhash.xxh64_intdigest(joined[s:e], seed) for s, e in zip(starts[at : at + STEP], last[at : at + STEP], strict=False)]
        bits = np.unpackbits(np.array(of, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.uint32)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def signed(x: int) -> int:
    """A 64-bit pattern as Spark's long."""
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 3, seed: int = 42) -> DataFrame:
    """id_col and bits, the fingerprint's 64 bits as a long, of each row's whole text."""

    def of(texts: list[str | None]) -> dict[str, list]:
        return {"bits": [signed(fingerprint(t, width=width, seed=seed)) for t in texts]}

    return map_texts(docs, id_col, text_col, "bits bigint", of)


def block_masks(n: int) -> list[int]:
    """Masks that each keep all but RADIUS of the blocks, the fewest that leave a chance of a few hundredths that one of n
    random fingerprints agrees with another on what a mask keeps. Two fingerprints at most RADIUS bits apart agree on
    what one of the masks keeps, wherever they differ."""
    blocks = next((b for b, most in ((6, 10**7), (8, 10**9)) if n <= most), 10)
    bounds = [64 * i // blocks for i in range(blocks + 1)]
    of = [(1 << e) - (1 << s) for s, e in itertools.pairwise(bounds)]
    return [(1 << 64) - 1 - sum(gone) for gone in itertools.combinations(of, RADIUS)]


def _long_array(values: list[int]) -> Column:
    return F.array(*[F.lit(signed(v)).cast("long") for v in values])


def _disputed(nodes: DataFrame, masks: list[int]) -> DataFrame:
    """Those of the nodes (bits, component) that agree with one of another component on what a mask keeps: only these can
    still have a link that matters. Groups are summed up before the shuffle and never gathered."""
    keys = nodes.select("bits", "component", F.posexplode(_long_array(masks)).alias("mask", "m")).select(
        "bits", "component", "mask", F.col("bits").bitwiseAND(F.col("m")).alias("key")
    )
    mixed = keys.groupBy("mask", "key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi")
    return keys.join(staged(mixed.select("mask", "key")), ["mask", "key"], "left_semi").select("bits", "component").distinct()


def _within_one(nodes: DataFrame) -> DataFrame:
    """(v, bits): each fingerprint with itself and the 64 that differ in one bit."""
    bit = F.expr("CASE WHEN i < 0 THEN 0L ELSE shiftleft(1L, i) END")
    return nodes.select("bits", F.explode(F.sequence(F.lit(-1), F.lit(63))).alias("i")).select(F.col("bits").bitwiseXOR(bit).alias("v"), "bits")


def _at_two(nodes: DataFrame) -> DataFrame:
    """(v, bits): each fingerprint with the 2,016 that differ from it in two bits."""
    first = nodes.select("bits", F.explode(F.sequence(F.lit(0), F.lit(62))).alias("i"))
    both = first.select("bits", "i", F.explode(F.sequence(F.col("i") + 1, F.lit(63))).alias("j"))
    return both.select(F.col("bits").bitwiseXOR(F.expr("shiftleft(1L, i) | shiftleft(1L, j)")).alias("v"), "bits")


def _stars(near: DataFrame, far: DataFrame | None) -> DataFrame:
    """Edges (a, b) that connect what collides on a variant: those within 1 of it with the smallest of them, and those
    within 2 of it with the same. That is all pairs' components: of two that collide one is within 1, so both are at most
    RADIUS bits from that smallest one. An edge for each row at most, of which a variant has 2,081 at most."""
    hubs = near.groupBy("v").agg(F.min("bits").alias("hub"), F.count("*").alias("n"))
    # sizes of exploded tables are estimated from what they are exploded from: neither side may be broadcast
    if far is None:
        met = near.join(hubs.where("n > 1").hint("merge"), "v")
    else:
        met = far.join(hubs.hint("merge"), "v")
    apart = F.bit_count(F.col("hub").bitwiseXOR(F.col("bits")))
    return met.where((F.col("hub") != F.col("bits")) & (apart <= RADIUS)).select(F.col("hub").alias("a"), F.col("bits").alias("b")).distinct()


def near_fingerprints(nodes: DataFrame) -> DataFrame:
    """(bits, component) of distinct fingerprints (bits): component is the smallest one reachable over links of RADIUS
    bits or fewer.

    Two fingerprints within 3 bits have a variant in common that is within 1 bit of one and within 2 of the other. If
    they are 1 or 3 bits apart one has an odd number of bits and the other an even one, so it is enough that the odd ones
    emit their 2,016 pairs of bits; if they are 2 apart, single bits meet. Fingerprints that agree with no other on all
    but 3 blocks have no link, and emit nothing. Single bits go first: what they connect needs pairs of bits only where
    another component is near.
    """
    masks = block_masks(nodes.count())
    own = nodes.select("bits", F.col("bits").alias("component"))
    some = staged(_disputed(own, masks))
    links = staged(_stars(_within_one(some), None))
    labels = connected_components(links).select(F.col("node").alias("bits"), "component")
    placed = some.select("bits").join(labels, "bits", "left").select("bits", F.coalesce("component", "bits").alias("component"))
    rest = staged(_disputed(staged(placed), masks))
    odd = rest.where(F.bit_count("bits") % 2 == 1)
    more = staged(_stars(_within_one(rest.where(F.bit_count("bits") % 2 == 0)), _at_two(odd)))
    found = connected_components(links.union(more)).select(F.col("node").alias("bits"), "component")
    return own.select("bits").join(found, "bits", "left").select("bits", F.coalesce("component", "bits").alias("component"))


def simhash_duplicates(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 3, seed: int = 42
) -> DataFrame:
    """id_col, fingerprint (16 lower-case hex digits), component_id (smallest id reachable, its own included).

    Fingerprints link if at most RADIUS bits differ. One row for each row, none for none. Null and empty texts, and those
    without words, have fingerprint zero and link like any other. A row without an id has a fingerprint, links nothing
    and has no component_id. Rows that repeat an id, with the same text or another, are documents of their own with that
    id. Texts of any length are read whole. Other columns are ignored.

    Equal fingerprints are one node, by partial aggregation, so copies cost nothing more however many they are; ids come
    back by a join on a table written first, which adaptive execution can split where a third of all rows share one.
    """
    rows = staged(fingerprints(docs, id_col=id_col, text_col=text_col, width=width, seed=seed).withColumnRenamed(id_col, "id"))
    nodes = staged(rows.where("id is not null").groupBy("bits").agg(F.min("id").alias("first")))
    placed = staged(nodes.join(near_fingerprints(nodes.select("bits")), "bits"))
    least = placed.groupBy("component").agg(F.min("first").alias("component_id"))
    named = staged(placed.join(least, "component").select("bits", "component_id"))
    component = F.when(F.col("id").isNotNull(), F.col("component_id"))
    digits = F.lower(F.lpad(F.hex("bits"), 16, "0"))
    return rows.join(named, "bits", "left").select(F.col("id").alias(id_col), digits.alias("fingerprint"), component.alias("component_id"))
