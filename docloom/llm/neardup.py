"""Near-duplicate texts by covering locality-sensitive hashing.

Every text is a set of word runs, sketched by ``3 * blocks`` minimum hashes
(symbols of 64 bits). Each block of three symbols is covered by the structured
bit masks of covering LSH for radius one: for every nonzero v of {0,1}^2 the
mask keeps the symbols i with <i, v> = 1 over GF(2), so that of any two blocks
differing in one symbol some mask keeps only equal symbols. A pair is a candidate
when it collides in two blocks. By pigeonhole over the blocks, two sketches that
differ in at most ``2 * blocks - 3`` of their symbols do so - a guarantee, not a
probability. With 14 blocks (radius 25 of 42) a pair of overlap 0.5 lies outside
the radius *and* collides in fewer than two blocks with probability 0.0009; a
pair of overlap 0.8 with probability 2e-12. Colliding pairs are held against
parity sketches, whose distance never exceeds the sets' symmetric difference, so
that no pair of the threshold is dropped, and what is left is compared exactly.

Texts with equal sets are one node, so groups of copies cost one row; the
result is exact copies (node membership) plus links between different texts.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm import jaccard
from docloom.llm.components import components
from docloom.llm.crosssplit import parity_sketches
from docloom.llm.kernels import Words, binaries, by_chars, distinct_sorted, mix64, runs_of, signed
from docloom.session import materialize

BLOCK = 3
#: Blocks in which a pair must collide; there may be 64 blocks at most.
LEAST_BLOCKS = 2
#: 64-bit words that hold a parity sketch.
SHORT_WORDS = 4
SHORT_NAMES = [f"c{i}" for i in range(SHORT_WORDS)]


def covering_masks(radius: int) -> list[list[int]]:
    """For 2^(radius+1)-1 symbols: the symbols each mask keeps.

    Any two sequences differing in at most ``radius`` symbols agree on all kept
    symbols of at least one mask.
    """
    size = 2 ** (radius + 1)
    return [[i - 1 for i in range(1, size) if (i & v).bit_count() % 2] for v in range(1, size)]


@functools.cache
def _multipliers(count: int) -> np.ndarray:
    return mix64(np.arange(1, count + 1, dtype=np.uint64)) | np.uint64(1)


def sketches(values: np.ndarray, begin: np.ndarray, count: int) -> np.ndarray:
    """``count`` minimum hashes of each group of values (no group may be empty)."""
    out = np.empty((len(begin) - 1, count), np.uint64)
    for k, m in enumerate(_multipliers(count)):
        out[:, k] = np.minimum.reduceat(values * m, begin[:-1])
    return out


def table_keys(sketch: np.ndarray) -> np.ndarray:
    """One 64-bit key per covering mask of every block."""
    masks = covering_masks(1)
    keys = np.empty((len(sketch), sketch.shape[1] // BLOCK * len(masks)), np.uint64)
    at = 0
    for block in range(sketch.shape[1] // BLOCK):
        for mask in masks:
            acc = np.full(len(sketch), at + 1, np.uint64)
            for i in mask:
                acc = mix64(acc) + sketch[:, block * BLOCK + i]
            keys[:, at] = mix64(acc)
            at += 1
    return keys


def parity_forms(values: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Parity sketch of each set: it differs in no more bits than two sets differ in values."""
    owner = np.repeat(np.arange(len(begin) - 1), np.diff(begin))
    return parity_sketches(mix64(values), owner, len(begin) - 1)


def may_overlap(x: str, y: str, threshold: float) -> Column:
    """Whether two sets can have this overlap, by their sizes and parity sketches; true for every pair that has it."""
    apart = " + ".join(f"bit_count({x}.{c} ^ {y}.{c})" for c in SHORT_NAMES)
    return F.expr(apart) <= (F.col(f"{x}.n") + F.col(f"{y}.n")) * F.lit((1 - threshold) / (1 + threshold)) + F.lit(1e-6)


def kind_salts(kinds: list[str]) -> np.ndarray:
    salt = {kind: xxhash.xxh3_64_intdigest(str(kind)) for kind in set(kinds)}
    return np.array([salt[k] for k in kinds], np.uint64)


def _node_sets(texts: list[str | None], kinds: list[str], words: int, least_words: int):
    """Yields (positions, nodes, values, begin) for the texts that take part."""
    for lo, hi in by_chars(texts):
        some = Words([t or "" for t in texts[lo:hi]])
        counts = np.diff(some.first)
        runs, begin = runs_of(some.hash, some.first, words)
        values, begin = distinct_sorted(runs, begin)
        at = np.flatnonzero((counts >= max(least_words, words)) & (np.diff(begin) > 0))
        if not len(at):
            continue
        take = np.concatenate([np.arange(begin[i], begin[i + 1]) for i in at])
        sizes = np.diff(begin)[at]
        begin = np.concatenate(([0], np.cumsum(sizes)))
        values = values[take]
        raw = memoryview(values).cast("B")
        nodes = np.fromiter(
            (
                xxhash.xxh3_64_intdigest(raw[begin[k] * 8 : begin[k + 1] * 8], seed=xxhash.xxh32_intdigest(str(kinds[lo + i])))
                for k, i in enumerate(at.tolist())
            ),
            np.uint64,
            len(at),
        )
        yield at + lo, nodes, values, begin


def item_nodes(items: DataFrame, words: int, least_words: int, blocks: int) -> DataFrame:
    """``(kind, key, node, n, tables array<long>, parity sketch)`` of every text that takes part."""

    def run(batches):
        for batch in batches:
            kinds, keys, texts = (batch.column(i).to_pylist() for i in range(3))
            for at, nodes, values, begin in _node_sets(texts, kinds, words, least_words):
                sketch = sketches(values, begin, BLOCK * blocks)
                tables = table_keys(sketch)
                short = parity_forms(values, begin)
                tables += kind_salts([kinds[i] for i in at.tolist()])[:, None]  # kinds never meet
                width = tables.shape[1]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([kinds[i] for i in at.tolist()]),
                        pa.array([keys[i] for i in at.tolist()]),
                        pa.array(signed(nodes)),
                        pa.array(np.diff(begin).astype(np.int32)),
                        pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype=np.int32) * width), pa.array(signed(tables).ravel())),
                        *(pa.array(short[:, i]) for i in range(SHORT_WORDS)),
                    ],
                    names=["kind", "key", "node", "n", "tables", *SHORT_NAMES],
                )

    sketch = ", ".join(f"{c} long" for c in SHORT_NAMES)
    return items.select("kind", "key", "text").where("key is not null").mapInArrow(run, f"kind string, key string, node long, n int, tables array<long>, {sketch}")


def node_sets(items: DataFrame, words: int, least_words: int, wanted: np.ndarray) -> DataFrame:
    """``(node, feats)`` of the nodes whose cell is in ``wanted`` (a fixed-size filter)."""
    packed = items.sparkSession.sparkContext.broadcast(np.packbits(wanted))

    def run(batches):
        bits = np.unpackbits(packed.value).astype(bool)
        sent: set[int] = set()
        for batch in batches:
            kinds, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for _, nodes, values, begin in _node_sets(texts, kinds, words, least_words):
                keep = bits[jaccard.cell_of(signed(nodes))]
                keep &= [n not in sent for n in nodes.tolist()]
                if not keep.any():
                    continue
                sent.update(nodes[keep].tolist())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(signed(nodes)), binaries(values, begin)], names=["node", "feats"]
                ).filter(pa.array(keep))

    return items.where("key is not null").select("kind", "text").mapInArrow(run, "node long, feats binary")


def candidate_pairs(nodes: DataFrame, threshold: float) -> DataFrame:
    """Distinct pairs ``(a, b)``, a < b, of nodes that share table keys of ``LEAST_BLOCKS`` blocks.

    Pairs whose sizes or parity sketches cannot give the overlap are left out
    before they are shuffled.
    """
    block = (F.col("pos") / len(covering_masks(1))).cast("int")
    keyed = nodes.select("node", "n", *SHORT_NAMES, F.posexplode("tables").alias("pos", "t")).select("node", "n", *SHORT_NAMES, "t", block.alias("block"))
    x, y = keyed.alias("x"), keyed.alias("y")
    fits = F.least("x.n", "y.n") >= F.greatest("x.n", "y.n") * F.lit(threshold - 1e-9)
    met = x.join(
        y,
        (F.col("x.t") == F.col("y.t"))
        & (F.col("x.node") < F.col("y.node"))
        & fits
        & may_overlap("x", "y", threshold),
    ).select(F.col("x.node").alias("a"), F.col("y.node").alias("b"), F.expr("shiftleft(1L, x.block)").alias("block"))
    return met.groupBy("a", "b").agg(F.bit_or("block").alias("blocks")).where(F.bit_count("blocks") >= LEAST_BLOCKS).select("a", "b")


def near_duplicate_links(
    items: DataFrame,
    words: int = 5,
    threshold: float = 0.8,
    least_words: int = 1,
    blocks: int = 14,
) -> tuple[DataFrame, DataFrame]:
    """Membership ``(kind, key, node)`` and links ``(a, b, overlap)`` between different nodes.

    ``items`` has ``kind``, ``key`` and ``text``; only items of one kind are
    compared. Two items of one node have equal sets of word runs. Null and empty
    texts and texts of fewer than ``least_words`` (or ``words``) words take no
    part; repeated rows of a key are one item; rows without a key are dropped;
    other columns are ignored.
    """
    rows = materialize(item_nodes(items, words, least_words, blocks))
    members = rows.select("kind", "key", "node").distinct()
    nodes = rows.drop("kind", "key").dropDuplicates(["node"])
    pairs = materialize(candidate_pairs(nodes, threshold))
    wanted = jaccard.membership(pairs.select(F.explode(F.array("a", "b")).alias("node")))
    links = jaccard.exact_overlaps(pairs, node_sets(items, words, least_words, wanted), threshold)
    return members, links.select("a", "b", "overlap")


def near_duplicate_pairs(items: DataFrame, **options) -> DataFrame:
    """All pairs ``(kind, key_a, key_b)``, key_a < key_b, copies included; see near_duplicate_links."""
    members, links = near_duplicate_links(items, **options)
    a = members.select(F.col("kind"), F.col("key").alias("p"), F.col("node").alias("a"))
    b = members.select(F.col("key").alias("q"), F.col("node").alias("b"))
    linked = links.select("a", "b").join(a, "a").join(b, "b").select("kind", F.least("p", "q").alias("key_a"), F.greatest("p", "q").alias("key_b"))
    copies = members.groupBy("node").agg(F.count("*").alias("c")).where("c > 1").select("node")
    inside = members.join(copies, "node")
    other = inside.select("node", F.col("key").alias("key_b"))
    same = inside.join(other, "node").where("key < key_b").select("kind", F.col("key").alias("key_a"), "key_b")
    return linked.union(same)


def near_duplicate_groups(items: DataFrame, **options) -> DataFrame:
    """One row ``(kind, key, group_id, copies, links)`` per item that takes part; see near_duplicate_links.

    ``group_id`` is the least key of the items linked to this one, directly or
    through others; ``copies`` counts the items with the same set of word runs
    (with itself), ``links`` the different texts it is linked to. Copies are
    never expanded into pairs.
    """
    members, links = near_duplicate_links(items, **options)
    pairs = materialize(links.select("a", "b"))
    group = components(pairs)
    degree = pairs.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("links"))
    classes = (
        members.groupBy("kind", "node")
        .agg(F.count("*").alias("copies"), F.min("key").alias("least"))
        .join(group, "node", "left")
        .join(degree, "node", "left")
        .select("kind", "node", "copies", "least", F.coalesce("component", "node").alias("component"), F.coalesce("links", F.lit(0)).alias("links"))
    )
    named = classes.groupBy("kind", "component").agg(F.min("least").alias("group_id"))
    whole = classes.join(named, ["kind", "component"]).select("kind", "node", "group_id", "copies", "links")
    return members.join(whole, ["kind", "node"]).select("kind", "key", "group_id", "copies", "links")
