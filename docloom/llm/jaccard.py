"""Exact overlap of candidate pairs, without shipping a set once per pair.

Pairs of one neighbourhood are sent to one place (the least neighbour of their
first member), so a set travels once per place instead of once per pair. Places
with very many pairs are cut into a grid of smaller places, each a bounded block
of pairs, so no task holds an unbounded neighbourhood.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.kernels import groups_in_order
from docloom.session import parallelism

#: Pairs of one place before it is cut into a grid.
PAIRS_PER_PLACE = 20_000
#: Cells of the membership filter; its size never depends on the data.
FILTER_CELLS = 1 << 20


def cell_of(nodes: np.ndarray) -> np.ndarray:
    x = nodes.astype(np.int64).view(np.uint64)
    return ((x ^ (x >> np.uint64(32))) & np.uint64(FILTER_CELLS - 1)).astype(np.int64)


def cell_column(node):
    return F.expr(f"({node} ^ shiftrightunsigned({node}, 32)) & {FILTER_CELLS - 1}L")


def membership(nodes: DataFrame) -> np.ndarray:
    """Bits of the cells that hold a node: false positives only, at most FILTER_CELLS rows collected."""
    cells = nodes.select(cell_column(nodes.columns[0]).alias("c")).distinct().toPandas()["c"].to_numpy()
    bits = np.zeros(FILTER_CELLS, bool)
    bits[cells] = True
    return bits


def place_pairs(pairs: DataFrame) -> DataFrame:
    """``(place, a, b)`` for distinct pairs ``(a, b)``, a <> b."""
    least = (
        pairs.select("a", "b").union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).groupBy("a").agg(F.min("b").alias("least"))
    ).select(F.col("a").alias("node"), F.least("a", "least").alias("place"))
    at = pairs.join(least, pairs.a == least.node).select("place", "a", "b")
    crowded = at.groupBy("place").count().where(F.col("count") > PAIRS_PER_PLACE)
    side = F.ceil(F.sqrt(F.col("count") / PAIRS_PER_PLACE))
    return at.join(crowded, "place", "left").select(
        F.when(F.col("count").isNull(), F.col("place"))
        .otherwise(F.xxhash64("place", F.pmod(F.xxhash64("a"), side), F.pmod(F.xxhash64("b"), side)))
        .alias("place"),
        "a",
        "b",
    )


def exact_overlaps(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """``(a, b, shared, overlap)`` of the pairs whose sets overlap by ``threshold`` or more.

    ``pairs``: distinct ``(a long, b long)``; ``sets``: ``(node long, feats
    binary)``, feats the set's distinct sorted uint64 values, repeated rows of a
    node allowed.
    """
    placed = place_pairs(pairs)
    needs = placed.select("place", F.col("a").alias("node")).union(placed.select("place", F.col("b"))).distinct()
    rows = (
        needs.join(sets, "node")
        .select("place", F.lit(0).alias("f"), F.col("node").alias("a"), F.lit(0).cast("long").alias("b"), "feats")
        .union(placed.select("place", F.lit(1), "a", "b", F.lit(None).cast("binary")))
    )
    spark = pairs.sparkSession
    ordered = rows.repartition(parallelism(spark), "place").sortWithinPartitions("place", "f")

    def run(batches):
        for table in groups_in_order(batches, ["place"]):
            place, f, a, b = (table[c].to_numpy() for c in ("place", "f", "a", "b"))
            feats = table["feats"]
            cuts = np.concatenate(([0], np.flatnonzero(place[1:] != place[:-1]) + 1, [len(place)]))
            out: list[tuple[int, int, int, float]] = []
            for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                split = lo + int(np.searchsorted(f[lo:hi], 1))
                held = {int(a[i]): np.frombuffer(feats[i].as_buffer(), np.uint64) for i in range(lo, split)}
                for x, y in zip(a[split:hi].tolist(), b[split:hi].tolist()):
                    p, q = held.get(x), held.get(y)
                    if p is None or q is None:
                        continue
                    shared = shared_count(p, q)
                    total = len(p) + len(q) - shared
                    if total and shared >= math.ceil(threshold * total - 1e-9):
                        out.append((x, y, shared, shared / total))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names=["a", "b", "shared", "overlap"])

    return ordered.mapInArrow(run, "a long, b long, shared long, overlap double")


def shared_count(p: np.ndarray, q: np.ndarray) -> int:
    both = np.concatenate((p, q))
    both.sort()
    return int((both[1:] == both[:-1]).sum())
