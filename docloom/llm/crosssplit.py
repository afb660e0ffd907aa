"""Questions of evaluation splits that also stand, exactly or almost, in a training split.

An exact bipartite prefix-filter join on character shingles. One global order of
the shingles, rarest first, is fixed by a frequency table of constant size (2^20
counters addressed by the shingle's hash, so the table is broadcast whatever the
corpus); any consistent order keeps the join exact, a good one keeps it small.
Evaluation prefixes are the index, training prefixes probe it with a length and
a position filter, and with a 256-bit parity sketch whose distance bounds the
sets' difference from below (all three never lose a pair); surviving pairs are
verified on the whole shingle sets.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.functions.text import strip_lower
from docloom.llm import jaccard
from docloom.llm.kernels import binaries, by_chars, code_points, distinct_sorted, fold, mix64, signed
from docloom.session import materialize

COUNTERS = 1 << 20
#: Bits of the parity sketch. Its Hamming distance never exceeds the two sets' symmetric difference.
PARITY_BITS = 256
PARITY = [f"b{i}" for i in range(PARITY_BITS // 64)]


_WORD = re.compile(r"\w+")


def normal_form(text: str) -> str:
    """The text's words, folded, joined by single blanks."""
    return " ".join(_WORD.findall(fold(text)))


def shingles(texts: list[str], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct sorted hashes of each text's ``size``-character substrings."""
    points = code_points("".join(texts)).astype(np.uint64)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    counts = np.maximum(lengths - (size - 1), 0)
    start = np.concatenate(([0], np.cumsum(lengths)))[:-1]
    begin = np.concatenate(([0], np.cumsum(counts)))
    at = np.arange(begin[-1]) + np.repeat(start - begin[:-1], counts)
    acc = np.zeros(len(at), np.uint64)
    for k in range(size):
        acc = mix64(acc) + points[at + k]
    return distinct_sorted(mix64(acc), begin)


def parity_sketches(values: np.ndarray, owner: np.ndarray, count: int) -> np.ndarray:
    cell = owner * PARITY_BITS + ((values >> np.uint64(40)) % np.uint64(PARITY_BITS)).astype(np.int64)
    odd = (np.bincount(cell, minlength=count * PARITY_BITS) & 1).astype(np.uint8)
    return np.packbits(odd).view(np.int64).reshape(count, -1)


def _batches(batches, size):
    for batch in batches:
        texts = batch.column(1).to_pylist()
        for lo, hi in by_chars(texts):
            forms = [normal_form(t or "") for t in texts[lo:hi]]
            values, begin = shingles(forms, size)
            yield batch.column(0).slice(lo, hi - lo), forms, values, begin


def _nodes(forms: list[str]) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(f.encode("utf-8", "surrogatepass")) for f in forms), np.uint64, len(forms))


def cross_split_links(evaluation: DataFrame, training: DataFrame, size: int = 5, threshold: float = 0.6) -> tuple[DataFrame, DataFrame]:
    """Membership ``(id, held, node)`` and links ``(a, b, overlap)`` between the two sides' different questions.

    ``a`` is a node of the evaluation side, ``b`` one of the training side (the
    same node where a question stands on both); see cross_split_overlaps.
    """

    spark = evaluation.sparkSession
    rows = evaluation.select("id", "question", F.lit(True).alias("held")).union(training.select("id", "question", F.lit(False)))
    rows = rows.where("id is not null and question is not null")

    def to_nodes(batches):
        for batch in batches:
            for part, forms, values, begin in _batches([batch.select([0, 1])], size):
                keep = np.diff(begin) > 0
                lo = part.offset - batch.column(0).offset
                yield pa.RecordBatch.from_arrays(
                    [part, batch.column(2).slice(lo, len(part)), pa.array(signed(_nodes(forms))), binaries(values, begin)],
                    names=["id", "held", "node", "feats"],
                ).filter(pa.array(keep))

    items = materialize(rows.mapInArrow(to_nodes, "id string, held boolean, node long, feats binary"))
    sets = items.select("held", "node", "feats").dropDuplicates(["held", "node"])

    def count_cells(batches):
        total = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            for feats in batch.column(0):
                cells = (np.frombuffer(feats.as_buffer(), np.uint64) & np.uint64(COUNTERS - 1)).astype(np.int64)
                np.add.at(total, cells, 1)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["c", "n"])

    counted = sets.select("feats").mapInArrow(count_cells, "c long, n long").groupBy("c").agg(F.sum("n").alias("n")).toPandas()
    table = np.zeros(COUNTERS, np.int64)
    table[counted["c"].to_numpy()] = counted["n"].to_numpy()
    frequency = spark.sparkContext.broadcast(table)

    def prefixes(batches):
        seen = frequency.value
        for batch in batches:
            held, node = batch.column(0), batch.column(1).to_numpy()
            grams, owners, sizes, places, whole = [], [], [], [], []
            for i, feats in enumerate(batch.column(2)):
                values = np.frombuffer(feats.as_buffer(), np.uint64)
                whole.append(values)
                n = len(values)
                length = n - math.ceil(threshold * n - 1e-9) + 1
                order = np.lexsort((values, seen[(values & np.uint64(COUNTERS - 1)).astype(np.int64)]))[:length]
                grams.append(values[order])
                owners.append(np.full(len(order), i))
                sizes.append(np.full(len(order), n, np.int32))
                places.append(np.arange(len(order), dtype=np.int32))
            if grams:
                owner = np.concatenate(owners)
                every = np.repeat(np.arange(len(whole)), [len(v) for v in whole])
                parity = parity_sketches(np.concatenate(whole), every, len(whole))[owner]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(signed(np.concatenate(grams))),
                        held.take(pa.array(owner)),
                        pa.array(node[owner]),
                        pa.array(np.concatenate(sizes)),
                        pa.array(np.concatenate(places)),
                        *(pa.array(parity[:, i]) for i in range(len(PARITY))),
                    ],
                    names=["g", "held", "node", "n", "p", *PARITY],
                )

    schema = "g long, held boolean, node long, n int, p int, " + ", ".join(b + " long" for b in PARITY)
    x, y = (sets.where(side).mapInArrow(prefixes, schema).alias(name) for side, name in (("held", "x"), ("not held", "y")))
    need = (F.col("x.n") + F.col("y.n")) * F.lit(threshold / (1 + threshold)) - 1e-6
    apart = F.expr(" + ".join(f"bit_count(x.{b} ^ y.{b})" for b in PARITY))
    pairs = materialize(
        x.join(
            y,
            (F.col("x.g") == F.col("y.g"))
            & (F.least("x.n", "y.n") >= F.greatest("x.n", "y.n") * F.lit(threshold) - 1e-6)
            & (F.least(F.col("x.n") - F.col("x.p"), F.col("y.n") - F.col("y.p")) >= need)
            & (F.col("x.n") + F.col("y.n") - apart >= 2 * need),
        )
        .select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))
        .distinct()
    )
    every = sets.select("node", "feats")
    different = jaccard.exact_overlaps(pairs.where("a <> b"), every, threshold).select("a", "b", "overlap")
    same = pairs.where("a = b").select("a", "b", F.lit(1.0).alias("overlap"))
    return items.select("id", "held", "node").distinct(), different.union(same)


def cross_split_overlaps(evaluation: DataFrame, training: DataFrame, size: int = 5, threshold: float = 0.6) -> DataFrame:
    """``(id_eval, id_train, overlap)``: all pairs whose questions overlap by ``threshold`` or more.

    Both inputs have ``id`` and ``question``. The overlap is taken on distinct
    ``size``-character substrings of the words joined by single blanks. Rows with
    a null id, and questions that are null or too short for one substring, take
    no part; repeated rows of an id count once; equal questions are compared once
    and expanded at the end; other columns are ignored.
    """
    members, links = cross_split_links(evaluation, training, size, threshold)
    a = members.where("held").select(F.col("node").alias("a"), F.col("id").alias("id_eval"))
    b = members.where("not held").select(F.col("node").alias("b"), F.col("id").alias("id_train"))
    return links.join(a, "a").join(b, "b").select("id_eval", "id_train", "overlap")


def evaluation_questions(cases: DataFrame, safety: DataFrame) -> DataFrame:
    """``(id, question, split, source_set)`` of the holdout cases and all safety cases."""
    split = strip_lower(F.col("split"))
    return (
        cases.where(split == "holdout")
        .select("id", "question", F.lit("holdout").alias("split"), "source_set")
        .union(safety.select("id", "question", F.lit("safety").alias("split"), F.col("origin").alias("source_set")))
    )


def training_questions(cases: DataFrame) -> DataFrame:
    return cases.where(strip_lower(F.col("split")) == "tuning").select("id", "question", "source_set")


def overlap_report(evaluation: DataFrame, training: DataFrame, **options) -> DataFrame:
    """Per split and source set: cases, cases that overlap the other side, and pairs.

    The counts cover every (split, source_set) of either side, those without
    overlaps too; a null source set is reported as ``none``. Pairs are counted from
    the sizes of classes of equal questions, never listed.
    """
    members, links = cross_split_links(evaluation, training, **options)
    sizes = members.groupBy("node", "held").agg(F.count("*").alias("n"))

    def overlapping(own: str, other: str, held: bool) -> DataFrame:
        """``(node, held, n)``: cases of the other side that each node of one side overlaps."""
        there = sizes.where(F.col("held") != held).select(F.col("node").alias(other), "n")
        return links.join(there, other).groupBy(F.col(own).alias("node")).agg(F.sum("n").alias("n")).withColumn("held", F.lit(held))

    per_node = overlapping("a", "b", True).unionByName(overlapping("b", "a", False))
    counts = members.join(per_node, ["node", "held"]).groupBy("id", "held").agg(F.sum("n").alias("pairs"))
    sides = evaluation.select("id", "split", "source_set").union(training.select("id", F.lit("tuning"), "source_set"))
    cases = sides.where("id is not null").distinct().withColumn("source_set", F.coalesce("source_set", F.lit("none")))
    joined = cases.withColumn("held", F.col("split") != "tuning").join(counts, ["id", "held"], "left")
    return joined.groupBy("split", "source_set").agg(
        F.count("*").alias("cases"), F.count("pairs").alias("overlapping"), F.coalesce(F.sum("pairs"), F.lit(0)).alias("pairs")
    )
