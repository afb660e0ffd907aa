"""Mixing sources to target shares of tokens, by iterative proportional fitting.

Documents are sized in tokens of a public tokenizer and counted in cells of
(source, language, topic). The tokens of the cells are raked until the source
marginal meets the targets and the language and topic marginals keep the
proportions of the pool, never beyond a source's cap on repeats. A cell's weight
(how often its documents stand in the mix on average) becomes each document's
calibrated probability: its whole part is taken for certain, its fraction by
systematic sampling within bounded strata ordered by size, so the reached shares
differ from the raked ones by no more than a few documents.
"""

from __future__ import annotations

import os
import warnings

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions.tokens import encoding
from docloom.session import materialize

VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Least share of the pool's tokens with which a language or a topic is a cell of its own; the others of its kind share one.
#: The shares bound the number of cells, whatever the data holds.
LEAST_LANGUAGE, LEAST_TOPIC = 0.001, 0.005
OTHER = "other"
#: Documents in a sampling stratum, on average.
STRATUM = 5000
#: Random starts of the systematic sample that a stratum chooses from.
STARTS = 24
ROUNDS, TOLERANCE = 200, 1e-9


def sized_documents(documents: DataFrame, sources: DataFrame, vocabulary: str) -> DataFrame:
    """``(doc_id, source, lang, topic, tokens)`` of the documents of some sources, one row per document.

    The language without case, blanks and region, the topic the first part of the
    path; empty where there is none. The vocabulary file travels with the job.
    """
    lang = F.coalesce(F.substring_index(F.regexp_replace(F.lower(F.col("lang")), r"(?U)\s", ""), "-", 1), F.lit(""))
    topic = F.coalesce(F.substring_index("path", "/", 1), F.lit(""))
    documents.sparkSession.sparkContext.addFile(vocabulary)
    name = os.path.basename(vocabulary)
    rows = (
        documents.where("doc_id is not null and text is not null and text <> ''")
        .select("doc_id", "source", lang.alias("lang"), topic.alias("topic"), "text")
        .join(sources.select("source").distinct(), "source", "left_semi")
    )

    def run(batches):
        encode = encoding(SparkFiles.get(name)).encode_ordinary
        for batch in batches:
            counts = [len(encode(t)) for t in batch.column(4).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(counts, pa.int64())], names=["doc_id", "source", "lang", "topic", "tokens"])

    return rows.select("doc_id", "source", "lang", "topic", "text").mapInArrow(run, "doc_id long, source string, lang string, topic string, tokens long").dropDuplicates(["doc_id"])


def cells_of(sized: DataFrame, least_language: float = LEAST_LANGUAGE, least_topic: float = LEAST_TOPIC) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Two small tables ``(lang, lang_cell)`` and ``(topic, topic_cell)`` of the values with cells of their own, and the
    documents with their cells.

    A value is a cell of its own from its least share of all tokens on, so there
    are at most 1 / share of them; every other value is in the cell ``other``.
    """
    out = sized
    tables = []
    for column, least in (("lang", least_language), ("topic", least_topic)):
        counted = sized.groupBy(column).agg(F.sum("tokens").alias("n"))
        large = counted.crossJoin(counted.agg(F.sum("n").alias("whole"))).where(F.col("n") >= F.col("whole") * least)  # one row of the whole
        own = large.select(column, F.col(column).alias(f"{column}_cell"))
        tables.append(own)
        out = out.join(F.broadcast(own), column, "left").withColumn(f"{column}_cell", F.coalesce(f"{column}_cell", F.lit(OTHER)))  # at most 1 / least rows
    return *tables, out


def rake(tokens: np.ndarray, source: np.ndarray, lang: np.ndarray, topic: np.ndarray, shares: np.ndarray, caps: np.ndarray, total: float) -> np.ndarray:
    """Weight of each cell: sources meet ``shares * total`` exactly, languages and topics stay near their
    proportions, no weight exceeds its source's cap."""
    mass = tokens.astype(float)
    target = shares * total
    keep = [(ids, np.bincount(ids, tokens) / tokens.sum() * total) for ids in (lang, topic)]
    for number in range(ROUNDS + 1):
        if number == ROUNDS:
            warnings.warn(f"the marginals still moved by {np.abs(mass - before).sum() / total:.2g} of the mix after {ROUNDS} rounds", RuntimeWarning, stacklevel=2)
            break
        before = mass.copy()
        for ids, want in keep:
            have = np.bincount(ids, mass, len(want))
            mass *= np.divide(want, have, out=np.ones_like(want), where=have > 0)[ids]
        mass = _fill(mass, tokens, source, target, caps)
        if np.abs(mass - before).sum() <= TOLERANCE * total:
            break
    return mass / tokens


def _fill(mass, tokens, source, target, caps):
    """Scale each source to its target; what a capped cell cannot take goes to the source's other cells."""
    most = caps[source] * tokens
    for _ in range(len(mass)):
        full = mass >= most * (1 - 1e-12)
        fixed = np.bincount(source, np.where(full, most, 0), len(target))
        free = np.bincount(source, np.where(full, 0, mass), len(target))
        factor = np.divide(np.maximum(target - fixed, 0), free, out=np.zeros_like(free), where=free > 0)
        if (fixed > target).any():  # shrinking: nothing is full then
            over = fixed > target
            scale = np.divide(target, np.bincount(source, mass, len(target)), out=np.zeros_like(target), where=np.bincount(source, mass, len(target)) > 0)
            mass = np.where(over[source], mass * scale[source], mass)
            continue
        grown = np.where(full, most, mass * factor[source])
        mass = np.minimum(grown, most)
        if not (grown > most * (1 + 1e-12)).any():
            return mass
    return np.minimum(mass, most)


def _weights(cells: "np.ndarray", targets: list, total_tokens: float | None) -> list[tuple]:
    """(mix_id, source, lang, topic, weight, strata) for all cells of all mixes."""
    out = []
    for mix in sorted({t[0] for t in targets}):
        wanted = {s: (share, repeats) for m, s, share, repeats in targets if m == mix and share and share > 0 and repeats and repeats > 0}
        mine = [c for c in cells if c[1 - 1] in wanted]
        if not mine:
            continue
        sources = sorted({c[0] for c in mine})
        langs, topics = sorted({c[1] for c in mine}), sorted({c[2] for c in mine})
        source = np.array([sources.index(c[0]) for c in mine])
        tokens = np.array([c[3] for c in mine], float)
        docs = np.bincount(source, [c[4] for c in mine])
        shares = np.array([wanted[s][0] for s in sources], float)
        shares /= shares.sum()
        caps = np.array([wanted[s][1] for s in sources], float)
        most = float((caps * np.bincount(source, tokens) / shares).min())  # beyond it some source would repeat too often
        total = min(total_tokens or tokens.sum(), most)
        weights = rake(
            tokens, source, np.array([langs.index(c[1]) for c in mine]), np.array([topics.index(c[2]) for c in mine]), shares, caps, total
        )
        out += [
            (int(mix), c[0], c[1], c[2], float(w), int(max(1, -(-docs[s] // STRATUM)))) for c, s, w in zip(mine, source.tolist(), weights.tolist())
        ]
    return out


def mix_sources(
    documents: DataFrame, targets: DataFrame, vocabulary: str = VOCABULARY, total_tokens: float | None = None, seed: int = 7
) -> DataFrame:
    """``(mix_id, source, doc_id, tokens, copies, lang_cell, topic_cell)``: the documents of every mix.

    The size of a mix is ``total_tokens`` (default: all tokens of its sources),
    less where a small source could not fill its share within ``max_repeats``.
    Shares are taken relative to the sum over the mix' sources that have tokens;
    targets with a null or non-positive share or repeat cap ask for nothing. Of
    repeated targets of a source in a mix, shares add and the least cap counts.
    Null or empty texts and null ids take no part, repeated rows of a document
    are one document, null languages and paths are empty ones; other columns are
    ignored. Equal inputs give equal mixes. Languages and topics with a small share
    of the pool share a cell (see cells_of), which ``lang_cell`` and ``topic_cell``
    of the result name.
    """
    spark = documents.sparkSession
    asked = targets.where("mix_id is not null and source is not null").groupBy("mix_id", "source").agg(
        F.sum("target_share").alias("target_share"), F.min("max_repeats").alias("max_repeats")
    )
    *_, sized = cells_of(materialize(sized_documents(documents, asked, vocabulary).where("tokens > 0")))
    sized = sized.select("doc_id", "source", F.col("lang_cell").alias("lang"), F.col("topic_cell").alias("topic"), "tokens")
    # At most sources x 1 / LEAST_LANGUAGE x 1 / LEAST_TOPIC rows, and far fewer in sum: a fixed number per asked source.
    cells = [tuple(r) for r in sized.groupBy("source", "lang", "topic").agg(F.sum("tokens"), F.count("*")).collect()]
    weights = _weights(sorted(cells), [tuple(r) for r in asked.collect()], total_tokens)
    table = spark.createDataFrame(weights, "mix_id int, source string, lang string, topic string, weight double, strata int")
    part = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.col("strata"))
    rows = sized.join(table, ["source", "lang", "topic"]).withColumn("part", part)
    rows = rows.withColumn("whole", F.floor("weight")).withColumn("rest", F.col("weight") - F.floor("weight"))
    order = Window.partitionBy("mix_id", "source", "part").orderBy("tokens", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("up_to", F.sum("rest").over(order))

    def taken(start):
        return F.least(F.greatest(F.floor(F.col("up_to") + start) - F.floor(F.col("up_to") - F.col("rest") + start), F.lit(0)), F.lit(1))

    def start_of(k: int):
        return F.pmod(F.xxhash64("mix_id", "source", "part", F.lit(seed), F.lit(k)), F.lit(1_000_003)) / 1_000_003

    # Of a few random starts each stratum keeps the one that comes nearest to its calibrated tokens.
    stratum = ["mix_id", "source", "part"]
    tried = rows.groupBy(stratum).agg(*(F.abs(F.sum(F.col("tokens") * (taken(start_of(k)) - F.col("rest")))).alias(f"off{k}") for k in range(STARTS)))
    best = tried.select(
        *stratum, F.array_min(F.array(*(F.struct(F.col(f"off{k}").alias("off"), start_of(k).alias("start")) for k in range(STARTS)))).getField("start").alias("start")
    )
    return (
        rows.join(best, stratum)
        .withColumn("copies", (F.col("whole") + taken(F.col("start"))).cast("int"))
        .where("copies > 0")
        .select("mix_id", "source", "doc_id", "tokens", "copies", F.col("lang").alias("lang_cell"), F.col("topic").alias("topic_cell"))
    )


def reached_shares(selection: DataFrame, targets: DataFrame) -> DataFrame:
    """One row per asked (mix_id, source): target and reached share, tokens, documents and copies (0 where none)."""
    asked = targets.where("mix_id is not null and source is not null").groupBy("mix_id", "source").agg(F.sum("target_share").alias("target_share"))
    got = selection.groupBy("mix_id", "source").agg(
        F.sum(F.col("tokens") * F.col("copies")).alias("tokens"), F.count("*").alias("documents"), F.sum("copies").alias("copies"), F.max("copies").alias("most_repeats")
    )
    whole = Window.partitionBy("mix_id")
    return asked.join(got, ["mix_id", "source"], "left").select(
        "mix_id",
        "source",
        "target_share",
        F.coalesce(F.col("tokens") / F.sum("tokens").over(whole), F.lit(0.0)).alias("reached_share"),
        *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("tokens", "documents", "copies", "most_repeats")),
    )


def reached_marginals(documents: DataFrame, selection: DataFrame, targets: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """``(mix_id, axis, cell, pool_share, reached_share, merged)``: languages and topics of every mix against its pool.

    The pool are the documents of the mix' sources; ``merged`` counts the values
    that share a cell. Source targets and caps come first, so the reached shares may
    have to leave those of the pool.
    """
    asked = targets.where("mix_id is not null and source is not null and target_share > 0 and max_repeats > 0").select("mix_id", "source").distinct()
    *_, sized = cells_of(materialize(sized_documents(documents, asked, vocabulary).where("tokens > 0")))
    pool = sized.join(asked, "source")
    out = None
    for axis in ("lang", "topic"):
        cell = f"{axis}_cell"
        have = pool.groupBy("mix_id", cell).agg(F.sum("tokens").alias("pool"), F.count_distinct(axis).alias("merged"))
        got = selection.groupBy("mix_id", cell).agg(F.sum(F.col("tokens") * F.col("copies")).alias("reached"))
        whole = Window.partitionBy("mix_id")
        one = have.join(got, ["mix_id", cell], "left").select(
            "mix_id",
            F.lit(axis).alias("axis"),
            F.col(cell).alias("cell"),
            (F.col("pool") / F.sum("pool").over(whole)).alias("pool_share"),
            F.coalesce(F.col("reached") / F.sum("reached").over(whole), F.lit(0.0)).alias("reached_share"),
            "merged",
        )
        out = one if out is None else out.union(one)
    return out


def mix_checks(selection: DataFrame, documents: DataFrame, targets: DataFrame, tolerance: float = 0.002, most_documents: int = 3) -> DataFrame:
    """``(mix_id, source, share, close, capped)`` of every asked source.

    ``share``: its target share of those that have documents; ``close``: the mix
    misses it by ``tolerance`` of all its tokens at most, or by ``most_documents``
    of the size of its largest document; ``capped``: no document stands in it too often.
    """
    asked = targets.where("mix_id is not null and source is not null").groupBy("mix_id", "source").agg(
        F.sum("target_share").alias("target"), F.min("max_repeats").alias("most")
    )
    there = documents.where("doc_id is not null and text <> ''").select("source").distinct().withColumn("has", F.lit(True))
    counted = F.when(F.col("has") & (F.col("target") > 0) & (F.col("most") > 0), F.col("target")).otherwise(0.0)
    whole = Window.partitionBy("mix_id")
    own = asked.join(there, "source", "left").withColumn("counted", F.coalesce(counted, F.lit(0.0)))
    own = own.withColumn("share", F.coalesce(F.try_divide("counted", F.sum("counted").over(whole)), F.lit(0.0)))
    got = selection.groupBy("mix_id", "source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("n"), F.max("copies").alias("copies"), F.max("tokens").alias("largest"))
    got = got.select("mix_id", "source", F.col("n").alias("tokens"), "copies", "largest")
    joined = own.join(got, ["mix_id", "source"], "left").withColumns({"tokens": F.coalesce("tokens", F.lit(0)), "all": F.coalesce(F.sum("tokens").over(whole), F.lit(0))})
    off = F.abs(F.col("tokens") - F.col("share") * F.col("all"))
    close = off <= F.greatest(F.lit(tolerance) * F.col("all"), most_documents * F.coalesce(F.max("largest").over(whole), F.lit(0)))
    return joined.select("mix_id", "source", F.round("share", 9).alias("share"), close.alias("close"), (F.coalesce("copies", F.lit(0)) <= F.greatest(F.coalesce("most", F.lit(0)), F.lit(0))).alias("capped"))
