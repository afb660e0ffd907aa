"""Keyword retrieval: an index of texts by their terms, BM25 scores, literal priority, top-k."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from docloom.functions.checks import require_count
from docloom.functions.literals import extract_literals, stands_whole
from docloom.functions.text import terms
from docloom.operators.intervals import merge_ranges
from docloom.operators.topk import Best
from docloom.session import materialize

# Fixed values of the ranking function.
K1, B, IDF_FLOOR = 1.2, 0.75, 1e-6
#: Scores are compared on this many digits, so copies tie whatever order their terms were added in.
DIGITS = 9
#: Queries, and literals, that travel at once.
QUERIES_PER_PASS, LITERALS_PER_PASS = 2000, 20_000
#: Documents scored at once against all queries of a pass (16 MB of scores).
SLICE = 1024


@dataclass(frozen=True)
class LexicalIndex:
    """Documents ``(id, terms)``, repeated terms included: what postings, lengths and statistics come from.

    Searching for the best ``k`` scans documents, in which nothing is shuffled but
    each task's best; postings serve checks, and scores of stated pairs.
    """

    documents: DataFrame

    def stored(self) -> "LexicalIndex":
        """The same index read from a table in the shared folder, for more than one batch of queries."""
        return LexicalIndex(materialize(self.documents))

    @property
    def lengths(self) -> DataFrame:
        return self.documents.select("id", F.size("terms").cast("long").alias("dl"))

    @property
    def postings(self) -> DataFrame:
        """``(term, id, tf, dl)``."""
        one = self.documents.select("id", F.size("terms").cast("long").alias("dl"), F.explode("terms").alias("term"))
        return one.groupBy("term", "id").agg(F.count("*").alias("tf"), F.first("dl").alias("dl"))

    @property
    def stats(self) -> DataFrame:
        return self.lengths.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))


def build_index(texts: DataFrame) -> LexicalIndex:
    """Index ``(id, text)``, one row per id. A text without terms counts as a document of length 0."""
    return LexicalIndex(texts.select("id", terms(F.coalesce("text", F.lit(""))).alias("terms")))


def query_terms(queries: DataFrame) -> DataFrame:
    """Distinct ``(query_id, term)`` of ``(query_id, text)``."""
    return queries.select("query_id", F.explode(F.array_distinct(terms(F.col("text")))).alias("term"))


def document_frequencies(index: LexicalIndex, wanted: DataFrame | None = None) -> DataFrame:
    """``(term, df)``, of the terms of ``wanted`` only if it is given."""
    one = index.documents.select(F.explode(F.array_distinct("terms")).alias("term"))
    one = one if wanted is None else one.join(wanted.select("term").distinct(), "term", "left_semi")
    return one.groupBy("term").agg(F.count("*").alias("df"))


def term_weights(index: LexicalIndex, wanted: DataFrame) -> DataFrame:
    """``(term, idf, avgdl)`` of the wanted terms that some document has."""
    idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    counted = document_frequencies(index, wanted).crossJoin(index.stats)  # one row of statistics
    return counted.select("term", F.when(idf > 0, idf).otherwise(IDF_FLOOR).alias("idf"), "avgdl")


def pair_scores(index: LexicalIndex, queries: DataFrame, pairs: DataFrame) -> DataFrame:
    """``(query_id, id, score)`` of stated distinct pairs ``(query_id, id)`` that share a term; lower is better."""
    asked = query_terms(queries)
    weighted = asked.join(term_weights(index, asked), "term")
    own = index.documents.join(pairs.select("id").distinct(), "id", "left_semi")
    postings = LexicalIndex(own).postings
    part = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    met = pairs.select("query_id", "id").join(weighted, "query_id").join(postings, ["id", "term"])
    return met.groupBy("query_id", "id").agg((-F.sum(part)).alias("score"))


def bm25_scores(index: LexicalIndex, queries: DataFrame) -> DataFrame:
    """``(query_id, id, score)`` of every document with a query term: a full listing, for checks and small inputs."""
    asked = query_terms(queries)
    part = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    weighted = asked.join(term_weights(index, asked), "term")
    return weighted.join(index.postings, "term").groupBy("query_id", "id").agg((-F.sum(part)).alias("score"))


def top_k(scores: DataFrame, k: int, *order) -> DataFrame:
    """The first ``k`` rows of each query in a total order, with ``rank`` from 1."""
    by = Window.partitionBy("query_id").orderBy(*order)
    return scores.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)


def bm25_top_k(index: LexicalIndex, queries: DataFrame, k: int = 10) -> DataFrame:
    """``(query_id, id, score, rank)``: the ``k`` best documents of every query; equal scores: smaller id.

    ``queries`` is a stated set ``(query_id, text)``. It travels in blocks of
    bounded size; a block scans the documents once, every task adds up its
    documents' scores and sends its own best ``k`` per query, so neither postings
    nor scores of a common term are ever shuffled.
    """
    require_count(k)
    asked = query_terms(queries)
    weights = term_weights(index, asked)
    count = queries.count()
    blocks = max(1, -(-count // QUERIES_PER_PASS))
    keyed = asked.join(weights, "term")
    if blocks > 1:
        keyed = materialize(keyed)
    parts = []
    for number in range(blocks):
        own = keyed.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == number) if blocks > 1 else keyed
        found, shared = _scan(index, own, queries, k)
        if blocks > 1:  # one block at a time on the driver and on the executors
            found = materialize(found)
            shared.destroy()
        parts.append(found)
    best = top_k(reduce(DataFrame.union, parts), k, F.desc("score"), F.col("id"))
    return best.select("query_id", "id", (-F.col("score")).alias("score"), "rank")


def _scan(index: LexicalIndex, keyed: DataFrame, queries: DataFrame, k: int):
    """Each task's best ``(query_id, id, score)``, positive scores, and the broadcast it reads."""
    rows = keyed.select("query_id", "term", "idf", "avgdl").collect()  # the terms of one block of queries
    names = sorted({r[0] for r in rows})
    number = {name: i for i, name in enumerate(names)}
    vocabulary = sorted({r[1] for r in rows})
    place = {term: i for i, term in enumerate(vocabulary)}
    holders: list[list[int]] = [[] for _ in vocabulary]
    idf = np.zeros(len(vocabulary))
    for query, term, weight, _ in rows:
        holders[place[term]].append(number[query])
        idf[place[term]] = weight
    avgdl = rows[0][3] if rows else 1.0
    shared = index.documents.sparkSession.sparkContext.broadcast((names, vocabulary, [np.array(h) for h in holders], idf, avgdl))
    id_type = to_arrow_type(index.documents.schema["id"].dataType)
    query_type = to_arrow_type(queries.schema["query_id"].dataType)

    def scan(batches):
        names, vocabulary, holders, idf, avgdl = shared.value
        if not names:
            return
        best, known = Best(len(names), k), pa.array(vocabulary, pa.string())
        for batch in batches:
            for lo in range(0, batch.num_rows, SLICE):
                _score_slice(batch.slice(lo, SLICE), known, holders, idf, avgdl, best)
        if (found := best.result()) is not None:
            query, score, ids = found
            yield pa.RecordBatch.from_arrays(
                [pa.array([names[q] for q in query.tolist()], query_type), pa.array(ids.tolist(), id_type), pa.array(score)], names=["query_id", "id", "score"]
            )

    schema = f"query_id {queries.schema['query_id'].dataType.simpleString()}, id {index.documents.schema['id'].dataType.simpleString()}, score double"
    return index.documents.select("id", "terms").mapInArrow(scan, schema), shared


def _score_slice(batch: pa.RecordBatch, known: pa.Array, holders: list, idf: np.ndarray, avgdl: float, best: Best) -> None:
    lists = batch.column(1)
    lengths = lists.value_lengths().to_numpy(zero_copy_only=False)
    term = pc.index_in(lists.flatten(), value_set=known)
    document = np.repeat(np.arange(batch.num_rows), lengths)[term.is_valid().to_numpy(zero_copy_only=False)]
    term = term.drop_null().to_numpy().astype(np.int64)
    if not len(term):
        return
    pair, tf = np.unique(term * batch.num_rows + document, return_counts=True)
    term, document = pair // batch.num_rows, pair % batch.num_rows
    impact = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * lengths[document] / avgdl))
    scores = np.zeros((len(best.floor), batch.num_rows))
    cuts = np.flatnonzero(np.diff(term, prepend=-1, append=-1))
    for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        scores[np.ix_(holders[term[lo]], document[lo:hi])] += impact[lo:hi]
    touched = np.unique(document)
    scores = np.round(scores[:, touched], DIGITS)
    best.add(scores, np.array(batch.column(0).to_pylist())[touched], scores > 0)


def literals(texts: DataFrame, underscores: bool = False) -> DataFrame:
    """``(id, literal, kind, start, end)`` of ``(id, text)``; null texts have none."""

    def run(batches):
        for batch in batches:
            out = [
                (i, *x) for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for x in extract_literals(text or "", underscores)
            ]
            if out:
                ids, *rest = zip(*out)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, batch.schema.field(0).type), pa.array(rest[0]), pa.array(rest[1]), pa.array(rest[2], pa.int32()), pa.array(rest[3], pa.int32())],
                    names=["id", "literal", "kind", "start", "end"],
                )

    kind = texts.schema["id"].dataType.simpleString()
    return texts.select("id", "text").mapInArrow(run, f"id {kind}, literal string, kind string, start int, end int")


def literal_matches(chunks: DataFrame, pages: DataFrame, wanted: DataFrame) -> DataFrame:
    """``(query_id, id, literal, kind, start, end)``: literals of questions that stand whole inside a chunk's ranges.

    ``wanted``: ``(query_id, literal, kind)``; ``chunks``: ``(id, page_key,
    ranges)``; ``pages``: ``(page_key, markdown)``, full copies of a row allowed. The
    literals travel in blocks of bounded size as one automaton each, which finds
    all of them in one pass over a page; boundaries are judged on the whole page.
    Only hits are shuffled, to be joined to the ranges of their page's chunks.
    """
    spark = chunks.sparkSession
    distinct = materialize(wanted.select("literal", "kind").distinct())
    key, key_type = pages.schema["page_key"].dataType.simpleString(), to_arrow_type(pages.schema["page_key"].dataType)
    blocks = max(1, -(-distinct.count() // LITERALS_PER_PASS))
    parts = []
    for number in range(blocks):
        own = distinct.where(F.pmod(F.xxhash64("literal", "kind"), F.lit(blocks)) == number)
        block = spark.sparkContext.broadcast(sorted(tuple(r) for r in own.collect()))  # about LITERALS_PER_PASS rows
        found = pages.select("page_key", "markdown").mapInArrow(_literal_search(block, key_type), f"page_key {key}, literal string, kind string, start int, end int")
        if blocks > 1:
            found = materialize(found)
            block.destroy()
        parts.append(found)
    hits = reduce(DataFrame.union, parts).distinct()
    ranges = chunks.join(hits.select("page_key").distinct(), "page_key", "left_semi").select("id", "page_key", F.explode("ranges").alias("r"))
    inside = merge_ranges(ranges.select("id", "page_key", "r.start", "r.end"), ["id", "page_key"]).withColumnsRenamed({"start": "a", "end": "b"})
    placed = hits.join(inside, "page_key").where("start >= a and end <= b").select("id", "literal", "kind", "start", "end")
    return placed.join(wanted.select("query_id", "literal", "kind").distinct(), ["literal", "kind"]).select("query_id", "id", "literal", "kind", "start", "end")


def _literal_search(block, key_type):
    def run(batches):
        import ahocorasick

        by_text: dict[str, list[str]] = {}
        for literal, kind in block.value:
            if literal:
                by_text.setdefault(literal, []).append(kind)
        if not by_text:
            return
        automaton = ahocorasick.Automaton()
        for literal, kinds in by_text.items():
            automaton.add_word(literal, (literal, kinds))
        automaton.make_automaton()
        for batch in batches:
            out = []
            for page, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for last, (literal, kinds) in automaton.iter(text or ""):
                    start, end = last + 1 - len(literal), last + 1
                    out += [(page, literal, kind, start, end) for kind in kinds if stands_whole(text, start, end, kind)]
            if out:
                kinds = [key_type, pa.string(), pa.string(), pa.int32(), pa.int32()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=["page_key", "literal", "kind", "start", "end"])

    return run


def lexical_search(index: LexicalIndex, queries: DataFrame, matches: DataFrame, k: int = 10) -> DataFrame:
    """The whole keyword search: literal hits first, then BM25 (see literal_priority).

    Chunks without a literal can only be needed among the best ``k`` by score, so
    beside those only the chunks with a literal are scored.
    """
    hits = materialize(matches.groupBy("query_id", "id").agg(F.count_distinct("literal").alias("n_literals")))
    near = bm25_top_k(index, queries, k).select("query_id", "id", "score")
    scored = pair_scores(index, queries, hits)
    # A chunk of both branches has equal scores but for the last digits.
    scores = near.union(scored).groupBy("query_id", "id").agg(F.min(F.round("score", DIGITS)).alias("score"))
    return ranked_with_literals(scores, hits, k)


def literal_priority(scores: DataFrame, matches: DataFrame, k: int = 10) -> DataFrame:
    """Chunks with literals first (more distinct ones first), then by score; literals compete before the cut.

    Result: ``(query_id, id, rank, n_literals, score)``, score null where only a literal matched.
    """
    return ranked_with_literals(scores, matches.groupBy("query_id", "id").agg(F.count_distinct("literal").alias("n_literals")), k)


def ranked_with_literals(scores: DataFrame, counts: DataFrame, k: int) -> DataFrame:
    both = scores.join(counts, ["query_id", "id"], "full").withColumn("n_literals", F.coalesce("n_literals", F.lit(0)))
    order = (F.desc("n_literals"), F.col("score").isNull(), F.round("score", DIGITS), F.col("id"))
    return top_k(both, k, *order).select("query_id", "id", "rank", "n_literals", "score")
