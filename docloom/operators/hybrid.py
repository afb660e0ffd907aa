"""Fusing ranked branches, and reranking their union."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.operators.lexical import top_k

RRF_CONSTANT = 60
#: Fused scores are compared on this many digits.
SCORE_DIGITS = 12


def fuse(semantic: DataFrame, lexical: DataFrame, k: int = 6, constant: int = RRF_CONSTANT) -> DataFrame:
    """Reciprocal rank fusion of two branches ``(query_id, id, rank)``.

    Result: ``(query_id, id, rank, score, semantic_rank, lexical_rank)``. A branch
    that misses an id adds nothing; equal scores go to the smaller id; of repeated
    ids in a branch the best rank counts.
    """
    def branch(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("query_id", "id").agg(F.min("rank").alias(name))

    both = branch(semantic, "semantic_rank").join(branch(lexical, "lexical_rank"), ["query_id", "id"], "full")
    share = [F.coalesce(1.0 / (F.lit(constant) + F.col(c)), F.lit(0.0)) for c in ("semantic_rank", "lexical_rank")]
    fused = top_k(both.withColumn("score", share[0] + share[1]), k, F.desc(F.round("score", SCORE_DIGITS)), F.col("id"))
    return fused.select("query_id", "id", "rank", "score", "semantic_rank", "lexical_rank")


def candidate_union(branches: list[DataFrame], most: int) -> DataFrame:
    """Distinct ``(query_id, id)`` of the branches; more than ``most`` of a query fail the job."""
    union = branches[0].select("query_id", "id")
    for other in branches[1:]:
        union = union.union(other.select("query_id", "id"))
    union = union.dropDuplicates(["query_id", "id"])
    counted = union.withColumn("n", F.count("*").over(Window.partitionBy("query_id")))
    fits = F.when(F.col("n") <= most, F.col("id")).otherwise(F.raise_error(F.lit(f"more than {most} candidates")).cast(union.schema["id"].dataType))
    return counted.select("query_id", fits.alias("id"))


def rerank(branches: list[DataFrame], scorer: Column, features: DataFrame, k: int) -> DataFrame:
    """Score the whole deduplicated union of the branches and keep the ``k`` best.

    ``features`` has one row per (query_id, id) or per id with the columns that
    ``scorer`` needs. A score that isn't finite fails the query.
    """
    union = branches[0].select("query_id", "id")
    for other in branches[1:]:
        union = union.union(other.select("query_id", "id"))
    keys = [c for c in ("query_id", "id") if c in features.columns]
    return best_scored(union.dropDuplicates(["query_id", "id"]).join(features, keys, "left").withColumn("score", scorer), k)


def best_scored(scored: DataFrame, k: int) -> DataFrame:
    """The ``k`` best of ``(query_id, id, score)``, equal scores: smaller id; a score that isn't finite fails the query."""
    sound = F.col("score").isNotNull() & ~F.isnan("score") & (F.abs("score") != float("inf"))
    checked = scored.withColumn("score", F.when(sound, F.col("score")).otherwise(F.raise_error(F.lit("rerank score is not finite")).cast("double")))
    return top_k(checked, k, F.desc("score"), F.col("id")).select("query_id", "id", "rank", "score")
