"""Scoring retrieval against evidence, grouping, comparing modes, choosing candidates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.operators.intervals import covered_spans

CUT = 5


def protocol_input(cases: DataFrame, follow_up) -> DataFrame:
    """Adds ``input``: the previous question and the question on two lines for follow-ups, else the question."""
    text = F.when(follow_up & F.col("previous_question").isNotNull(), F.concat_ws("\n", "previous_question", "question")).otherwise(F.col("question"))
    return cases.withColumn("input", text)


def evidence_spans(cases: DataFrame) -> DataFrame:
    """``(case_id, page_id, content_sha256, start, end, exact_text)``, one row per evidence span."""
    one = cases.select(F.col("id").alias("case_id"), F.explode("evidence").alias("e"))
    return one.select("case_id", "e.page_id", "e.content_sha256", F.explode("e.spans").alias("s")).select(
        "case_id", "page_id", "content_sha256", "s.start", "s.end", "s.exact_text"
    )


def evidence_hits(cases: DataFrame, ranked: DataFrame, chunk_ranges: DataFrame, cut: int = CUT) -> DataFrame:
    """``(case_id, hit)``: every span of the case is covered by the ranges of its first ``cut`` results.

    ``ranked``: ``(query_id, id, rank)``; ``chunk_ranges``: ``(id, page_id, start,
    end)``. Ranks beyond ``cut`` never count; a case without evidence is a miss.
    """
    spans = evidence_spans(cases).select("case_id", "page_id", "start", "end")
    shown = ranked.where(F.col("rank") <= cut).select(F.col("query_id").alias("case_id"), "id").join(chunk_ranges, "id").select("case_id", "page_id", "start", "end")
    covered = covered_spans(spans, shown, ["case_id", "page_id"])
    return (
        cases.select(F.col("id").alias("case_id"))
        .distinct()
        .join(covered.groupBy("case_id").agg(F.bool_and("covered").alias("all")), "case_id", "left")
        .select("case_id", F.coalesce("all", F.lit(False)).alias("hit"))
    )


def dense_groups(cases: DataFrame, axes: dict[str, list[str]], hit: str = "hit") -> DataFrame:
    """Count, hits, misses and hit rate for every combination of the axes' values, absent ones included."""
    spark = cases.sparkSession
    grid = reduce(DataFrame.crossJoin, [spark.createDataFrame([(v,) for v in values], f"{name} string") for name, values in axes.items()])  # fixed, small
    got = cases.groupBy(*axes).agg(F.count("*").alias("n"), F.count_if(F.col(hit)).alias("hits"))
    counted = grid.join(got, list(axes), "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n", "hits")})
    return counted.select(*axes, "n", "hits", (F.col("n") - F.col("hits")).alias("misses"), F.try_divide("hits", "n").alias("hit_rate"))


def transitions(hits: DataFrame) -> DataFrame:
    """``(mode_a, mode_b, hit_a, hit_b, n)`` over the cases of ``(mode, case_id, hit)``, for every two modes."""
    a = hits.select("case_id", F.col("mode").alias("mode_a"), F.col("hit").alias("hit_a"))
    b = hits.select("case_id", F.col("mode").alias("mode_b"), F.col("hit").alias("hit_b"))
    return a.join(b, "case_id").where("mode_a < mode_b").groupBy("mode_a", "mode_b", "hit_a", "hit_b").agg(F.count("*").alias("n"))


def lost_and_new(baseline: DataFrame, candidate: DataFrame) -> DataFrame:
    """``(case_id, change)`` of cases hit by only one of the two ``(case_id, hit)`` reports: lost or new."""
    old, new = (df.where("hit").select("case_id") for df in (baseline, candidate))
    lost = old.join(new, "case_id", "left_anti").withColumn("change", F.lit("lost"))
    return lost.union(new.join(old, "case_id", "left_anti").withColumn("change", F.lit("new")))


def loss_kind(inventory, union, final):
    """Where evidence got lost: among the candidates, in the ranking, or nowhere."""
    return F.when(~inventory, "impossible").when(~union, "candidate_loss").when(~final, "ranking_loss").otherwise("found")


def diagnostic(supplied, packed):
    """What to look at in a case: evidence not found, evidence that did not fit, or else the generated text (nulls: no evidence)."""
    return F.when(~supplied, "retrieval_miss").when(~packed, "context_miss").otherwise("review_generation")


def choose(candidates: DataFrame, *, order: list, eligible) -> DataFrame:
    """The single first eligible row in a lexicographic order of expressions."""
    return candidates.where(eligible).orderBy(*order).limit(1)


def latency_report(samples: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Count, mean, largest and nearest-rank 95th percentile per group; null values are ignored."""
    known = samples.where(F.col(value).isNotNull())
    found = known.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.max(value).alias("largest"))
    return found.join(nearest_rank(known, keys, value, 0.95).withColumnRenamed("value", "p95"), keys).select(*keys, "n", "mean", "largest", "p95")


#: Accuracy of the sketch that brackets a percentile, and half the width of the bracket: far more than the sketch can be off.
SKETCH, BRACKET = 10_000, 0.002


def nearest_rank(samples: DataFrame, keys: list[str], value: str, share: float) -> DataFrame:
    """``(keys, value)``: the value at rank ``ceil(share * n)`` of each group, exactly; null values are ignored.

    A sketch brackets the rank, then only the distinct values inside the bracket
    (0.4 % of a group) are ordered, so a hot group is never sorted in one task.
    """
    known = samples.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("value"))
    ends = F.percentile_approx("value", [max(share - BRACKET, 0.0), min(share + BRACKET, 1.0)], SKETCH)
    bounds = known.groupBy(*keys).agg(F.count("*").alias("n"), ends.alias("ends")).select(*keys, "n", F.col("ends")[0].alias("low"), F.col("ends")[1].alias("high"))
    place = known.join(bounds, keys).where("value <= high")
    # Values below the bracket count together, under its lower end less a rank.
    counted = place.groupBy(*keys, "n", F.when(F.col("value") >= F.col("low"), F.col("value")).alias("value")).agg(F.count("*").alias("c"))
    up_to = F.sum("c").over(Window.partitionBy(*keys).orderBy(F.asc_nulls_first("value")).rowsBetween(Window.unboundedPreceding, 0))
    reached = counted.withColumn("up_to", up_to).where(F.col("up_to") >= F.ceil(F.lit(share) * F.col("n") - 1e-9))
    return reached.where("value is not null").groupBy(*keys).agg(F.min("value").alias("value"))


def compare_modes(hits: DataFrame, base: str) -> DataFrame:
    """``(mode, cases, hits, hit_rate, won, lost)`` of ``(mode, case_id, hit)``; won and lost are against mode ``base``.

    A mode that scores other cases than the base fails the job: such reports cannot be compared.
    """
    own = hits.where(F.col("mode") == base).select("case_id", F.col("hit").alias("base"))
    sizes = hits.groupBy("mode").agg(F.count("*").alias("n"), F.expr("bit_xor(xxhash64(case_id))").alias("same"))
    spread = sizes.agg(F.count_distinct("n", "same").alias("kinds"))
    checked = F.when(F.col("kinds") == 1, F.col("case_id")).otherwise(F.raise_error(F.lit("the modes score different cases")).cast("string"))
    joined = hits.crossJoin(spread).select("mode", checked.alias("case_id"), "hit").join(own, "case_id")  # one row of kinds
    return joined.groupBy("mode").agg(
        F.count("*").alias("cases"),
        F.count_if("hit").alias("hits"),
        F.round(F.try_divide(F.count_if("hit"), F.count("*")), 9).alias("hit_rate"),
        F.count_if(F.col("hit") & ~F.col("base")).alias("won"),
        F.count_if(~F.col("hit") & F.col("base")).alias("lost"),
    )


def candidate_report(hits: DataFrame, base: tuple[int, int, int]) -> DataFrame:
    """Settings with their hits, lost and new hits against ``base``, and which one is chosen.

    ``hits``: ``(semantic_k, lexical_k, literal_policy, case_id, hit, follows)``.
    Chosen is the first by: more hits, none lost, more hits of follow-ups, fewer
    changed policies, fewer candidates in all, fewer semantic ones, smaller policy.
    """
    keys = ["semantic_k", "lexical_k", "literal_policy"]
    first = reduce(lambda a, b: a & b, [F.col(k) == v for k, v in zip(keys, base)])
    old = hits.where(first).select("case_id", F.col("hit").alias("base"))
    counted = hits.join(old, "case_id").groupBy(*keys).agg(
        F.count_if(F.col("hit") & ~F.col("follows")).alias("hits"),
        F.count_if(F.col("hit") & F.col("follows")).alias("follow_up_hits"),
        F.count_if(F.col("base") & ~F.col("hit")).alias("lost"),
        F.count_if(F.col("hit") & ~F.col("base")).alias("new"),
    )
    order = [F.desc("hits"), F.col("lost") > 0, F.desc("follow_up_hits"), F.col("literal_policy") != base[2], F.col("semantic_k") + F.col("lexical_k"), "semantic_k", "literal_policy"]
    best = counted.orderBy(*order).limit(1).select(*keys, F.lit(True).alias("best"))
    return counted.join(best, keys, "left").select(*keys, "hits", "follow_up_hits", "lost", "new", F.coalesce("best", F.lit(False)).alias("chosen"))
