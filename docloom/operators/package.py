"""Validation of an evaluation package: its cases, their evidence, and what the package as a whole must hold."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.functions.checks import holds_lines
from docloom.operators.validation import _union, broken, duplicates, is_blank

# How a case may be answered, and which of these mean that the corpus answers it.
BEHAVIORS = ["answer", "partial_answer", "refuse", "clarify", "report_conflict"]
ANSWERING = ["answer", "partial_answer", "report_conflict"]
CASE_ID = "^[A-Za-z][A-Za-z0-9_-]{0,63}$"


@dataclass(frozen=True)
class Policy:
    """What a package must look like; every list is a parameter of the package, not of the engine."""

    splits: tuple[str, ...] = ("tuning", "holdout")
    sources: tuple[str, ...] = ("live", "synthetic")
    required_tags: tuple[str, ...] = ()
    behavior_tags: dict[str, str] = field(default_factory=dict)  # behavior: the tag that goes with it and with nothing else
    several_pages: tuple[str, ...] = ("composite",)  # tags whose evidence must come from two pages at least
    starters: tuple[str, ...] = ()  # questions that must stand in the package
    least_follow_ups: int = 2
    refusals: tuple[int, int] = (3, 5)
    least_holdout: int = 4


def evidence_rows(cases: DataFrame) -> DataFrame:
    """``(case_id, evidence_id, page_id, locale, path, content_sha256, spans)``, one row per piece of evidence."""
    e = cases.select(F.col("id").alias("case_id"), F.explode("evidence").alias("e"))
    return e.select("case_id", F.col("e.id").alias("evidence_id"), "e.page_id", "e.locale", "e.path", "e.content_sha256", "e.spans")


def identity_matches(evidence: DataFrame, documents: DataFrame, keys: tuple[str, ...] = ("locale", "path", "content_sha256")) -> DataFrame:
    """The evidence with ``same``: whether its page has the values it names (a null names nothing), null without the page."""
    pages = documents.dropDuplicates(["page_id"]).select("page_id", F.lit(True).alias("exists"), *(F.col(k).alias(f"page_{k}") for k in keys))
    same = F.lit(True)
    for k in keys:
        same = same & F.coalesce(F.col(k) == F.col(f"page_{k}"), F.col(k).isNull())
    return evidence.join(pages, "page_id", "left").withColumn("same", F.when(F.col("exists"), same)).select(*evidence.columns, "same")


def case_violations(cases: DataFrame, policy: Policy) -> DataFrame:
    """``(key, rule)`` of what a case says about itself."""
    tags = F.coalesce("tags", F.array().cast("array<string>"))
    facts, evidence, commands = (F.coalesce(F.size(c), F.lit(0)) for c in ("required_facts", "evidence", "exact_commands"))
    empty = F.coalesce(F.col("required_facts"), F.expr("filter(required_facts, x -> false)"))
    named = F.coalesce(F.flatten(F.transform(empty, lambda f: f.evidence_ids)), F.array().cast("array<string>"))
    known = F.coalesce(F.transform("evidence", lambda e: e.id), F.array().cast("array<string>"))
    behavior = F.col("expected_behavior")
    rules = {
        "id": F.col("id").rlike(CASE_ID),
        "question": ~is_blank(F.col("question")),
        "tags": (F.size(tags) > 0) & (F.size(F.array_distinct(tags)) == F.size(tags)),
        "split": F.col("split").isin(*policy.splits),
        "source_set": F.col("source_set").isin(*policy.sources),
        "behavior": behavior.isin(*BEHAVIORS),
        "answerable": F.col("answerable") == behavior.isin(*ANSWERING),
        "previous_question": F.array_contains(tags, "follow_up") == ~is_blank(F.col("previous_question")),
        "missing_information": (behavior != "partial_answer") | ~is_blank(F.col("missing_information")),
        "clarification": (behavior != "clarify") | ~is_blank(F.col("clarification")),
        "facts": F.when(F.col("answerable"), facts.between(1, 3) & (evidence > 0)).otherwise((facts == 0) & (evidence == 0) & (commands == 0)),
        "evidence_ids": F.size(F.array_distinct(known)) == F.size(known),
        "fact_references": (F.size(F.array_except(named, known)) == 0) & (F.size(F.array_except(known, named)) == 0),
    }
    for what, tag in policy.behavior_tags.items():
        rules[f"behavior_tag_{what}"] = F.array_contains(tags, tag) == (behavior == what)
    if policy.several_pages:
        pages = F.size(F.array_distinct(F.transform("evidence", lambda e: e.page_id)))
        needs = (behavior == "report_conflict") | F.arrays_overlap(tags, F.array(*map(F.lit, policy.several_pages)))
        rules["several_pages"] = ~needs | (F.coalesce(pages, F.lit(0)) >= 2)
    return _union([broken(cases, F.col("id"), rules), duplicates(cases, ["id"], "repeated_id")])


def evidence_violations(cases: DataFrame, documents: DataFrame) -> DataFrame:
    """``(key, rule)`` of evidence against its pages: absent pages, other identities, spans and commands that are not there."""
    rows = identity_matches(evidence_rows(cases), documents)
    pages = documents.dropDuplicates(["page_id"]).select("page_id", "markdown")
    inside = F.expr("forall(spans, s -> s.start >= 0 and s.start < s.end and s.end <= length(markdown))")
    text = F.expr("forall(spans, s -> substring(markdown, s.start + 1, s.end - s.start) = s.exact_text)")
    there = F.col("same").isNotNull()
    rules = {
        "missing_page": there,
        "identity": ~there | F.col("same"),
        "no_span": F.size("spans") > 0,
        "span": ~there | inside,
        "exact_text": ~there | ~F.coalesce(inside, F.lit(False)) | text,
    }
    own = broken(rows.join(pages, "page_id", "left"), F.concat_ws("/", "case_id", "evidence_id"), rules)
    quoted = rows.select("case_id", F.explode("spans").alias("s")).groupBy("case_id").agg(F.collect_list("s.exact_text").alias("texts"))
    asked = cases.select(F.col("id").alias("case_id"), F.explode("exact_commands").alias("command")).join(quoted, "case_id", "left")
    held = asked.select("case_id", "command", F.explode_outer("texts").alias("text")).groupBy("case_id", "command").agg(F.bool_or(holds_lines(F.col("text"), F.col("command"))).alias("held"))
    return own.union(held.where(~F.coalesce("held", F.lit(False))).select("case_id", F.lit("exact_command")))


def package_quotas(cases: DataFrame, policy: Policy) -> DataFrame:
    """``(quota, found, least, most)`` of what the package as a whole must hold; ``most`` null: no limit."""
    one = cases.select("id", "split", "answerable", "expected_behavior", F.array_contains("tags", "follow_up").alias("follows"))
    counts = one.agg(
        F.count_if("follows").alias("follow_ups"),
        F.count_if(F.col("expected_behavior") == "refuse").alias("refusals"),
        F.count_if(F.col("split") == "holdout").alias("holdout"),
        F.count_if((F.col("split") == "holdout") & F.col("answerable")).alias("holdout_answerable"),
        F.count_if((F.col("split") == "holdout") & ~F.col("answerable")).alias("holdout_unanswerable"),
        F.count_if((F.col("split") == "tuning") & F.col("answerable")).alias("tuning_answerable"),
    )
    limits = {
        "follow_ups": (policy.least_follow_ups, None), "refusals": policy.refusals, "holdout": (policy.least_holdout, None),
        "holdout_answerable": (1, None), "holdout_unanswerable": (1, None), "tuning_answerable": (1, None),
    }
    rows = F.array(*(F.struct(F.lit(q).alias("quota"), F.col(q).alias("found"), F.lit(a).cast("long").alias("least"), F.lit(b).cast("long").alias("most")) for q, (a, b) in limits.items()))
    quotas = counts.select(F.explode(rows).alias("r")).select("r.*")
    spark = cases.sparkSession
    for name, column, wanted in (("tag", F.explode("tags"), policy.required_tags), ("starter", F.col("question"), policy.starters)):
        if wanted:
            stated = spark.createDataFrame([(w,) for w in wanted], "value string")
            have = cases.select(column.alias("value")).join(F.broadcast(stated), "value", "left_semi").groupBy("value").agg(F.count("*").alias("found"))
            counted = stated.join(have, "value", "left")
            quotas = quotas.union(counted.select(F.concat(F.lit(f"{name}: "), "value"), F.coalesce("found", F.lit(0)), F.lit(1).cast("long"), F.lit(None).cast("long")))
    return quotas


def package_report(cases: DataFrame, documents: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """``(key, rule)`` of every violation; quotas that are not met have the key ``package``.

    Full copies of a row count once. Null lists are empty lists, null texts are
    blank; an empty table violates the quotas only.
    """
    own = cases.distinct()
    unmet = package_quotas(own.dropDuplicates(["id"]), policy).where("found < least or found > most")
    return _union([case_violations(own, policy), evidence_violations(own.dropDuplicates(["id"]), documents), unmet.select(F.lit("package").alias("key"), F.col("quota").alias("rule"))])


def protocol_groups(cases: DataFrame, hits: DataFrame, axes: list[str]) -> DataFrame:
    """Per group: single questions and follow-ups that the corpus answers, with their hits, and refusals and clarifications apart."""
    follows = F.coalesce(F.array_contains("tags", "follow_up"), F.lit(False))
    answers = F.coalesce(F.col("answerable"), F.lit(False))
    hit = F.coalesce("hit", F.lit(False))
    return (
        cases.select(F.col("id").alias("case_id"), *axes, "tags", "answerable", "expected_behavior")
        .join(hits, "case_id", "left")
        .groupBy(*axes)
        .agg(
            F.count_if(answers & ~follows).alias("single"),
            F.count_if(answers & ~follows & hit).alias("single_hits"),
            F.count_if(answers & follows).alias("follow_up"),
            F.count_if(answers & follows & hit).alias("follow_up_hits"),
            F.count_if(F.col("expected_behavior") == "refuse").alias("refuse"),
            F.count_if(F.col("expected_behavior") == "clarify").alias("clarify"),
            F.array_sort(F.collect_list(F.when(answers & ~follows & hit, F.col("case_id")))).alias("hit_ids"),
            F.array_sort(F.collect_list(F.when(answers & ~follows & ~hit, F.col("case_id")))).alias("miss_ids"),
        )
    )
