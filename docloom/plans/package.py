"""Queries over the evaluation package, with faults planted at stated places so that every rule has something to find."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.functions.text import digest
from docloom.operators import evaluation, package, reports
from docloom.plans import retrieval
from docloom.plans.common import ASKED, CASES, CHUNKS, PAGES, RANGES, SPANS, asked_cases, cases, chunk_ranges, chunks, pages, sql_index, sql_search
from docloom.sources.tables import table

POLICY = package.Policy(required_tags=("text", "table", "conflict", "command", "identifier", "follow_up"), several_pages=("conflict",), refusals=(3, 5), starters=("no such question",))
#: Number of a case, from its id.
N = "cast(substring(id, 2) as bigint)"


def planted_cases(spark, sf):
    """The cases with one fault in some of them, chosen by their number."""
    n = F.expr(f"{N} % 40")
    change = {
        "question": F.when(n == 1, F.lit(" ")).otherwise(F.col("question")),
        "tags": F.when(n == 2, F.array(F.lit("text"), F.lit("text"))).when(n == 9, F.array(F.lit("text"), F.lit("follow_up"))).otherwise(F.col("tags")),
        "expected_behavior": F.when(n == 3, F.lit("guess")).when(n == 10, F.lit("partial_answer")).otherwise(F.col("expected_behavior")),
        "answerable": F.when(n == 4, ~F.col("answerable")).otherwise(F.col("answerable")),
        "evidence": F.when(n == 5, F.concat("evidence", "evidence")).otherwise(F.col("evidence")),
        "required_facts": F.when(n == 6, F.expr("filter(required_facts, x -> false)")).otherwise(F.col("required_facts")),
        "id": F.when(n == 7, F.concat(F.lit("!"), "id")).otherwise(F.col("id")),
        "exact_commands": F.when(n == 8, F.array(F.lit("not in any span"))).otherwise(F.col("exact_commands")),
    }
    own = cases(spark, sf)
    return own.select(*(change.get(c, F.col(c)).alias(c) for c in own.columns))


def package_violations(spark, sf):
    return package.package_report(planted_cases(spark, sf), pages(spark, sf), POLICY)


def package_quotas(spark, sf):
    return package.package_quotas(cases(spark, sf), POLICY)


def evidence_identity(spark, sf):
    """How much evidence names the page that is there, a page that has changed, or one that is gone, per source set."""
    found = package.identity_matches(package.evidence_rows(cases(spark, sf)), pages(spark, sf))
    state = F.when(F.col("same").isNull(), "gone").when(F.col("same"), "same").otherwise("changed")
    return found.groupBy(state.alias("state")).agg(F.count("*").alias("n"))


def planted_references(spark, sf):
    """Facts and evidence that do not close, in the planted cases."""
    from docloom.operators import validation

    return validation.reference_violations(planted_cases(spark, sf))


def protocol_groups(spark, sf):
    own = asked_cases(spark, sf).withColumns({"split": F.coalesce(F.lower(F.trim("split")), F.lit("none")), "source_set": F.coalesce("source_set", F.lit("none"))})
    tags = F.when(F.expr(f"{N} % 3 = 0"), F.array_append("tags", "follow_up")).otherwise(F.col("tags"))
    return package.protocol_groups(own.withColumn("tags", tags), retrieval._hits(spark, sf), ["source_set", "split"])


def evidence_manifest(spark, sf):
    """One row per piece of evidence: an id of its own that stays the same, and a digest of its spans cut from the page."""
    rows = package.evidence_rows(cases(spark, sf)).join(pages(spark, sf).select("page_id", "markdown"), "page_id")
    places = F.array_join(F.transform("spans", lambda s: F.concat_ws("-", s.start, s.end)), ",")
    cut = F.array_join(F.expr("transform(spans, s -> substring(markdown, s.start + 1, s.end - s.start))"), "\n")
    name = F.sha2(F.concat_ws("|", "case_id", "evidence_id", F.col("page_id").cast("string"), "locale", "path", "content_sha256", places), 256)
    return rows.select("case_id", "evidence_id", name.alias("manifest_id"), digest(cut).alias("digest"))


def chat_diagnostics(spark, sf):
    """Where a case's evidence is lost on the way to an answer: in the search, in the context that fits, or nowhere."""
    own, ranked, ranges = asked_cases(spark, sf), retrieval._ranked(spark, sf, 6), chunk_ranges(spark, sf)
    packed = retrieval._packed(spark, sf, ranked)
    supplied = evaluation.evidence_hits(own, ranked, ranges, 6).withColumnRenamed("hit", "supplied")
    fitting = evaluation.evidence_hits(own, packed, ranges, 6).withColumnRenamed("hit", "fitting")
    known = own.select(F.col("id").alias("case_id"), (F.coalesce(F.size("evidence"), F.lit(0)) > 0).alias("has_evidence"))
    joined = known.join(supplied, "case_id").join(fitting, "case_id")
    return joined.select("case_id", evaluation.diagnostic(*(F.when(F.col("has_evidence"), F.col(c)) for c in ("supplied", "fitting"))).alias("diagnostic"))


def corpus_counts(spark, sf):
    """Pages, chunks and largest token counts of every source with settings, 0 where it has none."""
    settings = table(spark, sf, "chunk_settings").select("source")
    own = pages(spark, sf).groupBy("source").agg(F.count("*").alias("pages"))
    cut = chunks(spark, sf).groupBy("source").agg(F.count("*").alias("chunks"), F.max("body_tokens").alias("most_body"), F.max("input_tokens").alias("most_input"))
    joined = settings.join(own, "source", "left").join(cut, "source", "left")
    return joined.select("source", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("pages", "chunks", "most_body", "most_input")))


def publishable_pages(spark, sf):
    """Pages that may be indexed: Markdown by type and editor, published, not private, and inside their publishing window."""
    n = F.col("page_id")
    state = pages(spark, sf).select(
        "page_id",
        F.when(n % 11 == 0, "html").otherwise("markdown").alias("content_type"),
        F.when(n % 13 == 0, "visual").otherwise("markdown").alias("editor"),
        F.when(n % 17 == 0, False).when(n % 19 != 0, True).alias("is_published"),
        (n % 23 == 0).alias("is_private"),
        F.when(n % 5 == 0, "").when(n % 5 == 1, "2025-01-01T00:00:00.000+00:00").when(n % 5 == 2, "2027-01-01T00:00:00.000+00:00").when(n % 5 == 3, "soon").otherwise("2026-05-01T00:00:00.000+00:00").alias("publish_start"),
        F.when(n % 7 < 4, "").when(n % 7 == 4, "2026-03-01T00:00:00.000+00:00").when(n % 7 == 5, "2028-01-01T00:00:00.000+00:00").alias("publish_end"),
    )
    return reports.publishable(state, "2026-06-01T00:00:00.000+00:00").select("page_id")


QUERIES = {
    f.__name__: f
    for f in (
        package_violations, package_quotas, evidence_identity, planted_references, protocol_groups, evidence_manifest, chat_diagnostics, corpus_counts, publishable_pages,
    )
}

_PLANTED = f"""(select case when m = 7 then '!' || id else id end as id, case when m = 1 then ' ' else question end as question,
  case when m = 2 then ['text', 'text'] when m = 9 then ['text', 'follow_up'] else tags end as tags, split, source_set,
  case when m = 4 then not answerable else answerable end as answerable, case when m = 3 then 'guess' when m = 10 then 'partial_answer' else expected_behavior end as expected_behavior,
  case when m = 6 then [] else required_facts end as required_facts, case when m = 5 then evidence || evidence else evidence end as evidence,
  case when m = 8 then ['not in any span'] else exact_commands end as exact_commands, previous_question, missing_information, clarification
  from (select *, {N} % 40 as m from {CASES}))"""
_LINES = "chr(10) || array_to_string(list_transform(string_split(replace({0}, chr(13) || chr(10), chr(10)), chr(10)), lambda x: trim(x)), chr(10)) || chr(10)"


def _case_rules() -> str:
    def blank(c):
        return f"(coalesce({c}, '') = '' or regexp_full_match({c}, '\\s*'))"

    rules = {
        "id": "regexp_matches(id, '^[A-Za-z][A-Za-z0-9_-]{0,63}$')",
        "question": f"not {blank('question')}",
        "tags": "len(tags) > 0 and len(list_distinct(tags)) = len(tags)",
        "split": "split in ('tuning', 'holdout')",
        "source_set": "source_set in ('live', 'synthetic')",
        "behavior": "expected_behavior in ('answer', 'partial_answer', 'refuse', 'clarify', 'report_conflict')",
        "answerable": "answerable = (expected_behavior in ('answer', 'partial_answer', 'report_conflict'))",
        "previous_question": f"list_contains(tags, 'follow_up') = (not {blank('previous_question')})",
        "missing_information": f"expected_behavior <> 'partial_answer' or not {blank('missing_information')}",
        "clarification": f"expected_behavior <> 'clarify' or not {blank('clarification')}",
        "facts": "case when answerable then coalesce(len(required_facts), 0) between 1 and 3 and coalesce(len(evidence), 0) > 0 else coalesce(len(required_facts), 0) + coalesce(len(evidence), 0) + coalesce(len(exact_commands), 0) = 0 end",
        "evidence_ids": "len(list_distinct(known)) = len(known)",
        "fact_references": "len(list_filter(named, lambda x: not list_contains(known, x))) = 0 and len(list_filter(known, lambda x: not list_contains(named, x))) = 0",
        "several_pages": "not (expected_behavior = 'report_conflict' or list_contains(tags, 'conflict')) or coalesce(len(list_distinct(list_transform(evidence, lambda e: e.page_id))), 0) >= 2",
    }
    return " union all ".join(f"select id as key, '{name}' as rule from c where not coalesce({ok}, false)" for name, ok in rules.items())


_QUOTAS = """q as (select 'follow_ups' as quota, count(*) filter (where list_contains(tags, 'follow_up')) as found, 2 as least, cast(null as bigint) as most from c
union all select 'refusals', count(*) filter (where expected_behavior = 'refuse'), 3, 5 from c
union all select 'holdout', count(*) filter (where split = 'holdout'), 4, null from c
union all select 'holdout_answerable', count(*) filter (where split = 'holdout' and answerable), 1, null from c
union all select 'holdout_unanswerable', count(*) filter (where split = 'holdout' and not answerable), 1, null from c
union all select 'tuning_answerable', count(*) filter (where split = 'tuning' and answerable), 1, null from c
union all select 'tag: ' || t, (select count(*) from (select unnest(tags) as x from c) where x = t), 1, null from (select unnest(['text', 'table', 'conflict', 'command', 'identifier', 'follow_up']) as t)
union all select 'starter: no such question', count(*) filter (where question = 'no such question'), 1, null from c)"""

_DIAGNOSTIC = f"""with texts as {retrieval._TEXTS}, ranges as {RANGES}, spans as {SPANS.format(cases=ASKED)}, own as {retrieval._ASKED}, {sql_index('texts')}, {sql_search('found', 'own', 6)},
packed as (select * from (select f.*, sum(l.dl) over (partition by f.query_id order by f.rank rows unbounded preceding) as used from found f join lengths l on l.id = f.id) where used <= 600),
{retrieval._hit_sql('supplied', 6, 'found')}, {retrieval._hit_sql('fitting', 6, 'packed')}"""

SQL = {
    "package_violations": f"""with c as (select *, coalesce(flatten(list_transform(required_facts, lambda f: f.evidence_ids)), []) as named, coalesce(list_transform(evidence, lambda e: e.id), []) as known from {_PLANTED}),
ev as (select id as case_id, e.id as eid, e.page_id as page_id, e.locale as locale, e.path as path, e.content_sha256 as sha, e.spans as spans from (select id, unnest(evidence) as e from c)),
w as (select ev.*, p.page_id as there, p.locale as pl, p.path as pp, p.content_sha256 as ps, p.markdown from ev left join {PAGES} p on p.page_id = ev.page_id),
s as (select *, there is not null as ok, len(list_filter(spans, lambda s: not (s.start >= 0 and s.start < s."end" and s."end" <= length(markdown)))) = 0 as inside from w),
{_QUOTAS}
{_case_rules()}
union all select case_id || '/' || eid, 'missing_page' from s where not ok
union all select case_id || '/' || eid, 'identity' from s where ok and not (coalesce(locale = pl, locale is null) and coalesce(path = pp, path is null) and coalesce(sha = ps, sha is null))
union all select case_id || '/' || eid, 'no_span' from s where coalesce(len(spans), 0) = 0
union all select case_id || '/' || eid, 'span' from s where ok and not inside
union all select case_id || '/' || eid, 'exact_text' from s where ok and inside and len(list_filter(spans, lambda s: substring(markdown, s.start + 1, s."end" - s.start) <> s.exact_text)) > 0
union all select k.id, 'exact_command' from (select distinct id, unnest(exact_commands) as command from c) k
  left join (select case_id, list(t) as texts from (select case_id, unnest(list_transform(spans, lambda s: s.exact_text)) as t from ev) group by 1) x on x.case_id = k.id
  where len(list_filter(coalesce(texts, []), lambda t: trim(command) <> '' and contains({_LINES.format('t')}, {_LINES.format('command')}))) = 0
union all select 'package', quota from q where found < least or found > most""",
    "package_quotas": f"with c as {CASES}, {_QUOTAS} select quota, found, cast(least as bigint) as least, most from q",
    "evidence_identity": f"""select case when p.page_id is null then 'gone' when coalesce(e.locale = p.locale, e.locale is null) and coalesce(e.path = p.path, e.path is null) and coalesce(e.content_sha256 = p.content_sha256, e.content_sha256 is null)
  then 'same' else 'changed' end as state, count(*) as n from (select unnest(evidence) as e from {CASES}) left join {PAGES} p on p.page_id = e.page_id group by 1""",
    "planted_references": f"""with c as (select id, tags, flatten(list_transform(required_facts, lambda f: f.evidence_ids)) as named, list_transform(evidence, lambda e: e.id) as known from {_PLANTED})
select id as key, 'unknown_evidence' as rule from c where not coalesce(len(list_filter(named, lambda x: not list_contains(known, x))) = 0, false)
union all select id, 'unused_evidence' from c where not coalesce(len(list_filter(known, lambda x: not list_contains(named, x))) = 0, false)
union all select id, 'repeated_evidence' from c where not coalesce(len(list_distinct(known)) = len(known), false)
union all select id, 'repeated_tags' from c where not coalesce(len(list_distinct(tags)) = len(tags), false)""",
    "protocol_groups": f"""{retrieval._EVAL}, {retrieval._hit_sql('final', 5)},
j as (select coalesce(source_set, 'none') as source_set, coalesce(lower(trim(split)), 'none') as split, c.id, coalesce(answerable, false) as answers, coalesce({N} % 3 = 0 or list_contains(tags, 'follow_up'), false) as follows, expected_behavior as b, coalesce(f.hit, false) as hit
  from {ASKED} c left join final f on f.case_id = c.id)
select source_set, split, count(*) filter (where answers and not follows) as single, count(*) filter (where answers and not follows and hit) as single_hits,
  count(*) filter (where answers and follows) as follow_up, count(*) filter (where answers and follows and hit) as follow_up_hits, count(*) filter (where b = 'refuse') as refuse, count(*) filter (where b = 'clarify') as clarify,
  coalesce(list(id order by id) filter (where answers and not follows and hit), []) as hit_ids, coalesce(list(id order by id) filter (where answers and not follows and not hit), []) as miss_ids from j group by 1, 2""",
    "evidence_manifest": f"""select c.id as case_id, e.id as evidence_id,
  sha256(concat_ws('|', c.id, e.id, cast(e.page_id as varchar), e.locale, e.path, e.content_sha256, array_to_string(list_transform(e.spans, lambda s: s.start || '-' || s."end"), ','))) as manifest_id,
  sha256(array_to_string(list_transform(e.spans, lambda s: substring(p.markdown, s.start + 1, s."end" - s.start)), chr(10))) as digest
from (select id, unnest(evidence) as e from {CASES}) c join {PAGES} p on p.page_id = e.page_id""",
    "chat_diagnostics": f"""{_DIAGNOSTIC} select c.id as case_id, case when coalesce(len(c.evidence), 0) = 0 then 'review_generation' when not s.hit then 'retrieval_miss' when not f.hit then 'context_miss' else 'review_generation' end as diagnostic
from {ASKED} c join supplied s on s.case_id = c.id join fitting f on f.case_id = c.id""",
    "corpus_counts": f"""select s.source, coalesce(p.n, 0) as pages, coalesce(c.n, 0) as chunks, cast(coalesce(c.b, 0) as bigint) as most_body, cast(coalesce(c.i, 0) as bigint) as most_input from chunk_settings s
left join (select source, count(*) as n from {PAGES} group by 1) p on p.source = s.source left join (select source, count(*) as n, max(body_tokens) as b, max(input_tokens) as i from {CHUNKS} group by 1) c on c.source = s.source""",
    "publishable_pages": f"""select page_id from {PAGES} where page_id % 11 <> 0 and page_id % 13 <> 0 and page_id % 17 <> 0 and page_id % 19 <> 0 and page_id % 23 <> 0
  and page_id % 5 in (0, 1, 4) and page_id % 7 not in (4, 6)""",
}
