"""Corpus queries: normalization, constraints, chunking, generations, snapshots."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from docloom.functions.text import INSTANT, digest, percent_encoded, utc_instant
from docloom.operators import chunking, snapshots, validation
from docloom.operators.evaluation import evidence_spans
from docloom.plans.common import CASES, CHUNKS, PAGES, SPANS, cases, chunks, pages
from docloom.session import ensure_checkpoint_dir
from docloom.sources import generations
from docloom.sources.tables import table


def doc_normalize(spark, sf):
    url = F.concat(F.lit("https://"), "source", F.lit("/"), percent_encoded(F.col("locale")), F.lit("/"), percent_encoded(F.col("path"), keep_slash=True))
    return pages(spark, sf).select(
        "page_id", url.alias("url"), utc_instant(F.col("updated_at")).alias("updated_utc"), digest(F.col("markdown")).alias("digest"), F.length("markdown").cast("long").alias("n_chars")
    )


def doc_violations(spark, sf):
    return validation.document_violations(table(spark, sf, "wiki_documents"))


def chunk_violations(spark, sf):
    return validation.chunk_violations(table(spark, sf, "chunks"), table(spark, sf, "wiki_documents"), table(spark, sf, "chunk_settings"))


def vector_violations(spark, sf):
    return validation.vector_violations(table(spark, sf, "chunk_embeddings"), table(spark, sf, "chunks"), 128)


def snapshot_inventory_diff(spark, sf):
    """Pages of the last snapshot against the pages of the wiki, of which some are hidden, renamed or new here."""
    own = table(spark, sf, "document_snapshots")
    last = own.join(own.agg(F.max("snapshot_no").alias("snapshot_no")), "snapshot_no", "left_semi").select("page_id", "path").distinct()
    there = pages(spark, sf).where("page_id % 37 <> 1").select(
        F.when(F.col("page_id") % 37 == 2, -F.col("page_id")).otherwise(F.col("page_id")).alias("page_id"),
        F.when(F.col("page_id") % 37 == 3, F.lit("elsewhere")).otherwise(F.col("path")).alias("path"),
    )
    return validation.inventory_difference(last.dropDuplicates(["page_id"]), there, ["page_id"], ["path"])


def evidence_span_violations(spark, sf):
    return validation.span_violations(evidence_spans(cases(spark, sf)), table(spark, sf, "wiki_documents"))


def reference_violations(spark, sf):
    return validation.reference_violations(cases(spark, sf))


RELATIONS = [
    ("lineitem", "l_orderkey", "orders", "o_orderkey"),
    ("orders", "o_custkey", "customer", "c_custkey"),
    ("customer", "c_nationkey", "nation", "n_nationkey"),
    ("chunk_embeddings", "chunk_id", "chunks", "chunk_id"),
    ("chunks", "page_id", "wiki_documents", "page_id"),
]


def fk_orphans(spark, sf):
    parts = [
        validation.orphans(table(spark, sf, c), k, table(spark, sf, p), pk).agg(F.count("*").alias("orphans")).select(F.lit(f"{c}.{k}").alias("relation"), "orphans")
        for c, k, p, pk in RELATIONS
    ]
    return validation._union(parts)


UNIQUE = [("orders", ["o_orderkey"]), ("lineitem", ["l_orderkey", "l_linenumber"]), ("chunks", ["chunk_id"]), ("eval_cases", ["id"]), ("documents", ["doc_id"])]


def unique_violations(spark, sf):
    return validation._union([validation.duplicates(table(spark, sf, t), keys, t) for t, keys in UNIQUE])


def ordinal_contiguity(spark, sf):
    one = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(
        F.min("l_linenumber").alias("a"), F.max("l_linenumber").alias("b"), F.count_distinct("l_linenumber").alias("n"), F.count("*").alias("c")
    )
    return one.where("a <> 1 or b <> n or c <> n").select("l_orderkey", F.col("n").alias("n_lines"))


def passage_text(spark, sf):
    heading = F.array_join("heading_path", " > ")
    whole = F.concat(F.lit("passage: "), F.coalesce("title", F.lit("")), F.lit("\n"), heading, F.lit("\n"), "search_text")
    one = chunks(spark, sf).join(pages(spark, sf).select("page_id", "title"), "page_id")
    return one.select("chunk_id", heading.alias("heading"), digest(whole).alias("passage_digest"), F.length(whole).cast("long").alias("n_chars"))


def chunk_blocks(spark, sf):
    return chunking.markdown_blocks(pages(spark, sf))


def _chunked(spark, sf, version):
    return chunking.chunk_documents(pages(spark, sf), table(spark, sf, "chunk_settings"), version)


def chunk_markdown(spark, sf):
    return _chunked(spark, sf, chunking.VERSIONS[0])


def chunk_markdown_packed(spark, sf):
    return _chunked(spark, sf, chunking.VERSIONS[1])


def block_cover(spark, sf):
    """Where each page's blocks begin and end, how much they hold, and the headings of pages without fences, rules and underlines."""
    plain = F.col("markdown").rlike(r"(?m)^ {0,3}(```|~~~|=+[ \t]*\r?$|-+[ \t]*\r?$)|\|")
    n = chunking.markdown_blocks(pages(spark, sf)).groupBy("page_id").agg(
        F.min("start").alias("first"), F.max("end").alias("last"), F.sum(F.col("end") - F.col("start")).alias("held"), F.count_if(F.col("kind") == "heading").alias("headings")
    )
    return n.join(pages(spark, sf).select("page_id", plain.alias("other")), "page_id").select("page_id", "first", "last", "held", F.when(~F.col("other"), F.col("headings")).alias("headings"))


def chunk_invariants(spark, sf):
    """Violations of the chunks made here, of which the first of some pages are spoiled: no others."""
    made = _chunked(spark, sf, chunking.VERSIONS[0]).where("error is null")
    m = F.when(F.col("ordinal") == 0, F.col("page_id") % 29)
    spoiled = made.withColumns(
        {
            "body_tokens": F.when(m == 3, 99_999).otherwise(F.col("body_tokens")),
            "search_text": F.when(m == 4, F.concat("search_text", F.lit("x"))).otherwise(F.col("search_text")),
            "ordinal": F.when(m == 5, 99_999).otherwise(F.col("ordinal")),
            "source_ranges": F.when(m == 6, F.expr("filter(source_ranges, x -> false)")).otherwise(F.col("source_ranges")),
        }
    )
    found = validation.chunk_violations(spoiled, table(spark, sf, "wiki_documents"), table(spark, sf, "chunk_settings"))
    named = made.select(F.col("chunk_id").alias("key"), F.col("page_id").cast("string").alias("page"))
    return found.join(named, "key", "left").select(F.coalesce("page", F.substring_index("key", "|", -1)).alias("page_id"), "rule")


def generation_roundtrip(spark, sf):
    """Publish pages and chunks as a generation, and compare what is read back."""
    root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/generations-{uuid.uuid4().hex}"
    made = {"documents": pages(spark, sf), "chunks": chunks(spark, sf)}
    generations.publish(spark, root, made)
    parts = []
    for name, df in made.items():
        back = generations.read(spark, root, name)
        state, same = generations.status(spark, root, list(made)), generations.same_rows(df, back)
        parts.append(back.agg(F.lit(name).alias("table_name"), F.lit(state).alias("state"), F.lit(same).alias("same"), F.count("*").alias("n"), F.max("page_id").alias("last_page")))
    return parts[0].union(parts[1])


def p3_found(spark, sf):
    return snapshots.snapshot_changes(table(spark, sf, "document_snapshots"))


def p3_change_counts(spark, sf):
    return p3_found(spark, sf).groupBy("snapshot_no", "change").agg(F.count("*").alias("n"))


QUERIES = {
    f.__name__: f
    for f in (
        doc_normalize, doc_violations, chunk_violations, vector_violations, snapshot_inventory_diff, evidence_span_violations,
        reference_violations, fk_orphans, unique_violations, ordinal_contiguity, passage_text, chunk_blocks, chunk_markdown,
        chunk_markdown_packed, block_cover, chunk_invariants, generation_roundtrip, p3_found, p3_change_counts,
    )
}

_BLANK = "({0} is null or regexp_replace({0}, '^\\s+|\\s+$', '', 'g') = '')"
_ROLES = ", ".join(f"'{r}'" for r in validation.ROLES)
_REASONS = ", ".join(f"'{r}'" for r in validation.REASONS)


def _rules(rows: str, key: str, rules: dict[str, str]) -> str:
    return " union all ".join(f"select cast({key} as varchar) as key, '{name}' as rule from {rows} where not coalesce({ok}, false)" for name, ok in rules.items())


def _repeats(t: str, keys: list[str], rule: str) -> str:
    return f"select concat_ws('|', {', '.join(f'cast({k} as varchar)' for k in keys)}) as key, '{rule}' as rule from {t} group by {', '.join(keys)} having count(*) > 1"


_P3 = """
with r as (select snapshot_no as s, page_id as k, nullif(lower(regexp_replace(content_sha256, '^\\s+|\\s+$', '', 'g')), '') as h,
    coalesce(epoch_us(try_cast(nullif(trim(updated_at), '') as timestamptz)), -9000000000000000000) as t
  from document_snapshots where snapshot_no is not null and page_id is not null),
one as (select s, k, h from r qualify row_number() over (partition by s, k order by t desc, h desc nulls last) = 1),
seq as (select *, lag(s) over (partition by k order by s) as ps, lead(s) over (partition by k order by s) as ns from one),
runs as (select *, sum(case when ps = s - 1 then 0 else 1 end) over (partition by k order by s) as run from seq),
known as (select *, last_value(h ignore nulls) over (partition by k, run order by s rows between unbounded preceding and 1 preceding) as lk from runs),
ends as (select min(s) as first, max(s) as last from one),
changes as (
  select s as snapshot_no, k as page_id, 'added' as change from known, ends where ps is distinct from s - 1 and s > first
  union all select s + 1, k, 'removed' from known, ends where ns is distinct from s + 1 and s < last
  union all select s, k, 'changed' from known where ps = s - 1 and h <> lk)
"""

SQL = {
    "doc_normalize": f"""select page_id, 'https://' || source || '/' || url_encode(locale) || '/' || replace(url_encode(path), '%2F', '/') as url,
  case when regexp_matches(updated_at, '{INSTANT}') then strftime(try_cast(updated_at as timestamptz) at time zone 'UTC', '%Y-%m-%dT%H:%M:%S.%fZ') end as updated_utc,
  sha256(markdown) as digest, length(markdown) as n_chars from {PAGES}""",
    "doc_violations": _rules(
        "wiki_documents",
        "page_id",
        {
            "page_id": "page_id >= 1",
            **{c: "not " + _BLANK.format(c) for c in ("locale", "path", "title", "source_url")},
            "updated_at": f"regexp_matches(updated_at, '{INSTANT}')",
            "markdown": "markdown is not null",
            "digest": "lower(content_sha256) = sha256(markdown)",
        },
    )
    + " union all " + _repeats("wiki_documents", ["page_id"], "repeated_id")
    + " union all " + _repeats("wiki_documents", ["source", "locale", "path"], "repeated_place"),
    "chunk_violations": f"""with pages as (select page_id, source as page_source, markdown, length(markdown) as n from {PAGES}),
w as (select c.*, p.page_source, p.markdown, p.n, s.maximum, s.input_limit from chunks c left join pages p on p.page_id = c.page_id left join chunk_settings s on s.source = c.source) """
    + _rules(
        "w",
        "chunk_id",
        {
            "document": "page_source = source",
            "segments": f"""len(list_filter(segments, lambda s: not coalesce(case s.kind when 'source' then s.start >= 0 and s.start < s."end" and s."end" <= n and s.role in ({_ROLES})
  when 'generated' then s.text is not null and s.reason in ({_REASONS}) else false end, false))) = 0""",
            "search_text": """search_text = array_to_string(list_transform(segments, lambda s: case when s.kind = 'source' then substring(markdown, s.start + 1, s."end" - s.start) else s.text end), '')""",
            "source_ranges": """list_transform(list_filter(segments, lambda s: s.kind = 'source'), lambda s: s.start || '-' || s."end") = list_transform(source_ranges, lambda s: s.start || '-' || s."end")""",
            "body_budget": "body_tokens >= 0 and body_tokens <= maximum",
            "input_budget": "input_tokens >= body_tokens and input_tokens <= input_limit",
        },
    )
    + " union all " + _repeats("chunks", ["chunk_id"], "repeated_id")
    + " union all select concat_ws('|', source, cast(page_id as varchar)), 'ordinals' from chunks group by source, page_id having min(ordinal) <> 0 or max(ordinal) <> count(distinct ordinal) - 1",
    "vector_violations": """with v as (select chunk_id, vector, coalesce(len(vector) = 128, false) as sized,
    coalesce(len(list_filter(vector, lambda x: not isfinite(x))) = 0, false) as finite from chunk_embeddings)
select chunk_id as key, 'dimension' as rule from v where not sized
union all select chunk_id, 'finite' from v where sized and not finite
union all select chunk_id, 'unit' from v where sized and finite and abs(sqrt(list_dot_product(vector::double[], vector::double[])) - 1) > 1e-5
union all select distinct chunk_id, 'no_chunk' from chunk_embeddings where chunk_id not in (select chunk_id from chunks)
union all select distinct chunk_id, 'no_vector' from chunks where chunk_id not in (select chunk_id from chunk_embeddings)""",
    "snapshot_inventory_diff": f"""with a as (select distinct page_id, path from document_snapshots where snapshot_no = (select max(snapshot_no) from document_snapshots)),
b as (select case when page_id % 37 = 2 then -page_id else page_id end as page_id, case when page_id % 37 = 3 then 'elsewhere' else path end as path from {PAGES} where page_id % 37 <> 1)
select * from (select coalesce(a.page_id, b.page_id) as page_id, case when b.page_id is null then 'missing' when a.page_id is null then 'unexpected' when a.path is distinct from b.path then 'different' end as difference
from a full join b on a.page_id = b.page_id) where difference is not null""",
    "evidence_span_violations": f"""select * from (select case_id, s.page_id, s.s as start, s.e as "end",
  case when p.page_id is null or p.content_sha256 is null then 'no_page' when coalesce(lower(s.content_sha256) <> lower(p.content_sha256), true) then 'digest'
    when not coalesce(s.s >= 0 and s.s < s.e and s.e <= length(p.markdown), false) then 'range'
    when coalesce(substring(p.markdown, s.s + 1, s.e - s.s) <> s.exact_text, true) then 'text' end as rule
from {SPANS.format(cases=CASES)} s left join {PAGES} p on p.page_id = s.page_id) where rule is not null""",
    "reference_violations": f"""with c as (select id, flatten(list_transform(required_facts, lambda f: f.evidence_ids)) as named, list_transform(evidence, lambda e: e.id) as known, tags from {CASES}) """
    + _rules(
        "c",
        "id",
        {
            "unknown_evidence": "len(list_filter(named, lambda x: not list_contains(known, x))) = 0",
            "unused_evidence": "len(list_filter(known, lambda x: not list_contains(named, x))) = 0",
            "repeated_evidence": "len(list_distinct(known)) = len(known)",
            "repeated_tags": "len(list_distinct(tags)) = len(tags)",
        },
    ),
    "fk_orphans": " union all ".join(
        f"select '{c}.{k}' as relation, count(*) as orphans from {c} where {k} is not null and {k} not in (select {pk} from {p} where {pk} is not null)" for c, k, p, pk in RELATIONS
    ),
    "unique_violations": " union all ".join(_repeats(t, keys, t) for t, keys in UNIQUE),
    "ordinal_contiguity": """select l_orderkey, count(distinct l_linenumber) as n_lines from lineitem group by 1
having min(l_linenumber) <> 1 or max(l_linenumber) <> count(distinct l_linenumber) or count(*) <> count(distinct l_linenumber)""",
    "passage_text": f"""select chunk_id, array_to_string(heading_path, ' > ') as heading, sha256(w) as passage_digest, length(w) as n_chars from
(select c.*, 'passage: ' || coalesce(title, '') || chr(10) || array_to_string(heading_path, ' > ') || chr(10) || search_text as w from {CHUNKS} c join (select page_id, title from {PAGES}) p on p.page_id = c.page_id)""",
    "block_cover": f"""select page_id, 0 as first, cast(length(markdown) as integer) as last, length(markdown) as held,
  case when not regexp_matches(markdown, '(?m)^ {{0,3}}(```|~~~|=+[ \\t]*\\r?$|-+[ \\t]*\\r?$)|\\|')
    then len(list_filter(string_split(markdown, chr(10)), lambda x: regexp_full_match(x, ' {{0,3}}#{{1,6}}([ \\t][^\\r\\n]*)?\\r?'))) end as headings from {PAGES} where length(markdown) > 0""",
    "chunk_invariants": f"""with p as (select cast(page_id as varchar) as page_id, page_id % 29 as m from {PAGES} where length(markdown) > 0)
select page_id, 'body_budget' as rule from p where m = 3 union all select page_id, 'input_budget' from p where m = 3 union all select page_id, 'search_text' from p where m = 4
union all select page_id, 'ordinals' from p where m = 5 union all select page_id, 'source_ranges' from p where m = 6""",
    "generation_roundtrip": f"select 'documents' as table_name, 'ok' as state, true as same, count(*) as n, max(page_id) as last_page from {PAGES} union all select 'chunks', 'ok', true, count(*), max(page_id) from {CHUNKS}",
    "p3_found": _P3 + "select cast(snapshot_no as integer) as snapshot_no, page_id, change from changes",
    "p3_change_counts": _P3 + "select cast(snapshot_no as integer) as snapshot_no, change, count(*) as n from changes group by 1, 2",
}
