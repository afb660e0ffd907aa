"""Queries that build an index and prove it, compare search modes, and check single rows against stated rules."""

from __future__ import annotations

import datetime as dt
import uuid

import numpy as np
from pyspark.sql import functions as F

from docloom.functions import checks, identity, tokens
from docloom.functions.text import digest, terms
from docloom.operators import builds, chunking, evaluation, grounding, hybrid, intervals, lexical, models, semantic, telemetry, validation
from docloom.plans import corpus, retrieval
from docloom.plans.common import ASKED, CASES, CHUNKS, PAGES, RANGES, SPANS, TEXTS, asked_cases, cases, chunk_fields, chunk_ranges, chunks, pages, sql_index, sql_search, sql_terms
from docloom.session import ensure_checkpoint_dir, materialize
from docloom.sources import generations, snapshots
from docloom.sources.tables import table

HASH_DIM = 64


def term_hash_encoder():
    """A deterministic encoder of terms (separated by blanks): how many fall in each of 64 cells of their MD5; no terms: the first cell."""
    import hashlib

    def encode(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), HASH_DIM))
        for i, text in enumerate(texts):
            for term in text.split(" "):
                out[i, hashlib.md5(term.encode()).digest()[0] % HASH_DIM if term else 0] += 1
        return out

    return encode


def _encoded(rows, text):
    return models.encode(rows.withColumn("_terms", F.array_join(terms(F.coalesce(text, F.lit(""))), " ")), "_terms", term_hash_encoder).drop("_terms")


def _folder(spark, name):
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _built(spark, sf):
    """A generation made of the pages and their chunks, with term-hash vectors; returns its root."""
    root = _folder(spark, "index")
    about = builds.identity("term-hash", HASH_DIM, tokens.WORDS, chunking.VERSIONS[0])
    own = chunks(spark, sf).select("chunk_id", "source", "page_id", "ordinal", "heading_path", "search_text")
    builds.rebuild(spark, root, pages(spark, sf), table(spark, sf, "chunk_settings"), term_hash_encoder, about, chunks=own, when=dt.datetime(2026, 1, 1, tzinfo=dt.timezone.utc))
    return root


def index_build(spark, sf):
    """What a full build of the given chunks holds."""
    root = _built(spark, sf)
    status = builds.index_status(spark, root)
    read = {t: generations.read(spark, root, t) for t in builds.TABLES}
    index = lexical.LexicalIndex(read["terms"])
    parts = [
        read["documents"].agg(F.lit("documents").alias("what"), F.count("*").alias("n")),
        read["chunks"].agg(F.lit("chunks"), F.count("*")),
        read["vectors"].agg(F.lit("vectors"), F.count("*")),
        index.postings.agg(F.lit("postings"), F.count("*")),
        index.postings.agg(F.lit("terms"), F.count_distinct("term")),
        index.lengths.agg(F.lit("longest"), F.max("dl")),
        spark.createDataFrame([(f"status {status['state']}", int(status["chunks"]))], "what string, n long"),
    ]
    return validation._union(parts)


def rechunked_build(spark, sf):
    """A full build that cuts the pages itself: every page with text is covered whole by its chunks, and nothing is violated."""
    root = _folder(spark, "index")
    about = builds.identity("term-hash", HASH_DIM, tokens.WORDS, chunking.VERSIONS[1])
    builds.rebuild(spark, root, pages(spark, sf), table(spark, sf, "chunk_settings"), term_hash_encoder, about, when=dt.datetime(2026, 1, 1, tzinfo=dt.timezone.utc))
    made = generations.read(spark, root, "chunks")
    ranges = made.select("page_id", F.explode("source_ranges").alias("r")).select("page_id", "r.start", "r.end")
    return intervals.merge_ranges(ranges, ["page_id"]).select("page_id", "start", "end")


def index_violations(spark, sf):
    """Faults planted in a built index: lexical rows gone, repeated, of other texts or of no chunk, vectors gone or not of unit length."""
    root = _built(spark, sf)
    read = {t: generations.read(spark, root, t) for t in builds.TABLES}
    own = read["chunks"].select(F.col("chunk_id").alias("id"), (F.col("page_id") % 30).alias("m"))
    held = read["terms"].join(own, "id")
    spoiled = (
        held.where("m <> 1").select("id", F.when(F.col("m") == 2, F.array_append("terms", "planted")).otherwise(F.col("terms")).alias("terms"))
        .union(held.where("m = 3").select("id", "terms"))
        .union(held.where("m = 4").select(F.concat(F.lit("no-"), "id"), "terms"))
    )
    vectors = read["vectors"].join(own.withColumnRenamed("id", "chunk_id"), "chunk_id").where("m <> 5")
    vectors = vectors.select("chunk_id", F.when(F.col("m") == 6, F.transform("vector", lambda x: (x * 2).cast("float"))).otherwise(F.col("vector")).alias("vector"))
    fields = builds.index_fields(read["chunks"], read["documents"])
    return builds.lexical_violations(spoiled, fields).union(validation.vector_violations(vectors, read["chunks"], HASH_DIM))


def chunk_output_violations(spark, sf):
    """The chunks written as canonical JSON lines, read back strictly and validated."""
    path = _folder(spark, "chunks")
    snapshots.write_chunk_output(table(spark, sf, "chunks"), path)
    back = snapshots.read_chunk_output(spark, path)
    return validation.chunk_violations(back, table(spark, sf, "wiki_documents"), table(spark, sf, "chunk_settings"))


def snapshot_json(spark, sf):
    """The pages of every source as a snapshot file, read back strictly."""
    path = _folder(spark, "snapshot")
    snapshots.write_json_snapshot(pages(spark, sf), path)
    back = snapshots.read_json_snapshot(spark, path)
    return back.select("source", "page_id", "title", "updated_at", digest(F.col("markdown")).alias("digest"))


def strict_json_lines(spark, sf):
    """Which of the events' objects are strict JSON, with repeated keys, NaN and broken ends planted."""
    n = F.col("event_id") % 50
    raw = F.when(n == 0, F.concat(F.lit('{"k": 1, "k": '), n.cast("string"), F.lit("}"))).when(n == 1, F.lit('{"k": NaN}')).when(n == 2, F.lit('{"k": [1, {"a": 1, "a": 1}]}')).when(n == 3, F.lit('{"k": 1')).otherwise(F.col("props"))
    rows = table(spark, sf, "events").select("event_id", raw.alias("raw"))
    return snapshots.strict_lines(rows, "event_id", "raw")


def generated_shapes(spark, sf):
    """Which generated objects have exactly the two text keys they should have."""
    n = F.expr("cast(substring(id, 2) as bigint) % 9")
    raw = (
        F.when(n == 0, F.lit('{"kind": "answer"}')).when(n == 1, F.lit('{"kind": "answer", "answer": 5}')).when(n == 2, F.lit('{"kind": "answer", "answer": "x", "more": 1}'))
        .when(n == 3, F.lit("[]")).when(n == 4, F.lit("{")).otherwise(F.to_json(F.struct("kind", "answer")))
    )
    own = table(spark, sf, "safety_cases").dropDuplicates(["id"])
    return snapshots.shaped_lines(own.select("id", raw.alias("raw")), "id", "raw", {"kind": str, "answer": str})


def chunk_lookup(spark, sf):
    """The first chunk by id, found in a published generation."""
    root = _folder(spark, "lookup")
    generations.publish(spark, root, {"chunks": chunks(spark, sf).select("chunk_id", "page_id", "ordinal", "search_text")})
    stored = generations.read(spark, root, "chunks")
    first = stored.agg(F.min("chunk_id")).first()[0]
    return stored.where(F.col("chunk_id") == F.lit(first)).select("chunk_id", "page_id", "ordinal", F.length("search_text").alias("n_chars"))


def corpus_fingerprint(spark, sf):
    """One fingerprint of all pages, whatever their order."""
    return builds.table_fingerprint(pages(spark, sf), ["source", "page_id", "content_sha256", "updated_at"])


def token_count_violations(spark, sf):
    """Chunks whose stated number of tokens is not the number of words and signs of their text."""
    counted = F.size(F.regexp_extract_all("search_text", F.lit(r"(?U)\w+|[^\w\s]"), F.lit(0)))
    found = chunks(spark, sf).select("chunk_id", F.col("body_tokens").cast("long").alias("stated"), counted.cast("long").alias("counted"))
    return found.where("coalesce(stated <> counted, true)")


def chunk_segments(spark, sf):
    """Every segment of every chunk with its text: the provenance of a chunk as flat rows."""
    own = chunks(spark, sf).join(pages(spark, sf).select("page_id", "markdown"), "page_id")
    flat = own.select("chunk_id", "markdown", F.posexplode("segments").alias("position", "s"))
    text = F.when(F.col("s.kind") == "source", F.substring(F.col("markdown"), F.col("s.start") + 1, F.col("s.end") - F.col("s.start"))).otherwise(F.col("s.text"))
    return flat.select("chunk_id", "position", "s.kind", "s.start", "s.end", "s.role", "s.reason", digest(text).alias("digest"))


def prompt_messages(spark, sf):
    """The digest of each asked case's conversation: the rules, then the question with its exact evidence texts."""
    texts = F.flatten(F.transform("evidence", lambda e: F.transform(e.spans, lambda s: s.exact_text)))
    made = grounding.messages(F.lit("Answer from the context only."), F.col("question"), texts)
    return asked_cases(spark, sf).where("size(evidence) > 0").select("id", digest(made).alias("digest"))


def pair_fingerprints(spark, sf):
    """One fingerprint per asked case and piece of evidence text, as a scorer's cache would key it."""
    own = asked_cases(spark, sf).select("id", "question", F.explode("evidence").alias("e")).select("id", "question", F.explode("e.spans").alias("s"))
    return own.select("id", identity.pair_fingerprint(F.col("question"), F.col("s.exact_text")).alias("fingerprint"))


def stop_reasons(spark, sf):
    """Where each user's series would stop: at the first sample whose gap or growth is too large, and why."""
    rows = table(spark, sf, "events").select("event_id", "user_id", "ts", "value")
    return telemetry.first_stops(rows, ["user_id"], "ts", "event_id", "value", most_gap_us=4 * 86_400_000_000, most_growth=60.0)


# Search modes.


def _mode_rankings(spark, sf, semantic_k, lexical_k):
    """Candidates of the term-hash encoder and of keywords for the asked cases."""
    asked = asked_cases(spark, sf).select(F.col("id").alias("query_id"), F.col("question").alias("text"))
    vectors = _encoded(chunk_fields(spark, sf), F.col("text")).select("id", "vector")
    near = semantic.exact_top_k(materialize(vectors), _encoded(asked, F.col("text")).select("query_id", "vector"), semantic_k, HASH_DIM)
    return materialize(near), materialize(retrieval._lexical_search(spark, sf, asked, lexical_k))


def _mode_hits(spark, sf):
    """``(mode, case_id, hit)`` of the three modes at five results."""
    near, words = _mode_rankings(spark, sf, 10, 10)
    own, ranges = asked_cases(spark, sf), chunk_ranges(spark, sf)
    ranked = {"semantic": near, "lexical": words, "hybrid": hybrid.fuse(near, words, k=6)}
    parts = [evaluation.evidence_hits(own, r, ranges).select(F.lit(mode).alias("mode"), "case_id", "hit") for mode, r in ranked.items()]
    return materialize(validation._union(parts))


def mode_comparison(spark, sf):
    """Cases, hits and hit rate of each mode, and how many cases it wins from and loses to the semantic one."""
    return evaluation.compare_modes(_mode_hits(spark, sf), "semantic")


GRID = [(s, k, policy) for s in (5, 10) for k in (1, 10) for policy in (1, 2)]


def candidate_grid(spark, sf):
    """Every setting of a small grid with its hits, lost and new hits against the first, and the one that is chosen."""
    asked = asked_cases(spark, sf).select(F.col("id").alias("query_id"), F.col("question").alias("text"))
    near, _ = _mode_rankings(spark, sf, 10, 1)
    index = lexical.build_index(chunk_fields(spark, sf)).stored()
    words = {p: materialize(lexical.lexical_search(index, asked, retrieval._literal_matches(spark, sf, asked, p == 2), 10)) for p in (1, 2)}
    own, ranges = asked_cases(spark, sf), chunk_ranges(spark, sf)
    parts = []
    for s, k, policy in GRID:
        fused = hybrid.fuse(near.where(F.col("rank") <= s), words[policy].where(F.col("rank") <= k), k=6)
        hits = evaluation.evidence_hits(own, fused, ranges)
        parts.append(hits.select(F.lit(s).alias("semantic_k"), F.lit(k).alias("lexical_k"), F.lit(policy).alias("literal_policy"), "case_id", "hit"))
    follows = own.select(F.col("id").alias("case_id"), F.col("previous_question").isNotNull().alias("follows"))
    return evaluation.candidate_report(materialize(validation._union(parts)).join(follows, "case_id"), GRID[0])


QUERIES = {
    f.__name__: f
    for f in (
        index_build, rechunked_build, index_violations, chunk_output_violations, snapshot_json, strict_json_lines, generated_shapes, chunk_lookup, corpus_fingerprint, token_count_violations,
        chunk_segments, prompt_messages, pair_fingerprints, stop_reasons, mode_comparison, candidate_grid,
    )
}

_HASHED = """case when len(t) = 0 then [0] else list_transform(t, lambda x: (16 * (position(md5(x)[1] in '0123456789abcdef') - 1) + position(md5(x)[2] in '0123456789abcdef') - 1) % 64) end"""


def _sql_vectors(name: str, source: str, key: str) -> str:
    """CTE ``name(key, v)``: unit vectors of (key, text) by the term-hash encoder, as 32-bit numbers."""
    return f"""{name}_b as (select {key}, {_HASHED} as b from (select {key}, {sql_terms("coalesce(text, '')")} as t from {source})),
{name}_c as (select {key}, list_transform(range(0, 64), lambda i: len(list_filter(b, lambda x: x = i))::double) as c from {name}_b),
{name} as (select {key}, list_transform(c, lambda x: (x / sqrt(list_dot_product(c, c)))::real::double) as v from {name}_c)"""


_RANKED = f"""with texts as {TEXTS}, ranges as {RANGES}, spans as {SPANS.format(cases=ASKED)}, own as {retrieval._ASKED}, {sql_index('texts')}, {sql_search('words', 'own', 10)},
{_sql_vectors("dv", "texts", "id")}, {_sql_vectors("qv", "own", "query_id")},
near as (select query_id, id, row_number() over (partition by query_id order by c desc, id) as rank from
  (select query_id, id, round(list_dot_product(q.v, d.v) / sqrt(list_dot_product(q.v, q.v)) / sqrt(list_dot_product(d.v, d.v)), 9) as c from qv q, dv d) qualify rank <= 10)"""


def _sql_fused(name: str, semantic_k: int, lexical_k: int, words: str = "words") -> str:
    return f"""{name} as (select query_id, id, row_number() over (partition by query_id order by round(score, 12) desc, id) as rank from (select coalesce(s.query_id, w.query_id) as query_id, coalesce(s.id, w.id) as id,
  coalesce(1.0::double / (60 + s.rank), 0) + coalesce(1.0::double / (60 + w.rank), 0) as score
  from (select * from near where rank <= {semantic_k}) s full join (select * from {words} where rank <= {lexical_k}) w on w.query_id = s.query_id and w.id = s.id) qualify rank <= 6)"""


_POLICY1 = sql_search("plain", "own", 10).replace("[\\p{L}\\p{N}]+(?:[-_][\\p{L}\\p{N}]+)+", "[\\p{L}\\p{N}]+(?:-[\\p{L}\\p{N}]+)+")
_GRID_NAMES = [f"g{s}_{k}_{p}" for s, k, p in GRID]

SQL = {
    "index_build": f"""with texts as {TEXTS}, {sql_index('texts')}
select 'documents' as what, count(*) as n from {PAGES} union all select 'chunks', count(*) from {CHUNKS} union all select 'vectors', count(*) from {CHUNKS}
union all select 'postings', count(*) from postings union all select 'terms', count(distinct term) from postings union all select 'longest', max(dl) from lengths union all select 'status ok', count(*) from {CHUNKS}""",
    "rechunked_build": f"""select page_id, 0 as start, cast(length(markdown) as integer) as "end" from {PAGES} where length(markdown) > 0""",
    "index_violations": f"""with c as (select chunk_id as id, page_id % 30 as m from {CHUNKS})
select id as key, 'terms_missing' as rule from c where m = 1 union all select id, 'terms_content' from c where m = 2 union all select id, 'terms_repeated' from c where m = 3
union all select 'no-' || id, 'terms_unexpected' from c where m = 4 union all select id, 'no_vector' from c where m = 5 union all select id, 'unit' from c where m = 6""",
    "chunk_output_violations": corpus.SQL["chunk_violations"],
    "snapshot_json": f"select source, page_id, title, updated_at, sha256(markdown) as digest from {PAGES}",
    "strict_json_lines": "select event_id, event_id % 50 > 3 as strict from events",
    "generated_shapes": "select id, cast(substring(id, 2) as bigint) % 9 > 4 and kind is not null and answer is not null as fits from (select distinct id, kind, answer from safety_cases)",
    "chunk_lookup": f"select chunk_id, page_id, ordinal, cast(length(search_text) as integer) as n_chars from {CHUNKS} where chunk_id = (select min(chunk_id) from chunks)",
    "corpus_fingerprint": f"""with r as (select sha256(concat_ws('|', coalesce(source, chr(0)), coalesce(cast(page_id as varchar), chr(0)), coalesce(content_sha256, chr(0)), coalesce(updated_at, chr(0)))) as h from {PAGES})
select count(*) as rows, sha256(concat_ws(':', cast(count(*) as varchar), cast(sum(cast('0x' || substring(h, 1, 15) as hugeint)) as varchar), cast(sum(cast('0x' || substring(h, 16, 15) as hugeint)) as varchar))) as fingerprint from r""",
    "token_count_violations": f"""select * from (select chunk_id, cast(body_tokens as bigint) as stated, len(regexp_extract_all(search_text, '[\\p{{L}}\\p{{M}}\\p{{Nd}}\\p{{Nl}}\\p{{Pc}}]+|[^\\p{{L}}\\p{{M}}\\p{{Nd}}\\p{{Nl}}\\p{{Pc}}\\s\\x{{0b}}\\x{{85}}\\x{{a0}}\\x{{1680}}\\x{{2000}}-\\x{{200a}}\\x{{2028}}\\x{{2029}}\\x{{202f}}\\x{{205f}}\\x{{3000}}]')) as counted from {CHUNKS})
where coalesce(stated <> counted, true)""",
    "chunk_segments": f"""select chunk_id, cast(position - 1 as integer) as position, s.kind as kind, s.start as start, s."end" as "end", s.role as role, s.reason as reason,
  sha256(case when s.kind = 'source' then substring(markdown, s.start + 1, s."end" - s.start) else s.text end) as digest
from (select chunk_id, page_id, unnest(segments) as s, generate_subscripts(segments, 1) as position from {CHUNKS}) c join {PAGES} p on p.page_id = c.page_id""",
    "prompt_messages": f"""select id, sha256(to_json([{{'role': 'system', 'content': 'Answer from the context only.'}}, {{'role': 'user', 'content': cast(to_json({{'question': question,
  'CONTEXT': flatten(list_transform(evidence, lambda e: list_transform(e.spans, lambda s: s.exact_text)))}}) as varchar)}}])) as digest from {ASKED} where len(evidence) > 0""",
    "pair_fingerprints": f"""select id, sha256(to_json([question, s.exact_text])) as fingerprint from (select id, question, unnest(e.spans) as s from (select id, question, unnest(evidence) as e from {ASKED}))""",
    "stop_reasons": """with g as (select *, epoch_us(ts) - lag(epoch_us(ts)) over (partition by user_id order by ts, event_id) as gap, value - first_value(value) over (partition by user_id order by ts, event_id) as growth from events),
r as (select *, case when gap > 345600000000 then 'gap' when growth > 60 then 'growth' end as reason from g)
select user_id, event_id, reason from r where reason is not null qualify row_number() over (partition by user_id order by ts, event_id) = 1""",
    "mode_comparison": f"""{_RANKED}, {_sql_fused("fused", 10, 10)}, {retrieval._hit_sql('hs', 5, 'near')}, {retrieval._hit_sql('hw', 5, 'words')}, {retrieval._hit_sql('hf', 5, 'fused')},
m as (select 'semantic' as mode, * from hs union all select 'lexical', * from hw union all select 'hybrid', * from hf)
select m.mode, count(*) as cases, count(*) filter (where m.hit) as hits, round(count(*) filter (where m.hit) / count(*)::double, 9) as hit_rate,
  count(*) filter (where m.hit and not b.hit) as won, count(*) filter (where not m.hit and b.hit) as lost from m join hs b on b.case_id = m.case_id group by 1""",
    "candidate_grid": f"""{_RANKED}, {_POLICY1}, {', '.join(_sql_fused(n, s, k, 'plain' if p == 1 else 'words') for n, (s, k, p) in zip(_GRID_NAMES, GRID))},
{', '.join(retrieval._hit_sql('h' + n, 5, n) for n in _GRID_NAMES)},
every as ({' union all '.join(f"select {s} as semantic_k, {k} as lexical_k, {p} as literal_policy, case_id, hit from h{n}" for n, (s, k, p) in zip(_GRID_NAMES, GRID))}),
j as (select e.*, b.hit as base, c.previous_question is not null as follows from every e join h{_GRID_NAMES[0]} b on b.case_id = e.case_id join {ASKED} c on c.id = e.case_id),
s as (select semantic_k, lexical_k, literal_policy, count(*) filter (where hit and not follows) as hits, count(*) filter (where hit and follows) as follow_up_hits,
  count(*) filter (where base and not hit) as lost, count(*) filter (where hit and not base) as new from j group by 1, 2, 3)
select *, row_number() over (order by hits desc, (lost > 0)::int, follow_up_hits desc, (literal_policy <> 1)::int, semantic_k + lexical_k, semantic_k, literal_policy) = 1 as chosen from s""",
}
