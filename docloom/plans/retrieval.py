"""Retrieval queries: terms, BM25, cosine, fusion, reranking, literals, intervals, evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.functions.text import terms
from docloom.functions.tokens import WORDS
from docloom.operators import evaluation, grounding, hybrid, intervals, lexical, models, semantic, setcover
from docloom.plans.common import (
    ASKED, CASES, CHUNKS, PAGES, QUERY_SHARE, RANGES, SPANS, TEXTS, VECTORS, asked_cases, cases, chunk_fields, chunk_ranges, chunk_vectors, chunks, pages,
    sql_bm25, sql_index, sql_literals, sql_matches, sql_search, sql_terms,
)
from docloom.session import spread
from docloom.sources.tables import table

QUESTIONS = [(1, "archived pallet index of the remote worker pool"), (2, "складской порт и ночной терминал"), (3, "Schlüssel für Einträge und Plätze")]


def documents(spark, sf):
    return table(spark, sf, "documents").dropDuplicates(["doc_id"]).select(F.col("doc_id").alias("id"), "text")


def term_stats(spark, sf):
    one = documents(spark, sf).select("id", F.explode(terms(F.coalesce("text", F.lit("")))).alias("term"))
    counts = one.groupBy("term", "id").agg(F.count("*").alias("tf"))
    return counts.groupBy("term").agg(F.count("*").alias("n_docs"), F.sum("tf").alias("n_total"))


def bm25_topk(spark, sf):
    asked = spark.createDataFrame(QUESTIONS, "query_id long, text string")
    found = lexical.bm25_top_k(lexical.build_index(documents(spark, sf)), asked, 10)
    return found.select("query_id", F.col("id").alias("doc_id"), F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"))


def _case_queries(spark, sf):
    return asked_cases(spark, sf).select(F.col("id").alias("query_id"), F.col("question").alias("text"))


def bm25_batch_topk(spark, sf):
    found = lexical.bm25_top_k(lexical.build_index(chunk_fields(spark, sf)), _case_queries(spark, sf), 10)
    return found.select("query_id", F.col("id").alias("chunk_id"), F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"))


def _embeddings(spark, sf):
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))


def cosine_batch_topk(spark, sf):
    own = _embeddings(spark, sf)
    found = semantic.exact_top_k(own, own.where("id % 20 = 0").withColumnRenamed("id", "query_id"), 10, 64)
    return found.select("query_id", F.col("id").alias("vec_id"), F.col("rank").cast("long").alias("rank"), F.round("cosine", 6).alias("cosine"))


def _hybrid_queries(spark, sf):
    """Every chunk of the pages whose id is divisible by 20: its vector, and its heading path as words."""
    return chunks(spark, sf).where(f"page_id % {QUERY_SHARE} = 0").select(F.col("chunk_id").alias("query_id"), F.array_join("heading_path", " ").alias("text"))


def _branches(spark, sf, semantic_k=10, lexical_k=10):
    """The candidates of both branches: cosine, and the whole keyword search."""
    asked = _hybrid_queries(spark, sf)
    vectors = chunk_vectors(spark, sf)
    near = semantic.exact_top_k(vectors, asked.join(vectors, asked.query_id == vectors.id).select("query_id", "vector"), semantic_k, 128)
    return near, _lexical_search(spark, sf, asked, lexical_k)


def hybrid_topk(spark, sf):
    return _fused_columns(hybrid.fuse(*_branches(spark, sf), k=6))


def _fused_columns(fused):
    return fused.select(
        "query_id", F.col("id").alias("chunk_id"), F.col("rank").cast("long").alias("rank"), F.round("score", 9).alias("score"),
        F.col("semantic_rank").cast("long").alias("semantic_rank"), F.col("lexical_rank").cast("long").alias("lexical_rank"),
    )


def branch_union(spark, sf):
    near, words = _branches(spark, sf)
    return near.select("query_id", "id").union(words.select("query_id", "id")).dropDuplicates(["query_id", "id"]).withColumnRenamed("id", "chunk_id")


def rerank_topk(spark, sf):
    """The union of 120 cosine candidates and the best keyword hit, scored pair by pair and reordered.

    The scorer stands where a trained cross-encoder would: the share of the
    question's distinct terms that the chunk holds.
    """
    asked, texts = _hybrid_queries(spark, sf), chunk_fields(spark, sf)

    def load():
        def score(question: str, text: str) -> float:
            wanted, held = set(question.split("\x1f")) - {""}, set(text.split("\x1f"))
            return round(len(wanted & held) / len(wanted), 9) if wanted else 0.0

        return score

    def joined(column):
        return F.array_join(terms(F.coalesce(column, F.lit(""))), "\x1f")

    union = hybrid.candidate_union(list(_branches(spark, sf, 120, 1)), 121)
    pairs = union.join(asked.select("query_id", joined(F.col("text")).alias("question")), "query_id").join(texts.select("id", joined(F.col("text")).alias("text")), "id")
    scored = models.score_pairs(pairs, "question", "text", load).select("query_id", "id", "score")
    found = hybrid.best_scored(scored, 6)
    return found.select("query_id", F.col("id").alias("chunk_id"), F.col("rank").cast("long").alias("rank"), F.col("score"))


def literal_ips(spark, sf):
    found = lexical.literals(pages(spark, sf).select(F.col("page_id").alias("id"), F.col("markdown").alias("text")))
    return found.where("kind = 'ip'").groupBy("literal").agg(F.count_distinct("id").alias("n_pages"))


def literal_extract(spark, sf):
    return lexical.literals(cases(spark, sf).select("id", F.col("question").alias("text")), underscores=True)


def _literal_matches(spark, sf, queries, underscores=True):
    asked = lexical.literals(queries.select(F.col("query_id").alias("id"), "text"), underscores)
    own = chunks(spark, sf).select(F.col("chunk_id").alias("id"), F.col("page_id").alias("page_key"), F.col("source_ranges").alias("ranges"))
    text = spread(table(spark, sf, "wiki_documents").select(F.col("page_id").alias("page_key"), "markdown"))
    return lexical.literal_matches(own, text, asked.select(F.col("id").alias("query_id"), "literal", "kind").distinct())


def literal_offsets(spark, sf):
    return _literal_matches(spark, sf, _case_queries(spark, sf))


def literal_priority_topk(spark, sf):
    found = _lexical_search(spark, sf, _case_queries(spark, sf))
    return found.select("query_id", "id", F.col("rank").cast("long").alias("rank"), F.col("n_literals"), F.round("score", 6).alias("score"))


def _lexical_search(spark, sf, queries, k=10):
    """The whole keyword search: BM25 over titles, headings and search text, and literal matches of all chunks before it."""
    return lexical.lexical_search(lexical.build_index(chunk_fields(spark, sf)).stored(), queries, _literal_matches(spark, sf, queries), k)


# Intervals: the spans are the evidence of the cases, the ranges those of the chunks.


def _spans(spark, sf):
    return evaluation.evidence_spans(cases(spark, sf)).select("page_id", "start", "end")


def merged_ranges(spark, sf):
    return intervals.merge_ranges(chunk_ranges(spark, sf), ["page_id"])


def interval_cover(spark, sf):
    return intervals.covered_spans(_spans(spark, sf), chunk_ranges(spark, sf), ["page_id"])


def interval_atoms(spark, sf):
    return intervals.atoms(_spans(spark, sf), chunk_ranges(spark, sf), ["page_id"])


def missing_ranges(spark, sf):
    """The parts of every page that no chunk covers."""
    whole = pages(spark, sf).select("page_id", F.lit(0).alias("start"), F.length("markdown").alias("end"))
    return intervals.uncovered(whole, chunk_ranges(spark, sf), ["page_id"]).select("page_id", "start", "end")


def interval_clip(spark, sf):
    spans = _spans(spark, sf).distinct().select("page_id", F.col("start").alias("a"), F.col("end").alias("b"))
    return intervals.clip(chunk_ranges(spark, sf).join(spans, "page_id"), "a", "b").select("id", "page_id", "start", "end").distinct()


# Evaluation: two modes, the question alone and the question with its follow-up protocol.


def _ranked(spark, sf, k, mode="plain"):
    asked = asked_cases(spark, sf)
    if mode == "protocol":
        asked = evaluation.protocol_input(asked, F.lit(True)).withColumn("question", F.col("input"))
    queries = asked.select(F.col("id").alias("query_id"), F.col("question").alias("text"))
    return _lexical_search(spark, sf, queries, k)


def _hits(spark, sf, mode="plain"):
    return evaluation.evidence_hits(asked_cases(spark, sf), _ranked(spark, sf, evaluation.CUT, mode), chunk_ranges(spark, sf))


def followup_input(spark, sf):
    return evaluation.protocol_input(cases(spark, sf), F.lit(True)).select("id", "input")


def evidence_hit_at_5(spark, sf):
    return _hits(spark, sf)


def eval_groups_dense(spark, sf):
    split, part = F.lower(F.trim("split")), F.coalesce("source_set", F.lit("none"))
    own = asked_cases(spark, sf).select(F.col("id").alias("case_id"), split.alias("split"), part.alias("source_set"))
    grouped = evaluation.dense_groups(own.join(_hits(spark, sf), "case_id"), {"source_set": ["live", "synthetic"], "split": ["tuning", "holdout"]})
    return grouped.withColumn("hit_rate", F.round("hit_rate", 9))


def _both_modes(spark, sf):
    return _hits(spark, sf).withColumn("mode", F.lit("plain")).union(_hits(spark, sf, "protocol").withColumn("mode", F.lit("protocol")))


def mode_transitions(spark, sf):
    return evaluation.transitions(_both_modes(spark, sf))


def lost_new_hits(spark, sf):
    """Cases whose evidence is still where it was frozen, judged by the pages' digests before and by the quoted texts now."""
    spans = evaluation.evidence_spans(cases(spark, sf)).join(pages(spark, sf).select("page_id", F.col("content_sha256").alias("sha"), "markdown"), "page_id", "left")
    text = F.substring(F.col("markdown"), F.col("start") + 1, F.col("end") - F.col("start")) == F.col("exact_text")
    odd = F.expr("cast(substring(case_id, 2) as bigint) % 5 = 0")
    judged = spans.groupBy("case_id").agg(F.bool_and(F.coalesce(F.col("content_sha256") == F.col("sha"), F.lit(False))).alias("before"), F.bool_and(F.coalesce(text, F.lit(False)) & ~odd).alias("now"))
    return evaluation.lost_and_new(judged.select("case_id", F.col("before").alias("hit")), judged.select("case_id", F.col("now").alias("hit")))


def loss_kinds(spark, sf):
    """Whether a case's evidence is lost before the candidates (50), in their ranking (5), or found."""
    ranked, ranges, own = _ranked(spark, sf, 50), chunk_ranges(spark, sf), asked_cases(spark, sf)
    spans = evaluation.evidence_spans(own)
    everywhere = intervals.covered_spans(spans.select("case_id", "page_id", "start", "end"), ranges.join(spans.select("case_id", "page_id").distinct(), "page_id"), ["case_id", "page_id"])
    inventory = everywhere.groupBy("case_id").agg(F.bool_and("covered").alias("inventory"))
    union = evaluation.evidence_hits(own, ranked, ranges, 50).withColumnRenamed("hit", "union")
    final = evaluation.evidence_hits(own, ranked, ranges).withColumnRenamed("hit", "final")
    joined = union.join(final, "case_id").join(inventory, "case_id", "left")
    return joined.select("case_id", evaluation.loss_kind(F.coalesce("inventory", F.lit(False)), F.col("union"), F.col("final")).alias("loss"))


def candidate_selection(spark, sf):
    """Of rank cuts 1, 3, 5 and 10: most hits, then the smallest cut."""
    ranked, ranges, own = _ranked(spark, sf, 10), chunk_ranges(spark, sf), asked_cases(spark, sf)
    parts = [evaluation.evidence_hits(own, ranked, ranges, c).agg(F.count_if("hit").alias("hits")).select(F.lit(c).cast("long").alias("cut"), "hits") for c in (1, 3, 5, 10)]
    every = parts[0].union(parts[1]).union(parts[2]).union(parts[3])
    return evaluation.choose(every, order=[F.desc("hits"), F.col("cut")], eligible=F.col("cut") > 0)


def set_cover_min(spark, sf):
    ranges = chunk_ranges(spark, sf)
    spans = evaluation.evidence_spans(cases(spark, sf))
    cut = intervals.atoms(spans.select("case_id", "page_id", "start", "end"), ranges.join(spans.select("case_id", "page_id").distinct(), "page_id"), ["case_id", "page_id"])
    atom = F.concat_ws(":", *(F.col(c).cast("string") for c in ("page_id", "start", "end")))
    inside = cut.join(ranges.withColumnsRenamed({"start": "a", "end": "b"}), "page_id", "left").withColumn("fits", (F.col("a") <= F.col("start")) & (F.col("b") >= F.col("end")))
    options = inside.select("case_id", atom.alias("atom"), F.when(F.col("fits"), F.col("id")).alias("id")).distinct()
    return setcover.minimum_covers(options).select("case_id", "status", "minimum")


def _packed(spark, sf, ranked):
    """The longest part of each ranking whose terms fit the budget."""
    sized = chunk_fields(spark, sf).select("id", F.size(terms(F.col("text"))).cast("long").alias("tokens"))
    return grounding.pack_budget(ranked.join(sized, "id"), 600)


def budget_pack(spark, sf):
    packed = _packed(spark, sf, _ranked(spark, sf, 10))
    return packed.select("query_id", F.col("id").alias("chunk_id"), F.col("rank").cast("long").alias("rank"), "tokens", "used")


def evidence_fragments(spark, sf):
    found = grounding.fragments(chunk_ranges(spark, sf), pages(spark, sf))
    return found.select(F.col("id").alias("chunk_id"), "start", "end", F.sha2(F.encode("text", "utf-8"), 256).alias("digest"))


def prompt_packing(spark, sf):
    """How many of each asked case's evidence texts fit a window of 150 tokens with the question, and what the prompt takes."""
    texts = F.transform("evidence", lambda e: F.struct(e.id.alias("chunk_id"), F.lit("t").alias("title"), F.lit("h").alias("heading"), F.transform(e.spans, lambda s: s.exact_text).alias("fragments")))
    asked = cases(spark, sf).where("size(evidence) > 0 and not question like '%\"%'").select(F.col("id").alias("query_id"), "question", texts.alias("evidence"))
    found = grounding.pack_prompts(asked, "Answer from the context only.", WORDS, 150)
    return found.select("query_id", F.size("packed").alias("packed"), "error")


def manifest_violations(spark, sf):
    """Rankings of chunks in which an id is repeated, is no chunk id, or belongs to a chunk whose ranges its page does not hold."""
    own = chunks(spark, sf).select(F.col("page_id").cast("string").alias("query_id"), F.col("chunk_id").alias("id"), (F.col("page_id") % 40).alias("m"))
    ranked = own.where("m <> 1").select("query_id", "id").union(own.where("m = 2").select("query_id", "id")).union(own.where("m = 1").select("query_id", F.substring("id", 1, 9)))
    spoiled = chunk_ranges(spark, sf).withColumn("end", F.when(F.col("page_id") % 40 == 3, 99_999_999).otherwise(F.col("end")))
    return grounding.manifest_violations(ranked, spoiled, pages(spark, sf))


def answer_validation(spark, sf):
    """The safety cases' answers as generated objects, each against one piece of evidence named by its manifest.

    Seven of sixteen get a fault that must be found, and some questions for clarification a sound form.
    """
    own = table(spark, sf, "safety_cases").dropDuplicates(["id"]).withColumn("m", F.expr("cast(substring(id, 2) as bigint) % 16"))
    name = F.sha2(F.coalesce("manifest", F.lit("")), 256)
    fragment = F.array(F.struct(name.alias("chunk_id"), F.coalesce("manifest", F.lit("")).alias("title"), F.lit("").alias("heading"), F.lit("").alias("url"), F.array("answer").alias("fragments")))
    kind = F.when(F.col("kind") == "refusal", "refuse").when(F.col("kind") == "clarification", "clarify").otherwise(F.col("kind"))
    marked = F.regexp_replace("answer", r"\$[A-Z]\$", F.concat(F.lit("[chunk:"), name, F.lit("]")))
    more = {1: " https://x", 2: " [1]", 3: f" [chunk:{'f' * 64}]", 4: "\n```\nnot there\n```\n", 5: "\n```\nopen", 6: " sudo reboot"}
    text = F.when((F.col("m") == 7) & (kind == "clarify"), F.lit("Which one?"))
    for n, tail in more.items():
        text = text.when(F.col("m") == n, F.concat(marked, F.lit(tail)))
    raw = F.when(F.col("m") == 0, F.lit("{")).otherwise(F.to_json(F.struct(kind.alias("kind"), text.otherwise(marked).alias("answer"))))
    found = grounding.check_answers(own.select("id", raw.alias("raw"), fragment.alias("evidence")))
    return found.select("id", "answer", "insufficient", "n_sources", "error", F.size("sources").alias("listed"))


QUERIES = {
    f.__name__: f
    for f in (
        term_stats, bm25_topk, bm25_batch_topk, cosine_batch_topk, hybrid_topk, branch_union, rerank_topk, literal_ips, literal_extract,
        literal_offsets, literal_priority_topk, merged_ranges, interval_cover, interval_atoms, missing_ranges, interval_clip, followup_input,
        evidence_hit_at_5, eval_groups_dense, mode_transitions, lost_new_hits, loss_kinds, candidate_selection, set_cover_min, budget_pack,
        evidence_fragments, prompt_packing, manifest_violations, answer_validation,
    )
}

_DOCS = "(select doc_id as id, text from documents qualify row_number() over (partition by doc_id order by source) = 1)"
_TEXTS = TEXTS
_ASKED = f"(select id as query_id, question as text from {ASKED})"
_PROTOCOL = f"(select id as query_id, case when previous_question is not null then concat_ws(chr(10), previous_question, question) else question end as text from {ASKED})"
_FIXED = "(select * from (values " + ", ".join(f"({i}, '{t}')" for i, t in QUESTIONS) + ") t(query_id, text))"
_HQ = f"(select chunk_id as query_id, array_to_string(heading_path, ' ') as text from {CHUNKS} where page_id % {QUERY_SHARE} = 0)"

def _sql_branches(semantic_k: int, lexical_k: int) -> str:
    return f"""with hq as {_HQ}, vec as {VECTORS}, texts as {_TEXTS}, {sql_index("texts")}, {sql_search("words", "hq", lexical_k)},
sem as (select hq.query_id, d.id, round(list_dot_product(q.v, d.v) / sqrt(list_dot_product(q.v, q.v)) / sqrt(list_dot_product(d.v, d.v)), 9) as cosine
  from hq join vec q on q.id = hq.query_id join vec d on d.id <> hq.query_id),
semantic as (select *, row_number() over (partition by query_id order by cosine desc, id) as rank from sem qualify rank <= {semantic_k})
"""


_BRANCHES = _sql_branches(10, 10)


def _islands(ranges: str) -> str:
    return f"""marked as (select page_id, s, e, coalesce(s > max(e) over (partition by page_id order by s, e rows between unbounded preceding and 1 preceding), true)::int as fresh from {ranges} where s < e),
islands as (select *, sum(fresh) over (partition by page_id order by s, e rows unbounded preceding) as island from marked),
merged as (select page_id, min(s) as s, max(e) as e from islands group by page_id, island)"""


def _hit_sql(name: str, cut: int, bm25: str = "bm25") -> str:
    """CTE ``name(case_id, hit)``: spans against the merged ranges of the first ``cut`` results."""
    return f"""{name}_r as (select b.query_id as case_id, r.page_id, r.s, r.e from {bm25} b join ranges r on r.id = b.id where b.rank <= {cut} and r.s < r.e),
{name}_m as (select *, coalesce(s > max(e) over (partition by case_id, page_id order by s, e rows between unbounded preceding and 1 preceding), true)::int as fresh from {name}_r),
{name}_i as (select case_id, page_id, min(s) as s, max(e) as e from (select *, sum(fresh) over (partition by case_id, page_id order by s, e rows unbounded preceding) as island from {name}_m) group by case_id, page_id, island),
{name}_s as (select sp.case_id, sp.page_id, sp.s, sp.e, coalesce(bool_or(i.s <= sp.s and i.e >= sp.e), false) as covered from (select distinct case_id, page_id, s, e from spans) sp
  left join {name}_i i on i.case_id = sp.case_id and i.page_id = sp.page_id group by 1, 2, 3, 4),
{name} as (select c.id as case_id, coalesce(h.hit, false) as hit from {ASKED} c left join (select case_id, bool_and(covered) as hit from {name}_s group by 1) h on h.case_id = c.id)"""


_INDEX = f"with texts as {_TEXTS}, ranges as {RANGES}, spans as {SPANS.format(cases=ASKED)}, own as {_ASKED}, {sql_index('texts')}"
_EVAL = f"{_INDEX}, {sql_search('bm25', 'own', 50)}"
_MODES = (
    f"{_INDEX}, other as {_PROTOCOL}, {sql_search('a', 'own', 5)}, {sql_search('b', 'other', 5)}, " + _hit_sql("plain", 5, "a") + ", " + _hit_sql("protocol", 5, "b")
)

SQL = {
    "term_stats": f"with tokens as (select id, unnest({sql_terms(chr(39) + chr(39) + ' || coalesce(text, ' + chr(39) + chr(39) + ')')}) as term from {_DOCS}) select term, count(distinct id) as n_docs, count(*) as n_total from tokens group by 1",
    "bm25_topk": f"with docs as {_DOCS}, fixed as {_FIXED}, {sql_bm25('docs', 'fixed', 10)} select cast(query_id as bigint) as query_id, id as doc_id, rank, round(score, 6) as score from bm25",
    "bm25_batch_topk": f"with texts as {_TEXTS}, {sql_bm25('texts', _ASKED, 10)} select query_id, id as chunk_id, rank, round(score, 6) as score from bm25",
    "cosine_batch_topk": """with e as (select vec_id as id, embedding::double[] as v from embeddings),
s as (select q.id as query_id, d.id, round(list_dot_product(q.v, d.v) / sqrt(list_dot_product(q.v, q.v)) / sqrt(list_dot_product(d.v, d.v)), 9) as c from e q join e d on d.id <> q.id where q.id % 20 = 0)
select query_id, id as vec_id, row_number() over (partition by query_id order by c desc, id) as rank, round(c, 6) as cosine from s qualify rank <= 10""",
    "hybrid_topk": _BRANCHES + """, fused as (select coalesce(s.query_id, b.query_id) as query_id, coalesce(s.id, b.id) as id, s.rank as semantic_rank, b.rank as lexical_rank,
  coalesce(1.0::double / (60 + s.rank), 0) + coalesce(1.0::double / (60 + b.rank), 0) as score from semantic s full join words b on b.query_id = s.query_id and b.id = s.id)
select query_id, id as chunk_id, row_number() over (partition by query_id order by round(score, 12) desc, id) as rank, round(score, 9) as score, semantic_rank, lexical_rank from fused qualify rank <= 6""",
    "branch_union": _BRANCHES + "select query_id, id as chunk_id from semantic union select query_id, id from words",
    "rerank_topk": _sql_branches(120, 1) + f""", u as (select query_id, id from semantic union select query_id, id from words),
wt as (select query_id, list_distinct({sql_terms("text")}) as w from hq), ct as (select id, {sql_terms("coalesce(text, '')")} as c from texts),
s as (select u.query_id, u.id, case when len(w) = 0 then 0.0 else round(len(list_filter(w, lambda x: list_contains(c, x))) / len(w)::double, 9) end as score from u join wt on wt.query_id = u.query_id join ct on ct.id = u.id)
select query_id, id as chunk_id, row_number() over (partition by query_id order by score desc, id) as rank, score from s qualify rank <= 6""",
    "merged_ranges": f"""with ranges as {RANGES}, {_islands('ranges')} select page_id, s as start, e as "end" from merged""",
    "interval_cover": f"""with ranges as {RANGES}, {_islands('ranges')}, spans as {SPANS.format(cases=CASES)}
select sp.page_id, sp.s as start, sp.e as "end", coalesce(bool_or(m.s <= sp.s and m.e >= sp.e), false) as covered
from (select distinct page_id, s, e from spans) sp left join merged m on m.page_id = sp.page_id group by 1, 2, 3""",
    "interval_atoms": f"""with ranges as {RANGES}, spans as (select distinct page_id, s, e from {SPANS.format(cases=CASES)} where s < e),
points as (select distinct page_id, unnest([s, e]) as p from ranges),
cuts as (select sp.*, p from spans sp join points using (page_id) where p > s and p < e union select *, s from spans union select *, e from spans)
select page_id, s as span_start, e as span_end, p as start, n as "end" from (select *, lead(p) over (partition by page_id, s, e order by p) as n from cuts) where n is not null""",
    "missing_ranges": f"""with ranges as {RANGES}, {_islands('ranges')}, pages as (select page_id, length(markdown) as n from {PAGES} where length(markdown) > 0),
stops as (select p.page_id, m.s, m.e from pages p join merged m on m.page_id = p.page_id where m.s < p.n and m.e > 0 union all select page_id, n, n from pages),
gaps as (select page_id, coalesce(lag(e) over (partition by page_id order by s, e), 0) as g, s from stops)
select page_id, cast(g as integer) as start, cast(s as integer) as "end" from gaps where g < s""",
    "interval_clip": f"""with ranges as {RANGES}, spans as (select distinct page_id, s, e from {SPANS.format(cases=CASES)})
select distinct r.id, r.page_id, greatest(r.s, sp.s) as start, least(r.e, sp.e) as "end" from ranges r join spans sp on sp.page_id = r.page_id where greatest(r.s, sp.s) < least(r.e, sp.e)""",
    "literal_ips": f"""with src as (select page_id as id, markdown as text from {PAGES}), {sql_literals("found", "src")}
select literal, count(distinct id) as n_pages from found where kind = 'ip' group by 1""",
    "literal_extract": f"with src as (select id, question as text from {CASES}), {sql_literals('found', 'src')} select * from found",
    "literal_offsets": f"with own as {_ASKED}, {sql_matches('found', 'own')} select * from found",
    "literal_priority_topk": f"""with texts as {_TEXTS}, own as {_ASKED}, {sql_index('texts')}, {sql_search('found', 'own', 10)}
select query_id, id, rank, n_literals, round(score, 6) as score from found""",
    "followup_input": f"select id, case when previous_question is not null then concat_ws(chr(10), previous_question, question) else question end as input from {CASES}",
    "evidence_hit_at_5": f"{_EVAL}, {_hit_sql('final', 5)} select case_id, hit from final",
    "eval_groups_dense": f"""{_EVAL}, {_hit_sql('final', 5)},
g as (select a as source_set, b as split from (values ('live'), ('synthetic')) x(a), (values ('tuning'), ('holdout')) y(b)),
c as (select coalesce(source_set, 'none') as source_set, lower(trim(split)) as split, hit from {ASKED} c join final f on f.case_id = c.id)
select g.source_set, g.split, count(c.hit) as n, count(*) filter (where c.hit) as hits, count(*) filter (where not c.hit) as misses,
  round(case when count(c.hit) > 0 then count(*) filter (where c.hit) / count(c.hit)::double end, 9) as hit_rate
from g left join c on c.source_set = g.source_set and c.split = g.split group by 1, 2""",
    "mode_transitions": f"{_MODES} select 'plain' as mode_a, 'protocol' as mode_b, a.hit as hit_a, b.hit as hit_b, count(*) as n from plain a join protocol b on b.case_id = a.case_id group by 3, 4",
    "lost_new_hits": f"""with j as (select s.case_id, bool_and(coalesce(s.content_sha256 = p.content_sha256, false)) as a,
  bool_and(coalesce(substring(p.markdown, s.s + 1, s.e - s.s) = s.exact_text, false) and cast(substring(s.case_id, 2) as bigint) % 5 <> 0) as b
  from {SPANS.format(cases=CASES)} s left join {PAGES} p on p.page_id = s.page_id group by 1) select case_id, case when a then 'lost' else 'new' end as change from j where a <> b""",
    "loss_kinds": f"""{_EVAL}, {_hit_sql('wide', 50)}, {_hit_sql('final', 5)}, {_islands('ranges')},
inv as (select case_id, bool_and(covered) as ok from (select sp.case_id, sp.page_id, sp.s, sp.e, coalesce(bool_or(m.s <= sp.s and m.e >= sp.e), false) as covered
  from (select distinct case_id, page_id, s, e from spans) sp left join merged m on m.page_id = sp.page_id group by 1, 2, 3, 4) group by 1)
select w.case_id, case when not coalesce(i.ok, false) then 'impossible' when not w.hit then 'candidate_loss' when not f.hit then 'ranking_loss' else 'found' end as loss
from wide w join final f on f.case_id = w.case_id left join inv i on i.case_id = w.case_id""",
    "candidate_selection": f"""{_EVAL}, {', '.join(_hit_sql(f'h{c}', c) for c in (1, 3, 5, 10))},
every as ({' union all '.join(f'select cast({c} as bigint) as cut, count(*) filter (where hit) as hits from h{c}' for c in (1, 3, 5, 10))}) select * from every order by hits desc, cut limit 1""",
    "set_cover_min": f"""with recursive ranges as {RANGES}, spans as (select distinct case_id, page_id, s, e from {SPANS.format(cases=CASES)} where s < e),
points as (select distinct page_id, unnest([s, e]) as p from ranges),
cuts as (select sp.*, p from spans sp join points using (page_id) where p > s and p < e union select *, s from spans union select *, e from spans),
atoms as (select case_id, page_id, s, e, p as a, n as b, dense_rank() over (partition by case_id order by page_id, p, n) as k from (select *, lead(p) over (partition by case_id, page_id, s, e order by p) as n from cuts) where n is not null),
need as (select case_id, list_sort(list_distinct(list(k))) as every from atoms group by 1),
options as (select o.case_id, list_sort(list_distinct(list(k))) as held from atoms o join ranges r on r.page_id = o.page_id and r.s <= o.a and r.e >= o.b group by o.case_id, r.id),
reach as (select case_id, list_distinct(flatten(list(held))) as can from options group by 1),
walk as (select case_id, 0 as n, every as missing from need
  union select w.case_id, w.n + 1, list_filter(w.missing, lambda x: not list_contains(o.held, x)) from walk w join options o on o.case_id = w.case_id and list_contains(o.held, w.missing[1]) where len(w.missing) > 0 and w.n < 12)
select n.case_id, case when len(list_filter(every, lambda x: not list_contains(coalesce(can, []), x))) > 0 then 'impossible' else 'exact' end as status,
  case when len(list_filter(every, lambda x: not list_contains(coalesce(can, []), x))) = 0 then (select min(w.n) from walk w where w.case_id = n.case_id and len(w.missing) = 0) end as minimum
from need n left join reach r on r.case_id = n.case_id""",
    "budget_pack": f"""with texts as {_TEXTS}, own as {_ASKED}, {sql_index('texts')}, {sql_search('bm25', 'own', 10)},
r as (select b.query_id, b.id as chunk_id, b.rank, l.dl as tokens, sum(l.dl) over (partition by b.query_id order by b.rank rows unbounded preceding) as used from bm25 b join lengths l on l.id = b.id)
select query_id, chunk_id, rank, tokens, cast(used as bigint) as used from r where used <= 600""",
    "prompt_packing": f"""with c as (select id, question, evidence from {CASES} where len(evidence) > 0 and question not like '%"%'),
s as (select id, n, 2 + len(regexp_extract_all(cast(to_json([{{'role': 'system', 'content': 'Answer from the context only.'}}, {{'role': 'user', 'content': cast(to_json({{'question': question,
  'CONTEXT': list_transform(evidence[1:n], lambda e: {{'id': e.id, 'title': 't', 'heading': 'h', 'fragments': list_transform(e.spans, lambda s: s.exact_text)}})}}) as varchar)}}]) as varchar),
  '[\\p{{L}}\\p{{N}}_]+|[^\\p{{L}}\\p{{N}}_\\s\\x{{0b}}\\x{{1c}}-\\x{{1f}}\\x{{85}}\\x{{a0}}\\x{{1680}}\\x{{2000}}-\\x{{200a}}\\x{{2028}}\\x{{2029}}\\x{{202f}}\\x{{205f}}\\x{{3000}}]')) as size
  from (select c.*, unnest(range(0, len(evidence) + 1)) as n from c))
select id as query_id, cast(coalesce(max(n) filter (where size <= 150), 0) as integer) as packed, case when count(*) filter (where size <= 150) = 0 then 'question_budget' end as error from s group by 1""",
    "manifest_violations": f"""with c as (select cast(page_id as varchar) as q, chunk_id as id, page_id % 40 as m, page_id, source_ranges from {CHUNKS}),
bad as (select id from c left join {PAGES} p on p.page_id = c.page_id where m = 3 or coalesce(len(source_ranges), 0) = 0 or len(list_filter(source_ranges, lambda r: not coalesce(r.start >= 0 and r.start < r."end" and r."end" <= length(p.markdown), false))) > 0)
select q as query_id, id, 'identity' as rule from c where m = 2 union all select distinct q, substring(id, 1, 9), 'identity' from c where m = 1
union all select distinct q, substring(id, 1, 9), 'ranges' from c where m = 1 union all select distinct q, id, 'ranges' from c where m <> 1 and id in (select id from bad)""",
    "answer_validation": f"""with c as (select distinct id, kind, answer, cast(substring(id, 2) as bigint) % 16 as m, regexp_matches(answer, '\\$[A-Z]\\$') as cites from safety_cases),
r as (select *, case when m = 0 then 'generated_json' when m = 4 then 'code_source' when m = 5 then 'code_fence' when m = 1 then 'generated_source_link' when m = 2 then 'citation_marker' when m = 3 then 'citation_unknown'
  when kind = 'answer' and not cites then 'citation_missing' when kind = 'refusal' then null when m = 6 then 'code_prose' when kind = 'clarification' and m <> 7 then 'clarify_format' end as error from c)
select id, case when error is not null then '{grounding.FALLBACK}' when kind = 'refusal' then '{grounding.REFUSAL}' when kind = 'clarification' then 'Which one?' else regexp_replace(answer, '\\$[A-Z]\\$', '[1]', 'g') end as answer,
  error is not null or kind <> 'answer' as insufficient, case when error is not null or kind = 'answer' then 1 else 0 end as n_sources, error, case when error is not null or kind = 'answer' then 1 else 0 end as listed from r""",
    "evidence_fragments": f"""with ranges as {RANGES}, marked as (select id, page_id, s, e, coalesce(s > max(e) over (partition by id, page_id order by s, e rows between unbounded preceding and 1 preceding), true)::int as fresh from ranges where s < e),
m as (select id, page_id, min(s) as s, max(e) as e from (select *, sum(fresh) over (partition by id, page_id order by s, e rows unbounded preceding) as island from marked) group by id, page_id, island)
select m.id as chunk_id, m.s as start, m.e as "end", sha256(substring(p.markdown, m.s + 1, m.e - m.s)) as digest from m join {PAGES} p on p.page_id = m.page_id where m.s >= 0 and m.e <= length(p.markdown)""",
}
