"""The registered queries of this folder and, where SQL can say it, their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import crosssplit, encoding, leak, mixing, neardup, similar, splitting
from docloom.operators import semantic
from docloom.sources.tables import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases, safety = table(spark, sf_dir, "eval_cases"), table(spark, sf_dir, "safety_cases")
    found = crosssplit.cross_split_overlaps(crosssplit.evaluation_questions(cases, safety), crosssplit.training_questions(cases))
    return (
        found.where("id_eval <> id_train")
        .select(F.least("id_eval", "id_train").alias("id_a"), F.greatest("id_eval", "id_train").alias("id_b"))
        .distinct()
    )


def wiki_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages and chunks as ``(kind, key, text, source)``."""
    pages = table(spark, sf_dir, "wiki_documents")
    chunks = table(spark, sf_dir, "chunks")
    return pages.select(
        F.lit("page").alias("kind"), F.col("page_id").cast("string").alias("key"), F.col("markdown").alias("text"), "source"
    ).union(chunks.select(F.lit("chunk"), "chunk_id", "search_text", "source"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = neardup.near_duplicate_pairs(wiki_items(spark, sf_dir), words=3, threshold=0.5, least_words=8)
    return pairs.select(F.col("kind").alias("item_kind"), "key_a", "key_b")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = splitting.split_oversized(wiki_items(spark, sf_dir), table(spark, sf_dir, "chunk_settings"), with_text=False)
    return pieces.where("piece_no = 0").select("item_kind", "item_key")


def p2_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splitting.split_oversized(wiki_items(spark, sf_dir), table(spark, sf_dir, "chunk_settings"))


def p2_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every cut item with what its pieces hold, counted on their texts."""
    settings = table(spark, sf_dir, "chunk_settings")
    found = splitting.piece_totals(p2_pieces(spark, sf_dir), settings)
    return found.drop("pieces")


def _near(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar.most_similar(table(spark, sf_dir, "chunk_embeddings"), k=5, least=0.85, tables=2, probes=6, levels=2)


def p4_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbours that p4_found's search gives every twentieth chunk against brute force over all vectors, and whether nine of ten are there."""
    asked = F.expr("chunk_id rlike '^[0-9a-f]{8}' and conv(substring(chunk_id, 1, 8), 16, 10) % 20 = 0")
    vectors = semantic.usable_vectors(table(spark, sf_dir, "chunk_embeddings"), "chunk_id", "vector", 128, "embedded_at")
    queries = vectors.where(F.expr("id rlike '^[0-9a-f]{8}' and conv(substring(id, 1, 8), 16, 10) % 20 = 0")).withColumnRenamed("id", "query_id")
    true = semantic.exact_top_k(vectors, queries, 5, 128).where("cosine >= 0.85").select(F.col("query_id").alias("id"), F.col("id").alias("other_id"), F.lit(True).alias("true"))
    got = _near(spark, sf_dir).withColumnRenamed("id", "chunk_id").where(asked).select(F.col("chunk_id").alias("id"), "other_id", F.lit(True).alias("got"))
    both = true.join(got, ["id", "other_id"], "left")
    return both.agg(F.count_distinct("id").alias("asked"), F.count("*").alias("wanted"), (F.count("got") >= 0.9 * F.count("*")).alias("enough"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = _near(spark, sf_dir)
    return near.select(F.least("id", "other_id").alias("chunk_id_a"), F.greatest("id", "other_id").alias("chunk_id_b")).distinct()


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leak.leaked_passages(table(spark, sf_dir, "documents"), table(spark, sf_dir, "heldout_items"))


def p7_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.reached_shares(p7_selection(spark, sf_dir), table(spark, sf_dir, "mix_targets"))


def p7_marginals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.reached_marginals(table(spark, sf_dir, "documents"), p7_selection(spark, sf_dir), table(spark, sf_dir, "mix_targets"))


def p7_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_checks(p7_selection(spark, sf_dir), table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding.garbled_documents(table(spark, sf_dir, "documents")).select("doc_id")


def p8_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding.garbled_documents(table(spark, sf_dir, "documents"))


def p1_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases, safety = table(spark, sf_dir, "eval_cases"), table(spark, sf_dir, "safety_cases")
    held, training = crosssplit.evaluation_questions(cases, safety), crosssplit.training_questions(cases)
    return crosssplit.overlap_report(held, training)


def p4_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Without a lower bound even distant neighbours count, which takes more tables than near ones do.
    near = similar.most_similar(table(spark, sf_dir, "chunk_embeddings"), k=5, tables=3, probes=4)
    return near.select(F.col("id").alias("chunk_id"), F.col("other_id").alias("neighbour_id"), "rank", "cosine")


def p5_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicate_groups(wiki_items(spark, sf_dir))


def p6_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leak.leak_report(p6_found(spark, sf_dir), table(spark, sf_dir, "heldout_items"))


QUERIES = {
    f.__name__: f
    for f in (
        p1_found, p1_report, p2_found, p2_pieces, p2_totals, p4_found, p4_neighbours, p4_recall, p5_found, p5_groups, p6_found, p6_report,
        p7_selection, p7_shares, p7_marginals, p7_checks, p8_found, p8_restored,
    )
}

_WORDS = "regexp_extract_all(lower(nfc_normalize({})), '[\\p{{L}}\\p{{N}}_]+')"
_TOKENS = "len(regexp_extract_all({}, '[\\p{{L}}\\p{{N}}\\p{{M}}_]+|[^\\p{{L}}\\p{{N}}\\p{{M}}_\\s\\x{{0b}}\\x{{1c}}-\\x{{1f}}\\x{{85}}\\x{{a0}}\\x{{1680}}\\x{{2000}}-\\x{{200a}}\\x{{2028}}\\x{{2029}}\\x{{202f}}\\x{{205f}}\\x{{3000}}]'))"


def _runs(key: str, text: str, size: int, table_name: str, least: int) -> str:
    """Distinct (key, run) of ``size`` consecutive words of texts of at least ``least`` words."""
    return f"""(select distinct key, array_to_string(w[i:i + {size - 1}], ' ') as run from
  (select key, w, unnest(range(1, len(w) - {size - 2})) as i from (select {key} as key, {_WORDS.format(text)} as w from {table_name}) where len(w) >= {least}))"""


_PAIRS5 = """select '{kind}' as item_kind, a as key_a, b as key_b from (select x.key as a, y.key as b, count(*) as o from {r} x join {r} y on x.run = y.run and x.key < y.key group by 1, 2) p
  join {r}_n m on m.key = p.a join {r}_n n on n.key = p.b where o >= 0.5 * (m.n + n.n - o)"""

_LEAKS = f"""with d as (select doc_id, {_WORDS.format('text')} as w from documents), i as (select item_id, {_WORDS.format('text')} as w from heldout_items),
sizes as (select distinct least(12, len(w)) as m from i where len(w) > 0),
ir as (select distinct item_id, m, array_to_string(w[k:k + m - 1], ' ') as run from (select item_id, w, least(12, len(w)) as m, unnest(range(1, len(w) - least(12, len(w)) + 2)) as k from i where len(w) > 0)),
dr as (select doc_id, m, array_to_string(w[k:k + m - 1], ' ') as run from (select doc_id, w, m, unnest(range(1, len(w) - m + 2)) as k from d, sizes where len(w) >= m)),
leaks as (select distinct doc_id, item_id from dr join ir using (m, run))"""

_OVERLAPS = f"""with q as (select id, question, lower(trim(split)) as side from eval_cases union select id, question, 'safety' from safety_cases),
t as (select distinct id, side = 'tuning' as training, array_to_string({_WORDS.format('question')}, ' ') as f from q where side in ('tuning', 'holdout', 'safety')),
g as (select distinct id, training, substring(f, i, 5) as g from (select *, unnest(range(1, length(f) - 3)) as i from t where length(f) >= 5)),
n as (select id, training, count(*) as n from g group by 1, 2),
o as (select a.id as x, b.id as y, count(*) as o from g a join g b on a.g = b.g and a.training and not b.training group by 1, 2),
pairs as (select x, y from o join n a on a.id = x and a.training join n b on b.id = y and not b.training where o >= 0.6 * (a.n + b.n - o))"""

SQL = {
    "p1_found": _OVERLAPS + "select distinct least(x, y) as id_a, greatest(x, y) as id_b from pairs where x <> y",
    "p1_report": _OVERLAPS + """,
sides as (select distinct id, case when lower(trim(split)) = 'tuning' then 'tuning' else 'holdout' end as split, coalesce(source_set, 'none') as source_set from eval_cases where lower(trim(split)) in ('tuning', 'holdout')
  union select distinct id, 'safety', coalesce(origin, 'none') from safety_cases),
counts as (select x as id, true as training, count(*) as n from pairs group by 1 union all select y, false, count(*) from pairs group by 1)
select s.split, s.source_set, count(*) as cases, count(c.n) as overlapping, cast(coalesce(sum(c.n), 0) as bigint) as pairs
from sides s left join counts c on c.id = s.id and c.training = (s.split = 'tuning') group by 1, 2""",
    "p2_found": f"""select distinct 'page' as item_kind, cast(page_id as varchar) as item_key from wiki_documents join chunk_settings using (source) where {_TOKENS.format('markdown')} > maximum
union all select distinct 'chunk', chunk_id from chunks join chunk_settings using (source) where {_TOKENS.format('search_text')} > maximum""",
    "p2_totals": f"""with i as (select distinct 'page' as item_kind, cast(page_id as varchar) as item_key, markdown as t, source from wiki_documents union select distinct 'chunk', chunk_id, search_text, source from chunks)
select item_kind, item_key, {_TOKENS.format('t')} as tokens, length(t) as n_chars, true as within, true as shared from i join chunk_settings using (source) where {_TOKENS.format('t')} > maximum""",
    "p4_recall": """with v as (select chunk_id as id, arg_max(vector, embedded_at)::double[] as v from chunk_embeddings where chunk_id is not null and len(vector) = 128
  and len(list_filter(vector, lambda x: not isfinite(x))) = 0 and len(list_filter(vector, lambda x: x <> 0)) > 0 group by 1),
q as (select * from v where regexp_matches(id, '^[0-9a-f]{8}') and cast('0x' || substring(id, 1, 8) as bigint) % 20 = 0),
s as (select q.id, v.id as other, round(list_dot_product(q.v, v.v) / sqrt(list_dot_product(q.v, q.v)) / sqrt(list_dot_product(v.v, v.v)), 9) as c from q join v on v.id <> q.id),
t as (select * from s qualify row_number() over (partition by id order by c desc, other) <= 5)
select count(distinct id) as asked, count(*) as wanted, true as enough from t where c >= 0.85""",
    "p5_groups": f"""with recursive w as (select distinct 'page' as kind, cast(page_id as varchar) as key, {_WORDS.format('markdown')} as w from wiki_documents union select distinct 'chunk', chunk_id, {_WORDS.format('search_text')} from chunks),
r as (select distinct kind, key, array_to_string(w[i:i + 4], ' ') as run from (select kind, key, w, unnest(range(1, len(w) - 3)) as i from w where len(w) >= 5)),
s as (select kind, key, md5(string_agg(run, '|' order by run)) as node, count(*) as n from r group by 1, 2),
nodes as (select kind, node, min(n) as n, min(key) as least, count(*) as copies from s group by 1, 2),
nr as (select distinct s.kind, s.node, r.run from r join s on s.kind = r.kind and s.key = r.key),
o as (select a.kind, a.node as x, b.node as y, count(*) as o from nr a join nr b on a.kind = b.kind and a.run = b.run and a.node < b.node group by 1, 2, 3),
links as (select o.kind, x, y from o join nodes a on a.kind = o.kind and a.node = x join nodes b on b.kind = o.kind and b.node = y where o >= 0.8 * (a.n + b.n - o) - 1e-9),
edges as (select * from links union all select kind, y, x from links),
reach as (select kind, node, node as other from nodes union select reach.kind, reach.node, e.y from reach join edges e on e.kind = reach.kind and e.x = reach.other),
named as (select r.kind, r.node, min(n.least) as group_id from reach r join nodes n on n.kind = r.kind and n.node = r.other group by 1, 2)
select s.kind, s.key, g.group_id, n.copies, coalesce(l.links, 0) as links from s join nodes n on n.kind = s.kind and n.node = s.node join named g on g.kind = s.kind and g.node = s.node
  left join (select kind, x, count(*) as links from edges group by 1, 2) l on l.kind = s.kind and l.x = s.node""",
    "p5_found": f"""with pr as {_runs('cast(page_id as varchar)', 'markdown', 3, 'wiki_documents', 8)}, pr_n as (select key, count(*) as n from pr group by 1),
cr as {_runs('chunk_id', 'search_text', 3, 'chunks', 8)}, cr_n as (select key, count(*) as n from cr group by 1)
{_PAIRS5.format(kind='page', r='pr')} union all {_PAIRS5.format(kind='chunk', r='cr')}""",
    "p6_found": _LEAKS + " select doc_id, item_id from leaks",
    "p7_checks": """with a as (select mix_id, source, sum(target_share) as target, min(max_repeats) as most from mix_targets where mix_id is not null and source is not null group by 1, 2),
c as (select *, case when target > 0 and most > 0 and source in (select source from documents where text <> '') then target else 0 end as counted from a)
select mix_id, source, round(coalesce(counted / sum(counted) over (partition by mix_id), 0), 9) as share, true as close, true as capped from c""",
    "p6_report": _LEAKS + """ select i.item_id, i.kind, i.lang, coalesce(n, 0) as documents from (select distinct item_id, kind, lang from heldout_items) i
  left join (select item_id, count(*) as n from leaks group by 1) l on l.item_id = i.item_id""",
}
