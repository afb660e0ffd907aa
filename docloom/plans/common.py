"""Inputs that several registered queries share, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions.text import latin_folding
from docloom.functions.vectors import is_usable
from docloom.operators import semantic
from docloom.session import remembered, spread
from docloom.sources.tables import table

DIM = 128
QUERY_SHARE = 20


def _split(spark: SparkSession, sf: str, name: str, key: str) -> tuple[DataFrame, DataFrame]:
    """The rows of a table whose key stands once, and the rows of repeated keys.

    Only keys are counted, so the rows that stand once are never shuffled.
    """
    rows = table(spark, sf, name)
    repeated = remembered(spark, ("repeated", sf, name, key), lambda: rows.groupBy(key).count().where("count > 1").select(key))
    return spread(rows).join(repeated, key, "left_anti"), rows.join(repeated, key, "left_semi")


def _once(spark: SparkSession, sf: str, name: str, key: str) -> DataFrame:
    alone, copies = _split(spark, sf, name, key)
    return alone.unionByName(copies.dropDuplicates([key]))


def pages(spark: SparkSession, sf: str) -> DataFrame:
    """One row per page: redelivered rows are full copies."""
    return _once(spark, sf, "wiki_documents", "page_id")


def chunks(spark: SparkSession, sf: str) -> DataFrame:
    return _once(spark, sf, "chunks", "chunk_id")


def cases(spark: SparkSession, sf: str) -> DataFrame:
    return _once(spark, sf, "eval_cases", "id")


def asked_cases(spark: SparkSession, sf: str) -> DataFrame:
    """The query set of searches: every case whose number is divisible by 20."""
    return cases(spark, sf).where(F.expr(f"cast(substring(id, 2) as bigint) % {QUERY_SHARE} = 0"))


def chunk_fields(spark: SparkSession, sf: str) -> DataFrame:
    """``(id, text)`` of everything a keyword search reads of a chunk: its page's title, its heading path, its search text."""
    titles = pages(spark, sf).select("page_id", "title")
    text = F.concat_ws("\n", "title", F.array_join("heading_path", " > "), "search_text")
    return chunks(spark, sf).join(titles, "page_id", "left").select(F.col("chunk_id").alias("id"), text.alias("text"))


def chunk_vectors(spark: SparkSession, sf: str) -> DataFrame:
    alone, versions = _split(spark, sf, "chunk_embeddings", "chunk_id")
    one = alone.where(F.col("chunk_id").isNotNull() & is_usable(F.col("vector"), DIM)).select(F.col("chunk_id").alias("id"), "vector")
    return one.union(semantic.usable_vectors(versions, "chunk_id", "vector", DIM, "embedded_at"))


def chunk_ranges(spark: SparkSession, sf: str) -> DataFrame:
    """``(id, page_id, start, end)`` of the source ranges of every chunk."""
    return chunks(spark, sf).select(F.col("chunk_id").alias("id"), "page_id", F.explode("source_ranges").alias("r")).select("id", "page_id", "r.start", "r.end")


PAGES = "(select * from wiki_documents qualify row_number() over (partition by page_id order by source) = 1)"
CHUNKS = "(select * from chunks qualify row_number() over (partition by chunk_id order by source) = 1)"
CASES = "(select * from eval_cases qualify row_number() over (partition by id order by split) = 1)"
ASKED = f"(select * from {CASES} where cast(substring(id, 2) as bigint) % {QUERY_SHARE} = 0)"
RANGES = f"(select id, page_id, r.start as s, r.\"end\" as e from (select chunk_id as id, page_id, unnest(source_ranges) as r from {CHUNKS}))"
VECTORS = f"""(select chunk_id as id, arg_max(vector, embedded_at)::double[] as v from chunk_embeddings
  where chunk_id is not null and len(vector) = {DIM} and len(list_filter(vector, lambda x: not isfinite(x))) = 0
    and len(list_filter(vector, lambda x: x <> 0)) > 0 group by 1)"""
SPANS = """(select case_id, page_id, content_sha256, s.start as s, s."end" as e, s.exact_text as exact_text from
  (select case_id, ev.page_id as page_id, ev.content_sha256 as content_sha256, unnest(ev.spans) as s from
    (select id as case_id, unnest(evidence) as ev from {cases})))"""


def sql_terms(text: str) -> str:
    source, target = latin_folding()
    return f"regexp_extract_all(translate(regexp_replace(lower({text}), '[\\x{{0300}}-\\x{{036f}}]', '', 'g'), '{source}', '{target}'), '[\\p{{L}}\\p{{N}}\\p{{Co}}]+')"


# Titles, heading paths and search texts: what a keyword search reads of a chunk (see chunk_fields).
TEXTS = f"""(select c.chunk_id as id, concat_ws(chr(10), p.title, array_to_string(c.heading_path, ' > '), c.search_text) as text
  from {CHUNKS} c left join (select page_id, title from {PAGES}) p on p.page_id = c.page_id)"""


def sql_index(corpus: str) -> str:
    """CTEs ``tokens, postings, lengths, stats, idfs`` of a corpus (id, text)."""
    return f"""
tokens as (select id, unnest({sql_terms("coalesce(text, '')")}) as term from {corpus}),
postings as (select term, id, count(*) as tf from tokens group by 1, 2),
lengths as (select c.id, coalesce(t.dl, 0) as dl from {corpus} c left join (select id, count(*) as dl from tokens group by 1) t on t.id = c.id),
stats as (select count(*) as n, avg(dl) as avgdl from lengths),
idfs as (select term, case when ln((n - df + 0.5) / (df + 0.5)) > 0 then ln((n - df + 0.5) / (df + 0.5)) else 1e-6 end as idf
  from (select term, count(*) as df from postings group by 1), stats)"""


def sql_scores(name: str, queries: str) -> str:
    """CTE ``{name}_scores(query_id, id, score)`` over the CTEs of sql_index; queries (query_id, text)."""
    return f"""
{name}_asked as (select distinct query_id, unnest({sql_terms('text')}) as term from {queries}),
{name}_scores as (select query_id, p.id, -sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) as score
  from {name}_asked a join postings p on p.term = a.term join idfs i on i.term = a.term join lengths l on l.id = p.id, stats group by 1, 2)"""


def sql_bm25(corpus: str, queries: str, k: int) -> str:
    """CTEs up to ``bm25(query_id, id, score, rank)``; corpus (id, text), queries (query_id, text)."""
    return f"""{sql_index(corpus)}, {sql_scores("bm25", queries)},
bm25 as (select *, row_number() over (partition by query_id order by round(score, 9), id) as rank from bm25_scores qualify rank <= {k})"""


_W, _CUT = r"\p{L}\p{N}_", r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}`\"''<>|,;!?()\[\]{}]"
_HEX = "[0-9A-Fa-f]{1,4}"


def _pieces(name: str, source: str, column: str, separator: str) -> str:
    """CTE ``name``: the parts of a text column between single separators, with their place ``pos`` (from 0) in ``source``'s text."""
    return f"""{name}_raw as (select id, base, unnest(string_split_regex({column}, '{separator}')) as w, generate_subscripts(string_split_regex({column}, '{separator}'), 1) as i from {source}),
{name} as (select id, w, base + coalesce(sum(length(w) + 1) over (partition by id, base order by i rows between unbounded preceding and 1 preceding), 0) as pos from {name}_raw)"""


def sql_literals(name: str, source: str) -> str:
    """CTE ``name(id, literal, kind, start, end)`` of the literals (names with underscores too) of ``source`` (id, text).

    Without look-around: texts are cut at the signs no path holds, then what stands
    before a part's path into names and addresses. Back-quoted spans of other
    kinds, addresses that overlap a name, and IPv6 zones are left out: the tables' questions have none.
    """
    return f"""{name}_in as (select id, text, 0 as base from {source}),
{_pieces(f"{name}_runs", f"{name}_in", "text", _CUT)},
{name}_tails as (select id, w, pos, regexp_extract(w, '^(?:.*?[^{_W}:/\\\\])??((?:[A-Za-z]:[\\\\/]|\\\\\\\\|\\.{{1,2}}/|/|[{_W}.-]+/).+)$', 1) as tail from {name}_runs),
{name}_heads as (select id, pos as base, substring(w, 1, length(w) - length(tail)) as head from {name}_tails),
{_pieces(f"{name}_names", f"{name}_heads", "head", f"[^{_W}-]")},
{_pieces(f"{name}_v4", f"{name}_heads", "head", f"[^{_W}.:]")},
{_pieces(f"{name}_v6", f"{name}_heads", "head", f"[^{_W}.:%]")},
{name}_found as (select id, rtrim(tail, '.:') as literal, 'path' as kind, pos + length(w) - length(tail) as start from {name}_tails where tail <> ''
union all select id, w, 'identifier', pos from {name}_names where regexp_full_match(w, '[\\p{{L}}\\p{{N}}]+(?:[-_][\\p{{L}}\\p{{N}}]+)+')
union all select * from (select id, regexp_extract(w, '^([0-9]{{1,3}}(?:\\.[0-9]{{1,3}}){{3}})(?:[^{_W}:]|$)', 1) as literal, 'ip', pos from {name}_v4)
  where literal <> '' and len(list_filter(string_split(literal, '.'), lambda x: cast(x as integer) > 255 or (len(x) > 1 and x[1] = '0'))) = 0
union all select * from (select id, rtrim(regexp_extract(w, '^([0-9A-Fa-f]*:[0-9A-Fa-f:.%]+)(?:[^{_W}:]|$)', 1), '.') as literal, 'ip', pos from {name}_v6)
  where regexp_full_match(literal, '(?:{_HEX}:){{7}}{_HEX}') or (len(regexp_extract_all(literal, '[0-9A-Fa-f]+')) <= 7
    and regexp_full_match(literal, '(?:{_HEX}(?::{_HEX})*)?::(?:{_HEX}(?::{_HEX})*)?'))),
{name} as (select id, literal, kind, cast(start as integer) as start, cast(start + length(literal) as integer) as "end" from {name}_found)"""


def sql_matches(name: str, queries: str) -> str:
    """CTE ``name(query_id, id, literal, kind, start, end)``: whole literals of questions inside the merged ranges of chunks."""
    joins = {"ip": f"[{_W}:%]", "path": f"[{_W}/\\\\~:+%@-]", "identifier": f"[{_W}-]"}

    def runs_on(near: str, beyond: str) -> str:
        sign = "case kind " + " ".join(f"when '{k}' then regexp_matches({near}, '{p}')" for k, p in joins.items()) + " else false end"
        return f"({sign} or (kind <> 'quoted' and {near} = '.' and regexp_matches({beyond}, '[{_W}.]')))"

    return f"""{name}_q as (select query_id as id, text from {queries}), {sql_literals(f"{name}_l", f"{name}_q")},
{name}_w as (select distinct literal, kind from {name}_l),
{name}_parts as (select page_id, literal, kind, markdown, unnest(string_split(markdown, literal)) as part, generate_subscripts(string_split(markdown, literal), 1) as i
  from {PAGES} p join {name}_w w on contains(p.markdown, w.literal)),
{name}_at as (select page_id, literal, kind, markdown, i,
  cast(sum(length(part)) over (partition by page_id, literal, kind order by i rows between unbounded preceding and 1 preceding) as bigint) + (i - 2) * length(literal) as s from {name}_parts),
{name}_near as (select page_id, literal, kind, cast(s as integer) as s, cast(s + length(literal) as integer) as e,
  case when s >= 1 then markdown[s] else '' end as a1, case when s >= 2 then markdown[s - 1] else '' end as a2,
  substring(markdown, s + length(literal) + 1, 1) as b1, substring(markdown, s + length(literal) + 2, 1) as b2 from {name}_at where i > 1),
{name}_hits as (select page_id, literal, kind, s, e from {name}_near where not {runs_on("a1", "a2")} and not {runs_on("b1", "b2")}),
{name}_marked as (select id, page_id, s, e, coalesce(s > max(e) over (partition by id order by s, e rows between unbounded preceding and 1 preceding), true)::int as fresh from {RANGES} where s < e),
{name}_merged as (select id, page_id, min(s) as a, max(e) as b from (select *, sum(fresh) over (partition by id order by s, e rows unbounded preceding) as island from {name}_marked) group by id, page_id, island),
{name} as (select distinct q.query_id, m.id, h.literal, h.kind, h.s as start, h.e as "end" from {name}_hits h join {name}_merged m on m.page_id = h.page_id and h.s >= m.a and h.e <= m.b
  join (select distinct id as query_id, literal, kind from {name}_l) q on q.literal = h.literal and q.kind = h.kind)"""


def sql_search(name: str, queries: str, k: int) -> str:
    """CTE ``name(query_id, id, n_literals, score, rank)`` of the whole keyword search, over the CTEs of sql_index."""
    return f"""{sql_scores(name, queries)}, {sql_matches(f"{name}_m", queries)},
{name}_counts as (select query_id, id, count(distinct literal) as n from {name}_m group by 1, 2),
{name} as (select *, row_number() over (partition by query_id order by n_literals desc, score is null, round(score, 9), id) as rank
  from (select coalesce(s.query_id, c.query_id) as query_id, coalesce(s.id, c.id) as id, coalesce(c.n, 0) as n_literals, s.score
    from {name}_scores s full join {name}_counts c on c.query_id = s.query_id and c.id = s.id) qualify rank <= {k})"""
