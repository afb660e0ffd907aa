import datetime as dt
import math
import sqlite3

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.functions import literals, vectors
from docloom.functions.text import latin_folding, percent_encoded, terms, utc_instant
from docloom.operators import hybrid, lexical, semantic
from docloom.operators.topk import Best
from docloom.plans import common, retrieval

from . import oracle

TEXTS = [("a", "Alpha beta beta"), ("b", "alpha gamma"), ("c", "gamma gamma delta"), ("d", "Café au lait, naïve"), ("e", ""), ("f", None), ("g", "alpha gamma"), ("h", "no match here at all")]


def index(spark):
    return lexical.build_index(spark.createDataFrame(TEXTS, "id string, text string"))


def queries(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "query_id long, text string")


def test_bm25_agrees_with_sqlite(spark):
    con = sqlite3.connect(":memory:")
    con.execute("create virtual table f using fts5(id unindexed, text, tokenize='unicode61')")
    con.executemany("insert into f values (?, ?)", [(i, t or "") for i, t in TEXTS])
    for text in ("alpha", "gamma delta", "cafe alpha beta"):
        want = {r[0]: r[1] for r in con.execute("select id, bm25(f, 0.0, 1.0) from f where f match ?", (" OR ".join(text.split()),))}
        got = {r.id: r.score for r in lexical.bm25_scores(index(spark), queries(spark, text)).collect()}
        assert got.keys() == want.keys()
        assert all(math.isclose(got[i], want[i], abs_tol=1e-12) for i in want)


def test_a_chunks_title_and_headings_are_indexed(spark, tmp_path):
    pages = [(1, "Pallet atlas"), (2, None), (3, "Other")]
    rows = [("a", 1, "s", ["Rack", "Night dock"], "alpha beta"), ("b", 2, "s", [], "beta pallet pallet"), ("c", 3, "s", None, "gamma"), ("d", 9, "s", ["Dock"], None)]
    spark.createDataFrame(pages, "page_id long, title string").write.parquet(f"{tmp_path}/wiki_documents.parquet")
    spark.createDataFrame(rows, "chunk_id string, page_id long, source string, heading_path array<string>, search_text string").write.parquet(f"{tmp_path}/chunks.parquet")
    con = sqlite3.connect(":memory:")
    con.execute("create virtual table f using fts5(id unindexed, title, headings, text, tokenize='unicode61')")
    con.executemany("insert into f values (?, ?, ?, ?)", [(i, dict(pages).get(p) or "", " > ".join(h or []), t or "") for i, p, _, h, t in rows])
    own = lexical.build_index(common.chunk_fields(spark, str(tmp_path)))
    for text in ("pallet", "dock beta", "gamma other"):
        want = {r[0]: r[1] for r in con.execute("select id, bm25(f, 0.0, 1.0, 1.0, 1.0) from f where f match ?", (" OR ".join(text.split()),))}
        got = {r.id: r.score for r in lexical.bm25_scores(own, queries(spark, text)).collect()}
        assert got.keys() == want.keys() and all(math.isclose(got[i], want[i], abs_tol=1e-12) for i in want)


@pytest.mark.skipif(not oracle.DATA.exists(), reason="the tables are not on this machine")
def test_literal_priority_topk_finds_words_of_titles(spark, monkeypatch):
    indexed, build = [], lexical.build_index
    monkeypatch.setattr(lexical, "build_index", lambda texts: indexed.append(texts) or build(texts))
    retrieval.literal_priority_topk(spark, str(oracle.DATA))
    row = common.chunks(spark, str(oracle.DATA)).join(common.pages(spark, str(oracle.DATA)).select("page_id", "title"), "page_id").where("title <> ''").first()
    text = indexed[0].where(F.col("id") == row.chunk_id).first().text
    assert row.title in text and " > ".join(row.heading_path or []) in text and row.search_text in text


def test_fused_search_has_literal_hits_that_keywords_miss(spark, tmp_path):
    asked = ("q", 20, "s", 0, ["see /etc/app.conf"], "", [(0, 1)])
    second = ("q2", 20, "s", 1, ["see"], "", [(0, 1)])
    many = [(f"k{i:02d}", 1, "s", i, [], "see etc app conf", [(0, 1)]) for i in range(12)]
    rows = [asked, second, ("z", 2, "s", 0, [], "unrelated words", [(0, 30)]), *many]
    schema = "chunk_id string, page_id long, source string, ordinal int, heading_path array<string>, search_text string, source_ranges array<struct<start int, end int>>"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/chunks.parquet")
    pages = [(1, "s", "Many", "x"), (2, "s", "One", "the file /etc/app.conf is here"), (20, "s", "Asking", "y")]
    spark.createDataFrame(pages, "page_id long, source string, title string, markdown string").write.parquet(f"{tmp_path}/wiki_documents.parquet")
    rng = np.random.default_rng(1)
    vectors = [(r[0], rng.normal(size=128).tolist(), dt.datetime(2026, 1, 1)) for r in rows]
    spark.createDataFrame(vectors, "chunk_id string, vector array<float>, embedded_at timestamp").write.parquet(f"{tmp_path}/chunk_embeddings.parquet")
    got = {(r.query_id, r.chunk_id): r for r in retrieval.hybrid_topk(spark, str(tmp_path)).collect()}
    assert got["q", "z"].lexical_rank == 1 and {q for q, _ in got} == {"q", "q2"}
    assert all(r.id != "z" for r in lexical.bm25_top_k(lexical.build_index(common.chunk_fields(spark, str(tmp_path))), retrieval._hybrid_queries(spark, str(tmp_path))).collect())


def test_the_scan_equals_the_full_listing(spark, monkeypatch):
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(30)]
    texts = [(f"d{i:03d}", " ".join(rng.choice(words, rng.integers(0, 12)))) for i in range(400)] + [("none", None), ("blank", "")]
    own = lexical.build_index(spark.createDataFrame(texts, "id string, text string").repartition(3))
    asked = queries(spark, *(" ".join(rng.choice(words, 4)) for _ in range(9)), "nothing", "")
    want = sorted((r.query_id, r["rank"], r.id, round(r.score, 9)) for r in lexical.top_k(lexical.bm25_scores(own, asked), 7, F.round("score", 9), F.col("id")).collect())
    for per_pass, rows in ((2000, 1024), (2, 50)):
        monkeypatch.setattr(lexical, "QUERIES_PER_PASS", per_pass)
        monkeypatch.setattr(lexical, "SLICE", rows)
        got = sorted((r.query_id, r["rank"], r.id, round(r.score, 9)) for r in lexical.bm25_top_k(own, asked, 7).collect())
        assert got == want and len(got) == 63
    assert lexical.bm25_top_k(lexical.build_index(spark.createDataFrame([], "id string, text string")), asked, 7).count() == 0


def test_keyword_search_equals_scores_of_all_pairs(spark):
    texts = [(f"d{i}", f"alpha{' beta' * (i % 3)} number w{i}") for i in range(40)]
    own, asked = lexical.build_index(spark.createDataFrame(texts, "id string, text string")), queries(spark, "alpha beta", "w7 w8", "zzz")
    hits = [(q, i, x, "path", 0, 1) for q, i, x in ((0, "d0", "a"), (0, "d3", "a"), (0, "d3", "b"), (2, "d5", "c"), (1, "d7", "a"))]
    matches = spark.createDataFrame(hits, "query_id long, id string, literal string, kind string, start int, end int")
    want = lexical.literal_priority(lexical.bm25_scores(own, asked), matches, 5)
    got = lexical.lexical_search(own, asked, matches, 5)

    def rows(df):
        return sorted((r.query_id, r["rank"], r.id, r.n_literals, r.score and round(r.score, 6)) for r in df.collect())

    assert rows(got) == rows(want) and rows(got)[0][2:4] == ("d3", 2)


def test_best_rows_of_slices_are_the_best_rows():
    rng = np.random.default_rng(0)
    scores, ids = np.round(rng.random((6, 500)), 1), rng.permutation(500)
    best = Best(6, 9)
    for lo in range(0, 500, 37):
        best.add(scores[:, lo : lo + 37], ids[lo : lo + 37], scores[:, lo : lo + 37] > 0.2)
    query, score, found = best.result()
    for q in range(6):
        order = [i for i in np.lexsort((ids, -scores[q])) if scores[q, i] > 0.2][:9]
        assert found[query == q].tolist() == ids[order].tolist() and score[query == q].tolist() == scores[q, order].tolist()


def test_ties_go_to_the_smaller_id_and_scores_are_negative(spark):
    rows = lexical.bm25_top_k(index(spark), queries(spark, "gamma alpha"), 10).collect()
    assert [r.id for r in rows][:2] == ["b", "g"] and rows[0].score == rows[1].score < 0
    assert lexical.bm25_top_k(index(spark), queries(spark, "nothing", ""), 3).count() == 0


def test_terms_fold_case_and_single_latin_marks(spark):
    row = spark.createDataFrame([("Naïve ÑANDÚ ё Й x_y-z 12½ été ệ",)], "t string").select(terms(F.col("t"))).first()[0]
    assert row == ["naive", "nandu", "ё", "й", "x", "y", "z", "12½", "ete", "ệ"]
    assert "é" in latin_folding()[0] and "й" not in latin_folding()[0]


def test_scalar_functions(spark):
    df = spark.createDataFrame([("a b/ё*~", "2026-01-02T03:04:05.5+03:00"), (None, "2026-01-02 03:04:05Z"), ("", "2026-01-02T03:04:05+24:00")], "p string, t string")
    rows = df.select(percent_encoded(F.col("p")), percent_encoded(F.col("p"), True), utc_instant(F.col("t"))).collect()
    assert tuple(rows[0]) == ("a%20b%2F%D1%91%2A~", "a%20b/%D1%91%2A~", "2026-01-02T00:04:05.500000Z")
    assert tuple(rows[1]) == (None, None, None) and tuple(rows[2]) == ("", "", None)


def test_vector_functions(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],), (None,), ([float("nan"), 1.0],), ([1.0],)], "v array<float>")
    rows = df.select(vectors.norm(F.col("v")), vectors.normalized(F.col("v")), vectors.is_usable(F.col("v"), 2)).collect()
    assert rows[0][0] == 5 and rows[0][1] == [0.6, 0.8] and [r[2] for r in rows] == [True, False, False, False, False]
    assert rows[1][1] is None


def test_exact_search_orders_by_cosine_then_id(spark):
    rows = [("a", [1.0, 0.0]), ("b", [0.0, 1.0]), ("c", [2.0, 0.0]), ("d", [1.0, 1.0])]
    df = spark.createDataFrame(rows, "id string, vector array<float>")
    got = semantic.exact_top_k(df, df.where("id = 'a'").withColumnRenamed("id", "query_id"), 3, 2).orderBy("rank").collect()
    assert [(r.id, round(r.cosine, 6)) for r in got] == [("c", 1.0), ("d", 0.707107), ("b", 0.0)]
    assert semantic.exact_top_k(df, df.limit(0).withColumnRenamed("id", "query_id"), 3, 2).count() == 0
    assert semantic.exact_top_k(df.limit(0), df.withColumnRenamed("id", "query_id"), 3, 2).count() == 0


def test_exact_search_in_blocks_is_the_same(spark, monkeypatch):
    rng = np.random.default_rng(0)
    df = spark.createDataFrame([(k, rng.normal(size=8).tolist()) for k in range(60)], "id long, vector array<float>")
    asked = df.where("id % 3 = 0").withColumnRenamed("id", "query_id")
    whole = {tuple(r) for r in semantic.exact_top_k(df, asked, 4, 8).collect()}
    monkeypatch.setattr(semantic, "BLOCK_NUMBERS", 40)
    assert {tuple(r) for r in semantic.exact_top_k(df, asked, 4, 8).collect()} == whole and len(whole) == 80


def ranked(spark, ids):
    return spark.createDataFrame([(1, i, r) for r, i in enumerate(ids, 1)], "query_id long, id string, rank int")


def test_fusion_of_known_ranks(spark):
    rows = hybrid.fuse(ranked(spark, "bac"), ranked(spark, "dca"), 6).orderBy("rank").collect()
    assert [r.id for r in rows] == ["a", "c", "b", "d"] and rows[0].score == pytest.approx(1 / 62 + 1 / 63)
    alone = hybrid.fuse(ranked(spark, "x"), ranked(spark, "").limit(0), 1).collect()
    assert alone[0].score == pytest.approx(1 / 61) and alone[0].lexical_rank is None


def test_rerank_scores_the_whole_union_and_refuses_bad_scores(spark):
    features = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("c", 1.0)], "id string, s double")
    rows = hybrid.rerank([ranked(spark, "ca"), ranked(spark, "ab")], F.col("s"), features, 2).orderBy("rank").collect()
    assert [(r.id, r.score) for r in rows] == [("b", 2.0), ("a", 1.0)]
    with pytest.raises(Exception, match="not finite"):
        hybrid.rerank([ranked(spark, "cz")], F.col("s"), features, 2).collect()


def test_literals():
    def found(text, **options):
        return [(x.value, x.kind) for x in literals.extract_literals(text, **options)]

    assert found("see /etc/app.conf: and 10.0.0.1. on node-7") == [("/etc/app.conf", "path"), ("10.0.0.1", "ip"), ("node-7", "identifier")]
    assert found("`x y` and `node-7` and 999.1.1.1 fe80::1") == [("x y", "quoted"), ("node-7", "identifier"), ("fe80::1", "ip")]
    assert found("max_size_x") == [] and found("max_size_x", underscores=True) == [("max_size_x", "identifier")]
    text = "😀 10.0.0.1, 10.0.0.11 and 10.0.0.1.bak 10.0.0.1."
    assert literals.occurrences(text, "10.0.0.1", "ip") == [(2, 10), (text.rindex("10.0.0.1"), text.rindex("10.0.0.1") + 8)]
    assert literals.occurrences("aaa", "aa", "quoted") == [(0, 2), (1, 3)]


def test_literals_compete_before_the_cut(spark):
    pages = spark.createDataFrame([(1, "node-7 and `x` alpha"), (2, "alpha beta node-70"), (3, "alpha")], "page_key long, markdown string")
    chunks = spark.createDataFrame([("c1", 1, [(0, 20)]), ("c2", 2, [(0, 18)]), ("c3", 3, [(0, 5)])], "id string, page_key long, ranges array<struct<start int, end int>>")
    wanted = spark.createDataFrame([(1, "node-7", "identifier"), (1, "x` a", "quoted")], "query_id long, literal string, kind string")
    matches = lexical.literal_matches(chunks, pages, wanted)
    assert {(r.id, r.literal, r.start) for r in matches.collect()} == {("c1", "node-7", 0), ("c1", "x` a", 12)}
    scores = spark.createDataFrame([(1, "c2", -3.0), (1, "c3", -2.0)], "query_id long, id string, score double")
    rows = lexical.literal_priority(scores, matches, 2).orderBy("rank").collect()
    assert [(r.id, r.n_literals, r.score) for r in rows] == [("c1", 2, None), ("c2", 0, -3.0)]
