import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.functions import checks
from docloom.functions.identity import canonical_json, fingerprint, range_id
from docloom.operators import bitmaps, evaluation, models, reports, telemetry, validation  # noqa: F401


def test_scalar_checks():
    assert checks.same_float(0.0, 0.0) and not checks.same_float(0.0, -0.0)
    assert checks.has_shape('{"a": 1, "b": "x"}', {"a": int, "b": str}) and not checks.has_shape('{"a": true, "b": "x"}', {"a": int, "b": str})
    assert not checks.has_shape('{"a": 1}', {"a": int, "b": str}) and not checks.has_shape("[", {})
    assert checks.cpu_identity("model : X\nflags: b a\nid : 7\n\nmodel: Y\n", ("model", "flags")) == [{"model": "X", "flags": ["a", "b"]}, {"model": "Y"}]
    for question, k in (("", 1), ("a\0", 1), ("a", 0), ("a", True), (None, 1), ("\ud800", 1)):
        with pytest.raises(ValueError):
            checks.validate_query(question, k)
    checks.validate_query("a", 1)


def test_identity():
    assert canonical_json({"b": [1, "ё"], "a": None}) == '{"a":null,"b":[1,"ё"]}'
    assert fingerprint({"a": 1}) == fingerprint({"a": 1}) != fingerprint({"a": 2}) and len(range_id("s", 1, 2, 3)) == 64
    with pytest.raises(ValueError):
        canonical_json(float("nan"))


def test_column_checks(spark):
    df = spark.createDataFrame([("https://a.b/c", "one\r\n  two \nthree", "two"), ("http://u@h/", "one two", "two"), (None, None, "x"), ("https://h:80", "a\nb\nc", "b\nc")], "u string, t string, c string")
    origin = checks.origin_of(F.col("u"))
    rows = df.select(origin, checks.is_origin(origin), checks.holds_lines(F.col("t"), F.col("c")), checks.is_field(F.col("t"), 8)).collect()
    assert [tuple(r) for r in rows] == [("https://a.b", True, True, False), (None, False, False, True), (None, False, False, False), ("https://h:80", True, True, True)]


def test_model_seams(spark):
    df = spark.createDataFrame([("abc", "ab"), (None, "x"), ("z", "z")], "a string, b string")
    rows = models.encode(df, "a", lambda: lambda texts: np.array([[len(t), 1.0] for t in texts])).collect()
    assert rows[0].vector == pytest.approx([3 / 10**0.5, 1 / 10**0.5]) and rows[1].vector is None
    with pytest.raises(Exception, match="unusable"):
        models.encode(df, "a", lambda: lambda texts: np.zeros((len(texts), 2))).collect()
    scored = models.score_pairs(df.na.fill(""), "a", "b", lambda: lambda x, y: len(set(x) & set(y))).collect()
    assert [r.score for r in scored] == [2, 0, 1]


def test_reports(spark):
    df = spark.createDataFrame([("a", 2.0, 1), ("a", 4.0, 2), ("b", 6.0, 3)], "arm string, v double, t int")
    assert [(r.position, r.arm) for r in reports.select_in_order(df.dropDuplicates(["arm"]), "arm", ["b", "a", "b", "z"]).orderBy("position").collect()] == [(0, "b"), (1, "a"), (2, "b")]
    assert {(r.arm, r.ratio) for r in reports.against_control(df, "arm", "v", "a").collect()} == {("a", 1.0), ("b", 2.0)}
    assert {r.ratio for r in reports.against_control(df, "arm", "v", "none").collect()} == {None}
    assert {(r.arm, r.first, r.warm) for r in reports.pass_pairs(df, ["arm"], ["t"], "v").collect()} == {("a", 2.0, 4.0), ("b", 6.0, None)}
    assert reports.run_difference(df, df, ["t"]).count() == 0 and reports.run_difference(df, df.limit(2), ["t"]).count() == 1
    gaps = telemetry.since_baseline(telemetry.sample_gaps(df.withColumn("t", F.timestamp_seconds("t")), ["arm"], "t", "v"), ["arm"], "v", "t", "v").orderBy("v").collect()
    assert [(r.gap_us, r.delta) for r in gaps] == [(None, 0.0), (1_000_000, 2.0), (None, 0.0)]


def test_evaluation_of_known_cases(spark):
    cases = spark.createDataFrame(
        [("hit", [("e", 1, "x", [(0, 4, "t"), (4, 6, "u")])]), ("late", [("e", 1, "x", [(6, 9, "t")])]), ("none", [])],
        "id string, evidence array<struct<id string, page_id long, content_sha256 string, spans array<struct<start int, end int, exact_text string>>>>",
    )
    ranges = spark.createDataFrame([("a", 1, 0, 4), ("b", 1, 4, 6), ("c", 1, 6, 9)], "id string, page_id long, start int, end int")
    order = [("hit", "a", 1), ("hit", "b", 5), ("late", "c", 6)]
    ranked = spark.createDataFrame(order, "query_id string, id string, rank int")
    hits = evaluation.evidence_hits(cases, ranked, ranges)
    assert {r.case_id: r.hit for r in hits.collect()} == {"hit": True, "late": False, "none": False}
    wide = evaluation.evidence_hits(cases, ranked, ranges, 6)
    assert {tuple(r) for r in evaluation.lost_and_new(hits, wide).collect()} == {("late", "new")}
    groups = evaluation.dense_groups(hits.withColumn("g", F.lit("x")), {"g": ["x", "y"]}).orderBy("g").collect()
    assert [(r.n, r.hits, r.misses, r.hit_rate) for r in groups] == [(3, 1, 2, 1 / 3), (0, 0, 0, None)]


def test_violations_of_sound_and_broken_rows(spark):
    fields = "source string, page_id long, locale string, path string, title string, source_url string, updated_at string, markdown string, content_sha256 string"
    good = ("s", 1, "ru", "p", "t", "u", "2026-01-01T00:00:00Z", "abc", "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad")
    df = spark.createDataFrame([good], fields)
    assert validation.document_violations(df).count() == 0 and validation.document_violations(df.limit(0)).count() == 0
    bad = spark.createDataFrame([good, good, ("s", 0, " ", None, "", "u", "yesterday", None, None)], fields)
    assert sorted(r.rule for r in validation.document_violations(bad).collect()) == sorted(
        ["page_id", "locale", "path", "title", "updated_at", "markdown", "digest", "repeated_id", "repeated_place"]
    )


def test_nearest_ranks_are_exact(spark):
    rng = np.random.default_rng(3)
    rows = [("one", 5.0)] + [("ties", float(v)) for v in rng.integers(0, 4, 999)] + [("wide", float(v)) for v in rng.normal(size=20_000)] + [("none", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(3)
    for share in (0.05, 0.5, 0.95, 1.0):
        want = {g: sorted(v for h, v in rows if h == g)[int(np.ceil(share * sum(h == g for h, _ in rows) - 1e-9)) - 1] for g in ("one", "ties", "wide")}
        assert {r.g: r.value for r in evaluation.nearest_rank(df, ["g"], "v", share).collect()} == want
