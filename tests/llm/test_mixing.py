import numpy as np
import pytest

from docloom.llm import mixing

pytest.importorskip("tiktoken")
DOCS = "doc_id long, text string, lang string, source string, path string, tokens int, copies int"


@pytest.fixture
def documents(spark):
    rng = np.random.default_rng(2)
    rows = []
    for k in range(900):
        source = ["big", "big", "mid", "small"][k % 4] if k % 40 else "tiny"
        rows.append((k, "word " * int(rng.integers(5, 60)), [" EN", "ru-RU", None, "xx"][k % 4], source, f"t{k % 5}/x", 1, 1))
    rows += [(2000, None, "en", "big", "a", 1, 1), (2001, "", "en", "big", "a", 1, 1), (None, "word", "en", "big", "a", 1, 1), (2002, "x", "en", None, "a", 1, 1)]
    df = spark.createDataFrame(rows, DOCS)
    return df.union(df.limit(30))


TARGETS = "mix_id int, source string, target_share double, max_repeats int"


def test_shares_and_caps(spark, documents):
    targets = spark.createDataFrame([(1, "big", 0.3, 1), (1, "mid", 0.3, 2), (1, "small", 0.35, 4), (1, "nosuch", 0.1, 2), (2, "tiny", 0.5, 3), (2, "big", 0.5, 1), (3, "big", None, 2)], TARGETS)
    chosen = mixing.mix_sources(documents, targets)
    rows = chosen.collect()
    assert len({(r.mix_id, r.doc_id) for r in rows}) == len(rows)
    caps = {(r.mix_id, r.source): r.max_repeats for r in targets.collect()}
    assert all(1 <= r.copies <= caps[r.mix_id, r.source] for r in rows)
    shares = {(r.mix_id, r.source): r.reached_share for r in mixing.reached_shares(chosen, targets).collect()}
    for source, share in (("big", 0.3), ("mid", 0.3), ("small", 0.35)):
        assert shares[1, source] == pytest.approx(share / 0.95, abs=0.01)
    assert shares[1, "nosuch"] == 0 and shares[3, "big"] == 0
    assert shares[2, "tiny"] == pytest.approx(0.5, abs=0.02)
    assert sorted(map(tuple, mixing.mix_sources(documents, targets).collect())) == sorted(map(tuple, rows))
    checks = mixing.mix_checks(chosen, documents, targets, 0.02).collect()
    assert len(checks) == 7 and all(r.close and r.capped for r in checks)


def test_languages_and_topics_keep_the_pools_shares_where_sources_allow(spark):
    rng = np.random.default_rng(5)
    rows = [(k, "word " * int(rng.integers(20, 60)), ["en", "ru", "de"][k % 3] if k % 500 else f"rare{k}", ["a", "b"][k % 2], f"{'xyz'[k // 7 % 3]}/p", 1, 1) for k in range(3000)]
    documents = spark.createDataFrame(rows, DOCS)
    targets = spark.createDataFrame([(1, "a", 0.7, 3), (1, "b", 0.3, 3)], TARGETS)
    chosen = mixing.mix_sources(documents, targets)
    found = {(r.axis, r.cell): r for r in mixing.reached_marginals(documents, chosen, targets).collect()}
    assert {c for a, c in found if a == "lang"} == {"en", "ru", "de", "other"} and {c for a, c in found if a == "topic"} == set("xyz")
    assert found["lang", "other"].merged == 6
    assert all(abs(r.pool_share - r.reached_share) < 0.01 for r in found.values())


def test_empty_inputs(spark, documents):
    targets = spark.createDataFrame([(1, "big", 1.0, 1)], TARGETS)
    assert mixing.mix_sources(documents.limit(0), targets).count() == 0
    assert mixing.mix_sources(documents, targets.limit(0)).count() == 0


def test_raking_meets_sources_and_keeps_caps():
    rng = np.random.default_rng(0)
    n = 60
    tokens, source, lang, topic = rng.integers(10, 1000, n).astype(float), np.arange(n) % 3, rng.integers(0, 4, n), rng.integers(0, 5, n)
    shares, caps = np.array([0.2, 0.3, 0.5]), np.array([2.0, 2.0, 3.0])
    total = min((caps * np.bincount(source, tokens) / shares).min(), tokens.sum())
    w = mixing.rake(tokens, source, lang, topic, shares, caps, total)
    assert np.allclose(np.bincount(source, w * tokens), shares * total, rtol=1e-6)
    assert (w <= caps[source] * (1 + 1e-9)).all()
