import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.functions import tokens
from docloom.operators import builds, chunking, package
from docloom.plans.builds import HASH_DIM, term_hash_encoder
from docloom.sources import generations

DOCUMENT = "source string, page_id long, locale string, path string, title string, source_url string, updated_at string, markdown string, content_sha256 string"
LIMITS = "source string, target int, maximum int, overlap int, input_limit int"
ABOUT = builds.identity("term-hash", HASH_DIM, tokens.WORDS, chunking.VERSIONS[0])


def pages(spark, *texts):
    return spark.createDataFrame([("s", i, "ru", f"p{i}", "t", "u", "2026-01-01T00:00:00Z", t, None) for i, t in enumerate(texts, 1)], DOCUMENT)


def limits(spark):
    return spark.createDataFrame([("s", 20, 30, 5, 60)], LIMITS)


def test_a_build_is_published_and_described(spark, tmp_path):
    root = str(tmp_path / "index")
    assert builds.index_status(spark, root) == {"state": "missing"}
    when = dt.datetime(2026, 1, 2, tzinfo=dt.timezone.utc)
    name = builds.rebuild(spark, root, pages(spark, "# A\nsome words here\n", "other words " * 30), limits(spark), term_hash_encoder, ABOUT, when=when)
    status = builds.index_status(spark, root)
    assert status["state"] == "ok" and status["documents"] == 2 and status["chunks"] == 3 and status["indexed_at"] == "2026-01-02T00:00:00+00:00"
    assert status["identity"] == ABOUT and generations.current(spark, root) == name
    assert builds.index_violations(spark, f"{root}/{name}", HASH_DIM).isEmpty()


def test_a_failed_build_leaves_the_generation_before(spark, tmp_path):
    root = str(tmp_path / "index")
    name = builds.rebuild(spark, root, pages(spark, "words\n"), limits(spark), term_hash_encoder, ABOUT)

    def broken():
        return lambda texts: np.full((len(texts), HASH_DIM), np.nan)

    with pytest.raises(Exception):
        builds.rebuild(spark, root, pages(spark, "words\n", "more\n"), limits(spark), broken, ABOUT)
    tiny = spark.createDataFrame([("s", 1, 1, 0, 1)], LIMITS)
    with pytest.raises(builds.BuildError):
        builds.rebuild(spark, root, pages(spark, "words\n"), tiny, term_hash_encoder, ABOUT)
    assert generations.current(spark, root) == name
    assert sorted(p.name for p in (tmp_path / "index").iterdir() if p.name.startswith("gen-")) == [name]
    with generations.builder_lock(spark, root), pytest.raises(ValueError):
        builds.rebuild(spark, root, pages(spark, "words\n"), limits(spark), term_hash_encoder, ABOUT)


def test_identities_schemas_and_paths(spark, tmp_path):
    other = builds.identity("term-hash", 32, tokens.CHARACTERS, chunking.VERSIONS[0])
    assert builds.identity_differences(ABOUT, ABOUT) == {} and set(builds.identity_differences(ABOUT, other)) == {"dimension", "tokenizer"}
    a, b = (spark.createDataFrame([], s).schema for s in ("x int, y string, z long", "y string, x long, w int"))
    assert builds.schema_differences(a, b) == [("w", "missing"), ("x", "int instead of bigint"), ("z", "unexpected")]
    (tmp_path / "data").mkdir()
    (tmp_path / "link").symlink_to(tmp_path / "data")
    builds.protect(str(tmp_path / "out"), str(tmp_path / "data"))
    for bad in (tmp_path / "data" / "x", tmp_path / "link", tmp_path):
        with pytest.raises(builds.BuildError):
            builds.protect(str(bad), str(tmp_path / "data"))


def test_fingerprints_ignore_order_and_see_repeats(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "k int, v string")
    one = builds.table_fingerprint(df, ["k", "v"]).first()
    assert builds.table_fingerprint(df.orderBy(F.desc("k")), ["k", "v"]).first() == one
    assert builds.table_fingerprint(df.union(df), ["k", "v"]).first() != one != builds.table_fingerprint(df.na.fill("x"), ["k", "v"]).first()


def test_a_sound_package_and_an_empty_one(spark):
    sha = "x" * 64
    schema = (
        "id string, question string, tags array<string>, split string, source_set string, answerable boolean, expected_behavior string,"
        " required_facts array<struct<text string, evidence_ids array<string>>>, evidence array<struct<id string, page_id long, locale string, path string,"
        " content_sha256 string, spans array<struct<start int, end int, exact_text string>>, heading_path array<string>>>, exact_commands array<string>,"
        " previous_question string, missing_information string, clarification string"
    )
    evidence = [("e", 1, "ru", "p", sha, [(0, 6, "run ls")], None)]
    good = ("q1", "how?", ["text"], "holdout", "live", True, "answer", [("f", ["e"])], evidence, ["run ls"], None, None, None)
    refuse = ("q2", "what?", ["text"], "holdout", "live", False, "refuse", [], [], [], None, None, None)
    documents = spark.createDataFrame([(1, "ru", "p", sha, "run ls\n")], "page_id long, locale string, path string, content_sha256 string, markdown string")
    policy = package.Policy(least_follow_ups=0, refusals=(1, 5), least_holdout=1)
    cases = spark.createDataFrame([good, good, refuse, ("q3", *good[1:3], "tuning", *good[4:])], schema)
    assert package.package_report(cases, documents, policy).collect() == []
    assert {r.key for r in package.package_report(cases.limit(0), documents, policy).collect()} == {"package"}
    nulls = spark.createDataFrame([("q9", *[None] * 12)], schema)
    assert "facts" not in {r.rule for r in package.case_violations(nulls, policy).collect()} and package.evidence_violations(nulls, documents).isEmpty()


def test_smallest_reaching():
    for limit in range(0, 60):
        taken = []
        found = tokens.smallest_reaching(lambda n: taken.append(n) or n // 3, limit, 100)
        assert found == (3 * limit if limit <= 33 else None) and len(taken) < 30


def test_vocabulary_tokens_count_parts_like_texts(tmp_path):
    import base64

    path = tmp_path / "tiny.tiktoken"
    path.write_bytes(b"\n".join(base64.b64encode(bytes([b])) + b" %d" % b for b in range(256)) + b"\n" + base64.b64encode(b"ab") + b" 256\n")
    counter = tokens.VocabularyTokens(str(path))
    assert counter.count("ab ab") == 3 and counter.count("ab", True) == 3 and counter.count("") == 0
    chunks = chunking.chunk_page("s", {"page_id": 1, "title": "t", "markdown": "ab ab\n" * 50}, chunking.Limits(20, 30, 4, 90), counter)
    assert len(chunks) > 3 and all(c["body_tokens"] == counter.count(c["search_text"]) <= 30 for c in chunks)
