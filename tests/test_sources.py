import hashlib
import json

import pytest

from docloom.sources import generations, snapshots
from docloom.streaming import snapshots as streams

DOCUMENT = {"page_id": 1, "locale": "ru", "path": "p", "title": "t", "source_url": "u", "updated_at": "2026-01-01T00:00:00Z", "markdown": "a\r\n😀", "content_sha256": "x"}


def test_json_snapshots(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"schema_version": 1, "source": "s", "documents": [DOCUMENT, DOCUMENT | {"page_id": 2}]}))
    rows = snapshots.read_json_snapshot(spark, str(tmp_path)).orderBy("page_id").collect()
    assert [(r.source, r.page_id, r.markdown) for r in rows] == [("s", 1, "a\r\n😀"), ("s", 2, "a\r\n😀")]
    (tmp_path / "b.json").write_text('{"source": "s", "source": "s", "documents": []}')
    with pytest.raises(Exception, match="repeated key"):
        snapshots.read_json_snapshot(spark, str(tmp_path)).count()


@pytest.mark.parametrize("raw", [b'{"a": 1, "a": 2}', b'{"a": NaN}', b"\xff", b'{"a": {"b": 1, "b": 2}}', b"{"])
def test_strict_json_refuses(raw):
    with pytest.raises(ValueError):
        snapshots.strict_json(raw)


def test_generations(spark, tmp_path):
    root = str(tmp_path / "gens")
    first, second = spark.range(3), spark.range(5)
    assert generations.status(spark, root, ["t"]) == "missing"
    with pytest.raises(ValueError):
        generations.read(spark, root, "t")
    name = generations.publish(spark, root, {"t": first})
    assert generations.current(spark, root) == name and generations.read(spark, root, "t").count() == 3
    with pytest.raises(Exception):
        generations.publish(spark, root, {"t": second.selectExpr("raise_error('no') as x")})
    assert generations.current(spark, root) == name
    generations.publish(spark, root, {"t": second})
    assert generations.read(spark, root, "t").count() == 5 and generations.status(spark, root, ["t"]) == "ok"
    assert generations.status(spark, root, ["t", "u"]) == "invalid"
    assert generations.same_rows(first.union(first), first.union(first)) and not generations.same_rows(first, first.union(first))


def test_digests_and_logs(spark, tmp_path):
    (tmp_path / "x.log").write_bytes(b"one\ntwo\n")
    assert snapshots.file_digests(spark, str(tmp_path)).first().sha256 == hashlib.sha256(b"one\ntwo\n").hexdigest()
    assert sorted(r.line for r in snapshots.log_lines(spark, str(tmp_path)).collect()) == ["one", "two"]


def test_event_stream_equals_batch(spark, tmp_path):
    rows = spark.sql("select timestamp'2026-01-01 00:00:00' + make_interval(0,0,0,0,0,cast(id as int),0) as ts, if(id % 2 = 0, 'a', 'b') as event_type, cast(id as double) as value from range(40)")
    rows.union(rows.selectExpr("cast(null as timestamp)", "event_type", "value").limit(1)).repartition(3).write.parquet(str(tmp_path / "in"))
    stream = streams.event_windows(streams.table_stream(spark, str(tmp_path / "in"), rows.schema), late="2 hours")
    q = stream.writeStream.outputMode("complete").format("memory").queryName("windows").start()
    q.processAllAvailable()
    q.stop()
    want = {tuple(r) for r in streams.event_windows(rows).collect()}
    assert {tuple(r) for r in spark.table("windows").collect()} == want and len(want) == 16


def test_redelivered_rows_of_a_stream_come_once(spark, tmp_path):
    rows = spark.sql("select id as page_id, timestamp'2026-01-01' as delivered_at from range(5)")
    rows.write.parquet(str(tmp_path / "in"))
    rows.write.mode("append").parquet(str(tmp_path / "in"))
    got = []
    stream = streams.delivered_once(streams.table_stream(spark, str(tmp_path / "in"), rows.schema), "page_id", "delivered_at")
    q = streams.for_each_batch(stream, str(tmp_path / "ckpt"), lambda df, n: got.extend(r.page_id for r in df.collect()))
    q.awaitTermination()
    assert sorted(got) == list(range(5))


def test_newest_rows_of_a_stream_and_of_a_batch(spark, tmp_path):
    rows = spark.sql("select id % 3 as page_id, timestamp'2026-01-01' + make_interval(0,0,0,cast(id as int),0,0,0) as at, id as n from range(9)").union(spark.sql("select 1L, null, 99L"))
    rows.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = streams.newest_rows(streams.table_stream(spark, str(tmp_path / "in"), rows.schema, 1), "page_id", "at")
    streams.replace_batches(stream, str(tmp_path / "out"), str(tmp_path / "progress")).awaitTermination()
    want = {(r.page_id, r.n) for r in streams.newest_rows(rows, "page_id", "at").collect()}
    assert {(r.page_id, r.n) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == want == {(0, 6), (1, 7), (2, 8)}


def test_chunk_output_is_canonical_and_strict(spark, tmp_path):
    fields = snapshots.CHUNK
    row = ("c1", "s", 1, 0, ["H"], [("source", 0, 3, "text", None, None)], [(0, 3)], "a\u0301b", 2, 4, "{}")
    df = spark.createDataFrame([row, ("c0", *row[1:])], fields)
    snapshots.write_chunk_output(df, str(tmp_path / "a"))
    snapshots.write_chunk_output(df.repartition(3), str(tmp_path / "b"))
    assert sorted(map(tuple, snapshots.read_chunk_output(spark, str(tmp_path / "a")).collect())) == sorted(map(tuple, df.collect()))
    lines = [sorted(r.value for r in spark.read.text(str(tmp_path / d)).collect()) for d in "ab"]
    assert lines[0] == lines[1] and '"chunk_id":"c0"' in lines[0][0]
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "x.txt").write_text('{"chunk_id": "c", "more": 1}\n')
    with pytest.raises(Exception, match="other keys"):
        snapshots.read_chunk_output(spark, str(tmp_path / "c")).count()


def test_written_snapshots_are_read_back(spark, tmp_path):
    df = spark.createDataFrame([tuple({"source": s, **DOCUMENT, "page_id": i}.values()) for s, i in (("a", 2), ("a", 1), ("b", 3))], "source string, " + snapshots.DOCUMENT)
    snapshots.write_json_snapshot(df, str(tmp_path / "s"))
    back = snapshots.read_json_snapshot(spark, str(tmp_path / "s" / "*.txt"))
    assert {(r.source, r.page_id, r.markdown) for r in back.collect()} == {("a", 1, "a\r\n😀"), ("a", 2, "a\r\n😀"), ("b", 3, "a\r\n😀")}


def test_every_source_of_a_snapshot_has_its_own_file(spark, tmp_path):
    """Sources that come from several tasks, and none at all."""
    setting = "spark.sql.adaptive.coalescePartitions.enabled"
    df = spark.createDataFrame([tuple({"source": f"s{i % 40}", **DOCUMENT, "page_id": i}.values()) for i in range(80)], "source string, " + snapshots.DOCUMENT)
    spark.conf.set(setting, "false")
    try:
        snapshots.write_json_snapshot(df, str(tmp_path / "s"))
        snapshots.write_json_snapshot(df.where("false"), str(tmp_path / "none"))
    finally:
        spark.conf.unset(setting)
    assert len(list((tmp_path / "s").glob("*.txt"))) == 40
    assert sorted((r.page_id, r.source) for r in snapshots.read_json_snapshot(spark, str(tmp_path / "s")).collect()) == [(i, f"s{i % 40}") for i in range(80)]
    assert snapshots.read_json_snapshot(spark, str(tmp_path / "none")).count() == 0


def test_stated_files_are_compared_with_their_digests(spark):
    have = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "path string, sha256 string")
    want = spark.createDataFrame([("a", "1"), ("b", "9"), ("d", "4")], "path string, sha256 string")
    assert {tuple(r) for r in snapshots.missing_files(have, want).collect()} == {("b", "other"), ("c", "unexpected"), ("d", "missing")}


def test_a_database_view_is_read_in_ranges(spark):
    url = "jdbc:derby:memory:docloom;create=true"
    con = spark.sparkContext._jvm.java.sql.DriverManager.getConnection(url)
    run = con.createStatement().execute
    run('create table "pages" ("page_id" bigint, "locale" varchar(9), "path" varchar(99), "title" varchar(99), "markdown" varchar(999), "updated_at" varchar(40))')
    for i in range(20):
        run(f"insert into \"pages\" values ({i}, 'ru', 'p{i}', 't', 'text {i}', '2026-01-01T00:00:00Z')")
    con.close()
    df = snapshots.read_jdbc_view(spark, url, "pages", quoted_columns=True, bounds=(0, 20, 4), timeout_s=30)
    assert df.rdd.getNumPartitions() == 4 and sorted((r.page_id, r.markdown) for r in df.collect()) == [(i, f"text {i}") for i in range(20)]
