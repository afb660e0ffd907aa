import random

from docloom.llm import leak
from docloom.llm.kernels import Words


def words_of(text):
    some = Words([text or ""])
    return [some.word(i) for i in range(len(some.hash))]


def brute(documents, items, run=12):
    out = set()
    for d, text in documents:
        have = words_of(text)
        for i, item in items:
            want = words_of(item)
            size = min(run, len(want))
            if d is None or i is None or not size:
                continue
            pieces = {tuple(want[k : k + size]) for k in range(len(want) - size + 1)}
            if any(tuple(have[k : k + size]) in pieces for k in range(len(have) - size + 1)):
                out.add((d, i))
    return out


def test_matches_brute_force(spark):
    rng = random.Random(5)
    vocabulary = [f"слово{k}" for k in range(6)] + ["a", "b"]
    items = [(k, " ".join(rng.choices(vocabulary, k=rng.choice([1, 2, 5, 11, 12, 13, 20])))) for k in range(30)]
    items += [(100, ""), (101, None), (None, "a b"), (102, "Café ÉTÉ")]
    documents = [(k, ", ".join(rng.choices(vocabulary, k=rng.randrange(0, 60)))) for k in range(60)]
    for k in range(20):
        text = documents[k][1]
        documents.append((200 + k, text + "\r\n" + (items[rng.randrange(30)][1] or "") + " " + text))
    documents += [(300, None), (301, ""), (None, items[0][1]), (302, "the café été"), (303, "café. ete")]
    d = spark.createDataFrame(documents, "doc_id long, text string").selectExpr("*", "1 as item_id", "'x' as source")
    i = spark.createDataFrame(items, "item_id long, text string")
    rows = [tuple(r) for r in leak.leaked_passages(d.union(d), i.union(i)).collect()]
    assert len(rows) == len(set(rows)) and set(rows) == brute(documents, items)
    assert (302, 102) in rows and (303, 102) not in rows


def test_several_scans_find_the_same(spark, monkeypatch):
    items = spark.createDataFrame([(k, f"alpha{k} beta gamma") for k in range(20)], "item_id long, text string")
    documents = spark.createDataFrame([(k, f"x alpha{k} beta gamma y") for k in range(0, 20, 2)], "doc_id long, text string")
    monkeypatch.setattr(leak, "CHARS_PER_SCAN", 50)
    assert {tuple(r) for r in leak.leaked_passages(documents, items).collect()} == {(k, k) for k in range(0, 20, 2)}


def test_empty_tables(spark):
    none_i = spark.createDataFrame([], "item_id long, text string, kind string, lang string")
    none_d = spark.createDataFrame([], "doc_id long, text string")
    one = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert leak.leaked_passages(one, none_i).count() == 0 and leak.leaked_passages(none_d, none_i).count() == 0
    assert leak.leak_report(leak.leaked_passages(one, none_i), none_i).count() == 0


def test_short_items_do_not_narrow_the_window_of_longer_ones():
    items = [(1, "one"), (2, "two words"), (3, "a b c"), (4, " ".join(f"w{i}" for i in range(7))), (5, " ".join(f"x{i}" for i in range(20))), (6, "")]
    found = leak.matchers(items, 12)
    assert sorted(m.window for m in found) == [1, 2, 7, 12]
