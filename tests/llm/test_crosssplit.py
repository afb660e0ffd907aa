import random

from docloom.llm import crosssplit


def grams(text, size=5):
    form = crosssplit.normal_form(text or "")
    return {form[i : i + size] for i in range(len(form) - size + 1)}


def brute(held, training, threshold):
    out = set()
    for i, p in held:
        for j, q in training:
            a, b = grams(p), grams(q)
            if i and j and a and b and len(a & b) >= threshold * len(a | b):
                out.add((i, j))
    return out


def questions(seed, n, side):
    rng = random.Random(seed)
    words = [f"w{k}-слово" for k in range(30)]
    base = [" ".join(random.Random(k).choices(words, k=12)) for k in range(8)]
    out = []
    for k in range(n):
        parts = rng.choice(base).split()
        for _ in range(rng.randrange(4)):
            parts[rng.randrange(len(parts))] = rng.choice(words)
        out.append((f"{side}{k}", " ".join(parts)))
    return out


def test_matches_brute_force(spark):
    held = questions(1, 60, "h") + [("h-null", None), ("h-short", "ab"), (None, "x y z w v u")]
    training = questions(2, 60, "t") + [("t-empty", ""), held[0][:0] + ("t-copy", held[0][1])]
    a = spark.createDataFrame(held, "id string, question string").withColumnRenamed("id", "id")
    b = spark.createDataFrame(training, "id string, question string")
    found = crosssplit.cross_split_overlaps(a.union(a), b)
    got = [(r.id_eval, r.id_train) for r in found.collect()]
    assert len(got) == len(set(got))
    assert set(got) == brute(held, training, 0.6)
    assert (held[0][0], "t-copy") in set(got)


def test_composed_accents_and_case_are_equal(spark):
    a = spark.createDataFrame([("1", "Café TERMINAL Nummer drei")], "id string, question string")
    b = spark.createDataFrame([("2", "café terminal nummer, drei!")], "id string, question string")
    assert crosssplit.cross_split_overlaps(a, b).collect()[0].overlap == 1.0


def test_empty_sides_and_clashing_columns(spark):
    empty = spark.createDataFrame([], "id string, question string, node long, held string")
    one = spark.createDataFrame([("1", "some question text", 5, "x")], "id string, question string, node long, held string")
    for a, b in ((empty, one), (one, empty), (empty, empty)):
        assert crosssplit.cross_split_overlaps(a, b).count() == 0


def test_report_counts_every_group(spark):
    held = spark.createDataFrame([("a", "long question", "holdout", "live"), ("b", "other words", "safety", None)], "id string, question string, split string, source_set string")
    training = spark.createDataFrame([("t", "long question", "live")], "id string, question string, source_set string")
    rows = {(r.split, r.source_set): (r.cases, r.overlapping, r.pairs) for r in crosssplit.overlap_report(held, training).collect()}
    assert rows == {("holdout", "live"): (1, 1, 1), ("safety", "none"): (1, 0, 0), ("tuning", "live"): (1, 1, 1)}


def test_report_counts_classes_of_copies_without_listing_pairs(spark):
    held = spark.range(3000).selectExpr("concat('h', id) as id", "if(id < 2000, 'the same question here', 'another one there') as question", "'holdout' as split", "'live' as source_set")
    training = spark.range(2500).selectExpr("concat('t', id) as id", "'the same question, here' as question", "'live' as source_set")
    rows = {r.split: (r.cases, r.overlapping, r.pairs) for r in crosssplit.overlap_report(held, training).collect()}
    assert rows == {"holdout": (3000, 2000, 2000 * 2500), "tuning": (2500, 2500, 2000 * 2500)}
