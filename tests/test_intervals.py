import itertools
import random

import pytest

from docloom.operators import intervals, setcover

SCHEMA = "k long, start int, end int"


def random_ranges(seed, n=120):
    rng = random.Random(seed)
    out = [(rng.randrange(6), a := rng.randrange(60), a + rng.randrange(0, 12)) for _ in range(n)]
    return out + [(1, None, 3), (2, 5, None), (None, 1, 2)]


def points(ranges, key):
    return {p for k, a, b in ranges if k == key and a is not None and b is not None for p in range(a, b)}


def test_merge_is_the_union(spark):
    ranges = random_ranges(1)
    got = [tuple(r) for r in intervals.merge_ranges(spark.createDataFrame(ranges, SCHEMA), ["k"]).where("k is not null").collect()]
    for key in range(6):
        own = sorted(r for r in got if r[0] == key)
        assert points(own, key) == points(ranges, key)
        assert all(a[2] < b[1] for a, b in zip(own, own[1:]))


def test_cover_and_gaps_match_points(spark):
    ranges, spans = random_ranges(2, 60), random_ranges(3, 40)
    r, s = (spark.createDataFrame(x, SCHEMA) for x in (ranges, spans))
    for row in intervals.covered_spans(s.where("k is not null and start < end"), r, ["k"]).collect():
        assert row.covered == (set(range(row.start, row.end)) <= points(ranges, row.k))
    gaps = {}
    for row in intervals.uncovered(s, r, ["k"]).where("k is not null").collect():
        gaps.setdefault((row.k, row.span_start, row.span_end), set()).update(range(row.start, row.end))
    for k, a, b in spans:
        if None not in (k, a, b) and a < b:
            assert gaps.get((k, a, b), set()) == set(range(a, b)) - points(ranges, k)


def test_touching_ranges_cover_and_atoms_cut(spark):
    ranges = spark.createDataFrame([(1, 0, 2), (1, 4, 7), (1, 2, 4)], SCHEMA)
    span = spark.createDataFrame([(1, 0, 7)], SCHEMA)
    assert intervals.covered_spans(span, ranges, ["k"]).first().covered
    assert not intervals.covered_spans(span, ranges.where("start <> 2"), ["k"]).first().covered
    assert sorted((r.start, r.end) for r in intervals.atoms(span, ranges, ["k"]).collect()) == [(0, 2), (2, 4), (4, 7)]
    assert not intervals.covered_spans(span, ranges.limit(0), ["k"]).first().covered


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert intervals.merge_ranges(none, ["k"]).count() == intervals.atoms(none, none, ["k"]).count() == intervals.uncovered(none, none, ["k"]).count() == 0


@pytest.mark.parametrize(
    "options,full,want",
    [
        ({c: 1 << i for i, c in enumerate("abcdef")}, 63, ("exact", 6)),
        ({"a": 0b0011, "b": 0b1110, "c": 0b0100}, 15, ("exact", 2)),
        ({"a": 1}, 3, ("impossible", None)),
        ({}, 0, ("impossible", None)),
        ({"big": 0b011110, "l": 0b000111, "r": 0b111000}, 63, ("exact", 2)),
    ],
)
def test_minimum_cover(options, full, want):
    def atoms(mask):
        return {i for i in range(6) if mask >> i & 1}

    assert setcover.cover({n: atoms(m) for n, m in options.items()}, atoms(full))[:2] == want


def test_minimum_cover_equals_brute_force():
    rng = random.Random(5)
    for _ in range(200):
        options = {f"c{i}": set(rng.sample(range(8), rng.randrange(1, 5))) for i in range(rng.randrange(1, 9))}
        sizes = [n for n in range(1, len(options) + 1) if any(set().union(*c) >= set(range(8)) for c in itertools.combinations(options.values(), n))]
        status, minimum, low, high, witness = setcover.cover(options, set(range(8)))
        assert (status, minimum) == (("exact", sizes[0]) if sizes else ("impossible", None))
        assert not sizes or set().union(*(options[n] for n in witness)) >= set(range(8)) and len(witness) == minimum == low == high


def test_cover_gives_bounds_when_stopped():
    options = {"ab": {1, 2}, "cd": {3, 4}, "ef": {5, 6}, "ac": {1, 3}, "be": {2, 5}, "df": {4, 6}, "abc": {1, 2, 3}}
    status, minimum, low, high, witness = setcover.cover(options, {1, 2, 3, 4, 5, 6}, max_steps=0)
    assert (status, minimum) == ("unknown", None) and low == 2 <= high == len(witness)


def test_minimum_covers_of_cases(spark):
    rows = [("x", "1", "a"), ("x", "2", "a"), ("x", "2", "b"), ("x", "3", "b"), ("y", "1", None), ("y", "2", "c")]
    got = {r.case_id: (r.status, r.minimum, r.witness) for r in setcover.minimum_covers(spark.createDataFrame(rows, "case_id string, atom string, id string")).collect()}
    assert got == {"x": ("exact", 2, ["a", "b"]), "y": ("impossible", None, [])}
