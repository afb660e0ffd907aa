import random

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from docloom.operators.bitmaps import OrdinalBitmap
from docloom.operators.snapshots import advance, load_state, snapshot_changes

SCHEMA = "snapshot_no int, page_id long, content_sha256 string, updated_at string"


def brute(rows):
    newest = {}
    for s, k, h, t in rows:
        if s is None or k is None:
            continue
        h = (h or "").strip().lower() or None
        order = (t or "", h is not None, h or "")
        if (s, k) not in newest or order > newest[s, k][0]:
            newest[s, k] = (order, h)
    if not newest:
        return set()
    first, last = min(s for s, _ in newest), max(s for s, _ in newest)
    known, out = {}, set()
    for s in range(first, last + 1):
        now = {k: v[1] for (n, k), v in newest.items() if n == s}
        before = {k for n, k in newest if n == s - 1}
        out |= {(s, k, "removed") for k in before - set(now)}
        for k, h in now.items():
            if k not in before:
                known.pop(k, None)
                if s > first:
                    out.add((s, k, "added"))
            elif h and known.get(k, h) != h:
                out.add((s, k, "changed"))
            if h:
                known[k] = h
    return {x for x in out if x[0] > first}


def test_matches_brute_force(spark):
    rng = random.Random(1)
    rows = []
    for s in range(1, 9):
        if s == 5:
            continue  # an empty snapshot
        for k in range(80):
            if rng.random() < 0.7:
                for _ in range(rng.choice([1, 1, 2])):
                    h = rng.choice(["aa", "bb", "cc", None, " AA\n", "bb "])
                    rows.append((s, k, h, rng.choice([None, "", f"2026-01-0{rng.randrange(1, 5)}T00:00:00Z"])))
    rows += [(None, 1, "aa", None), (3, None, "aa", None)]
    df = spark.createDataFrame(rows + rows[:50], SCHEMA).selectExpr("*", "1 as s", "'x' as k", "2 as t")
    got = [tuple(r) for r in snapshot_changes(df, shards=5).collect()]
    want = brute(rows)
    # Equal times are settled by a fixed but unspecified rule between known hashes.
    clear = {(s, k) for s, k, _, _ in rows}
    assert len(got) == len(set(got)) and clear
    assert {x for x in got if x[2] != "changed"} == {x for x in want if x[2] != "changed"}
    unique = [r for r in rows if sum((r[0], r[1]) == (q[0], q[1]) for q in rows) == 1]
    alone = snapshot_changes(spark.createDataFrame(unique, SCHEMA), shards=3)
    assert {tuple(r) for r in alone.collect()} == brute(unique)


def test_offsets_decide_the_newest_row(spark):
    rows = [(1, 1, "old", "2026-01-01T00:00:00Z"), (2, 1, "new", "2026-01-02T03:00:00+03:00"), (2, 1, "late", "2026-01-02T00:00:01Z"), (2, 1, "blank", " ")]
    rows += [(3, 1, "LATE ", None)]
    assert [tuple(r) for r in snapshot_changes(spark.createDataFrame(rows, SCHEMA)).collect()] == [(2, 1, "changed")]


def test_empty_table(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert snapshot_changes(none).collect() == [] and advance(none)[1] is None


def test_later_snapshots_need_only_the_stored_state(spark, tmp_path):
    rng = random.Random(7)
    rows = [(s, k, rng.choice(["aa", "bb", None]), f"2026-01-{s:02d}T00:00:00Z") for s in (1, 2, 3, 4, 6, 7) for k in range(60 + 5 * s) if rng.random() < 0.8]
    whole = sorted(tuple(r) for r in snapshot_changes(spark.createDataFrame(rows, SCHEMA), shards=3).collect())
    assert set(whole) == brute(rows)
    got, state, ordinals = [], None, {}
    for low, high in ((1, 2), (3, 3), (4, 6), (7, 7)):
        changes, after = advance(spark.createDataFrame([r for r in rows if low <= r[0] <= high], SCHEMA), state, shards=3)
        after.store(str(tmp_path / f"s{high}"))
        state = load_state(spark, str(tmp_path / f"s{high}"))
        got += [tuple(r) for r in changes.collect()]
        now = {r.k: r.ordinal for r in state.rows.collect()}
        assert ordinals.items() <= now.items() and state.last == high
        ordinals = now
    assert sorted(got) == whole
    with pytest.raises(ValueError):
        advance(spark.createDataFrame(rows[:1], SCHEMA), state)


def test_repeats_of_a_hot_key_are_combined_before_the_exchange(spark):
    hot = spark.range(30_000).selectExpr("1 + id % 2 as s", "7L as k", "if(id = 29999, 'new', 'old') as h", "if(id = 29999, '2026-01-02T00:00:00Z', '2026-01-01T00:00:00Z') as t")
    assert [tuple(r) for r in snapshot_changes(hot.toDF("snapshot_no", "page_id", "content_sha256", "updated_at")).collect()] == [(2, 7, "changed")]


SETS = st.one_of(st.sets(st.integers(0, 300_000), max_size=60), st.integers(0, 9).map(lambda k: set(range(k * 7000, k * 7000 + 6000))))


@settings(max_examples=60, deadline=None)
@given(SETS, SETS)
def test_bitmaps_are_sets(a, b):
    x, y = (OrdinalBitmap.of(np.array(sorted(s), np.int64)) for s in (a, b))
    assert set(x.to_array()) == a and len(x) == len(a)
    assert set(x.minus(y).to_array()) == a - b and set(x.intersect(y).to_array()) == a & b
