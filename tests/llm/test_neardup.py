import itertools
import random

import numpy as np
import pytest

from docloom.llm import neardup
from docloom.llm.components import components


def word_runs(text, size):
    words = text.lower().split()
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)}


def corpus(n=60, seed=3):
    rng = random.Random(seed)
    words = [f"word{k}" for k in range(400)]
    items = []
    for k in range(n):
        base = rng.choices(words, k=60)
        items.append(("page", f"b{k}", " ".join(base)))
        for v in range(rng.randrange(3)):
            edited = base[:]
            for _ in range(rng.randrange(1, 8)):
                edited[rng.randrange(len(edited))] = rng.choice(words)
            items.append(("page", f"b{k}v{v}", " ".join(edited)))
    items += [("page", "copy1", items[0][2]), ("chunk", "copy2", items[0][2]), ("page", "short", "a b c"), ("page", "empty", ""), ("page", "null", None), (None, None, "a b c d e f g h")]
    return items


SCHEMA = "kind string, key string, text string"


@pytest.mark.parametrize("words,threshold", [(3, 0.5), (5, 0.8)])
def test_pairs_match_brute_force(spark, words, threshold):
    items = corpus()
    df = spark.createDataFrame(items, SCHEMA)
    got = {tuple(r) for r in neardup.near_duplicate_pairs(df.union(df), words=words, threshold=threshold, least_words=8).collect()}
    want = set()
    sets = [(k, i, word_runs(t, words)) for k, i, t in items if k and t and len(t.split()) >= 8]
    for (k, i, a), (l, j, b) in itertools.combinations(sets, 2):
        if k == l and len(a & b) >= threshold * len(a | b):
            want.add((k, *sorted((i, j))))
    assert got == want
    assert ("page", "b0", "copy1") in got


def test_no_colliding_pair_of_the_threshold_is_dropped(spark):
    # Pairs of overlap 0.5 that share a table key although few of their minimum hashes agree.
    items = [("page", f"{s}{side}", " ".join(f"{s}x{i}" for i in at)) for s in (952, 6558, 11428) for side, at in (("a", range(44)), ("b", [*range(30), *range(50, 64)]))]
    got = {tuple(r) for r in neardup.near_duplicate_pairs(spark.createDataFrame(items, SCHEMA), words=3, threshold=0.5, least_words=8).collect()}
    assert got == {("page", f"{s}a", f"{s}b") for s in (952, 6558, 11428)}


def test_groups_hold_every_item_once(spark):
    df = spark.createDataFrame(corpus(), SCHEMA)
    rows = {(r.kind, r.key): r for r in neardup.near_duplicate_groups(df, words=3, threshold=0.5, least_words=8).collect()}
    assert rows["page", "copy1"].group_id == rows["page", "b0"].group_id == "b0"
    assert rows["page", "b0"].copies == 2 and rows["chunk", "copy2"].copies == 1 and rows["chunk", "copy2"].group_id == "copy2"
    assert ("page", "short") not in rows and ("page", "null") not in rows


def test_many_copies_cost_one_node(spark):
    text = " ".join(f"w{k}" for k in range(30))
    df = spark.range(3000).selectExpr("'page' as kind", "cast(id as string) as key", f"'{text}' as text", "id as node", "id as n")
    rows = neardup.near_duplicate_groups(df).collect()
    assert len(rows) == 3000 and {r.group_id for r in rows} == {"0"} and {r.copies for r in rows} == {3000} and {r.links for r in rows} == {0}


def test_empty_table(spark):
    assert neardup.near_duplicate_pairs(spark.createDataFrame([], SCHEMA)).count() == 0
    assert neardup.near_duplicate_groups(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("radius", [1, 2, 3])
def test_covering_masks_cover_the_radius(radius):
    size = 2 ** (radius + 1) - 1
    masks = neardup.covering_masks(radius)
    for differing in itertools.combinations(range(size), radius):
        assert any(not set(mask) & set(differing) for mask in masks)


def test_every_pair_within_the_radius_collides_in_two_blocks():
    rng = np.random.default_rng(0)
    blocks = 14
    for _ in range(300):
        x = rng.integers(0, 2**64, (1, 3 * blocks), dtype=np.uint64)
        y = x.copy()
        y[0, rng.permutation(3 * blocks)[: 2 * blocks - 3]] += np.uint64(1)
        same = (neardup.table_keys(x) == neardup.table_keys(y)).reshape(blocks, -1).any(1)
        assert same.sum() >= neardup.LEAST_BLOCKS


def test_components_of_chains_and_stars(spark):
    edges = [(k, k + 1) for k in range(0, 40)] + [(100, k) for k in range(101, 160)] + [(500, 500)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(41)}, **{k: 100 for k in range(100, 160)}}
