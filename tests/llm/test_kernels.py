import numpy as np
from hypothesis import given, settings, strategies as st

from docloom.llm import kernels
from docloom.llm.kernels import Words, distinct_sorted, groups_in_order, runs_of


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text(alphabet="aбÉé́_1 -.\n😀", max_size=40), max_size=6))
def test_words_and_their_hashes(texts):
    import re

    some = Words(texts)
    seen = {}
    for i, t in enumerate(texts):
        own = [some.word(k) for k in range(some.first[i], some.first[i + 1])]
        assert own == re.findall(r"\w+", kernels.fold(t))
        for k, w in enumerate(own):
            assert seen.setdefault(w, some.hash[some.first[i] + k]) == some.hash[some.first[i] + k]
    assert len(set(map(int, seen.values()))) == len(seen)


def test_long_texts_hash_as_short_ones(monkeypatch):
    text = " ".join(f"слово{k}" for k in range(3000))
    whole = Words([text, text]).hash
    monkeypatch.setattr(kernels, "BATCH_CHARS", 100)
    assert (Words([text, text]).hash == whole).all()


def test_runs_stay_inside_their_text():
    some = Words(["a b c d", "", "a b", "b c d e"])
    runs, begin = runs_of(some.hash, some.first, 3)
    assert np.diff(begin).tolist() == [2, 0, 0, 2] and runs[1] == runs[2] and len(set(runs.tolist())) == 3
    values, begin = distinct_sorted(np.array([3, 1, 3, 2, 2], np.uint64), np.array([0, 3, 3, 5]))
    assert values.tolist() == [1, 3, 2] and begin.tolist() == [0, 2, 2, 3]


def test_groups_come_whole_over_batches():
    import pyarrow as pa

    keys = [1, 1, 2, 2, 2, 3, 4, 4, 4, 4, 5]
    for size in (1, 2, 3, 11):
        batches = [pa.RecordBatch.from_pydict({"k": keys[i : i + size], "v": list(range(i, min(i + size, len(keys))))}) for i in range(0, len(keys), size)]
        tables = list(groups_in_order(batches, ["k"]))
        assert [v for t in tables for v in t["v"].to_pylist()] == list(range(len(keys)))
        owners = [set(t["k"].to_pylist()) for t in tables]
        assert sum(map(len, owners)) == 5
