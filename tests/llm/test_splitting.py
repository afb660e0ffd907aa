import random

import numpy as np
from hypothesis import given, settings, strategies as st

from docloom.llm import splitting
from docloom.llm.splitting import Tokens, _split

TEXT = st.text(alphabet="ab é́и\n\r .#|!_1— 𝄞", max_size=400)


@settings(max_examples=150, deadline=None)
@given(TEXT, st.integers(1, 12), st.integers(0, 14))
def test_pieces_cover_the_text_within_the_maximum(text, maximum, overlap):
    some = Tokens([text])
    count = some.first[1] - some.first[0]
    pieces = list(_split([text], [maximum], [overlap]))
    if count <= maximum:
        assert not pieces
        return
    assert pieces[0][2] == 0 and pieces[-1][3] == len(text)
    for _, number, start, end, tokens, _ in pieces:
        own = Tokens([text[start:end]])
        assert own.first[1] - own.first[0] == tokens <= maximum
    shared = min(overlap, maximum - 1)
    for a, b in zip(pieces, pieces[1:]):
        own = Tokens([text[b[2] : a[3]]])
        assert b[2] <= a[3] and own.first[1] - own.first[0] == shared and b[3] > a[3]


def test_cuts_fall_on_natural_boundaries():
    rng = random.Random(1)
    topics = [[f"{t}word{k}" for k in range(12)] for t in "abcd"]
    text = ""
    for words in topics:
        text += "# Heading\n\n" + " ".join(f"{' '.join(rng.choices(words, k=9))}." for _ in range(8)) + "\n\n"
    pieces = list(_split([text], [130], [0]))
    assert {splitting.KINDS[p[5]] for p in pieces} <= {"heading", "end", "paragraph", "sentence"}
    assert sum(text[p[2] : p[3]].startswith("# Heading") for p in pieces) >= 3


def test_long_text_without_boundaries_is_cut_between_tokens():
    text = "x " * 20_000
    pieces = list(_split([text], [450], [50]))
    assert max(p[4] for p in pieces) == 450 and pieces[-1][3] == len(text)


def test_operator_handles_dirty_rows(spark):
    items = [("page", "1", "a b c d e f g h", "s"), ("page", "1", "a b c d e f g h", "s"), ("page", "2", None, "s"), ("page", "3", "", "s"), ("page", "4", "a b", "s")]
    items += [("page", "5", "a b c d e f", "unknown"), ("page", None, "a b c d e f", "s"), ("page", "6", "a b c d e f", None), ("chunk", "1", "a b c d e", "s")]
    df = spark.createDataFrame(items, "kind string, key string, text string, source string").selectExpr("*", "1 as maximum", "2 as overlap")
    limits = spark.createDataFrame([("s", 4, 1), ("n", None, None)], "source string, maximum int, overlap int")
    rows = splitting.split_oversized(df, limits).orderBy("item_kind", "item_key", "piece_no").collect()
    assert [(r.item_kind, r.item_key, r.text, r.tokens) for r in rows] == [
        ("chunk", "1", "a b c d ", 4), ("chunk", "1", "d e", 2),
        ("page", "1", "a b c d ", 4), ("page", "1", "d e f g ", 4), ("page", "1", "g h", 2),
    ]
    assert splitting.split_oversized(df.limit(0), limits).count() == 0 and splitting.split_oversized(df, limits.limit(0)).count() == 0


def test_two_texts_of_a_key_never_mix(spark):
    rows = [("page", "1", "a b c d e f g", "s"), ("page", "1", "x y z u v w", "s")] * 3
    df = spark.createDataFrame(rows, "kind string, key string, text string, source string")
    limits = spark.createDataFrame([("s", 3, 1)], "source string, maximum int, overlap int")
    pieces = splitting.split_oversized(df, limits)
    whole = {"a b c d e f g", "x y z u v w"}
    texts = [r.text for r in pieces.orderBy("piece_no").collect()]
    assert any(all(t in w for t in texts) for w in whole)
    row = splitting.piece_totals(pieces, limits).first()
    assert row.within and row.shared and row.tokens in (6, 7)


def test_valleys_of_long_texts_equal_those_of_one_slab(monkeypatch):
    rng = np.random.default_rng(2)
    cells = rng.integers(-1, splitting.CELLS, 3000).astype(np.int16)
    at = np.sort(rng.choice(np.arange(1, 3000), 400, replace=False))
    want = splitting.valley_depths(cells, at)
    monkeypatch.setattr(splitting, "SLAB", 97)
    assert np.allclose(splitting.valley_depths(cells, at), want, atol=1e-5)
