import datetime as dt

import numpy as np

from docloom.llm import similar

SCHEMA = "chunk_id string, vector array<float>, embedded_at timestamp, node int"


def vectors(groups=40, per=6, dim=128, seed=0):
    rng = np.random.default_rng(seed)
    x = np.repeat(rng.normal(size=(groups, dim)), per, axis=0) + rng.normal(size=(groups * per, dim)) * 0.25
    return x.astype(np.float32)


def brute(ids, x, k, least):
    x = x / np.linalg.norm(x, axis=1)[:, None]
    s = np.round(x.astype(np.float64) @ x.T.astype(np.float64), 6)
    np.fill_diagonal(s, -2)
    return {(ids[i], ids[j]) for i in range(len(ids)) for j in np.lexsort((ids, -s[i]))[:k] if s[i, j] >= least}


def frame(spark, rows):
    return spark.createDataFrame([(i, v, t, 1) for i, v, t in rows], SCHEMA)


T0 = dt.datetime(2026, 1, 1)


def test_recall_against_brute_force(spark):
    x = vectors()
    ids = np.array([f"c{k:04d}" for k in range(len(x))])
    df = frame(spark, [(i, v.tolist(), T0) for i, v in zip(ids.tolist(), x)])
    for least, floor in ((0.85, 0.97), (-1.0, 0.9)):
        options = {} if least > 0 else {"tables": 3}
        got = {(r.id, r.other_id) for r in similar.most_similar(df.union(df), 5, least, **options).collect()}
        want = brute(ids, x, 5, least)
        assert len(got & want) >= floor * len(want)
        assert least < 0 or len(got - want) <= 0.02 * len(want)


def test_unusable_vectors_versions_and_copies(spark):
    x = vectors(4, 3)
    v = [r.tolist() for r in x]
    nan, inf = v[0][:], v[0][:]
    nan[3], inf[5] = float("nan"), float("inf")
    later = T0 + dt.timedelta(days=1)
    rows = [("a", v[0], T0), ("b", v[1], T0), ("c", v[2], T0), ("old", v[0], T0), ("old", v[6], later), ("none", None, T0), ("nan", nan, T0), ("inf", inf, T0)]
    rows += [("zero", [0.0] * 128, T0), ("short", v[0][:64], T0), (None, v[0], T0), ("undated", v[1], None), ("scaled", [2 * a for a in v[2]], T0)]
    rows += [(f"copy{k:02d}", v[9], T0) for k in range(12)]
    got = {}
    for r in similar.most_similar(frame(spark, rows), 5, 0.8).collect():
        got.setdefault(r.id, []).append((r.rank, r.other_id, r.cosine))
    assert {"none", "nan", "inf", "zero", "short"}.isdisjoint({o for rows in got.values() for _, o, _ in rows} | set(got))
    assert "old" not in {o for _, o, _ in got["a"]}  # its latest vector is another one
    assert [o for _, o, _ in sorted(got["copy11"])] == [f"copy{k:02d}" for k in range(5)]
    assert [o for _, o, _ in sorted(got["copy03"])] == ["copy00", "copy01", "copy02", "copy04", "copy05"]
    assert sorted(got["undated"])[0][1:] == ("b", 1.0) and sorted(got["scaled"])[0][1] == "c"


def test_empty_table(spark):
    assert similar.most_similar(frame(spark, [])).count() == 0


def test_crowded_cells_are_cut(monkeypatch):
    x = vectors(200, 12)
    x /= np.linalg.norm(x, axis=1)[:, None]
    row, other, score = similar.neighbours_within(x, 5, 0.8, 7, cell_rows=64)
    want = similar._brute(x, 5, 0.8)
    assert len(set(zip(row, other)) & set(zip(want[0], want[1]))) >= 0.95 * len(want[0])


def test_crowded_cells_are_compared_whole(spark):
    x = vectors(200, 12)
    x /= np.linalg.norm(x, axis=1)[:, None]
    for least in (0.8, -1.0):
        row, other, _ = similar.neighbours_within(x, 5, least, 7, cell_rows=64)
        want = similar._brute(x, 5, least)
        assert set(zip(row, other)) == set(zip(want[0], want[1]))
    df = frame(spark, [(f"c{k:04d}", v.tolist(), T0) for k, v in enumerate(x[:600])])
    whole, dealt = ({(r.id, r.other_id) for r in similar.most_similar(df, 5, -1.0, cell_rows=c).collect()} for c in (600, 4))
    assert dealt == whole


def test_hadamard_is_orthonormal():
    h = similar.hadamard(np.eye(16))
    assert np.allclose(h @ h.T, np.eye(16), atol=1e-6) and np.allclose(np.abs(h), 0.25)


def test_recall_of_the_production_parameters(spark):
    x = vectors(300, 8, seed=4)
    ids = np.array([f"c{k:04d}" for k in range(len(x))])
    got = {(r.id, r.other_id) for r in similar.most_similar(frame(spark, [(i, v.tolist(), T0) for i, v in zip(ids.tolist(), x)]), 5, 0.85, tables=2, probes=6, levels=2).collect()}
    want = brute(ids, x, 5, 0.85)
    assert len(got & want) >= 0.97 * len(want) and len(want) > 3000 and len(got - want) <= 0.02 * len(want)


def test_work_of_clustered_vectors_stays_near_linear():
    def compared(groups):
        x = vectors(groups, 10)
        x /= np.linalg.norm(x, axis=1)[:, None]
        sizes = np.unique(similar.table_cells(x, 0, 6, 2).ravel(), return_counts=True)[1].astype(float)
        return (sizes**2).sum()

    small, large = compared(500), compared(2000)
    assert large < 8 * small and large < 0.02 * 20_000**2


def test_cells_of_two_rotations_are_pairs_of_their_axes():
    x = np.random.default_rng(1).normal(size=(50, 64)).astype(np.float32)
    cells = similar.table_cells(x, 3, 5, 2)
    a, b = (similar.nearest_axes(x, (3 * 2 + level) * 31, 4) for level in range(2))
    assert (cells[:, 0] == a[:, 0] * 128 + b[:, 0]).all()
    assert all(len(set(row)) == 5 for row in cells.tolist())
    assert all(c // 128 in a[i] and c % 128 in b[i] for i, row in enumerate(cells.tolist()) for c in row)
