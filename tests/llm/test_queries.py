import pytest

from docloom.llm import queries

from .. import oracle

pytestmark = pytest.mark.skipif(not oracle.DATA.exists(), reason="the tables are not on this machine")


@pytest.fixture(scope="module")
def con():
    return oracle.connect(oracle.DATA)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_its_sql(spark, con, name):
    oracle.compare(spark, con, queries.QUERIES[name], queries.SQL[name])


def shares_sum_to_one(rows, keys, column):
    sums = {}
    for r in rows:
        key = tuple(r[k] for k in keys)
        sums[key] = sums.get(key, 0) + r[column]
    return all(abs(v - 1) < 1e-9 for v in sums.values())


#: What must hold of the rows of each query that SQL cannot give, on the smallest tables.
HOLDS = {
    "p2_pieces": lambda rows: rows and all(r.start < r.end and r.tokens > 0 and r.text for r in rows) and len({(r.item_kind, r.item_key, r.piece_no) for r in rows}) == len(rows),
    "p4_found": lambda rows: rows and all(r.chunk_id_a < r.chunk_id_b for r in rows) and len(set(rows)) == len(rows),
    "p4_neighbours": lambda rows: rows and all(1 <= r["rank"] <= 5 and r.chunk_id != r.neighbour_id and -1.001 <= r.cosine <= 1 for r in rows) and len({(r.chunk_id, r["rank"]) for r in rows}) == len(rows),
    "p7_selection": lambda rows: rows and all(r.copies >= 1 and r.tokens > 0 for r in rows) and len({(r.mix_id, r.doc_id) for r in rows}) == len(rows),
    "p7_shares": lambda rows: rows and shares_sum_to_one(rows, ["mix_id"], "reached_share"),
    "p7_marginals": lambda rows: rows and shares_sum_to_one(rows, ["mix_id", "axis"], "pool_share") and shares_sum_to_one(rows, ["mix_id", "axis"], "reached_share"),
    "p8_found": lambda rows: len(set(rows)) == len(rows),
    "p8_restored": lambda rows: all(r.damaged or r.mappings for r in rows) and len({r.doc_id for r in rows}) == len(rows),
}


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_other_queries_hold_what_they_must(spark, name):
    assert HOLDS[name](queries.QUERIES[name](spark, str(oracle.DATA)).collect())
