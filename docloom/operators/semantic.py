"""Exact vector search for a stated set of queries, and normalization checks."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from docloom.functions.checks import require_count
from docloom.functions.vectors import is_usable
from docloom.operators.lexical import DIGITS, top_k
from docloom.operators.topk import Best
from docloom.session import materialize

#: Numbers of query vectors that travel at once (4 MB); a larger set takes more passes.
BLOCK_NUMBERS = 524_288
#: Vectors compared at once with all queries of a pass.
ROWS = 1024


def usable_vectors(vectors: DataFrame, id_col: str, vector_col: str, dim: int, time_col: str | None = None) -> DataFrame:
    """``(id, vector)``: usable vectors, of several of an id the latest (equal times: any one of equal copies)."""
    rows = vectors.where(F.col(id_col).isNotNull() & is_usable(F.col(vector_col), dim))
    when = F.col(time_col) if time_col else F.lit(0)
    return rows.groupBy(F.col(id_col).alias("id")).agg(F.max_by(vector_col, when).alias("vector"))


def exact_top_k(vectors: DataFrame, queries: DataFrame, k: int, dim: int) -> DataFrame:
    """``(query_id, id, cosine, rank)``: the ``k`` most similar other ids of every query, by brute force.

    ``vectors``: ``(id, vector)``; ``queries``: ``(query_id, vector)``, a stated
    set. Queries travel in blocks of bounded size; each block scans the vectors
    once and every task sends only its own best ``k`` per query. Cosines are
    double precision; ties (on nine digits) go to the smaller id.
    """
    require_count(k)
    spark = vectors.sparkSession
    blocks = max(1, -(-queries.count() // max(1, BLOCK_NUMBERS // dim)))
    parts = []
    for number in range(blocks):
        own = queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == number) if blocks > 1 else queries
        rows = own.select("query_id", "vector").collect()  # about BLOCK_NUMBERS numbers
        matrix = _unit(np.array([r[1] for r in rows], np.float64).reshape(-1, dim))
        shared = spark.sparkContext.broadcast(([r[0] for r in rows], matrix))
        found = _scan(vectors, queries, shared, k, dim)
        if blocks > 1:  # one block at a time on the driver and on the executors
            found = materialize(found)
            shared.destroy()
        parts.append(found)
    return top_k(reduce(DataFrame.union, parts), k, F.desc("cosine"), F.col("id"))


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1), 1e-300)[:, None]


def _scan(vectors: DataFrame, queries: DataFrame, shared, k: int, dim: int) -> DataFrame:
    """Each task's best ``(query_id, id, cosine)``."""
    kind, query_kind = (df.schema[c].dataType.simpleString() for df, c in ((vectors, "id"), (queries, "query_id")))
    id_type, query_type = (to_arrow_type(df.schema[c].dataType) for df, c in ((vectors, "id"), (queries, "query_id")))

    def scan(batches):
        names, q = shared.value
        if not names:
            return
        best = Best(len(names), k)
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS):
                part = batch.slice(lo, ROWS)
                ids = np.array(part.column(0).to_pylist())
                x = _unit(part.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim))
                scores = np.round(q @ x.T, DIGITS)
                wanted = np.ones(scores.shape, bool)
                here: dict = {}
                for j, name in enumerate(ids.tolist()):
                    here.setdefault(name, []).append(j)
                for i, name in enumerate(names):
                    if name in here:  # no query finds itself
                        wanted[i, here[name]] = False
                best.add(scores, ids, wanted)
        if (found := best.result()) is not None:
            query, score, ids = found
            yield pa.RecordBatch.from_arrays(
                [pa.array([names[i] for i in query.tolist()], query_type), pa.array(ids.tolist(), id_type), pa.array(score)], names=["query_id", "id", "cosine"]
            )

    return vectors.select("id", "vector").mapInArrow(scan, f"query_id {query_kind}, id {kind}, cosine double")
