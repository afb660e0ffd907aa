"""Seams for models: encoders of passages and scorers of pairs, loaded once per Python worker."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def encode(rows: DataFrame, text: str, load: Callable[[], Callable[[list[str]], np.ndarray]], batch: int = 16) -> DataFrame:
    """Adds ``vector``: the unit-length encoding of a text column.

    ``load()`` runs once per worker and returns a function from texts to a matrix
    with one row each. A row that isn't finite, or is all zero, fails the job; a
    null text has a null vector.
    """

    @F.pandas_udf("array<float>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for part in parts:
            out: list = [None] * len(part)
            at = [i for i, t in enumerate(part) if t is not None]
            for lo in range(0, len(at), batch):
                mine = at[lo : lo + batch]
                x = np.asarray(model([part.iloc[i] for i in mine]), np.float64)
                size = np.linalg.norm(x, axis=1)
                if x.shape[0] != len(mine) or not np.isfinite(x).all() or not size.all():
                    raise ValueError("the encoder gave an unusable vector")
                for i, row in zip(mine, (x / size[:, None]).astype(np.float32)):
                    out[i] = row
            yield pd.Series(out)

    return rows.withColumn("vector", run(text))


def score_pairs(rows: DataFrame, left: str, right: str, load: Callable[[], Callable[[str, str], float]]) -> DataFrame:
    """Adds ``score`` of every pair of texts, one pair at a time; a score that isn't finite fails the job."""

    @F.pandas_udf("double")
    def run(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = load()
        for a, b in parts:
            scores = [float(model(x, y)) for x, y in zip(a, b)]
            if not np.isfinite(scores).all():
                raise ValueError("the scorer gave a score that isn't finite")
            yield pd.Series(scores, dtype="float64")

    return rows.withColumn("score", run(left, right))
