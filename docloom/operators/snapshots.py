"""What changed between consecutive full snapshots of a table.

Keys get persistent ordinals inside key shards: a key keeps the ordinal it got in
the first snapshot that held it, in this run and in every later one, because the
ordinals are stored with the state. Per shard each snapshot is one compressed
bitmap of the ordinals present; AND-NOT of neighbours gives additions and
removals, AND gives the common keys whose ordinal-aligned hash vectors are then
compared. A new snapshot reads itself and the stored state, not the snapshots
before it.

The plan has one exchange (rows to their key shard); repeated rows of a key in a
snapshot are combined batch by batch before it, so a hot key is not one task's
load. A task goes through its rows in the order of snapshots and holds one
snapshot of its shard at a time. A hot source cannot skew a shard because shards
are taken from the key's hash.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions.text import instant_micros, strip_lower
from docloom.operators.bitmaps import OrdinalBitmap
from docloom.session import materialize

EARLIEST = -(2**63)
#: Stands for a row of the stored state among the rows of snapshots: before every snapshot.
STATE = -(2**31)
_ROW = "s int, k long, t long, known boolean, h1 long, h2 long, present boolean"


class SnapshotState(NamedTuple):
    """What later snapshots are compared with: ``rows`` has ``k, ordinal, known, h1, h2, present`` of every key ever seen."""

    rows: DataFrame
    last: int
    shards: int

    def store(self, path: str) -> None:
        self.rows.withColumns({"last": F.lit(self.last), "shards": F.lit(self.shards)}).write.parquet(path)


def load_state(spark: SparkSession, path: str) -> SnapshotState:
    """A stored state; ValueError where it is empty."""
    rows = spark.read.parquet(path)
    one = rows.select("last", "shards").first()
    if one is None:
        raise ValueError(f"no state in {path}")
    return SnapshotState(rows.drop("last", "shards"), one[0], one[1])


def advance(
    rows: DataFrame,
    state: SnapshotState | None = None,
    snapshot_col: str = "snapshot_no",
    key_col: str = "page_id",
    hash_col: str = "content_sha256",
    updated_col: str = "updated_at",
    keys_per_shard: int = 4096,
    shards: int | None = None,
) -> tuple[DataFrame, SnapshotState | None]:
    """Changes ``(snapshot_no, key, change)`` of the snapshots in ``rows`` and the state after them.

    Without ``state`` the first snapshot is only compared with; with it the
    snapshots must come after ``state.last``, and its shards stay. Otherwise as
    snapshot_changes. The state is None only if there is neither a state nor a row.
    """
    spark = rows.sparkSession
    data = rows.select(
        F.col(snapshot_col).cast("int").alias("s"),
        F.col(key_col).cast("long").alias("k"),
        F.coalesce(instant_micros(F.col(updated_col)), F.lit(EARLIEST)).alias("t"),
        (F.coalesce(strip_lower(F.col(hash_col)), F.lit("")) != "").alias("known"),
        F.xxhash64(strip_lower(F.col(hash_col))).alias("h1"),
        F.xxhash64(F.lit("second half"), strip_lower(F.col(hash_col))).alias("h2"),
        F.lit(True).alias("present"),
    ).where("s is not null and k is not null")
    none = spark.createDataFrame([], f"{snapshot_col} int, {key_col} long, change string")
    bounds = data.agg(F.min("s"), F.max("s"), F.approx_count_distinct("k")).first()
    if bounds[0] is None:
        return none, state
    first, last = int(bounds[0]), int(bounds[1])
    if state is not None and first <= state.last:
        raise ValueError(f"snapshot {first} is not after {state.last}")
    count = state.shards if state else shards or max(spark.sparkContext.defaultParallelism, -(-int(bounds[2]) // keys_per_shard))
    start = state.last + 1 if state else first
    compared_from = start if state else first + 1
    combined = data.mapInArrow(_combine, _ROW)
    if state is not None:
        combined = combined.union(state.rows.select(F.lit(STATE), "k", F.col("ordinal").cast("long"), "known", "h1", "h2", "present"))

    def run(batches):
        shard = _Shard()
        at = start
        for number, part in _by_snapshot(batches):
            if number == STATE:
                shard.restore(part)
                continue
            while at < number:  # snapshots without a row in this shard
                yield from shard.step(at, None, at >= compared_from)
                at += 1
            yield from shard.step(number, part, number >= compared_from)
            at = number + 1
        while at <= last:
            yield from shard.step(at, None, at >= compared_from)
            at += 1
        yield shard.rows()

    sharded = combined.repartition(count, "k").sortWithinPartitions("s")
    found = materialize(sharded.mapInArrow(run, "s int, k long, change string, ordinal int, known boolean, h1 long, h2 long, present boolean"))
    changes = found.where("change is not null").select(F.col("s").alias(snapshot_col), F.col("k").alias(key_col), "change")
    after = found.where("change is null").select("k", "ordinal", "known", "h1", "h2", "present")
    return changes, SnapshotState(after, last, count)


def snapshot_changes(rows: DataFrame, **options) -> DataFrame:
    """Rows ``(snapshot_no, key, change)``, change in added / removed / changed.

    Snapshot *s* is compared with *s - 1* for every s between the second and the
    last snapshot number of the table. Defined results:

    * several rows of a key in a snapshot: the latest instant of ``updated_at``
      counts, null, blank or unreadable times are earliest; equal instants: one of
      the known hashes by a fixed rule, a null hash last, so the result never
      depends on row order; full copies therefore count once;
    * hashes are compared without case and outer white space; a blank hash is a
      null hash, and a null hash means present with content unknown: it never
      makes a change, and the next known hash is compared with the last known
      one since the key was last added;
    * rows with a null key or a null snapshot number take no part;
    * a snapshot number without any row is an empty snapshot;
    * an empty table gives no rows; other columns are ignored, whatever names
      they carry.

    Options as in ``advance``, whose state this drops.
    """
    return advance(rows, **options)[0]


def _latest(s, k, t, known, h1, h2) -> np.ndarray:
    """Positions of the row that counts of every (snapshot, key)."""
    order = np.lexsort((h2, h1, known, t, k, s))
    s, k = s[order], k[order]
    return order[np.append((s[1:] != s[:-1]) | (k[1:] != k[:-1]), True)] if len(order) else order


def _columns(batch) -> list[np.ndarray]:
    return [batch.column(c).to_numpy(zero_copy_only=False) for c in ("s", "k", "t", "known", "h1", "h2")]


def _combine(batches):
    for batch in batches:
        if batch.num_rows:
            yield batch.take(pa.array(_latest(*_columns(batch))))


def _by_snapshot(batches):
    """(snapshot, its rows as one batch) in order, from batches ordered by snapshot."""
    held: list[pa.RecordBatch] = []

    def whole():
        return pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    for batch in batches:
        s = batch.column("s").to_numpy()
        cuts = np.concatenate(([0], np.flatnonzero(s[1:] != s[:-1]) + 1, [len(s)])) if len(s) else [0]
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            part = batch.slice(lo, hi - lo)
            if held and held[-1].column("s")[0].as_py() != int(s[lo]):
                yield held[-1].column("s")[0].as_py(), whole()
                held = []
            held.append(part)
    if held:
        yield held[-1].column("s")[0].as_py(), whole()


class _Shard:
    """The keys of one shard, aligned by ordinal, and the bitmap of those present in the snapshot before."""

    def __init__(self):
        self.keys = np.empty(0, np.int64)  # by ordinal
        self.hash = np.zeros((2, 0), np.int64)  # the last known one since the key was added
        self.known = np.zeros(0, bool)
        self.sorted = np.empty(0, np.int64)  # ordinals in the order of their keys
        self.before = OrdinalBitmap()

    def restore(self, part: pa.RecordBatch) -> None:
        _, k, ordinal, known, h1, h2 = _columns(part)
        order = np.argsort(ordinal)
        self.keys, self.known, self.hash = k[order], known[order].astype(bool), np.stack((h1[order], h2[order]))
        self.sorted = np.argsort(self.keys, kind="stable")
        self.before = OrdinalBitmap.of(np.flatnonzero(part.column("present").to_numpy(zero_copy_only=False)[order]))

    def ordinals(self, k: np.ndarray) -> np.ndarray:
        """Ordinals of distinct keys; new ones get the next numbers, in the order of the keys."""
        own = self.keys[self.sorted]
        place = np.minimum(np.searchsorted(own, k), max(len(own) - 1, 0))
        fresh = np.sort(k[own[place] != k]) if len(own) else np.sort(k)
        if len(fresh):
            self.keys = np.concatenate((self.keys, fresh))
            self.known = np.concatenate((self.known, np.zeros(len(fresh), bool)))
            self.hash = np.concatenate((self.hash, np.zeros((2, len(fresh)), np.int64)), axis=1)
            self.sorted = np.argsort(self.keys, kind="stable")
            own = self.keys[self.sorted]
        return self.sorted[np.searchsorted(own, k)]

    def step(self, number: int, part: pa.RecordBatch | None, tell: bool):
        if part is None:
            at, ok, hashes = np.empty(0, np.int64), np.empty(0, bool), np.empty((2, 0), np.int64)
        else:
            columns = _columns(part)
            _, k, _, known, h1, h2 = (c[_latest(*columns)] for c in columns)
            at, ok, hashes = self.ordinals(k), known.astype(bool), np.stack((h1, h2))
        now = OrdinalBitmap.of(np.sort(at))
        added, removed = now.minus(self.before).to_array(), self.before.minus(now).to_array()
        self.known[added] = False
        common = np.zeros(len(self.keys), bool)
        common[now.intersect(self.before).to_array()] = True
        moved = ok & common[at] & self.known[at] & (self.hash[:, at] != hashes).any(0)
        changed = at[moved]
        self.hash[:, at[ok]], self.known[at[ok]] = hashes[:, ok], True
        self.before = now
        for name, ordinals in (("added", added), ("removed", removed), ("changed", changed)):
            if tell and len(ordinals):
                n = len(ordinals)
                yield _batch(np.full(n, number, np.int32), self.keys[ordinals], pa.array([name] * n), ordinals, self.known[ordinals], self.hash[:, ordinals], np.ones(n, bool))

    def rows(self) -> pa.RecordBatch:
        n = len(self.keys)
        present = np.zeros(n, bool)
        present[self.before.to_array()] = True
        return _batch(np.full(n, STATE, np.int32), self.keys, pa.nulls(n, pa.string()), np.arange(n), self.known, self.hash, present)


def _batch(s, k, change, ordinal, known, hashes, present) -> pa.RecordBatch:
    names = ["s", "k", "change", "ordinal", "known", "h1", "h2", "present"]
    return pa.RecordBatch.from_arrays(
        [pa.array(s), pa.array(k), change, pa.array(np.asarray(ordinal).astype(np.int32)), pa.array(known), pa.array(hashes[0]), pa.array(hashes[1]), pa.array(present)], names=names
    )
