"""The k most similar vectors of every vector, by multiprobe cross-polytope hashing.

Unit vectors are turned by three rounds of random signs and fast Hadamard
transforms and assigned to the nearest signed axes: the nearest axis (or the pair
of nearest axes of two rotations) is the home cell, the next ones are its probes.
Rows sit in ``probes`` cells of every table, so two vectors meet when any of these
agree. A cell is always
compared whole, so how crowded it is changes no result: its rows are dealt to
blocks of bounded size, and every pair of blocks is a task of its own. The
vectors travel as 16-bit fixed-point numbers (cosine error about 4e-6).

Vectors that are equal after normalization are one node: copies cost one row and
are expanded only in the result.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm.kernels import groups_in_order, mix64, signed
from docloom.session import materialize, parallelism

#: Rows of a block. A cell of more is dealt to several blocks, and each row travels once per block of its cell.
CELL_ROWS = 65536
#: Axes of each rotation that a cell of several rotations is made of.
AXES = 4
#: Rows and columns of cosines held at once.
TILE_ROWS, TILE_COLS = 512, 8192


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of each row (length a power of two), orthonormal."""
    x = np.array(x, np.float32)
    n, d = x.shape
    h = 1
    while h < d:
        y = x.reshape(n, d // (2 * h), 2, h)
        left = y[:, :, 0] + y[:, :, 1]
        y[:, :, 1] = y[:, :, 0] - y[:, :, 1]
        y[:, :, 0] = left
        h *= 2
    return x / np.float32(np.sqrt(d))


@functools.cache
def _signs(seed: int, dim: int) -> np.ndarray:
    bits = mix64(np.arange(3 * dim, dtype=np.uint64) + np.uint64(1_000_003 * (seed + 1)))
    return np.where(bits & np.uint64(1), 1, -1).astype(np.float32).reshape(3, dim)


def ranked_axes(x: np.ndarray, seed: int, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``count`` nearest signed axes of each row after pseudo-rotation ``seed``, nearest first, and the row's parts along them."""
    for s in _signs(seed, x.shape[1]):
        x = hadamard(x * s)
    size = np.abs(x)
    count = min(count, x.shape[1])
    near = np.argpartition(-size, count - 1, axis=1)[:, :count]
    near = np.take_along_axis(near, np.argsort(-np.take_along_axis(size, near, 1), axis=1, kind="stable"), 1)
    return near * 2 + (np.take_along_axis(x, near, 1) < 0), np.take_along_axis(size, near, 1)


def nearest_axes(x: np.ndarray, seed: int, probes: int) -> np.ndarray:
    return ranked_axes(x, seed, probes)[0]


def table_cells(x: np.ndarray, table: int, probes: int, levels: int) -> np.ndarray:
    """The ``probes`` cells of each row in a table: one axis of each of ``levels`` rotations, those with the largest parts in sum first."""
    cells, parts = np.zeros((len(x), 1), np.int64), np.zeros((len(x), 1), np.float32)
    for level in range(levels):
        axes, size = ranked_axes(x, (table * levels + level) * 31, probes if levels == 1 else min(probes, AXES))
        cells = (cells[:, :, None] * (2 * x.shape[1]) + axes[:, None, :]).reshape(len(x), -1)
        parts = (parts[:, :, None] + size[:, None, :]).reshape(len(x), -1)
        best = np.argsort(-parts, axis=1, kind="stable")[:, :probes]
        cells, parts = np.take_along_axis(cells, best, 1), np.take_along_axis(parts, best, 1)
    return cells


def blocks_of(nodes: np.ndarray, salt, blocks) -> np.ndarray:
    """Block of each row in its cell: rows are dealt evenly, in another way for every salt."""
    return (mix64(nodes.astype(np.uint64) + mix64(np.atleast_1d(np.asarray(salt, np.uint64)) + np.uint64(1))) % np.asarray(blocks, np.uint64)).astype(np.int64)


def pair_number(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Number of the unordered pair of blocks a and b."""
    low, high = np.minimum(a, b), np.maximum(a, b)
    return high * (high + 1) // 2 + low


def neighbours_within(x: np.ndarray, k: int, least: float, salt: int, cell_rows: int = CELL_ROWS):
    """(row, neighbour row, cosine) of the best ``k`` of every row among all these rows, in pairs of blocks."""
    blocks = -(-len(x) // cell_rows)
    block = blocks_of(np.arange(len(x)), salt, blocks) if blocks else np.empty(0, int)
    found = [(np.empty(0, int), np.empty(0, int), np.empty(0, np.float32))]
    for b in range(blocks):
        for a in range(b + 1):
            rows = np.flatnonzero((block == a) | (block == b))
            part = compared(x[rows], block[rows], k, least)
            found.append((rows[part[0]], rows[part[1]], part[2]))
    return best_per_row(*(np.concatenate(c) for c in zip(*found)), k)


def compared(x: np.ndarray, block: np.ndarray, k: int, least: float):
    """One task: all rows of a single block with each other, or the rows of two blocks with those of the other."""
    if not len(x) or (block == block[0]).all():
        return _brute(x, k, least)
    a, b = np.flatnonzero(block == block[0]), np.flatnonzero(block != block[0])
    found = []
    for own, other in ((a, b), (b, a)):
        row, col, score = _nearest(x[own], x[other], k, least, False)
        found.append((own[row], other[col], score))
    return best_per_row(*(np.concatenate(c) for c in zip(*found)), k)


def _brute(x: np.ndarray, k: int, least: float):
    return _nearest(x, x, k, least, True)


def _nearest(x: np.ndarray, y: np.ndarray, k: int, least: float, same: bool):
    """(row of x, row of y, cosine) of the best ``k`` rows of y for every row of x; ``same``: x is y, no row meets itself."""
    found = [(np.empty(0, int), np.empty(0, int), np.empty(0, np.float32))]
    for lo in range(0, len(x), TILE_ROWS):
        rows = x[lo : lo + TILE_ROWS]
        floor = np.full(len(rows), max(least, -1.5), np.float32)
        parts = []
        for at in range(0, len(y), TILE_COLS):
            near = rows @ y[at : at + TILE_COLS].T
            if same:
                own = np.arange(max(lo, at), min(lo + len(rows), at + near.shape[1]))
                near[own - lo, own - at] = -2
            passing = near >= floor[:, None]
            if near.shape[1] > k and np.count_nonzero(passing) > 16 * k * len(rows):
                # The k-th best of some columns is a bound on the k-th best of all: nothing below it can come out.
                some = near[:, : max(2048, k + 1)]
                floor = np.maximum(floor, np.partition(some, some.shape[1] - k, axis=1)[:, some.shape[1] - k])
                passing = near >= floor[:, None]
            row, col = np.nonzero(passing)
            parts.append((row + lo, col + at, near[row, col]))
        found.append(best_per_row(*(np.concatenate(c) for c in zip(*parts)), k))
    return tuple(np.concatenate(c) for c in zip(*found))


def best_per_row(row, other, score, k: int):
    """Distinct neighbours, the ``k`` best of each row; equal scores: smaller number first."""
    order = np.lexsort((-score, other, row))
    row, other, score = row[order], other[order], score[order]
    fresh = np.ones(len(row), bool)
    fresh[1:] = (row[1:] != row[:-1]) | (other[1:] != other[:-1])
    row, other, score = row[fresh], other[fresh], score[fresh]
    order = np.lexsort((other, -score, row))
    row, other, score = row[order], other[order], score[order]
    keep = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[keep], other[keep], score[keep]


def usable(batch: pa.RecordBatch, dim: int):
    """Positions and unit float32 vectors of a batch's usable vectors (first column)."""
    column = batch.column(batch.schema.get_field_index("vector"))
    sizes = column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    at = np.flatnonzero(sizes == dim)
    if not len(at):
        return at, np.empty((0, dim), np.float32)
    flat = column.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    good = np.isfinite(flat).all(1) & (flat != 0).any(1)
    flat, at = flat[good], at[good]
    flat /= np.abs(flat).max(1)[:, None]
    return at, (flat / np.sqrt((flat * flat).sum(1))[:, None]).astype(np.float32)


def pack(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    scale = np.abs(x).max(1) / 32767
    return np.rint(x / scale[:, None]).astype(np.int16), scale.astype(np.float32)


def _fixed(values: np.ndarray) -> pa.Array:
    width = values.shape[1] * values.dtype.itemsize
    offsets = np.arange(len(values) + 1, dtype=np.int32) * width
    return pa.Array.from_buffers(pa.binary(), len(values), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))])


def _joined(column: pa.ChunkedArray, dtype, width: int) -> np.ndarray:
    array = column.combine_chunks()
    if isinstance(array, pa.ChunkedArray):
        array = array.chunk(0)
    offsets = np.frombuffer(array.buffers()[1], np.int32)[array.offset : array.offset + len(array) + 1]
    return np.frombuffer(array.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].view(dtype).reshape(-1, width)


def vector_nodes(vectors: DataFrame, dim: int, id_col: str, time_col: str, with_codes: bool) -> DataFrame:
    """Each usable vector's id, time and node (hash of its unit form) and, if asked for, its packed numbers."""

    def run(batches):
        for batch in batches:
            at, x = usable(batch, dim)
            if not len(at):
                continue
            raw = memoryview(x).cast("B")
            nodes = np.fromiter((xxhash.xxh3_64_intdigest(raw[i * dim * 4 : (i + 1) * dim * 4]) for i in range(len(x))), np.uint64, len(x))
            taken = batch.take(pa.array(at))
            columns, names = [taken.column(0), taken.column(1), pa.array(signed(nodes))], ["id", "t", "node"]
            if with_codes:
                codes, scale = pack(x)
                columns += [_fixed(codes), pa.array(scale)]
                names += ["codes", "scale"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    key = F.xxhash64(id_col) if with_codes else F.col(id_col)
    rows = vectors.where(F.col(id_col).isNotNull()).select(
        key.alias("id"), F.coalesce(F.unix_micros(F.col(time_col).cast("timestamp")), F.lit(-(2**63))).alias("t"), "vector"
    )
    kind = "long" if with_codes else "string"
    return rows.mapInArrow(run, f"id {kind}, t long, node long" + (", codes binary, scale float" if with_codes else ""))


def cell_blocks(vectors: DataFrame, dim: int, id_col: str, tables: int, probes: int, levels: int, cell_rows: int) -> np.ndarray:
    """Number of blocks of every cell of every table, at least 1, by counting the rows before versions and copies are dropped."""

    size = (2 * dim) ** levels

    def run(batches):
        counts = np.zeros(tables * size, np.int64)
        for batch in batches:
            _, x = usable(batch, dim)
            for t in range(tables if len(x) else 0):
                counts[t * size : (t + 1) * size] += np.bincount(table_cells(x, t, probes, levels).ravel(), minlength=size)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], names=["cell", "n"])

    counted = vectors.where(F.col(id_col).isNotNull()).select("vector").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    blocks = np.ones(tables * size, np.int64)
    crowded = counted.where(F.col("n") > cell_rows).collect()  # one row a cell at most, whatever the data
    for row in crowded:
        blocks[row["cell"]] = -(-row["n"] // cell_rows)
    return blocks


def node_neighbours(vectors: DataFrame, k: int, least: float, dim: int, id_col: str, time_col: str, tables: int, probes: int, levels: int, cell_rows: int) -> DataFrame:
    """``(node, other, cosine)``: the best ``k`` other nodes of every node, in one row per neighbour."""
    spark = vectors.sparkSession
    parts = parallelism(spark)
    blocks = cell_blocks(vectors, dim, id_col, tables, probes, levels, cell_rows)
    first = np.concatenate(([0], np.cumsum(blocks * (blocks + 1) // 2)))  # first task of each cell
    versions = vector_nodes(vectors, dim, id_col, time_col, True).repartition(parts, "id").sortWithinPartitions("id", F.desc("t"), F.desc("node"))

    def newest(batches):
        last = None
        for batch in batches:
            ids = batch.column(0).to_numpy()
            fresh = np.ones(len(ids), bool)
            fresh[1:] = ids[1:] != ids[:-1]
            if last is not None and len(ids):
                fresh[0] = ids[0] != last
            if len(ids):
                last = ids[-1]
            batch = batch.filter(pa.array(fresh))
            if not batch.num_rows:
                continue
            node = batch.column(2).to_numpy()
            _, one = np.unique(node, return_index=True)  # copies combine before the exchange
            batch = batch.take(pa.array(one))
            yield batch.select(["node", "codes", "scale"])

    nodes = materialize(versions.mapInArrow(newest, "node long, codes binary, scale float"))

    def to_cells(batches, t):
        for batch in batches:
            if not batch.num_rows:
                continue
            node, scale = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            x = _joined(pa.chunked_array([batch.column(1)]), np.int16, dim) * scale[:, None]
            cells = table_cells(x, t, probes, levels) + t * (2 * dim) ** levels
            for p in range(cells.shape[1]):
                cell = cells[:, p]
                block = blocks_of(node, cell, blocks[cell])
                for other in range(blocks[cell].max()):
                    at = np.flatnonzero(other < blocks[cell])
                    task = first[cell[at]] + pair_number(block[at], np.full(len(at), other))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(task), pa.array(block[at].astype(np.int32)), *batch.take(pa.array(at)).columns],
                        names=["task", "block", "node", "codes", "scale"],
                    )

    def search(batches):
        for table in groups_in_order(batches, ["task"]):
            task, block, node, scale = (table[c].to_numpy() for c in ("task", "block", "node", "scale"))
            codes = _joined(table["codes"], np.int16, dim)
            cuts = np.concatenate(([0], np.flatnonzero(task[1:] != task[:-1]) + 1, [len(task)]))
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                own, one = np.unique(node[lo:hi], return_index=True)
                if len(own) < 2:
                    continue
                x = codes[lo:hi][one] * scale[lo:hi][one][:, None]
                row, other, score = compared(x, block[lo:hi][one], k, least)
                if len(row):
                    yield _lists(own, row, other, score)

    found = []
    for t in range(tables):  # the copies that meet in one table's cells are gone before the next table's are made
        copies = nodes.mapInArrow(functools.partial(to_cells, t=t), "task long, block int, node long, codes binary, scale float")
        met = copies.repartition(parts, "task").sortWithinPartitions("task")
        found.append(materialize(met.mapInArrow(search, "node long, found binary")))
    lists = functools.reduce(DataFrame.union, found).repartition(parts, "node").sortWithinPartitions("node")

    def merge(batches):
        for table in groups_in_order(batches, ["node"]):
            node = table["node"].to_numpy()
            array = table["found"].combine_chunks()
            found = np.frombuffer(b"".join(v.as_py() for v in array), _ENTRY)
            per = np.fromiter((len(v.as_buffer()) // _ENTRY.itemsize for v in array), np.int64, len(array))
            row, other, score = best_per_row(np.repeat(node, per), found["node"], found["cosine"], k)
            yield pa.RecordBatch.from_arrays([pa.array(row), pa.array(other), pa.array(np.minimum(score, 1))], names=["node", "other", "cosine"])

    return lists.mapInArrow(merge, "node long, other long, cosine float")


_ENTRY = np.dtype([("node", "<i8"), ("cosine", "<f4")])


def _lists(own: np.ndarray, row: np.ndarray, other: np.ndarray, score: np.ndarray) -> pa.RecordBatch:
    entries = np.empty(len(row), _ENTRY)
    entries["node"], entries["cosine"] = own[other], score
    who, begin = np.unique(row, return_index=True)
    offsets = (np.append(begin, len(row)) * _ENTRY.itemsize).astype(np.int32)
    packed = pa.Array.from_buffers(pa.binary(), len(who), [None, pa.py_buffer(offsets), pa.py_buffer(entries.tobytes())])
    return pa.RecordBatch.from_arrays([pa.array(own[who]), packed], names=["node", "found"])


def most_similar(
    vectors: DataFrame,
    k: int = 5,
    least: float = -1.0,
    dim: int = 128,
    id_col: str = "chunk_id",
    time_col: str = "embedded_at",
    tables: int = 1,
    probes: int = 4,
    levels: int = 1,
    cell_rows: int = CELL_ROWS,
) -> DataFrame:
    """``(id, other_id, rank, cosine)``: for every id its ``k`` most similar other ids, best first.

    Usable vectors have ``dim`` finite numbers that are not all zero; of several
    usable rows of an id the latest ``time_col`` counts (null is earliest; equal
    times: one of the vectors by a fixed rule), so repeated rows count once.
    Equal cosines: smaller id first; ids of equal vectors have cosine 1. Only
    neighbours of cosine ``least`` or more come out. More ``tables`` and
    ``probes`` find more of the distant neighbours; more ``levels`` (rotations that
    must agree) make smaller cells, which takes more tables for the same recall;
    ``cell_rows`` bounds the work of one task and changes no result. Null ids and unusable
    vectors take no part, an empty table gives no rows, other columns are
    ignored. Recall is below 1 (README), all else is exact.
    """
    newest = vector_nodes(vectors, dim, id_col, time_col, False).groupBy("id").agg(F.max(F.struct("t", "node")).alias("m"))
    members = materialize(newest.select("id", F.col("m.node").alias("node")))
    ranked_members = members.withColumn("r", F.row_number().over(Window.partitionBy("node").orderBy("id"))).where(F.col("r") <= k + 1)
    classes = ranked_members.groupBy("node").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    near = node_neighbours(vectors, k, least, dim, id_col, time_col, tables, probes, levels, cell_rows)
    others = near.join(classes.withColumnRenamed("node", "other"), "other").select("node", F.explode("ids").alias("other_id"), "cosine")
    copies = classes.where(F.size("ids") > 1).select("node", F.explode("ids").alias("other_id"), F.lit(1.0).cast("float").alias("cosine"))
    order = Window.partitionBy("node").orderBy(F.desc("cosine"), "other_id")
    best = (
        others.union(copies)
        .withColumn("r", F.row_number().over(order))
        .where(F.col("r") <= k + 1)
        .groupBy("node")
        .agg(F.array_sort(F.collect_list(F.struct("r", "other_id", "cosine"))).alias("best"))
    )
    own = members.join(best, "node").select("id", F.slice(F.filter("best", lambda x: x.other_id != F.col("id")), 1, k).alias("best"))
    return own.select("id", F.posexplode("best").alias("p", "b")).select(
        "id", F.col("b.other_id").alias("other_id"), (F.col("p") + 1).alias("rank"), F.col("b.cosine").cast("double").alias("cosine")
    )
