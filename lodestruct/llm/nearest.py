"""Nearest neighbours by inner product: a block matrix join on int8 tiles with error bounds."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._common import materialise, table

#: Rows of a candidate block and of a query block. A tile holds one of each and their int32-exact products.
ROWS, QUERIES = 2048, 512
#: Query blocks of a row of the grid and candidate blocks of a column, on average: what a cell holds, and how far it goes.
BAND, COLUMN = 16, 512
_BLOCK = pa.schema([("block", pa.int64()), ("n", pa.int32()), ("dim", pa.int32()), ("rows", pa.binary()), ("ids", pa.binary()), ("codes", pa.binary()), ("scales", pa.binary()), ("norms", pa.binary()), ("errors", pa.binary())])
_BLOCK_SQL = "block long, n int, dim int, rows binary, ids binary, codes binary, scales binary, norms binary, errors binary"
_NAMES = [f.name for f in _BLOCK]
_FOUND = pa.schema([("q_row", pa.int64()), ("query_id", pa.int64()), ("r_row", pa.int64()), ("vec_id", pa.int64()), ("low", pa.float64()), ("high", pa.float64())])


def usable(vector: Column) -> Column:
    """Not null, not all zero, no null or non-finite component."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return vector.isNotNull() & F.coalesce(fine, F.lit(False)) & F.exists(vector, lambda x: x != 0)


def quantise(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, the scale of each row, and the exact length of what rounding lost."""
    scale = np.abs(v).max(axis=1) / 127
    scale[scale == 0] = 1
    codes = np.rint(v / scale[:, None]).astype(np.int8)
    return codes, scale, np.linalg.norm(v - codes * scale[:, None], axis=1)


def _blocks(rows: int):
    """Blocks of (row, id, vector) rows of one length; they hold codes and bounds, not the vectors."""

    def make(part: int, k: int, at: list, ids: list, vectors: list) -> pa.RecordBatch:
        v = np.array(vectors, np.float64)
        codes, scale, lost = quantise(v)
        arrays = (np.array(at, np.int64), np.array(ids, np.int64), codes, scale, np.linalg.norm(v, axis=1), lost)
        return pa.RecordBatch.from_arrays([pa.array([(part << 32) + k]), pa.array([len(v)], pa.int32()), pa.array([v.shape[1]], pa.int32()), *[pa.array([x.tobytes()], pa.binary()) for x in arrays]], schema=_BLOCK)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, k, held = TaskContext.get().partitionId(), 0, {}
        for batch in it:
            for row, i, v in zip(*(batch.column(c).to_pylist() for c in range(3))):
                group = held.setdefault(len(v), ([], [], []))
                for own, x in zip(group, (row, i, v)):
                    own.append(x)
                if len(group[0]) == rows:
                    yield make(part, k, *held.pop(len(v)))
                    k += 1
        for group in held.values():
            yield make(part, k, *group)
            k += 1

    return run


class Block:
    """A block as it is read in a cell."""

    def __init__(self, row: dict) -> None:
        n, self.dim = row["n"], row["dim"]
        self.rows, self.ids = (np.frombuffer(row[c], np.int64) for c in ("rows", "ids"))
        self.scales, self.norms, self.errors = (np.frombuffer(row[c], np.float64) for c in ("scales", "norms", "errors"))
        kind = np.float32 if 127 * 127 * self.dim < 1 << 24 else np.float64
        self.codes = np.frombuffer(row["codes"], np.int8).reshape(n, self.dim).astype(kind)


def bounds(queries: Block, rows: Block) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest value that the inner product of each query and row can have.

    The int8 product is exact in float32 (at most 127 * 127 * dim < 2**24 up to 1040 dimensions, float64 beyond). It is
    off from the true product by at most |q| * error(x) + error(q) * (|x| + error(x)), and float rounding is added to
    that. Where these overflow nothing is known.
    """
    with np.errstate(over="ignore", invalid="ignore"):
        near = (queries.codes @ rows.codes.T).astype(np.float64) * queries.scales[:, None] * rows.scales
        slack = queries.norms[:, None] * rows.errors + queries.errors[:, None] * (rows.norms + rows.errors) + 1e-9 * queries.norms[:, None] * rows.norms
        low, high = near - slack, near + slack
    low[np.isnan(low)], high[np.isnan(high)] = -np.inf, np.inf
    return low, high


class Band:
    """A query block in a cell: the ``k`` greatest lower bounds of each query so far, and the pairs that may be among its ``k`` best."""

    def __init__(self, block: Block, k: int) -> None:
        self.block, self.k = block, k
        self.best = np.full((len(block.ids), k), -np.inf)
        self.pairs: list[tuple[np.ndarray, ...]] = []

    def tile(self, rows: Block) -> None:
        low, high = bounds(self.block, rows)
        own = self.block.ids[:, None] == rows.ids
        low[own] = -np.inf
        top = low if low.shape[1] <= self.k else np.partition(low, -self.k, axis=1)[:, -self.k :]
        self.best = np.partition(np.concatenate([self.best, top], axis=1), -self.k, axis=1)[:, -self.k :]
        q, r = np.nonzero((high >= self.best.min(axis=1)[:, None]) & ~own)
        self.pairs.append((q, rows.rows[r], rows.ids[r], low[q, r], high[q, r]))

    def survivors(self) -> pa.RecordBatch:
        q, row, ids, low, high = (np.concatenate(c) for c in zip(*self.pairs)) if self.pairs else [np.zeros(0, np.int64)] * 3 + [np.zeros(0)] * 2
        fits = high >= self.best.min(axis=1)[q]
        q = q[fits]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (self.block.rows[q], self.block.ids[q], row[fits], ids[fits], low[fits], high[fits])], schema=_FOUND)


def _cells(k: int):
    """Of each cell first come the query blocks of its band, then the candidate blocks of its column, one tile after the other."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, band = None, []
        for batch in it:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                if (row["band"], row["col"]) != cell:
                    for b in band:
                        yield b.survivors()
                    cell, band = (row["band"], row["col"]), []
                if row["side"] == 0:
                    band.append(Band(Block(row), k))
                else:
                    block = Block(row)
                    for b in band:
                        if b.block.dim == block.dim:
                            b.tile(block)
        for b in band:
            yield b.survivors()

    return run


def _scores(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Products in double, one component after the other, so equal vectors score equally."""
    for batch in it:
        q, r = batch.column(3), batch.column(4)
        size, score = np.diff(np.asarray(q.offsets)), np.zeros(batch.num_rows)
        for dim in np.unique(size).tolist():
            own = pa.array(np.flatnonzero(size == dim))
            a, b = (np.asarray(x.take(own).flatten()).reshape(-1, dim) for x in (q, r))
            with np.errstate(over="ignore", invalid="ignore"):
                score[size == dim] = np.add.accumulate(a * b, axis=1)[:, -1]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(score)], names=["q_row", "query_id", "vec_id", "score"])


def _heaps(k: int):
    """The ``k`` best rows of each query, whose rows follow one another; ties to the smaller id."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, query, heap = None, None, []

        def made() -> list[tuple]:
            return [(query, n, -r, s) for n, (s, r) in enumerate(sorted(heap, reverse=True), 1)]

        for batch in it:
            out = []
            for q, i, r, s in zip(*(c.to_pylist() for c in batch.columns)):
                if q != at:
                    out += made()
                    at, query, heap = q, i, []
                if len(heap) < k:
                    heapq.heappush(heap, (s, -r))
                elif (s, -r) > heap[0]:
                    heapq.heapreplace(heap, (s, -r))
            yield _ranked(out)
        yield _ranked(made())

    return run


def _ranked(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) or [()] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.float64()))], names=["query_id", "rank", "vec_id", "score"])


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", rows: int = ROWS, query_rows: int = QUERIES, band: int = BAND, column: int = COLUMN) -> DataFrame:
    """The ``k`` rows of ``vectors`` with greatest inner product for each row of ``queries``; exact, the tiles only prune.

    Returns (query_id, rank, vec_id, score), ties to the smaller id; a row is never its own neighbour. Rows whose id or
    vector is null, and vectors that are zero or hold null or non-finite components, take no part. Vectors of another
    length than the query's are not its candidates. Repeated ids are different rows. An empty side gives an empty
    result; other columns are not read.

    Blocks of codes and bounds meet in a grid: query blocks are dealt to its rows, candidate blocks to its columns, and
    a block is sent once to each cell of its row or column. What travels is so proportional to blocks times grid side,
    and vectors do not travel with it. A cell goes through its candidate blocks one by one and hands on the pairs whose
    upper bound reaches the k-th greatest lower bound. After the same test over all cells, only the survivors' vectors
    are joined; their products are computed again in double and merged by a heap for each query. Of equal vectors (by a
    hash of 128 bits) only those that can be among the best take part, which loses nothing: ties go to the smaller id.
    """
    spark = vectors.sparkSession

    def usable_rows(df: DataFrame) -> DataFrame:
        v = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
        return v.filter(F.col("id").isNotNull() & usable(F.col("v")))

    def numbered(df: DataFrame, name: str) -> DataFrame:
        return materialise(df.select(F.monotonically_increasing_id().alias("row"), "id", "v"), name)

    # of equal vectors only the first k + 1 ids, and of a repeated id k rows, can be among the k best of any query
    every = usable_rows(vectors).withColumns({"h1": F.xxhash64("v"), "h2": F.xxhash64(F.lit("v"), "v")})
    each = every.groupBy("h1", "h2", "id").agg(F.first("v").alias("v"), F.count("*").alias("c"))
    each = each.withColumn("place", F.row_number().over(W.partitionBy("h1", "h2").orderBy("id"))).filter(F.col("place") <= k + 1)
    each = each.select("id", "v", F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.col("c"), F.lit(k)))))
    right, left = numbered(each, "vectors"), numbered(usable_rows(queries), "queries")
    r = materialise(right.mapInArrow(_blocks(rows), _BLOCK_SQL), "vector_blocks")
    q = materialise(left.mapInArrow(_blocks(query_rows), _BLOCK_SQL), "query_blocks")
    width = spark.sparkContext.defaultParallelism
    bands = max(1, -(-q.count() // band))
    columns = max(1, -(-r.count() // column), -(-width // bands))  # at least a cell for each core
    q = q.select(F.pmod(F.xxhash64("block"), F.lit(bands)).alias("band"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(columns - 1).cast("long"))).alias("col"), F.lit(0).alias("side"), *_NAMES)
    r = r.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(bands - 1).cast("long"))).alias("band"), F.pmod(F.xxhash64("block"), F.lit(columns)).alias("col"), F.lit(1).alias("side"), *_NAMES)
    tasks = min(bands * columns, max(4 * width, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    cells = q.unionByName(r).repartition(tasks, "band", "col").sortWithinPartitions("band", "col", "side")
    found = cells.mapInArrow(_cells(k), "q_row long, query_id long, r_row long, vec_id long, low double, high double")

    by = W.partitionBy("q_row")
    bar = F.max(F.when(F.col("place") == k, F.col("low"))).over(by)  # of a query's survivors, at least k a cell
    found = found.withColumn("place", F.row_number().over(by.orderBy(F.col("low").desc()))).withColumn("bar", bar)
    found = found.filter(F.col("bar").isNull() | (F.col("high") >= F.col("bar"))).select("q_row", "query_id", "r_row", "vec_id")
    pairs = found.join(left.select(F.col("row").alias("q_row"), F.col("v").alias("q_v")), "q_row").join(right.select(F.col("row").alias("r_row"), F.col("v").alias("r_v")), "r_row")
    scored = pairs.select("q_row", "query_id", "vec_id", "q_v", "r_v").mapInArrow(_scores, "q_row long, query_id long, vec_id long, score double")
    return scored.repartition("q_row").sortWithinPartitions("q_row").mapInArrow(_heaps(k), "query_id long, rank int, vec_id long, score double")


def op5_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.filter("vec_id % 20 = 0"))


ORACLE = """
WITH v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
