"""Exact top-k inner products by exhaustive term-at-a-time accumulation.

A vector's component number is a term, its integer value the weight. Candidates are packed, where they are read, into blocks
of at most ``BLOCK`` rows that hold postings (row numbers and weights) for each term; queries are packed into blocks too. For
each pair of a candidate block and a query block, a query's terms scatter their weighted postings into a dense score array of
the block, the k best are selected by partition, and the selections are merged: in the task over the blocks it meets, then
over all by a window whose input Spark cuts to k rows a query before the shuffle.

Only the stated query set is paired with all rows, block by block. The pairs of blocks form a grid: candidate blocks are dealt to rows of
cells by a hash of their first id and meet each query block in one cell, and queries go to all cells of their column, by an equi-join on the
cell. A cell holds about ``CELL`` candidate blocks and one query block, whatever the table's size, and each cell is a key of its own, so
the search spreads over as many tasks as there are cells. Nothing is broadcast.

Scores are 64-bit integers. Components are clipped to 64 bits and sums are taken modulo 2^64, which finite 32-bit
components of usual size never reach. Null or non-finite vectors take no part, nor do rows with a null id. Of several rows
with one id the least vector is the query; as candidates all count, except under the query's own id. Vectors of unlike length are
compared over the terms they share. An empty table gives no rows; further columns, whatever their names, are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, table

BLOCK, QUERY_BLOCK, CELL = 4096, 4096, 1
MAX_TASKS = 4096  # partitions of the grid; beyond that a task works on several cells
PACKED = "ids binary, weights binary, dims int, part int"


def _integers(values: np.ndarray, scale: float) -> np.ndarray:
    x = np.floor(values.astype(np.float64) * scale)
    return np.where(x >= 2.0**63, 2**63 - 1, np.where(x < -(2.0**63), -(2**63), np.clip(x, -(2.0**63), 2.0**63 - 1024))).astype(np.int64)


def _packed(rows: DataFrame, size: int, parts: int, scale: float) -> DataFrame:
    """Blocks of the ``id, vec`` rows; part: a number under ``parts``, dealt in turn."""
    schema = pa.schema([("ids", pa.binary()), ("weights", pa.binary()), ("dims", pa.int32()), ("part", pa.int32())])

    def run(batches):
        held: dict[int, list] = {}
        turn = 0

        def block(dims: int):
            nonlocal turn
            ids, vecs = zip(*held.pop(dims), strict=True)
            turn += 1
            ids, vecs = np.concatenate(ids), np.concatenate(vecs)
            return pa.RecordBatch.from_arrays([pa.array([ids.tobytes()], pa.binary()), pa.array([vecs.tobytes()], pa.binary()), pa.array([dims], pa.int32()), pa.array([(int(ids[0]) * 31 + turn) % parts], pa.int32())], schema=schema)

        for batch in batches:
            ids, vecs = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
            lengths = vecs.value_lengths().to_numpy(zero_copy_only=False)
            flat = vecs.flatten().to_numpy(zero_copy_only=False)
            starts = np.cumsum(lengths) - lengths
            for dims in np.unique(lengths):
                own = np.flatnonzero(lengths == dims)
                for k in range(0, len(own), size):
                    some = own[k : k + size]
                    vectors = _integers(flat[starts[some][:, None] + np.arange(dims)], scale)
                    held.setdefault(int(dims), []).append((ids[some].astype(np.int64), vectors))
                    if sum(len(x[0]) for x in held[dims]) >= size:
                        yield block(int(dims))
        for dims in list(held):
            yield block(dims)

    return rows.mapInArrow(run, PACKED)


def postings(weights: np.ndarray) -> list[tuple]:
    """For each term its rows and weights; a term that all rows hold needs no row numbers."""
    out = []
    for column in weights.T:
        rows = np.flatnonzero(column)
        out.append((slice(None), np.ascontiguousarray(column)) if len(rows) == len(column) else (rows, column[rows]))
    return out


def search_block(query: np.ndarray, lists: list[tuple], n: int) -> np.ndarray:
    """Dense scores of a block's n rows for one query."""
    scores = np.zeros(n, dtype=np.int64)
    for term in np.flatnonzero(query[: len(lists)]):
        rows, weights = lists[term]
        scores[rows] += query[term] * weights
    return scores


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest scores, ties to the smaller id."""
    if len(scores) > k:
        floor = np.partition(scores, len(scores) - k)[len(scores) - k]
        above, level = np.flatnonzero(scores > floor), np.flatnonzero(scores == floor)
        need = k - len(above)
        if len(level) > need:
            level = level[np.argpartition(ids[level], need - 1)[:need]] if need else level[:0]
        at = np.concatenate([above, level])
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], -scores[at]))]


FOUND = "query_id long, vec_id long, score long"


def exact_top_k(vectors: DataFrame, k: int = 10, scale: float = 1024.0, every: int = 100) -> DataFrame:
    """``query_id, rank, vec_id, score``: vectors is (vec_id, embedding); queries are the ids divisible by ``every``."""
    spark = vectors.sparkSession
    vec = F.col("embedding").cast("array<double>")
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("id"), vec.alias("vec")).filter(F.col("id").isNotNull() & F.col("vec").isNotNull() & finite)
    asked = rows.filter(F.col("id") % every == 0).groupBy("id").agg(F.min("vec").alias("vec"))
    scratch = Scratch(spark, "topk")
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("id") % every == 0).alias("asked")).first()
    parts = max(1, -(-size.asked // QUERY_BLOCK))
    bands = max(1, -(-size.n // (CELL * BLOCK)))
    tasks = min(MAX_TASKS, parts * bands)
    queries = scratch.keep(_packed(asked, QUERY_BLOCK, parts, scale))
    blocks = scratch.keep(_packed(rows, BLOCK, 1, scale))

    def dealt(side, band, part):
        """``side`` by cell, in a stated number of partitions, so that cells of few bytes and much work aren't joined together."""
        return side.withColumn("cell", (band * parts + part).cast("long")).repartition(tasks, "cell")

    band = F.pmod(F.xxhash64("ids"), F.lit(bands))
    c = dealt(blocks.withColumn("band", band).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))), F.col("band"), F.col("part"))
    q = dealt(queries.withColumn("band", F.explode(F.sequence(F.lit(0), F.lit(bands - 1)))), F.col("band"), F.col("part"))
    pairs = c.alias("c").join(q.alias("q").hint("merge"), F.col("c.cell") == F.col("q.cell")).select("c.ids", "c.weights", "c.dims", F.col("q.ids").alias("q_ids"), F.col("q.weights").alias("q_weights"), F.col("q.dims").alias("q_dims"))
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def run(batches):
        top: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        seen, lists = None, None

        def out():
            q = np.repeat(np.fromiter(top, dtype=np.int64, count=len(top)), [len(x[0]) for x in top.values()])
            ids, scores = (np.concatenate([x[i] for x in top.values()]) for i in (0, 1))
            top.clear()
            return pa.RecordBatch.from_arrays([pa.array(q), pa.array(ids), pa.array(scores)], schema=schema)

        for batch in batches:
            for r in range(batch.num_rows):
                c_ids, c_weights, dims, q_ids, q_weights, q_dims = (batch.column(i)[r].as_py() for i in range(6))
                ids = np.frombuffer(c_ids, dtype=np.int64)
                if (c_ids, c_weights) != seen:
                    seen, lists = (c_ids, c_weights), postings(np.frombuffer(c_weights, dtype=np.int64).reshape(len(ids), dims))
                asked_ids = np.frombuffer(q_ids, dtype=np.int64)
                for q, weights in zip(asked_ids.tolist(), np.frombuffer(q_weights, dtype=np.int64).reshape(len(asked_ids), q_dims), strict=True):
                    others = ids != q
                    scores = search_block(weights, lists, len(ids))
                    some_ids, some = (ids, scores) if others.all() else (ids[others], scores[others])
                    at = best(some, some_ids, k)
                    some_ids, some = some_ids[at], some[at]
                    if q in top:
                        some_ids, some = np.concatenate([top[q][0], some_ids]), np.concatenate([top[q][1], some])
                        at = best(some, some_ids, k)
                        some_ids, some = some_ids[at], some[at]
                    top[q] = (some_ids, some)
                if len(top) > 16 * QUERY_BLOCK:
                    yield out()
        if top:
            yield out()

    found = pairs.mapInArrow(run, FOUND)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark, sf_dir: str) -> DataFrame:
    return exact_top_k(table(spark, sf_dir, "embeddings"))


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS w FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
    CAST(list_sum(list_transform(list_zip(q.w, c.w), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS "rank", vec_id, score FROM s
)
SELECT query_id, "rank", vec_id, score FROM r WHERE "rank" <= 10
"""
