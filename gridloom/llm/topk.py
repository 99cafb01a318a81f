"""Exact top-k search by inner product with multi-resolution segment statistics.

Vectors are cut into segments. With a segment's mean and deviation, |q - x|^2 is at least
sum over segments of len * ((mean_q - mean_x)^2 + (dev_q - dev_x)^2); as the norms are known, that is an
upper bound of the inner product. Every query starts with its k-th score over a bounded set of first candidates.
Bounds are then taken from coarse to fine segments; a candidate whose bound is below the k-th score
found so far is out, and only those that no level rules out get their exact integer score.

Data vectors are packed into blocks, blocks into parts of bounded size. A part lies in one task and isn't moved again;
every block of queries is sent to every part, and the k-th scores it has found go with it from block to block
of the part. Nulls: vectors that are null or hold null or
non-finite components, and rows without id, take no part; vectors of another length than the query's
are no candidates; rows with the query's id count as its own row; repeated rows are candidates, and queries, each for itself, as in the SQL; other columns are not read. Ties go to
the smaller id. Empty tables return no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.base import written

#: Vectors of a block; most data blocks of a part; segments of the levels of bounds.
BLOCK, BLOCKS_A_PART, LEVELS = 2048, 64, (4, 16, 32)
#: Pairs whose exact scores are taken at once; vectors over which queries get their first k-th score.
PAIRS, FIRST = 1 << 16, 4096


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of vectors of one length: dim, n, ids, data (int64)."""
    held: dict[int, list[tuple[int, np.ndarray]]] = {}

    def block(dim: int) -> pa.RecordBatch:
        rows = held.pop(dim)
        ids, data = np.array([i for i, _ in rows], np.int64), np.array([x for _, x in rows], np.int64)
        return pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([len(rows)], pa.int32()), pa.array([ids.tobytes()]), pa.array([data.tobytes()])], ["dim", "n", "ids", "data"])

    for batch in batches:
        for i, x in zip(batch.column(0).to_pylist(), batch.column(1)):
            x = np.floor(256 * x.values.to_numpy(zero_copy_only=False).astype(np.float64)).astype(np.int64)
            held.setdefault(len(x), []).append((i, x))
            if len(held[len(x)]) == BLOCK:
                yield block(len(x))
    for dim in [*held]:
        yield block(dim)


def _matrix(dim: int, ids: bytes, data: bytes) -> tuple[np.ndarray, np.ndarray]:
    ids = np.frombuffer(ids, np.int64)
    return ids, np.frombuffer(data, np.int64).reshape(len(ids), dim)


def segment_statistics(x: np.ndarray, segments: int) -> np.ndarray:
    """For each row the means and deviations of its segments, each times the root of the segment's length."""
    edges = np.linspace(0, x.shape[1], min(segments, x.shape[1]) + 1).astype(int)[:-1]
    n = np.diff(np.r_[edges, x.shape[1]])
    mean = np.add.reduceat(x, edges, axis=1) / n
    spread = np.add.reduceat((x - np.repeat(mean, n, axis=1)) ** 2, edges, axis=1)
    return np.hstack([mean * np.sqrt(n), np.sqrt(spread)])


class Block:
    """Vectors by id, with their statistics of every level."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, levels: tuple[int, ...] = LEVELS):
        order = np.argsort(ids, kind="stable")
        self.ids, self.x = ids[order], x[order]
        plain = self.x.astype(np.float64)
        self.largest, self.norms = float(np.abs(plain).max(initial=0)), np.linalg.norm(plain, axis=1)
        self.levels = [segment_statistics(plain, n) for n in levels] if x.shape[1] else []

    def scored_as(self, other: Block) -> type:
        """Doubles, faster, while no sum of products can pass 2^53; else 64-bit integers."""
        return np.float64 if self.largest * other.largest * max(1, self.x.shape[1]) < 2.0**53 else np.int64


def search(queries: Block, data: Block, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query's place, candidate's place, exact score) of every pair whose score may be ``least`` of the query or more."""
    exact = queries.scored_as(data)
    q, x = queries.x.astype(exact), data.x.astype(exact)
    slack = 1e-9 * queries.norms[:, None] * data.norms[None, :] + 1e-6
    alive = queries.ids[:, None] != data.ids[None, :]
    for a, b in zip(queries.levels, data.levels):
        # Bounds of blocks are matrix products; candidates that no query has left are out of them.
        some = np.flatnonzero(alive.any(axis=0))
        alive[:, some] &= a @ b[some].T + slack[:, some] >= least[:, None]
    rows, cols = np.nonzero(alive)
    score = [np.einsum("pd,pd->p", q[rows[i : i + PAIRS]], x[cols[i : i + PAIRS]]).astype(np.int64) for i in range(0, len(rows), PAIRS)]
    return rows, cols, np.concatenate(score or [np.empty(0, np.int64)])


class Best:
    """The k best candidates of each query of a block so far; ties go to the smaller id."""

    def __init__(self, queries: Block, k: int, least: np.ndarray):
        self.queries, self.k, self.least, self.exact = queries, k, least.astype(np.float64), 0
        self.rows = self.ids = self.scores = np.empty(0, np.int64)

    def meet(self, data: Block) -> None:
        rows, cols, score = search(self.queries, data, self.least)
        self.exact += len(rows)
        stays = score >= self.least[rows]
        rows, ids, score = (np.r_[a, b] for a, b in ((self.rows, rows[stays]), (self.ids, data.ids[cols[stays]]), (self.scores, score[stays])))
        order = np.lexsort((ids, -score, rows))
        rows, ids, score = rows[order], ids[order], score[order]
        place = np.arange(len(rows)) - np.searchsorted(rows, rows)
        last = place == self.k - 1
        self.least[rows[last]] = np.maximum(self.least[rows[last]], score[last])
        kept = place < self.k
        self.rows, self.ids, self.scores = rows[kept], ids[kept], score[kept]


def first_scores(queries: Block, first: Block, k: int) -> np.ndarray:
    """For each query the k-th best exact score over ``first``, minus infinity if that has fewer candidates."""
    least = np.full(len(queries.ids), -np.inf)
    if len(first.ids) >= k and len(least):
        exact = queries.scored_as(first)
        scores = (queries.x.astype(exact) @ first.x.astype(exact).T).astype(np.float64)
        scores[queries.ids[:, None] == first.ids[None, :]] = -np.inf
        least = np.partition(scores, -k, axis=1)[:, -k]
    return least


def top_k(vectors: DataFrame, is_query, k: int, id_col: str = "vec_id", vector_col: str = "embedding", share: bool = False) -> DataFrame:
    """query_id, rank (from 1), id and score of the k best vectors for every row where ``is_query`` holds.

    With ``share``, instead, exact and pairs: how many pairs were scored exactly, and how many there are.
    """
    odd = F.exists(vector_col, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    valid = vectors.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull()).where(~odd)
    spark = vectors.sparkSession
    schema, columns = "dim int, n int, ids binary, data binary", [F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector")]
    queries = valid.where(is_query)
    n, n_queries = valid.count(), queries.count()
    shaped = lambda rows, total: rows.select(columns).repartition(max(1, -(-total // BLOCK))).mapInArrow(_blocks, schema)
    # Parts hold BLOCKS_A_PART blocks, or fewer if every core can then have its own.
    blocks = -(-n // BLOCK)
    parts = max(1, -(-blocks // BLOCKS_A_PART), min(blocks, 2 * spark.sparkContext.defaultParallelism))
    # Written once: a block's number has to stay the same for whoever reads it.
    data = written(shaped(valid, n).withColumn("part", (F.monotonically_increasing_id() % parts).cast("int")), "data-blocks")
    asked = written(shaped(queries, n_queries), "query-blocks")
    # At most FIRST vectors and a block, whatever the input; any vectors do, as scores over them only start the search.
    first: dict[int, list] = {}
    for dim, ids, x in data.select("dim", "ids", "data").limit(max(1, FIRST // BLOCK)).collect():
        first.setdefault(dim, []).append(_matrix(dim, ids, x))
    started = spark.sparkContext.broadcast({dim: tuple(np.concatenate(x) for x in zip(*found)) for dim, found in first.items()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = None, {}
        starts = {dim: Block(*found) for dim, found in started.value.items()}
        for batch in batches:
            for now, asks, dim, ids, x in zip(*(batch.column(c).to_pylist() for c in range(5))):
                if now != part:
                    part, held = now, {}
                if not asks:
                    held.setdefault(dim, []).append(Block(*_matrix(dim, ids, x)))
                    continue
                block = Block(*_matrix(dim, ids, x))
                least = first_scores(block, starts[dim], k) if dim in starts else np.full(len(block.ids), -np.inf)
                best = Best(block, k, least)
                for data_block in held.get(dim, ()):
                    best.meet(data_block)
                if share:
                    yield pa.RecordBatch.from_arrays([pa.array([best.exact], pa.int64()), pa.array([len(block.ids) * sum(len(b.ids) for b in held.get(dim, ()))], pa.int64())], ["exact", "pairs"])
                elif len(best.rows):
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (block.ids[best.rows], best.ids, best.scores)], ["query_id", "id", "score"])

    to_parts = F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part")
    both = data.select("part", F.lit(False).alias("asks"), "dim", "ids", "data").unionByName(asked.select(to_parts, F.lit(True).alias("asks"), "dim", "ids", "data"))
    met = both.repartitionById(parts, "part").sortWithinPartitions("part", "asks")
    if share:
        return met.mapInArrow(run, "exact long, pairs long").agg(F.sum("exact").alias("exact"), F.sum("pairs").alias("pairs"))
    found = met.mapInArrow(run, "query_id long, id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_col), "score")
