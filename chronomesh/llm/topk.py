"""Exact top-k search by inner product with pivot-table elimination.

A table keeps each vector's distances to a few pivots. The triangle inequality gives a lower bound
on the distance of a query and a candidate from each pivot; the greatest of them, with the
norms, bounds their inner product from above. Candidates are evaluated in the order of that
bound until the next one lies below the k-th score found, so no score is missed. Bounds are
floats, widened by all that rounding can take away; scores are exact integers.

Queries go through in blocks, each of which every partition of candidates meets once. A block
has at most QUERIES rows and BLOCK_VALUES components; it, its PIVOTS vectors and a floor for
each query are all that is sent out. The floor is the k-th best score among SEED of the block's
own vectors, which are candidates too, so every partition prunes from its first row on. A
partition gives at most k rows a query.

Components become floor(scale * x) with x as double, integers of any size; a score that doesn't fit
a long is ranked by its exact value and given as the nearest long. Vectors that are null
or hold nulls or values that are not finite take no part, nor do rows without an id. A query meets
candidates of its own length; empty vectors meet each other with score 0. Rows that
repeat an id are candidates of their own; a repeated query id is one query, its least vector. An
empty table gives an empty result. Further columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import map_arrow, settle, small_batches, table

SCALE, K, EVERY = 1024, 10, 100
PIVOTS, QUERIES, BLOCK_VALUES, SEED = 24, 4_096, 1 << 22, 512
#: Candidates, and components of them, that a task searches at once; scores computed between two looks at the floor.
ROWS, VALUES, CHUNK = 4_096, 1 << 22, 64
LONG = (1 << 63) - 1
#: Bits of a component that bounds are computed with; larger components are shifted down.
FLOAT_BITS = 400
EPS = float(np.finfo(np.float64).eps)


def usable_vectors(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, x): rows that take part, components as doubles."""
    x = F.col(vec_col).cast("array<double>")
    fine = x.isNotNull() & F.col(id_col).isNotNull() & F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    return df.select(F.col(id_col).cast("long").alias("vec_id"), F.when(fine, x).alias("x")).where("x is not null")


def whole(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x): int64, or Python integers if one of them is larger."""
    with np.errstate(over="ignore"):
        y = x * scale
    if not y.size or np.abs(y).max() < 1 << 62:
        return np.floor(y).astype(np.int64)
    one = np.frompyfunc(lambda a, b: math.floor(b) if math.isfinite(b) else int(a) * scale, 2, 1)
    return one(x, y)


def largest(v: np.ndarray) -> int:
    return max(map(abs, v.ravel().tolist()), default=0) if v.dtype == object else int(np.abs(v).max(initial=0))


def floats(v: np.ndarray, shift: int) -> np.ndarray:
    """v without its `shift` lowest bits."""
    if v.dtype != object:
        return (v >> min(shift, 63)).astype(np.float64)
    return np.frompyfunc(lambda a: float(a >> shift), 1, 1)(v).astype(np.float64).reshape(v.shape)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of integer rows."""
    most = largest(a) * largest(b) * max(1, a.shape[1])
    if most < 1 << 53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if most < 1 << 63:
        return a.astype(np.int64) @ b.astype(np.int64).T
    return np.dot(a.astype(object), b.astype(object).T)


def norms(a: np.ndarray) -> np.ndarray:
    return np.sqrt((a * a).sum(axis=1))


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * a @ b.T, 0))


def choose_pivots(v: np.ndarray, n: int) -> np.ndarray:
    """Rows far from each other, found one after another."""
    if not len(v):
        return v
    sample = floats(v, max(0, largest(v).bit_length() - FLOAT_BITS))
    chosen = [0]
    gap = distances(sample, sample[:1])[:, 0]
    while len(chosen) < min(n, len(sample)) and gap.max() > 0:
        chosen.append(int(gap.argmax()))
        gap = np.minimum(gap, distances(sample, sample[chosen[-1:]])[:, 0])
    return v[chosen]


class Best:
    """The k best (score, id) of each query, and the score that a candidate must reach; floors are where it starts."""

    def __init__(self, n: int, k: int, floors: list[int | None] | None = None):
        self.k, self.rows = k, [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in range(n)]
        self.floor: list[int | None] = list(floors) if floors else [None] * n

    def add(self, q: int, scores: np.ndarray, ids: np.ndarray) -> None:
        old = self.rows[q]
        scores, ids = np.concatenate([old[0], scores]), np.concatenate([old[1], ids])
        if scores.dtype == object:
            order = np.array(sorted(range(len(ids)), key=lambda i: (-scores[i], ids[i]))[: self.k], int)
        else:
            order = np.lexsort((ids, -scores))[: self.k]
        self.rows[q] = (scores[order], ids[order])
        if len(order) == self.k:
            last = int(scores[order[-1]])
            self.floor[q] = last if self.floor[q] is None else max(last, self.floor[q])

    def least(self, q: int, shift: int) -> float:
        """The floor of a query in units of 2 ** (2 * shift)."""
        if self.floor[q] is None:
            return -math.inf
        down = self.floor[q] >> 2 * shift
        return float(down) if down.bit_length() < 1000 else math.copysign(math.inf, down)


def search_block(best: Best, query_ids: np.ndarray, queries: np.ndarray, pivots: np.ndarray, ids: np.ndarray, vectors: np.ndarray) -> int:
    """Update best with a block of candidates; gives the number of scores that were computed."""
    shift = max(0, max(map(largest, (queries, pivots, vectors))).bit_length() - FLOAT_BITS)
    fq, fp, fx = (floats(v, shift) for v in (queries, pivots, vectors))
    d = queries.shape[1]
    lost = math.sqrt(d) if shift else 0.0  # what shifting takes from a vector's length
    near = math.sqrt((d + 8) * 2 * EPS)  # share of both lengths that rounding can move a distance by
    size_q, size_x, size_p = norms(fq), norms(fx), norms(fp)
    near_q, near_x = distances(fq, fp), distances(fx, fp)
    loose = near * size_p[None, :] + 2 * lost
    low_x, high_x = near_x - near * size_x[:, None] - loose, near_x + near * size_x[:, None] + loose
    low_q, high_q = near_q - near * size_q[:, None] - loose, near_q + near * size_q[:, None] + loose
    evaluated = 0
    for q in range(len(queries)):
        gap = np.maximum(np.maximum(low_x - high_q[q], low_q[q] - high_x).max(axis=1, initial=0.0), 0.0)
        squares = (size_q[q] + lost) ** 2 + (size_x + lost) ** 2
        most = (squares - gap * gap) / 2 + 4 * (d + 8) * EPS * squares + 1
        fit = np.flatnonzero(most >= best.least(q, shift))
        fit = fit[np.argsort(-most[fit], kind="stable")]
        for at in range(0, len(fit), CHUNK):
            now = fit[at : at + CHUNK]
            if most[now[0]] < best.least(q, shift):
                break
            now = now[ids[now] != query_ids[q]]
            if len(now):
                evaluated += len(now)
                best.add(q, products(queries[q : q + 1], vectors[now])[0], ids[now])
    return evaluated


class Block:
    """Queries of one length, their pivots and floors."""

    def __init__(self, ids: list[int], rows: list[list[float]], k: int, scale: int):
        self.ids, self.queries = np.array(ids, np.int64), whole(np.array(rows, np.float64).reshape(len(ids), -1), scale)
        self.pivots, self.k = choose_pivots(self.queries, PIVOTS), k
        seen = Best(len(ids), k)
        search_block(seen, self.ids, self.queries, self.pivots, self.ids[:SEED], self.queries[:SEED])
        self.floors = seen.floor

    def best(self) -> Best:
        return Best(len(self.ids), self.k, self.floors)


def sortable(score: int) -> bytes | None:
    """Bytes in the order of the scores; None for those that a long tells apart."""
    if abs(score) < 1 << 62:
        return None
    raw = abs(score).to_bytes(-(-score.bit_length() // 8), "big")
    framed = b"\xff" + len(raw).to_bytes(4, "big") + raw
    return framed if score > 0 else bytes(255 - b for b in framed)


def block_top(candidates: DataFrame, blocks: dict[int, Block], scale: int) -> DataFrame:
    """(query_id, vec_id, score, wide): the best k of each partition for each query of the blocks."""

    def run(batches):
        best = {n: b.best() for n, b in blocks.items()}
        held: dict[int, list] = {n: [] for n in blocks}
        size = dict.fromkeys(blocks, 0)

        def search(n):
            ids, vectors = (np.concatenate(x) for x in zip(*held[n], strict=True))
            search_block(best[n], blocks[n].ids, blocks[n].queries, blocks[n].pivots, ids, whole(vectors, scale))
            held[n], size[n] = [], 0

        for batch in batches:
            lengths = np.diff(batch.column(1).offsets.to_numpy())
            for n in np.unique(lengths).tolist():
                if n not in blocks:
                    continue
                own = np.flatnonzero(lengths == n)
                x = batch.column(1).take(pa.array(own)).flatten().to_numpy(zero_copy_only=False).reshape(len(own), n)
                held[n].append((batch.column(0).to_numpy()[own], x))
                size[n] += len(own)
                if size[n] >= ROWS or size[n] * n >= VALUES:
                    search(n)
        for n in blocks:
            if size[n]:
                search(n)
            found = [(q, i, s) for q, (scores, ids) in zip(blocks[n].ids.tolist(), best[n].rows, strict=True) for s, i in zip(map(int, scores), ids.tolist(), strict=True)]
            for at in range(0, len(found), 1 << 16):
                query, vec, score = zip(*found[at : at + (1 << 16)], strict=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(query, pa.int64()), pa.array(vec, pa.int64()), pa.array([max(-LONG - 1, min(LONG, s)) for s in score], pa.int64()), pa.array(map(sortable, score), pa.binary())],
                    ["query_id", "vec_id", "score", "wide"],
                )

    return map_arrow(candidates, run, "query_id long, vec_id long, score long, wide binary", rows=ROWS)


def top_k(df: DataFrame, is_query, id_col: str = "vec_id", vec_col: str = "embedding", k: int = K, scale: int = SCALE, block: int = QUERIES) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k best candidates of each query; ties go to the smaller id.

    is_query is a condition on column vec_id.
    """
    spark = df.sparkSession
    small_batches(spark)
    rows = usable_vectors(df, id_col, vec_col)
    asked = rows.where(is_query).groupBy("vec_id").agg(F.min("x").alias("x"))
    total, widest = asked.agg(F.count("*"), F.max(F.size("x"))).first()
    blocks = -(-total // max(1, min(block, BLOCK_VALUES // max(1, widest or 1))))
    if blocks > 1:  # by hash, so that each can be read alone
        asked = settle(asked.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")))
    found = None
    for at in range(blocks):
        by_length: dict[int, tuple[list, list]] = {}
        for r in (asked.where(F.col("block") == at) if blocks > 1 else asked).select("vec_id", "x").orderBy("vec_id").collect():
            ids, own = by_length.setdefault(len(r["x"]), ([], []))
            ids.append(r["vec_id"]), own.append(r["x"])
        if not by_length:
            continue
        part = block_top(rows, {n: Block(*own, k, scale) for n, own in by_length.items()}, scale)
        if blocks > 1:  # each block's candidates are read, reduced and put away before the next
            part = settle(ranked(part, k))
        found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    return ranked(found, k) if blocks == 1 else found


def ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("wide"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op5_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % EVERY == 0)


OP5_SQL = """
WITH c AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, x.vec_id, CAST(list_sum(list_transform(list_zip(q.v, x.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM c q JOIN c x ON q.vec_id % 100 = 0 AND x.vec_id <> q.vec_id
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
WHERE rank <= 10
"""
