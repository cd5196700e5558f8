"""Operator 7: exact top-k inner products over norm-sorted, rotated vectors.

Vectors become whole numbers. A rotation from the singular vectors of a bounded sample gathers most of an
inner product in few leading components. The few longest vectors are scored first and give every query a
threshold it must reach. Candidates are dealt into blocks by hash and queries into blocks of their own; a
task takes one block of each. It goes through its candidates by falling length: a query leaves as soon as its
length times the next candidate's falls below its threshold (Cauchy-Schwarz), and a candidate is scored in
full only if its partial sum over the leading components plus the product of the residual lengths reaches the
threshold. Scores themselves are whole-number products, so neither rotation nor bounds change a result.

A task holds two blocks of fixed size and returns k rows per query; the best k overall come from a ranked
window per query.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.vectors import matrix, usable

SAMPLE = 2_048
CANDIDATES = 8_192
QUERIES = 4_096
STEP = 1_024
LOWEST = np.iinfo(np.int64).min


def whole(vectors: np.ndarray, scale: int) -> np.ndarray:
    """``floor(scale * x)``; beyond 2**62 the value saturates."""
    return np.clip(np.floor(vectors * scale), -(2.0**62), 2.0**62).astype(np.int64)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of all rows as whole numbers; beyond the range of a long they saturate."""
    top = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(a.shape[1], 1)
    if top < 2.0**53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    if top < 2.0**62:
        return a @ b.T
    exact = a.astype(object) @ b.T.astype(object)
    return np.clip(exact, -(2**63), 2**63 - 1).astype(np.int64)


def best(query: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest scores of every query, ties to the smaller id."""
    order = np.lexsort((ids, -scores.astype(np.float64), query)) if np.abs(scores).max(initial=0) < 2**53 else np.array(
        sorted(range(len(ids)), key=lambda i: (query[i], -int(scores[i]), ids[i])), np.int64)
    of = query[order]
    first = np.searchsorted(of, of)
    return order[np.arange(len(of)) - first < k]


def search_block(q_ids, q, limits, c_ids, c, turn, k, lead):
    """Query numbers, candidate ids and scores of the k best candidates of each query in one block."""
    order = np.lexsort((c_ids, -np.sqrt((c.astype(np.float64) ** 2).sum(1))))
    c_ids, c = c_ids[order], c[order]
    limits = limits.copy()
    qr, cr = q.astype(np.float64) @ turn, c.astype(np.float64) @ turn
    q_length, c_length = (np.sqrt((x**2).sum(1)) for x in (qr, cr))
    q_rest, c_rest = (np.sqrt((x[:, lead:] ** 2).sum(1)) for x in (qr, cr))
    empty = np.empty(0, np.int64)
    kept, kept_ids, kept_scores = empty, empty, empty
    for at in range(0, len(c), STEP):
        part = slice(at, at + STEP)
        # rounding of the rotated sums, far below the distance of whole numbers unless these are huge
        slack = 0.5 + 1e-9 * q_length * c_length[at]
        going = np.flatnonzero(q_length * c_length[at] + slack >= limits)
        if not len(going):
            break
        bound = qr[going, :lead] @ cr[part, :lead].T + q_rest[going, None] * c_rest[None, part] + slack[going, None]
        row, col = np.nonzero(bound >= limits[going, None])
        some_q, some_c = np.unique(row), np.unique(col)
        if not len(row):
            continue
        scores = products(q[going[some_q]], c[part][some_c])[np.searchsorted(some_q, row), np.searchsorted(some_c, col)]
        query, ids = going[row], c_ids[part][col]
        fit = (scores >= limits[query]) & (ids != q_ids[query])
        kept = np.concatenate([kept, query[fit]])
        kept_ids = np.concatenate([kept_ids, ids[fit]])
        kept_scores = np.concatenate([kept_scores, scores[fit]])
        top = best(kept, kept_ids, kept_scores, k)
        kept, kept_ids, kept_scores = kept[top], kept_ids[top], kept_scores[top]
        number = np.bincount(kept, minlength=len(q))
        last = np.flatnonzero(np.diff(kept, append=-1))
        full = last[number[kept[last]] == k]
        limits[kept[full]] = np.maximum(limits[kept[full]], kept_scores[full])
    return kept, kept_ids, kept_scores


def top_products(vectors: DataFrame, is_query, k: int = 10, scale: int = 1024, id_column: str = "vec_id",
                 vector_column: str = "embedding", sample: int = SAMPLE, candidate_block: int = CANDIDATES,
                 query_block: int = QUERIES) -> DataFrame:
    """``query_id, rank, <id>, score`` of each query's k highest products (all, if fewer).

    ``is_query``: condition on the column ``id``. Rows whose id or vector is null, or whose vector holds a null
    or non-finite component, take no part. A shorter vector counts as filled up with zeros; an empty one scores
    0. A query's candidates are all rows with another id; repeated rows each count. Ties go to the smaller id.
    An empty table, or one without queries, gives an empty result. Other columns are not read.
    """
    rows = vectors.select(F.col(id_column).alias("id"), F.col(vector_column).alias("vector")).where(
        F.col("id").isNotNull() & usable("vector"))
    size = rows.agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("d"), F.count_if(is_query).alias("q")).first()
    n, d, n_queries = size.n, size.d or 0, size.q
    length = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    longest = rows.orderBy(F.desc(length), "id").limit(sample).collect()
    drawn = rows.orderBy(F.xxhash64("id")).limit(sample).select("vector").collect()

    def filled(vs) -> np.ndarray:
        return whole(matrix(pa.array([list(map(float, v)) for v in vs], pa.list_(pa.float64())), d), scale)

    first_ids, first = np.array([r.id for r in longest], np.int64), filled([r.vector for r in longest])
    base = filled([r.vector for r in drawn]).astype(np.float64)
    turn = np.linalg.svd(base.T @ base)[0] if d else np.zeros((0, 0))
    lead = max(1, d // 4)

    def limits_of(batches):
        for batch in batches:
            q = whole(matrix(batch.column("vector"), d), scale)
            scores = products(q, first)
            scores[batch.column("id").to_numpy()[:, None] == first_ids[None, :]] = LOWEST
            limit = np.partition(scores, -k, axis=1)[:, -k] if scores.shape[1] >= k else np.full(len(q), LOWEST)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(limit, pa.int64())], ["id", "vector", "limit"])

    blocks, query_blocks = max(1, -(-n // candidate_block)), max(1, -(-n_queries // query_block))
    kind = rows.schema["vector"].dataType.simpleString()
    queries = rows.where(is_query).mapInArrow(limits_of, f"id long, vector {kind}, limit long").select(
        "id", "vector", "limit", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("c"),
        F.pmod(F.xxhash64("id"), F.lit(query_blocks)).cast("int").alias("q"))
    candidates = rows.select(
        "id", "vector", F.pmod(F.xxhash64("id", "vector"), F.lit(blocks)).cast("int").alias("c"),
        F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))).alias("q"))

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        found = [np.empty(0, np.int64)] * 3
        if left.num_rows and right.num_rows:
            q_ids, c_ids = (t.column("id").to_numpy() for t in (left, right))
            q, c = (whole(matrix(t.column("vector"), d), scale) for t in (left, right))
            query, ids, scores = search_block(q_ids, q, left.column("limit").to_numpy(), c_ids, c, turn, k, lead)
            found = [q_ids[query], ids, scores]
        return pa.table(dict(zip(("query_id", "id", "score"), (pa.array(x, pa.int64()) for x in found))))

    pairs = queries.groupBy("c", "q").cogroup(candidates.groupBy("c", "q")).applyInArrow(
        search, "query_id long, id long, score long")
    by_query = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    ranked = pairs.withColumn("rank", F.row_number().over(by_query)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.col("id").alias(id_column), "score")
