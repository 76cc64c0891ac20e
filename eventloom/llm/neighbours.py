"""Nearest neighbours by inner product: a block matrix join over int8 tiles.

Candidates fall into blocks of about ``BLOCK`` rows and queries into blocks of about ``QUERY_BLOCK`` by a hash of the
row; each pair of blocks meets once, in one task of bounded size. In a tile the vectors are rounded to int8 with one
scale each; the integer products are exact, and the rounding error of a product is at most

    s_q s_x (|q|_1 + |x|_1 + d / 2) / 2        (q, x the int8 vectors, s their scales, d the dimension)

A candidate survives if its upper bound reaches the k-th largest lower bound of its query. Survivors are computed again
in double precision from the original vectors and merged by heaps; the results of the blocks are merged by rank. The
answer is therefore exact.

Edge cases: vectors that are null, empty, zero, or hold null or non-finite components take no part; only vectors of one
length are compared; repeated rows (same id and vector) count once; equal scores go to the smaller id; fewer than k
candidates give fewer rows; an empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BLOCK = 8192
QUERY_BLOCK = 4096
_STRIPE = 256


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    scale = np.abs(x).max(1) / 127
    return np.rint(x / scale[:, None]).astype(np.int8), scale


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Integer products of int8 rows; single precision holds them exactly in runs of 1000 dimensions."""
    out = np.zeros((len(q), len(x)))
    for at in range(0, q.shape[1], 1000):
        out += q[:, at : at + 1000].astype(np.float32) @ x[:, at : at + 1000].astype(np.float32).T
    return out


def tile(query_ids, query_rows, queries, ids, rows, vectors, k: int):
    """(query, [(-score, id)] nearest first) of one block against another. ``*_rows`` mark a query's own row."""
    q8, q_scale = quantise(queries)
    x8, x_scale = quantise(vectors)
    q_sum, x_sum = np.abs(q8.astype(np.int32)).sum(1), np.abs(x8.astype(np.int32)).sum(1)
    for at in range(0, len(queries), _STRIPE):
        part = slice(at, at + _STRIPE)
        scale = q_scale[part, None] * x_scale[None]
        near = products(q8[part], x8) * scale
        error = (q_sum[part, None] + x_sum[None] + queries.shape[1] / 2) * scale * (0.5 + 1e-9)
        own = (query_ids[part, None] == ids[None]) & (query_rows[part, None] == rows[None])
        low = np.where(own, -np.inf, near - error)
        take = min(k, len(ids))
        floor = np.partition(low, len(ids) - take, axis=1)[:, len(ids) - take]
        keep = (near + error >= floor[:, None]) & ~own
        for i in range(len(near)):
            left = np.flatnonzero(keep[i])
            scores = vectors[left] @ queries[at + i]
            heap = list(zip((-scores).tolist(), ids[left].tolist(), strict=True))
            heapq.heapify(heap)
            yield at + i, list(islice(iter(lambda h=heap: heapq.heappop(h) if h else None, None), k))


def _join(k: int):
    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        def side(t):
            vectors = np.asarray(t["vector"].combine_chunks().flatten()).astype(np.float64).reshape(t.num_rows, -1)
            return np.asarray(t["id"]), np.asarray(t["mark"]), vectors

        out: list[list] = [[], [], [], []]
        if left.num_rows and right.num_rows:
            a, b = side(left), side(right)
            for i, found in tile(*a, *b, k):
                out[0] += [int(a[0][i])] * len(found)
                out[1] += [int(a[1][i])] * len(found)
                out[2] += [x for _, x in found]
                out[3] += [-s for s, _ in found]
        return pa.table([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.float64()), strict=True)], names=["query_id", "mark", "vec_id", "score"])

    return run


def valid(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id, vector, mark (hash of the vector) of the distinct rows that take part."""
    v = F.col("vector")
    fine = F.col("id").isNotNull() & v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    rows = df.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("vector")).where(fine)
    return rows.dropDuplicates(["id", "vector"]).withColumn("mark", F.xxhash64("vector"))


def search(df: DataFrame, queries: F.Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest other rows of each row whose ``id`` fulfils ``queries``."""
    rows = valid(df, id_col, vector_col)
    size = df.count()
    n_blocks = max(1, math.ceil(size / BLOCK))
    n_queries = max(1, math.ceil(df.where(queries).count() / QUERY_BLOCK))
    spread = lambda n: F.pmod(F.xxhash64("id", "mark"), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    width = F.size("vector").alias("width")
    candidates = rows.select("id", "mark", "vector", width, spread(n_blocks).alias("x"), each(n_queries).alias("q"))
    asked = df.where(queries).transform(lambda d: valid(d, id_col, vector_col))
    asked = asked.select("id", "mark", "vector", width, spread(n_queries).alias("q"), each(n_blocks).alias("x"))
    by = ["width", "x", "q"]
    found = asked.groupBy(*by).cogroup(candidates.groupBy(*by)).applyInArrow(_join(k), "query_id long, mark long, vec_id long, score double")
    order = Window.partitionBy("query_id", "mark").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
