"""Exact top-k inner products by pivot-table elimination.

Components become ``floor(64 * x)``. ``PIVOTS`` reference vectors (the valid rows with the smallest hashes of their ids) are sent to all
tasks, and every vector gets its distances to them once. For a query q and a candidate x the largest difference of their distances
to a pivot is a lower bound of their distance, so ``(|q|^2 + |x|^2 - bound^2) / 2`` is an upper bound of their inner product.
Queries and candidates meet in blocks of bounded size; in a block each query's candidates are evaluated in the order of their
upper bounds, until the next bound is below the query's k-th score so far. A block gives k candidates a query at most, and a window
a query merges the blocks. All products are whole numbers; a bound is widened by its rounding error.

Edge cases: vectors that are null or hold null or non-finite components, and rows with null ids, take no part. Vectors of unequal
length are compared with zeros appended; an empty vector scores 0. Rows equal in id and vector count once; other rows of one id are separate
candidates (none of them for that id's own query). Ties go to the smaller id. Fewer than k candidates give fewer rows; an empty
table none. Only the id and vector columns are read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracelens.llm.common import cut

PIVOTS = 16
#: Rows in a block of queries and of candidates.
QUERY_BLOCK, BLOCK = 2048, 8192
#: Pairs of a query and a candidate whose bounds are held at once.
AT_ONCE = 1 << 16


def whole(vector: str, scale: int = 64) -> Column:
    """floor(scale * x) of each component."""
    return F.transform(F.col(vector), lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long"))


def valid(vector: str) -> Column:
    """Neither null nor with null or non-finite components."""
    bad = F.exists(F.col(vector), lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return F.col(vector).isNotNull() & ~F.coalesce(bad, F.lit(True))


def _matrix(rows, width: int) -> np.ndarray:
    out = np.zeros((len(rows), width), dtype=np.int64)
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def _products(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """x @ q in whole numbers. Floating-point arguments stand for whole numbers whose sums are all below 2**53, and so are exact."""
    if x.dtype == np.float64:
        return (x @ q).astype(np.int64)
    return np.clip(x.astype(object) @ q.astype(object), -(2**63), 2**63 - 1).astype(np.int64)


def search_block(query_ids, queries, query_far, ids, vectors, far, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best candidates of each query in one block, as (query id, id, score). Exact, ties to the smaller id."""
    order = np.argsort(ids, kind="stable")
    ids, vectors, far = ids[order], vectors[order], far[order]
    norm_x = (vectors.astype(np.float64) ** 2).sum(axis=1)
    norm_q = (queries.astype(np.float64) ** 2).sum(axis=1)
    if float(np.abs(vectors).max(initial=0)) * float(np.abs(queries).max(initial=0)) * max(1, vectors.shape[1]) < 2**53:
        vectors, queries = vectors.astype(np.float64), queries.astype(np.float64)
    pivots = np.ascontiguousarray(far.T)
    out_q, out_id, out_s = [], [], []
    for at in range(0, len(queries), step := max(1, AT_ONCE // max(1, len(ids)))):
        part = slice(at, at + step)
        gap = np.zeros((len(queries[part]), len(ids)))
        one = np.empty_like(gap)
        for p in range(far.shape[1]):
            np.subtract(query_far[part, p, None], pivots[p], out=one)
            np.maximum(gap, np.abs(one, out=one), out=gap)
        size = norm_q[part, None] + norm_x[None, :]
        most = (size - gap**2) / 2 + 1 + 1e-9 * size
        for j in range(len(gap)):
            bound = np.where(ids == query_ids[at + j], -np.inf, most[j])
            left = np.flatnonzero(bound > -np.inf)
            got_i, got_s, take = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), max(256, 2 * k)
            while len(left):
                if len(left) > take:
                    cut_at = np.argpartition(-bound[left], take)
                    now, left = left[cut_at[:take]], left[cut_at[take:]]
                else:
                    now, left = left, left[:0]
                # Without a copy of the rows where many of the block's are left.
                new = _products(vectors, queries[at + j])[now] if 4 * len(now) > len(ids) else _products(vectors[now], queries[at + j])
                if len(new) > k:
                    least = np.partition(new, len(new) - k)[len(new) - k]
                    now, new = now[new >= least], new[new >= least]
                got_i, got_s = np.concatenate([got_i, now]), np.concatenate([got_s, new])
                best = np.lexsort((got_i, -got_s))[:k]
                got_i, got_s = got_i[best], got_s[best]
                if len(got_s) == k:
                    left = left[bound[left] >= got_s[-1]]
                take *= 4
            out_q.append(np.full(len(got_i), query_ids[at + j]))
            out_id.append(ids[got_i])
            out_s.append(got_s)
    cat = lambda x: np.concatenate(x) if x else np.zeros(0, dtype=np.int64)
    return cat(out_q), cat(out_id), cat(out_s)


def top_k(table: DataFrame, is_query: Column, *, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 64) -> DataFrame:
    """Rows (query_id, rank, id, score): the k highest inner products of every row for which ``is_query`` holds, against all rows."""
    spark = table.sparkSession
    rows = table.where(F.col(id_col).isNotNull() & valid(vector_col)).select(F.col(id_col).cast("long").alias("id"), whole(vector_col, scale).alias("v"), F.coalesce(is_query, F.lit(False)).alias("q")).distinct()
    rows = cut(rows)
    n, nq, width = rows.agg(F.count("*"), F.count_if("q"), F.max(F.size("v"))).first()
    width = max(1, width or 1)
    pivots = _matrix([r["v"] for r in rows.orderBy(F.xxhash64("id"), "id", "v").limit(PIVOTS).select("v").collect()], width)

    @F.pandas_udf("array<double>")
    def distances(vectors: pd.Series) -> pd.Series:
        x = _matrix(list(vectors), width).astype(np.float64)
        return pd.Series(list(np.sqrt(((x[:, None, :] - pivots[None, :, :].astype(np.float64)) ** 2).sum(axis=2))), dtype=object)

    tabled = cut(rows.withColumn("far", distances("v")))
    query_blocks, blocks = max(1, -(-nq // QUERY_BLOCK)), max(1, -(-n // BLOCK))
    own = F.xxhash64("id", "v")
    queries = tabled.where("q").select("id", "v", "far", F.pmod(own, F.lit(query_blocks)).alias("qb"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("cb"))
    candidates = tabled.select("id", "v", "far", F.pmod(own, F.lit(blocks)).alias("cb"), F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))).alias("qb"))
    keys = [F.col("qb").cast("long"), F.col("cb").cast("long")]

    def search(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        parts = []
        for x in (q, c):
            parts += [x["id"].to_numpy(dtype=np.int64), _matrix(list(x["v"]), width), np.array(list(x["far"]), dtype=np.float64).reshape(len(x), -1)]
        return pd.DataFrame(dict(zip(("query_id", "id", "score"), search_block(*parts, k), strict=True)))

    found = queries.groupBy(*keys).cogroup(candidates.groupBy(*keys)).applyInPandas(search, T.StructType([T.StructField(c, T.LongType()) for c in ("query_id", "id", "score")]))
    # Rows of one id are one query's rows: a query with several vectors would have ranks of all of them together.
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "id", "score")
