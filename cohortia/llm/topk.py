"""Exact top-k search by inner product with Fagin's threshold algorithm.

Candidates are dealt into blocks.  A block has one list per dimension, sorted by component.  The
queries of a task walk the lists together, from the top where a query's component is positive and from
the bottom where it is negative.  Rows that turn up get their full scores; the components at the depth
reached bound the score of every row not yet seen; a query leaves once that bound is below its k-th
score.  Then the best of all blocks are merged per query.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import buckets_for, col

EXACT = float(2**53)


def integer_components(vector: Column, scale: int) -> Column:
    """floor(scale * x) of every component, x as double."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(float(scale))).cast("long"))


def usable(vector: Column) -> Column:
    """Neither missing nor with a missing or non-finite component."""
    x_bad = lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == F.lit(float("inf")))
    return vector.isNotNull() & ~F.exists(vector, x_bad)


def threshold_search(queries: np.ndarray, query_ids: np.ndarray, rows: np.ndarray, row_ids: np.ndarray, k: int):
    """(query number, row number, score) of each query's best ``k`` rows of a block, ties included in order of ids."""
    n, dims = rows.shape
    small = dims * float(np.abs(queries).max(initial=0)) * float(np.abs(rows).max(initial=0)) < EXACT
    kind = np.float64 if small else np.int64
    queries, rows = queries.astype(kind), rows.astype(kind)
    lists = np.argsort(rows, axis=0, kind="stable")
    ordered = np.take_along_axis(rows, lists, axis=0)
    # Rows by id, so that the first of equal scores is the one to keep.
    by_id = np.argsort(row_ids, kind="stable")
    place = np.empty(n, np.int64)
    place[by_id] = np.arange(n)
    up, down = np.maximum(queries, 0), np.minimum(queries, 0)
    lowest = np.finfo(np.float64).min if small else np.iinfo(np.int64).min
    best = np.full((len(queries), k), lowest, kind)
    best_row = np.full((len(queries), k), n, np.int64)
    seen = np.zeros(n, bool)
    active = np.arange(len(queries))
    depth = 0
    while len(active) and depth < n:
        deeper = min(n, max(8, 4 * depth))
        fresh = np.zeros(n, bool)
        fresh[lists[depth:deeper].ravel()] = True
        fresh[lists[n - deeper : n - depth].ravel()] = True
        fresh &= ~seen
        seen |= fresh
        depth = deeper
        new = by_id[fresh[by_id]]
        for at in range(0, len(active), 256):
            some = active[at : at + 256]
            scores = queries[some] @ rows[new].T
            scores[query_ids[some][:, None] == row_ids[new][None, :]] = lowest
            merged = np.concatenate((best[some], scores), axis=1)
            where = np.concatenate((best_row[some], np.broadcast_to(new, (len(some), len(new)))), axis=1)
            kth = np.partition(merged, -k, axis=1)[:, -k]
            for i, q in enumerate(some.tolist()):
                at_least = np.flatnonzero(merged[i] >= kth[i])
                ids = where[i, at_least]
                rank = np.where(ids < n, place[np.minimum(ids, n - 1)], n)
                top = at_least[np.lexsort((rank, -merged[i, at_least]))[:k]]
                best[q], best_row[q] = merged[i, top], where[i, top]
        if depth < n:
            bound = up[active] @ ordered[n - depth] + down[active] @ ordered[depth - 1]
            # An unseen row may still tie with a smaller id, so only a lower bound ends the search.
            active = active[bound >= best[active, k - 1]]
    number = np.repeat(np.arange(len(queries)), k)
    found = (best_row.ravel() < n) & (best.ravel() > lowest)
    return number[found], best_row.ravel()[found], best.ravel()[found].astype(np.int64)


def search(
    vectors: DataFrame,
    is_query: Column,
    k: int = 5,
    scale: int = 256,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    rows_per_block: int = 8192,
    queries_per_block: int = 2048,
) -> DataFrame:
    """``query_id``, ``rank`` (from 1), the id and ``score`` of each query's ``k`` best other rows.

    The score is the inner product of the integer components floor(``scale`` * x); it must fit 64 bits.
    Ties go to the smaller id.  Rows whose id or vector is missing, or whose vector holds a missing or
    non-finite component, take no part, nor do rows under the query's own id; only vectors of the same
    length are compared.  A repeated candidate row is found as often as it is there, a repeated query
    is answered once.  Without queries or candidates there are no rows.
    """
    given = vectors.where(col(id_col).isNotNull() & usable(col(vector_col))).select(
        col(id_col).cast("long").alias("id"),
        integer_components(col(vector_col), scale).alias("vector"),
        F.coalesce(is_query, F.lit(False)).alias("is_query"),
    )
    counts = given.agg(F.count(F.lit(1)).alias("rows"), F.sum(F.col("is_query").cast("long")).alias("queries")).first()
    row_blocks = buckets_for(counts["rows"], rows_per_block)
    query_blocks = buckets_for(counts["queries"] or 0, queries_per_block)
    dims = F.size("vector").alias("dims")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    # Each block of queries meets each block of rows.
    rows = given.select(
        "id", "vector", dims, F.pmod(F.xxhash64("id", "vector"), F.lit(row_blocks)).cast("int").alias("row_block"), every(query_blocks).alias("query_block")
    )
    asked = given.where("is_query").dropDuplicates(["id"]).select(
        "id", "vector", dims, F.pmod(F.xxhash64("id"), F.lit(query_blocks)).cast("int").alias("query_block"), every(row_blocks).alias("row_block")
    )

    def block(key, found: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        names = ["query_id", "id", "score"]
        if not len(found) or not len(queries) or not key[0]:
            return pd.DataFrame({n: pd.Series(dtype="int64") for n in names})
        found, queries = found.sort_values("id", kind="stable"), queries.sort_values("id")
        ids, query_ids = found["id"].to_numpy(), queries["id"].to_numpy()
        q, r, score = threshold_search(np.stack(queries["vector"]), query_ids, np.stack(found["vector"]), ids, min(k, len(ids)))
        return pd.DataFrame({"query_id": query_ids[q], "id": ids[r], "score": score})

    keys = ["dims", "row_block", "query_block"]
    found = rows.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInPandas(block, "query_id long, id long, score long")
    # The filter on the rank becomes a group limit, which also acts before the shuffle.
    best_first = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("id").asc())
    ranked = found.withColumn("rank", F.row_number().over(best_first)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias(id_col), "score")
