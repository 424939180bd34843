"""Approximate nearest neighbours by a permutation index.

Every vector is represented by the order of its nearest pivots. The index is stored once: each vector
with its order, to be posted in the inverted files of its ``posted`` nearest pivots. A query reads the
files of its ``asked`` nearest pivots and no others. Within a file, vectors are ranked by the footrule
distance between their order and the query's, the nearest ``rerank`` share of the file is scored by the
exact inner product, and the best of all files are merged by a top-k per query. A vector that a query
meets in several files counts in the one whose pivot is nearest to the query.

A file of more than ``block_rows`` vectors is split into blocks, and its queries into blocks of
``query_rows``, so a task holds one block of each whatever the size of the file; it compares ``SLICE``
queries at a time. Until files are split (at about a million rows with the defaults), a vector moves
``posted`` times and a query ``asked`` times, so the shuffle is in proportion to the rows.

* Pivots: at most ``pivots`` distinct vectors, the smallest by a hash of their components: a bounded,
  documented sample. Every vector is indexed.
* Equal vectors have equal scores, and ties go to the smaller ids; so of equal vectors the index holds
  the rows of the ``k + 1`` smallest ids (``k`` rows of an id at most). No other can be among the
  ``k`` nearest of any query.
* Vectors that are null, empty, zero, of another length than the pivots, or that hold null or
  non-finite components take no part, neither as query nor as candidate. Rows without an id
  neither. Where the lengths differ, the most frequent length counts (ties: the smaller).
* Repeated ids are candidates each for itself, but never of a query of the same id. Queries of equal
  id and vector are asked once; those of one id and different vectors share the list of their id.
* Ties in the score go to the smaller id. Without any vector the result is empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from soquy.llm.common import stored

RESULT = "query_id long, rank int, vec_id long, score double"
FOUND = "query_id long, vec_id long, score double"
SLICE = 256


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, v): the rows that take part, components as doubles where they are not floats."""
    kind = vectors.schema[vec_col].dataType
    single = isinstance(kind, ArrayType) and isinstance(kind.elementType, FloatType)
    v = F.col(vec_col).cast("array<float>" if single else "array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    some = F.exists("v", lambda x: x != 0)
    return rows.filter(F.col("id").isNotNull() & F.col("v").isNotNull() & finite & some)


def nearest_orders(vectors: np.ndarray, pivots: np.ndarray, length: int) -> np.ndarray:
    """For each vector its ``length`` nearest pivots by inner product, nearest first."""
    nearness = vectors @ pivots.T
    length = min(length, len(pivots))
    head = np.argpartition(-nearness, length - 1, axis=1)[:, :length]
    order = np.argsort(-np.take_along_axis(nearness, head, 1), axis=1, kind="stable")
    return np.take_along_axis(head, order, 1)


def footrule_gains(queries: np.ndarray, posted: np.ndarray, n_pivots: int) -> np.ndarray:
    """Per query and vector, by how much its footrule distance falls short of that of two orders
    without a common pivot. Walks the posting list of each pivot once."""
    depth = posted.shape[1]
    rows, places = np.divmod(np.arange(posted.size), depth)
    by_pivot = np.argsort(posted.ravel(), kind="stable")
    bounds = np.searchsorted(posted.ravel()[by_pivot], np.arange(n_pivots + 1))
    gains = np.zeros((len(queries), len(posted)), np.float32)
    q_rows, q_places = np.divmod(np.arange(queries.size), queries.shape[1])
    by_query_pivot = np.argsort(queries.ravel(), kind="stable")
    q_bounds = np.searchsorted(queries.ravel()[by_query_pivot], np.arange(n_pivots + 1))
    for p in range(n_pivots):
        asked = by_query_pivot[q_bounds[p] : q_bounds[p + 1]]
        listed = by_pivot[bounds[p] : bounds[p + 1]]
        if len(asked) and len(listed):
            # |a - b| instead of (depth - a) + (depth - b), for places a and b of the pivot; a list
            # holds a vector once, so plain addition is enough
            later = np.maximum(q_places[asked][:, None], places[listed][None, :])
            gains[np.ix_(q_rows[asked], rows[listed])] += 2 * (depth - later)
    return gains


def pivots_of(rows: DataFrame, count: int) -> np.ndarray:
    """At most ``count`` distinct vectors, by the smallest hashes. Hashes move first, so a vector in
    very many rows is one among the others."""
    hashed = rows.withColumn("h", F.xxhash64("v"))
    least = [r["h"] for r in hashed.select("h").distinct().orderBy("h").limit(count).collect()]
    sample = hashed.filter(F.col("h").isin(least)).groupBy("h").agg(F.min("v").alias("v")).collect()
    return np.unique(np.array([r["v"] for r in sample], np.float64).reshape(len(sample), -1), axis=0)


def with_orders(rows: DataFrame, pivots: np.ndarray, length: int) -> DataFrame:
    """(id, v, nearest): the rows with the order of their nearest pivots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                v = batch["v"].flatten().to_numpy(zero_copy_only=False).astype(np.float64)
                orders = nearest_orders(v.reshape(len(batch), -1), pivots, length).astype(np.int16)
                lists = pa.FixedSizeListArray.from_arrays(orders.ravel(), orders.shape[1])
                columns = [batch["id"], batch["v"], lists.cast(pa.list_(pa.int16()))]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "v", "nearest"])

    schema = rows.select("id", "v", F.lit(None).cast("array<short>").alias("nearest")).schema
    return rows.select("id", "v").mapInArrow(run, schema)


def first_rows(rows: DataFrame, k: int) -> DataFrame:
    """Of equal vectors the rows of the k + 1 smallest ids, and k rows of an id."""
    by_vector = Window.partitionBy("v").orderBy("id")
    by_row = Window.partitionBy("v", "id").orderBy("id")
    few = rows.withColumn("r", F.dense_rank().over(by_vector)).filter(F.col("r") <= k + 1)
    return few.withColumn("r", F.row_number().over(by_row)).filter(F.col("r") <= k).select("id", "v")


def blocks_of(posts: DataFrame, n_pivots: int, rows: int) -> list[int]:
    """Into how many blocks the file of each pivot is split."""
    sizes = {r["pivot"]: r["count"] for r in posts.groupBy("pivot").count().collect()}  # a row per pivot
    return [max(1, -(-sizes.get(p, 0) // rows)) for p in range(n_pivots)]


def search_file(pivot: int, queries: pd.DataFrame, vectors: pd.DataFrame, n_pivots: int, k: int, posted: int, depth: int, rerank: float) -> pd.DataFrame:
    """The best ``k`` of one block of a pivot's file for each of one block of the queries that read it."""
    vectors = vectors.sort_values("id", kind="stable")
    v, order, ids = components(vectors), np.stack(vectors["nearest"].to_list()), vectors["id"].to_numpy()
    parts = (queries[at : at + SLICE] for at in range(0, len(queries), SLICE))
    return pd.concat([search_slice(pivot, part, v, order, ids, n_pivots, k, posted, depth, rerank) for part in parts])


def components(rows: pd.DataFrame) -> np.ndarray:
    return np.stack(rows["v"].to_list()).astype(np.float64)


def search_slice(pivot: int, queries: pd.DataFrame, v, order, ids, n_pivots: int, k: int, posted: int, depth: int, rerank: float) -> pd.DataFrame:
    """The best ``k`` of the vectors ``v``, in the order of their ids, for each of a few queries."""
    q, q_order, q_ids = components(queries), np.stack(queries["nearest"].to_list()), queries["id"].to_numpy()
    place = np.full((len(q), n_pivots), n_pivots, np.int16)
    np.put_along_axis(place, q_order.astype(np.int64), np.arange(q_order.shape[1], dtype=np.int16)[None, :], axis=1)
    first = place[:, order[:, 0]]
    for c in range(1, min(posted, order.shape[1])):
        np.minimum(first, place[:, order[:, c]], out=first)
    mine = (first == place[:, pivot][:, None]) & (ids != q_ids[:, None])  # in no file nearer to the query
    wanted = max(4 * k, int(np.ceil(rerank * len(ids))))
    if wanted < len(ids):
        gains = np.where(mine, footrule_gains(q_order[:, :depth], order[:, :depth], n_pivots), -1)
        mine &= gains >= np.partition(gains, len(ids) - wanted, axis=1)[:, len(ids) - wanted, None]
    # matrix products find what can be among the best; the score is summed up alike for equal vectors
    rough = np.where(mine, q @ v.T, -np.inf)
    near = np.linalg.norm(q, axis=1) * np.linalg.norm(v, axis=1).max() * q.shape[1] * 1e-15
    least = -np.partition(-rough, min(k, len(ids)) - 1, axis=1)[:, min(k, len(ids)) - 1] - near
    rows, of = np.nonzero(mine & ~(rough < least[:, None]))
    score = np.einsum("ij,ij->i", v[of], q[rows])
    best = np.lexsort((of, -score, rows))
    rank = np.arange(len(best)) - np.searchsorted(rows, rows[best])  # rows come in order
    rows, of, score = (x[best[rank < k]] for x in (rows, of, score))
    return pd.DataFrame({"query_id": q_ids[rows], "vec_id": ids[of], "score": score})


def nearest_neighbours(
    vectors: DataFrame,
    is_query,
    k: int = 20,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    pivots: int = 128,
    posted: int = 4,
    asked: int = 44,
    depth: int = 32,
    rerank: float = 0.5,
    block_rows: int = 16_384,
    query_rows: int = 16_384,
) -> DataFrame:
    """The ``k`` nearest vectors of each query: query_id, rank (from 1), vec_id, score.

    ``is_query`` is a predicate over the id column, named ``id`` here. The defaults are for vectors
    without any clusters, where a query has to read a third of all files for a recall over 0.9; of
    clustered vectors more ``pivots`` with the same ``asked`` read less.
    """
    rows = usable(vectors, id_col, vec_col)
    top = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    if not top:
        return vectors.sparkSession.createDataFrame([], RESULT)
    rows = rows.filter(F.size("v") == top[0]["n"])
    anchor = pivots_of(rows, pivots)
    longest = max(asked, depth, posted)
    index = stored(with_orders(first_rows(rows, k), anchor, longest))
    queries = with_orders(rows.filter(is_query).dropDuplicates(["id", "v"]), anchor, longest)
    files = index.withColumn("pivot", F.explode(F.slice("nearest", 1, posted)))
    reads = queries.withColumn("pivot", F.explode(F.slice("nearest", 1, asked)))
    parts = blocks_of(files, len(anchor), block_rows)
    q_parts = blocks_of(reads, len(anchor), query_rows)

    def of_file(counts: list[int]) -> Column:
        return F.element_at(F.array(*(F.lit(n) for n in counts)), F.col("pivot") + 1)

    def dealt(side: DataFrame, own: str, salt: int, counts: list[int], other: str, others: list[int]) -> DataFrame:
        block = F.pmod(F.xxhash64("id", "v", F.lit(salt)), of_file(counts)).cast("int")
        every = F.explode(F.sequence(F.lit(0), of_file(others) - 1))
        return side.withColumn(own, block).withColumn(other, every).groupBy("pivot", "qb", "vb")

    n_pivots = len(anchor)

    def search(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        return search_file(int(key[0]), left, right, n_pivots, k, posted, depth, rerank)

    read, held = dealt(reads, "qb", 1, q_parts, "vb", parts), dealt(files, "vb", 0, parts, "qb", q_parts)
    best = read.cogroup(held).applyInPandas(search, FOUND)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
