"""The permutation index against all inner products."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from soquy.llm import queries
from soquy.llm.neighbours import first_rows, footrule_gains, nearest_neighbours, nearest_orders, pivots_of, usable

SCHEMA = "vec_id long, embedding array<float>, id string, v string"


def table(spark, rows):
    return spark.createDataFrame([(i, v, "i", "v") for i, v in rows], SCHEMA)


@pytest.mark.parametrize("size", ["sf0.01", "sf0.1"])
def test_recall_on_the_given_vectors(spark, size):
    folder = f"/root/testdata/{size}"
    rows = spark.read.parquet(f"{folder}/embeddings.parquet").collect()
    ids = np.array([r["vec_id"] for r in rows])
    v = np.array([r["embedding"] for r in rows], np.float64)
    found = queries.neighbours(spark, folder).collect()
    hits = 0
    for q in ids[ids % 20 == 0]:
        own = sorted((r for r in found if r["query_id"] == q), key=lambda r: r["rank"])
        scores = v @ v[ids == q][0]
        assert [r["rank"] for r in own] == list(range(1, 21))
        for r in own:
            assert r["vec_id"] != q and abs(r["score"] - scores[ids == r["vec_id"]][0]) < 1e-12
        assert own == sorted(own, key=lambda r: (-r["score"], r["vec_id"]))
        scores[ids == q] = -np.inf
        best = set(ids[np.lexsort((ids, -scores))[:20]])
        hits += len(best & {r["vec_id"] for r in own})
    assert hits >= 0.95 * 20 * (ids % 20 == 0).sum()


def test_few_and_awkward_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (20, [0.0, 2.0]), (1, [1.0, 1.0]), (2, [1.0, 1.0]), (2, [1.0, 1.0]), (3, None), (4, []), (5, [0.0, 0.0])]
    rows += [(6, [1.0, None]), (7, [nan, 1.0]), (8, [inf, 1.0]), (None, [1.0, 2.0]), (9, [1.0, 2.0, 3.0]), (40, [0.0, 0.0])]
    found = nearest_neighbours(table(spark, rows), F.col("id") % 20 == 0, k=20).collect()
    got = {q: [(r["rank"], r["vec_id"], r["score"]) for r in sorted(found, key=lambda r: r["rank"]) if r["query_id"] == q] for q in (0, 20)}
    assert got[0] == [(1, 1, 1.0), (2, 2, 1.0), (3, 2, 1.0), (4, 20, 0.0)]
    assert got[20] == [(1, 1, 2.0), (2, 2, 2.0), (3, 2, 2.0), (4, 0, 0.0)]
    assert len(found) == 8


def test_blocks_find_what_one_block_finds(spark):
    rng = np.random.default_rng(1)
    rows = [(k, [float(x) for x in rng.normal(size=4)]) for k in range(300)]
    run = lambda **a: {(r["query_id"], r["rank"]): r["vec_id"] for r in nearest_neighbours(table(spark, rows), F.col("id") % 20 == 0, k=5, rerank=1.0, **a).collect()}
    assert run() == run(block_rows=40, query_rows=2)


def brute_force(rows, k):
    """(query, rank, vector, score) of rows of two components, equal queries once."""
    out = []
    for q in sorted({i for i, _ in rows if i % 20 == 0}):
        asked = {tuple(v) for i, v in rows if i == q}
        met = [(-sum(x * y for x, y in zip(v, w, strict=True)), i) for v in asked for i, w in rows if i != q]
        out += [(q, rank, i, -score) for rank, (score, i) in enumerate(sorted(met)[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("blocks", [{}, {"block_rows": 7, "query_rows": 2}])
def test_whole_index_is_brute_force(spark, blocks):
    """Every file read and everything reranked: copies, repeated ids and ties as in brute force."""
    rng = np.random.default_rng(3)
    rows = [(k, [float(x) for x in rng.integers(-3, 4, 2)]) for k in range(1, 90)]
    rows = [(k, v) for k, v in rows if any(v)]
    rows += [(k, [3.0, 2.0]) for k in range(100, 190)] + [(40, [3.0, 2.0])] * 9 + [(7, [3.0, 2.0])] * 9
    found = nearest_neighbours(table(spark, rows), F.col("id") % 20 == 0, k=5, pivots=10, asked=10, rerank=1.0, **blocks)
    assert sorted(tuple(r) for r in found.select("query_id", "rank", "vec_id", "score").collect()) == brute_force(rows, 5)


def test_one_vector_in_most_rows_leaves_other_pivots(spark):
    rows = [(k, [1.0, 2.0]) for k in range(400)] + [(400 + k, [float(k), -1.0]) for k in range(1, 30)]
    assert len(pivots_of(usable(table(spark, rows), "vec_id", "embedding"), 16)) == 16
    assert first_rows(usable(table(spark, rows), "vec_id", "embedding"), 3).count() == 4 + 29


@pytest.mark.parametrize("rows", [[], [(1, None)], [(0, [1.0])], [(1, [1.0]), (2, [2.0])]])
def test_nothing_to_find(spark, rows):
    assert nearest_neighbours(table(spark, rows), F.col("id") % 20 == 0).count() == 0


def test_gains_are_footrule_distances():
    rng = np.random.default_rng(2)
    pivots, depth = rng.normal(size=(12, 3)), 5
    a, b = (nearest_orders(rng.normal(size=(6, 3)), pivots, depth) for _ in range(2))
    gains = footrule_gains(a, b, 12)
    for i, x in enumerate(a.tolist()):
        for j, y in enumerate(b.tolist()):
            place = lambda order, p: order.index(p) if p in order else depth
            distance = sum(abs(place(x, p) - place(y, p)) for p in {*x, *y})
            assert gains[i, j] == depth * (depth + 1) - distance
