"""Hard negatives against all integer scores."""

import math
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from soquy.llm import hardnegatives as hn

SCHEMA = "vec_id long, embedding array<double>, label int, id string, mark string, v string"


def table(spark, rows):
    return spark.createDataFrame([(i, v, label, "i", "m", "v") for i, v, label in rows], SCHEMA)


def brute(rows, every, k=5, n=5, band=(80, 100), scale=256):
    usable = set()
    for i, v, label in rows:
        if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            usable.add((i, label, tuple(math.floor(scale * x) for x in v)))
    lengths = defaultdict(int)
    for _, _, v in usable:
        lengths[len(v)] += 1
    length = min(lengths, key=lambda x: (-lengths[x], x), default=0)
    usable = sorted(r for r in usable if len(r[2]) == length)
    out = []
    for a, own, q in usable:
        if a % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(q, v, strict=True)), i, label) for i, label, v in usable if i != a)
        for p, positive, _ in [s for s in scored if s[2] == own][:k]:
            near = [s for s in scored if s[2] != own and band[0] * -p <= 100 * -s[0] <= band[1] * -p][:n]
            out += [(a, positive, rank, i, -p, -s) for rank, (s, i, _) in enumerate(near, 1)]
    return sorted(out)


def clustered(seed=3, n=400, size=20):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, size))
    return [(k, [float(x) for x in centres[k % 6] + rng.normal(size=size) * 0.5], int(rng.integers(0, 4))) for k in range(n)]


def awkward():
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.5], 1), (10, [0.0, 0.0], 1), (1, [1.0, 0.5], 1), (1, [1.0, 0.5], 1), (2, [0.9, 0.5], 2), (3, [0.9, 0.5], 2)]
    rows += [(4, None, 1), (5, [1.0, None], 1), (6, [nan, 1.0], 2), (7, [inf, 1.0], 2), (8, [1.0, 1.0], None), (None, [1.0, 1.0], 2)]
    rows += [(9, [1.0, 1.0, 1.0], 2), (11, [], 2), (20, [-1.0, -0.5], 2), (21, [-1.0, -0.4], 2), (20, [0.7, 0.7], 2), (12, [0.0, 0.0], 2)]
    return rows + [(30, [0.25, 1.0], 3), (13, [0.3, 0.95], 1), (14, [0.004, -0.004], 1)]


@pytest.mark.parametrize("rows", [clustered(), awkward(), clustered(4, 90, 130)])
def test_against_all_scores(spark, rows):
    got = hn.hard_negatives(table(spark, rows), F.col("id") % 10 == 0).collect()
    assert sorted(map(tuple, got)) == brute(rows, 10)
    assert len(got) > 3


def test_blocks_and_bands(spark):
    rows = clustered(5)
    got = hn.hard_negatives(table(spark, rows), F.col("id") % 10 == 0, positives=2, negatives=3, band=(50, 90), block_rows=30, planes=3)
    assert sorted(map(tuple, got.collect())) == brute(rows, 10, 2, 3, (50, 90))


@pytest.mark.parametrize("rows", [[], [(0, None, 1)], [(0, [1.0], 1)], [(1, [1.0], 1), (2, [2.0], 1)], [(0, [1.0], 1), (1, [-1.0], 1)]])
def test_nothing_to_find(spark, rows):
    assert hn.hard_negatives(table(spark, rows), F.col("id") % 10 == 0).collect() == []


def block(vectors, labels):
    turn = hn.rotation(hn.code_bits(vectors.shape[1]))
    norms, turned = hn.directions(vectors, turn)
    codes = np.packbits(turned >= 0, axis=1, bitorder="little").view(np.uint64)
    aligned = np.abs(turned).sum(1) / np.sqrt(len(turn))
    return hn.Rows(np.arange(len(vectors)), labels, vectors, codes, aligned, norms), turn


@pytest.mark.parametrize("size", [3, 64, 200])
@pytest.mark.parametrize("planes", [1, 6])
def test_scores_lie_in_their_intervals(size, planes):
    rng = np.random.default_rng(size)
    vectors = rng.integers(-300, 300, (60, size))
    vectors[:5] = vectors[7]
    vectors[8], vectors[9] = 0, -vectors[7]
    rows, turn = block(vectors, np.zeros(60, np.int64))
    _, low, high = hn.Anchors(rows, turn, planes).intervals(slice(0, 60), rows)
    exact = vectors @ vectors.T
    assert (low <= exact).all() and (exact <= high).all()
    units = rng.integers(0, 2**planes, (4, turn.shape[0]))
    packed = np.stack([np.packbits((units >> j) & 1, axis=1, bitorder="little").view(np.uint64) for j in range(planes)], 1)
    ones = np.unpackbits(rows.codes.view(np.uint8), axis=1, bitorder="little")
    assert (hn.popcount_sums(packed, rows.codes) == units @ ones.T.astype(np.int64)).all()


def test_most_rows_are_passed_over():
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(40, 128)) * 100
    labels = np.arange(4000) % 40
    vectors = np.rint(centres[labels] + rng.normal(size=(4000, 128)) * 20).astype(np.int64)
    rows, turn = block(vectors, labels % 10)
    anchors = hn.Anchors(hn.Rows(*(x[:50] for x in (rows.ids, rows.labels, rows.vectors, rows.codes, rows.alignments, rows.norms))), turn, 6)
    seen = []
    real = hn.Anchors.scores
    hn.Anchors.scores = lambda self, i, j, part: seen.append(len(i)) or real(self, i, j, part)
    try:
        hn.nearest_in_block(anchors, rows, 5)
    finally:
        hn.Anchors.scores = real
    assert sum(seen) < 0.5 * 50 * 400
