"""Hard negatives of anchors by rotated one-bit codes with deterministic intervals.

Components become integers, floor(scale * x); the score of two rows is their integer inner product.
A row o is stored with the signs of its rotated direction as one bit per component, x = signs / sqrt(D),
its norm, and the alignment a = <x, Ro/|o|> of code and vector. For an anchor q the inner product
s = <x, Rq/|q|> is estimated by popcounts: the rotated anchor is written in ``planes`` bits per
component, and s is a sum over the bit planes of popcount(code AND plane). What the bits leave out has
a known length, so s lies in a known range (Cauchy-Schwarz). The direction of o is a * x plus a
residual of length sqrt(1 - a^2) orthogonal to x, and that of q has sqrt(1 - s^2) orthogonal to x, so

    a * s - sqrt(1 - a^2) * sqrt(1 - s^2)  <=  cos(o, q)  <=  a * s + sqrt(1 - a^2) * sqrt(1 - s^2)

without any assumption. Rows whose interval cannot reach what an anchor still needs are passed over;
all others are scored in integers. The best estimates of a block, s / a, are scored first, so that what
is needed is soon high. Results are exact.

Two passes over the same blocks: first the positives of each anchor, then, for the band that each
positive's score sets, the negatives. Blocks of anchors meet blocks of rows, so a task holds one block
of each whatever the size of the table or of a label, and gives back a fixed number of rows for each
anchor; the best of all blocks are merged by a top-k.

* Rows with a null id, label or vector, or with a null or non-finite component, take no part; nor do
  vectors of another length than the most frequent one (ties: the shorter).
* Rows with equal id, label and vector count once. A row is never found for an anchor of its own id.
  Rows that share an id but differ are rows of their own, as anchors too.
* Ties in the score go to the smaller id. A zero vector scores 0 with every row. Without anchors, or
  without a positive of a positive score, nothing is returned (score 0 only meets score 0).
* Scores must fit in 64 bits. Other columns may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from soquy.llm.common import stored

CHUNK = 1 << 20
"""Pairs whose intervals are held at a time."""
FIRST = 8
"""Rows of a chunk that are scored for an anchor before the others, by their estimates."""
SLACK = 1e-9
"""What rounding may add to a cosine."""


def rotation(size: int, seed: int = 11) -> np.ndarray:
    """A random orthogonal matrix, the same everywhere."""
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(size, size)))
    return q * np.sign(np.diag(r))


def code_bits(length: int) -> int:
    return max(64, -(-length // 64) * 64)


def directions(vectors: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Norms, and rotated vectors of length 1 (0 for zero vectors)."""
    wide = np.zeros((len(vectors), len(turn)))
    wide[:, : vectors.shape[1]] = vectors
    norms = np.sqrt((wide * wide).sum(1))
    return norms, (wide / np.where(norms, norms, 1)[:, None]) @ turn.T


@dataclass
class Rows:
    """Rows of a block: ids, labels, integer vectors, codes, alignments, norms."""

    ids: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray
    codes: np.ndarray
    alignments: np.ndarray
    norms: np.ndarray

    @staticmethod
    def of(table: pa.Table, length: int) -> Rows:
        def packed(name: str, kind: str, width: int) -> np.ndarray:
            return np.frombuffer(b"".join(table[name].to_pylist()), kind).reshape(-1, width)

        plain = (table[c].to_numpy() for c in ("id", "label"))
        words = code_bits(length) // 64
        return Rows(*plain, packed("vector", "<i8", length), packed("code", "<u8", words), table["alignment"].to_numpy(), table["norm"].to_numpy())


CODED = "id long, label long, mark long, vector binary, code binary, alignment double, norm double"


def coded(rows: DataFrame, length: int) -> DataFrame:
    """Rows (id, label, v) with ``v`` as bytes, its code, alignment and norm; ``mark`` tells vectors apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = rotation(code_bits(length))
        for batch in batches:
            v = batch["v"].flatten().to_numpy().reshape(-1, length)
            norms, turned = directions(v, turn)
            codes = np.packbits(turned >= 0, axis=1, bitorder="little")
            yield pa.RecordBatch.from_arrays(
                [
                    batch["id"], batch["label"], batch["mark"],
                    pa.array([x.astype("<i8").tobytes() for x in v], pa.binary()),
                    pa.array([x.tobytes() for x in codes], pa.binary()),
                    pa.array(np.abs(turned).sum(1) / np.sqrt(len(turn))),
                    pa.array(norms),
                ],
                names=[x.split()[0] for x in CODED.split(", ")],
            )

    return rows.mapInArrow(run, CODED)


def bit_planes(turned: np.ndarray, planes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Directions in ``planes`` bits per component: least value, step, packed planes, length of the error."""
    low = turned.min(1)
    step = (turned.max(1) - low) / (2**planes - 1)
    step[step == 0] = 1
    units = np.rint((turned - low[:, None]) / step[:, None]).astype(np.uint8)
    error = turned - (low[:, None] + step[:, None] * units)
    packed = [np.packbits((units >> j) & 1, axis=1, bitorder="little").view(np.uint64) for j in range(planes)]
    return low, step, np.stack(packed, 1), np.sqrt((error * error).sum(1))


def popcount_sums(planes: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """For each anchor and row, the sum of the anchor's units over the ones of the code."""
    total = np.zeros((len(planes), len(codes)), np.int32)
    for j in range(planes.shape[1]):
        for w in range(codes.shape[1]):
            ones = np.bitwise_count(planes[:, j, w][:, None] & codes[:, w][None, :])
            total += ones.astype(np.int32) << j
    return total


class Anchors:
    """A block of anchors, ready to be held against rows."""

    def __init__(self, rows: Rows, turn: np.ndarray, planes: int):
        self.rows = rows
        _, turned = directions(rows.vectors, turn)
        self.low, self.step, self.planes, self.error = bit_planes(turned, planes)
        size = len(turn)
        ones = np.full((1, size // 64), ~np.uint64(0), np.uint64)
        self.all_units = popcount_sums(self.planes, ones)[:, 0]
        self.size = size

    def intervals(self, at: slice, rows: Rows) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Estimate, least and largest score of each anchor in ``at`` with each row."""
        held = np.bitwise_count(rows.codes).sum(1, dtype=np.int64)[None, :]
        units = popcount_sums(self.planes[at], rows.codes)
        low, step, error = (x[at][:, None] for x in (self.low, self.step, self.error))
        s = (low * (2 * held - self.size) + step * (2 * units - self.all_units[at][:, None])) / np.sqrt(self.size)
        a = np.minimum(rows.alignments, 1.0)[None, :]
        b = np.sqrt(1 - a * a)
        ends = [np.clip(s - error, -1, 1), np.clip(s + error, -1, 1)]
        wide = [b * np.sqrt(1 - e * e) for e in ends]
        # the upper bound has its top, 1, where s = a, the lower one its bottom, -1, where s = -a
        high = np.where((ends[0] <= a) & (a <= ends[1]), 1.0, np.maximum(a * ends[0] + wide[0], a * ends[1] + wide[1]))
        least = np.where((ends[0] <= -a) & (-a <= ends[1]), -1.0, np.minimum(a * ends[0] - wide[0], a * ends[1] - wide[1]))
        size = self.rows.norms[at][:, None] * rows.norms[None, :]
        return s / np.where(a, a, 1) * size, (least - SLACK) * size, (high + SLACK) * size

    def scores(self, i: np.ndarray, j: np.ndarray, rows: Rows) -> np.ndarray:
        """Integer inner products of the pairs (anchor i, row j)."""
        out = np.empty(len(i), np.int64)
        step = max(1, CHUNK // rows.vectors.shape[1])
        for k in range(0, len(i), step):
            part = slice(k, k + step)
            out[part] = np.einsum("ij,ij->i", self.rows.vectors[i[part]], rows.vectors[j[part]])
        return out


def best(group: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the first ``k`` of each group, highest score first, ties to the smaller id."""
    order = np.lexsort((ids, -score, group))
    of = group[order]
    first = np.flatnonzero(np.append(True, of[1:] != of[:-1])) if len(of) else np.zeros(0, np.int64)
    place = np.arange(len(of)) - np.repeat(first, np.diff(np.append(first, len(of))))
    return order[place < k]


class Held:
    """The first ``k`` scored rows of each group so far; ``least`` is what a row needs to come among them."""

    def __init__(self, floor: np.ndarray, k: int):
        self.k, self.floor, self.least = k, floor, floor.copy()
        self.group, self.score, self.ids = (np.zeros(0, np.int64) for _ in range(3))

    def add(self, group: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        group, score, ids = (np.concatenate(x) for x in ((self.group, group), (self.score, score), (self.ids, ids)))
        top = best(group, score, ids, self.k)
        self.group, self.score, self.ids = group[top], score[top], ids[top]
        n = np.bincount(self.group, minlength=len(self.least))
        full = np.flatnonzero(n == self.k)
        last = np.cumsum(n)[full] - 1
        self.least[full] = np.maximum(self.floor[full], self.score[last])


def searched(anchors: Anchors, rows: Rows, allowed, ceiling: np.ndarray, needed, scored) -> tuple[int, int]:
    """Scores every pair that ``allowed(anchors, rows)`` admits and whose interval reaches from
    ``needed()`` up to ``ceiling`` of its anchor. ``scored`` takes the pairs and their scores. Returns
    the number of admitted and of scored pairs."""
    step = max(1, CHUNK // max(1, len(anchors.rows.ids)))
    met = done = 0
    for k in range(0, len(rows.ids), step):
        part = Rows(*(x[k : k + step] for x in (rows.ids, rows.labels, rows.vectors, rows.codes, rows.alignments, rows.norms)))
        width = max(1, CHUNK // len(part.ids))
        for first in range(0, len(anchors.rows.ids), width):
            at = slice(first, first + width)
            estimate, low, high = anchors.intervals(at, part)
            open_ = allowed(at, part)
            met += int(open_.sum())
            open_ &= low <= ceiling[at][:, None]
            head = min(FIRST, len(part.ids))
            near = np.argpartition(-np.where(open_, estimate, -np.inf), head - 1, axis=1)[:, :head]
            early = np.zeros_like(open_)
            np.put_along_axis(early, near, True, 1)
            for wave in (early, ~early):
                i, j = np.nonzero(open_ & wave & (high >= needed()[at][:, None]))
                done += len(i)
                scored(i + first, j, part, anchors.scores(i + first, j, part))
    return met, done


def nearest_in_block(anchors: Anchors, rows: Rows, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, score, id): the first ``k`` rows of each anchor's label."""
    n = len(anchors.rows.ids)
    held = Held(np.full(n, np.iinfo(np.int64).min), k)

    def allowed(at, part):
        return (anchors.rows.labels[at][:, None] == part.labels) & (anchors.rows.ids[at][:, None] != part.ids)

    searched(anchors, rows, allowed, np.full(n, np.inf), lambda: held.least, lambda i, j, part, score: held.add(i, score, part.ids[j]))
    return held.group, held.score, held.ids


def negatives_in_block(anchors: Anchors, rows: Rows, low: np.ndarray, high: np.ndarray, k: int):
    """(anchor, place, score, id): for each band low..high (anchors x places; an empty band has low
    above high) the first ``k`` rows of other labels with a score in it."""
    n, places = low.shape
    held = Held(low.ravel().copy(), k)

    def allowed(at, part):
        return (anchors.rows.labels[at][:, None] != part.labels) & (anchors.rows.ids[at][:, None] != part.ids)

    def scored(i, j, part, score):
        within = (score[:, None] >= low[i]) & (score[:, None] <= high[i])
        pair, place = np.nonzero(within)
        held.add(i[pair] * places + place, score[pair], part.ids[j[pair]])

    def needed():
        return np.where(low <= high, held.least.reshape(n, places), np.iinfo(np.int64).max).min(1)

    top = np.where(low <= high, high, np.iinfo(np.int64).min).max(1)
    searched(anchors, rows, allowed, top.astype(np.float64), needed, scored)
    return *np.divmod(held.group, places), held.score, held.ids


def usable(vectors: DataFrame, label: Column, id_col: str, vec_col: str, scale: int) -> DataFrame:
    """(id, label, v, mark): the rows that take part, once each, components as integers."""
    v = F.col(vec_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), v.alias("x"))
    finite = F.forall("x", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("x").isNotNull() & finite)
    rows = rows.select("id", "label", F.transform("x", lambda x: F.floor(x * scale).cast("long")).alias("v"))
    return rows.distinct().withColumn("mark", F.xxhash64("label", "v"))


def hard_negatives(
    vectors: DataFrame,
    is_anchor: Column,
    label: Column | None = None,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    positives: int = 5,
    negatives: int = 5,
    band: tuple[int, int] = (80, 100),
    scale: int = 256,
    planes: int = 6,
    block_rows: int = 4096,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    The positives of an anchor are its first ``positives`` other rows of the same label; for each, the
    first ``negatives`` rows of other labels with band[0] * positive <= 100 * score <= band[1] * positive.
    ``is_anchor`` is a predicate over the id column, named ``id`` here.
    """
    rows = stored(usable(vectors, F.col("label") if label is None else label, id_col, vec_col, scale))
    lengths = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    length, total = (lengths[0]["n"], lengths[0]["count"]) if lengths else (0, 0)
    rows = rows.filter(F.size("v") == length)
    known = stored(coded(rows, length)) if length else coded(rows.limit(0), 1)
    anchors = known.filter(is_anchor)
    n_rows = max(1, -(-total // block_rows))
    n_anchors = max(1, -(-anchors.count() // block_rows))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    block = lambda n, salt: F.pmod(F.xxhash64("id", "mark", F.lit(salt)), F.lit(n)).cast("int")
    rows_in = known.withColumn("rb", block(n_rows, 0)).withColumn("ab", every(n_anchors)).groupBy("ab", "rb")
    met = lambda df: df.withColumn("ab", block(n_anchors, 1)).withColumn("rb", every(n_rows)).groupBy("ab", "rb")

    def ready(table: pa.Table) -> Anchors:
        return Anchors(Rows.of(table, length), rotation(code_bits(length)), planes)

    found_positive = "anchor_id long, mark long, score long, id long"

    def first_pass(left: pa.Table, right: pa.Table) -> pa.Table:
        i, score, ids = (np.zeros(0, np.int64),) * 3
        if len(left) and len(right):
            i, score, ids = nearest_in_block(ready(left), Rows.of(right, length), positives)
        marks = left["mark"].to_numpy()[i] if len(left) else i
        owner = left["id"].to_numpy()[i] if len(left) else i
        return pa.table({"anchor_id": owner, "mark": marks, "score": score, "id": ids})

    near = met(anchors).cogroup(rows_in).applyInArrow(first_pass, found_positive)
    of_anchor = Window.partitionBy("anchor_id", "mark").orderBy(F.desc("score"), "id")
    near = near.withColumn("place", F.row_number().over(of_anchor)).filter(F.col("place") <= positives)
    lists = F.array_sort(F.collect_list(F.struct("place", "score", "id"))).alias("near")
    near = stored(near.groupBy("anchor_id", "mark").agg(lists))

    found_negative = "anchor_id long, mark long, place int, positive_id long, positive_score long, negative_id long, negative_score long"

    def second_pass(left: pa.Table, right: pa.Table) -> pa.Table:
        lists = left["near"].to_pylist() if len(right) else []
        i, place, score, ids = (np.zeros(0, np.int64),) * 4
        positive = np.zeros((len(lists), positives, 2), np.int64)
        if lists:
            low, high = np.ones(positive.shape[:2], np.int64), np.zeros(positive.shape[:2], np.int64)
            for k, found in enumerate(lists):
                for p, row in enumerate(found):
                    positive[k, p] = row["id"], row["score"]
                    low[k, p], high[k, p] = -(-band[0] * row["score"] // 100), band[1] * row["score"] // 100
            i, place, score, ids = negatives_in_block(ready(left), Rows.of(right, length), low, high, negatives)
        owner, marks = (left[c].to_numpy()[i] if lists else i for c in ("id", "mark"))
        chosen = positive[i, place]
        return pa.table(
            {
                "anchor_id": owner, "mark": marks, "place": pa.array(place, pa.int32()),
                "positive_id": chosen[:, 0], "positive_score": chosen[:, 1], "negative_id": ids, "negative_score": score,
            }
        )

    near = near.withColumnsRenamed({"anchor_id": "of", "mark": "of_mark"})
    asked = anchors.join(near, (F.col("id") == F.col("of")) & (F.col("mark") == F.col("of_mark")))
    asked = asked.select(*(F.col(c).alias(c) for c in (*known.columns, "near")))  # columns of their own beside the rows'
    far = met(asked).cogroup(rows_in).applyInArrow(second_pass, found_negative)
    of_pair = Window.partitionBy("anchor_id", "mark", "place").orderBy(F.desc("negative_score"), "negative_id")
    far = far.withColumn("rank", F.row_number().over(of_pair)).filter(F.col("rank") <= negatives)
    return far.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
