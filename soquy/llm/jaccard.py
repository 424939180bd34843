"""Near-duplicate documents by an n-gram Jaccard join with several global orders.

The set of a text are its distinct word n-grams, as 64-bit hashes. Under any order of all n-grams
that is the same for every text, two sets of similarity ``share`` or more have an n-gram in common
among their first ``n - ceil(share * n) + 1``. Candidates must have one under each of ``ORDERS``
different orders: pairs come from the first order, the other two are intersected with it, and only
then are whole sets compared.

All orders put rare n-grams first. How often an n-gram occurs is taken from one table of counters
over all texts, of a fixed size, indexed by hash; n-grams are ordered by the power of two of their
counter and, within that, by a hash of their own for each order. Any order gives right results, a
good one gives few candidates: an n-gram of a passage in very many texts comes last.

Links are needed to tell classes, not all pairs of a class. So the join goes in two steps. First each
n-gram's texts are compared with one of them (the smallest by id), and the links found make classes.
Then only pairs of different classes that share an n-gram are left; these are compared, all of them.
A text that is linked is so found whatever the size of its class, and large groups of near copies
cost a few comparisons for each text.

* Texts with equal sets are one node, so copies are never compared. Node ids are 64-bit hashes of
  the set.
* A text of fewer words than ``size`` is one n-gram; one without words (or null) has an empty set,
  is linked with nothing and is its own class.
* The class of a row is the smallest document id in it. Rows without an id take part; a class
  without any id has a null class id. Repeated rows are equal sets, and so are linked.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from soquy.llm.common import Scratch, chunks, lean, mix, slices, stored, text_bytes, words

ORDERS = 3
CELLS = 1 << 20
FILTER_CELLS = 1 << 22
LONG = 3_000
BLOCK = 1 << 12
WORD_BYTES = np.array([not (b == 0x20 or 0x09 <= b <= 0x0D) for b in range(256)])


def shingle_sets(texts: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct n-gram hashes of several texts, one after the other, and their bounds."""
    hashed, _, _, owner = words(texts, WORD_BYTES)
    n_words = np.bincount(owner, minlength=len(texts))
    first = np.cumsum(n_words) - n_words
    parts = [hashed * np.uint64(0x9E3779B97F4A7C15 + 2 * k) for k in range(size)]
    if len(hashed) >= size:
        total = len(hashed) - size + 1
        grams = mix(sum((mix(parts[k][k : k + total]) for k in range(1, size)), parts[0][:total]))
        whole = owner[:total] == owner[size - 1 :]
        grams, of = grams[whole], owner[:total][whole]
    else:
        grams, of = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    short = np.flatnonzero((n_words > 0) & (n_words < size))
    few = [mix(sum((mix(parts[k][first[t] + k : first[t] + k + 1]) for k in range(1, n_words[t])), parts[0][first[t] : first[t] + 1])) for t in short]
    grams, of = np.concatenate([grams, *few]), np.concatenate([of, short]).astype(np.int64)
    bounds = np.searchsorted(of, np.arange(len(texts) + 1)) if not len(short) else None
    if bounds is None:
        by_text = np.argsort(of, kind="stable")
        grams, of = grams[by_text], of[by_text]
        bounds = np.searchsorted(of, np.arange(len(texts) + 1))
    for k in range(len(texts)):
        grams[bounds[k] : bounds[k + 1]].sort()
    new = np.ones(len(grams), bool)
    new[1:] = (grams[1:] != grams[:-1]) | (of[1:] != of[:-1])
    grams, of = grams[new], of[new]
    return grams, np.searchsorted(of, np.arange(len(texts) + 1))


def sets_of(batches: Iterator[pa.RecordBatch], size: int):
    """(batch, first row, n-grams, bounds) for chunks of the texts of all batches."""
    for batch in slices(batches):
        texts = text_bytes(batch["text"])
        for first, end in chunks([len(t) for t in texts]):
            yield batch, first, *shingle_sets(texts[first:end], size)


def counters(docs: DataFrame, size: int) -> np.ndarray:
    """How many texts have an n-gram of each cell: one table for the corpus, of CELLS numbers."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(CELLS, np.int64)
        for _, _, grams, _ in sets_of(batches, size):
            cells += np.bincount((grams & np.uint64(CELLS - 1)).astype(np.int64), minlength=CELLS)
        for k, part in enumerate(cells.reshape(-1, BLOCK)):
            if part.any():
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k], pa.int32()), pa.array([part.astype("<i8").tobytes()])], names=["block", "cells"]
                )

    def add(parts: pa.Table) -> pa.Table:
        total = np.zeros(BLOCK, np.int64)
        for cells in parts["cells"].to_pylist():
            total += np.frombuffer(cells, "<i8")
        return pa.table({"block": parts["block"][:1], "cells": pa.array([total.tobytes()])})

    schema = "block int, cells binary"
    found = docs.mapInArrow(lean(count), schema).groupBy("block").applyInArrow(add, schema).collect()
    cells = np.zeros((CELLS // BLOCK, BLOCK), np.int64)
    for row in found:  # 256 rows
        cells[row["block"]] = np.frombuffer(row["cells"], "<i8")
    return cells.ravel()


def levels(cells: np.ndarray) -> np.ndarray:
    """The power of two of each counter, a byte each."""
    return np.frexp(cells.astype(np.float64))[1].astype(np.uint8)


def ranked(grams: np.ndarray, level: np.ndarray, order: int) -> np.ndarray:
    """Keys that sort n-grams by one of the global orders. The key tells the n-gram as well."""
    of = level[(grams & np.uint64(CELLS - 1)).astype(np.int64)].astype(np.uint64)
    return (of << np.uint64(56)) | (mix(grams + np.uint64(order)) >> np.uint64(8))


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def smallest(grams: np.ndarray, level: np.ndarray, order: int, percent: int) -> np.ndarray:
    """The prefix of a set under one order, as keys in that order."""
    keys, length = ranked(grams, level, order), prefix_length(len(grams), percent)
    return np.sort(np.partition(keys, length - 1)[:length])


def node_id(grams: np.ndarray) -> int:
    return int(mix(mix(grams).sum(keepdims=True) + np.uint64(len(grams))).view(np.int64)[0])


def parity(grams: np.ndarray) -> bytes:
    """1024 bits (8192 for a set of more than LONG), each whether an odd number of n-grams falls on
    it. Two sets differ by at least as many n-grams as these bits differ."""
    bits = 8192 if len(grams) > LONG else 1024
    odd = np.bincount(((grams >> np.uint64(32)) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def parities(column: list[bytes], wide: bool) -> np.ndarray:
    """Parities as rows of 64-bit words: as they are, or folded to 1024 bits."""
    if wide:
        return np.frombuffer(b"".join(column), np.uint64).reshape(len(column), -1)
    folded = [p if len(p) == 128 else np.bitwise_xor.reduce(np.frombuffer(p, np.uint64).reshape(-1, 16)).tobytes() for p in column]
    return np.frombuffer(b"".join(folded), np.uint64).reshape(len(column), -1)


def signatures(docs: DataFrame, keep: list[str], size: int, percent: int, level) -> DataFrame:
    """The columns to keep, the node of each row, and of its set the size, the prefix under order 0 and
    the parities."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, first, grams, bounds in sets_of(batches, size):
            nodes, prefixes, parities = [], [], []
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                nodes.append(node_id(grams[a:b]) if b > a else None)
                parities.append(parity(grams[a:b]))
                prefixes.append(smallest(grams[a:b], level.value, 0, percent).view(np.int64) if b > a else [])
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch[c].slice(first, len(nodes)) for c in keep),
                    pa.array(nodes, pa.int64()),
                    pa.array(np.diff(bounds)),
                    pa.array(prefixes, pa.list_(pa.int64())),
                    pa.array(parities, pa.binary()),
                ],
                names=[*keep, "node", "n", "prefix", "parity"],
            )

    kinds = {"node": "long", "n": "long", "prefix": "array<long>", "parity": "binary"}
    schema = docs.select(*keep, *(F.lit(None).cast(t).alias(c) for c, t in kinds.items())).schema
    return docs.mapInArrow(lean(run), schema)


def whole_sets(texts: DataFrame, size: int, percent: int, level, marks) -> DataFrame:
    """(node, n, grams, second, third) of the texts with a marked text_key; a row like the one before
    it is left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = None
        for _, _, grams, bounds in sets_of(picked(batches, marks, "text_key"), size):
            rows = []
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                own = grams[a:b]
                node = node_id(own) if b > a else None
                if node != done and b > a:
                    others = [(smallest(own, level.value, o, percent) & np.uint64(0xFFFFFFFF)).astype(np.uint32).view(np.int32) for o in range(1, ORDERS)]
                    rows.append((node, b - a, own.view(np.int64), *others))
                done = node
            if rows:
                kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)],
                    names=["node", "n", "grams", "second", "third"],
                )

    return texts.mapInArrow(
        lean(run), "node long, n long, grams array<long>, second array<int>, third array<int>"
    )


def marks_of(keys: DataFrame, key: str):
    """A table of ``FILTER_CELLS`` bits, of that size whatever the number of keys, with those of the
    keys set. It goes to all tasks, which pick out texts by it, so that no text is shuffled."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = np.zeros(FILTER_CELLS, np.uint8)
        for batch in batches:
            marks[cells_of(batch[key])] = 1
        for k, part in enumerate(marks.reshape(-1, BLOCK)):
            if part.any():
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k], pa.int32()), pa.array([part.tobytes()])], names=["block", "cells"]
                )

    def either(parts: pa.Table) -> pa.Table:
        both = np.zeros(BLOCK, np.uint8)
        for cells in parts["cells"].to_pylist():
            both |= np.frombuffer(cells, np.uint8)
        return pa.table({"block": parts["block"][:1], "cells": pa.array([both.tobytes()])})

    schema = "block int, cells binary"
    marks = np.zeros((FILTER_CELLS // BLOCK, BLOCK), bool)
    for row in keys.select(key).mapInArrow(lean(mark), schema).groupBy("block").applyInArrow(either, schema).collect():
        marks[row["block"]] = np.frombuffer(row["cells"], np.uint8)
    return keys.sparkSession.sparkContext.broadcast(np.packbits(marks.ravel()))


def picked(batches: Iterator[pa.RecordBatch], marks, key: str) -> Iterator[pa.RecordBatch]:
    """The rows whose key is among the marked ones, and some others."""
    marked = np.unpackbits(marks.value).astype(bool)
    for batch in batches:
        yield batch.filter(pa.array(marked[cells_of(batch[key])]))


def cells_of(keys: pa.Array) -> np.ndarray:
    return (mix(keys.to_numpy(zero_copy_only=False).view(np.uint64)) & np.uint64(FILTER_CELLS - 1)).astype(np.int64)


def near_enough(percent: int):
    """Keeps pairs whose sizes and parities allow the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_a, n_b = batch["n_a"].to_numpy(), batch["n"].to_numpy()
            columns = [batch[c].to_pylist() for c in ("parity_a", "parity_b")]
            both, near = (n_a > LONG) & (n_b > LONG), np.zeros(len(n_a), bool)
            for wide in (False, True):
                rows = np.flatnonzero(both == wide)
                if len(rows):
                    a, b = (parities([c[k] for k in rows], wide) for c in columns)
                    near[rows] = may_link(np.bitwise_count(a ^ b).sum(1), n_a[rows], n_b[rows], percent)
            yield batch.select(["a", "b", "n"]).filter(pa.array(near))

    return run


def may_link(apart: np.ndarray, n_a, n_b, percent: int) -> np.ndarray:
    """Whether sets of these sizes that differ by ``apart`` n-grams at least can be similar enough."""
    return (apart * (100 + percent) <= (100 - percent) * (n_a + n_b)) & (
        100 * np.minimum(n_a, n_b) >= percent * np.maximum(n_a, n_b)
    )


def flipped(column: Column | str) -> Column:
    """A key of its own for a join: both sides stay plain exchanges, which adaptive execution can
    split where a value is crowded."""
    return (F.col(column) if isinstance(column, str) else column).bitwiseXOR(F.lit(1))


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b) of the pairs (a, b, n of b) that are linked: sizes first, then the prefixes under the
    other orders, then the whole sets."""
    left = sets.select(F.col("node").alias("of_a"), *(F.col(c).alias(f"{c}_a") for c in ("n", "grams", "second", "third")))
    right = sets.select(F.col("node").alias("of_b"), *(F.col(c).alias(f"{c}_b") for c in ("grams", "second", "third")))
    sized = pairs.join(left, F.col("a") == F.col("of_a")).filter(
        100 * F.least("n", "n_a") >= percent * F.greatest("n", "n_a")
    )
    both = sized.join(right, F.col("b") == F.col("of_b"))
    both = both.filter(F.arrays_overlap("second_a", "second_b") & F.arrays_overlap("third_a", "third_b"))
    shared = F.size(F.array_intersect("grams_a", "grams_b"))
    return both.filter(100 * shared >= percent * (F.col("n_a") + F.col("n") - shared)).select("a", "b")


def both_ways(first: list[Column], second: list[Column]) -> Column:
    """Two rows in the place of one; a union would work out the rows before it twice."""
    return F.inline(F.array(F.struct(*first), F.struct(*second)))


def are_stars(edges: DataFrame) -> bool:
    """Whether every u has one v, and no v is a u."""
    up, down = ([F.col(c).alias("node"), F.lit(int(c == "u")).alias("up"), F.lit(int(c == "v")).alias("down")] for c in "uv")
    ends = edges.select(both_ways(up, down)).groupBy("node").agg(F.sum("up").alias("up"), F.sum("down").alias("down"))
    return not ends.filter("up > 1 or (up > 0 and down > 0)").agg(F.count("*")).first()[0]


def classes(links: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """(node, root): for every linked node but the smallest of its class, that smallest node.

    Large and small stars in turn: each round hangs the neighbours of a node on the smallest of
    them, until all classes are stars. What a step needs twice is stored: the driver keeps the plan
    and the tasks of every query, and tasks are as many as partitions, however few the links.
    """
    scratch = scratch or Scratch()
    u, v, m = F.col("u"), F.col("v"), F.col("m")
    edges = scratch.stored(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct())
    while not are_stars(edges):
        both = edges.select(both_ways([u, v], [v.alias("u"), u.alias("v")]))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(flipped("u").alias("k"), F.least("u", "m").alias("m"))
        large = both.join(low, flipped("u") == F.col("k")).filter("v > u").select(v.alias("u"), m.alias("v"))
        large = scratch.stored(large.filter("u != v"))
        low = large.groupBy("u").agg(F.min("v").alias("m")).select(flipped("u").alias("k"), "m")
        met = large.join(low, flipped("u") == F.col("k"))
        small = met.select(both_ways([v.alias("u"), m.alias("v")], [u, m.alias("v")]))
        edges = scratch.stored(small.filter("u != v").distinct())
    return edges.select(u.alias("node"), v.alias("root"))


def compare_classes(percent: int):
    """Pairs of different classes within one n-gram's part, as far as sizes, the n-gram's places in
    the two prefixes, and parities allow. Parities of long sets are left for later."""

    def run(bucket: pa.Table) -> pa.Table:
        part = np.array([bucket[c].to_numpy() for c in ("gram", "i", "j")])
        order = np.lexsort((bucket["n"].to_numpy(), *part[::-1]))
        part = part[:, order]
        node, root, n, block, place = (bucket[c].to_numpy()[order] for c in ("node", "root", "n", "block", "place"))
        held = bucket["parity"].to_pylist()
        bits = np.frombuffer(b"".join(held[k] or bytes(128) for k in order), np.uint64).reshape(-1, 16)
        cuts = np.flatnonzero(np.append(True, (part[:, 1:] != part[:, :-1]).any(0)))
        found = []
        for first, end in zip(cuts, np.append(cuts[1:], len(node)), strict=True):
            reach = np.searchsorted(n[first:end], n[first:end] * 100 // percent, side="right") + first
            for k in range(first, end - 1):
                near = slice(k + 1, reach[k - first])
                other = root[near] != root[k]
                if part[1, k] != part[2, k]:
                    other &= block[near] != block[k]
                if not other.any():
                    continue
                at = np.flatnonzero(other) + k + 1
                # the first n-gram in common leaves room for as many others as come behind it
                room = np.minimum(n[at] - place[at], n[k] - place[k])
                at = at[room * (100 + percent) >= percent * (n[at] + n[k])]
                if not len(at):
                    continue
                apart = np.bitwise_count(bits[at] ^ bits[k]).sum(1)
                at = at[(n[at] > LONG) | may_link(apart, n[at], n[k], percent)]
                if len(at):
                    a, b = np.minimum(node[at], node[k]), np.maximum(node[at], node[k])
                    found.append(np.array([a, b, np.where(node[at] > node[k], n[at], n[k]), n[at] > LONG]))
        a, b, size, late = np.concatenate(found, axis=1) if found else np.zeros((4, 0), np.int64)
        return pa.table({"a": pa.array(a), "b": pa.array(b), "n": pa.array(size), "late": pa.array(late == 1)})

    return run


def with_parities(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(a, b, n_a, n, parity_a, parity_b) of pairs (a, b)."""
    side = lambda c: nodes.select(F.col("node").alias(f"of_{c}"), F.col("n").alias(f"n_{c}"), F.col("parity").alias(f"parity_{c}"))
    both = pairs.select("a", "b").join(side("a"), F.col("a") == F.col("of_a"))
    both = both.join(side("b"), F.col("b") == F.col("of_b"))
    return both.select("a", "b", "n_a", F.col("n_b").alias("n"), "parity_a", "parity_b")


PAIRS = "a long, b long, n long"


def cross_pairs(shared: DataFrame, roots: DataFrame, nodes: DataFrame, percent: int, part_rows: int = 2048, scratch: Scratch | None = None) -> DataFrame:
    """(a, b, n of b): pairs of nodes in different classes that share an n-gram. The nodes of a
    crowded n-gram are dealt into blocks, and any two blocks meet in a task of their own."""
    scratch = scratch or Scratch()
    named = roots.select(F.col("node").alias("of"), "root")
    rows = shared.select("gram", "node", "places", "place").join(named, F.col("node") == F.col("of"), "left").drop("of")
    rows = scratch.stored(rows.withColumn("root", F.coalesce("root", "node")))
    mixed = rows.groupBy("gram").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low != high")
    rows = rows.join(mixed.select(flipped("gram").alias("k")), flipped("gram") == F.col("k"), "left_semi")
    parts = F.ceil(F.col("places") / part_rows)
    rows = scratch.stored(rows.withColumn("parts", parts).withColumn("block", F.pmod(F.xxhash64("node"), F.col("parts"))))
    n_buckets = max(1, rows.agg(F.sum("parts")).first()[0] or 0) // 20_000 + 1
    known = nodes.select(F.col("node").alias("of"), "n", F.when(F.col("n") <= LONG, F.col("parity")).alias("parity"))
    dealt = (
        rows.join(known, F.col("node") == F.col("of"))
        .withColumn("with", F.explode(F.expr("sequence(0L, parts - 1)")))
        .withColumn("i", F.least("block", "with"))
        .withColumn("j", F.greatest("block", "with"))
        .withColumn("bucket", F.pmod(F.xxhash64("gram", "i", "j"), F.lit(n_buckets)))
        .select("bucket", "gram", "i", "j", "block", "node", "root", "n", "place", "parity")
    )
    found = dealt.groupBy("bucket").applyInArrow(compare_classes(percent), f"{PAIRS}, late boolean")
    found = scratch.stored(found.distinct())
    late = with_parities(found.filter("late"), nodes).mapInArrow(lean(near_enough(percent)), PAIRS)
    return found.filter("not late").select("a", "b", "n").union(late)


def near_duplicates(
    docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id_col, n_shingles, component_id) of every row: the size of its set and the smallest id of
    its class. Rows link whose sets have ``100 * common >= percent * union``."""
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.xxhash64(text).alias("text_key"))
    scratch, wide = Scratch(), Scratch()
    level = docs.sparkSession.sparkContext.broadcast(levels(counters(rows.select("text"), size)))
    full = wide.stored(signatures(rows, ["id", "text_key"], size, percent, level))
    signed = scratch.stored(full.select("id", "text_key", "node", "n"))
    of_rows, prefixed = (df.filter("node is not null") for df in (signed, full))
    nodes = scratch.stored(prefixed.select("node", "n", "parity").distinct())
    listed = prefixed.select(F.posexplode("prefix").alias("place", "gram"), "node").repartition("gram").distinct()
    groups = listed.groupBy("gram").agg(F.count("*").alias("places"), F.min("node").alias("lead")).filter("places > 1")
    shared = scratch.stored(listed.join(groups, "gram"))
    wide.clear()

    def linked(pairs: DataFrame) -> DataFrame:
        """Links among the pairs; the sets of their nodes are counted anew from one text of each."""
        ends = pairs.select(F.col("a").alias("of")).union(pairs.select("b")).distinct()
        keys = of_rows.groupBy("node").agg(F.min("text_key").alias("text_key"))
        keys = keys.join(ends, F.col("node") == F.col("of")).select("text_key")
        texts = rows.select("text", "text_key")
        marks = marks_of(keys, "text_key")
        sets = wide.stored(whole_sets(texts, size, percent, level, marks))
        marks.destroy()
        found = scratch.stored(verified(pairs, sets, percent))
        wide.clear()
        return found

    stars = shared.filter("node != lead").select(F.col("lead").alias("a"), F.col("node").alias("b")).distinct()
    links = linked(scratch.stored(with_parities(stars, nodes).mapInArrow(lean(near_enough(percent)), PAIRS)))
    roots = classes(links, scratch)
    further = linked(scratch.stored(cross_pairs(shared, roots, nodes, percent, scratch=scratch)))
    if not further.isEmpty():  # the classes so far are stars already
        roots = classes(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(further), scratch)
    smallest_id = of_rows.groupBy("node").agg(F.min("id").alias("low"))
    rooted = smallest_id.join(roots.withColumnRenamed("node", "of"), F.col("node") == F.col("of"), "left")
    rooted = scratch.stored(rooted.select("node", "low", F.coalesce("root", "node").alias("root")))
    of_class = rooted.groupBy("root").agg(F.min("low").alias("component")).select(flipped("root").alias("k"), "component")
    of_node = rooted.join(of_class, flipped("root") == F.col("k")).select(flipped("node").alias("of"), "component")
    out = signed.select("id", "node", "n").join(of_node, flipped("node") == F.col("of"), "left")
    result = stored(out.select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_shingles"),
        F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("component")).alias("component_id"),
    ))
    scratch.clear()
    level.destroy()
    return result
