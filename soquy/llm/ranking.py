"""Ranked lexical search of many queries at once by shared partial accumulators.

Every item (query) is the set of its terms, and a document's score for it is a sum over these. What
items have in common is evaluated once:

1. Terms that stand in exactly the same items are one *shared set*. Of each item, the sets are put in
   one order for all items, those in most items first, and the pair of neighbours that most items
   have becomes a set of its own, again and again, until no pair stands in two items. The result is
   a graph without cycles: sets of terms at the leaves, sums of two nodes above, items on top.
2. For a block of documents each leaf gets an accumulator, the partial sums of its terms for every
   document. Inner nodes add two accumulators, items add those of their nodes. An accumulator is
   computed once for all items above it, whatever their number.

Terms are read from whole texts once. What is kept of a document is its length and the occurrences of
the items' terms, stored as a table; document frequencies are counted from it before anything is
scored. A task gives back ``k`` documents for each item, and these are merged by a top-k.

The graph and the terms of at most about ``part_terms`` terms are broadcast at a time. More items are
dealt into parts (a part has one item at least), which are evaluated one after the other; then items
share only within their part.

Weights are integers: a term's is floor(1000 * ln((2N+2) / (2df+1))) in doubles, a document's m is
100 - b + (b * n * N) div L, and tf occurrences add weight * ((10**9 * tf) div (1000 * tf + 8 * m)).
N counts documents with a term, L all terms, n those of the document.

* A term is a run of ASCII letters and digits and characters beyond ASCII; only A-Z are lower-cased.
  Null and empty texts have no terms, neither as item nor as document.
* Rows with the same item id are one item with the terms of all; a null item id is an id.
* Documents with a score of 0 are not returned. Equal scores go by ascending id, null ids last; rows
  with the same id are ranked each for itself. Without items or documents the result is empty.
* Only the id and text columns are read; other columns may have any names. Document ids are integers.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from soquy.llm.common import stored, text_bytes

# Lower-case letters for A-Z, a space for every other ASCII character but letters and digits.
TERM_BYTES = bytes(
    b | 0x20 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20
    for b in range(256)
)
LENGTH_SHARE = 90
CELLS = 1 << 22
"""Accumulator cells (nodes x documents) that a task holds at a time."""
LAST_ID = (1 << 63) - 1


def terms(text: bytes) -> list[bytes]:
    return text.translate(TERM_BYTES).split()


def item_terms(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(item, term) of all items, once each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sorted(set(terms(t))) for t in text_bytes(batch["text"])]
            yield pa.RecordBatch.from_arrays([batch["item"], pa.array(found, pa.list_(pa.binary()))], names=["item", "terms"])

    rows = items.select(F.col(id_col).alias("item"), F.col(text_col).cast("string").alias("text"))
    schema = T.StructType([rows.schema["item"], T.StructField("terms", T.ArrayType(T.BinaryType()))])
    return rows.mapInArrow(run, schema).select("item", F.explode("terms").alias("term")).distinct()


def shared_sets(item_of: list[int], term_of: list[int], n_items: int) -> tuple[list[list[int]], list[tuple[int, int]], list[list[int]]]:
    """Leaves (lists of terms), inner nodes (pairs of earlier nodes; their numbers follow the leaves)
    and, for each item, the nodes whose terms together are its terms, each once."""
    holders = defaultdict(list)
    for item, term in sorted(zip(item_of, term_of, strict=True)):
        holders[term].append(item)
    by_items = defaultdict(list)
    for term, its in holders.items():
        by_items[tuple(its)].append(term)
    ordered = sorted(by_items.items(), key=lambda x: (-len(x[0]), x[0]))
    leaves = [found for _, found in ordered]
    rows: list[list[int]] = [[] for _ in range(n_items)]
    for node, (its, _) in enumerate(ordered):
        for item in its:
            rows[item].append(node)
    pairs: list[tuple[int, int]] = []
    while True:
        seen = Counter(p for row in rows for p in zip(row[:-1], row[1:], strict=True))
        number: dict[tuple[int, int], int] = {}
        merged = []
        for row in rows:
            out, k = [], 0
            while k < len(row):
                pair = tuple(row[k : k + 2])
                behind = seen[tuple(row[k + 1 : k + 3])] if k + 2 < len(row) else 0
                if len(pair) == 2 and seen[pair] > 1 and seen[pair] >= behind:
                    out.append(number.setdefault(pair, len(leaves) + len(pairs) + len(number)))
                    k += 2
                else:
                    out.append(row[k])
                    k += 1
            merged.append(out)
        if not number:
            return leaves, pairs, rows
        pairs += number
        rows = merged


def mined(parts: DataFrame) -> DataFrame:
    """Rows (part, item, term) as one graph for each part: (part, leaf_terms, pairs, items, item_nodes).
    A part has a bounded number of terms."""
    item = parts.schema["item"]
    schema = T.StructType(
        [
            T.StructField("part", T.LongType()),
            T.StructField("terms", T.ArrayType(T.BinaryType())),
            T.StructField("leaf_of", T.ArrayType(T.IntegerType())),
            T.StructField("pairs", T.ArrayType(T.ArrayType(T.IntegerType()))),
            T.StructField("items", T.ArrayType(item.dataType)),
            T.StructField("nodes", T.ArrayType(T.ArrayType(T.IntegerType()))),
        ]
    )

    def run(part: pa.Table) -> pa.Table:
        items, found = (part[c].combine_chunks().dictionary_encode(null_encoding="encode") for c in ("item", "term"))
        leaves, pairs, nodes = shared_sets(items.indices.to_pylist(), found.indices.to_pylist(), len(items.dictionary))
        leaf_of = [0] * len(found.dictionary)
        for leaf, held in enumerate(leaves):
            for term in held:
                leaf_of[term] = leaf
        lists = pa.list_(pa.list_(pa.int32()))
        return pa.table(
            {
                "part": part["part"][:1],
                "terms": pa.array([found.dictionary.to_pylist()], pa.list_(pa.binary())),
                "leaf_of": pa.array([leaf_of], pa.list_(pa.int32())),
                "pairs": pa.array([[list(p) for p in pairs]], lists),
                "items": pa.array([items.dictionary.to_pylist()], pa.list_(items.dictionary.type)),
                "nodes": pa.array([nodes], lists),
            }
        )

    return parts.groupBy("part").applyInArrow(run, schema)


INDEX = "id long, n long, term array<int>, tf array<int>"


def indexed(docs: DataFrame, vocabulary) -> DataFrame:
    """(id, n, term, tf) of every document with a term: its length and the occurrences of the
    vocabulary's terms, by their numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {term: k for k, term in enumerate(vocabulary.value)}
        for batch in batches:
            ids, rows = batch["id"].to_pylist(), []
            for doc, text in zip(ids, text_bytes(batch["text"]), strict=True):
                own = terms(text)
                if own:
                    seen = Counter(own)
                    known = seen.keys() & number.keys()
                    rows.append((doc, len(own), [number[t] for t in known], [seen[t] for t in known]))
            if rows:
                kinds = [pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32())]
                columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "n", "term", "tf"])

    return docs.mapInArrow(run, INDEX)


def accumulate(leaf: np.ndarray, doc: np.ndarray, parts: np.ndarray, n_leaves: int, n_docs: int, pairs: np.ndarray) -> np.ndarray:
    """The accumulators (nodes x documents): leaves summed from the parts, every other node from two."""
    sums = np.zeros((n_leaves + len(pairs), n_docs), np.int64)
    np.add.at(sums.reshape(-1), leaf * n_docs + doc, parts)
    for k, (a, b) in enumerate(pairs, n_leaves):
        np.add(sums[a], sums[b], out=sums[k])
    return sums


class Best:
    """The first ``k`` documents of each item so far: highest score first, ties to the smaller id."""

    def __init__(self, n_items: int, k: int):
        self.k = k
        self.rows = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in range(n_items)]
        self.least = np.ones(n_items, np.int64)

    def add(self, item: int, score: np.ndarray, ids: np.ndarray) -> None:
        near = np.flatnonzero(score >= self.least[item])
        if len(near):
            old_score, old_ids = self.rows[item]
            score, ids = np.append(old_score, score[near]), np.append(old_ids, ids[near])
            order = np.lexsort((ids, -score))[: self.k]
            self.rows[item] = score[order], ids[order]
            if len(order) == self.k:
                self.least[item] = score[order[-1]]


def ranked_in_task(index: DataFrame, graph, weights, totals: tuple[int, int], k: int) -> DataFrame:
    """(item, id, score): the first ``k`` documents of each item among those of each task; ``item`` by
    its number in the graph."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leaf_of, pairs, nodes = (graph.value[c] for c in ("leaf_of", "pairs", "nodes"))
        leaf_of, weight = np.array(leaf_of, np.int64), weights.value
        n_leaves, n_docs, n_terms = int(leaf_of.max(initial=-1)) + 1, *totals
        block = max(1, CELLS // max(1, n_leaves + len(pairs)))
        found = Best(len(nodes), k)
        for batch in batches:
            for at in range(0, len(batch), block):
                part = batch.slice(at, block)
                ids = part["id"].fill_null(LAST_ID).to_numpy()
                m = 100 - LENGTH_SHARE + LENGTH_SHARE * part["n"].to_numpy() * n_docs // n_terms
                doc = np.repeat(np.arange(len(part)), part["term"].value_lengths().to_numpy())
                term, tf = part["term"].flatten().to_numpy(), part["tf"].flatten().to_numpy().astype(np.int64)
                parts = weight[term] * (1_000_000_000 * tf // (1000 * tf + 8 * m[doc]))
                sums = accumulate(leaf_of[term], doc, parts, n_leaves, len(part), pairs)
                for item, own in enumerate(nodes):
                    found.add(item, sums[own].sum(0), ids)
        item = np.repeat(np.arange(len(nodes)), [len(r[0]) for r in found.rows])
        score, ids = (np.concatenate([np.zeros(0, np.int64), *(r[c] for r in found.rows)]) for c in (0, 1))
        yield pa.RecordBatch.from_arrays(
            [pa.array(item, pa.int32()), pa.array(ids, mask=ids == LAST_ID), pa.array(score)], names=["item", "id", "score"]
        )

    return index.mapInArrow(run, "item int, id long, score long")


def search(
    docs: DataFrame,
    items: DataFrame,
    k: int = 10,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    part_terms: int = 100_000,
) -> DataFrame:
    """(item_col, rank, id_col, score): the ``k`` highest-scoring documents of each item."""
    spark = docs.sparkSession
    asked = stored(item_terms(items, item_col, item_text_col))
    n_parts = max(1, -(-asked.count() // part_terms))
    dealt = asked.withColumn("part", F.pmod(F.xxhash64("item"), F.lit(n_parts)))
    graphs = stored(mined(dealt))
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    item = items.schema[item_col]
    schema = T.StructType([T.StructField("number", T.IntegerType()), T.StructField("asked", item.dataType)])
    nothing = spark.createDataFrame([], schema)
    out = nothing.select("asked", *(F.lit(None).cast(t).alias(c) for c, t in (("rank", "int"), ("id", "long"), ("score", "long"))))
    for part in range(n_parts):  # one part is broadcast at a time
        row = graphs.filter(F.col("part") == part).first()
        if row is None:
            continue
        index = stored(indexed(texts, spark.sparkContext.broadcast([bytes(t) for t in row["terms"]])))
        n_docs, n_terms = index.agg(F.count("*"), F.sum("n")).first()
        held = index.select(F.explode("term").alias("term")).groupBy("term").count().collect()  # a row for each term
        weights = np.zeros(len(row["terms"]), np.int64)
        for r in held:  # a term that no document has adds nothing
            weights[r["term"]] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * r["count"] + 1)))
        graph = spark.sparkContext.broadcast({c: row[c] for c in ("leaf_of", "pairs", "nodes")})
        near = ranked_in_task(index, graph, spark.sparkContext.broadcast(weights), (n_docs, n_terms or 1), k)
        order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("id"))
        near = near.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        names = spark.createDataFrame(list(enumerate(row["items"])), schema)
        out = out.union(near.join(names, F.col("item") == F.col("number")).select("asked", "rank", "id", "score"))
    return out.select(F.col("asked").alias(item_col), "rank", F.col("id").alias(id_col), "score")
