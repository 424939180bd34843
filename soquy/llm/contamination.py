"""Benchmark decontamination over a stored positional inverted index.

``PositionalIndex`` stores the postings of all terms of all texts: one row per term and segment (the
texts of a task, about ``segment_bytes`` of them at a time) with the positions of its occurrences. Each
task writes its own segments, sorted by term, so that Parquet finds the pages of a term without the
others and a frequent term is never in one place. A row of its own per segment says which text begins at
which position. Texts leave one position free behind them, so consecutive positions never cross texts.

A search joins each window of ``size`` consecutive benchmark words with the postings of its rarest
term (by its count over all texts); in the segments that have it, the list is shifted by the term's
offset and intersected with the shifted lists of the other terms, from the rarest on. What is left
are exact phrase matches. ``proximity`` looks for the ``rarest`` terms of an item within a given
number of words, in any order, on the same lists.

* Words are runs of ASCII letters and digits and of all bytes outside ASCII; A-Z count as a-z. Null
  has no words. A match never crosses texts. Terms are kept as 64-bit hashes.
* An item of fewer words than a window, but not none, is one window. Items without id or text count
  for nothing; an empty benchmark hits nothing.
* Windows, counts and lists stay in Spark tables. A task holds the benchmark's lists of one segment
  and the lookups of one part of about ``part_windows`` windows there.
* Items with equal windows all count; a repeated item_id counts once. Every row of the texts gets
  its own result, repeated ones too; columns of the names in ``ADDED`` are replaced.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from soquy.llm.common import Scratch, chunks, hidden, lean, merged, slices, spans, text_bytes, words

ADDED = ("n_words", "hit_starts", "hit_ends", "items")
FAR = 1 << 40
WORD_BYTES = np.array([b > 0x7F or chr(b).isalnum() for b in range(256)])
SEGMENT_BYTES = 1 << 25
POSTED_ROWS = 20_000
STARTS = 1 << 20
"""Places that are looked at in one go."""
POSTING = "segment long, term long, n int, positions array<int>, rows array<long>"


def term_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The words of several texts as hashes, and the number of the text each belongs to."""
    hashed, owners = [], []
    for first, end in chunks([len(t) for t in texts]):
        terms, _, _, owner = words(texts[first:end], WORD_BYTES)
        hashed.append(terms.view(np.int64))
        owners.append(owner + first)
    return np.concatenate([np.zeros(0, np.int64), *hashed]), np.concatenate([np.zeros(0, np.int64), *owners])


def segment_postings(segment: int, rows: list[int], terms: list[np.ndarray]) -> pa.RecordBatch:
    """Posting lists of one segment, and the row that tells where each text begins; the last of its
    positions is the end of the segment."""
    firsts = np.concatenate(([0], np.cumsum([len(t) + 1 for t in terms]))).astype(np.int32)
    joined = np.concatenate(terms)
    at = np.arange(len(joined)) + np.repeat(np.arange(len(terms)), [len(t) for t in terms])
    order = np.argsort(joined, kind="stable")
    ordered = joined[order]
    bounds = np.append(np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1]))), len(ordered))
    lists = np.concatenate((bounds, [len(ordered) + len(firsts)])).astype(np.int32)
    n = len(bounds) - 1
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.full(n + 1, segment)),
            pa.array([*ordered[bounds[:-1]].tolist(), None], pa.int64()),
            pa.array(np.append(np.diff(bounds), 0).astype(np.int32)),
            pa.ListArray.from_arrays(lists, np.concatenate((at[order].astype(np.int32), firsts))),
            pa.array([*[None] * n, rows], pa.list_(pa.int64())),
        ],
        names=["segment", "term", "n", "positions", "rows"],
    )


def _post(text_col: str, row: str, segment_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, rows, terms, held = TaskContext.get().partitionId() << 32, [], [], 0
        for batch in slices(batches):
            texts = text_bytes(batch[text_col])
            hashed, owner = term_hashes(texts)
            bounds = np.searchsorted(owner, np.arange(len(texts) + 1))
            for k, name in enumerate(batch[row].to_pylist()):
                if bounds[k] == bounds[k + 1]:
                    continue
                if rows and held + len(texts[k]) > segment_bytes:
                    yield from slices([segment_postings(number, rows, terms)], POSTED_ROWS)
                    number, rows, terms, held = number + 1, [], [], 0
                rows.append(name)
                terms.append(hashed[bounds[k] : bounds[k + 1]].copy())
                held += len(texts[k])
        if rows:
            yield from slices([segment_postings(number, rows, terms)], POSTED_ROWS)

    return run


def _count(text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts, counts = text_bytes(batch[text_col]), []
            for first, end in chunks([len(t) for t in texts]):
                starts, _ = spans(WORD_BYTES[np.frombuffer(b" ".join(texts[first:end]), np.uint8)])
                ends = np.cumsum([len(t) + 1 for t in texts[first:end]])
                counts.append(np.diff(np.searchsorted(starts, ends), prepend=0))
            n = np.concatenate([np.zeros(0, np.int64), *counts])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(n, pa.int64())], names=[*batch.schema.names, "n_words"])

    return run


def benchmark_terms(benchmark: DataFrame, item_col: str, text_col: str, size: int | None) -> DataFrame:
    """(item, terms): the distinct windows of each item, or without ``size`` its distinct terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashed, owner = term_hashes(text_bytes(batch["text"]))
            bounds = np.searchsorted(owner, np.arange(len(batch) + 1))
            for k, item in enumerate(batch["item"].to_pylist()):
                terms = hashed[bounds[k] : bounds[k + 1]]
                if not len(terms):
                    continue
                if size is None:
                    rows = [np.unique(terms)]
                else:
                    rows = np.unique(np.lib.stride_tricks.sliding_window_view(terms, min(size, len(terms))), axis=0)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([item] * len(rows), pa.string()), pa.array(list(rows), pa.list_(pa.int64()))], names=["item", "terms"]
                )

    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).cast("string").alias("text"))
    return items.dropna().mapInArrow(run, "item string, terms array<long>").distinct()


class Lists:
    """The posting lists of one segment, ordered by term, and its texts."""

    def __init__(self, postings: pa.Table):
        where = postings.filter(pc.is_valid(postings["rows"]))
        self.rows, self.firsts = (pc.list_flatten(where[c]).to_numpy() for c in ("rows", "positions"))
        listed = postings.filter(pc.is_null(postings["rows"])).sort_by("term")
        self.terms = listed["term"].to_numpy()
        self.positions = pc.list_flatten(listed["positions"]).to_numpy().astype(np.int64)
        sizes = pc.list_value_length(listed["positions"]).to_numpy()
        self.bounds = np.concatenate(([0], np.cumsum(sizes, dtype=np.int64)))
        self.keys = (np.repeat(np.arange(len(sizes)), sizes) << 32) + self.positions

    def ranks(self, terms: np.ndarray) -> np.ndarray:
        """Place of each term among those that have a list, or -1."""
        at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        return np.where(self.terms[at] == terms, at, -1) if len(self.terms) else np.full(len(terms), -1)

    def postings(self, rank: int) -> np.ndarray:
        return self.positions[self.bounds[rank] : self.bounds[rank + 1]]

    def holds(self, ranks: np.ndarray, positions: np.ndarray) -> np.ndarray:
        """Whether each position is in the list of its term."""
        wanted = (ranks << 32) + positions
        return self.keys[np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)] == wanted

    def phrases(self, ranks: np.ndarray, offsets: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(window, first position) of every occurrence of windows whose terms [bounds[w], bounds[w + 1])
        stand in the order of rarity: the rarest term's list, shifted, is intersected with the
        shifted list of each further term. About ``STARTS`` places at a time."""
        lengths, first = np.diff(bounds), bounds[:-1]
        missing = np.concatenate(([0], np.cumsum(ranks < 0)))
        known = np.flatnonzero(missing[bounds[1:]] == missing[first])
        rarest = ranks[first[known]]
        counts = self.bounds[rarest + 1] - self.bounds[rarest]
        for at, end in chunks(counts.tolist(), STARTS):
            some, n = known[at:end], counts[at:end]
            window = np.repeat(some, n)
            place = np.repeat(self.bounds[rarest[at:end]], n) + np.arange(len(window)) - np.repeat(np.cumsum(n) - n, n)
            start = self.positions[place] - offsets[first[window]]
            window, start = window[start >= 0], start[start >= 0]
            for k in range(1, int(lengths.max())):
                term = np.minimum(first[window] + k, len(ranks) - 1)
                left = (k >= lengths[window]) | self.holds(ranks[term], start + offsets[term])
                window, start = window[left], start[left]
                if not len(window):
                    break
            yield window, start


class PositionalIndex:
    """Stored postings of the texts of a table whose rows have a number each in ``row_col``."""

    def __init__(
        self, texts: DataFrame, scratch: Scratch, text_col: str = "text", row_col: str = "row", segment_bytes: int = SEGMENT_BYTES
    ):
        posted = texts.select(row_col, text_col).mapInArrow(lean(_post(text_col, row_col, segment_bytes)), POSTING)
        self.scratch = scratch
        self.postings = scratch.stored(posted)

    def counts(self, terms: DataFrame) -> DataFrame:
        """(term, total): occurrences of the distinct terms of ``terms`` that occur at all."""
        listed = self.postings.filter(F.col("rows").isNull()).select("term", "n")
        return listed.join(terms.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("n").alias("total"))

    def by_rarity(self, asked: DataFrame, most: int | None = None) -> DataFrame:
        """(w, terms, offsets): the terms of each ``asked`` row (w, terms), the rarest first, without
        rows that have a term which occurs nowhere. ``most`` cuts the lists."""
        exploded = asked.select("w", F.size("terms").alias("length"), F.posexplode("terms").alias("offset", "term"))
        met = exploded.join(self.counts(exploded), "term").groupBy("w", "length")
        whole = met.agg(F.sort_array(F.collect_list(F.struct("total", "offset", "term"))).alias("plan"))
        plan = F.col("plan") if most is None else F.slice("plan", 1, most)
        chosen = whole.filter(F.size("plan") == F.col("length")).select("w", plan.alias("plan"))
        return self.scratch.stored(chosen.select("w", F.col("plan.term").alias("terms"), F.col("plan.offset").alias("offsets")))

    def by_segment(self, asked: DataFrame, parts: int, search: Callable[[pa.Table, Lists], pa.Table], schema: str) -> DataFrame:
        """``search`` over the lists of every segment, with the rows of ``asked`` (see ``by_rarity``) whose
        rarest term has a list there; a part of the rows at a time."""
        asked = asked.withColumn("part", F.pmod(F.xxhash64("w"), F.lit(parts)))
        listed = self.postings.filter(F.col("rows").isNull())
        rarest = asked.withColumn("term", F.col("terms")[0])
        lookups = listed.select("term", "segment").join(rarest, "term").drop("term")
        used = asked.select("part", F.explode("terms").alias("term")).distinct()
        places = self.postings.filter(F.col("rows").isNotNull())
        lists = listed.join(used, "term").unionByName(places.withColumn("part", F.explode(F.expr(f"sequence(0L, {parts - 1}L)"))))
        lists = lists.select(F.col("segment").alias("at"), F.col("part").alias("of"), "term", "positions", "rows")

        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            return search(left, Lists(right)) if len(left) else empty

        empty = search(pa.table({"w": pa.array([], pa.int64()), "terms": NO_LIST, "offsets": NO_LIST}), Lists(NO_POSTINGS))
        return lookups.groupBy("segment", "part").cogroup(lists.groupBy("at", "of")).applyInArrow(run, schema)


NO_LIST = pa.array([], pa.list_(pa.int64()))
NO_POSTINGS = pa.table({"term": pa.array([], pa.int64()), "positions": NO_LIST, "rows": NO_LIST})


def lists_of(table: pa.Table, name: str) -> tuple[np.ndarray, np.ndarray]:
    """The lists of a column one after the other, and their bounds."""
    sizes = pc.list_value_length(table[name]).to_numpy()
    return pc.list_flatten(table[name]).to_numpy(), np.concatenate(([0], np.cumsum(sizes, dtype=np.int64)))


def find_phrases(asked: pa.Table, lists: Lists) -> pa.Table:
    """A row for each text that is hit: its row number, the merged ranges of words hit, and the windows."""
    terms, bounds = lists_of(asked, "terms")
    offsets, _ = lists_of(asked, "offsets")
    names, lengths = asked["w"].to_numpy(), np.diff(bounds)
    found = list(lists.phrases(lists.ranks(terms), offsets, bounds)) if len(asked) else []
    window = np.concatenate([np.zeros(0, np.int64), *(w for w, _ in found)])
    start = np.concatenate([np.zeros(0, np.int64), *(s for _, s in found)])
    order = np.argsort(start, kind="stable")
    window, start = window[order], start[order]
    text = np.searchsorted(lists.firsts, start, side="right") - 1
    rows = []
    for k in np.unique(text):
        a, b = np.searchsorted(text, [k, k + 1])
        own = start[a:b] - lists.firsts[k]
        starts, ends = merged(own, own + lengths[window[a:b]])
        rows.append((lists.rows[k], starts, ends, np.unique(names[window[a:b]])))
    columns = list(zip(*rows, strict=True)) if rows else [[]] * 4
    kinds = [pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int64())]
    return pa.table([pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)], names=["row", "starts", "ends", "windows"])


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ranges = [merged(np.array(s), np.array(e)) for s, e in zip(batch["starts"].to_pylist(), batch["ends"].to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays(
            [batch["row"], *(pa.array([r[k] for r in ranges], pa.list_(pa.int32())) for k in (0, 1))], names=["row", "starts", "ends"]
        )


def numbered_texts(docs: DataFrame, scratch: Scratch, text_col: str, row: str, keep: list[str]) -> DataFrame:
    """The rows, stored with a number each and their number of words."""
    numbered = docs.select(*keep, F.monotonically_increasing_id().alias(row))
    schema = numbered.withColumn("n_words", F.lit(None).cast("long")).schema
    return scratch.stored(numbered.mapInArrow(lean(_count(text_col)), schema))


def match_phrases(
    docs: DataFrame,
    benchmark: DataFrame,
    size: int = 13,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    part_windows: int = 200_000,
    segment_bytes: int = SEGMENT_BYTES,
) -> DataFrame:
    """All rows with n_words, the merged word ranges hit (hit_starts, hit_ends) and the ids of the
    items (as strings, sorted) that have a window there."""
    keep = [c for c in docs.columns if c not in ADDED]
    (row,) = hidden(docs, "row")
    held, scratch = Scratch(), Scratch()
    texts = numbered_texts(docs, held, text_col, row, keep)
    owners = scratch.stored(benchmark_terms(benchmark, item_col, item_text_col, size))
    windows = scratch.stored(owners.select("terms").distinct().withColumn("w", F.monotonically_increasing_id()))
    index = PositionalIndex(texts, scratch, text_col, row, segment_bytes)
    parts = max(1, -(-windows.count() // part_windows))
    schema = "row long, starts array<int>, ends array<int>, windows array<long>"
    hits = scratch.stored(index.by_segment(index.by_rarity(windows), parts, find_phrases, schema))
    one_row = hits.groupBy("row").agg(*(F.flatten(F.collect_list(c)).alias(c) for c in ("starts", "ends")))
    ranges = one_row.mapInArrow(lean(_merge), "row long, starts array<int>, ends array<int>")
    items = owners.join(windows, "terms").select("w", "item")
    named = hits.select("row", F.explode("windows").alias("w")).join(items, "w").groupBy("row").agg(F.sort_array(F.collect_set("item")).alias("items"))
    found = held.stored(ranges.join(named, "row").withColumnsRenamed({"row": row, "starts": "hit_starts", "ends": "hit_ends"}))
    scratch.clear()
    nothing = {"hit_starts": "cast(array() as array<int>)", "hit_ends": "cast(array() as array<int>)", "items": "cast(array() as array<string>)"}
    joined = texts.join(found, row, "left")
    return joined.select(*keep, "n_words", *(F.coalesce(c, F.expr(none)).alias(c) for c, none in nothing.items()))


def hit_count() -> Column:
    """Words inside any match."""
    widths = F.transform(F.arrays_zip("hit_starts", "hit_ends"), lambda r: (r["hit_ends"] - r["hit_starts"]).cast("long"))
    return F.aggregate(widths, F.lit(0).cast("long"), lambda a, b: a + b)


def is_contaminated() -> Column:
    """At least a twentieth of the words, and at least one, are inside a match."""
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def nearest_windows(anchor: np.ndarray, others: list[np.ndarray], first: np.ndarray, end: np.ndarray):
    """First and last position of the narrowest window around each anchor, within its own text
    [first, end), that has an occurrence of each other list; the last is ``FAR`` or more where there
    is none. Of equally narrow windows the rightmost counts.

    A window that starts at some place takes the terms whose nearest occurrence on the left it still
    has, and the others from the right; only the anchor and those left places can be the start.
    """
    lefts, rights = [], []
    for listed in others:
        after = np.searchsorted(listed, anchor)
        padded = np.concatenate(([-FAR], listed, [FAR]))
        left, right = padded[after], padded[after + 1]
        lefts.append(np.where(left >= first, left, -FAR))
        rights.append(np.where(right < end, right, FAR))
    low, high = anchor, np.full(len(anchor), 2 * FAR)
    for start in [anchor, *lefts]:
        last = anchor
        for left, right in zip(lefts, rights, strict=True):
            last = np.where(left >= start, last, np.maximum(last, right))
        closer = (last - start < high - low) | ((last - start == high - low) & (start > low))
        better = (start > -FAR) & (last < FAR) & closer
        low, high = np.where(better, start, low), np.where(better, last, high)
    return low, high


def find_near(within: int):
    def search(asked: pa.Table, lists: Lists) -> pa.Table:
        terms, bounds = lists_of(asked, "terms")
        ranks, rows = lists.ranks(terms), []
        for k, w in enumerate(asked["w"].to_pylist()):
            own = ranks[bounds[k] : bounds[k + 1]]
            if (own < 0).any():
                continue
            anchor = lists.postings(own[0])
            text = np.searchsorted(lists.firsts, anchor, side="right") - 1
            low, high = nearest_windows(anchor, [lists.postings(t) for t in own[1:]], lists.firsts[text], lists.firsts[text + 1])
            fits = high - low < within
            rows += zip(lists.rows[text[fits]], [w] * fits.sum(), (low - lists.firsts[text])[fits], (high - lists.firsts[text])[fits], strict=True)
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 4
        return pa.table([pa.array(list(c), pa.int64()) for c in columns], names=["row", "w", "first", "last"])

    return search


def proximity_matches(
    docs: DataFrame, benchmark: DataFrame, within: int = 30, rarest: int = 5, text_col: str = "text",
    id_col: str = "doc_id", item_col: str = "item_id", item_text_col: str = "text", part_items: int = 50_000,
) -> DataFrame:
    """(id, item, first, last): places where the ``rarest`` distinct terms of an item stand within
    ``within`` words of each other, in any order; one row for each such place of the rarest term, with
    the narrowest window around it. Items of fewer distinct terms use all they have; an item with a
    term that no text has is nowhere."""
    held, scratch = Scratch(), Scratch()
    texts = numbered_texts(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), scratch, "text", "row", ["id", "text"])
    items = scratch.stored(benchmark_terms(benchmark, item_col, item_text_col, None).withColumn("w", F.monotonically_increasing_id()))
    index = PositionalIndex(texts, scratch)
    parts = max(1, -(-items.count() // part_items))
    near = index.by_segment(index.by_rarity(items, rarest), parts, find_near(within), "row long, w long, first long, last long")
    named = near.join(texts.select("row", "id"), "row").join(items.select("w", "item"), "w")
    found = held.stored(named.select("id", "item", "first", "last"))
    scratch.clear()
    return found
