"""Repeated byte strings of a corpus by a blockwise suffix array with a difference cover.

A string of ``length`` bytes that starts at two or more places of the corpus is repeated. Suffixes
are dealt into buckets such that equal strings meet: the bucket of a suffix is set by the smallest
(hashed) run of ``length // 6``, at most 64, bytes within its first ``length`` bytes. Runs that
occur once in the corpus cannot belong to a repeated string, so only suffixes below a repeated run
are sorted, and only the text around them travels. One bucket after the other is sorted:

1. The suffixes at the positions of a difference cover modulo 31 are ranked, by their first bytes
   and then by doubling the depth, until ranks tell strings of ``length`` bytes apart.
2. Every suffix of the bucket is sorted by its few bytes up to the next cover position and the rank
   there, which resolves ties of any length without looking at the text again.
3. Neighbours in that order whose common prefix is ``length`` bytes or more are repeated.

Texts of a bucket are laid out so that their shared run stands at a multiple of 31; equal strings
are then in the same residue class, in which the distance to the next cover position is the same.
A run of very many places is split by the distance between suffix and run, which equal strings share.

* Texts are UTF-8 bytes, null is empty; strings never cross texts. Both places may be in one text
  and may overlap. Strings are judged on the input, not on what is left.
* Equal texts share one key (half of their SHA-256) and one result. Empty and short texts have no
  spans. Every row keeps its own result; columns named as in ``ADDED`` are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from soquy.llm.common import BASE_INVERSE, Scratch, chunks, hidden, lean, merged, mix, powers, prefix_hashes, slices
from soquy.llm.common import spans, stored, text_bytes

ADDED = ("span_starts", "span_ends")
PERIOD = 31
COVER = (0, 1, 3, 8, 12, 18)  # every residue modulo 31 is a difference of two of them
SLAB = 1 << 18
CROWDED = 2_000
HELD = 16 << 20
PIECE = 400
"""Bytes that a task's pieces may take before they are passed on, and what one takes beside its text."""


def text_key(text_col: str) -> Column:
    whole = F.unhex(F.sha2(F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary"), 256))
    return F.substring(whole, 1, 16)


def run_bytes(length: int) -> int:
    return max(1, min(64, length // 6))


def anchors(data: np.ndarray, text_ends: np.ndarray, length: int):
    """Maximal ranges of suffixes with the same smallest run: (first, last, place of the run, its
    hash), positions in the joined bytes. Ties go to the leftmost run."""
    size = run_bytes(length)
    width = length - size + 1
    empty = np.zeros(0, np.int64)
    if len(data) < length:
        return empty, empty, empty, np.zeros(0, np.uint64)
    prefix = prefix_hashes(data)
    runs = mix((prefix[size:] - prefix[:-size]) * powers(BASE_INVERSE, len(data) - size + 1))
    places = np.empty(len(data) - length + 1, np.int64)
    low = np.uint64((1 << 20) - 1)
    for at in range(0, len(places), SLAB):
        end = min(at + SLAB, len(places))
        part = runs[at : end + width - 1]
        best = (part & ~low) | np.arange(len(part), dtype=np.uint64)
        reach = 1
        while reach * 2 <= width:
            best = np.minimum(best[:-reach], best[reach:])
            reach *= 2
        best = np.minimum(best[: end - at], best[width - reach : width - reach + end - at])
        places[at:end] = (best & low).astype(np.int64) + at
    text_starts = np.concatenate(([0], text_ends[:-1]))
    first_of = text_starts[text_ends - text_starts >= length]
    inside = np.zeros(len(places) + 1, np.int8)
    np.add.at(inside, first_of, 1)
    np.add.at(inside, (text_ends - length + 1)[text_ends - text_starts >= length], -1)
    inside = np.cumsum(inside[:-1]).astype(bool)
    new = np.concatenate(([True], places[1:] != places[:-1]))
    new[first_of] = True
    starts = np.flatnonzero(new & inside)
    stops = np.flatnonzero(np.append(new[1:] | ~inside[1:], True) & inside)
    return starts, stops, places[starts], runs[places[starts]]


def find_anchors(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts, keys = text_bytes(batch["text"]), batch["key"]
            for first, end in chunks([len(t) for t in texts]):
                ends = np.cumsum([len(t) for t in texts[first:end]])
                data = np.frombuffer(b"".join(texts[first:end]), np.uint8)
                starts, stops, places, runs = anchors(data, ends, length)
                if len(starts):
                    owner = np.searchsorted(ends, starts, side="right")
                    base = np.concatenate(([0], ends[:-1]))[owner]
                    yield pa.RecordBatch.from_arrays(
                        [
                            keys.take(pa.array(owner + first)),
                            pa.array(runs.view(np.int64)),
                            *(pa.array(x - base, pa.int32()) for x in (starts, stops, places)),
                        ],
                        names=["key", "run", "first", "last", "place"],
                    )

    return run


ANCHORS = "key binary, run long, first int, last int, place int"
PIECES = "bucket long, key binary, run long, first int, lead int, whole boolean, piece binary"


def cut_pieces(length: int, n_buckets: int):
    """The text around each repeated run, cut into pieces where the run is crowded.

    A piece that a task has met before is repeated as a whole: of such, only the first travels, and of
    the others the range, which goes to any bucket. A line that stands everywhere so comes to a
    bucket once for each ``HELD`` bytes of a task and not for each place.
    """
    width = length - run_bytes(length) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, rows, held, met = None, [], 0, {}
        for batch in slices(batches, 250):
            keys, texts, lists = batch["key"].to_pylist(), text_bytes(batch["text"]), batch["found"].to_pylist()
            for key, text, found in zip(keys, texts, lists, strict=True):
                if key == done:  # a copy, next to the first of its kind
                    continue
                done = key
                for a in found:
                    parts = min(width, -(-a["places"] // CROWDED))
                    step = -(-width // parts)
                    at = a["first"]
                    while at <= a["last"]:
                        part = (a["place"] - at) // step  # by the distance to the run
                        end = min(a["last"], a["place"] - part * step)
                        bucket = int(mix(np.array([a["run"]], np.int64).view(np.uint64) + np.uint64(part))[0] % np.uint64(n_buckets))
                        piece = text[at : end + length]
                        lead = a["place"] - at
                        before = met.setdefault((a["run"], lead, piece), len(rows))
                        held += PIECE
                        if before == len(rows):
                            rows.append((bucket, key, a["run"], at, lead, a["copies"] > 1, piece))
                            held += len(piece)
                        else:
                            rows[before] = (*rows[before][:5], True, piece)
                            rows.append((len(rows) % n_buckets, key, a["run"], at, len(piece), True, None))
                        at = end + 1
                if held > HELD:
                    yield table_of(rows)
                    rows, held, met = [], 0, {}
        if rows:
            yield table_of(rows)

    return run


def table_of(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.binary()]
    names = [x.split()[0] for x in PIECES.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def words_at(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Big-endian 64-bit words of the bytes from each position on."""
    wide = np.ndarray((len(data) - 7,), dtype=">u8", buffer=data.data, strides=(1,))
    return wide[at].astype(np.uint64)


def common_prefix(data: np.ndarray, a: np.ndarray, b: np.ndarray, limit: int) -> np.ndarray:
    """Length of the common prefix of the suffixes a and b, as far as ``limit``."""
    out, active = np.full(len(a), limit, np.int64), np.arange(len(a))
    for at in range(0, limit, 8):
        differ = words_at(data, a[active] + at) ^ words_at(data, b[active] + at)
        ended = differ != 0
        zeros = np.zeros(int(ended.sum()), np.int64)
        for k in range(1, 8):
            zeros += (differ[ended] >> np.uint64(64 - 8 * k)) == 0
        out[active[ended]] = np.minimum(at + zeros, limit)
        active = active[~ended]
    return out


def dense(order: np.ndarray, new: np.ndarray) -> np.ndarray:
    """Ranks by position in the order; ``new`` marks where a value differs from the one before."""
    ranks = np.empty(len(order), np.int64)
    ranks[order] = np.cumsum(new)
    return ranks


def cover_ranks(data: np.ndarray, n: int, depth: int):
    """Sample positions of the cover in [0, n), each period's after the one before, and their order by
    at least ``depth`` bytes. The data goes on for ``depth`` and some more bytes behind n."""
    samples = (np.arange(0, n, PERIOD)[:, None] + np.array(COVER)[None, :]).ravel()
    samples = samples[samples < n]
    tail = words_at(data, samples + 24) >> np.uint64(8)  # bytes 24 to 30
    keys = [tail, *(words_at(data, samples + 8 * k) for k in (2, 1, 0))]
    order = np.lexsort(keys)
    new = np.zeros(len(samples), bool)
    for k in keys:
        new[1:] |= k[order][1:] != k[order][:-1]
    del keys, tail, k
    ranks, periods = dense(order, new), 1
    while periods * PERIOD < depth:
        ahead = periods * len(COVER)  # samples from one position to that so many periods later
        pair = ranks << 32
        pair[:-ahead] |= ranks[ahead:] + 1
        order = np.argsort(pair, kind="stable")
        pair = pair[order]
        new = np.concatenate(([False], pair[1:] != pair[:-1]))
        ranks, periods = dense(order, new), 2 * periods
    return samples, order


def repeated_in_bucket(pieces: list[bytes], leads: np.ndarray, length: int) -> list[np.ndarray]:
    """For each piece, which of its suffixes (all that are followed by ``length`` bytes in it) start
    with a string that another suffix of these pieces starts with. ``leads``: the distance from the
    first suffix of a piece to its run."""
    counts = np.array([len(p) - length + 1 for p in pieces])
    starts, at = np.empty(len(pieces), np.int64), 0
    for k, piece in enumerate(pieces):
        at += -(at + int(leads[k])) % PERIOD  # the run stands at a multiple of the period
        starts[k] = at
        at += len(piece)
    data = np.zeros(at + length + 64, np.uint8)
    sorted_, repeated = np.zeros(at, bool), np.zeros(at, bool)
    for start, count, piece in zip(starts, counts, pieces, strict=True):
        data[start : start + len(piece)] = np.frombuffer(piece, np.uint8)
        sorted_[start : start + count] = True
    samples, order = cover_ranks(data, at, length)
    shared = np.zeros(len(samples), np.int64)
    for first in range(1, len(samples), SLAB):
        row = samples[order[first - 1 : first + SLAB]]
        shared[first : first + SLAB] = common_prefix(data, row[:-1], row[1:], length)
    place = np.empty(len(samples), np.int64)
    place[order] = np.arange(len(samples))
    del samples, order
    for residue in range(PERIOD):
        near = np.flatnonzero(sorted_[residue::PERIOD]) * PERIOD + residue
        if len(near) < 2:
            continue
        ahead = min((c - residue) % PERIOD for c in COVER)
        if length <= ahead:  # short strings need no rank
            ahead = length
        head = words_at(data, near)
        more = words_at(data, near + 8)
        head = head >> np.uint64(64 - 8 * ahead) if 0 < ahead < 8 else head if ahead else np.zeros_like(head)
        more = more >> np.uint64(128 - 8 * ahead) if ahead > 8 else np.zeros_like(more)
        if length > ahead:
            spot = COVER.index((residue + ahead) % PERIOD)
            rank = place[(near + ahead) // PERIOD * len(COVER) + spot]
            level = np.cumsum(shared < length - ahead)[rank]
        else:
            rank = level = np.zeros(len(near), np.int64)
        row = np.lexsort((rank, more, head))
        same = (head[row][1:] == head[row][:-1]) & (more[row][1:] == more[row][:-1]) & (level[row][1:] == level[row][:-1])
        flags = np.zeros(len(near), bool)
        flags[1:] |= same
        flags[:-1] |= same
        repeated[near[row[flags]]] = True
    return [repeated[start : start + count] for start, count in zip(starts, counts, strict=True)]


def sort_bucket(length: int):
    def run(bucket: pa.Table) -> pa.Table:
        keys, runs = bucket["key"].to_pylist(), bucket["run"].to_numpy()
        firsts, leads = bucket["first"].to_numpy(), bucket["lead"].to_numpy()
        whole, pieces = bucket["whole"].to_numpy(), bucket["piece"].to_pylist()
        # equal pieces are sorted once; what they hold is repeated
        members: dict[tuple, list[int]] = {}
        found_keys, starts, ends = [], [], []
        for k, piece in enumerate(pieces):
            if piece is None:  # a whole range, known to be repeated
                found_keys.append(keys[k])
                starts.append(firsts[k])
                ends.append(firsts[k] + leads[k])
            else:
                members.setdefault((runs[k], leads[k], piece), []).append(k)
        kinds: dict[int, int] = {}
        for run_, _, _ in members:
            kinds[run_] = kinds.get(run_, 0) + 1
        open_ = []
        for (run_, _, piece), rows in members.items():
            if len(rows) > 1 or whole[rows[0]]:
                for k in rows:
                    found_keys.append(keys[k])
                    starts.append(firsts[k])
                    ends.append(firsts[k] + len(piece))
            if kinds[run_] > 1:
                open_.append(rows[0])
        if open_:
            flags = repeated_in_bucket([pieces[k] for k in open_], leads[open_], length)
            for k, flag in zip(open_, flags, strict=True):
                for a, b in zip(*spans(flag), strict=True):
                    found_keys.append(keys[k])
                    starts.append(firsts[k] + a)
                    ends.append(firsts[k] + b - 1 + length)
        return pa.table(
            {
                "key": pa.array(found_keys, pa.binary()),
                "start": pa.array(starts, pa.int32()),
                "end": pa.array(ends, pa.int32()),
            }
        )

    return run


def repeated_spans(docs: DataFrame, length: int = 400, text_col: str = "text", bucket_bytes: int = 4 << 20) -> DataFrame:
    """(key, found): for each text with repeated strings, by its key, the ranges they cover; the
    ranges may overlap and repeat."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    texts = docs.select(text_key(text_col).alias("key"), text.alias("text")).filter(F.octet_length("text") >= length)
    # copies have the same rows here, and are counted on the mappers
    scratch = Scratch()
    once = scratch.stored(
        texts.mapInArrow(lean(find_anchors(length)), ANCHORS)
        .groupBy("key", "run", "first", "last", "place")
        .agg(F.count("*").alias("copies"))
    )
    counts = once.groupBy("run").agg(F.sum("copies").alias("places")).filter("places > 1")
    # a derived key keeps both sides plain exchanges, so that a crowded run can be split
    counts = counts.select((F.col("run").bitwiseXOR(F.lit(1))).alias("of_run"), "places")
    shared = once.join(counts, F.col("run").bitwiseXOR(F.lit(1)) == F.col("of_run")).drop("of_run")
    per_text = shared.groupBy("key").agg(
        F.collect_list(F.struct("run", "first", "last", "place", "copies", "places")).alias("found"),
        F.sum(F.col("last") - F.col("first") + length).alias("bytes"),
    )
    per_text = scratch.stored(per_text)
    total = per_text.agg(F.sum("bytes")).first()[0] or 0
    n_buckets = max(1, -(-total // bucket_bytes))
    pieces = (
        texts.join(per_text.select(F.col("key").alias("of_key"), "found"), F.col("key") == F.col("of_key"))
        .select("key", "text", "found")
        .mapInArrow(lean(cut_pieces(length, n_buckets)), PIECES)
    )
    spans_found = pieces.groupBy("bucket").applyInArrow(sort_bucket(length), "key binary, start int, end int")
    found = stored(spans_found.groupBy("key").agg(F.collect_set(F.struct("start", "end")).alias("found")))
    scratch.clear()
    return found


def with_spans(docs: DataFrame, length: int = 400, text_col: str = "text") -> DataFrame:
    """All rows with span_starts and span_ends: the maximal byte ranges covered by repeated strings."""
    keep = [c for c in docs.columns if c not in ADDED]
    key, of_key, ranges_col = hidden(docs, "text_key", "of_text_key", "found_ranges")
    found = repeated_spans(docs, length, text_col).select(F.col("key").alias(of_key), F.col("found").alias(ranges_col))
    joined = docs.select(*keep, text_key(text_col).alias(key)).join(found, F.col(key) == F.col(of_key), "left")

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [merged(*ranges(x)) for x in batch[ranges_col].to_pylist()]
            columns = [pa.array([list(x[k]) for x in found], pa.list_(pa.int32())) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in keep), *columns], names=[*keep, *ADDED])

    out = docs.select(*keep, *(F.expr("cast(array() as array<int>)").alias(c) for c in ADDED))
    return joined.select(*keep, ranges_col).mapInArrow(lean(merge), out.schema)


def ranges(found: list[dict] | None) -> tuple[np.ndarray, np.ndarray]:
    return tuple(np.array([x[k] for x in found or ()], np.int64) for k in ("start", "end"))


def kept_bytes(text: bytes, starts: list[int], ends: list[int]) -> bytes:
    at, out = 0, []
    for a, b in zip(starts, ends, strict=True):
        out.append(text[at:a])
        at = b
    return b"".join([*out, text[at:]])


def kept_text(text: str | None, starts: list[int], ends: list[int]) -> str | None:
    """The text without the spans; a character that a span cuts in two stays whole."""
    if text is None or not starts:
        return text
    raw = text.encode()
    inside = lambda at: at < len(raw) and raw[at] & 0xC0 == 0x80
    whole = []
    for a, b in zip(starts, ends, strict=True):
        while inside(a):
            a += 1
        while inside(b):
            b -= 1
        if b > a:
            whole.append((a, b))
    return kept_bytes(raw, [a for a, _ in whole], [b for _, b in whole]).decode()
