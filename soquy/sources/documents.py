"""Whole JSON documents of many records, each file read by many tasks.

A document is an object whose ``data`` is a list of objects, in any layout. Spark's text reader cuts
files at every ``}``, and a file in as many splits as its size asks for. Whether such a mark ends a
record is known once it is known what stands before the split: inside a string or not, and in how
many objects. So there are two passes:

1. Each split tells the parity of its quotes, and how many objects it leaves open, both for a start
   outside and inside a string. Running sums over the splits of a file give the start of each.
2. With its start known, a split gives out the records that lie in it whole. Of a record cut by a
   split's end the pieces are put together; there is one such record for each end at most. What is
   left without the records, the frame of the document, has to be ``{"data": [`` ... ``]}``.

Most splits start between two records. The others are counted, and their starts handed to the tasks
if they are few (``LISTED_STARTS``); if they are many, the pieces meet them in a join.

A document that is cut off or no JSON fails the query, and so does one with other objects beside its
data, or without a comma between two records. A null, absent or scalar ``data`` gives no rows.
"""

from __future__ import annotations

import json
import re
import sys
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from soquy.sources.schemas import BROKEN, PLACE_COLUMN, raw_schema, typed

# Task functions travel by value, so executors need no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

LISTED_STARTS = 10_000
# Escapes stand inside strings only, but count wherever they are, so that a wrong guess of what stands
# before a piece turns every state into its opposite.
_STRING = re.compile(rb'\\.|"(?:[^"\\]|\\.)*(?:"|\\?\Z)', re.DOTALL)
_BETWEEN = re.compile(rb"\s*,\s*")
_HEAD = re.compile(r'"data"\s*:\s*\[\s*$')

RECORD, FRAME, HEAD, TAIL = range(4)
"""Kinds of what a split gives out: a whole record, a part of the frame, the first part of a record
that goes on in the next split, and a further part of one."""


def without_strings(piece: bytes, inside: bool) -> tuple[bytes, bool]:
    """The piece with its strings blanked, and whether it ends inside one."""
    text = b'"' + piece if inside else piece
    ends_inside = False
    parts, at = [], 0
    for found in _STRING.finditer(text):
        part = found.group()
        parts.append(text[at : found.start()] + b" " * len(part))
        at = found.end()
        ends_inside = part[:1] == b'"' and at == len(text) and not _closed(part)
    blanked = b"".join([*parts, text[at:]])
    return (blanked[1:] if inside else blanked), ends_inside


def _closed(string: bytes) -> bool:
    """Whether a string that was started has its closing quote."""
    if len(string) < 2 or string[-1:] != b'"':
        return False
    before = string[1:-1]
    return (len(before) - len(before.rstrip(b"\\"))) % 2 == 0


def split_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list[bytes], dict]]:
    """(file and block, pieces, other columns) for runs of rows of one split."""
    for batch in batches:
        rows = batch.to_pylist()
        first = 0
        for k in range(1, len(rows) + 1):
            if k == len(rows) or (rows[k]["file"], rows[k]["block"]) != (rows[first]["file"], rows[first]["block"]):
                yield (rows[first]["file"], rows[first]["block"]), [r["value"] for r in rows[first:k]], rows[first]
                first = k


SUMMARY = "file string, size long, block long, quotes int, opened_outside long, opened_inside long, bytes long"


def summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each split: the parity of its quotes, and the objects it leaves open for either start."""
    found: dict[tuple, list] = {}
    for key, pieces, row in split_rows(batches):
        own = found.setdefault(key, [row["size"], 0, 0, 0, 0])
        for piece in pieces:
            odd = own[1]
            for start in (False, True):
                blanked, ends_inside = without_strings(piece, bool(odd) != start)
                own[2 + start] += blanked.count(b"{") - (not ends_inside)
                if not start:
                    own[1] = int(ends_inside)
            own[4] += len(piece) + 1
    if found:
        rows = [(file, size, block, *rest) for (file, block), (size, *rest) in found.items()]
        names = [f.split()[0] for f in SUMMARY.split(", ")]
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
        columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
        yield pa.RecordBatch.from_arrays(columns, names=names)


def starts(summary: DataFrame) -> DataFrame:
    """(file, block, inside, depth): what stands before each split; nothing where the file begins."""
    before = "OVER (PARTITION BY file ORDER BY block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    known = summary.selectExpr("*", f"coalesce(sum(quotes) {before}, 0) % 2 = 1 AS inside")
    opened = "if(inside, opened_inside, opened_outside)"
    return known.selectExpr("file", "block", "inside", f"coalesce(sum({opened}) {before}, 0) AS depth")


class Split:
    """Gives out the records and the frame of one split, piece by piece."""

    def __init__(self, first: bool, inside: bool, depth: int):
        self.inside, self.depth = inside, depth
        self.between: list[bytes] = []
        self.record: list[bytes] = []
        self.goes_on = depth >= 2
        self.framed = first  # the frame before the first record of a file is its head
        self.any = False
        self.out: list[tuple[int, bool, bytes]] = []

    def add(self, piece: bytes) -> None:
        blanked, ends_inside = without_strings(piece, self.inside)
        self.inside = ends_inside
        at = 0
        while self.depth < 2:
            brace = blanked.find(b"{", at)
            if brace < 0:
                self.between.append(piece + b"}" if self.depth < 2 else b"")
                self.depth -= not ends_inside
                return
            self.depth += 1
            if self.depth == 2:
                self.between.append(piece[:brace])
                self._begin()
                piece, blanked = piece[brace:], blanked[brace + 1 :]
                break
            at = brace + 1
        self.depth += blanked.count(b"{")
        self.record.append(piece + b"}")
        if not ends_inside:
            self.depth -= 1
            if self.depth == 1:
                text = b"".join(self.record)
                self.out.append((TAIL if self.goes_on else RECORD, True, text))
                self.record, self.goes_on, self.any = [], False, True

    def _begin(self) -> None:
        text = b"".join(self.between)
        self.between = []
        if not _BETWEEN.fullmatch(text) or self.framed:
            if self.any:
                raise ValueError(f"broken document: {text[:100]!r} between two records")
            self.out.append((FRAME, True, text))
        self.framed = False

    def end(self) -> list[tuple[int, bool, bytes]]:
        if self.record:
            self.out.append((TAIL if self.goes_on else HEAD, False, b"".join(self.record)))
        if self.between:
            self.out.append((FRAME, False, b"".join(self.between)))
        return self.out


def parts_of_splits(others: list[str], listed: dict[tuple, tuple] | None, wanted: tuple[int, ...]):
    """The task function of the second pass. ``listed`` holds the starts that are not between two
    records; None: each row brings the start of its split."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, split, row, place = None, None, None, 0

        def given_out(parts) -> pa.RecordBatch:
            nonlocal place
            chosen = [p for p in parts if p[0] in wanted]
            n = len(chosen)
            columns = {
                "file": pa.array([row["file"]] * n, pa.string()),
                "size": pa.array([row["size"]] * n, pa.int64()),
                "block": pa.array([row["block"]] * n, pa.int64()),
                "part": pa.array(range(place, place + n), pa.int64()),
                "kind": pa.array([p[0] for p in chosen], pa.int32()),
                "whole": pa.array([p[1] for p in chosen], pa.bool_()),
                "text": pa.array([p[2] for p in chosen], pa.binary()),
                **{c: pa.array([row[c]] * n, kinds[c]) for c in others},
            }
            place += n
            return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

        kinds: dict = {}
        for batch in batches:
            kinds = {c: batch.schema.field(c).type for c in others}
            for now, pieces, of in split_rows(iter([batch])):
                if now != key:
                    if split:
                        yield given_out(split.end())
                    between = (False, 1 if now[1] else 0)
                    inside, depth = (of["inside"], of["depth"]) if listed is None else listed.get(now, between)
                    key, split, row, place = now, Split(now[1] == 0, inside, depth), of, 0
                for piece in pieces:
                    split.add(piece)
                yield given_out(split.out)
                split.out = []
        if split:
            yield given_out(split.end())

    return run


def checked_frame(table: pa.Table) -> pa.Table:
    """No rows; fails where the frame of one file is not that of a document."""
    rows = sorted(table.to_pylist(), key=lambda r: (r["block"], r["part"]))
    frame = b"".join(r["text"] for r in rows)
    if rows[0]["cut"]:  # the last piece ended with the file and not with a mark
        frame = frame[:-1]
    before = [k for k, r in enumerate(rows) if r["whole"]]
    try:
        document = json.loads(frame.decode("utf-8-sig"))
        head = b"".join(r["text"] for r in rows[: before[0] + 1]).decode() if before else '"data":['
        data = document.get("data") if isinstance(document, dict) else "no object"
        if len(before) > 1 or not _HEAD.search(head) or (isinstance(data, list | dict) and data) or data == "no object":
            raise ValueError("objects that are no records of its data")
    except ValueError as error:
        raise ValueError(f"broken document {rows[0]['file']}: {error}") from None
    return table.slice(0, 0).select(["file"])


def read_whole(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    partitions: Iterable[T.StructField] = (),
    chosen: Callable[[DataFrame], DataFrame] = lambda df: df,
    listed_starts: int = LISTED_STARTS,
) -> DataFrame:
    """The records of whole documents, typed, with null places (the place of a record is known within
    its split only) and the partition columns. ``chosen`` filters the files by these."""
    others = [f.name for f in partitions]
    text = spark.read.schema(T.StructType([T.StructField("value", T.StringType()), *partitions])).text(path, lineSep="}")
    pieces = chosen(text).selectExpr(
        "CAST(value AS BINARY) AS value", "_metadata.file_path AS file", "_metadata.file_size AS size",
        "_metadata.file_block_start AS block", "monotonically_increasing_id() AS place", *others,
    )
    summary = pieces.select("value", "file", "size", "block").mapInArrow(summaries, SUMMARY)
    # a split whose rows came in several batches has one summary, as tasks keep them by split
    odd = starts(summary).where("inside OR depth <> if(block = 0, 0, 1)")
    found = odd.limit(listed_starts + 1).collect()
    listed = {(r["file"], r["block"]): (r["inside"], r["depth"]) for r in found}
    if len(found) > listed_starts:
        listed = None
        known = starts(summary).withColumnsRenamed({"file": "of_file", "block": "of_block"})
        pieces = pieces.join(known, (F.col("file") == F.col("of_file")) & (F.col("block") == F.col("of_block")))
        pieces = pieces.drop("of_file", "of_block").sortWithinPartitions("file", "block", "place")
    fields = [f"{c} {t}" for c, t in (f.split() for f in "file string, size long, block long, part long, kind int, whole boolean, text binary".split(", "))]
    fields += [f"{f.name} {f.dataType.simpleString()}" for f in partitions]

    def given(*kinds: int) -> DataFrame:
        return pieces.drop("place").mapInArrow(parts_of_splits(others, listed, kinds), ", ".join(fields))

    whole = given(RECORD).select("text", *others)
    rest = given(FRAME, HEAD, TAIL)
    of_file = "OVER (PARTITION BY file ORDER BY block, part)"
    cut = rest.where(f"kind <> {FRAME}").selectExpr("*", f"sum(if(kind = {HEAD}, 1, 0)) {of_file} AS nth")
    together = cut.groupBy("file", "nth", *others).agg(
        F.array_sort(F.collect_list(F.struct("block", "part", "text"))).alias("parts")
    )
    joined = together.selectExpr("aggregate(parts, X'', (a, p) -> concat(a, p.text)) AS text", *others)
    ends = summary.groupBy("file").agg(F.sum("bytes").alias("read"), F.max("size").alias("of_size"))
    # all bytes and one mark for each piece; a byte order mark is not read
    ends = ends.selectExpr("file AS of", "of_size - read IN (-1, 2) AS cut")
    frames = rest.where(f"kind = {FRAME}").join(ends, F.col("file") == F.col("of")).select("file", "block", "part", "whole", "text", "cut")
    faults = frames.groupBy("file").applyInArrow(checked_frame, "file string")
    null = [f"CAST(NULL AS {f.dataType.simpleString()}) AS {f.name}" for f in partitions]
    texts = whole.union(joined).union(faults.selectExpr("CAST(file AS BINARY) AS text", *null))
    kept = T.StructType([*raw_schema(schema), T.StructField(BROKEN, T.StringType())])
    record = f"from_json(CAST(text AS STRING), '{kept.simpleString()}', map('columnNameOfCorruptRecord', '{BROKEN}'))"
    fault = f"raise_error(concat('broken record: ', left(record.{BROKEN}, 200)))"
    sound = f"CASE WHEN record.{BROKEN} IS NOT NULL THEN {fault} ELSE record END AS record"
    rows = texts.selectExpr(f"{record} AS record", *others).selectExpr(sound, *others).selectExpr("record.*", *others)
    return rows.selectExpr(*typed(schema), f"CAST(NULL AS BIGINT) AS {PLACE_COLUMN}", *others)
