"""Exact duplicates of texts by skew-safe combining, with full content compared at every stage.

Two texts are equal when they are identical after every white-space character of ``BLANKS`` is
deleted. Of equal texts the row with the most code points in its original text stays, ties go to
the smallest id. Groups are combined in three stages, each an aggregate whose key holds the digest
and the whole normalised text, so that rows meet only where every character agrees:

1. Each task combines the texts it reads (the partial side of the first aggregate).
2. What is left of a text meets under its digest and a salt, which is the number of the reading task
   modulo ``salts``: a text with a third of all rows comes from a task once, and its rows are dealt
   over as many reducers as there are salts.
3. The winners of the salts, at most ``salts`` for each text, are combined over all.

The verdict goes back to the rows by digest alone, as no text has to travel for that. It may, because
the stages have shown which digests stand for one text; the rows of a digest that stands for several
texts, if there is one, meet their group by content. A group with more than a thousandth of all rows
is joined by broadcast, and there are fewer than a thousand of such; no other key is crowded.

* A null text counts as empty; so does a text of white space alone. They are one group.
* Rows without an id come after all others and may stay where no row of their text has an id.
* Repeated rows are rows: each is returned, one of them stays. Ids are integers.
* Only the id and text columns are read; other columns may have any names. An empty table gives an
  empty result.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from soquy.llm.common import stored

# Fixed value: the characters that do not count.
BLANKS = " \t\n\x0b\x0c\r"
CROWDED = 1_000
"""Groups with more than this part of all rows are joined by broadcast."""


def normalised(text_col: str) -> Column:
    return F.translate(F.coalesce(F.col(text_col).cast("string"), F.lit("")), BLANKS, "")


def preference() -> Column:
    """Larger for the row that is to stay: more code points first, then the smaller id, then null."""
    by_id = F.coalesce(F.lit(Decimal(1 << 63)) - F.col("id"), F.lit(Decimal(0)))
    return (F.col("n").cast("decimal(11,0)") * F.lit(Decimal(1 << 65)) + by_id).cast("decimal(38,0)")


def digested(docs: DataFrame, id_col: str, text_col: str, digest_bytes: int) -> DataFrame:
    """(id, n, norm, sha, digest) of every row."""
    rows = docs.select(
        F.col(id_col).cast("long").alias("id"),
        F.coalesce(F.char_length(F.col(text_col).cast("string")), F.lit(0)).alias("n"),
        normalised(text_col).alias("norm"),
    )
    rows = rows.withColumn("sha", F.unhex(F.sha2(F.col("norm").cast("binary"), 256)))
    return rows.withColumn("digest", F.substring("sha", 1, digest_bytes))


def combined(rows: DataFrame, salts: int) -> DataFrame:
    """(digest, norm, keep_id, best, size): one row for each different text, in the three stages."""
    dealt = rows.select("digest", "norm", "id", preference().alias("best"), F.pmod(F.spark_partition_id(), F.lit(salts)).alias("salt"))
    salted = dealt.groupBy("digest", "salt", "norm").agg(
        F.max_by("id", "best").alias("id"), F.max("best").alias("best"), F.count("*").alias("size")
    )
    return salted.groupBy("digest", "norm").agg(
        F.max_by("id", "best").alias("keep_id"), F.max("best").alias("best"), F.sum("size").alias("size")
    )


def exact_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 32, digest_bytes: int = 32
) -> DataFrame:
    """(id_col, keep_id, group_size, kept, text_sha256) of every row, dropped ones too.

    ``digest_bytes`` of the SHA-256 lead rows to each other; fewer only cost time.
    """
    rows = digested(docs, id_col, text_col, digest_bytes)
    # equal rows become one with a count, so that one of them can stay
    signed = stored(rows.groupBy("digest", "sha", "id", "n").agg(F.count("*").alias("times")))
    winners = stored(combined(rows, salts).drop("norm"))
    several = stored(winners.groupBy("digest").count().filter("count > 1").select("digest"))
    plain, own = signed, winners
    if not several.isEmpty():
        plain, own = (df.join(several, "digest", "left_anti") for df in (signed, winners))
    total = winners.agg(F.sum("size")).first()[0] or 0
    crowded = own.filter(F.col("size") * CROWDED > total)
    rest = own.filter(F.col("size") * CROWDED <= total)
    found = plain.join(F.broadcast(crowded), "digest").unionByName(
        plain.join(F.broadcast(crowded.select("digest")), "digest", "left_anti").join(rest, "digest")
    )
    if not several.isEmpty():
        clashing = rows.join(several, "digest", "left_semi")
        groups = combined(clashing, salts)
        by_text = clashing.groupBy("digest", "sha", "id", "n", "norm").agg(F.count("*").alias("times"))
        found = found.unionByName(by_text.join(groups, ["digest", "norm"]).select(found.columns))
    found = found.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "times")))
    return found.select(
        F.col("id").alias(id_col),
        "keep_id",
        F.col("size").alias("group_size"),
        ((preference() == F.col("best")) & (F.col("copy") == 1)).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )
