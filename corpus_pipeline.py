"""A training corpus from ``documents``: one row per document kept, in five stages.

Each stage is a function of (spark, docs, sf_dir); its result is written as Parquet and read again
as the next stage's documents. All but the last return the columns of documents.

1. language ID: documents whose text tells no language (``und``) go.
2. n-gram Jaccard join, five words and 0.8: of each class of near duplicates the document with the
   smallest id stays (of rows with one id, one row; rows without an id are a document each only where
   their class has no id, and then one of them stays).
3. suffix-array dedup: strings of ``REPEATED_BYTES`` bytes that also start anywhere else are cut out,
   whole characters only; ``n_chars`` follows. A document stays, even with little text left.
4. benchmark decontamination: contaminated documents go.
5. mixing: documents are drawn with the probabilities that bring source, language and topic as near
   to their targets as half of all tokens can be; ``tokens``, ``weight`` and ``probability`` are added.

Null texts have no language and go in stage 1. An empty table passes every stage as an empty table.
Other columns of the documents are carried along under their names, whatever these are; only the
columns that the last stage adds take the place of columns of the same name.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from soquy.llm import contamination, jaccard, language, mixing, suffixes
from soquy.llm.common import lean, slices, stored

REPEATED_BYTES = 200
MIX_SEED = 17
SEGMENT_BYTES = 1 << 23  # of the index of stage 4: workers that earlier stages have filled hold less


OWN = ("doc_id", "text", "lang", "source", "n_chars")
ADDED = ("tokens", "weight", "probability")


def apart(stage):
    """A stage in which other columns than the documents' own have names that no operator uses."""

    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        names = {c if c in OWN else f"extra_{k}": c for k, c in enumerate(docs.columns)}
        out = stage(spark, docs.toDF(*names), sf_dir)
        kept = [c for c in out.columns if c in ADDED or names[c] not in ADDED or len(out.columns) == len(names)]
        return out.select(*(F.col(c).alias(names.get(c, c)) for c in kept))

    return run


@apart
def with_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = language.train(docs)
    return language.identify(docs, model).filter(F.col("lang_pred") != language.UNKNOWN).select(*docs.columns)


@apart
def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ids = docs.groupBy("doc_id").count().agg(F.max("count"), F.max(F.col("doc_id").isNull().cast("int"))).first()
    if (ids[0] or 0) <= 1 and not ids[1]:  # ids tell rows apart
        found = jaccard.near_duplicates(docs.select("doc_id", "text"), size=5, percent=80)
        first = found.filter(F.col("doc_id") == F.col("component_id")).select("doc_id")
        return docs.join(first, "doc_id", "left_semi").select(*docs.columns)
    numbered = stored(docs.withColumn("_row", F.monotonically_increasing_id()))
    rows = numbered.select(F.struct(F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("id"), "_row").alias("key"), "text")
    found = jaccard.near_duplicates(rows, size=5, percent=80, id_col="key")
    first = found.filter(F.col("key") == F.coalesce("component_id", "key")).select(F.col("key._row").alias("_row"))
    return numbered.join(first, "_row", "left_semi").select(*docs.columns)


@apart
def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = suffixes.with_spans(docs, REPEATED_BYTES)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = []
            for text, starts, ends in zip(*(batch[c].to_pylist() for c in ("text", *suffixes.ADDED)), strict=True):
                texts.append(suffixes.kept_text(text, starts, ends))
            new = {"text": pa.array(texts, pa.string())}
            if "n_chars" in names:
                sizes = [None if t is None else len(t) for t in texts]
                new["n_chars"] = pa.array(sizes, pa.int64()).cast(batch.schema.field("n_chars").type)
            yield pa.RecordBatch.from_arrays([new.get(c, batch[c]) for c in names], names=names)

    names = docs.columns
    return found.mapInArrow(lean(cut), docs.schema)


@apart
def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = contamination.match_phrases(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), segment_bytes=SEGMENT_BYTES)
    return found.withColumn("n_hit", contamination.hit_count()).filter(~contamination.is_contaminated()).select(*docs.columns)


@apart
def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    margins = {"source": F.col("source"), "lang": F.col("lang"), "topic": mixing.topic_column()}
    drawn = mixing.mix_sources(docs, margins, seed=MIX_SEED, sample=mixing.SAMPLE).filter("mix_sampled")
    return drawn.select(
        *docs.columns,
        F.col("mix_tokens").alias("tokens"),
        F.col("mix_weight").alias("weight"),
        F.col("mix_probability").alias("probability"),
    )


STAGES = [
    ("language ID", with_language),
    ("n-gram Jaccard join", without_near_copies),
    ("suffix-array dedup", without_repeats),
    ("benchmark decontamination", without_benchmark),
    ("mixing sources to target weights", mixed),
]

# The language model, the suffix array and the raking have no SQL form; tests/llm compares the stages
# with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
