"""The corpus operators as queries over a data folder, with production parameters.

Queries without an oracle have no SQL form (learned models, raking, a minimum cut, an approximate
index) or one too slow on whole tables; tests/llm holds them against brute force.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from soquy.llm import contamination, exact, hardnegatives, jaccard, language, licences, mincut, mixing, quality, ranking, suffixes, warc
from soquy.llm.common import lean, slices, stored
from soquy.llm.neighbours import nearest_neighbours
from soquy.llm.oracles import ORACLES as ORACLES


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return nearest_neighbours(table(spark, folder, "embeddings"), F.col("id") % 20 == 0)


def held_out(modulus: int, rest: int):
    """Whether the fold of a document, by its id alone, is kept from learning."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % modulus == rest, F.lit(False))


def warc_captures(spark: SparkSession, folder: str) -> DataFrame:
    archives = warc.write_captures(table(spark, folder, "pages"), "page_id", "url", "html")
    captures = warc.assemble(warc.read_records(spark, archives, payloads=False))
    said = F.col("metadata.fields")
    return captures.select(
        said["key"].cast("long").alias("page_id"),
        F.col("response.payload_bytes").alias("payload_bytes"),
        F.col("response.payload_digest").alias("payload_digest"),
        F.col("response.record_type").alias("record_type"),
        said["original-key"].cast("long").alias("refers_to"),
    )


def languages(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = language.train(docs.filter(~held_out(4, 2)))
    found = language.identify(docs.select("doc_id", "text"), model)
    return found.select(
        "doc_id", held_out(4, 2).alias("held_out"), "lang_pred", F.col("lang_score").alias("score")
    )


def main_texts(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages").select("page_id", "url", "html")
    return mincut.extract_main_text(pages).select("page_id", "url", "text", "n_chars")


def licence_scan(spark: SparkSession, folder: str) -> DataFrame:
    found = licences.scan_licences(table(spark, folder, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id",
        F.size("licences").cast("long").alias("n_matches"),
        F.concat_ws(",", F.array_sort(F.array_distinct("licences.licence"))).alias("licences"),
        F.to_json("licences").alias("matches"),
    )


def jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, folder, "documents"), size=3, percent=90)


def suffix_array_dedup(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = []
            for text, starts, ends in zip(*(batch[c].to_pylist() for c in ("text", "span_starts", "span_ends")), strict=True):
                raw = (text or "").encode()
                kept = suffixes.kept_bytes(raw, starts, ends)
                left = suffixes.kept_text(text, starts, ends)
                rows.append((len(raw), len(raw) - len(kept), len(starts), hashlib.sha256(kept).hexdigest(), left))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "text"],
            )

    return suffixes.with_spans(docs).mapInArrow(
        lean(digest), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, text string"
    )


def decontamination(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = contamination.match_phrases(docs, table(spark, folder, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        contamination.hit_count().alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
    ).withColumn("contaminated", contamination.is_contaminated())


def mixing_weights(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    margins = {"source": F.col("source"), "lang": F.col("lang"), "topic": mixing.topic_column()}
    mixed = mixing.mix_sources(docs, margins, sample=mixing.SAMPLE)
    return mixed.select("doc_id", *mixing.ADDED)


def quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    measured = stored(quality.statistics(table(spark, folder, "documents"), ["doc_id"]))
    labels = table(spark, folder, "labels").select("doc_id", "quality")
    known = stored(measured.filter(~held_out(3, 1)).join(labels, "doc_id"))
    score = quality.fit(known, "quality").score()
    return measured.select("doc_id", held_out(3, 1).alias("held_out"), score.alias("score")).withColumn(
        "predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0)
    )


def exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact.exact_groups(table(spark, folder, "documents"))


def mined_negatives(spark: SparkSession, folder: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hardnegatives.hard_negatives(table(spark, folder, "embeddings"), F.col("id") % 100 == 0, label)


def ranked_search(spark: SparkSession, folder: str) -> DataFrame:
    return ranking.search(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc_captures": warc_captures,
    "op2_jaccard_join": jaccard_join,
    "op3_mincut_text": main_texts,
    "op4_mixing_weights": mixing_weights,
    "op5_suffix_array_dedup": suffix_array_dedup,
    "op6_licence_rules": licence_scan,
    "op7_language_backoff": languages,
    "op10_quality_rules": quality_rules,
    "op8_positional_index": decontamination,
    "op9_permutation_index": neighbours,
    "op11_exact_dedup": exact_dedup,
    "op12_hard_negatives": mined_negatives,
    "op13_ranked_search": ranked_search,
}
