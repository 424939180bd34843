"""Language identification by words first, then by ever shorter character n-grams.

A model holds, per language, the log relative frequency of the most frequent words and of the most
frequent n-grams of ``longest`` characters down to one (words are padded with a space on both
sides). A known word scores its log frequency. An unseen word scores the mean log frequency of its
known n-grams of the longest length that has any; a word
without any known n-gram scores the same for every language. A text goes to the language with the
largest sum over all of its words.

* All counts are taken over every row with a language; the bounds ``max_words`` and ``max_grams``
  only say how many of the counted words and n-grams the model keeps, so that its size does not grow
  with the corpus. Each language has an equal quota of them, n-grams of each length a quota of their
  own, filled from its own highest counts; so what is kept of a language does not depend on how large
  the others are. What any language keeps has the counts of all languages.
* A word is a run of letters of the lower-cased text. A text that is null or has no letter is
  ``und`` with score 0. Ties go to the smaller language name. Without any labelled row all texts
  are ``und``.
* The score is the posterior probability of the language under a uniform prior.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from soquy.llm.common import Scratch, lean, slices

UNKNOWN = "und"
WORD = re.compile(r"[^\W\d_]+")
FLUSH = 200_000
SMOOTHING = 0.5


@dataclass
class LanguageModel:
    languages: list[str]
    longest: int
    words: dict[str, int]
    grams: dict[str, int]
    scores: np.ndarray  # one row per word, then one per n-gram, a last one of zeros


def grams_of(word: str, n: int) -> list[str]:
    padded = f" {word} "
    return [padded[k : k + n] for k in range(len(padded) - n + 1)]


def has_letter(words: list[str]) -> bool:
    """Signs such as ``½`` make words, but are no letters."""
    return words[0].isalpha() or any(c.isalpha() for word in words for c in word)


def tally(counts: Counter) -> pa.RecordBatch:
    langs, keys = zip(*counts, strict=True) if counts else ((), ())
    return pa.RecordBatch.from_arrays(
        [pa.array(langs, pa.string()), pa.array(keys, pa.string()), pa.array(counts.values(), pa.int64())],
        names=["lang", "key", "n"],
    )


def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    by_lang: dict[str, Counter] = {}
    for batch in slices(batches):
        for lang, text in zip(batch["lang"].to_pylist(), batch["text"].to_pylist(), strict=True):
            by_lang.setdefault(lang, Counter()).update(WORD.findall(text.lower()))
        if sum(map(len, by_lang.values())) > FLUSH:
            while by_lang:
                yield tally_of(*by_lang.popitem())
    while by_lang:
        yield tally_of(*by_lang.popitem())


def tally_of(lang: str, held: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([lang] * len(held), pa.string()), pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())],
        names=["lang", "key", "n"],
    )


def count_grams(longest: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for batch in batches:
            for lang, word, n in zip(*(batch[c].to_pylist() for c in ("lang", "key", "n")), strict=True):
                for size in range(1, longest + 1):
                    for gram in grams_of(word, size):
                        held[lang, gram] += n
                if len(held) > FLUSH:
                    yield tally(held)
                    held.clear()
        yield tally(held)

    return run


def quotas(sizes: dict, languages: int, limit: int) -> dict:
    """Room for each (language, part): every language has the same, and parts of it that need less
    than an equal share leave the rest to its longer parts. Every part has room for one at least."""
    by_lang: dict = {}
    for (lang, part), n in sizes.items():
        by_lang.setdefault(lang, []).append((n, part))
    out = {}
    for lang, parts in by_lang.items():
        room = limit // languages
        for k, (n, part) in enumerate(sorted(parts)):
            out[lang, part] = min(n, max(1, room // (len(parts) - k)))
            room -= out[lang, part]
    return out


def most_frequent(counts: DataFrame, limit: int, part: Column) -> DataFrame:
    """Keys with their counts by language: of each language and part the highest counts, as many as
    its quota.

    A class is an eighth of a power of two, so the histogram that sets the thresholds is small and no
    task has to sort the keys. Of the class that passes the quota a share is taken, by hash.
    """
    classed = counts.withColumns({"part": part, "level": F.floor(F.log2("n") * 8)})
    classes = classed.groupBy("lang", "part", "level").count().collect()
    sizes: Counter = Counter()
    for row in classes:
        sizes[row["lang"], row["part"]] += row["count"]
    room = quotas(sizes, len({lang for lang, _ in sizes}), limit)
    least = {}
    for row in sorted(classes, key=lambda r: -r["level"]):
        group = row["lang"], row["part"]
        if room[group] > 0:
            least[group] = (row["level"], min(1.0, room[group] / row["count"]))
            room[group] -= row["count"]
    spark = counts.sparkSession
    bounds = spark.createDataFrame(
        [(*group, *bound) for group, bound in least.items()], "lang string, part int, least long, share double"
    )
    draw = F.pmod(F.xxhash64("key"), F.lit(1 << 20)) / float(1 << 20)
    enough = (F.col("level") > F.col("least")) | ((F.col("level") == F.col("least")) & (draw < F.col("share")))
    # a row per language and part: small whatever the input
    flagged = classed.join(F.broadcast(bounds), ["lang", "part"]).withColumn("enough", enough)
    keys = flagged.groupBy("key").agg(
        F.max("enough").alias("enough"), F.map_from_entries(F.collect_list(F.struct("lang", "n"))).alias("by_lang")
    )
    return keys.filter("enough").select("key", "by_lang")


def flat(table: pa.Table, name: str) -> pa.Array:
    """The values of a column of lists, one after the other."""
    return table[name].combine_chunks().flatten() if len(table) else pa.array([], table.schema.field(name).type.value_type)


def train(
    labelled: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    longest: int = 4,
    max_words: int = 150_000,
    max_grams: int = 150_000,
) -> LanguageModel:
    """A model of all rows that have a text and a language."""
    rows = labelled.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).dropna()
    schema = "lang string, key string, n long"
    counted = rows.mapInArrow(lean(count_words), schema).groupBy("lang", "key").agg(F.sum("n").alias("n"))
    scratch = Scratch()
    words = scratch.stored(counted)
    grams = scratch.stored(words.mapInArrow(lean(count_grams(longest)), schema).groupBy("lang", "key").agg(F.sum("n").alias("n")))
    kept = [
        most_frequent(counts, n, part)
        .select("key", F.map_keys("by_lang").alias("langs"), F.map_values("by_lang").alias("ns"))
        .toArrow()
        .sort_by("key")
        for counts, n, part in ((words, max_words, F.lit(0)), (grams, max_grams, F.char_length("key")))
    ]
    scratch.clear()
    languages = sorted({x for table in kept for x in flat(table, "langs").unique().to_pylist()})
    index, tables = [], []
    for counted in kept:
        table = np.full((len(counted), len(languages)), SMOOTHING)
        sizes = [len(x) for x in counted["langs"]]
        column = pa.compute.index_in(flat(counted, "langs"), pa.array(languages, pa.string())).to_numpy()
        table[np.repeat(np.arange(len(counted)), sizes), column] += flat(counted, "ns").to_numpy()
        lengths = pa.compute.utf8_length(counted["key"]).to_numpy()
        if index:  # n-grams: shares among those of the same length
            for size in range(1, longest + 1):
                table[lengths == size] = np.log(table[lengths == size] / table[lengths == size].sum(0))
        elif len(counted):
            table = np.log(table / table.sum(0))
        start = len(tables[0]) if tables else 0
        index.append({key: start + k for k, key in enumerate(counted["key"].to_pylist())})
        tables.append(table)
    scores = np.concatenate([*tables, np.zeros((1, len(languages)))])
    return LanguageModel(languages, longest, index[0], index[1], scores)


class Scorer:
    """A model with the scores of the words met so far (about ``FLUSH`` of them at most)."""

    def __init__(self, model: LanguageModel):
        self.model = model
        self.forget()

    def forget(self) -> None:
        self.rows: dict[str, int] = {}
        self.table = np.empty((4096, len(self.model.languages)))

    def unseen(self, word: str) -> np.ndarray:
        for size in range(self.model.longest, 0, -1):
            known = [k for g in grams_of(word, size) if (k := self.model.grams.get(g)) is not None]
            if known:
                return self.model.scores[known].mean(0)
        return self.model.scores[-1]

    def row_of(self, word: str) -> int:
        row = len(self.rows)
        if row == len(self.table):
            self.table = np.concatenate([self.table, np.empty_like(self.table)])
        known = self.model.words.get(word)
        self.table[row] = self.unseen(word) if known is None else self.model.scores[known]
        self.rows[word] = row
        return row

    def predict(self, text: str | None) -> tuple[str, float]:
        words = WORD.findall(text.lower()) if text else []
        if not words or not self.model.languages or not has_letter(words):
            return UNKNOWN, 0.0
        if len(self.rows) > FLUSH:
            self.forget()
        known = self.rows.get
        rows = [k if (k := known(w)) is not None else self.row_of(w) for w in words]
        total = self.table[rows].sum(0)
        best = int(total.argmax())
        return self.model.languages[best], float(1 / np.exp(total - total[best]).sum())


def identify(docs: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """All rows with ``lang_pred`` and ``lang_score`` added (columns of these names are replaced)."""
    keep = [c for c in docs.columns if c not in ("lang_pred", "lang_score")]
    sent = docs.sparkSession.sparkContext.broadcast(vars(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(LanguageModel(**sent.value))
        for batch in slices(batches):
            found = [scorer.predict(text) for text in batch[text_col].to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*(batch[c] for c in keep), pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())],
                names=[*keep, "lang_pred", "lang_score"],
            )

    schema = docs.select(*keep).schema.add("lang_pred", "string").add("lang_score", "double")
    return docs.select(*keep).mapInArrow(lean(run), schema)
