"""Small awkward tables: nulls, empty and long texts, repeated rows, clashing column names."""

import random

from pyspark.sql import types as T

DOCS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        # names that operators use for columns of their own
        T.StructField("node", T.StringType()),
        T.StructField("n_hit", T.StringType()),
        T.StructField("text_key", T.StringType()),
        T.StructField("mix_tokens", T.StringType()),
        T.StructField("weight", T.StringType()),
        T.StructField("words", T.StringType()),
    ]
)
VOCABULARY = {
    "en": "the of and to in is that it was for on with as by at from this be are have".split(),
    "de": "der die und das ist nicht ein zu den mit von sich auf für dem über schön groß".split(),
    "fr": "le la les des est une dans pour que qui sur pas avec être été où déjà très".split(),
}


def sentence(rng: random.Random, lang: str, n: int) -> str:
    stems = VOCABULARY[lang]
    return " ".join(rng.choice(stems) + (rng.choice(stems) if rng.random() < 0.4 else "") for _ in range(n))


def texts(seed: int = 5) -> list[tuple]:
    rng = random.Random(seed)
    passage = sentence(rng, "en", 120)
    rows = []
    for k in range(60):
        lang = ("en", "de", "fr")[k % 3]
        rows.append((k, sentence(rng, lang, rng.randint(20, 300)) + ".", lang, f"s{k % 4}"))
    for k in range(60, 66):  # exact copies
        rows.append((k, rows[3][1], "en", "s0"))
    for k in range(66, 74):  # near copies: a word or two changed
        words = rows[4][1].split(" ")
        for _ in range(2 if k % 2 else 1):
            words[rng.randrange(len(words))] = "changed" + str(k)
        rows.append((k, " ".join(words), "de", "s1"))
    for k in range(74, 80):  # a passage that documents share
        rows.append((k, f"{sentence(rng, 'fr', 40)}\n{passage}\n{sentence(rng, 'fr', 30)}", "fr", "s2"))
    rows += [
        (80, None, "en", "s0"),
        (81, "", "en", None),
        (82, "   \n\t ", None, "s3"),
        (83, "one", "en", "s3"),
        (84, "two words", None, "s3"),
        (85, "One", "en", "s3"),
        (86, "123 456 !!", "en", "s3"),
        (87, sentence(rng, "en", 30_000), "en", "s0"),
        (88, "ab" * 3000, "en", "s0"),
        (None, sentence(rng, "de", 50), "de", "s1"),
        (None, None, None, None),
        (5, rows[5][1], "fr", "s1"),
        (5, rows[5][1], "fr", "s1"),
        (-7, rows[6][1], "en", "s2"),
        (89, "日本語 の 文 é ü x y\x0bz", "fr", "s1"),
    ]
    return rows


def documents(spark, rows=None):
    rows = texts() if rows is None else rows
    full = [(*r, None if r[1] is None else len(r[1]), "n", "h", "k", "m", "w", None) for r in rows]
    return spark.createDataFrame(full, DOCS).repartition(3)
