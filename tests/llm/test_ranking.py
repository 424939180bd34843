"""Ranked search against a plain evaluation of every item over every document."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from cases import documents, texts

from soquy.llm import ranking

TERM = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall((text or "").encode().lower())


def brute(rows, items, k=10):
    docs = [(r[0], Counter(terms(r[1]))) for r in rows]
    docs = [(i, c, sum(c.values())) for i, c in docs if c]
    n_docs, n_terms = len(docs), sum(n for _, _, n in docs)
    df = Counter(t for _, c, _ in docs for t in c)
    wanted = {}
    for item, text in items:
        wanted.setdefault(item, set()).update(terms(text))
    out = []
    for item, asked in wanted.items():
        scored = []
        for i, c, n in docs:
            m = 10 + 90 * n * n_docs // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in asked if t in c)
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        out += [(item, rank, s[3], -s[0]) for rank, s in enumerate(sorted(scored)[:k], 1)]
    return Counter(out)


def items():
    rows = texts()
    rng = random.Random(2)
    passages = []
    for k in range(30):
        words = (rows[k][1] or "").split()
        at = rng.randrange(len(words))
        passages.append((k, " ".join(words[at : at + 12])))
    return passages + [(40, None), (41, ""), (42, "..."), (43, "two WORDS"), (44, rows[87][1][:3000]), (45, "das das DAS"), (46, "nowhere"), (47, "日本語 é 123"), (None, "the of"), (48, "the"), (48, "Über")]


def found(df):
    return Counter(tuple(r) for r in df.collect())


def asked(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "item_id long, text string, term string, rank int")


@pytest.mark.parametrize(("k", "part_terms"), [(10, 100_000), (3, 40)])
def test_awkward_documents_and_items(spark, k, part_terms):
    got = ranking.search(documents(spark), asked(spark, items()), k, part_terms=part_terms)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert found(got) == brute(texts(), items(), k)


def test_small_blocks_of_documents(spark, monkeypatch):
    expected = brute(texts(), items())
    monkeypatch.setattr(ranking, "CELLS", 500)
    assert found(ranking.search(documents(spark), asked(spark, items()))) == expected


@pytest.mark.parametrize(("rows", "wanted"), [([], items()), (texts(), []), ([], []), ([(1, None, "en", "s")], items()), (texts(), [(1, None), (2, "!")])])
def test_nothing(spark, rows, wanted):
    got = ranking.search(documents(spark, rows), asked(spark, wanted))
    assert got.collect() == [] and got.columns == ["item_id", "rank", "doc_id", "score"]


def test_text_item_ids(spark):
    bench = spark.createDataFrame([("b", "the of"), ("a", "le la")], "item_id string, text string")
    assert found(ranking.search(documents(spark), bench)) == brute(texts(), [("b", "the of"), ("a", "le la")])


def test_shared_sets_cover_each_item_once_and_are_shared():
    rng = random.Random(7)
    passage = list(range(20))
    wanted = [sorted({*passage, *rng.sample(range(20, 60), 5)}) for _ in range(10)] + [rng.sample(range(60), 15) for _ in range(40)] + [[5]]
    pairs = [(i, t) for i, row in enumerate(wanted) for t in row]
    rng.shuffle(pairs)
    leaves, inner, rows = ranking.shared_sets([p[0] for p in pairs], [p[1] for p in pairs], len(wanted))
    held = [Counter(x) for x in leaves]
    for a, b in inner:
        held.append(held[a] + held[b])
    for row, nodes in zip(wanted, rows, strict=True):
        assert sum((held[n] for n in nodes), Counter()) == Counter(row)
    uses = Counter(n for row in rows for n in row) + Counter(n for pair in inner for n in pair)
    sums = len(inner) + sum(len(row) - 1 for row in rows)
    assert sums < 0.8 * sum(len(row) - 1 for row in wanted)
    assert max(uses.values()) > 1


def test_accumulators():
    sums = ranking.accumulate(np.array([0, 1, 1, 2]), np.array([1, 0, 0, 1]), np.array([5, 2, 3, 7]), 3, 2, np.array([[0, 1], [3, 2]]))
    assert sums.tolist() == [[0, 5], [5, 0], [0, 7], [5, 5], [5, 12]]
