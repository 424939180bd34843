"""Exact duplicates against brute force: awkward rows, crowded groups, digests that clash."""

import hashlib
import re
from collections import Counter, defaultdict

import pytest
from cases import documents, texts

from soquy.llm import exact


def brute(rows):
    groups = defaultdict(list)
    for row in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", row[1] or "")].append(row)
    out = Counter()
    for text, members in groups.items():
        sha = hashlib.sha256(text.encode()).hexdigest()
        order = lambda r: (-len(r[1] or ""), r[0] is None, r[0] or 0)
        first = min(members, key=order)
        left = True
        for r in sorted(members, key=order):
            out[(r[0], first[0], len(members), left, sha)] += 1
            left = False
    return out


def found(df):
    return Counter(tuple(r) for r in df.collect())


@pytest.mark.parametrize(("salts", "digest_bytes"), [(32, 32), (1, 32), (3, 1)])
def test_awkward_rows(spark, salts, digest_bytes):
    rows = texts()
    rows += [(200, "a b\tc", "en", "s"), (201, "abc", "en", "s"), (199, "ab  c", "en", "s"), (None, "a b c d", "en", "s"), (202, "abcd", "en", "s")]
    rows += [(203, " ", "en", "s"), (204, "\x1c", "en", "s"), (205, "é", "en", "s"), (206, "é", "en", "s")]
    got = exact.exact_groups(documents(spark, rows), salts=salts, digest_bytes=digest_bytes)
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert found(got) == brute(rows)


def test_a_text_with_most_rows_meets_under_salts(spark):
    rows = [(k, "the same text" if k % 3 else f"text {k}", "en", "s") for k in range(3000)]
    docs = documents(spark, rows).repartition(40)
    assert found(exact.exact_groups(docs)) == brute(rows)
    plan = exact.combined(exact.digested(docs, "doc_id", "text", 32), 4)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("HashAggregate") == 4 and "SortAggregate" not in plan
    salted = exact.combined(exact.digested(docs, "doc_id", "text", 32).filter("norm = 'thesametext'"), 4)
    assert [r["size"] for r in salted.collect()] == [2000]


def test_digests_that_clash_are_told_apart_by_content(spark):
    rows = [(k, "ABCDEFGH"[k % 8] * 3, "en", "s") for k in range(64)] + [(64, None, "en", "s"), (64, None, "en", "s")]
    assert found(exact.exact_groups(documents(spark, rows), digest_bytes=0)) == brute(rows)


def test_nothing(spark):
    assert exact.exact_groups(documents(spark, [])).collect() == []
