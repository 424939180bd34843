"""Operators on documents against brute force, on awkward and empty tables."""

import hashlib
import itertools
import math
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from cases import DOCS, documents, texts
from pyspark.sql import functions as F

import corpus_pipeline
from soquy.llm import common, contamination, jaccard, language, licences, mixing, quality, queries, suffixes


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Tables as the queries read them."""
    out = str(tmp_path_factory.mktemp("tables"))
    documents(spark).write.parquet(f"{out}/documents.parquet")
    bench = [("10", texts()[7][1]), ("9", " ".join(texts()[8][1].split()[:5])), ("x", None), ("y", "..."), ("9", "two words")]
    spark.createDataFrame(bench, "item_id string, text string").write.parquet(f"{out}/benchmark.parquet")
    labels = [(k, k % 3 // 2, 0) for k in range(70)] + [(None, 1, 0), (3, None, 0)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{out}/labels.parquet")
    return out


@pytest.fixture(scope="module")
def nothing(spark, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("nothing"))
    documents(spark, []).write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame([], "item_id string, text string").write.parquet(f"{out}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{out}/labels.parquet")
    return out


def bag(rows) -> Counter:
    return Counter(tuple(r) for r in rows)


def shingles(text, size):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    if len(words) < size:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[k : k + size]) for k in range(len(words) - size + 1))


def brute_classes(rows, size, percent):
    sets = [shingles(r[1], size) for r in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        common = len(sets[a] & sets[b])
        if common and 100 * common >= percent * len(sets[a] | sets[b]):
            parent[find(b)] = find(a)
    low = defaultdict(list)
    for k, r in enumerate(rows):
        if r[0] is not None:
            low[find(k)].append(r[0])
    return [(r[0], len(sets[k]), min(low[find(k)], default=None)) for k, r in enumerate(rows)]


@pytest.mark.parametrize(("size", "percent"), [(3, 90), (5, 80), (1, 50)])
def test_jaccard_join(spark, size, percent):
    found = jaccard.near_duplicates(documents(spark), size=size, percent=percent)
    assert bag(found.collect()) == Counter(brute_classes(texts(), size, percent))


def test_jaccard_crowded_ngrams_meet_in_blocks(spark):
    rng = np.random.default_rng(2)
    nodes = [(k, int(rng.integers(0, 4)), sorted({int(x) for x in rng.integers(0, 12, 9)})) for k in range(60)]
    shared = spark.createDataFrame([(7, k, 60, 0) for k, _, _ in nodes], "gram long, node long, places long, place int")
    sets = spark.createDataFrame(
        [(k, len(s), jaccard.parity(jaccard.mix(np.array(s, np.uint64)))) for k, _, s in nodes], "node long, n long, parity binary"
    )
    roots = spark.createDataFrame([(k, r) for k, r, _ in nodes], "node long, root long")
    found = {(r["a"], r["b"]) for r in jaccard.cross_pairs(shared, roots, sets, 60, part_rows=20).collect()}
    for (a, ra, sa), (b, rb, sb) in itertools.combinations(nodes, 2):
        linked = 100 * len(set(sa) & set(sb)) >= 60 * len(set(sa) | set(sb))
        assert not linked or ra == rb or (a, b) in found
    assert all(nodes[a][1] != nodes[b][1] for a, b in found)


def test_classes_of_chains_and_stars(spark):
    links = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 130)] + [(130, 129), (500, 500)]
    found = {r["node"]: r["root"] for r in jaccard.classes(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {**{k: 0 for k in range(1, 41)}, **{k: 100 for k in range(101, 131)}}


def brute_repeats(raws, length):
    seen = Counter(t[k : k + length] for t in raws for k in range(len(t) - length + 1))
    out = []
    for t in raws:
        inside = np.zeros(len(t), bool)
        for k in range(len(t) - length + 1):
            if seen[t[k : k + length]] > 1:
                inside[k : k + length] = True
        out.append(inside)
    return out


@pytest.mark.parametrize("length", [400, 60, 7])
def test_suffix_array_dedup(spark, folder, length):
    rows = texts()
    raws = [(r[1] or "").encode() for r in rows]
    expected = Counter()
    for r, raw, inside in zip(rows, raws, brute_repeats(raws, length), strict=True):
        edges = np.flatnonzero(np.diff(np.concatenate(([0], inside, [0]))))
        expected[(r[0], tuple(map(int, edges[0::2])), tuple(map(int, edges[1::2])))] += 1
    found = suffixes.with_spans(documents(spark), length).select("doc_id", *suffixes.ADDED).collect()
    assert Counter((r[0], tuple(r[1]), tuple(r[2])) for r in found) == expected
    if length == 400:
        digest = {(r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in queries.suffix_array_dedup(spark, folder).collect()}
        for r, raw, inside in zip(rows, raws, brute_repeats(raws, length), strict=True):
            kept = bytes(np.frombuffer(raw, np.uint8)[~inside])
            n_spans = int((np.diff(np.concatenate(([0], inside))) > 0).sum())
            assert (r[0], len(raw), int(inside.sum()), n_spans, hashlib.sha256(kept).hexdigest()) in digest


def test_suffix_sorter_on_crowded_runs():
    rng = np.random.default_rng(4)
    shared = bytes(rng.integers(97, 100, 500, np.uint8))
    raws = [bytes(rng.integers(97, 123, 50, np.uint8)) + shared[k % 90 : 380 + k % 70] for k in range(40)] + [b"a" * 700]
    for length in (20, 100, 300):
        found = []
        for raw, inside in zip(raws, brute_repeats(raws, length), strict=True):
            pass
        ends = np.cumsum([len(t) for t in raws])
        first, last, place, _ = suffixes.anchors(np.frombuffer(b"".join(raws), np.uint8), ends, length)
        joined = b"".join(raws)
        flags = suffixes.repeated_in_bucket([joined[a : b + length] for a, b in zip(first, last, strict=True)], place - first, length)
        got = np.zeros(len(joined), bool)
        for a, flag in zip(first, flags, strict=True):
            for k in np.flatnonzero(flag):
                got[a + k : a + k + length] = True
        assert (got == np.concatenate(brute_repeats(raws, length))).all(), found


def test_kept_text_keeps_whole_characters():
    text = "aéüb"
    assert suffixes.kept_text(text, [2], [4]) == "aéüb"[:2] + "üb"
    assert suffixes.kept_text(text, [1], [3]) == "aüb"
    assert suffixes.kept_text(None, [], []) is None


def held_at_most(run) -> float:
    """MB of Python and numpy that the call holds at a time."""
    tracemalloc.start()
    run()
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return most / 1e6


def test_a_task_holds_few_of_its_pieces():
    """5,000 texts of 10,000 bytes and four pieces, all in one batch."""
    raws = [hashlib.shake_128(b"%d" % k).hexdigest(5_000) for k in range(5_000)]
    ranges = [{"run": at, "first": at, "last": at + 160, "place": at + 160, "copies": 1, "places": 2} for at in range(0, 640, 160)]
    kind = pa.list_(pa.struct([(c, pa.int64() if c == "run" else pa.int32()) for c in ranges[0]]))
    columns = [pa.array([raw[:16].encode() for raw in raws]), pa.array(raws), pa.array([ranges] * len(raws), kind)]
    batch = pa.RecordBatch.from_arrays(columns, names=["key", "text", "found"])
    pieces = []

    def run():
        for part in suffixes.cut_pieces(200, 7)(iter([batch])):
            pieces.append(part.num_rows)

    assert held_at_most(run) < 50
    assert sum(pieces) == 20_000


def test_a_bucket_is_sorted_in_little_memory():
    """4 MB without repeats but for the first half of two pieces."""
    rng = np.random.default_rng(5)
    pieces = [rng.integers(0, 256, 40_000, dtype=np.uint8).tobytes() for _ in range(100)]
    pieces[4] = pieces[3][:20_000] + pieces[4][20_000:]
    found = []
    assert held_at_most(lambda: found.extend(suffixes.repeated_in_bucket(pieces, np.zeros(100, np.int64), 200))) < 100
    assert [len(x) for x in found] == [39_801] * 100
    assert [int(x.sum()) for x in found] == [19_801 if k in (3, 4) else 0 for k in range(100)]
    assert found[3][:19_801].all() and found[4][:19_801].all()


def brute_matches(doc_texts, items, size):
    word = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    cut = lambda t: word.findall((t or "").encode().lower())
    windows = defaultdict(set)
    for item, text in items:
        w = cut(text)
        for k in range(max(1, len(w) - size + 1) if w else 0):
            windows[tuple(w[k : k + size])].add(item)
    out = []
    for text in doc_texts:
        w, hit, found = cut(text), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if ids := windows.get(tuple(w[k : k + n])):
                    hit |= set(range(k, k + n))
                    found |= ids
        sha = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((len(w), len(hit), len(found), sha, len(hit) > 0 and 20 * len(hit) >= len(w)))
    return out


def test_decontamination(spark, folder):
    rows = texts()
    items = [tuple(r) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    expected = Counter((r[0], *m) for r, m in zip(rows, brute_matches([r[1] for r in rows], items, 13), strict=True))
    columns = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert bag(queries.decontamination(spark, folder).select(*columns).collect()) == expected
    bench = spark.read.parquet(f"{folder}/benchmark.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    parts = contamination.match_phrases(docs, bench, part_windows=3).withColumn("n_hit", contamination.hit_count())
    assert bag(parts.select("doc_id", "n_words", "n_hit").collect()) == Counter({k: v for k, v in _shorter(expected).items()})
    assert set(DOCS.names) <= set(parts.columns)
    small = contamination.match_phrases(docs, bench, segment_bytes=3_000).withColumn("n_hit", contamination.hit_count())
    assert bag(small.select("doc_id", "n_words", "n_hit").collect()) == _shorter(expected)
    none = contamination.match_phrases(docs.limit(0), bench).collect()
    assert none == [] and contamination.match_phrases(docs, bench.limit(0)).filter("size(items) > 0").count() == 0


def test_positional_index(spark, folder):
    """Stored lists against the words of each text; ranges of hits that overlap, and repeated items in parts."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    scratch = contamination.Scratch()
    texts = contamination.numbered_texts(docs, scratch, "text", "at", ["doc_id", "text"])
    index = contamination.PositionalIndex(texts, scratch, "text", "at", segment_bytes=3_000)
    stored, segments = index.postings.collect(), defaultdict(dict)
    for r in stored:
        if r["rows"] is not None:
            segments[r["segment"]]["texts"] = (r["rows"], r["positions"])
        else:
            assert r["n"] == len(r["positions"])
            segments[r["segment"]].update({p: r["term"] for p in r["positions"]})
    assert len(segments) > 3
    found = {}
    for lists in segments.values():
        rows, firsts = lists.pop("texts")
        for row, first, end in zip(rows, firsts, firsts[1:], strict=False):
            assert end - 1 not in lists
            found[row] = [lists.pop(p) for p in range(first, end - 1)]
        assert not lists
    for r in texts.collect():
        hashed, _ = contamination.term_hashes([(r["text"] or "").encode()])
        assert found.get(r["at"], []) == hashed.tolist() and r["n_words"] == len(hashed)
    rows = [(1, "a b c d e f"), (2, "b c"), (3, "c"), (4, "x a b"), (5, "c d")]
    items = [("i", "a b c d"), ("i", "a b c d"), ("i", "d e f"), ("j", "c d"), (None, "a"), ("k", None), ("l", "..."), ("m", "zz a b")]
    small = spark.createDataFrame(rows, "doc_id long, text string").repartition(1)
    bench = spark.createDataFrame(items, "item_id string, text string")
    for part in (1, 100):
        got = contamination.match_phrases(small, bench, size=3, part_windows=part).orderBy("doc_id").collect()
        assert [(r["hit_starts"], r["hit_ends"], r["items"]) for r in got] == [
            ([0], [6], ["i", "j"]), ([], [], []), ([], [], []), ([], [], []), ([0], [2], ["j"])
        ]


def _shorter(rows):
    out = Counter()
    for r, n in rows.items():
        out[r[:3]] += n
    return out


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "x Zebra then a quagga, and okapi y"), (2, "zebra " + "z " * 40 + "quagga okapi"), (3, None)], "doc_id long, text string")
    bench = spark.createDataFrame([("i", "okapi quagga zebra")], "item_id string, text string")
    assert [tuple(r) for r in contamination.proximity_matches(docs, bench).collect()] == [(1, "i", 1, 6)]


def test_proximity_against_brute_force(spark):
    rng = np.random.default_rng(6)
    words = ["qa", "qb", "qc", "x", "y", "z"]
    rows = [(k, " ".join(rng.choice(words, rng.integers(1, 25), p=[0.06, 0.15, 0.15, 0.24, 0.2, 0.2]))) for k in range(300)]
    rows += [(300, "qb " + "x " * 9 + "qa " + "x " * 10 + "qb " + "x " * 13 + "qc")]  # nearest on the wrong side
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    for within in (4, 8, 26):
        expected = Counter()
        for k, text in rows:
            places = {t: [i for i, w in enumerate(text.split()) if w == t] for t in ("qa", "qb", "qc")}
            for a in places["qa"]:
                spans = [(max(a, b, c) - min(a, b, c), -min(a, b, c)) for b in places["qb"] for c in places["qc"]]
                if spans and min(spans)[0] < within:
                    wide, low = min(spans)
                    expected[k, "i", -low, wide - low] += 1
        bench = spark.createDataFrame([("i", "qa qb qc")], "item_id string, text string")
        assert expected and bag(contamination.proximity_matches(docs, bench, within=within).collect()) == expected


def test_languages(spark, folder):
    found = {}
    for r in queries.languages(spark, folder).collect():
        found.setdefault(r["doc_id"], []).append(r)
        assert 0 <= r["score"] <= 1
        held = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2
        assert r["held_out"] is held
    assert sum(len(v) for v in found.values()) == len(texts())
    wrong = [k for k, _, lang, _ in texts()[:74] if found[k][0]["lang_pred"] != lang and k not in range(60, 66)]
    assert len(wrong) <= 4 and {found[k][0]["lang_pred"] for k in (80, 81, 82, 86)} == {"und"}


def test_rare_language_keeps_its_model_beside_a_hot_one(spark):
    letters = "abcdefghij"
    hot = [(" ".join(f"{a}{b}{c}" for a in letters for b in letters for c in letters), "hot")] * 40
    rare = [("шум дождь ветер река", "rare"), ("река шум", "rare")]
    models = []
    for rows in (hot[:2] + rare, hot + rare):
        docs = spark.createDataFrame(rows, "text string, lang string")
        models.append(language.train(docs, max_words=100, max_grams=120))
        model = models[-1]
        assert model.languages == ["hot", "rare"]
        assert len(model.words) < 130 and len(model.grams) < 150
        assert {"шум", "дождь", "ветер", "река"} <= set(model.words)
        assert any(len(g) == 4 and "ш" in g for g in model.grams)
        scorer = language.Scorer(model)
        assert scorer.predict("шум ветер")[0] == scorer.predict("дождик")[0] == "rare" and scorer.predict("abc")[0] == "hot"
    rare_keys = [{w for w in m.words if not w.isascii()} | {g for g in m.grams if not g.isascii()} for m in models]
    assert rare_keys[0] == rare_keys[1]


def test_language_backoff():
    model = language.LanguageModel(
        ["a", "b"], 3, {"known": 0}, {"ab": 1, "a": 2, " z": 3}, np.array([[-1.0, -2.0], [-3.0, -1.0], [-1.0, -9.0], [-2.0, -2.0], [0, 0]])
    )
    scorer = language.Scorer(model)
    assert scorer.predict("Known")[0] == "a"
    assert scorer.predict("cab")[0] == "b"  # the bigram counts, the letter does not
    assert scorer.predict("ca")[0] == "a"
    assert scorer.predict("qq") == ("a", 0.5) and scorer.predict("12 !") == ("und", 0.0)
    assert math.isclose(scorer.predict("known")[1], 1 / (1 + math.exp(-1)))


def test_quality(spark, folder):
    rows = queries.quality_rules(spark, folder).collect()
    assert len(rows) == len(texts())
    for r in rows:
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
        assert r["held_out"] is (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)


def test_quality_rules_tell_junk(spark):
    good = [(k, "A plain sentence of some words. And one more of them, with a comma.", 1) for k in range(60)]
    junk = [(k, "word### more%%% " * 5, 0) for k in range(60, 120)]
    docs = spark.createDataFrame(good + junk, "doc_id long, text string, quality int")
    measured = quality.statistics(docs, ["doc_id", "quality"])
    model = quality.fit(measured, "quality", trees=6)
    assert model.rules
    wrong = measured.withColumn("s", model.score()).filter((F.col("s") >= 0.5) != (F.col("quality") == 1))
    assert wrong.count() == 0
    one = quality.fit(measured.filter("quality = 1"), "quality")
    assert measured.select(one.score().alias("s")).first()["s"] > 0.99


def test_tree_paths():
    text = "If (feature 0 <= 1.5)\n If (feature 1 > 2.0)\n  Predict: 1\n Else (feature 1 <= 2.0)\n  Predict: 0\nElse (feature 0 > 1.5)\n Predict: 0"
    a, b = quality.STATISTICS[:2]
    assert quality.tree_rules(text) == {
        ((a, True, 1.5),),
        tuple(sorted([(a, True, 1.5), (b, False, 2.0)])),
        tuple(sorted([(a, True, 1.5), (b, True, 2.0)])),
        ((a, False, 1.5),),
    }


def test_mixing(spark):
    docs = documents(spark)
    margins = {"source": F.col("source"), "lang": F.col("lang")}
    rows = mixing.mix_sources(docs, margins, temperature=0.5).collect()
    assert len(rows) == len(texts())
    tokens, drawn = defaultdict(int), defaultdict(float)
    for r in rows:
        assert r["mix_tokens"] == len(re.findall(r"[^ \t\n\x0b\f\r]+", r["text"] or ""))
        assert 0 <= r["mix_probability"] <= 1 and (r["mix_probability"] > 0) == (r["mix_tokens"] > 0)
        tokens[r["source"]] += r["mix_tokens"]
        drawn[r["source"]] += r["mix_tokens"] * r["mix_probability"]
    wanted = {k: math.sqrt(v) for k, v in tokens.items()}
    for k in tokens:
        assert math.isclose(drawn[k] / sum(drawn.values()), wanted[k] / sum(wanted.values()), rel_tol=1e-4)


def test_mixing_to_given_targets(spark):
    docs = documents(spark)
    target = spark.createDataFrame([("s0", 3.0), ("s1", 1.0), ("nowhere", 5.0)], "source string, share double")
    rows = mixing.mix_sources(docs, {"source": F.col("source")}, {"source": target}).collect()
    drawn = defaultdict(float)
    for r in rows:
        drawn[r["source"]] += r["mix_tokens"] * r["mix_probability"]
    assert math.isclose(drawn["s0"], 3 * drawn["s1"], rel_tol=1e-6) and not drawn["s2"] and not drawn[None]
    assert all(not r["mix_sampled"] for r in rows if r["source"] == "s2")


def skewed(spark, n, new):
    """Documents of ten words: nine of ten of one source, and one document of a source of its own."""
    rows = [(k, "word " * 10, "en" if k % 7 else "de", "hot" if k % 10 else "cold") for k in range(n)]
    return documents(spark, rows + ([(n, "word " * 10, "fr", "new")] if new else []))


@pytest.mark.parametrize("new", [False, True])
def test_mixing_sample_does_not_hang_on_the_rarest_cell(spark, new):
    margins = {"source": F.col("source"), "lang": F.col("lang")}
    for n in (300, 3000):
        rows = mixing.mix_sources(skewed(spark, n, new), margins, sample=0.5).collect()
        assert math.isclose(sum(r["mix_probability"] for r in rows), 0.5 * len(rows), rel_tol=1e-6)
        assert all(0 < r["mix_probability"] <= 1 for r in rows)
        cells = {(r["source"], r["lang"]): r["mix_weight"] for r in rows}
        assert math.isclose(sum(cells.values()), 1, rel_tol=1e-6)
        cold = sum(r["mix_probability"] for r in rows if r["source"] == "cold")
        power = {s: sum(r["source"] == s for r in rows) ** 0.7 for s in ("hot", "cold", "new")}
        assert new or math.isclose(cold, 0.5 * n * power["cold"] / (power["hot"] + power["cold"]), rel_tol=1e-3)
        assert not new or [r["mix_probability"] for r in rows if r["source"] == "new"] == [pytest.approx(1)]


def test_mixing_sample_takes_all_where_less_is_there(spark):
    target = spark.createDataFrame([("s0", 3.0), ("s1", 1.0)], "source string, share double")
    rows = mixing.mix_sources(documents(spark), {"source": F.col("source")}, {"source": target}, sample=1.0).collect()
    for r in rows:
        assert r["mix_probability"] == pytest.approx(float(r["source"] in ("s0", "s1") and r["mix_tokens"] > 0))


def test_mixing_query_and_stage_draw_half(spark, tmp_path):
    skewed(spark, 3000, True).write.parquet(f"{tmp_path}/documents.parquet")
    found = queries.mixing_weights(spark, str(tmp_path)).agg(F.sum("mix_probability")).first()[0]
    assert math.isclose(found, 0.5 * 3001, rel_tol=1e-6)
    kept = corpus_pipeline.mixed(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path)).count()
    assert abs(kept - 1500) < 150


def test_licences(spark):
    grant, notice = licences.SENTENCES["mit-grant"], licences.SENTENCES["mit-notice"]
    rows = [
        (1, f"Prose without an end\n{licences.SENTENCES['apache-name']}\nmore"),
        (2, f"{grant}\n\n{notice}"),
        (3, f"{notice}\n\n{grant}"),  # wrong order
        (4, f"{grant}\n\n{'x ' * 2000}\n\n{notice}"),  # too far apart
        (5, "\n".join(licences.SENTENCES[k] for k in ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse")).upper()),
        (6, None),
        (7, ""),
    ]
    found = licences.scan_licences(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r["doc_id"]: [(m["licence"], m["sentences"]) for m in r["licences"]] for r in found.collect()} == {
        1: [("Apache-2.0", 1)], 2: [("MIT", 2)], 3: [], 4: [], 5: [("BSD-3-Clause", 4)], 6: [], 7: [],
    }
    for licence, names in licences.RULES:
        text = "\n".join(licences.SENTENCES[n] for n in names)
        assert licences.Scanner(licences.SENTENCES, licences.RULES, 2000).scan(text)[0][0] == licence


@pytest.mark.parametrize("size", [1, 1_700, 20_000])
def test_licence_line_with_more_behind_it(size):
    text = f"# NOTICE\n{licences.SENTENCES['apache-name']} {'word ' * (size // 5)}"
    assert [m[0] for m in licences.Scanner(licences.SENTENCES, licences.RULES, 2000).scan(text)] == ["Apache-2.0"]


def test_pipeline_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows, kept = texts(), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, folder)
        before = [tuple(r) for r in docs.select("doc_id", "text").collect()]
        after = [tuple(r) for r in out.select("doc_id", "text").collect()]
        if k < 4:
            assert out.columns == docs.columns
        if k == 0:
            assert Counter(after) == Counter(r for r in before if re.search(r"[^\W\d_]", r[1] or ""))
        if k == 1:
            classes = brute_classes(before, 5, 80)
            groups = len({c for _, n, c in classes if n}) + sum(1 for _, n, _ in classes if not n)
            lonely = sum(1 for i, _, c in classes if c is None)
            assert len(after) in range(groups, groups + lonely + 1) and len({t for _, t in after}) == len(after)
        if k == 2:
            raws = [t.encode() for _, t in before]
            removed = dict(zip([r[0] for r in before], brute_repeats(raws, corpus_pipeline.REPEATED_BYTES), strict=True))
            for doc, text in after:
                assert 0 <= len(text.encode()) - int((~removed[doc]).sum()) <= 6 * 40
            assert all(r["n_chars"] == len(r["text"]) for r in out.collect())
        if k == 3:
            matches = brute_matches([t for _, t in before], [tuple(r) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()], 13)
            assert Counter(after) == Counter(b for b, m in zip(before, matches, strict=True) if not m[-1])
        if k == 4:
            assert {"tokens", "weight", "probability"} <= set(out.columns) and not Counter(after) - Counter(before)
            assert out.schema["weight"].dataType.simpleString() == "double"
        docs = spark.createDataFrame(out.collect(), out.schema)
        kept.append(len(after))
    assert kept[0] < len(rows) and kept[-1] > 0


def licence_names(text, gap=2_000):
    return [m[0] for m in licences.Scanner(licences.SENTENCES, licences.RULES, gap).scan(text)]


def test_licences_whatever_stands_between_their_words():
    assert licence_names(f"Released under{' ' * 1800}the MIT License.") == ["MIT"]
    assert licence_names("// SPDX-License-Identifier: MPL-2.0\nint x;") == ["MPL-2.0"]
    assert licence_names("SPDX-License-Identifier: nothing. " + "word " * 20 + "\nMIT\n") == []


def test_rules_reach_any_later_sentence():
    a, b, c = (licences.SENTENCES[k] for k in ("bsd-grant", "bsd-source", "bsd-binary"))
    fill = " " + "word " * 300 + ".\n"
    assert licence_names(a + "\n" + b + fill + b + fill + c) == ["BSD-2-Clause"]
    assert licence_names(a + "\n" + b + fill + fill + fill + c) == []


def brute_rules(sequence, rules, gap):
    """All chains, tried one by one, over (identifier, place) of sentences 10 long."""
    found = set()
    for licence, wanted in rules:
        def go(k, end, first):
            if k == len(wanted):
                found.add((first, end, licence, len(wanted)))
                return
            for name, at in sequence:
                if name == wanted[k] and (k == 0 or end <= at <= end + gap):
                    go(k + 1, at + 10, at if k == 0 else first)
        go(0, 0, 0)
    kept, reach = [], -1
    best = {}
    for first, end, licence, n in found:
        best[(first, licence, n)] = min(end, best.get((first, licence, n), end))
    for first, end, licence, n in sorted((f, -e, l, n) for (f, l, n), e in best.items()):
        if -end > reach:
            kept.append((licence, first, -end, n))
            reach = -end
    return kept


def test_rules_against_all_chains():
    rng = np.random.default_rng(6)
    rules = (("x", ("a", "b", "c")), ("y", ("b", "a")), ("z", ("c",)))
    scanner = licences.Scanner({n: f"sentence {n}." for n in "abc"}, rules, 25)
    for _ in range(200):
        at, sequence = 0, []
        for _ in range(rng.integers(1, 9)):
            at += int(rng.integers(10, 40))
            sequence.append(("abc"[rng.integers(0, 3)], at))
        places = {n: [(p, p + 10) for m, p in sequence if m == n] for n in "abc"}
        scanner.recognised = lambda text, places=places: {n: p for n, p in places.items() if p}
        assert scanner.scan("text") == brute_rules(sequence, rules, 25)


def test_raked_weights_meet_the_margins_as_plain_sweeps_do(spark):
    rng = np.random.default_rng(3)
    cells = [(a, b, int(rng.integers(1, 500))) for a in "pqr" for b in "uvwx" if rng.random() < 0.9]
    table = spark.createDataFrame(cells, "m string, k string, tokens long")
    targets = {"m": {"p": 0.2, "q": 0.5, "r": 0.3}, "k": {"u": 0.1, "v": 0.2, "w": 0.3, "x": 0.4}}
    given = {n: spark.createDataFrame(list(t.items()), f"{n} string, share double") for n, t in targets.items()}
    weights = {(a, b): n / sum(c[2] for c in cells) for a, b, n in cells}
    for _ in range(400):
        for place, name in enumerate(("m", "k")):
            for value, share in targets[name].items():
                now = sum(w for key, w in weights.items() if key[place] == value)
                for key in weights:
                    if key[place] == value:
                        weights[key] *= share / now
    for together in (mixing.TOGETHER, 0):
        kept, mixing.TOGETHER = mixing.TOGETHER, together
        try:
            found = {(r["m"], r["k"]): r["weight"] for r in mixing.rake(table, ["m", "k"], given).collect()}
        finally:
            mixing.TOGETHER = kept
        assert found.keys() == weights.keys()
        assert max(abs(found[key] - weights[key]) for key in weights) < 1e-5


def tasks_of(spark, run) -> int:
    """Tasks of all that is run, over 64 shuffle partitions that are not coalesced."""
    group, conf = f"tasks-{id(run)}", {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    spark.sparkContext.setJobGroup(group, "")
    try:
        run()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    tracker = spark.sparkContext.statusTracker()
    stages = {s for job in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(job).stageIds}
    return sum(x.numCompletedTasks for s in stages if (x := tracker.getStageInfo(s)))


def test_classes_that_are_stars_take_no_rounds(spark):
    links = common.stored(spark.createDataFrame([(k % 7, k) for k in range(7, 300)], "a long, b long"))
    found = []
    assert tasks_of(spark, lambda: found.extend(jaccard.classes(links).collect())) < 500
    assert sorted(tuple(r) for r in found) == sorted((k, k % 7) for k in range(7, 300))


def test_raking_few_cells_takes_tasks_for_no_partitions(spark):
    cells = common.stored(spark.range(60).selectExpr("id % 6 AS m", "id div 6 AS k", "id + 1 AS tokens"))
    given = {x: mixing.natural_targets(cells, x, 0.7).localCheckpoint() for x in ("m", "k")}
    found = []
    run = lambda: found.extend(mixing.rake(cells, ["m", "k"], given, sample=0.5).collect())
    assert tasks_of(spark, run) < 250
    assert sum(r["weight"] for r in found) == pytest.approx(0.5)


@pytest.mark.parametrize("name", ["op2_jaccard_join", "op4_mixing_weights", "op5_suffix_array_dedup", "op6_licence_rules", "op7_language_backoff", "op8_positional_index", "op10_quality_rules"])
def test_empty_tables(spark, nothing, name):
    assert queries.QUERIES[name](spark, nothing).count() == 0


def test_empty_pipeline(spark, nothing):
    assert corpus_pipeline.run(spark, nothing).count() == 0


def test_signs_are_no_letters():
    model = language.LanguageModel(["a"], 1, {}, {"½": 0}, np.zeros((2, 1)))
    assert language.Scorer(model).predict("½ ² 7") == ("und", 0.0) and language.Scorer(model).predict("½ é")[0] == "a"
