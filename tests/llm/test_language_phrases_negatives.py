"""Language identification, phrase mining and hard negatives against brute force on small tables."""

import collections
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pytest

from quern.llm import language, negatives, oracles, phrases, queries

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# language


def test_grams_are_those_of_padded_words():
    def plain(text):
        found = []
        for word in re.findall(r"[^\W\d_]+", text.lower()):
            padded = f" {word} "
            found += list(word) + [padded[i : i + 2] for i in range(len(padded) - 1)] + [padded[i : i + 3] for i in range(len(padded) - 2)]
        return collections.Counter(found)

    def named(key):
        parts = [key >> 42, key >> 21 & 0x1FFFFF, key & 0x1FFFFF]
        return "".join(chr(p) for p in parts if p)

    for text in ("Über 3 Wege_nach-Rom", "a", "", " \n\t", "x1y", "日本語 text", "a b  c", "ß" * 50, "don't"):
        keys, counts = language.counted(text)
        assert {named(k): n for k, n in zip(keys.tolist(), counts.tolist())} == dict(plain(text))


def test_marks_belong_to_words_only_after_letters():
    assert len(language.counted("́ ́")[0]) == 0
    assert 0x301 in language.counted("é")[0].tolist()


def test_long_texts_are_counted_in_pieces(monkeypatch):
    text = " ".join(random.Random(1).choice(["der", "die", "und", "nicht"]) for _ in range(4000))
    whole = language.counted(text)
    monkeypatch.setattr(language, "_PIECE", 1000)
    assert all((a == b).all() for a, b in zip(language.counted(text), whole))


def sentences(seed, stems, n):
    rng = random.Random(seed)
    return [" ".join(rng.choice(stems) + rng.choice(stems) for _ in range(rng.randint(5, 40))) for _ in range(n)]


@pytest.fixture(scope="module")
def spoken(spark):
    rows = [(t, "aa") for t in sentences(1, ["ka", "ro", "mi"], 60)] + [(t, "bb") for t in sentences(2, ["the", "ing", "sh"], 60)] + [(t, "cc") for t in sentences(3, ["ñu", "ció", "lla"], 60)]
    rows = [(i, *r) for i, r in enumerate(rows)]
    return rows, spark.createDataFrame([(*r, "x", 0.5) for r in rows], "doc_id long, text string, lang string, lang_pred string, score double").repartition(5)


def test_languages_are_told_apart_on_texts_kept_from_learning(spark, spoken):
    rows, docs = spoken
    out = language.held_out(docs["doc_id"])
    found = {r["doc_id"]: r for r in language.identify_languages(docs, language.learn_profiles(docs.filter(~out))).collect()}
    kept = {i for i, *_ in rows if zlib.crc32(str(i).encode()) % 4 == 2}
    assert kept == {r["doc_id"] for r in docs.filter(out).select("doc_id").collect()} and len(kept) > 20
    assert all(found[i]["lang_pred"] == lang and 0 < found[i]["score"] <= 1 for i, _, lang in rows)


def test_odd_texts_have_a_defined_language(spark, spoken):
    _, docs = spoken
    profiles = language.learn_profiles(docs)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "123 !? _"), (None, "karo"), (4, "karo"), (4, "karo"), (5, "漢字"), (6, "karo " * 300_000)], "doc_id long, text string")
    found = {(r["doc_id"], r["lang_pred"], round(r["score"], 6)) for r in language.identify_languages(odd, profiles).collect()}
    assert {(1, "und", 0.0), (2, "und", 0.0), (3, "und", 0.0), (5, "aa", 0.0)} <= found
    assert {(i, lang) for i, lang, _ in found if i in (None, 4, 6)} == {(None, "aa"), (4, "aa"), (6, "aa")}
    assert language.identify_languages(odd, profiles).count() == 8
    assert language.identify_languages(odd.limit(0), profiles).collect() == []
    nothing = language.learn_profiles(docs.limit(0))
    assert {r["lang_pred"] for r in language.identify_languages(odd, nothing).collect()} == {"und"}


def test_blocks_of_languages_change_nothing(spark, spoken):
    _, docs = spoken
    profiles = language.learn_profiles(docs)
    one = language.identify_languages(docs, profiles).collect()
    assert sorted(one) == sorted(language.identify_languages(docs, profiles, block=1).collect())


# phrases


def brute_phrases(rows, least, top=2000, longest=5):
    counts, totals = collections.defaultdict(collections.Counter), collections.Counter()
    for text, lang in rows:
        lang = lang if lang is not None else "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(FOLD)):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    counts[lang][tuple(words[i : i + k])] += 1
    out = []
    for lang, f in counts.items():
        candidates = {p: a for p, a in f.items() if a >= least and len(p) > 1}
        scored = []
        for p, a in candidates.items():
            if any(b >= a and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in candidates.items()):
                continue
            score, k = min((1000 * a * totals[lang] // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            scored.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, rank, p.decode(), -a, left, right, totals[lang], -score) for rank, (score, a, p, left, right) in enumerate(sorted(scored)[:top], 1)]
    return sorted(out)


@pytest.fixture(scope="module")
def said():
    rng = random.Random(3)
    names = ["alpha", "Beta", "gamma", "delta", "épsilon", "zeta", "x y"]
    rows = []
    for i in range(300):
        words = [rng.choice(names[: 3 + i % 5]) for _ in range(rng.randint(0, 40))]
        for _ in range(3):
            words.insert(rng.randrange(len(words) + 1), rng.choice(["New York City Hall", "new\tyork city", "stop. here", "one,two", "a\rb", "go go go go go go go"]))
        rows.append((" ".join(words), [None, "en", "fr"][i % 3]))
    return [*rows, (None, "en"), ("", "fr"), (". ; \n", None), (rows[0][0], rows[0][1])]


@pytest.mark.parametrize("share", [0.0, 0.02, 0.3, 1.0])
def test_phrases_are_those_of_brute_force_whatever_the_sample(spark, said, share):
    docs = spark.createDataFrame([(i, *r, 1, 2) for i, r in enumerate(said)], "doc_id long, text string, lang string, n long, phrase long").repartition(4)
    found = phrases.mine_phrases(docs, least=25, share=share, filter_bits=1 << 16)
    assert sorted(tuple(r) for r in found.collect()) == brute_phrases(said, 25)


def test_a_full_filter_only_costs_time(spark, said):
    docs = spark.createDataFrame(said, "text string, lang string")
    assert sorted(tuple(r) for r in phrases.mine_phrases(docs, least=25, top=7, filter_bits=64).collect()) == brute_phrases(said, 25, top=7)


def test_long_texts_and_pieces_without_end(spark, said, monkeypatch):
    whole = [("\n".join(t for t, lang in said if t), "en"), (" ".join(["round", "and", "about"] * 3000), "en")]
    expected = brute_phrases(whole, 25)
    monkeypatch.setattr(phrases, "_SEGMENT", 500)
    assert all(len(part) for part in phrases.segments([whole[0][0]]))
    assert [w for part in phrases.segments([t for t, _ in whole]) for w in part if w != b"."] == [w.encode() for t, _ in whole for w in re.findall(r"[^\x20\x09\n]+", re.sub(r"[.,;:!?\x0A-\x0D]", "\n", t.translate(FOLD)))]
    monkeypatch.undo()
    assert sorted(tuple(r) for r in phrases.mine_phrases(spark.createDataFrame(whole, "text string, lang string"), least=25).collect()) == expected


def test_stops_stay_stops_when_the_memory_of_words_is_emptied():
    known = phrases.PieceHash()
    known.limit = 3
    words = [w for i in range(20) for w in (f"w{i}".encode(), b".")]
    assert [k == 0 for k in phrases.word_keys(words, known, "en").tolist()] == [w == b"." for w in words]


def test_no_phrases(spark):
    empty = spark.createDataFrame([], "text string, lang string")
    assert phrases.mine_phrases(empty).collect() == []
    assert phrases.mine_phrases(spark.createDataFrame([("a b c", "en"), (None, None)], "text string, lang string")).collect() == []


def test_scores_pass_64_bits(spark):
    n = 3_000_000_000
    rows = spark.createDataFrame([(n, n, n, 10 * n)], "a long, l long, r long, total long")
    assert rows.select(phrases.surplus().alias("s")).first()["s"] == 1000 * n * 10 * n // (n * n)
    rows = spark.createDataFrame([(10**13, 10**13 + 7, 10**13 + 9, 10**15)], "a long, l long, r long, total long")
    assert rows.select(phrases.surplus().alias("s")).first()["s"] == 1000 * 10**13 * 10**15 // ((10**13 + 7) * (10**13 + 9))


# hard negatives


def brute_negatives(rows, every=100, positives=5, negatives_=5):
    good = {}
    size = collections.Counter(len(v) for *_, v in rows if v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v)).most_common(1)
    for i, label, v in sorted((r for r in rows if None not in r[:2] and r[2] is not None and r[2] and all(x is not None and math.isfinite(x) for x in r[2])), key=lambda r: (r[1], r[2])):
        if len(v) == size[0][0]:
            good.setdefault(i, (label, [math.floor(256 * x) for x in v]))
    out = []
    for a, (label, v) in good.items():
        if a % every:
            continue
        scores = {i: sum(x * y for x, y in zip(v, w)) for i, (_, w) in good.items() if i != a}
        order = sorted(scores, key=lambda i: (-scores[i], i))
        for p in [i for i in order if good[i][0] == label][:positives]:
            fit = [i for i in order if good[i][0] != label and 80 * scores[p] <= 100 * scores[i] <= 100 * scores[p]]
            clip = lambda s: max(-(2**63 - 1), min(2**63 - 1, s))
            out += [(a, p, rank, i, clip(scores[p]), clip(scores[i])) for rank, i in enumerate(fit[:negatives_], 1)]
    return sorted(out)


SCHEMA = "vec_id long, label int, embedding array<float>"


def single(x):
    return float(np.float32(x))


@pytest.mark.parametrize("kind", ["gauss", "ties", "near", "small"])
def test_negatives_are_those_of_brute_force(spark, kind):
    rng = random.Random(kind)
    draw = {"gauss": lambda: single(rng.gauss(0, 1)), "ties": lambda: rng.choice([0.0, 0.5, -0.5]), "near": lambda: single(1 + rng.gauss(0, 0.05)), "small": lambda: single(rng.gauss(0, 0.003))}[kind]
    rows = [(i, rng.randrange(4), [draw() for _ in range(6)]) for i in range(0, 3000, 5)]
    rows += [(7000, None, [1.0] * 6), (7100, 1, None), (7200, 1, [1.0, None] * 3), (7300, 1, [float("nan")] * 6), (7400, 1, [float("inf")] * 6), (7500, 1, [0.0] * 6), (7600, 1, [1.0] * 5), (100, 3, [9.0] * 6), (None, 1, [1.0] * 6), rows[3], (7700, 2, [])]
    table = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA + ", ask int, part string").repartition(3)
    expected = brute_negatives(rows)
    assert sorted(tuple(r) for r in negatives.hard_negatives(table, clusters=3).collect()) == expected
    assert sorted(tuple(r) for r in negatives.hard_negatives(table, clusters=50, block_rows=100, anchor_rows=2).collect()) == expected


def test_scores_of_any_size_are_compared_exactly(spark):
    rng = random.Random(9)
    rows = [(i, rng.randrange(2), [rng.choice([-1, 1, 1, 1]) * single(rng.choice([1e18, 3e18, 1e19, 1e37]) * rng.random()) for _ in range(4)]) for i in range(0, 300, 4)]
    assert sorted(tuple(r) for r in negatives.hard_negatives(spark.createDataFrame(rows, SCHEMA)).collect()) == brute_negatives(rows)


def test_lists_end_where_the_bound_certifies_it():
    rng = np.random.default_rng(0)
    centres = np.eye(16)[:4]
    rows = np.floor(256 * (3 * centres[rng.integers(0, 4, 20_000)] + rng.normal(0, 0.1, (20_000, 16))))
    lists = negatives.SharedLists(np.arange(20_000), np.zeros(20_000, int), rows, centres)
    anchor = np.floor(256 * 3 * centres[0])
    wanted = negatives.Wanted(5, [(-np.inf, np.inf)])
    lists.walk(*lists.of(0, 0.05), anchor, -1, wanted)
    scores = rows @ anchor
    assert wanted.best[0] == [(int(scores[i]), i) for i in np.lexsort((np.arange(20_000), -scores))[:5].tolist()]
    assert lists.walked < 10_000


def test_few_rows(spark):
    assert negatives.hard_negatives(spark.createDataFrame([], SCHEMA)).collect() == []
    assert negatives.hard_negatives(spark.createDataFrame([(100, 1, [1.0, 2.0])], SCHEMA)).collect() == []
    assert negatives.hard_negatives(spark.createDataFrame([(1, 1, [1.0]), (2, 2, [1.0])], SCHEMA)).collect() == []
    assert [tuple(r) for r in negatives.hard_negatives(spark.createDataFrame([(0, 1, [1.0]), (1, 1, [1.0]), (2, 2, [0.9])], SCHEMA)).collect()] == [(0, 1, 1, 2, 65536, 58880)]


@pytest.mark.parametrize("name", ["op11_language_id", "op12_phrases", "op13_hard_negatives"])
def test_queries_equal_their_sql(spark, name):
    folder = "/root/testdata/sf0.01"
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    found = queries.queries()[name](spark, folder)
    cursor = con.execute(oracles.oracle_sql()[name])
    order = [[d[0] for d in cursor.description].index(c) for c in found.columns]
    assert sorted(tuple(r) for r in found.collect()) == sorted(tuple(r[i] for i in order) for r in cursor.fetchall())
