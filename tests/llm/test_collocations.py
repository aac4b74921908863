"""Phrases against counts by brute force, however suffixes are dealt; odd rows."""

import itertools
import random
import re
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from tempora.llm import collocations as c
from tests.llm.conftest import ODD

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def pieces_of(rows):
    for text, lang in rows:
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            yield "und" if lang is None else lang, [w for w in re.split("[ \t]+", piece) if w]


def brute(rows, max_words, min_count, top, covered):
    count, total = Counter(), Counter()
    for lang, words in pieces_of(rows):
        total[lang] += len(words)
        for i in range(len(words)):
            for k in range(1, max_words + 1):
                if i + k <= len(words):
                    count[lang, tuple(words[i : i + k])] += 1
    candidates = {k: n for k, n in count.items() if len(k[1]) > 1 and n >= min_count}
    gone = set()
    for (lang, words), n in candidates.items():
        for i, j in itertools.combinations(range(len(words) + 1), 2):
            part = (lang, words[i:j])
            if part in candidates and j - i < len(words) and 100 * n >= covered * candidates[part]:
                gone.add(part)
    rows = {}
    for (lang, words), a in candidates.items():
        if (lang, words) not in gone:
            cuts = [(1000 * a * total[lang] // (count[lang, words[:k]] * count[lang, words[k:]]), k) for k in range(1, len(words))]
            score, k = min(cuts)
            rows.setdefault(lang, []).append((-score, -a, " ".join(words).encode(), count[lang, words[:k]], count[lang, words[k:]]))
    return sorted((lang, i + 1, p.decode(), -a, lo, r, total[lang], -s) for lang, own in rows.items() for i, (s, a, p, lo, r) in enumerate(sorted(own)[:top]))


def documents_of(seed, n=60):
    pick = random.Random(seed)
    words = ["A", "b", "the", "of", "é", "b\x01", "b\"c", "日本", "\x1c", "A-b", "ſ"]
    odd = [None, "", " \t ", ".,;", "the", "A\tb  a.b"]
    texts = ["".join(pick.choice(words) + pick.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\x0b"]) for _ in range(pick.randint(1, 80))) for _ in range(n)]
    rows = [(t, pick.choice(["en", "en", "de", None, ""])) for t in texts + odd]
    return rows + rows[:5] + [("the of the of the", "en")] * 20


def collected(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize(("seed", "max_words", "min_count", "top", "covered"), [(0, 5, 3, 2000, 100), (1, 5, 2, 7, 60), (2, 3, 4, 2000, 100), (3, 2, 1, 50, 100)])
def test_brute_force(spark, seed, max_words, min_count, top, covered):
    rows = documents_of(seed)
    docs = spark.createDataFrame(rows, "text string, lang string").repartition(3)
    assert collected(c.collocations(docs, max_words, min_count, top, covered)) == brute(rows, max_words, min_count, top, covered)


def test_first_words_dealt_over_several_tasks_and_held_in_small_parts(spark, monkeypatch):
    rows = documents_of(4)
    docs = spark.createDataFrame(rows, "text string, lang string").repartition(4)
    want = brute(rows, 5, 3, 2000, 100)
    table = spark.createDataFrame([("en", w, n) for w, n in (("the", 500), ("of", 90), ("x", 10))], "lang string, phrase string, n long")
    assert c.full_keys(table, ["lang", "phrase"], 37) == {("en", "the"): 500 // 37 + 1, ("en", "of"): 90 // 37 + 1}
    for words, pairs in ((3, 1), (3, 4), (1, 3)):
        monkeypatch.setattr(c, "full_keys", lambda counts, keys, fill, over=(words, pairs): {tuple(r[k] for k in keys): over[keys == ["pair"]] for r in counts.collect()})
        assert collected(c.collocations(docs, 5, 3)) == want


def test_hashes_of_words_are_those_of_their_bytes_wherever_they_stand():
    words = [b"", b"a", b"aa", b"ab", b"ba", bytes([255] * 40), b"a", "日本".encode(), b"\x00", b"\x00\x00"]
    got = c.byte_hashes(pa.array(words, pa.binary()))
    again = c.byte_hashes(pa.array([b"xyz", *words[::-1]], pa.binary()))[1:][::-1]
    assert (got == again).all() and len(set(got.tolist())) == len(set(words))
    assert (c.byte_hashes(pa.array(words, pa.binary())[3:]) == got[3:]).all()


def test_buckets_of_triples_hold_what_is_frequent(spark):
    rows = [("a b c d", "en")] * 6 + [("x y z", "en")] * 3
    texts = c.spoken(spark.createDataFrame(rows, "text string, lang string").repartition(3))
    every = np.full(16, 2**64 - 1, np.uint64)
    for least, found in ((3, 3), (4, 2), (7, 0), (300, 0)):
        assert int(np.bitwise_count(c.frequent_triples(texts, every, least)).sum()) == found


def test_what_is_sent_follows_the_frequent_phrases_and_not_the_partitions(spark):
    """Each task sends what is frequent, and it is in every partition. A suffix goes no further than a frequent run, though all its triples are frequent."""
    tasks = c.TASKS_A_CORE * spark.sparkContext.defaultParallelism
    rows = [("a b c. b c d. b c", "en")] * (6 * tasks) + [("a b c d", "en")]
    texts = c.spoken(spark.createDataFrame(rows, "text string, lang string").repartition(3 * tasks))
    pairs = c.words_and_pairs(texts).where("pair is not null").groupBy("pair").agg({"n": "sum"}).where("sum(n) > 5")
    known = c.bitmap(pairs, "pair", 3)
    runs = c.frequent_triples(texts, known, 5, 5)
    sent = c.suffixes(texts, known, runs, 5, {}, {}).select("suffix", "n").collect()
    total = Counter()
    for r in sent:
        total[r["suffix"]] += r["n"]
    n = 6 * tasks
    assert total == {"a b c ": n + 1, "b c d ": n + 1, "b c ": 2 * n, "c d ": n + 1}
    assert len(sent) <= 4 * tasks


def test_sums_hold_what_comes_most_often():
    sums, gone = c.Sums(["pair"], 8), []
    for k in range(20):
        gone += sums.add(pa.table({"pair": pa.array([-1, *range(6 * k, 6 * k + 6)], pa.int64()), "n": pa.array([3] + [1] * 6, pa.int64())}))
    out = [(r["pair"], r["n"]) for b in [*gone, *sums.rest()] for r in b.to_pylist()]
    assert [n for pair, n in out if pair == -1] == [60] and sorted(out) == [(-1, 60), *[(k, 1) for k in range(120)]]


def test_every_prefix_is_counted_once_by_the_stack():
    suffixes = Counter({("de", "a b "): 1, ("en", "a b c "): 2, ("en", "a b\x01 "): 4, ("en", "a b "): 8, ("en", "b c "): 3})
    rows = sorted(((lang, s, n, True) for (lang, s), n in suffixes.items()), key=lambda r: (r[0], [-b for b in r[1].encode()] + [1]))
    assert sorted(c.prefixes(iter(rows), 1)) == [("de", "a b", 2, 1), ("en", "a b", 2, 10), ("en", "a b\x01", 2, 4), ("en", "a b c", 3, 2), ("en", "b c", 2, 3)]
    assert sorted(c.prefixes(iter(rows), 4)) == [("en", "a b", 2, 10), ("en", "a b\x01", 2, 4)]


def test_a_full_bitmap_lets_everything_through_and_changes_nothing(spark, monkeypatch):
    rows = documents_of(5)
    docs = spark.createDataFrame(rows, "text string, lang string")
    monkeypatch.setattr(c, "TRIPLE_BUCKETS", 64)
    assert collected(c.collocations(docs, 5, 3)) == brute(rows, 5, 3, 2000, 100)
    monkeypatch.setattr(c, "bitmap", lambda keys, key, n: np.full(16, 2**64 - 1, np.uint64))
    assert collected(c.collocations(docs, 5, 3)) == brute(rows, 5, 3, 2000, 100)


def test_counts_that_pass_64_bits(spark):
    big = 10**12
    found = spark.createDataFrame([("en", "a b", 2, big), ("en", "a", 1, 3 * big), ("en", "b", 1, big + 7)], "lang string, phrase string, words int, n long")
    totals = spark.createDataFrame([("en", 10**14)], "lang string, n long")
    row = c.scored(found, totals).first()
    assert (row["l"], row["r"], row["score"]) == (3 * big, big + 7, 1000 * big * 10**14 // (3 * big * (big + 7)))


def test_odd_rows_empty_tables_and_other_columns(spark, odd, nothing):
    rows = [("Hello world", None)] * 3
    clashing = spark.createDataFrame([(t, x, 1, 2, 3) for t, x in rows], "text string, lang string, phrase int, n int, words int")
    assert collected(c.collocations(clashing, min_count=3)) == [("und", 1, "hello world", 3, 3, 3, 6, 2000)]
    assert c.collocations(nothing.withColumn("lang", nothing["line"])).count() == 0
    got = collected(c.collocations(odd.withColumn("lang", odd["line"]), min_count=2000))
    long = [(t, x) for _, t, x in ODD]
    assert got == brute(long, 5, 2000, 2000, 100) and got


def test_few_rare_pairs_pass_for_frequent(spark):
    """What a task sends would otherwise be mostly suffixes of rare pairs, the more so the larger the corpus is."""
    rng = np.random.default_rng(3)
    words = c.Words([" ".join(f"w{x}" for x in rng.integers(0, 50_000, 600_000).tolist())], ["en"])
    at, pair = words.pairs()
    frequent = np.unique(pair)[::10]
    keys = spark.createDataFrame(pd.DataFrame({"pair": frequent.view(np.int64)}))
    joined = words.joined(c.bitmap(keys, "pair", len(frequent)))[0][at]
    true = np.isin(pair, frequent)
    assert len(frequent) > 59_000 and joined[true].all() and joined[~true].mean() < 0.002
