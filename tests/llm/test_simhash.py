import random
import re

import numpy as np
import pytest
import xxhash

from tempora.llm import simhash

from tests.llm.conftest import ODD


def slow_fingerprint(text, n=3):
    words = re.findall("[^\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[i : i + n]) for i in range(len(words) - n + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(ids, prints, radius=3):
    roots = list(ids)
    while True:
        new = [min(r for p, r in zip(prints, roots) if (p ^ q).bit_count() <= radius) for q in prints]
        if new == roots:
            return roots
        roots = new


def slow_shingles(text, n=5):
    words = re.findall("[^\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} or ({tuple(words)} if words else set())


def slow_mixed(h, k):
    full = (1 << 64) - 1
    if k:
        h ^= k * 0x9E3779B97F4A7C15 & full
        h = (h ^ h >> 30) * 0xBF58476D1CE4E5B9 & full
        h = (h ^ h >> 27) * 0x94D049BB133111EB & full
        h ^= h >> 31
    return h


def all_near(ids, texts):
    """(gone, kept) of all pairs of similarity 0.8 or more, found by shared shingles and not by fingerprints."""
    sets = {i: slow_shingles(texts[i]) for i in ids}
    having, pairs = {}, set()
    for i in sorted(ids):
        others = {k for x in sets[i] for k in having.get(x, ())} if sets[i] else {k for k in having.get((), ())}
        pairs |= {(i, k) for k in others if len(sets[i] & sets[k]) >= 0.8 * len(sets[i] | sets[k])}
        for x in sets[i] or {()}:
            having.setdefault(x, []).append(i)
    return pairs


def slow_prints(text, words):
    own = re.findall("[^\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(own[i : i + words]) for i in range(len(own) - words + 1)] or ([" ".join(own)] if own else [])
    hashed = [xxhash.xxh64(x.encode(), seed=42).intdigest() for x in shingles]
    return [sum(1 << b for b in range(64) if 2 * sum(slow_mixed(h, k) >> b & 1 for h in hashed) > len(hashed)) for k in range(simhash.PRINTS)]


def slow_copies(ids, texts, radius, words):
    """Ids of documents with a near copy of smaller id whose set of shingles is the same, or one of whose fingerprints lies within the radius."""
    pairs = all_near(ids, texts)
    sets = {i: slow_shingles(texts[i]) for i in {x for p in pairs for x in p}}
    prints = {i: slow_prints(texts[i], words) for i in sets}
    return {i for i, k in pairs if sets[i] == sets[k] or any((p ^ q).bit_count() <= radius for p, q in zip(prints[i], prints[k], strict=True))}


def test_near_copies_are_compared(spark, monkeypatch):
    """Dense groups in which many links are no near copies, over several rounds and parts of buckets, with texts that share a fingerprint."""
    rng = random.Random(4)
    texts = {}
    for base in range(6):
        words = [f"w{rng.randrange(9000)}" for _ in range(80)]
        for _ in range(30):
            own = list(words)
            for _ in range(rng.choice([0, 1, 2, 5, 9])):
                own[rng.randrange(80)] = f"x{rng.randrange(9000)}"
            texts[rng.randrange(1 << 40)] = " ".join(own)
    texts |= {1: "", 2: " ", 3: "Same Words here", 4: "same words HERE"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    want = set(texts) - slow_copies(list(texts), texts, 16, 1)
    assert 12 < len(want) < 170
    monkeypatch.setattr(simhash, "LINKS_A_ROUND", 3)
    monkeypatch.setattr(simhash, "LINKS_A_PART", 2)
    for rows, held in ((1 << 16, 1 << 18), (40, 5)):
        monkeypatch.setattr(simhash, "TASK_ROWS", rows)
        monkeypatch.setattr(simhash, "HELD_LINKS", held)
        assert {r["doc_id"] for r in simhash.unlike(docs, 16, 1).collect()} == want


def test_links_between_equal_fingerprints_count(spark):
    """Of three texts of one fingerprint the third is like the second only, which goes because of the first; it goes as well."""
    rng = random.Random(21)
    words = [f"w{rng.randrange(9000)}" for _ in range(60)]
    second = [*words[:55], *(f"y{i}" for i in range(5))]
    third = [*(f"z{i}" for i in range(5)), *second[5:]]
    texts = {1: " ".join(words), 2: " ".join(second), 3: " ".join(third)}
    pairs = all_near(texts, texts)
    assert (2, 1) in pairs and (3, 2) in pairs and (3, 1) not in pairs
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert [r["doc_id"] for r in simhash.unlike(docs, 64, 1).collect()] == [1]


def test_most_near_copies_are_linked(spark):
    """Recall over all pairs of similarity 0.8 or more of the tables of sf0.1, and of copies with random changes, with the pipeline's fingerprints."""
    import corpus_pipeline

    rng = random.Random(2)
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet("/root/testdata/sf0.1/documents.parquet").collect()}
    for n in (40, 150, 600, 2500):
        for _ in range(25):
            words = [f"w{int(rng.paretovariate(0.7)) % 5000}" for _ in range(n)]
            own = list(words)
            for i in rng.sample(range(n), max(1, n // 55)):
                own[i] = f"x{rng.randrange(5000)}"
            texts |= {len(texts) + (1 << 30): " ".join(words), len(texts) + (1 << 30) + 1: " ".join(own)}
    firsts = {}
    for i in sorted(texts):
        firsts.setdefault(" ".join(sorted(map(str, slow_shingles(texts[i])))) if len(texts[i]) < 200 else texts[i], i)
    ids = sorted(firsts.values())
    pairs = [(i, k) for i, k in near_by_prefix(ids, texts) if slow_shingles(texts[i]) != slow_shingles(texts[k])]
    own_ids = sorted({x for p in pairs for x in p})
    prints = simhash.majorities([simhash.hashes(texts[i], corpus_pipeline.SHINGLE_WORDS) for i in own_ids], simhash.PRINTS)
    of = dict(zip(own_ids, zip(*prints, strict=True), strict=True))
    linked = [any(int(p ^ q).bit_count() <= corpus_pipeline.RADIUS for p, q in zip(of[i], of[k], strict=True)) for i, k in pairs]
    assert len(pairs) > 100 and sum(linked) / len(pairs) >= 0.95


def near_by_prefix(ids, texts, similarity=0.8):
    """All pairs of this similarity: each shares one of its rarest shingles, as many as may be missing and one more."""
    sets = {i: set(simhash.hashes(texts[i], 5)) for i in ids}
    often, having = {}, {}
    for own in sets.values():
        for x in own:
            often[x] = often.get(x, 0) + 1
    for i in sorted(ids):
        own = sorted(sets[i], key=lambda x: (often[x], x))
        rare = [x for x in own[: len(own) - -(-8 * len(own) // 10) + 1] if often[x] > 1]
        for k in sorted({k for x in rare for k in having.get(x, ())}):
            if len(sets[i] & sets[k]) >= similarity * len(sets[i] | sets[k]):
                yield i, k
        for x in rare:
            having.setdefault(x, []).append(i)


def test_sketches_lose_no_near_copy():
    """Whatever pair has the similarity may have it by its sketches, and most other pairs may not."""
    rng = random.Random(12)
    texts = [t or "" for _, t, _ in ODD]
    for n in (3, 30, 300, 900, 5_000):
        words = [f"w{rng.randrange(n)}" for _ in range(n)]
        for changed in (0, 1, n // 200, n // 60, n // 20, n):
            own = list(words)
            for i in rng.sample(range(n), changed):
                own[i] = f"x{rng.randrange(n)}"
            texts.append(" ".join(own))
    sketches = simhash.sketches(texts, 5)
    sets = [slow_shingles(t) for t in texts]
    a, b = (np.array(x) for x in zip(*[(i, j) for i in range(len(texts)) for j in range(i)]))
    alike = np.array([len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) for i, j in zip(a, b)])
    may_be = simhash.may_be_alike(sketches[a], sketches[b], 0.8)
    assert sketches[:, 0].tolist() == [len(s) for s in sets]
    assert may_be[alike].all() and alike.sum() > 20 and may_be[~alike].mean() < 0.1


def test_odd_rows_are_compared(odd, nothing):
    assert simhash.unlike(nothing).count() == 0
    rows = simhash.unlike(odd)
    assert rows.columns == odd.columns
    assert sorted([r["doc_id"] for r in rows.collect()], key=str) == [1, 1, 2, 5, 6, 7, 8, None, None]


def test_fingerprints_of_odd_texts():
    texts = [t or "" for _, t, _ in ODD] + ["one", "one two", "one two three", "A b C d", "a b c d"]
    assert simhash.fingerprints(texts).tolist() == [slow_fingerprint(t) for t in texts]


def test_components_of_documents(documents):
    rows = simhash.near_duplicates(documents).orderBy("doc_id").collect()
    prints = [r["fingerprint"] & (1 << 64) - 1 for r in rows]
    assert [r["component_id"] for r in rows] == slow_components([r["doc_id"] for r in rows], prints)


def test_links_of_chosen_fingerprints(spark):
    """Chains, dense groups beyond a task's rows' tiles, and pairs at just three and four bits."""
    rng = random.Random(8)
    prints = {rng.getrandbits(64) for _ in range(300)}
    for p in list(prints)[:60]:
        q = p
        for _ in range(4):
            for b in rng.sample(range(64), rng.choice([1, 3, 4])):
                q ^= 1 << b
            prints.add(q)
    middle = rng.getrandbits(64)
    prints |= {middle ^ (1 << a) ^ (1 << b) for a in range(20) for b in range(20)}
    prints = sorted(prints)
    table = spark.createDataFrame([((p - (1 << 64) if p >> 63 else p),) for p in prints], "fingerprint long")
    want = slow_components(list(range(len(prints))), prints)
    for rows in (None, 1 << 34, 1 << 42):  # with more rows, more blocks
        roots = {r["node"] & (1 << 64) - 1: r["root"] for r in simhash.components(simhash.links(table, rows=rows)).collect()}
        got = {}
        for p, c in zip(prints, want):
            got.setdefault(c, set()).add(roots.get(p, p - (1 << 64) if p >> 63 else p))
        assert all(len(s) == 1 for s in got.values()) and len({next(iter(s)) for s in got.values()}) == len(got)


def test_a_bucket_of_many_rows_is_cut_into_tasks(spark, monkeypatch):
    monkeypatch.setattr(simhash, "TASK_ROWS", 16)
    rng = random.Random(3)
    base = rng.getrandbits(64)
    prints = sorted({base ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(150)})
    table = spark.createDataFrame([((p - (1 << 64) if p >> 63 else p),) for p in prints], "fingerprint long")
    roots = {r["node"]: r["root"] for r in simhash.components(simhash.links(table)).collect()}
    want = slow_components(list(range(len(prints))), prints)
    assert len(set(roots.values())) == len({c for c in want if want.count(c) > 1})


def joined_in_a_bucket(prints, radius=3):
    zeros = np.zeros(len(prints), np.int64)
    u, v, compared, skipped = simhash.stars(zeros, zeros, prints, radius)
    roots = dict(zip(u.tolist(), v.tolist()))
    groups = {}
    for p in prints.tolist():
        groups.setdefault(roots.get(p, p), set()).add(p)
    return {frozenset(g) for g in groups.values()}, compared, skipped


@pytest.mark.parametrize("tile", [1, 7, 64])
def test_skipping_tiles_loses_no_link(monkeypatch, tile):
    monkeypatch.setattr(simhash, "TILE_ROWS", tile)
    rng = np.random.default_rng(1)
    bit = lambda n: np.uint64(1) << rng.integers(0, 64, n, dtype=np.uint64)
    near = np.concatenate([b ^ bit(100) ^ bit(100) for b in rng.integers(0, 1 << 63, 3, dtype=np.uint64)])
    sparse = np.bitwise_or.reduce([bit(60), bit(60), bit(60)])
    prints = np.unique(np.concatenate([near, rng.integers(0, 1 << 63, 200, dtype=np.uint64), sparse, ~sparse]))
    want = {}
    for p, c in zip(prints.tolist(), slow_components(list(range(len(prints))), prints.tolist())):
        want.setdefault(c, set()).add(p)
    got, compared, skipped = joined_in_a_bucket(prints)
    tiles = -(-len(prints) // tile)
    assert got == {frozenset(g) for g in want.values()}
    assert compared + skipped == tiles * (tiles + 1) // 2 and skipped > compared / 4


def test_every_pair_meets_in_a_bucket():
    """Whatever the number of rows, two fingerprints within the radius agree in the bits of some choice."""
    rng = random.Random(5)
    for rows in (0, 100, 5_000, 1 << 20, 1 << 30, 1 << 38):
        for radius in (0, 1, 3, 5):
            masks = simhash.bucket_masks(rows, radius)
            for _ in range(200):
                p = rng.getrandbits(64)
                q = p
                for b in rng.sample(range(64), radius):
                    q ^= 1 << b
                assert any(p & m == q & m for m in masks)


def test_all_comparisons_are_those_of_tiles(documents):
    found = simhash.tile_counts(documents).first()
    prints = simhash.fingerprint(documents).select("fingerprint").distinct().count()
    choices = len(simhash.bucket_masks(prints, simhash.RADIUS))
    assert found["skipped"] > 0 and 0 < found["compared"] <= choices * (prints // simhash.TILE_ROWS + 1) ** 2


def test_hot_fingerprints_are_joined_apart(documents, monkeypatch):
    from tempora.llm import common

    want = sorted(map(tuple, simhash.near_duplicates(documents).collect()))
    monkeypatch.setattr(common, "HOT_ROWS", 2)
    assert sorted(map(tuple, simhash.near_duplicates(documents).collect())) == want


@pytest.mark.parametrize("words", [1, 2, 5])
def test_shingles_of_other_lengths(words):
    texts = [t or "" for _, t, _ in ODD] + ["a b c d e f g"]
    assert simhash.fingerprints(texts, words).tolist() == [slow_fingerprint(t, words) for t in texts]


def test_odd_rows_and_empty_table(odd, nothing):
    rows = simhash.near_duplicates(odd).collect()
    assert len(rows) == len(ODD)
    empty = [r for r in rows if r["fingerprint"] == 0]
    assert {r["component_id"] for r in empty} == {2} and len(empty) == 4
    assert simhash.near_duplicates(nothing).count() == 0
    left = simhash.representatives(odd)
    assert left.columns == odd.columns and {r["doc_id"] for r in left.collect()} >= {1, 2, None}
    assert simhash.representatives(nothing).count() == 0


def test_long_chain_takes_few_rounds(spark):
    n = 400
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)], "u long, v long")
    found = simhash.components(edges).collect()
    assert len(found) == n + 1 and len({r["root"] for r in found}) == 1
