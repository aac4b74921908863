import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from tempora.llm import toxicity

from tests.llm.conftest import ODD


def labelled(spark, n=900, seed=1):
    """Invented prose; a third of it has insults or their inflections, some of them disguised."""
    rng = random.Random(seed)
    words = ["".join(rng.choices("abdehilmnorstu", k=rng.randint(2, 8))) for _ in range(400)]
    insults = ["grobnik", "zwarfel", "plomtus"]
    rows = []
    for i in range(n):
        text, toxic = rng.choices(words, k=rng.randint(30, 120)), int(i % 3 == 0)
        if toxic:
            for _ in range(rng.randint(1, 6)):
                bad = rng.choice(insults) + rng.choice(["", "s", "er", "ino"])
                text.insert(rng.randrange(len(text)), rng.choice([bad, bad.upper(), "you " + bad, bad.replace("o", "0")]))
        rows.append((i, " ".join(text), toxic))
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    return docs, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int"), {i: y for i, _, y in rows}


def test_held_out_accuracy(spark):
    docs, labels, truth = labelled(spark)
    model = toxicity.fit(docs, labels)
    held = {i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0}
    scores = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    assert held and np.mean([(scores[i] >= 0.5) == truth[i] for i in held]) > 0.95
    assert all(0 <= s <= 1 for s in scores.values())
    assert {r["doc_id"] for r in toxicity.reject(docs, model).collect()} == {i for i, s in scores.items() if s < 0.5}


def test_held_out_labels_change_nothing(spark):
    docs, labels, _ = labelled(spark, 300)
    flipped = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (dict(map(tuple, toxicity.score(docs, toxicity.fit(docs, x)).collect())) for x in (labels, flipped))
    assert a == b


def slow_features(lexicon, text):
    """The features from their definition, chunk by chunk and word by word, without caches or arrays."""
    s, codes = toxicity.Scanner(lexicon), []
    flag = toxicity.LEXICON | toxicity.STEM | toxicity.HIDDEN
    for chunk in text.split():
        codes += np.frombuffer(s.word_codes(chunk), np.uint16).tolist()
    hits = [i for i, c in enumerate(codes) if c & flag]
    second = [i for i, c in enumerate(codes) if c & toxicity.SECOND]
    near = sum(any(abs(i - j) <= toxicity.NEAR_WORDS for j in second) for i in hits)
    weights, n, data = [codes[i] >> toxicity.WEIGHT_SHIFT for i in hits], max(1, len(codes)), text.encode()
    share = lambda f: sum(bool(c & f) for c in codes) / n
    of = lambda chars: sum(data.count(c.encode()) for c in chars) / max(1, len(data))
    return [np.log1p(len(codes)), share(toxicity.LEXICON), share(toxicity.STEM), sum(weights) / n, np.log1p(len(hits)), max(weights, default=0), near / n, len(second) / n, share(toxicity.HIDDEN), share(toxicity.OBFUSCATED), share(toxicity.CAPITALS), of("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), of("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"), of("!"), of("0123456789"), len(hits) / n]


def slow_tree(x, grad, hess, edges, depth, least):
    """One tree, each split found by summing up both sides of every cut: nested tuples of feature, cut and the two sides, or a value."""
    if depth == 0 or not len(x):
        return grad.sum() / (hess.sum() + least)
    best = (1e-6, None)
    for j, e in enumerate(edges):
        for cut in e:
            left = x[:, j] <= cut
            hl, hr = hess[left].sum(), hess[~left].sum()
            if hl < 0.1 or hr < 0.1:
                continue
            gain = grad[left].sum() ** 2 / (hl + least) + grad[~left].sum() ** 2 / (hr + least) - grad.sum() ** 2 / (hess.sum() + least)
            if gain > best[0] + 1e-9:
                best = (gain, (j, cut))
    if best[1] is None:
        return slow_tree(x, grad, hess, edges, 0, least)
    j, cut = best[1]
    left = x[:, j] <= cut
    return (j, cut, slow_tree(x[left], grad[left], hess[left], edges, depth - 1, least), slow_tree(x[~left], grad[~left], hess[~left], edges, depth - 1, least))


def fall(tree, row):
    while isinstance(tree, tuple):
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree


def test_trees_equal_slowly_grown_ones():
    rng = np.random.default_rng(3)
    x = rng.random((300, 4))
    y = (x[:, 0] + 0.3 * x[:, 1] * (x[:, 2] > 0.4) + 0.2 * rng.random(300) > 0.7).astype(float)
    model = toxicity.Trees.fit(x, y, rounds=4, bins=8)
    edges = [sorted({*np.quantile(f, np.linspace(0, 1, 9)[1:-1]).tolist(), *(np.quantile(f[f > 0], np.linspace(0, 1, 9)[:-1]) - 1e-12).tolist()}) for f in x.T]
    raw = np.full(300, np.log(y.mean() / (1 - y.mean())))
    for _ in range(4):
        p = 1 / (1 + np.exp(-raw))
        tree = slow_tree(x, y - p, np.maximum(p * (1 - p), 1e-6), edges, 3, 1.0)
        raw = raw + 0.2 * np.array([fall(tree, row) for row in x])
    assert np.allclose(model.raw(x), raw)


def test_op7_scores_by_brute_force(spark, sf, documents):
    """Every score from the slow features, the nodes of the trees one by one, and a straight line between the knots."""
    model = toxicity.fit(documents, spark.read.parquet(f"{sf}/labels.parquet"))
    got = {r["doc_id"]: r for r in toxicity.op7(spark, sf).collect()}
    texts = {r["doc_id"]: r["text"] for r in documents.collect()}
    assert got.keys() == texts.keys()
    for i, text in texts.items():
        x, raw = slow_features(model.lexicon, text), 0.0
        if model.trees is None:
            want = model.share
        else:
            raw = model.trees.base
            for feature, cut, value in model.trees.trees:
                node = 0
                while node < len(feature):
                    node = 2 * node + 1 + int(x[feature[node]] > cut[node])
                raw += model.trees.rate * value[node - len(feature)]
            k, v = model.knots, model.values
            at = int(np.searchsorted(k, raw))
            want = v[0] if at == 0 else v[-1] if at == len(k) else v[at - 1] + (v[at] - v[at - 1]) * (raw - k[at - 1]) / (k[at] - k[at - 1])
        assert abs(got[i]["score"] - min(1, max(0, want))) < 1e-9
        assert got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) and got[i]["predicted"] == int(got[i]["score"] >= 0.5)


def test_rows_without_an_id_are_not_held_out(odd):
    rows = odd.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held")).collect()
    assert all(r["held"] is (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)


def test_repeated_documents_count_once(spark):
    docs, labels, _ = labelled(spark, 300)
    a, b = (toxicity.fit(x, labels) for x in (docs, docs.unionByName(docs)))
    assert a.lexicon == b.lexicon and (a.knots == b.knots).all()
    assert len(toxicity.fit(docs, labels, lexicon_terms=3).lexicon) == 3


def test_odd_rows_and_few_labels(spark, odd, nothing):
    few = toxicity.fit(odd, spark.createDataFrame([(1, 1), (1, 1), (2, 0), (3, None), (None, 1), (5, 0), (5, 1)], "doc_id long, toxic int"), holdout=False)
    assert few.trees is None
    rows = toxicity.score(odd, few).collect()
    assert len(rows) == len(ODD) and len({r["score"] for r in rows}) == 1
    docs, labels, _ = labelled(spark, 300)
    model = toxicity.fit(docs, labels)
    assert toxicity.score(odd, model).count() == len(ODD)
    assert toxicity.score(nothing, model).count() == 0
    assert toxicity.reject(odd, model).columns == odd.columns
    none = toxicity.fit(nothing, spark.createDataFrame([], "doc_id long, toxic int"))
    assert none.trees is None and none.share == 0


def test_isotonic_rises_and_pools():
    knots, values = toxicity.isotonic(np.array([0.1, 0.2, 0.3, 0.4, 0.5]), np.array([0.0, 1.0, 0.0, 1.0, 1.0]))
    assert (np.diff(values) > 0).all() and (np.diff(knots) > 0).all()
    assert abs(values[1] - 0.5) < 0.01


def test_trees_fit_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.random((2000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = toxicity.Trees.fit(x[:1500], y[:1500])
    assert (((model.raw(x[1500:]) > 0) == y[1500:]).mean()) > 0.95


def test_codes():
    s = toxicity.Scanner({"idiot": 6.0, "grobn*": 4.0})
    assert s.code("Idiot!") & toxicity.LEXICON and s.code("grobniks") & toxicity.STEM
    assert s.code("1d1ot") & toxicity.OBFUSCATED or s.code("id10t") & toxicity.OBFUSCATED
    assert s.code("idi0t") & toxicity.HIDDEN and s.code("idiooot") & toxicity.HIDDEN
    assert s.code("you") & toxicity.SECOND and s.code("NO") == 0 and s.code("NOW") & toxicity.CAPITALS


def test_all_words_of_a_chunk_count():
    s = toxicity.Scanner({"idiot": 6.0, "grobn*": 4.0})
    x = dict(zip(toxicity.FEATURES, s.features(["well,you/idiot...grobniks-grobniks"])[0], strict=True))
    assert x["log_words"] == np.log1p(5) and x["lexicon"] == 1 / 5 and x["stems"] == 2 / 5
    assert x["log_hits"] == np.log1p(3) and x["strongest"] == 6 and x["second"] == 1 / 5 and x["near_second"] == 3 / 5
    for text in ("l'idiot", "hey,idi0t", "a—idiot", "\"so\":idiot"):
        assert s.features([text])[0][toxicity.FEATURES.index("log_hits")] > 0
    # A long text without white space counts as the same words with it.
    words = ["well", "idiot", "you"] * 1000
    assert (s.features(["/".join(words)])[0][:9] == s.features([" ".join(words)])[0][:9]).all()


def test_lexicon_is_learned_from_all_words_of_a_chunk(spark):
    rows = [(i, ("so,l'zwarfel" if i % 3 == 0 else "so,l'abend") + " hallo welt") for i in range(150)]
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i, _ in rows], "doc_id long, toxic int")
    assert "zwarfel" in toxicity.fit(spark.createDataFrame(rows, "doc_id long, text string"), labels).lexicon
