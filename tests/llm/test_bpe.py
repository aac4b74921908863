import hashlib
import itertools
import os
import random
import subprocess
import sys
from types import SimpleNamespace

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tempora.llm import bpe, token_counts
from tempora.llm.bpe import codec, default_vocabulary, encode_bytes
from tempora.llm.common import stage

from tests.llm.conftest import ODD

PATH = default_vocabulary()


def ours(texts):
    return [np.frombuffer(b, "<u4").tolist() for b in encode_bytes(PATH, texts)]


def theirs(library, text):
    return library.encode(text, add_special_tokens=False).ids


def test_equals_the_library_on_documents(documents, library):
    texts = [r["text"] for r in documents.select("text").collect()]
    assert ours(texts) == [theirs(library, t) for t in texts]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(codec="utf-8", categories=["L", "N", "P", "S", "M", "Z"]), st.sampled_from("ab 's<|>\n\x1c\x85\x00Σ")), max_size=40))
def test_equals_the_library_on_any_text(text):
    from tokenizers import Tokenizer

    library = test_equals_the_library_on_any_text.__dict__.setdefault("library", Tokenizer.from_file(PATH))
    import unicodedata

    if any(unicodedata.category(c) == "Cn" for c in text):
        return  # characters newer than one of the Unicode tables
    assert ours([text]) == [theirs(library, text)] == [codec(PATH).encode(text)]


def test_forced_cuts_lie_in_no_token():
    c = codec(PATH)
    tokens = {t.removesuffix(c.suffix) for t in c.tokens.values()} - set(c.added)
    seen = {p for t in tokens for p in itertools.pairwise(c.byte_of[x] for x in t if x in c.byte_of)}
    assert {tuple(p) for p in np.argwhere(c.joined).tolist()} == seen
    data = "zqxjé7".encode()
    for at in c.cuts([data]).get(0, []):
        assert (data[at - 1], data[at]) not in seen


def test_encode_and_decode(odd, library):
    rows = bpe.encode(odd, decoded=True).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["ids"]) for r in rows) == sorted((i is None, i or 0, theirs(library, t or "")) for i, t, _ in ODD)
    assert all(r["decoded"] == library.decode(r["ids"], skip_special_tokens=False) for r in rows)
    back = {r["doc_id"]: r["decoded"] for r in bpe.decode(bpe.encode(odd)).collect()}
    assert back[6] == next(r["decoded"] for r in rows if r["doc_id"] == 6)


def test_empty_table(nothing):
    assert bpe.encode(nothing, decoded=True).count() == 0
    assert token_counts.trees(nothing).count() == 0


def test_generations_are_bounded():
    g = bpe.Generations(lambda keys: [k.encode() for k in keys], 2000)
    for i in range(50):
        assert g.values([[f"k{i}", f"k{i + 1}"]]) == [[b"k%d" % i, b"k%d" % (i + 1)]]
    assert len(g.young) <= 12 and len(g.old) <= 12
    long = "y" * 100
    assert g.values([[long, "z"]]) == [[long.encode(), b"z"]] and long in g.young
    g.values([["w"]])
    assert long not in g.young and "z" in g.young or "z" in g.old


def test_each_different_chunk_is_looked_up_once(monkeypatch):
    asked = []

    class Known(dict):
        def __getitem__(self, key):
            asked.append(key)
            return np.array([len(key), 7], "<u4").tobytes()

    monkeypatch.setattr(bpe, "chunk_cache", lambda path, limit: SimpleNamespace(holding=lambda keys: Known()))
    assert ours(["a bb a " * 1000, "", " \n", "bb\tccc\xa0a"]) == [[1, 7, 2, 7, 1, 7] * 1000, [], [], [2, 7, 3, 7, 1, 7]]
    assert sorted(asked) == ["a", "bb", "ccc"]


def test_all_white_space_parts_chunks(library):
    white = [x for x in map(chr, range(0x110000)) if x.isspace() or bpe._WHITE.fullmatch(x)]
    texts = [t for x in white for t in (f"a{x}b", x, f"é{x}{x}A!", f"{x}日")]
    assert len(white) == 29 and ours(texts) == [theirs(library, t) for t in texts]


def test_counts_follow_edits(library):
    rng = random.Random(5)
    parts = ["a", "b ", " ", "'s", "é", "́", " \n", "\x1c", "12", ".", "<|endoftext|>", "Σ", "x y", "日", ""]
    for _ in range(300):
        text = "".join(rng.choices(parts, k=rng.randint(0, 14)))
        tree = token_counts.SegmentTree.of(PATH, text)
        for _ in range(6):
            a, new = rng.randint(-1, len(text) + 1), "".join(rng.choices(parts, k=rng.randint(0, 3)))
            b = a + rng.randint(0, 5)
            tree.edit(a, b, new)
            a = min(max(0, a), len(text))
            text = text[:a] + new + text[min(max(a, b), len(text)) :]
            assert tree.text() == text and tree.tokens == len(theirs(library, text))


def test_only_touched_leaves_are_encoded(spark, odd, library):
    stored = stage(token_counts.trees(odd), "trees")
    rows = {r["doc_id"]: r for r in token_counts.apply(token_counts.revision(stored)).collect()}
    assert rows[5]["n_leaves"] == 36_000 and rows[5]["encoded_leaves"] < 20
    edits = spark.createDataFrame([(1, 2, 0, 5, "Bye"), (1, 1, 0, 0, "Oh "), (99, 1, 0, 0, "x"), (4, 1, None, None, None)], "doc_id long, seq int, start long, end long, replacement string")
    got = {r["doc_id"]: sum(r["tokens"]) for r in token_counts.apply(token_counts.with_edits(stored, edits)).collect()}
    assert got[1] == len(theirs(library, "Bye" + "Oh Hello world, it's me."[5:])) and got[4] == 0


def test_trees_take_a_second_round_of_edits(odd, library):
    """What apply gives is what trees gives of the edited texts, so edits of another day need no text to be counted anew."""
    once = stage(token_counts.apply(token_counts.revision(stage(token_counts.trees(odd), "trees"))), "trees")
    twice = token_counts.apply(token_counts.revision(once)).collect()
    assert len(twice) == len(ODD)
    for r in [*once.collect(), *twice]:
        assert sum(r["tokens"]) == len(theirs(library, r["text"])) and sum(r["characters"]) == len(r["text"]) and 0 not in r["characters"]


def test_leaves_are_counted_by_their_chunks(monkeypatch, library):
    """A text is cut into chunks once, not each of its leaves; their lengths and counts are those of the leaves."""
    calls, own = [], bpe.Codec.chunks
    monkeypatch.setattr(bpe.Codec, "chunks", lambda self, text: calls.append(text) or own(self, text))
    texts = ["", " ", "a", "  a b\x1c c\xa0d\u3000 é", "🙂 a  ", "a\x1f \x1e b\x85", "\x1ca b", " x\n\n", "\x1c", " ".join(f"word{k}{' ' * (k % 3)}" for k in range(500))]
    lengths = list(map(token_counts.leaf_lengths, texts))
    counts = token_counts.leaf_counts(PATH, texts, lengths)
    assert len(calls) == len(texts)
    for text, characters, tokens in zip(texts, lengths, counts, strict=True):
        leaves = token_counts.cut(text)
        assert characters.tolist() == list(map(len, leaves)) and tokens.tolist() == [len(theirs(library, x)) for x in leaves]
        assert token_counts.SegmentTree.of(PATH, text).tokens == len(theirs(library, text))


def test_trees_look_each_different_chunk_up_once(spark, monkeypatch, library):
    """No text is cut into a list of its chunks, and no chunk is looked up wherever it stands; very long texts are."""
    asked, own = [], bpe.Generations.values
    monkeypatch.setattr(bpe.Generations, "values", lambda self, lists: asked.extend(lists) or own(self, lists))
    texts = ["", " ", "a", "  a b\x1c c\xa0d\u3000 é", "", "🙂 a  ", "a\x1f \x1e b\x85", "\x1ca b", " x\n\n", "\u2003", "\x1c", "日本\u2028 <|endoftext|> Σ", " ".join(f"word{k % 9}{' ' * (k % 3)}" for k in range(500)), ""]
    want = [token_counts.cut(t) for t in texts]
    for most in (bpe.CHARACTERS_AT_ONCE, 30):
        monkeypatch.setattr(token_counts, "CHARACTERS_AT_ONCE", most)
        n, characters, tokens = token_counts.leaves(PATH, texts)
        assert n.tolist() == list(map(len, want)) and characters.tolist() == [len(x) for own in want for x in own]
        assert tokens.tolist() == [len(theirs(library, x)) for own in want for x in own]
        if most > 30:
            assert len(asked) == 1 and len(asked[0]) == len(set(asked[0])) < 40
    for few in ([], [""], ["", " "], ["é"]):
        assert token_counts.leaves(PATH, few)[0].tolist() == [len(token_counts.cut(t)) for t in few]


def test_op2_equals_a_recount(spark, sf, documents, library):
    def revised(t):
        n, q, h = len(t), len(t) // 4, len(t) // 2
        for a, b, new in ((q, q, "nota bene: "), (h, h + 12, ""), (q * 3, q * 3 + 5, "42%"), (n + 100, n + 100, " It isn't so.")):
            a = min(a, len(t))
            t = t[:a] + new + t[min(b, len(t)) :]
        return t

    got = {r["doc_id"]: (r["n_tokens"], r["edited_tokens"], r["edited_characters"]) for r in token_counts.op2(spark, sf).collect()}
    assert got == {r["doc_id"]: (len(theirs(library, r["text"])), len(theirs(library, revised(r["text"]))), len(revised(r["text"]))) for r in documents.collect()}


def test_op1_digests(spark, sf, documents, library):
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in bpe.op1(spark, sf).collect()}
    ids = {r["doc_id"]: theirs(library, r["text"]) for r in documents.collect()}
    assert got == {i: (len(x), sha(" ".join(map(str, x))), sha(library.decode(x, skip_special_tokens=False))) for i, x in ids.items()}


def test_added_tokens_may_repeat(library):
    for text in ("<|endoftext|> <|endoftext|>", "<|endoftext|><|endoftext|>x<|endoftext|>"):
        assert codec(PATH).encode(text) == theirs(library, text) == ours([text])[0]


def test_long_texts_in_parts(library, monkeypatch):
    rng = random.Random(9)
    word = lambda: "".join(rng.choices("abcxyz0123+/=é日", k=rng.randint(1, 200)))
    text = " ".join(word() for _ in range(300)) + "\n" + "".join(rng.choices("abyz019/日", k=30_000))
    want = theirs(library, text)
    monkeypatch.setattr(bpe, "CHARACTERS_AT_ONCE", 1000)
    monkeypatch.setattr(bpe, "PRETOKENS_AT_ONCE", 100)
    assert ours([text, "a b", text]) == [want, theirs(library, "a b"), want]


def test_memory_is_bounded_by_bytes():
    """Texts of long chunks that never come again: base64, Chinese, code without spaces."""
    script = """
import random, resource
from tempora.llm.bpe import default_vocabulary, encode_bytes
rng = random.Random(1)
path = default_vocabulary()
for i in range(400):
    encode_bytes(path, ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz0123456789+/", k=5000)) + " " + "".join(rng.choices("的一是不了人我在有他这为之大来以个中上们", k=1500))], 4 << 20)
    if i == 100:
        before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
print(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before)
"""
    grown = int(subprocess.run([sys.executable, "-c", script], capture_output=True, text=True, check=True, cwd=os.getcwd()).stdout)
    assert grown < 60_000  # kilobytes
