import hashlib
import random
import re

import pytest

from tempora.llm import pii

from tests.llm.conftest import ODD

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def slow_luhn(digits):
    total = 0
    for place, d in enumerate(map(int, reversed(digits))):
        d = d * 2 if place % 2 else d
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def brute(text):
    out = []
    for k, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            if (kind == "ip" and any(int(p) > 255 for p in m.group().split("."))) or (kind == "card" and not (12 <= len(digits) <= 19 and slow_luhn(digits))) or (kind == "phone" and not 9 <= len(digits) <= 15):
                continue
            out.append((m.start(), m.end(), k))
    return sorted(out, key=lambda s: (s[0], s[2]))


def test_base_spans_equal_the_patterns():
    rng = random.Random(3)
    parts = ["a", "b.", "@", ".", "1", "12", "255", "256", "+", "-", " ", "(", ")", "x@y.z", "+1 (415) 555-1234", "4111 1111 1111 1111", "%", "é", "\n", "0", "1.2.3.4", "..", "@@"]
    for _ in range(8000):
        text = "".join(rng.choices(parts, k=rng.randint(1, 25)))
        assert pii.find_spans(text)[0] == brute(text), text


def test_documents(documents):
    rows = documents.collect()
    found = {r["doc_id"]: [(s["start"], s["end"], pii.KINDS.index(s["kind"])) for s in r["spans"] if s["base"]] for r in pii.find(documents).collect()}
    assert found == {r["doc_id"]: brute(r["text"]) for r in rows}


@pytest.mark.parametrize(
    ("text", "kind", "span"),
    [
        ("mail john.doe [at] example [dot] com now", "email", "john.doe [at] example [dot] com"),
        ("john at example dot com", "email", "john at example dot com"),
        ("Write to anna (at) mail.example.org!", "email", "anna (at) mail.example.org"),
        ("аnna@exаmple.com", "email", "аnna@exаmple.com"),
        ("jane_at_example_dot_com", "email", "jane_at_example_dot_com"),
        ("john@exam​ple.com", "email", "john@exam​ple.com"),
        ("call plus four nine one five one two three four five six seven eight", "phone", "plus four nine one five one two three four five six seven eight"),
        ("４１１１ １１１１ １１１１ １１１１", "card", "４１１１ １１１１ １１１１ １１１１"),
        ("ip one nine two dot one six eight dot one dot one end", "ip", "one nine two dot one six eight dot one dot one"),
        ("1９2.168.０.1", "ip", "1９2.168.０.1"),
        ("plus four(nine)(one)(five)(one)(two)(three)(four)(five)(six)", "phone", "plus four(nine)(one)(five)(one)(two)(three)(four)(five)(six"),
        ("plus four(nine)(one)(five)(one)(two)(three)(four)(five)(six) é", "phone", "plus four(nine)(one)(five)(one)(two)(three)(four)(five)(six"),
        ("ask john dot doe at example dot com!", "email", "john dot doe at example dot com"),
        ("john at example dot tech", "email", "john at example dot tech"),
        ("to john at example dot quux now", "email", "john at example dot quux"),
        ("x" * 300 + " [dot] y (at) mail dot example dot org", "email", "x" * 300 + " [dot] y (at) mail dot example dot org"),
        ("a [dot] " * 60 + "b [at] example [dot] museum", "email", "a [dot] " * 60 + "b [at] example [dot] museum"),
    ],
)
def test_disguises_map_back_to_the_source(text, kind, span):
    base, added = pii.find_spans(text)
    assert [(text[a:b], pii.KINDS[k]) for a, b, k in added] == [(span, kind)]
    assert all(not (a < e and s < b) for a, b, _ in added for s, e, _ in base)


@pytest.mark.parametrize(
    ("text", "span", "left"),
    [
        ("mail jоhn@example.com now", "jоhn@example.com", "mail [EMAIL] now"),
        ("john [dot] doe@example.com", "john [dot] doe@example.com", "[EMAIL]"),
        ("to josé.mаria@mail.example.org!", "josé.mаria@mail.example.org", "to [EMAIL]!"),
        ("von jörg@example.de, gern", "jörg@example.de", "von [EMAIL], gern"),
        ("a@example.com [dot] au", "a@example.com [dot] au", "[EMAIL]"),
        ("ｊane.roe@example.com and x@y.zz", "ｊane.roe@example.com", "[EMAIL] and [EMAIL]"),
        ("１0.1.2.3", "１0.1.2.3", "[IP]"),
        ("+49 １51 2345678 9", "+49 １51 2345678 9", "[PHONE]"),
    ],
)
def test_half_disguised_identifiers_are_found_whole(text, span, left):
    base, added = pii.find_spans(text)
    assert base == brute(text)
    assert [text[a:b] for a, b, _ in added] == [span]
    assert pii.masked(text) == left


def test_added_spans_lie_in_no_base_span_and_masking_leaves_nothing_of_either():
    rng = random.Random(8)
    parts = ["jоhn", "ann", "é", ".", " [dot] ", "@", " at ", " dot ", "example", ".com", "1", "１", "92.168.0.1", "+1 415 555 123", "4", " ", "(at)", "x"]
    for _ in range(3000):
        text = "".join(rng.choices(parts, k=rng.randint(1, 12)))
        base, added = pii.find_spans(text)
        assert base == brute(text)
        assert not any(s <= a and b <= e for a, b, _ in added for s, e, _ in base)
        covered = {i for a, b, _ in base + added for i in range(a, b)}
        kept = re.sub(r"\[(EMAIL|IP|CARD|PHONE)\]", "", pii.masked(text))
        assert kept == "".join(c for i, c in enumerate(text) if i not in covered)


@pytest.mark.parametrize("text", ["He looked at the dot on the map.", "the cat at home dot dot", "one two three, go!", "We met at noon. Seven of us.", "see point (a) at page 3", "nine, eight, seven, six", "we arrived at some point during lunch", "look at each dot closely", "meet me at noon dot"])
def test_prose_is_left_alone(text):
    assert pii.find_spans(text) == ([], [])


@pytest.mark.parametrize("unit", ["a", "1", "one ", "a.", "[at] ", " at x", "1.", " dot a", "+1(", "@", "１", " ", "\t (", "a_at_", "a dot b at c dot com ", "x at y dot "])
def test_long_runs_take_linear_time(unit):
    import time

    def seconds(n):
        began = time.process_time()
        pii.find_spans(unit * n + " x@y.zz")
        return time.process_time() - began

    assert seconds(40_000) < 20 * seconds(10_000) + 0.5


def test_odd_rows(odd, nothing):
    rows = pii.find(odd).collect()
    assert len(rows) == len(ODD) and pii.find(nothing).count() == 0
    masked = pii.mask(odd)
    assert masked.columns == odd.columns and sorted((r["doc_id"] or 0, r["text"] or "") for r in masked.collect()) == sorted((i or 0, t or "") for i, t, _ in ODD)
    assert pii.masked("a b@c.de, 1.2.3.4") == "a [EMAIL], [IP]"


def test_op8_columns(spark, sf, documents):
    texts = {r["doc_id"]: r["text"] for r in documents.collect()}
    for r in pii.op8(spark, sf).collect():
        base = brute(texts[r["doc_id"]])
        told = [f"{pii.KINDS[k]}:{a}:{b}" for a, b, k in base]
        assert r["base_sha256"] == hashlib.sha256(",".join(told).encode()).hexdigest()
        assert [r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]] == [sum(k == i for _, _, k in base) for i in range(4)]
        spans = [x for x in r["spans"].split(",") if x]
        assert set(told) <= set(spans) and len(spans) == len(base) + r["n_added"]
        assert [int(x.split(":")[1]) for x in spans] == sorted(int(x.split(":")[1]) for x in spans)


def test_n_chars_follows_the_text(spark):
    df = spark.createDataFrame([(1, "x a@b.cd y", 10)], "doc_id long, text string, n_chars long")
    assert pii.mask(df).first()["n_chars"] == len("x [EMAIL] y")
