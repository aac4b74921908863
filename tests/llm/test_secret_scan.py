"""Base patterns by brute force; what names and constants lead to; texts that lead nowhere; odd rows."""

import hashlib
import random
import re
import time

import pytest

from tempora.llm import secret_scan as s


def slow_base(text):
    lower = {c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
    low = "".join(lower.get(c, c) for c in text)
    found, at = [], 0
    head = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?""")
    while at < len(text):  # leftmost, then on from its end
        m = head.match(low, at)
        run = re.compile("[A-Za-z0-9+/_.=-]+").match(text, m.end()) if m else None
        if m and not run:  # the mark's quote or spaces can't give way, but a second mark may be the value
            m = re.compile(head.pattern + "([a-z0-9+/_.=-]+)").match(low, at)
            run = m and re.compile("[A-Za-z0-9+/_.=-]+").match(text, m.start(1))
        if run:
            if run.end() - run.start() >= 8:
                found.append((at, run.end(), 0))
            at = run.end()
        else:
            at += 1
    for kind, pattern, least in ((1, "AKIA[A-Z0-9]+", 16), (2, "[0-9a-f]+", 32)):
        found += [(m.start(), m.end(), kind) for m in re.finditer(pattern, text) if len(m.group()) >= least]
    return sorted(found, key=lambda x: (x[0], x[2], x[1]))


@pytest.mark.parametrize("seed", range(6))
def test_base_spans_by_brute_force(seed):
    pick = random.Random(seed)
    parts = ["password", "PassWD", "secret", "toKen", "TOKEN", "api_key", "APIKEY", "paſsword", ":", "=", " ", '"', "'", "==", "a", "Zz9-_.=/+", "AKIA", "AKIA0123456789AB", "ABCDEF0123456789", "0f", "deadbeef" * 4, "é", "\n", "日本"]
    for _ in range(400):
        text = "".join(pick.choice(parts) for _ in range(pick.randint(0, 14)))
        assert s.find_spans(text)[0] == slow_base(text), text


FOUND = {
    'password = "p@ss word1"': ["p@ss word1"],
    "db_pwd: hunter2!x9": ["hunter2!x9"],
    '{"clientSecret": "a8F!kk-2l_0P"}': ["a8F!kk-2l_0P"],
    "x = 'Zk38-dk!!a'\npassword = x": ["Zk38-dk!!a"],
    "a = 'Zk38-dk!!a'\nb = a\nc = b\ndbPassword = c": ["Zk38-dk!!a"],
    "p1 = 'abc9!DEF'\np2='ghi7?JKL'\nauthToken = p1 + '-' + p2": ["abc9!DEF", "ghi7?JKL"],
    "x = 'AbC!dEf1'\nsecret_token = f\"pre-{x}-post\"": ["AbC!dEf1"],
    "export BASE='aa!11bb22'\nexport DB_SECRET=$BASE": ["aa!11bb22"],
    'BASE="aa!11bb22"\nSESSION_SECRET=${BASE}': ["aa!11bb22"],
    "const apiKey: string = 'Qw!3rt-99zz'": ["Qw!3rt-99zz"],
    "<password>S3cr!et%77</password>": ["S3cr!et%77"],
    "<db password='S3cr!et%77'/>": ["S3cr!et%77"],
    "mysql --password 'h4rd%2Guess' -u root": ["h4rd%2Guess"],
    "Authorization: Bearer abc.DEF-123_456!z": ["abc.DEF-123_456!z"],
    'user.setPassword("Tr0ub4dor&3")': ["Tr0ub4dor&3"],
    "if passwd == 'l3tme%%in':": ["l3tme%%in"],
    'contraseña = "Mad!rid2024"': ["Mad!rid2024"],
    "self.key = 'k3y!material'\nself.pwd = self.key": ["k3y!material"],
    "creds['api-key'] = 'ZZ!99-abcd'": ["ZZ!99-abcd"],
    "secret = decode('c2Vj!cmV0MTIz')": ["c2Vj!cmV0MTIz"],
    "encryption_key => 'q!W2e#R4t%Y6u&I8'": ["q!W2e#R4t%Y6u&I8"],
    "pw = 'one!1one'\npw = 'two!2two'\npassphrase = pw": ["two!2two"],
    "pass = 'Ab1!'\npass += 'Cd2?'": ["Ab1!", "Cd2?"],
    "日本 db_password = 'Pä§§w0rd!'": ["Pä§§w0rd!"],
}
NOT_FOUND = [
    "password = 'changeme!'", "password = '<your password>'", "token_length = 'abcdefgh!123'", "password_file: '/etc/pass!word1'", "The secret: it was late when they left.", "x = 'Zk38-dk!!a'\ny = x", "password = get('x')", "Password: none", 'password = ""',
    "the key = to the door", "colour = 'p@ss word1'", "password = 'this is only a sentence about the passwords of others'", "PASS=${NOT_KNOWN}", "secret = 'aaaaaaaaaa!'",
]


@pytest.mark.parametrize("text", sorted(FOUND))
def test_literals_of_sensitive_names(text):
    assert [text[a:b] for a, b, _ in s.find_spans(text)[1]] == FOUND[text]
    wrapped = f"# é {'x' * 50}\n{text}\n# end"  # the same somewhere else, after characters of several bytes
    assert [wrapped[a:b] for a, b, _ in s.find_spans(wrapped)[1]] == FOUND[text]


@pytest.mark.parametrize("text", NOT_FOUND)
def test_what_is_no_secret(text):
    assert s.find_spans(text)[1] == []


def test_constants_of_any_size_count():
    names = [f"p{i}" for i in range(100)]
    text = "".join(f"{n} = 'aB{i:02}!x'\n" for i, n in enumerate(names)) + f"password = {' + '.join(names)}"
    assert [text[a:b] for a, b, _ in s.find_spans(text)[1]] == [f"aB{i:02}!x" for i in range(100)]
    grown = "pw = 'aB!x1'\n" + "".join(f"pw += 'cD?{i:04}'\n" for i in range(2000)) + "passphrase = pw"
    assert len(s.find_spans(grown)[1]) == 2001
    long = "Ab1!" * 2000
    assert [b - a for a, b, _ in s.find_spans(f"x = '{long}'\nsecret_key = x")[1]] == [len(long)]
    assert s.find_spans(f"x = '{long}'\ny = 'chan'\nz='geme'\nsecret_key = x + y + z")[1] == []


@pytest.mark.parametrize("unit", ["token += 'yY1!zz'\n", "key = key + key\n", "a = a + 'b'\ntoken = a\n"])
def test_time_grows_with_the_text_of_constants(unit):
    test_time_grows_with_the_text("key = 'Zk38-dk!!a'\n" + unit * 200)
    test_time_grows_with_the_text(unit)


def test_a_pin_is_a_name_like_others():
    text = "userPin = 'Zk38-dk!!aQW12xyz'"
    assert [text[a:b] for a, b, _ in s.find_spans(text)[1]] == ["Zk38-dk!!aQW12xyz"]


@pytest.mark.parametrize("cut", [1, 5, 9, 17, 40])
def test_the_score_of_a_joined_text_is_that_of_the_whole(cut):
    pick = random.Random(cut)
    parts = ["a", "Z9", " ", "<", ">", "change", "me", "xx", "x", "..", ".", ":", "//", "/", "~", "todo", "none", "token", "é", "K"]
    for _ in range(2000):
        text = "".join(pick.choice(parts) for _ in range(pick.randint(1, 60)))
        pieces = [s.Said.of(text[i : i + cut]) for i in range(0, len(text), cut)]
        assert s.literal_score(sum(pieces[1:], pieces[0])) == s.literal_score(text)


def test_the_later_constant_does_not_reach_back():
    text = "password = x\nx = 'Zk38-dk!!a'"
    assert s.find_spans(text)[1] == []


def test_added_spans_are_sound_on_anything():
    pick = random.Random(9)
    parts = ["password", "token", "key", " = ", ": ", "=>", "'", '"', "`", "a1!B2?c3", "\\", "\n", "${x}", "x", "(", ")", "+", "[", "]", "<pwd>", "</pwd>", "--", "{", "é"]
    for _ in range(3000):
        text = "".join(pick.choice(parts) for _ in range(pick.randint(0, 25)))
        base, added = s.find_spans(text)
        assert all(0 <= a < b <= len(text) for a, b, _ in added)
        assert all(x[1] <= y[0] for x, y in zip(added, added[1:], strict=False))
        assert not any(p <= a and b <= q for a, b, _ in added for p, q, _ in base)


@pytest.mark.parametrize("unit", ["a", "a.", '"', "key = ", "x:", "token = '", "<a>", 'key("', "key = a + ", "key='a' 'b' ", "a = a + a\n", "a += 'y'\n", "{a:{a:", "a: b[", "`a=`"])
def test_time_grows_with_the_text(unit):
    took = []
    for n in (20_000, 160_000):
        began = time.process_time()
        s.find_spans(unit * (n // len(unit)) + " key")
        took.append(time.process_time() - began)
    assert took[1] < 24 * took[0] + 0.5


def test_odd_rows(spark, odd, nothing):
    rows = {(r["doc_id"], tuple(map(tuple, r["spans"]))) for r in s.find(odd).collect()}
    assert rows == {(i, ()) for i in (1, 2, 3, None, 4, 5, 6, 7, 8)}
    assert s.find(odd).count() == odd.count()
    assert s.find(nothing).count() == 0


def test_query(spark):
    sf = "/root/testdata/sf0.01"  # the smallest tables have no secrets
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    seen = 0
    for r in s.op13(spark, sf).collect():
        base = slow_base(texts[r["doc_id"]])
        written = ",".join(f"{s.KINDS[k]}:{a}:{b}" for a, b, k in base)
        assert r["base_sha256"] == hashlib.sha256(written.encode()).hexdigest()
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(k == kind for _, _, k in base) for kind in range(3)]
        assert set(written.split(",")) - {""} <= set(r["spans"].split(",")) and r["n_added"] == len([x for x in r["spans"].split(",") if x]) - len(base)
        seen += len(base)
    assert seen
