import re

from tempora.llm import line_dedup

from tests.llm.conftest import ODD


def slow_dedup(texts, least, share=line_dedup.CONSTANT_SHARE):
    """The same tree without hashes: kept text of each."""
    words = lambda line: tuple(re.findall("[^\x20\x09-\x0d]+", line))
    masked = lambda line: tuple("<*>" if re.search("[0-9]", w) else w for w in words(line))
    node = lambda t: (len(t), t[:3])
    own = [text.split("\n") for text in texts]
    passages, nodes, n, cells, often = ({} for _ in range(5))

    def count(into, keys, by=1):
        for k in keys:
            into[k] = into.get(k, 0) + by

    for lines in own:
        count(passages, {words(x) for x in lines if len(words(x)) >= 50})
        count(nodes, {node(masked(x)) for x in lines if words(x)})
        count(n, {masked(x) for x in lines if words(x)})
    for t, k in n.items():
        count(cells, [(node(t), i, x) for i, x in enumerate(t)], k)
    shape = lambda t: (node(t), tuple(x if cells[node(t), i, x] >= least else None for i, x in enumerate(t)))
    enough = lambda t: nodes[node(t)] >= least and sum(x is not None for x in shape(t)[1]) / len(t) >= share
    for lines in own:
        count(often, {shape(masked(x)) for x in lines if words(x) and enough(masked(x))})
    gone = lambda x: bool(words(x)) and (passages.get(words(x), 0) >= 2 or (enough(masked(x)) and often[shape(masked(x))] >= least))
    return ["\n".join(x for x in lines if not gone(x)) for lines in own]


def corpus():
    texts = []
    for i in range(40):
        who = f"user{chr(97 + i % 26)}{chr(97 + i // 26)}x"
        texts.append(f"Unique prose {chr(97 + i % 26)} of document\nThe session of {who} was opened at {i}:00 today\nCopyright 20{i:02d} by nobody\n\nPage {i}")
    return texts + ["The session of nobody was closed", "Copyright, they said", ""]


def test_templates_with_variable_fields_go(spark):
    texts = corpus()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup(docs, 10).collect()}
    assert got == dict(enumerate(slow_dedup(texts, 10)))
    assert got[3].startswith("Unique prose") and "session" not in got[3] and "Copyright" not in got[3] and got[41] == "Copyright, they said"


def test_the_join_gives_what_the_broadcast_gives(spark, documents, monkeypatch):
    before = sorted(map(tuple, line_dedup.dedup(documents, 4).collect()))
    monkeypatch.setattr(line_dedup, "BROADCAST_ROWS", 0)
    assert sorted(map(tuple, line_dedup.dedup(documents, 4).collect())) == before


def test_passages_go_from_the_second_document_on(spark):
    passage = " ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60))
    dated = passage + " in 1998"
    texts = [f"one\n{passage}\ntwo", passage.replace(" ", "\t", 3), f"{dated}\nx", f"y\n{dated}", passage + " in 1999", passage.rsplit(" ", 12)[0], passage.rsplit(" ", 12)[0], "short line", "short line", f"{passage} z\n{passage} z"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup(docs).collect()}
    assert got == dict(enumerate(slow_dedup(texts, 10)))
    assert got[0] == "one\ntwo" and got[1] == "" and got[2] == "x" and got[4] == texts[4] and got[5] == texts[5] and got[9] == texts[9]


def test_a_document_counts_once_for_a_template(spark):
    fields = lambda i: "".join(chr(97 + int(d)) for d in str(i))
    log = "\n".join(f"service started by user {fields(i)} on host now" for i in range(40))
    few = [log] + [f"service started by user {fields(100 + i)} on host now" for i in range(5)] + [f"service started by nobody at all now {i % 2}" for i in range(6)]
    many = [log, log.replace("x", "y")] + [f"service started by user {fields(100 + i)} on host now" for i in range(9)]
    for texts in (few, many):
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        got = {r["doc_id"]: r["text"] for r in line_dedup.dedup(docs).collect()}
        assert got == dict(enumerate(slow_dedup(texts, 10)))
        assert (got[0] == log) == (texts is few)


def test_lines_of_very_many_documents_are_joined_apart(spark, monkeypatch):
    from tempora.llm import common

    monkeypatch.setattr(common, "HOT_ROWS", 2)
    test_a_document_counts_once_for_a_template(spark)


def test_only_ascii_white_space_and_digits_count(spark):
    lines = ["a\u00a0b c d e", "a b\x1cc d e f", "x \u0663 y z w", "x 3 y z w"]
    texts = ["\n".join(lines[i % 4 :]) for i in range(24)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["doc_id"]: r["text"] for r in line_dedup.dedup(docs, 10).collect()} == dict(enumerate(slow_dedup(texts, 10)))


def test_documents(documents):
    rows = documents.select("doc_id", "text").collect()
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup(documents, 4).collect()}
    assert got == dict(zip([r["doc_id"] for r in rows], slow_dedup([r["text"] for r in rows], 4)))


def test_odd_rows_and_empty_table(odd, nothing):
    rows = line_dedup.dedup(odd, 2).collect()
    assert len(rows) == len(ODD) and sum(r["n_dropped"] for r in rows) > 0
    assert sorted((r["doc_id"] or 0, r["text"]) for r in rows) == sorted(zip([i or 0 for i, _, _ in ODD], slow_dedup([t or "" for _, t, _ in ODD], 2)))
    assert line_dedup.dedup(nothing).count() == 0
