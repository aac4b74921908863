import pytest

LONG = "lorem ipsum dolor " * 12_000

#: Null ids and texts, empty and very long texts, repeated rows, odd characters; columns whose names operators use themselves.
ODD = [
    (1, "Hello world, it's me.", "a"),
    (1, "Hello world, it's me.", "a"),
    (2, None, "b"),
    (3, "", None),
    (None, "no id here", "c"),
    (None, None, None),
    (4, " \t\n ", "d"),
    (5, LONG, "e"),
    (6, "É ÉCOLE 日本 🙂 a\x1cb <|endoftext|> Σ", "f"),
    (7, "Hello  world,it's\nme.", "g"),
    (8, "x" * 5000, "h"),
]
NAMES = ["fingerprint", "digest", "score", "shard", "node", "n", "ids", "_d", "_c", "_rn", "_id", "_gone", "gone_0", "edits", "keep_id", "kept", "_digest", "_characters", "characters", "best", "line", "start", "rank", "_salt", "size"]
COLUMNS = "doc_id long, text string, " + ", ".join(f"{n} string" for n in NAMES) + ", tags map<string,int>, n_chars long"


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame([(i, t, *[x] * len(NAMES), {"a": 1}, None) for i, t, x in ODD], COLUMNS)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], COLUMNS)


@pytest.fixture(scope="session")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="session")
def library():
    from tokenizers import Tokenizer

    from tempora.llm.bpe import default_vocabulary

    return Tokenizer.from_file(default_vocabulary())
