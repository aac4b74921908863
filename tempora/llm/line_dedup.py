"""Line dedup by a log-template tree.

Lines are parsed to a fixed depth: a node is a number of tokens and the leading tokens, with tokens that hold a digit masked.
Inside a node, a token that few lines have at its position is a variable field; the line's template is what remains of it.
Templates that enough documents share, and of which enough is not variable, are recurring, and their lines are dropped from
every document. A template without a variable field, that is a line as it stands, recurs from the second document on if it is a
passage, a line of enough words: so run this after the dedup of whole documents, as lines of copies are passages too.

The text is read three times, and only hashes and counts are moved: of nodes and passages first, then of the distinct lines of
recurring nodes. What all tasks need to know of the recurring nodes is a bitmap of fixed size, which may let a line through
that the exact counts then leave out. Tokens are parted by space and U+0009 to U+000D, and digits are 0 to 9.
"""

from __future__ import annotations

import itertools
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from tempora.llm.common import BROADCAST_ROWS, documents, identified, joined_by_key, slices, stage, whole_text

LEADING_TOKENS = 3
#: A template recurs if this many documents have a line of it, and this share of its tokens is not variable.
MIN_DOCUMENTS = 10
CONSTANT_SHARE = 0.6
#: A passage has this many tokens, and recurs if this many documents have it word for word.
PASSAGE_TOKENS = 50
PASSAGE_DOCUMENTS = 2
#: Bits of the bitmap of recurring nodes.
BITMAP_BITS = 1 << 24
#: Counts that a task holds, and bytes of text that it reads, before it hands its counts on.
HELD_COUNTS, HELD_BYTES = 200_000, 32 << 20
#: Bits of a document's number inside its task.
NUMBER_BITS = 36

VARIABLE = b"<*>"
_NUMBER = re.compile(rb"\S*[0-9]\S*")
_has_digit = re.compile(rb"[0-9]").search


def tokens_of(line: bytes) -> list[bytes]:
    """The tokens of a line; those with a digit are masked."""
    return (_NUMBER.sub(VARIABLE, line) if _has_digit(line) else line).split()


def lines_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").split(b"\n")


def hashed(data: bytes) -> int:
    """A signed 64-bit hash, the same as Spark's xxhash64 of the text."""
    h = xxh64_intdigest(data, 42)
    return h - (1 << 64) if h >> 63 else h


def node_of(tokens: list[bytes]) -> int:
    return hashed(b"%d %s" % (len(tokens), b" ".join(tokens[:LEADING_TOKENS])))


def passage_of(line: bytes, tokens: list[bytes]) -> int | None:
    """The hash of a line as it stands, but for its white space, if it is a passage. A line feed parts these hashes from those of masked lines."""
    return hashed(b"\n" + b" ".join(line.split())) if len(tokens) >= PASSAGE_TOKENS else None


def line_hashes(line: bytes) -> tuple[int | None, int | None]:
    """Of the masked line, and of the passage; nothing for a line without tokens."""
    tokens = tokens_of(line)
    return (hashed(b" ".join(tokens)), passage_of(line, tokens)) if tokens else (None, None)


def _counted(schema: list[tuple[str, pa.DataType]], of_text):
    """Counts the rows that of_text gives for each document and its number, handing counts on whenever many are held. A row with a document's number, its last field, counts by itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        size, number = 0, TaskContext.get().partitionId() << NUMBER_BITS

        def out() -> pa.RecordBatch:
            columns = list(zip(*[(*k, n) for k, n in held.items()], strict=True)) or [()] * len(schema)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, schema, strict=True)], [n for n, _ in schema])

        for batch in batches:
            for part in slices(batch):
                for text in part.column("text").to_pylist():
                    held.update(of_text(text, number))
                    size, number = size + len(text), number + 1
                if len(held) >= HELD_COUNTS or size >= HELD_BYTES:
                    yield out()
                    size = 0
        yield out()

    return run


def nodes_and_passages(texts: DataFrame, min_documents: int) -> DataFrame:
    """key and passage (whether it is one, else a node) of what enough documents have."""

    def of_text(text: str, number: int) -> set[tuple[bool, int]]:
        found = set()
        for line in lines_of(text):
            if tokens := tokens_of(line):
                found.add((False, node_of(tokens)))
                if (key := passage_of(line, tokens)) is not None:
                    found.add((True, key))
        return found

    counts = texts.mapInArrow(_counted([("passage", pa.bool_()), ("key", pa.int64()), ("n", pa.int64())], of_text), "passage boolean, key long, n long")
    counts = counts.groupBy("passage", "key").agg(F.sum("n").alias("n"))
    return counts.where(F.col("n") >= F.when(F.col("passage"), PASSAGE_DOCUMENTS).otherwise(min_documents)).select("passage", "key")


def bitmap_of(nodes: DataFrame) -> np.ndarray:
    """A bit for each residue of the nodes: of fixed size, whatever the corpus holds."""
    bit = F.pmod("key", F.lit(BITMAP_BITS))
    words = nodes.select(F.floor(bit / 64).cast("long").alias("word"), F.expr(f"shiftleft(1L, cast(pmod(pmod(key, {BITMAP_BITS}), 64) as int))").alias("bits")).groupBy("word").agg(F.bit_or("bits").alias("bits"))
    bitmap = np.zeros(BITMAP_BITS // 64, np.int64)
    found = words.toPandas()  # at most BITMAP_BITS / 64 rows
    bitmap[found["word"].to_numpy(int)] = found["bits"].to_numpy(np.int64)
    return bitmap


def recurring_lines(docs: DataFrame, min_documents: int = MIN_DOCUMENTS, constant_share: float = CONSTANT_SHARE) -> DataFrame:
    """line: the hashes of masked lines whose template recurs, and of recurring passages."""
    texts = docs.select(whole_text().alias("text"))
    counted = stage(nodes_and_passages(texts, min_documents), "recurring-nodes")
    bitmap = bitmap_of(counted.where("not passage"))

    def lines(text: str, number: int) -> list[tuple[int, str, int | None]]:
        """The distinct lines of recurring nodes, and once more with the document's number where a node has several."""
        found: dict[int, set[bytes]] = {}
        for line in lines_of(text):
            if tokens := tokens_of(line):
                node = node_of(tokens)
                bit = node % BITMAP_BITS
                if bitmap[bit >> 6] >> (bit & 63) & 1:
                    found.setdefault(node, set()).add(b" ".join(tokens))
        return [(node, x.decode("utf-8", "surrogatepass"), of) for node, own in found.items() for x in own for of in ((None, number) if len(own) > 1 else (None,))]

    schema = [("node", pa.int64()), ("line", pa.string()), ("document", pa.int64()), ("n", pa.int64())]
    seen = stage(texts.mapInArrow(_counted(schema, lines), "node long, line string, document long, n long"), "lines-of-nodes")
    distinct = stage(seen.where("document is null").groupBy("node", "line").agg(F.sum("n").alias("n")), "distinct-lines")
    cells = distinct.select("node", "n", F.xxhash64("line").alias("line"), F.posexplode(F.split("line", " ")).alias("place", "token")).withColumn("token", F.xxhash64("token"))
    constant = cells.groupBy("node", "place", "token").agg(F.sum("n").alias("at_place"), F.count(F.lit(1)).alias("lines")).where(F.col("at_place") >= min_documents)
    constant = stage(constant.select(F.xxhash64("node", "place", "token").alias("cell"), "lines"), "constant-cells")
    keyed = cells.withColumn("cell", F.xxhash64("node", "place", "token"))
    held = joined_by_key(keyed, constant.withColumn("constant", F.lit(True)), "cell", "lines").select("node", "line", "n", "place", "token")
    shaped = keyed.groupBy("node", "line").agg(F.max("n").alias("n"), F.count(F.lit(1)).alias("length"))
    fixed = held.groupBy("node", "line").agg(F.sort_array(F.collect_list(F.struct("place", "token"))).alias("cells"))
    shaped = shaped.join(fixed, ["node", "line"]).select("node", "line", "n", F.xxhash64("node", "cells").alias("template"), (F.size("cells") / F.col("length")).alias("share"))
    shaped = stage(shaped.where(F.col("share") >= constant_share), "shaped-lines")
    # A document counts once for a template: what its further lines of one template have added is taken off again.
    key = F.xxhash64("node", "line").alias("key")
    several = seen.where("document is not null").select("document", "node", F.xxhash64("line").alias("line")).select("document", key)
    extra = joined_by_key(several, shaped.select(key, "template", "n"), "key", "n").groupBy("document", "template").agg(F.count(F.lit(1)).alias("k")).groupBy("template").agg(F.sum(F.col("k") - 1).alias("extra"))
    often = shaped.groupBy("template").agg(F.sum("n").alias("documents")).join(extra, "template", "left").where(F.col("documents") - F.coalesce("extra", F.lit(0)) >= min_documents)
    return shaped.join(often.select("template"), "template", "left_semi").select("line").unionByName(counted.where("passage").select(F.col("key").alias("line"))).distinct()


def dedup(docs: DataFrame, min_documents: int = MIN_DOCUMENTS, constant_share: float = CONSTANT_SHARE) -> DataFrame:
    """doc_id, text without its recurring lines, n_lines and n_dropped of each row.

    A line ends at a line feed; lines without tokens are kept and never counted as recurring. A null text counts as empty and
    stays so; repeated rows are each returned and each counted as a document; a very long text is read whole. Only doc_id and
    text are read, so other columns may have any name. An empty table gives no row.
    """
    found = stage(recurring_lines(docs, min_documents, constant_share), "recurring-lines")
    texts = identified(docs)
    if found.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        known = frozenset(r["line"] for r in found.toLocalIterator())
        return texts.mapInArrow(_without(lambda batch: itertools.repeat(known)), RESULT)
    # Too many to send to every task: the hashes of a document's lines meet them in a join, and come back as a list a document.
    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                rows = [(i, x, h) for i, x, t in zip(*(part.column(c).to_pylist() for c in ("doc_id", "of_text", "text")), strict=True) for h in {h for own in map(line_hashes, lines_of(t)) for h in own if h is not None}]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in list(zip(*rows, strict=True)) or [()] * 3], ["_id", "_of", "line"])

    keyed = texts.withColumn("of_text", F.xxhash64("text"))
    lists = keyed.mapInArrow(lines, "_id long, _of long, line long").distinct().join(found, "line").groupBy("_id", "_of").agg(F.collect_list("line").alias("drop"))
    marked = keyed.join(lists, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("of_text") == F.col("_of")), "left").select("doc_id", "text", "drop")
    return marked.mapInArrow(_without(lambda batch: [frozenset(d or ()) for d in batch.column("drop").to_pylist()]), RESULT)


#: What dedup returns.
RESULT = "doc_id long, text string, n_lines long, n_dropped long"


def _without(drops):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                out = []
                for text, known in zip(part.column("text").to_pylist(), drops(part), strict=False):
                    own = lines_of(text)
                    kept = [line for line in own if known.isdisjoint(line_hashes(line))] if known else own
                    out.append((text if len(kept) == len(own) else b"\n".join(kept).decode("utf-8", "surrogatepass"), len(own), len(own) - len(kept)))
                columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.string(), pa.int64(), pa.int64()), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *columns], ["doc_id", "text", "n_lines", "n_dropped"])

    return run


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = dedup(documents(spark, sf_dir))
    return rows.select("doc_id", "n_lines", "n_dropped", F.char_length("text").cast("long").alias("kept_characters"), F.sha2("text", 256).alias("kept_sha256"))


#: The same tree by plain SQL, with nodes, cells, templates and passages as they are instead of hashed.
_SPACE = "[\\x20\\x09-\\x0D]"
_SPLIT = f"list_filter(string_split_regex({{}}, '{_SPACE}+'), lambda x: x <> '')"
ORACLE_SQL = f"""WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
    s AS (SELECT doc_id, lines[i] AS line, i FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS i FROM d)),
    l AS (SELECT *, {_SPLIT.format("line")} AS words, [CASE WHEN regexp_matches(x, '[0-9]') THEN '{VARIABLE.decode()}' ELSE x END FOR x IN {_SPLIT.format("line")}] AS tokens FROM s),
    u AS (SELECT tokens, (len(tokens), tokens[1:{LEADING_TOKENS}]) AS node, doc_id FROM l WHERE len(tokens) > 0),
    passages AS (SELECT words FROM l WHERE len(words) >= {PASSAGE_TOKENS} GROUP BY words HAVING count(DISTINCT doc_id) >= {PASSAGE_DOCUMENTS}),
    recurring AS (SELECT node FROM u GROUP BY node HAVING count(DISTINCT doc_id) >= {MIN_DOCUMENTS}),
    own AS (SELECT tokens, node, count(DISTINCT doc_id) AS n FROM u SEMI JOIN recurring USING (node) GROUP BY ALL),
    cells AS (SELECT tokens, node, n, unnest(tokens) AS token, unnest(range(len(tokens))) AS place FROM own),
    fixed AS (SELECT node, place, token FROM cells GROUP BY ALL HAVING sum(n) >= {MIN_DOCUMENTS}),
    shaped AS (SELECT c.tokens, c.node, list(CASE WHEN f.token IS NOT NULL THEN c.token END ORDER BY c.place) AS shape, count(f.token) / count(*) AS share FROM cells c LEFT JOIN fixed f ON c.node = f.node AND c.place = f.place AND c.token = f.token GROUP BY c.tokens, c.node),
    enough AS (SELECT * FROM shaped WHERE share >= {CONSTANT_SHARE}),
    often AS (SELECT e.node, shape FROM enough e JOIN u ON u.tokens = e.tokens GROUP BY ALL HAVING count(DISTINCT doc_id) >= {MIN_DOCUMENTS}),
    gone AS (SELECT DISTINCT tokens FROM enough SEMI JOIN often ON enough.node = often.node AND enough.shape = often.shape),
    kept AS (SELECT l.*, gone.tokens IS NOT NULL OR p.words IS NOT NULL AS dropped FROM l LEFT JOIN gone ON l.tokens = gone.tokens LEFT JOIN passages p ON l.words = p.words),
    texts AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT dropped), '') AS text FROM kept GROUP BY doc_id)
    SELECT doc_id, n_lines, n_dropped, length(text) AS kept_characters, sha256(text) AS kept_sha256 FROM texts"""
