"""Sharding by rendezvous hashing of stable record keys over weighted shards.

Each (key, shard) has a hash; with u the hash as a number between 0 and 1, a record goes to the shard of least -ln(u) / weight.
A record's best shard among those there before changes only if a new shard beats it, so one more shard takes rows only into
itself, about 1/(n + 1) of them at equal weights. All of it is column arithmetic: no shuffle decides a shard. The hash is the
start of an MD5 digest, which other systems have too.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tempora.llm.common import documents, identified, salted_rank

SHARDS = 40
#: What a record takes besides its text, in bytes.
RECORD_BYTES = 16
#: Hexadecimal digits of the digest that make up a hash: 52 bits, which a double holds exactly.
HASH_DIGITS = 13


def record_key(doc_id: Column) -> Column:
    """The key as text; a null one counts as the empty key."""
    return F.coalesce(doc_id.cast("string"), F.lit(""))


def score(key: Column, shard: int, weight: float) -> Column:
    """-ln(u) / weight."""
    digest = F.md5(F.concat(key, F.lit(f"/{shard}")).cast("binary"))
    u = (F.conv(F.substring(digest, 1, HASH_DIGITS), 16, 10).cast("double") + 0.5) / float(1 << 4 * HASH_DIGITS)
    return -F.ln(u) / weight


def rendezvous(key: Column, weights: Sequence[float], first: int = 0) -> Column:
    """Score and number of the best of the shards from `first` on; of equal scores the lower shard is best."""
    if not weights or min(weights) <= 0:
        raise ValueError("every shard needs a weight above 0")
    scores = [F.struct(score(key, first + i, w).alias("score"), F.lit(first + i).alias("shard")) for i, w in enumerate(weights)]
    return F.least(*scores) if len(scores) > 1 else scores[0]


def shard(docs: DataFrame, weights: Sequence[float] = (1.0,) * SHARDS) -> DataFrame:
    """doc_id, text, size, text_crc32, shard and grown_shard (with one more shard of the mean weight) for every row.

    A null text has no bytes, a null doc_id is the empty key; repeated rows go to the same shard. Of equal scores the lower shard is
    best. Only the one more shard is compared with the best so far. A very long text is a row like any other. Only doc_id and
    text are read, so other columns may have any name. An empty table gives no row.
    """
    key = record_key(F.col("doc_id"))
    best = identified(docs).select("doc_id", "text", rendezvous(key, weights).alias("best"), rendezvous(key, [sum(weights) / len(weights)], len(weights)).alias("added"))
    return best.select("doc_id", "text", (F.octet_length("text").cast("long") + RECORD_BYTES).alias("size"), F.crc32("text").alias("text_crc32"), F.col("best.shard").alias("shard"), F.least("best", "added")["shard"].alias("grown_shard"))


def with_slots(rows: DataFrame) -> DataFrame:
    """Adds slot, gapless from 0 in each shard; repeated rows take one each. The text is left out, as numbering rows sorts them.

    Slots follow the first digit of the key's digest and the checksum's lowest four bits, so that a shard is numbered in 256 parts
    and rows of one key in 16, then doc_id, checksum, size.
    """
    salt = F.concat(F.substring(F.md5(record_key(F.col("doc_id")).cast("binary")), 1, 1), F.lower(F.hex(F.col("text_crc32") % 16)))
    return salted_rank(rows.drop("text"), "shard", ["doc_id", "text_crc32", "size"], salt, "slot")


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = with_slots(shard(documents(spark, sf_dir)))
    return rows.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


#: The same by plain SQL, with the checksum's table made by its rule.
ORACLE_SQL = f"""WITH t AS (SELECT [list_reduce(list_prepend(b, range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) FOR b IN range(256)] AS crc),
    d AS (SELECT doc_id, coalesce(CAST(doc_id AS VARCHAR), '') AS key, hex(encode(coalesce(text, ''))) AS h FROM documents),
    c AS (SELECT doc_id, key, length(h) // 2 + {RECORD_BYTES} AS size, xor(list_reduce(list_prepend(4294967295::BIGINT, [('0x' || h[2 * i + 1:2 * i + 2])::BIGINT FOR i IN range(length(h) // 2)]), lambda a, b: xor(crc[(xor(a, b) & 255) + 1], a >> 8)), 4294967295) AS text_crc32 FROM d, t),
    u AS (SELECT key, s AS shard, ('0x' || substr(md5(key || '/' || s), 1, {HASH_DIGITS}))::BIGINT AS h FROM (SELECT DISTINCT key FROM d), range({SHARDS + 1}) r(s)),
    b AS (SELECT key, arg_max(shard, (h, -shard)) FILTER (shard < {SHARDS}) AS shard, arg_max(shard, (h, -shard)) AS grown_shard FROM u GROUP BY key)
    SELECT doc_id, size, text_crc32, 'key' AS law, CAST(shard AS INTEGER) AS shard, row_number() OVER (PARTITION BY shard ORDER BY substr(md5(key), 1, 1), text_crc32 % 16, doc_id, text_crc32, size) - 1 AS slot, CAST(grown_shard AS INTEGER) AS grown_shard
    FROM c JOIN b USING (key)"""
