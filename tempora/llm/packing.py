"""Packing by minimum bin slack: token runs of at most one window, gathered so that windows are all but full.

A document's ids (and an end id) are cut into whole windows and a rest. How many pieces there are of each length is a
histogram of at most `window` numbers, whatever the corpus holds; the search runs on it alone. A sequence starts with the
longest length left; a bitset subset-sum (bit s: the sum s can be reached) over the lengths left, longest first, finds the
sum closest to the room that remains, and going back through the stored bitsets gives how many pieces of each length make
it up. The multiset found is used as often as the counts allow before the next search. Pieces then take their places by
their rank among the pieces of their length: a join with the plan, in which no piece's data is moved.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempora.llm.bpe import CACHE_BYTES, default_vocabulary, encode_bytes, release
from tempora.llm.common import documents, identified, salted_rank, slices, stage, tidy

WINDOW = 2048
END_ID = 1
#: Pieces of one length are numbered in at least so many parts, more where parts would have more rows than this.
SALTS, SALT_ROWS = 64, 1 << 20
#: Length and rank share a 64-bit number: ranks up to 2^44, lengths up to 2^19.
RANK_BITS = 44
#: Texts are encoded together up to this part of the cache's bytes: the more, the less often a chunk is looked up again.
SLICES_PER_CACHE = 32
#: Bits of a piece's number inside its task.
DEALT_BITS = 36

Pattern = tuple[list[tuple[int, int]], int]


def closest_sum(counts: dict[int, int], lengths: list[int], room: int) -> list[tuple[int, int]]:
    """(length, how many) whose sum is the largest that `room` holds; lengths are in falling order. Of equal sums, the one that needs only the longest lengths."""
    mask, reach, steps, target = (1 << room + 1) - 1, 1, [], 1 << room
    for length in lengths:
        if length > room:
            continue
        left = min(counts[length], room // length)
        part = 1
        while left > 0:
            take = min(part, left)
            steps.append((length, take, reach))
            reach |= reach << length * take & mask
            left -= take
            part *= 2
        if reach & target:
            break
    total, taken = reach.bit_length() - 1, {}
    for length, take, before in reversed(steps):
        if not before >> total & 1:
            total -= length * take
            taken[length] = taken.get(length, 0) + take
    return list(taken.items())


def minimum_slack_plan(histogram: dict[int, int], window: int) -> list[Pattern]:
    """Multisets of lengths and how often each is used; together they use up the histogram."""
    counts = {length: n for length, n in histogram.items() if n > 0}
    lengths, plan = sorted(counts, reverse=True), []
    while lengths:
        first = lengths[0]
        counts[first] -= 1
        need = dict(closest_sum(counts, [x for x in lengths if counts[x]], window - first))
        counts[first] += 1
        need[first] = need.get(first, 0) + 1
        times = min(counts[length] // n for length, n in need.items())
        for length, n in need.items():
            counts[length] -= n * times
        plan.append((sorted(need.items(), reverse=True), times))
        lengths = [x for x in lengths if counts[x]]
    return plan


def places(plan: list[Pattern]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, ranks, how many a sequence, first sequence, offset of the first) for each length of each multiset."""
    rows, used, sequence = [], {}, 0
    for need, times in plan:
        offset = 0
        for length, n in need:
            rows.append((length, used.get(length, 0), n * times, n, sequence, offset))
            used[length] = used.get(length, 0) + n * times
            offset += length * n
        sequence += times
    return rows


def pieces(docs: DataFrame, vocabulary: str | None = None, window: int = WINDOW, end_id: int | None = END_ID, keep_ids: bool = True, cache_bytes: int = CACHE_BYTES, keep_caches: bool = True) -> DataFrame:
    """doc_id, start, length, doc_tokens, ids_crc32 and, with keep_ids, the ids (little-endian unsigned 32-bit) of each window of a document and of its rest.

    `dealt` is the task and a running number, for ranks to be dealt by. Without keep_caches a task drops the vocabulary and the
    cache when it ends and gives their memory back; the next one builds its own.
    """
    path = vocabulary or default_vocabulary()
    end = b"" if end_id is None else np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made = TaskContext.get().partitionId() << DEALT_BITS, 0
        for batch in batches:
            for part in slices(batch, limit=cache_bytes // SLICES_PER_CACHE):
                rows = []
                for doc_id, ids in zip(part.column("doc_id").to_pylist(), encode_bytes(path, part.column("text").to_pylist(), cache_bytes), strict=True):
                    ids += end
                    for at in range(0, len(ids), 4 * window):
                        own = ids[at : at + 4 * window]
                        rows.append((doc_id, at // 4, len(own) // 4, len(ids) // 4, zlib.crc32(own), task + made, own)[: len(names)])
                        made += 1
                columns = list(zip(*rows, strict=True)) or [()] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=False)], names)
        if not keep_caches:
            release()

    names, types = ["doc_id", "start", "length", "doc_tokens", "ids_crc32", "dealt"] + ["ids"] * keep_ids, [pa.int64()] * 6 + [pa.binary()]
    return identified(docs).mapInArrow(run if keep_caches else tidy(run), ", ".join(f"{n} long" for n in names[:6]) + ", ids binary" * keep_ids)


def pack(docs: DataFrame, vocabulary: str | None = None, window: int = WINDOW, end_id: int | None = END_ID, keep_ids: bool = False, cache_bytes: int = CACHE_BYTES, keep_caches: bool = True) -> DataFrame:
    """Pieces with their place: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset; with keep_ids their ids too.

    A null or empty text is the end id alone; a document without any id (end_id None) has no piece. A very long text has as many
    pieces as it needs. Repeated rows are packed each for itself. Of pieces of equal length any may take a place. cache_bytes
    bounds a task's memory, and without keep_caches its worker keeps none of it. Sequences are numbered from 0; offsets in one are gapless from 0. Only doc_id and text are read, so
    other columns may have any name. An empty table gives no piece.
    """
    cut = stage(pieces(docs, vocabulary, window, end_id, keep_ids, cache_bytes, keep_caches), "pieces")
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row for each length up to the window
    plan = sorted(places(minimum_slack_plan(histogram, window)))
    ranked = salted_rank(cut, "length", ["doc_id", "start", "ids_crc32", "doc_tokens", "dealt"], F.pmod(F.xxhash64("dealt"), F.lit(max(SALTS, sum(histogram.values()) // SALT_ROWS))), "rank")
    kept = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"] + ["ids"] * keep_ids
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ranked.select(kept).schema) + ", sequence_id long, offset long"
    return ranked.select(*kept, "rank").mapInArrow(_placing(plan, kept), schema)


def _placing(plan: list[tuple[int, ...]], kept: list[str]):
    """Looks up where the plan puts each rank of a length. The plan has a bounded size: it grows with the window, not with the rows."""
    length, first, _, each, sequence, offset = np.array(plan, np.int64).reshape(-1, 6).T

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts = length << RANK_BITS | first
        for batch in batches:
            own, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            row = np.searchsorted(starts, own << RANK_BITS | rank, side="right") - 1
            k = rank - first[row]
            columns = [batch.column(c) for c in kept]
            columns += [pa.array(sequence[row] + k // each[row]), pa.array(offset[row] + k % each[row] * own)]
            yield pa.RecordBatch.from_arrays(columns, [*kept, "sequence_id", "offset"])

    return run


def op4(spark, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir))
