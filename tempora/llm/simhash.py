"""SimHash near-duplicates by tiled exact comparison.

Distinct fingerprints are put in buckets, and a bucket's fingerprints, in order of population count, are cut into tiles. Every
comparison is one of two tiles of a bucket: exclusive-or and bit counts as numpy products of their rows. Tile pairs whose
population counts lie further apart than the radius are skipped unseen, and so are tiles that are one tree by then. Comparing
all tiles of a corpus would grow with its square, so buckets decide which tiles may meet at all: two fingerprints that differ in
at most `radius` bits agree wholly in all but `radius` of any blocks of bits, so each choice of that many blocks gives a
bucket, and linked fingerprints share at least one. No link is lost. As many bits of a choice are used as leave a bucket some
BUCKET_ROWS random fingerprints; more rows mean more bits, then more blocks, not larger buckets. A bucket with very many
fingerprints is cut into parts that meet pairwise in different tasks. A task emits a spanning star for what it has joined,
never all pairs; components are found by contraction, over fingerprints rather than documents, with every round staged in the
shared folder.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from tempora.llm.common import bounded, documents, identified, joined_by_key, lacking, slices, stage, tidy

SEED = 42
SHINGLE_WORDS = 3
RADIUS = 3
BITS = 64
#: Rows of a tile, and of a tile of those to be found where few look for others.
TILE_ROWS = 64
FOUND_ROWS = 1024
#: Random fingerprints that a bucket is meant for.
BUCKET_ROWS = 512
#: The most rows of a bucket that meet each other in one task.
TASK_ROWS = 1 << 16
#: Links that nearest() gathers before it keeps the nearest only.
HELD_LINKS = 1 << 18
#: Linked documents that an unsettled document is compared with in the round after its nearest one; four times as many in each further round, up to the second number.
LINKS_A_ROUND, MOST_A_ROUND = 16, 256
#: Words of 64 bits of the sketch that tells unlike texts apart before they are read.
SKETCH_WORDS = 8
SKETCH = ["size", *[f"s{i}" for i in range(SKETCH_WORDS)]]
#: Two sums over a text's set of shingles that tell it from any other set.
WHOLE = ["sum", "mixed"]
#: Near copies share this much of their sets of shingles of so many words.
SIMILARITY, SIMILAR_WORDS = 0.8, 5
#: Fingerprints of a text, of differently mixed hashes, any of which may link it.
PRINTS = 4
#: Links to one document that are compared in the same part of a join.
LINKS_A_PART = 64
PRINT = [f"print_{k}" for k in range(PRINTS)]
#: Rows that a task gathers, to the end of a bucket, before it compares.
HELD_ROWS = 1 << 17

_LANES = np.uint64(0x0101010101010101)


def hashes(text: str, words: int = SHINGLE_WORDS) -> list[int]:
    """XXH64 of each run of so many words, in lower case (A-Z), parted by one space; of all words if there are fewer."""
    own = text.encode("utf-8", "surrogatepass").lower().split()
    if len(own) <= words:
        return [xxh64_intdigest(b" ".join(own), SEED)] if own else []
    joined = b" ".join(own)
    ends = list(itertools.accumulate(map(len, own), lambda a, n: a + n + 1))
    starts = [0, *[e + 1 for e in ends]]
    return [xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts, ends[words - 1 :], strict=False)]


def mixed(values: np.ndarray, k: int) -> np.ndarray:
    """The k-th mix of hashes; that of 0 leaves them as they are."""
    if not k:
        return values
    values = values ^ np.uint64(k * 0x9E3779B97F4A7C15 & (1 << BITS) - 1)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        values = (values ^ values >> np.uint64(shift)) * np.uint64(factor)
    return values ^ values >> np.uint64(31)


def majorities(per_text: list[list[int]], mixes: int = 1) -> list[np.ndarray]:
    """For each mix, a fingerprint of each text: a bit is set if over half of the text's hashes have it; none without hashes."""
    counts = np.array([len(h) for h in per_text], np.int64)
    outs = [np.zeros(len(per_text), np.uint64) for _ in range(mixes)]
    full = np.flatnonzero(counts)
    if not len(full):
        return outs
    hashed = np.fromiter(itertools.chain.from_iterable(per_text), np.uint64, int(counts.sum()))
    # Eight bits at a time are counted in the eight bytes of a word, over parts of 255 hashes at most.
    parts = (counts[full] + 254) // 255
    first_part = np.cumsum(parts) - parts
    first_hash = np.cumsum(counts[full]) - counts[full]
    starts = np.repeat(first_hash, parts) + 255 * (np.arange(parts.sum()) - np.repeat(first_part, parts))
    for mix, out in enumerate(outs):
        flat = mixed(hashed, mix)
        for k in range(8):
            lanes = np.add.reduceat(flat >> np.uint64(k) & _LANES, starts)
            each = np.add.reduceat(lanes.astype("<u8").view(np.uint8).reshape(-1, 8).astype(np.int64), first_part, axis=0)
            over = 2 * each > counts[full, None]
            out[full] |= (over.astype(np.uint64) << (np.arange(8, dtype=np.uint64) * np.uint64(8) + np.uint64(k))).sum(axis=1, dtype=np.uint64)
    return outs


def fingerprints(texts: list[str], words: int = SHINGLE_WORDS) -> np.ndarray:
    """A bit is set if over half of a text's hashes have it; a text without words has none."""
    return majorities([hashes(t, words) for t in texts])[0]


def sketches(texts: list[str], words: int) -> np.ndarray:
    """For each text the number of its different shingles, and a bit for each remainder of their hashes: whether an odd number of them has it.

    Where two sketches differ in a bit, some shingle is in one text only, so texts differ in at least as many shingles as their
    sketches in bits, however long they are.
    """
    out = np.zeros((len(texts), 1 + SKETCH_WORDS), np.int64)
    for row, text in enumerate(texts):
        out[row] = sketch_of(np.unique(np.array(hashes(text, words), np.uint64)))
    return out


def sketch_of(own: np.ndarray) -> np.ndarray:
    odd = np.bincount((own % np.uint64(64 * SKETCH_WORDS)).astype(np.int64), minlength=64 * SKETCH_WORDS) & 1
    return np.concatenate([[len(own)], np.packbits(odd.astype(np.uint8)).view(np.int64)])


def least_apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """In how many shingles the texts of these sketches, row by row, differ at least."""
    bits = np.bitwise_count(np.ascontiguousarray(a[:, 1:]).view(np.uint64) ^ np.ascontiguousarray(b[:, 1:]).view(np.uint64)).sum(1, dtype=np.int64)
    return np.maximum(bits, np.abs(a[:, 0] - b[:, 0]))


def may_be_alike(a: np.ndarray, b: np.ndarray, similarity: float) -> np.ndarray:
    """Whether the texts of these sketches, row by row, can have this similarity; where they have it, always true."""
    return least_apart(a, b) * (1 + similarity) <= (a[:, 0] + b[:, 0]) * (1 - similarity) + 1e-6


def sketched(docs: DataFrame, words: int, sketch_words: int) -> DataFrame:
    """doc_id, PRINTS fingerprints (of shingles of `words` words), the sketch and the sums (of shingles of `sketch_words` words) of each row's whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                texts = part.column("text").to_pylist()
                prints = [p.view(np.int64) for p in majorities([hashes(t, words) for t in texts], PRINTS)]
                rows = np.zeros((len(texts), len(SKETCH) + len(WHOLE)), np.int64)
                for row, text in zip(rows, texts, strict=True):
                    own = np.unique(np.array(hashes(text, sketch_words), np.uint64))
                    row[: len(SKETCH)] = sketch_of(own)
                    row[len(SKETCH) :] = np.array([own.sum(dtype=np.uint64), mixed(own, 1).sum(dtype=np.uint64)]).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *map(pa.array, [*prints, *rows.T.copy()])], ["doc_id", *PRINT, *SKETCH, *WHOLE])

    return identified(docs).mapInArrow(tidy(run), "doc_id long, " + ", ".join(f"{c} long" for c in [*PRINT, *SKETCH, *WHOLE]))


def fingerprint(docs: DataFrame, words: int = SHINGLE_WORDS) -> DataFrame:
    """doc_id and fingerprint (the 64 bits as a long) of each row's whole text; a null or empty text has fingerprint 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                found = fingerprints(part.column("text").to_pylist(), words)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(found.view(np.int64))], ["doc_id", "fingerprint"])

    return identified(docs).mapInArrow(run, "doc_id long, fingerprint long")


def block_masks(blocks: int, radius: int) -> list[int]:
    """A mask for each choice of blocks in which fingerprints within the radius may agree."""
    edges = [BITS * i // blocks for i in range(blocks + 1)]
    whole = [(1 << b) - (1 << a) for a, b in itertools.pairwise(edges)]
    return [sum(c) for c in itertools.combinations(whole, blocks - radius)]


def bucket_masks(rows: int, radius: int) -> list[int]:
    """The bits that make a bucket, for each choice of blocks: of the fewest blocks that give bits enough, and no more bits than needed."""
    bits = max(0, rows // BUCKET_ROWS).bit_length()
    if not bits:
        return [0]
    blocks = radius + 1
    while blocks < radius + 5 and BITS * (blocks - radius) // blocks < bits:
        blocks += 1
    masks = []
    for mask in block_masks(blocks, radius):
        places = [b for b in range(BITS) if mask >> b & 1]
        masks.append(sum(1 << b for b in places[-bits:]))
    return masks


def join_roots(roots: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Joins the trees of places a and b pairwise; afterwards every place points at the least place of its tree."""
    while len(a):
        a, b = roots[a], roots[b]
        apart = a != b
        a, b = a[apart], b[apart]
        low, high = np.minimum(a, b), np.maximum(a, b)
        np.minimum.at(roots, high, low)
        while (roots[roots] != roots).any():
            roots[:] = roots[roots]


def compare(prints: np.ndarray, roots: np.ndarray, left: range, right: range, radius: int) -> tuple[int, int]:
    """Joins the rows of left with those of right that lie within the radius; returns how many tile pairs were compared and skipped.

    left and right are places in order of population count, either the same or apart.
    """
    counts = np.bitwise_count(prints).astype(int)
    compared = skipped = 0
    for i in range(left.start, left.stop, TILE_ROWS):
        a = slice(i, min(i + TILE_ROWS, left.stop))
        for j in range(i if left == right else right.start, right.stop, TILE_ROWS):
            b = slice(j, min(j + TILE_ROWS, right.stop))
            if counts[j] - counts[a.stop - 1] > radius or counts[i] - counts[b.stop - 1] > radius:
                skipped += 1
                continue
            if (roots[a] == roots[i]).all() and (roots[b] == roots[i]).all():
                skipped += 1
                continue
            compared += 1
            x, y = np.nonzero(np.bitwise_count(prints[a][:, None] ^ prints[b][None, :]) <= radius)
            x, y = x + i, y + j
            apart = roots[x] != roots[y]
            join_roots(roots, x[apart], y[apart])
    return compared, skipped


def buckets(bucket: np.ndarray, side: np.ndarray, prints: np.ndarray) -> Iterator[tuple[np.ndarray, range, range]]:
    """The rows of each bucket in order of population count, and which places of them meet which.

    Rows of side 0 meet each other, or those of side 1 where a bucket has any: these parts of a bucket meet themselves elsewhere.
    """
    order = np.lexsort((np.bitwise_count(prints), side, bucket))
    starts = np.flatnonzero(np.r_[True, bucket[order][1:] != bucket[order][:-1]])
    for rows in np.split(order, starts[1:]):
        cut = int(np.searchsorted(side[rows], 1))
        yield rows, range(cut), range(cut, len(rows)) if cut < len(rows) else range(cut)


def stars(bucket: np.ndarray, side: np.ndarray, prints: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, int, int]:
    """Links found inside buckets, as fingerprints and fingerprints that they are joined with, and how many tile pairs were compared and skipped."""
    us, vs, total = [prints[:0]], [prints[:0]], np.zeros(2, np.int64)
    for rows, left, right in buckets(bucket, side, prints):
        own, roots = prints[rows], np.arange(len(rows))
        total += compare(own, roots, left, right, radius)
        linked = np.flatnonzero(roots != np.arange(len(own)))
        us.append(own[linked]), vs.append(own[roots[linked]])
    return np.concatenate(us), np.concatenate(vs), *total.tolist()


def nearest(prints: np.ndarray, ids: np.ndarray, looking: np.ndarray, after: tuple[np.ndarray, np.ndarray], sketch: np.ndarray, left: range, right: range, radius: int, most: int, similarity: float) -> np.ndarray:
    """For each row that is looking, linked rows of smaller id that may be alike: the `most` whose sketches are nearest, of equally near ones those of smallest id, that come after (distance, id): columns gone, distance, kept.

    left and right are as in compare(). Tiles are of rows that look and of rows to be found.
    """
    counts = np.bitwise_count(prints).astype(int)
    found = [np.zeros((0, 3), np.int64)]

    def least() -> np.ndarray:
        links = np.concatenate(found)
        links = links[np.lexsort((links[:, 2], links[:, 1], links[:, 0]))]
        first = np.flatnonzero(np.r_[True, links[1:, 0] != links[:-1, 0]]) if len(links) else np.zeros(0, int)
        return links[np.arange(len(links)) - np.repeat(first, np.diff(np.r_[first, len(links)])) < most]

    for seekers, others in [(left, right)] if left == right else [(left, right), (right, left)]:
        rows = np.arange(seekers.start, seekers.stop)[looking[seekers.start : seekers.stop]]
        for i in range(0, len(rows), TILE_ROWS):
            a = rows[i : i + TILE_ROWS]
            low = others.start + int(np.searchsorted(counts[others.start : others.stop], counts[a[0]] - radius))
            high = others.start + int(np.searchsorted(counts[others.start : others.stop], counts[a[-1]] + radius, "right"))
            for j in range(low, high, FOUND_ROWS):
                b = slice(j, min(j + FOUND_ROWS, high))
                x, y = np.nonzero(np.bitwise_count(prints[a][:, None] ^ prints[b][None, :]) <= radius)
                gone, kept = a[x], y + j
                down = ids[kept] < ids[gone]
                gone, kept = gone[down], kept[down]
                near = least_apart(sketch[gone], sketch[kept])
                new = (near > after[0][gone]) | (near == after[0][gone]) & (ids[kept] > after[1][gone])
                new &= may_be_alike(sketch[gone], sketch[kept], similarity)
                if new.any():
                    found.append(np.stack([ids[gone[new]], near[new], ids[kept[new]]], 1))
            if sum(map(len, found)) > HELD_LINKS:
                found = [least()]
    return least()


def tasks(prints: DataFrame, radius: int, rows: int | None = None, by: str = "fingerprint") -> DataFrame:
    """The rows of prints, dealt and sorted by the tasks (parts of buckets) in which they meet others, with their side there. by: what deals a bucket's rows over its parts."""
    masks = bucket_masks(prints.count() if rows is None else rows, radius)
    signed = [m - (1 << BITS) if m >> BITS - 1 else m for m in masks]
    keyed = prints.select("*", F.explode(F.array(*[F.struct(F.lit(i).alias("choice"), F.col("fingerprint").bitwiseAND(F.lit(m)).alias("bits")) for i, m in enumerate(signed)])).alias("key"))
    keyed = keyed.select(*prints.columns, F.xxhash64("key.choice", "key.bits").alias("key"))
    # A bucket of few rows is one part. Parts i and j of a larger one meet as task (i, j): part i on side 0 and, if j > i, part j on side 1.
    sizes = stage(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > TASK_ROWS), "large-buckets")
    dealt = keyed.join(bounded(sizes), "key", "left").withColumn("parts", F.coalesce(F.ceil(F.col("n") / TASK_ROWS), F.lit(1)).cast("long"))
    part = F.pmod(F.xxhash64(by), F.col("parts"))
    own = F.transform(F.sequence(part, F.col("parts") - 1), lambda j: F.struct(part.alias("i"), j.alias("j"), F.lit(0).alias("side")))
    others = F.transform(F.filter(F.sequence(F.lit(0).cast("long"), part), lambda i: i < part), lambda i: F.struct(i.alias("i"), part.alias("j"), F.lit(1).alias("side")))
    met = dealt.withColumn("task", F.explode(F.concat(own, others))).select(F.xxhash64("key", "task.i", "task.j").alias("task"), "task.side", *prints.columns)
    return met.repartition("task").sortWithinPartitions("task")


def whole_tasks(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[list[np.ndarray]]:
    """The columns (the first is the sorted task) of about HELD_ROWS rows at a time, with all rows of their tasks."""
    held: list[list[np.ndarray]] = []
    for batch in batches:
        if batch.num_rows:
            held.append([batch.column(c).to_numpy() for c in columns])
            if sum(len(h[0]) for h in held) >= HELD_ROWS and held[-1][0][-1] != held[0][0][0]:
                whole = [np.concatenate(c) for c in zip(*held, strict=True)]
                cut = int(np.searchsorted(whole[0], whole[0][-1]))  # rows of the last task may go on in the next batch
                held = [[c[cut:] for c in whole]]
                yield [c[:cut] for c in whole]
    if held:
        yield [np.concatenate(c) for c in zip(*held, strict=True)]


def tiled(prints: DataFrame, radius: int = RADIUS, rows: int | None = None) -> DataFrame:
    """u, v: links that join exactly the fingerprints that links within the radius join; and rows without u and v, with the tile pairs compared and skipped."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for task, side, own in whole_tasks(batches, ["task", "side", "fingerprint"]):
            u, v, compared, skipped = stars(task, side, own.view(np.uint64), radius)
            none = [None] * len(u)
            yield pa.RecordBatch.from_arrays([pa.array([*x.view(np.int64).tolist(), None], pa.int64()) for x in (u, v)] + [pa.array([*none, n], pa.int64()) for n in (compared, skipped)], ["u", "v", "compared", "skipped"])

    return tasks(prints.select("fingerprint"), radius, rows).mapInArrow(run, "u long, v long, compared long, skipped long")


def links(prints: DataFrame, radius: int = RADIUS, rows: int | None = None) -> DataFrame:
    """u, v of tiled(): at most one row for each fingerprint, bucket and task."""
    return tiled(prints, radius, rows).where("u is not null").select("u", "v").distinct()


def tile_counts(docs: DataFrame, radius: int = RADIUS, words: int = SHINGLE_WORDS) -> DataFrame:
    """One row: the tile pairs that are compared and those skipped for the documents."""
    return tiled(fingerprint(docs, words).select("fingerprint").distinct(), radius).agg(F.sum("compared").alias("compared"), F.sum("skipped").alias("skipped"))


def components(edges: DataFrame) -> DataFrame:
    """node, root: a node of each component stands for it. Nodes without an edge have no row.

    Every round each node goes to the neighbour of least hash, if that is less than its own; a hash of node and round takes away
    the long chains that an order by value may have. Edges between what is left go on to the next round.
    """
    order = lambda node, k: F.xxhash64(node, F.lit(k))
    edges = stage(edges.where("u != v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "links")
    found, k = None, 0
    while edges.take(1):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min(F.struct(order(F.col("v"), k).alias("h"), F.col("v").alias("to"))).alias("best"))
        hook = stage(least.select(F.col("u").alias("node"), F.when(F.col("best.h") < order(F.col("u"), k), F.col("best.to")).otherwise(F.col("u")).alias("root")), "hooks")
        of_u, of_v = hook.select(F.col("node").alias("u"), F.col("root").alias("ru")), hook.select(F.col("node").alias("v"), F.col("root").alias("rv"))
        left = edges.join(of_u, "u").join(of_v, "v").where("ru != rv").select(F.least("ru", "rv").alias("u"), F.greatest("ru", "rv").alias("v"))
        edges = stage(left.distinct(), "links")
        if found is None:
            found = hook
        else:
            moved = hook.select(F.col("node").alias("root"), F.col("root").alias("next"))
            found = stage(found.join(moved, "root", "left").select("node", F.coalesce("next", "root").alias("root")), "roots")
        k += 1
    return found if found is not None else edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def near_duplicates(docs: DataFrame, radius: int = RADIUS, words: int = SHINGLE_WORDS) -> DataFrame:
    """doc_id, fingerprint and component_id, the smallest doc_id that links reach, of every row.

    Texts without words, null ones too, share fingerprint 0. Repeated rows are each returned. A component without any doc_id has
    a null id. A very long text is hashed whole, by itself. Ties can't occur: ids are compared as numbers. Only doc_id and text
    are read, so other columns may have any name. An empty table gives no row.
    """
    rows = stage(fingerprint(docs, words), "fingerprints")
    prints = stage(rows.groupBy("fingerprint").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")), "prints")
    edges = stage(links(prints.select("fingerprint"), radius), "edges")
    roots = components(edges)
    linked = prints.join(roots, F.col("fingerprint") == F.col("node"), "left").withColumn("root", F.coalesce("root", "fingerprint"))
    of_root = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    of_print = stage(linked.select("fingerprint", "root", "n").join(of_root, "root").select("fingerprint", "component_id", "n"), "components")
    return joined_by_key(rows, of_print, "fingerprint", "n").select("doc_id", "fingerprint", "component_id")


def hexadecimal(bits: Column) -> Column:
    return F.lower(F.lpad(F.hex(bits), 16, "0"))


def representatives(docs: DataFrame, radius: int = RADIUS, words: int = SHINGLE_WORDS) -> DataFrame:
    """One row of each component, the one of the smallest doc_id, with all its columns.

    Rows without a doc_id stay, as do all rows that repeat the smallest doc_id. Null and empty texts are one component. Columns may
    have any name. An empty table gives no row.
    """
    rows = near_duplicates(docs, radius, words).where("doc_id != component_id").select(F.col("doc_id").alias("gone")).distinct()
    return lacking(docs, stage(rows, "near-copies"), [(F.col("doc_id").cast("long"), "gone")])


def nearest_links(nodes: DataFrame, radius: int, most: int, similarity: float) -> DataFrame:
    """gone, apart, kept: the links of nearest() of each id. nodes (staged) has id, PRINTS fingerprints, looking, after_apart, after_id and the sketch."""
    columns = ["id", "looking", "after_apart", "after_id", *SKETCH]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for task, side, own, ids, looking, apart, after, *sketch in whole_tasks(batches, ["task", "side", "fingerprint", *columns]):
            own, looking, sketch = own.view(np.uint64), looking.astype(bool), np.stack(sketch, 1)
            found = np.concatenate([nearest(own[r], ids[r], looking[r], (apart[r], after[r]), sketch[r], left, right, radius, most, similarity) for r, left, right in buckets(task, side, own) if looking[r].any()] or [np.zeros((0, 3), np.int64)])
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in found.T.copy()], ["gone", "apart", "kept"])

    rows, found = nodes.count(), None
    for name in PRINT:
        met = tasks(nodes.select(F.col(name).alias("fingerprint"), *columns).withColumn("looking", F.col("looking").cast("long")), radius, rows, "id").mapInArrow(tidy(run), "gone long, apart long, kept long")
        found = met if found is None else found.unionByName(met)
    found = found.distinct()  # a link is found in each bucket that it has
    return found.withColumn("place", F.row_number().over(W.partitionBy("gone").orderBy("apart", "kept"))).where(F.col("place") <= most).drop("place")


def compared(pairs: DataFrame, docs: DataFrame, similarity: float, words: int) -> DataFrame:
    """pairs (staged: gone, apart, kept) and whether the texts are alike; an id of several texts is if all of them are.

    A text that many are compared with goes to as many parts of the join as that takes.
    """
    often = stage(pairs.groupBy("kept").agg(F.count(F.lit(1)).alias("n")), "compared-with")
    ids = stage(pairs.select(F.col("gone").alias("doc_id")).unionByName(often.select(F.col("kept").alias("doc_id"))).distinct(), "linked-ids")
    texts = stage(identified(docs).join(bounded(ids), "doc_id"), "linked-texts")
    parts = F.ceil(F.col("n") / LINKS_A_PART)
    dealt = joined_by_key(pairs, often, "kept", "n").withColumn("part", F.pmod(F.xxhash64("gone"), parts)).drop("n")
    of_kept = texts.join(often, F.col("doc_id") == F.col("kept")).select("kept", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("part"), F.col("text").alias("b"))
    both = dealt.join(texts.select(F.col("doc_id").alias("gone"), F.col("text").alias("a")), "gone").join(of_kept, ["kept", "part"]).select("gone", "apart", "kept", "a", "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            alike = []
            for a, b in zip(batch.column("a"), batch.column("b"), strict=True):
                one, other = (np.unique(np.array(hashes(t.as_py(), words), np.uint64)) for t in (a, b))
                shared = len(np.intersect1d(one, other, assume_unique=True))
                alike.append(shared >= similarity * (len(one) + len(other) - shared))
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("gone", "apart", "kept")] + [pa.array(alike, pa.bool_())], ["gone", "apart", "kept", "alike"])

    return both.mapInArrow(tidy(run), "gone long, apart long, kept long, alike boolean").groupBy("gone", "apart", "kept").agg(F.bool_and("alike").alias("alike"))


def unlike(docs: DataFrame, radius: int = RADIUS, words: int = SHINGLE_WORDS, similarity: float = SIMILARITY, similar_words: int = SIMILAR_WORDS) -> DataFrame:
    """The rows, with all their columns, that aren't near copies of a row of smaller doc_id.

    A document goes if the sets of shingles of its text and of a linked one's of smaller doc_id have a similarity of `similarity`
    or more, whether or not that one stays itself. Texts are linked if any of their PRINTS fingerprints lie within the radius, so
    links between equal fingerprints count like any others. Of equal sets only the smallest doc_id stays and stands for all. Each
    set that is left is compared with the first one of its first fingerprint, then with the linked set whose sketch is nearest,
    then with more of them, round after round, until one is alike or none is left. A pair whose sketches show that its similarity
    is less is left out before its texts are read; that loses no pair of this similarity.

    Texts without words are alike. Rows without a doc_id stay, and rows that repeat a doc_id stay or go together. Very long texts
    are compared whole. Columns may have any name. An empty table gives no row.
    """
    rows = stage(sketched(docs, words, similar_words).where("doc_id is not null"), "fingerprints")
    # Of an id's several texts any one will do, as all of them would have to be alike.
    ids = rows.groupBy("doc_id").agg(F.min(F.struct(*WHOLE, *PRINT, *SKETCH)).alias("own"), F.count(F.lit(1)).alias("texts")).select("doc_id", "texts", "own.*")
    sets = stage(ids.groupBy(*WHOLE, "size").agg(F.min(F.struct(F.col("doc_id").alias("id"), *PRINT, *SKETCH[1:])).alias("first"), F.count(F.lit(1)).alias("n")), "sets")
    of_set = F.xxhash64(*WHOLE, "size").alias("set")
    same = joined_by_key(ids.where("texts = 1").select("doc_id", of_set, *WHOLE, "size"), sets.select(of_set, *[F.col(c).alias(f"{c}_of") for c in (*WHOLE, "size")], F.col("first.id").alias("id"), "n"), "set", "n")
    equal = same.where(" and ".join(f"{c} = {c}_of" for c in (*WHOLE, "size"))).where("doc_id > id").select(F.col("doc_id").alias("gone"))
    several = ids.where("texts > 1").select(F.col("doc_id").alias("id"), "size", *PRINT, *SKETCH[1:])
    nodes = stage(sets.select("first.id", "size", *[F.col(f"first.{c}").alias(c) for c in (*PRINT, *SKETCH[1:])]).unionByName(several).dropDuplicates(["id"]), "sets-to-compare")
    gone = stage(equal, "equal-sets")
    # Where very many sets have one fingerprint, most are alike its first one, and needn't look for others.
    firsts = stage(nodes.groupBy(PRINT[0]).agg(F.min("id").alias("kept"), F.count(F.lit(1)).alias("n")), "first-sets")
    pairs = joined_by_key(nodes.select(F.col("id").alias("gone"), PRINT[0]), firsts, PRINT[0], "n").where("gone != kept").select("gone", F.lit(0).cast("long").alias("apart"), "kept")
    found = stage(compared(stage(pairs, "pairs"), docs, similarity, similar_words), "compared")
    settled, last, most = found.where("alike").select(F.col("gone").alias("id")), None, 1
    while True:
        gone = gone.unionByName(found.where("alike").select("gone"))
        if last is None:
            still = nodes.join(bounded(stage(settled, "settled")).withColumn("settled", F.lit(True)), "id", "left").select("*", F.col("settled").isNull().alias("looking"), F.lit(-1).cast("long").alias("after_apart"), F.lit(0).cast("long").alias("after_id"))
        else:
            seen = found.groupBy("gone").agg(F.bool_or("alike").alias("alike"), F.count(F.lit(1)).alias("n"), F.max(F.struct("apart", "kept")).alias("last"))
            unsettled = stage(seen.where(~F.col("alike") & (F.col("n") >= most)).select(F.col("gone").alias("id"), "last"), "unsettled")
            if not unsettled.take(1):
                return lacking(docs, stage(gone.distinct(), "near-copies"), [(F.col("doc_id").cast("long"), "gone")])
            most = LINKS_A_ROUND if most == 1 else max(most, min(4 * most, MOST_A_ROUND))
            still = nodes.join(bounded(unsettled), "id", "left").select("*", F.col("last").isNotNull().alias("looking"), F.coalesce("last.apart", F.lit(0)).alias("after_apart"), F.coalesce("last.kept", F.lit(0)).alias("after_id"))
        last = True
        found = stage(compared(stage(nearest_links(stage(still.drop("settled", "last"), "looking"), radius, most, similarity), "pairs"), docs, similarity, similar_words), "compared")


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = near_duplicates(documents(spark, sf_dir))
    return rows.select("doc_id", hexadecimal(F.col("fingerprint")).alias("fingerprint"), "component_id")
