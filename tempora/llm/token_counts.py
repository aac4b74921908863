"""Token counts that follow edits without counting a text anew.

A document is held as a segment tree over its pre-token runs: a leaf is the characters from one white-space boundary to the
next, which no pre-token, merge or normalisation crosses, with its number of characters and tokens; inner nodes hold the sums.
An edit finds its leaves by going down the character sums, joins the text of those it touches and of one neighbour on a side
where it reaches their edge (the boundary context), cuts and encodes that text alone, and puts the new leaves into the place of
the old ones; sums change only on the paths above them.

trees() encodes texts once and gives a table of leaves, to be stored. apply() takes such a table and edits, encodes nothing but
what they touch, and gives the table as it is afterwards, for the edits of another day.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tempora.llm.bpe import CACHE_BYTES, CHARACTERS_AT_ONCE, chunk_cache, codec, default_vocabulary, different, joined_chunks
from tempora.llm.common import documents, identified, slices, small_batches, stage, whole_text

EDITS = "array<struct<start:long,end:long,replacement:string>>"
#: Bytes of a generation of the cache of chunks.
TREE_CACHE_BYTES = CACHE_BYTES * 3 // 4
#: Trees of so few leaves are summed up number by number.
FEW_LEAVES = 32
#: A stored tree: the text, and characters and tokens of each leaf.
TREE = "doc_id long, text string, characters array<int>, tokens array<int>"

#: A leaf: characters up to white space and that white space; control characters that only Python counts as white space belong to the former.
_LEAF = re.compile("[\\S\x1c-\x1f]+[^\\S\x1c-\x1f]*|[^\\S\x1c-\x1f]+")
#: Whether each character up to the last white one is white space, in that sense.
_WHITE = np.array([chr(c).isspace() and not 0x1C <= c <= 0x1F for c in range(0x3001)])


def cut(text: str) -> list[str]:
    """The leaves of a text."""
    return _LEAF.findall(text)


def leaf_lengths(text: str) -> np.ndarray:
    """The number of characters of each leaf of a text."""
    if text.isascii():
        white = _WHITE[np.frombuffer(text.encode("ascii"), np.uint8)]
    else:
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
        white = _WHITE[np.minimum(codes, len(_WHITE) - 1)] & (codes < len(_WHITE))
    starts = np.flatnonzero(white[:-1] & ~white[1:]) + 1
    return np.diff(starts, prepend=0, append=len(text)).astype(np.int32) if text else np.zeros(0, np.int32)


def leaf_counts(path: str, texts: list[str], lengths: list[np.ndarray]) -> list[np.ndarray]:
    """The number of tokens of each leaf. A leaf is one chunk of the encoding with the white space behind it, or white space that begins a text."""
    found = chunk_cache(path, TREE_CACHE_BYTES).values(list(map(codec(path).chunks, texts)))
    counts = []
    for ids, own in zip(found, lengths, strict=True):
        n = np.zeros(len(own), np.int32)
        n[len(own) - len(ids) :] = np.fromiter(map(len, ids), np.int32, len(ids)) // 4
        counts.append(n)
    return counts


def leaves(path: str, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The number of leaves of each text, and characters and tokens of all of them. Each different chunk of the texts is looked up once, and numpy puts its count in every place."""
    if max(map(len, texts), default=0) > CHARACTERS_AT_ONCE:
        lengths = list(map(leaf_lengths, texts))
        return np.array(list(map(len, lengths))), np.concatenate(lengths), np.concatenate(leaf_counts(path, texts, lengths))
    data, begins, starts, chunks = joined_chunks(texts)
    (ids,) = chunk_cache(path, TREE_CACHE_BYTES).values([different(chunks)])
    tokens = np.fromiter(map(len, ids), np.int32, len(ids)) // 4
    begin = np.zeros(len(data) + 1, bool)  # of a leaf, or of a text
    begin[starts] = begin[begins] = True
    at = np.flatnonzero(begin)
    counts = np.zeros(len(at), np.int32)
    counts[np.searchsorted(at, starts)] = tokens[chunks.indices.to_numpy()]
    characters = np.diff(at if data.max(initial=0) < 128 else np.r_[0, np.cumsum(data & 0xC0 != 0x80)][at])
    first = np.searchsorted(at, begins)
    characters[first[1:] - 1] -= 1  # the line feed behind a text
    full = characters > 0  # an empty text has no leaf
    return np.diff(np.r_[0, np.cumsum(full)][first]), characters[full].astype(np.int32), counts[:-1][full]


class SegmentTree:
    """Sums of characters and tokens over leaves; a leaf that an edit has made several of holds a tree of its own."""

    def __init__(self, path: str, text: str, characters: Sequence[int], tokens: Sequence[int]):
        self.path, self.source, self.n, self.encoded = path, text, len(characters), 0
        self.width = 1 << max(0, self.n - 1).bit_length()
        self.built = characters, tokens
        self.sums = tuple(map(self.summed, self.built))
        self.starts = list(itertools.accumulate(characters, initial=0)) if self.n <= FEW_LEAVES else np.concatenate([[0], np.cumsum(characters, dtype=np.int64)])  # of the leaves as they were built
        self.changed: dict[int, str] = {}
        self.grown: dict[int, SegmentTree] = {}

    def summed(self, leaves: Sequence[int]) -> list[int]:
        """The sums of all nodes; the leaves are the last `width` of them."""
        width = self.width
        if self.n <= FEW_LEAVES:
            sums = [0] * width + list(leaves) + [0] * (width - self.n)
            for node in range(width - 1, 0, -1):
                sums[node] = sums[2 * node] + sums[2 * node + 1]
            return sums
        level = np.zeros(width, np.int64)
        level[: self.n] = leaves
        levels = [level]
        while len(level) > 1:
            level = level[::2] + level[1::2]
            levels.append(level)
        return np.concatenate([[0], *levels[::-1]]).tolist()

    @classmethod
    def of(cls, path: str, text: str) -> SegmentTree:
        """The tree of a text, all of whose leaves are encoded."""
        chunks, lengths = codec(path).chunks(text), list(map(len, cut(text)))
        cache = chunk_cache(path, TREE_CACHE_BYTES)
        found = list(map(cache.young.get, chunks))
        if None in found:
            found = cache.values([chunks])[0]
        tree = cls(path, text, lengths, [0] * (len(lengths) - len(chunks)) + [len(ids) // 4 for ids in found])
        tree.encoded = len(lengths)
        return tree

    @property
    def characters(self) -> int:
        return self.sums[0][1]

    @property
    def tokens(self) -> int:
        return self.sums[1][1]

    def leaf_at(self, place: int) -> tuple[int, int]:
        """The leaf that holds the character at this place, and where the leaf begins."""
        node, begin, characters = 1, 0, self.sums[0]
        while node < self.width:
            node *= 2
            left = characters[node]
            if place - begin >= left:
                begin += left
                node += 1
        return node - self.width, begin

    def text_of(self, leaf: int) -> str:
        if leaf in self.grown:
            return self.grown[leaf].text()
        return self.changed[leaf] if leaf in self.changed else self.source[self.starts[leaf] : self.starts[leaf + 1]]

    def parts(self) -> Iterator[tuple[str, Sequence[int], Sequence[int]]]:
        """Stretches of the text with characters and tokens of their leaves: what edits have changed, and what lies between."""
        at, (characters, tokens) = 0, self.built
        for leaf in sorted(self.changed.keys() | self.grown.keys()):
            if leaf > at:
                yield self.source[self.starts[at] : self.starts[leaf]], characters[at:leaf], tokens[at:leaf]
            if leaf in self.grown:
                yield from self.grown[leaf].parts()
            elif self.changed[leaf]:
                yield self.changed[leaf], [self.sums[0][self.width + leaf]], [self.sums[1][self.width + leaf]]
            at = leaf + 1
        if at < self.n:
            yield self.source[self.starts[at] :], characters[at:], tokens[at:]

    def text(self) -> str:
        return "".join([t for t, *_ in self.parts()])

    def update(self, leaf: int, *values: int) -> None:
        """Sets characters and tokens of a leaf, and the sums above it."""
        for sums, value in zip(self.sums, values, strict=True):
            node = self.width + leaf
            change = value - sums[node]
            while change and node:
                sums[node] += change
                node //= 2

    def edit(self, start: int, end: int, replacement: str) -> None:
        """Replaces the characters from start up to end; places beyond the text are moved to its end."""
        start = min(max(0, start), self.characters)
        end = min(max(start, end), self.characters)
        if not self.characters:
            before = self.encoded
            self.__dict__.update(SegmentTree.of(self.path, replacement).__dict__)
            self.encoded += before
            return
        first, begin = self.leaf_at(max(0, start - 1))  # also the leaf that the edit touches with its left edge
        last, at = self.leaf_at(min(end, self.characters - 1))  # and with its right edge
        if first == last and first in self.grown:
            inner = self.grown[first]
            before = inner.encoded
            inner.edit(start - begin, end - begin, replacement)
            self.encoded += inner.encoded - before
            self.update(first, inner.characters, inner.tokens)
            return
        old = "".join(map(self.text_of, range(first, last + 1)))
        new = SegmentTree.of(self.path, old[: start - begin] + replacement + old[end - begin :])
        self.encoded += new.n
        for leaf in range(first, last + 1):
            self.grown.pop(leaf, None)
            self.changed[leaf] = ""
            if leaf > first:
                self.update(leaf, 0, 0)
        if new.n > 1:
            self.grown[first] = new
        else:
            self.changed[first] = new.source
        self.update(first, new.characters, new.tokens)


def _table(ids: pa.Array, texts: pa.Array, n_leaves: Sequence[int], characters: np.ndarray, tokens: np.ndarray) -> list[pa.Array]:
    """The columns of TREE; characters and tokens are those of all leaves."""
    offsets = pa.array(np.r_[0, np.cumsum(n_leaves)], pa.int32())
    return [ids, texts, *[pa.ListArray.from_arrays(offsets, pa.array(x, pa.int32())) for x in (characters, tokens)]]


def trees(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """The stored tree (TREE) of each row's whole text.

    Null texts count as empty and have no leaves; repeated rows are each returned; a very long text is a row like any other, and
    nothing is compared, so there are no ties. Only doc_id and text are read, so other columns may have any name. An empty table
    gives no row.
    """
    path = vocabulary or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                yield pa.RecordBatch.from_arrays(_table(part.column("doc_id"), part.column("text"), *leaves(path, part.column("text").to_pylist())), ["doc_id", "text", "characters", "tokens"])

    return identified(docs).mapInArrow(run, TREE)


def with_edits(stored: DataFrame, edits: DataFrame) -> DataFrame:
    """Stored trees with the edits of each doc_id (columns doc_id, seq, start, end, replacement) in the order of seq; edits of other ids are left out."""
    lists = edits.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("seq", "start", "end", "replacement"))).alias("edits"))
    lists = lists.select("doc_id", F.transform("edits", lambda e: F.struct(e["start"].cast("long").alias("start"), e["end"].cast("long").alias("end"), e["replacement"].alias("replacement"))).alias("edits"))
    return stored.select("doc_id", "text", "characters", "tokens").join(lists, "doc_id", "left")


def apply(edited: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """The stored trees after the edits that stand beside them (column `edits`, EDITS), n_tokens and n_leaves before, and encoded_leaves, what was encoded for it.

    A row's edits are applied one after another, each in the characters that the one before left. Null edits are none, a null
    place is 0, a null replacement the empty one. Repeated rows are each edited. An empty table gives no row.
    """
    path = vocabulary or default_vocabulary()
    small_batches(edited.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                texts, n_leaves, characters, tokens, told = [], [], [], [], []
                columns = part.column("characters"), part.column("tokens")
                for row, (text, edits) in enumerate(zip(part.column("text").to_pylist(), part.column("edits").to_pylist(), strict=True)):
                    tree = SegmentTree(path, text, *[c[row].values.to_numpy() for c in columns])
                    before = tree.tokens, tree.n
                    for e in edits or ():
                        tree.edit(e["start"] or 0, e["end"] or 0, e["replacement"] or "")
                    parts = list(tree.parts())
                    texts.append("".join([p[0] for p in parts])), told.append((*before, tree.encoded))
                    characters += [p[1] for p in parts]
                    tokens += [p[2] for p in parts]
                    n_leaves.append(sum([len(p[1]) for p in parts]))
                own = [np.concatenate([np.zeros(0, np.int32), *x]) for x in (characters, tokens)]
                more = [pa.array(c, pa.int64()) for c in zip(*told, strict=True)]
                yield pa.RecordBatch.from_arrays([*_table(part.column("doc_id"), pa.array(texts, pa.string()), n_leaves, *own), *more], ["doc_id", "text", "characters", "tokens", "n_tokens", "n_leaves", "encoded_leaves"])

    return edited.select("doc_id", "text", "characters", "tokens", F.col("edits").cast(EDITS).alias("edits")).mapInArrow(run, TREE + ", n_tokens long, n_leaves long, encoded_leaves long")


def total(leaves: str) -> Column:
    """The sum over the leaves of a stored tree."""
    return F.aggregate(leaves, F.lit(0).cast("long"), lambda a, x: a + x)


def revision(docs: DataFrame) -> DataFrame:
    """Every document with four edits that its length decides: words go in near the start, a stretch in the middle goes, characters at three quarters are replaced, and a sentence is added."""
    n = F.char_length(whole_text()).cast("long")
    quarter, half = F.floor(n / 4), F.floor(n / 2)
    steps = [(quarter, quarter, F.lit("nota bene: ")), (half, half + 12, F.lit("")), (quarter * 3, quarter * 3 + 5, F.lit("42%")), (n + 100, n + 100, F.lit(" It isn't so."))]
    return docs.withColumn("edits", F.array(*[F.struct(a.cast("long").alias("start"), b.cast("long").alias("end"), r.alias("replacement")) for a, b, r in steps]))


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of the stored trees of all documents, before and after a round of edits."""
    stored = stage(trees(documents(spark, sf_dir)), "trees")
    done = apply(revision(stored))
    return done.select("doc_id", "n_tokens", total("tokens").alias("edited_tokens"), "n_leaves", "encoded_leaves", total("characters").alias("edited_characters"))
