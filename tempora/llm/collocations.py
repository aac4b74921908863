"""Phrase collocations by Suffix-sigma.

A phrase is a run of words inside a piece of text. Every position gives one suffix, the words from it on, cut off at the longest
phrase's length; suffixes are dealt by language and first word and sorted in reverse, so that one stack, whose levels are the
words of the suffix before, counts every prefix of every suffix, and so every phrase, in one pass. The counts of a phrase's parts
are counts of phrases as well, and are joined afterwards.

Of a phrase that is frequent enough all words that stand side by side are frequent pairs, and longer runs of its words are as
frequent. So these are counted first, pairs by hash and then runs of three words and more in a fixed number of buckets, and a
suffix ends before the first pair or run that isn't frequent: what is left out can't be part of a frequent phrase. All tasks know
what is frequent by two bitmaps of bounded size, which may let others through that the exact counts then leave out. Suffixes are
added up in their task before they are shuffled, in as many tasks as the cores want, however many partitions the texts have: the
rows sent so follow the frequent phrases, of which there are at most four for every min_count words. First words that would fill a task are dealt over several by the pair that they
begin, and pairs that would fill one by their whole suffix; the counts of such pairs are added up over the tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from tempora.llm.common import documents, joined_by_key, slices, small_batches, stage, tidy, whole_text

#: Words of the longest phrase, and how often a phrase must occur.
MAX_WORDS = 5
MIN_COUNT = 100
#: A phrase is dropped if a longer one around it has this share (of 100) of its occurrences.
COVERED = 100
#: Phrases returned of each language.
TOP = 2_000
#: The language of rows without one.
UNKNOWN = "und"
#: Bytes of text that are parsed at a time, and rows that a task adds up before it hands them on.
PARSED_BYTES, HELD_ROWS = 1 << 20, 1 << 19
#: Bits of the bitmap of frequent pairs: so many for each, between these; a pair sets several, at these shifts of its hash.
#: By a single bit, some hundredth of all pairs passed for frequent on a small corpus and more on a larger one: most of what was sent.
PAIR_BITS, LEAST_BITS, MOST_BITS, PAIR_SHIFTS = 32, 1 << 20, 1 << 28, (0, 18, 36)
#: Buckets in which triples and longer runs are counted, those of a row that is sent, and the parts in which tasks' counts are added up first.
TRIPLE_BUCKETS, SENT_BUCKETS, COUNT_PARTS = 1 << 22, 1 << 16, 64
#: Tasks that suffixes are added up in, for each core.
TASKS_A_CORE = 2
#: A first word is dealt over several tasks from this share of a task's words on.
FULL_TASK = 4
#: Parts that a language's phrases are ranked in, step by step.
RANK_PARTS = (1024, 32, 1)

_SPACES, _BREAKS, _UPPER = b" \t", b".,;:!?\n\x0b\x0c\r", range(ord("A"), ord("Z") + 1)
#: What a byte is: 0 part of a word, 1 between words, 2 between pieces; and the byte in lower case.
_KIND = np.array([1 if b in _SPACES else 2 if b in _BREAKS else 0 for b in range(256)], np.uint8)
_LOWER = np.array([b + 32 if b in _UPPER else b for b in range(256)], np.uint8)
#: A base for hashes of bytes, and the number that undoes a multiplication by it in 64 bits.
_DIGIT = np.uint64(0x2545F4914F6CDD1D)
_BACK = np.uint64(pow(0x2545F4914F6CDD1D, -1, 1 << 64))
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def byte_hashes(words: pa.BinaryArray) -> np.ndarray:
    """A hash of each word: its bytes as the digits of a number, taken from the sums over all words before it."""
    ends = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    data = np.frombuffer(words.buffers()[2], np.uint8)[ends[0] : ends[-1]] if len(words) else np.zeros(0, np.uint8)
    ends -= ends[0]
    powers = lambda x: np.cumprod(np.r_[np.uint64(1), np.full(len(data), x, np.uint64)], dtype=np.uint64)
    sums = np.r_[np.uint64(0), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(_DIGIT)[:-1], dtype=np.uint64)]
    out = (sums[ends[1:]] - sums[ends[:-1]]) * powers(_BACK)[ends[:-1]] + np.diff(ends).astype(np.uint64) * _ODD[2]
    return out ^ out >> np.uint64(31)


class Words:
    """The words of some texts: `names` (all different, with their language), `word` (a place in names for each word) and `near` (whether the next word is of the same piece)."""

    def __init__(self, texts: list[str], langs: list[str]):
        kinds = {lang: k for k, lang in enumerate(dict.fromkeys(langs))}
        encoded = [t.encode("utf-8", "surrogatepass") for t in texts]
        data = np.frombuffer(b"\n".join([*encoded, b""]), np.uint8)
        kind = _KIND[data]
        inside = kind == 0
        edges = np.diff(np.r_[np.int8(0), inside.view(np.int8)])
        starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
        piece = np.cumsum(kind == 2, dtype=np.int32)[starts]
        self.near = np.r_[piece[1:] == piece[:-1], np.zeros(min(1, len(piece)), bool)]
        ends_at = np.r_[0, np.cumsum(ends - starts)].astype(np.int32)
        spelled = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(ends_at), pa.py_buffer(_LOWER[data[inside]])]).dictionary_encode()
        first = np.cumsum([0, *[len(t) + 1 for t in encoded]])
        of_text = np.array([kinds[x] for x in langs], np.int64)
        lang = of_text[np.searchsorted(first, starts, "right") - 1] if len(starts) else np.zeros(0, np.int64)
        keys, self.word = np.unique(lang * max(1, len(spelled.dictionary)) + spelled.indices.to_numpy(), return_inverse=True)
        of_key, name = np.divmod(keys, max(1, len(spelled.dictionary)))
        of_lang = np.array([xxh64_intdigest(x.encode("utf-8", "surrogatepass"), 7) for x in kinds], np.uint64)
        self.hashes = (byte_hashes(spelled.dictionary)[name] + of_lang[of_key]) * _ODD[0] if len(name) else np.zeros(0, np.uint64)
        self.langs = pa.array(list(kinds), pa.string()).take(pa.array(of_key))
        self.names = spelled.dictionary.take(pa.array(name)).cast(pa.string())

    def __len__(self) -> int:
        return len(self.word)

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Where words stand side by side, and a hash of the language and both words for each such place."""
        at = np.flatnonzero(self.near)
        mixed = self.hashes[self.word[at]] ^ (self.hashes[self.word[at + 1]] + _ODD[1]) * _ODD[2]
        mixed ^= mixed >> np.uint64(29)
        return at, mixed * _ODD[1]

    def joined(self, frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each word whether it begins a pair that the bitmap has, and the hashes of the pairs."""
        at, pair = self.pairs()
        pairs = np.zeros(len(self), np.uint64)
        pairs[at] = pair
        out = np.zeros(len(self), bool)
        for shift in PAIR_SHIFTS:  # the first bit rules most out
            known = has(frequent, pair >> np.uint64(shift))
            at, pair = at[known], pair[known]
        out[at] = True
        return out, pairs

    def runs(self, joined: np.ndarray, pairs: np.ndarray, max_words: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For runs of three words, of four and so on: where all pairs are of the bitmap, and a hash for each such place."""
        at, mixed = np.flatnonzero(joined), pairs[joined]
        for k in range(1, max_words - 1):
            on = at + k < len(joined)
            on[on] = joined[at[on] + k]
            at = at[on]
            mixed = mixed[on] * _ODD[2] ^ pairs[at + k]
            mixed = (mixed ^ mixed >> np.uint64(32)) * _ODD[0]
            yield at, mixed >> np.uint64(20)

    def counts(self) -> pa.Table:
        """lang, phrase (the word) and n."""
        return pa.table({"lang": self.langs, "phrase": self.names, "n": np.bincount(self.word, minlength=len(self.names)).astype(np.int64)})

    def suffixes(self, frequent: np.ndarray, frequent_runs: np.ndarray, max_words: int) -> pa.Table:
        """lang, suffix (each word with a space behind it), first, pair (the hash of the first two words) and n of the different suffixes of two words or more; by the bitmaps of pairs and longer runs."""
        joined, pairs = self.joined(frequent)
        begin = np.flatnonzero(joined)
        longer = self.runs(joined, pairs, max_words)
        on, deep, ids = np.ones(len(begin), bool), [], self.word[begin]
        for k in range(max_words - 1):
            if k:
                at, run = next(longer)
                known = np.zeros(len(self), bool)
                known[at] = has(frequent_runs, run)
                if k > 1:  # so are the run without its last word and without its first
                    known &= before & np.r_[before[1:], False]
                on, before = known[begin], known
            word = np.where(on, self.word[np.minimum(begin + k + 1, len(self) - 1)], -1)
            deep.append(word)
            ids = np.unique(ids * np.int64(len(self.names) + 1) + word + 1, return_inverse=True)[1]
        _, one, n = np.unique(ids, return_index=True, return_counts=True)
        first = pa.array(self.word[begin][one])
        parts = [self.names.take(first), *[self.names.take(pa.array(w[one], pa.int64(), mask=w[one] < 0)) for w in deep]]
        suffix = pc.binary_join_element_wise(*parts, " ", null_handling="skip")
        return pa.table({"lang": self.langs.take(first), "suffix": pc.binary_join_element_wise(suffix, "", " "), "first": parts[0], "pair": pairs[begin][one].view(np.int64), "n": n.astype(np.int64)})


def has(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether the bit of each hash is set; a bitmap has a power of two of words of 64 bits."""
    bit = hashes & np.uint64(len(bitmap) * 64 - 1)
    return (bitmap[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63)) & np.uint64(1)).astype(bool)


def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[Words]:
    for batch in batches:
        for part in slices(batch, limit=PARSED_BYTES):
            yield Words(part.column("text").to_pylist(), part.column("lang").to_pylist())


class Sums:
    """Tables' rows with n added up for equal keys, as far as a task holds them; what it doesn't hold comes back as batches."""

    def __init__(self, keys: list[str], held_rows: int = HELD_ROWS):
        self.keys, self.held_rows, self.held, self.rows = keys, held_rows, [], 0

    def add(self, table: pa.Table) -> list[pa.RecordBatch]:
        self.held.append(table)
        self.rows += table.num_rows
        if self.rows < self.held_rows:
            return []
        total, gone = self._total(), []
        if 2 * total.num_rows >= self.held_rows:  # what has come most often stays
            order = np.argsort(-total.column("n").to_numpy(), kind="stable")
            keep = self.held_rows // 4
            gone, total = total.take(order[keep:]).to_batches(), total.take(order[:keep])
        self.held, self.rows = [total], total.num_rows
        return gone

    def rest(self) -> list[pa.RecordBatch]:
        return self._total().to_batches() if self.held else []

    def _total(self) -> pa.Table:
        joined, self.held, self.rows = pa.concat_tables(self.held), [], 0
        return joined.group_by(self.keys, use_threads=False).aggregate([("n", "sum")]).select([*self.keys, "n_sum"]).rename_columns([*self.keys, "n"])


def spoken(docs: DataFrame) -> DataFrame:
    """Only text and lang, neither null."""
    small_batches(docs.sparkSession)
    return docs.select(whole_text().alias("text"), F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN)).alias("lang"))


def words_and_pairs(texts: DataFrame) -> DataFrame:
    """lang, phrase and n of every word; and pair (a hash) and n of all words that stand side by side."""

    def of_words(found: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in found:
            yield pa.RecordBatch.from_arrays([b.column("lang"), b.column("phrase"), pa.nulls(len(b), pa.int64()), b.column("n")], ["lang", "phrase", "pair", "n"])

    def of_pairs(found: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in found:
            none = pa.nulls(len(b), pa.string())
            yield pa.RecordBatch.from_arrays([none, none, b.column("pair"), b.column("n")], ["lang", "phrase", "pair", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, side_by_side = Sums(["lang", "phrase"]), Sums(["pair"])
        for words in parsed(batches):
            yield from of_words(own.add(words.counts()))
            pair, n = np.unique(words.pairs()[1].view(np.int64), return_counts=True)
            yield from of_pairs(side_by_side.add(pa.table({"pair": pair, "n": n.astype(np.int64)})))
        yield from of_words(own.rest())
        yield from of_pairs(side_by_side.rest())

    return texts.mapInArrow(tidy(run), "lang string, phrase string, pair long, n long")


def bitmap(keys: DataFrame, key: str, n: int) -> np.ndarray:
    """Bits for each of the keys, at PAIR_SHIFTS, in words of 64: of bounded size, whatever n, the number of keys, is."""
    bits = LEAST_BITS
    while bits < min(MOST_BITS, PAIR_BITS * n):
        bits *= 2
    places = F.array(*[F.shiftrightunsigned(key, s).bitwiseAND(F.lit(bits - 1).cast("long")) for s in PAIR_SHIFTS])
    words = keys.select(F.explode(places).alias("place")).select(F.shiftright("place", 6).alias("word"), F.expr("shiftleft(1L, cast(place & 63 as int))").alias("bits")).groupBy("word").agg(F.bit_or("bits").alias("bits"))
    out = np.zeros(bits // 64, np.int64)
    found = words.toPandas()  # at most MOST_BITS / 64 rows
    out[found["word"].to_numpy(int)] = found["bits"].to_numpy(np.int64)
    return out.view(np.uint64)


def frequent_triples(texts: DataFrame, pairs: np.ndarray, min_count: int, max_words: int = 3) -> np.ndarray:
    """The bitmap of the buckets that have min_count triples of frequent pairs, or longer runs of up to max_words words.

    Counts beyond min_count are sent as min_count, and added up over parts of the tasks first, so a row is a byte a bucket and no
    task reads more rows than there are parts, or tasks in a part.
    """
    kind, size = (np.uint8 if min_count < 256 else np.uint32), min(SENT_BUCKETS, TRIPLE_BUCKETS)
    schema = ["chunk", "part", "counts"]

    def batch_of(chunks: dict[int, np.ndarray], part: int) -> pa.RecordBatch:
        sent = [np.minimum(c, min_count).astype(kind).tobytes() for c in chunks.values()]
        return pa.RecordBatch.from_arrays([pa.array(list(chunks), pa.int32()), pa.array([part] * len(sent), pa.int32()), pa.array(sent, pa.binary())], schema)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(TRIPLE_BUCKETS, np.int32)
        for words in parsed(batches):
            for _, run in words.runs(*words.joined(pairs), max_words):
                bucket, n = np.unique(run & np.uint64(TRIPLE_BUCKETS - 1), return_counts=True)
                counts[bucket.astype(np.int64)] += n.astype(np.int32)
        chunks = counts.reshape(-1, size)
        yield batch_of({k: chunks[k] for k in np.flatnonzero(chunks.any(1)).tolist()}, TaskContext.get().partitionId() % COUNT_PARTS)

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks: dict[int, np.ndarray] = {}
        for b in batches:
            for k, sent in zip(b.column("chunk").to_pylist(), b.column("counts").to_pylist(), strict=True):
                chunks[k] = np.minimum(np.frombuffer(sent, kind).astype(np.int64) + chunks.get(k, 0), min_count)
        yield batch_of(chunks, 0)

    shape = "chunk int, part int, counts binary"
    sums = texts.mapInArrow(tidy(counted), shape).repartition("chunk", "part").mapInArrow(tidy(added), shape).repartition("chunk").mapInArrow(tidy(added), shape)
    out = np.zeros(TRIPLE_BUCKETS, bool)
    for row in sums.toLocalIterator():  # a byte a bucket, whatever the corpus holds
        out[row["chunk"] * size : (row["chunk"] + 1) * size] = np.frombuffer(row["counts"], kind) >= min_count
    return np.packbits(out, bitorder="little").view(np.uint64)


def prefixes(rows: Iterator[tuple[str, str, int, bool]], min_count: int) -> Iterator[tuple[str, str, int, int]]:
    """lang, phrase, its number of words and n of every prefix of two words or more of the suffixes, which are sorted in reverse.

    rows: lang, suffix, n and whether all suffixes that begin with its first two words are here; if so, phrases under min_count are left out.
    """
    of, whole = None, True
    words: list[str] = []  # of the suffix before, and how often the prefixes that end with them have been seen
    seen: list[int] = []

    def down_to(depth: int) -> Iterator[tuple[str, str, int, int]]:
        while len(seen) > depth:
            n = seen.pop()
            if len(seen) and (n >= min_count or not whole):
                yield of, " ".join(words[: len(seen) + 1]), len(seen) + 1, n
            if seen:
                seen[-1] += n
            words.pop()

    for lang, suffix, n, all_here in rows:
        own, same = suffix[:-1].split(" "), 0
        if lang == of:
            for a, b in zip(own, words, strict=False):
                if a != b:
                    break
                same += 1
        yield from down_to(same)
        of, whole = lang, all_here  # the same for all suffixes of a pair; the count of a first word alone isn't used
        words += own[same:]
        seen += [0] * (len(own) - same)
        seen[-1] += n
    yield from down_to(0)


def full_keys(counts: DataFrame, keys: list[str], fill: int) -> dict:
    """The keys of which there are so many that they are dealt over several tasks, and over how many: at most FULL_TASK for each partition."""
    return {tuple(r[k] for k in keys): r["n"] // fill + 1 for r in counts.where(F.col("n") >= fill).toLocalIterator()}


def suffixes(texts: DataFrame, known: np.ndarray, runs: np.ndarray, max_words: int, full: dict, full_pairs: dict) -> DataFrame:
    """lang, suffix, first and n of the suffixes, with the part of their first word and the number of parts of their pair. A task adds up over several partitions of the texts: what is frequent is in all of them, and each would send it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = Sums(["lang", "suffix", "first", "pair"])

        def dealt(found: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in found:
                rows = list(zip(b.column("lang").to_pylist(), b.column("first").to_pylist(), b.column("pair").to_pylist(), strict=True))
                over = [full_pairs.get((pair,), 1) for _, _, pair in rows]
                part = [pair % full.get((lang, first), 1) for lang, first, pair in rows]
                yield pa.RecordBatch.from_arrays([b.column("lang"), b.column("suffix"), b.column("first"), b.column("n"), pa.array(part, pa.int64()), pa.array(over, pa.int64())], ["lang", "suffix", "first", "n", "part", "over"])

        for words in parsed(batches):
            yield from dealt(sums.add(words.suffixes(known, runs, max_words)))
        yield from dealt(sums.rest())

    few = texts.coalesce(TASKS_A_CORE * texts.sparkSession.sparkContext.defaultParallelism)
    return few.mapInArrow(tidy(run), "lang string, suffix string, first string, n long, part long, over long")


def phrases(docs: DataFrame, max_words: int = MAX_WORDS, min_count: int = MIN_COUNT) -> tuple[DataFrame, DataFrame]:
    """lang, phrase, words and n (staged) of all phrases of up to max_words words that occur min_count times in their language; and the number n of words of each lang.

    Letters A to Z are lower-cased. Pieces end at any of ".,;:!?" and U+000A to U+000D, words at space and tab. Occurrences overlap
    freely, and repeated rows count each. Null and empty texts have no words; a null lang is UNKNOWN; a very long text is read
    whole, and a piece of any length may be one word. Only text and lang are read, so other columns may have any name. An empty
    table gives no row.
    """
    texts = spoken(docs)
    counted = stage(words_and_pairs(texts).groupBy("lang", "phrase", "pair").agg(F.sum("n").alias("n")), "words-and-pairs")
    words = counted.where("pair is null").select("lang", "phrase", "n")
    totals = stage(words.groupBy("lang").agg(F.sum("n").alias("n")), "word-totals")
    pairs = counted.where(F.col("pair").isNotNull() & (F.col("n") >= min_count)).select("pair", "n")
    known = bitmap(pairs, "pair", pairs.count())
    runs = frequent_triples(texts, known, min_count, max_words)
    fill = max(1, (words.agg(F.sum("n")).first()[0] or 0) // (FULL_TASK * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    full, full_pairs = full_keys(words, ["lang", "phrase"], fill), full_keys(pairs, ["pair"], fill)

    def stacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for b in batches for row in zip(b.column("lang").to_pylist(), b.column("suffix").to_pylist(), b.column("n").to_pylist(), pc.equal(b.column("over"), 1).to_pylist(), strict=True))
        held: list[tuple] = []
        for row in prefixes(rows, min_count):
            held.append(row)
            if len(held) >= 10_000:
                yield _phrase_batch(held)
                held = []
        yield _phrase_batch(held)

    # A first word that would fill a task is dealt by the pair that it begins, and such a pair by the whole suffix.
    dealt = suffixes(texts, known, runs, max_words, full, full_pairs).withColumn("suffix_part", F.pmod(F.xxhash64("suffix"), F.col("over")))
    ordered = dealt.repartition("lang", "first", "part", "suffix_part").sortWithinPartitions("lang", F.desc("suffix")).select("lang", "suffix", "n", "over")
    # Prefixes of pairs that several tasks have are added up; the others are whole, and only those that are frequent come here.
    found = ordered.mapInArrow(tidy(stacked), "lang string, phrase string, words int, n long").groupBy("lang", "phrase", "words").agg(F.sum("n").alias("n"))
    single = words.select("lang", "phrase", F.lit(1).alias("words"), "n")
    return stage(found.unionByName(single).where(F.col("n") >= min_count), "phrases"), totals


def _phrase_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int32(), pa.int64()), strict=True)], ["lang", "phrase", "words", "n"])


def key_of(phrase: Column) -> Column:
    """One column for a phrase and its lang: no word has a line feed."""
    return F.concat(phrase, F.lit("\n"), F.col("lang"))


def words_of(phrase: str, k: Column) -> Column:
    """The first k words of a phrase, or its last -k."""
    return F.call_function("substring_index", F.col(phrase), F.lit(" "), k)


def scored(found: DataFrame, totals: DataFrame, min_count: int = MIN_COUNT, covered: int = COVERED) -> DataFrame:
    """lang, phrase, a, l, r, n, score of the phrases of two words or more that no longer one covers.

    The score is that of the lowest cut into two parts, of equal ones the first. found and totals are those of phrases().
    """
    many = found.where("words > 1").withColumn("key", key_of(F.col("phrase")))
    # Around a phrase, one longer by one word has as many occurrences as any longer still.
    inner = many.where("words > 2").select("n", "lang", F.explode(F.array(words_of("phrase", F.col("words") - 1), words_of("phrase", 1 - F.col("words")))).alias("inner"))
    around = inner.groupBy(key_of(F.col("inner")).alias("key")).agg(F.max("n").alias("around"))
    left = many.join(around, "key", "left").where(F.col("around").isNull() | (F.col("around") * 100 < F.col("n") * covered)).select("lang", "phrase", "words", "key", F.col("n").alias("a"))
    cut = F.explode(F.transform(F.sequence(F.lit(1), F.col("words") - 1), lambda k: F.struct(k.alias("k"), key_of(words_of("phrase", k)).alias("l"), key_of(words_of("phrase", k - F.col("words"))).alias("r"))))
    cuts = stage(left.select("lang", "phrase", "key", "a", cut.alias("cut")).select("lang", "phrase", "key", "a", "cut.*"), "cuts")
    # Each longer phrase has min_count occurrences of its part, so a part with n is joined with at most this many rows.
    parts = stage(found.select(key_of(F.col("phrase")).alias("part"), F.col("n").alias("f"), F.ceil(F.col("n") * F.lit(4 / min_count)).alias("rows")), "parts")
    for side in ("l", "r"):
        cuts = stage(joined_by_key(cuts.withColumnRenamed(side, "part"), parts, "part", "rows").withColumnRenamed("f", side).drop("part", "rows"), "cuts")
    whole = joined_by_key(cuts, totals, "lang", "n")
    a, n, l, r = (f"cast({c} as decimal(19,0))" for c in ("a", "n", "l", "r"))  # products pass 64 bits
    score = F.expr(f"(cast(1000 as decimal(4,0)) * {a} * {n}) div ({l} * {r})")
    best = whole.withColumn("score", score).groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("best"))
    return best.select("lang", "phrase", "a", "best.l", "best.r", "n", "best.score")


def first_of(rows: DataFrame, group: str, order: list[Column], key: str, k: int, rank: str) -> DataFrame:
    """The first k rows of each group and their rank from 1. Groups are cut into fewer and fewer parts, of which each keeps its first k."""
    for parts in RANK_PARTS:
        place = F.row_number().over(W.partitionBy(group, F.pmod(F.xxhash64(key), F.lit(parts))).orderBy(*order))
        rows = rows.withColumn(rank, place.cast("long")).where(F.col(rank) <= k)
    return rows


def collocations(docs: DataFrame, max_words: int = MAX_WORDS, min_count: int = MIN_COUNT, top: int = TOP, covered: int = COVERED) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first phrases of each lang by score, then by a (both descending), then by their bytes.

    A phrase goes if one word more on either side has as many occurrences. For odd rows see phrases().
    """
    found, totals = phrases(docs, max_words, min_count)
    rows = stage(scored(found, totals, min_count, covered), "scored")
    ranked = first_of(rows, "lang", [F.desc("score"), F.desc("a"), F.col("phrase")], "phrase", top, "rank")
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(documents(spark, sf_dir))


_CUTS = f"""SELECT c.lang, c.words, c.f AS a, k, l.f AS l, r.f AS r FROM (SELECT *, unnest(range(1, len(words))) AS k FROM left_over) c
        JOIN phrases l ON l.lang = c.lang AND l.words = c.words[1:c.k] JOIN phrases r ON r.lang = c.lang AND r.words = c.words[c.k + 1:]"""
ORACLE_SQL = f"""WITH d AS (SELECT coalesce(lang, '{UNKNOWN}') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
    pieces AS (SELECT lang, unnest(string_split_regex(text, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM d),
    w AS (SELECT lang, list_filter(string_split_regex(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS words FROM pieces),
    totals AS (SELECT lang, sum(len(words))::BIGINT AS n FROM w GROUP BY lang),
    starts AS (SELECT lang, words, unnest(range(1, len(words) + 1)) AS i FROM w),
    suffixes AS (SELECT lang, words[i:i + {MAX_WORDS - 1}] AS suffix FROM starts),
    prefixes AS (SELECT lang, suffix, unnest(range(1, len(suffix) + 1)) AS k FROM suffixes),
    phrases AS (SELECT lang, suffix[1:k] AS words, count(*) AS f FROM prefixes GROUP BY ALL HAVING count(*) >= {MIN_COUNT}),
    candidates AS (SELECT * FROM phrases WHERE len(words) > 1),
    inner_runs AS (SELECT lang, f, words, unnest(range(2, len(words))) AS size FROM candidates),
    inner_places AS (SELECT lang, f, words, size, unnest(range(1, len(words) - size + 2)) AS i FROM inner_runs),
    covers AS (SELECT lang, words[i:i + size - 1] AS words, max(f) AS around FROM inner_places GROUP BY ALL),
    left_over AS (SELECT c.* FROM candidates c LEFT JOIN covers o ON c.lang = o.lang AND c.words = o.words WHERE o.around IS NULL OR 100 * o.around < {COVERED} * c.f),
    cuts AS ({_CUTS}),
    scored AS (SELECT lang, words, a, k, l, r, n, ((1000::HUGEINT * a * n) // (l::HUGEINT * r))::BIGINT AS score FROM cuts JOIN totals USING (lang)),
    best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, words ORDER BY score, k) = 1),
    ranked AS (SELECT *, array_to_string(words, ' ') AS phrase, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(words, ' ')) AS rank FROM best)
    SELECT lang, rank, phrase, a, l, r, n, score FROM ranked WHERE rank <= {TOP}"""
