"""BPE encoding and decoding by forced-boundary splitting.

A byte pair that occurs inside no vocabulary token can never be joined by a merge, so a text may be cut there and the
fragments encoded apart. White space is such a boundary for this vocabulary (no token holds it, and neither normalisation
nor a pre-token crosses it), so a text is first cut into chunks at white space; a chunk is cut into pre-tokens and each of
those at its forced byte pairs. Fragments go through the library's merge rules; their ids are concatenated. What a short
chunk encodes to is kept in a cache of bounded bytes, as most chunks come again and again.

Null and empty texts have no ids and decode to the empty text.
"""

from __future__ import annotations

import gc
import itertools
import json
import re
import sys
import unicodedata
from array import array
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from itertools import compress
from operator import not_

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempora.llm.common import identified, slices

#: Bytes of a generation of the chunk cache, of which two are held; the cache of pre-tokens below it takes half as much.
CACHE_BYTES = 128 << 20
#: Longer chunks are encoded whenever they come and never kept.
KEPT_CHARACTERS = 64
#: A dictionary's share of an entry, in bytes.
ENTRY_BYTES = 104
#: Pre-tokens of one chunk that are encoded together.
PRETOKENS_AT_ONCE = 50_000
#: Characters of one text that are cut into chunks together.
CHARACTERS_AT_ONCE = 1 << 21

#: What the tokenizer's `\s` matches. str.split() cuts at four control characters besides.
_WHITE = regex.compile(r"\p{White_Space}+")
_SPLIT_MORE = re.compile("[\x1c-\x1f]")
#: White space beyond ASCII, and whether a byte is white space by itself.
_OTHER_WHITE = re.compile("[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_WHITE_BYTE = np.array([b in b"\t\n\x0b\x0c\r " for b in range(256)])


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_alphabet() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary, turned round: printable bytes stand for themselves, the others follow from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


def packed(ids: list[int]) -> bytes:
    """Little-endian unsigned 32-bit integers."""
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


class Codec:
    """Encodes and decodes as the tokenizer file says; without special tokens added, truncation or padding."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer, models, pre_tokenizers

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab, merges = model["vocab"], [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.suffix = model.get("end_of_word_suffix") or ""
        if not self.suffix:
            raise ValueError("the vocabulary has no mark for the end of a word")
        splits = [p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"]
        self.pretoken = regex.compile(splits[0]["pattern"]["Regex"])
        self.pretoken_or_end = regex.compile("\n|" + splits[0]["pattern"]["Regex"])
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.added_pattern = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")")
        self.added_start = re.compile("|".join({re.escape(t[:2]) for t in self.added}))
        self.inner = models.BPE(vocab, merges)  # of a fragment that doesn't end its pre-token
        self.last = Tokenizer(models.BPE(vocab, merges, end_of_word_suffix=self.suffix))
        self.last.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.tokens = {i: t for t, i in vocab.items()} | {i: t for t, i in self.added.items()}
        self.ends_word = np.array([self.tokens.get(i, "").endswith(self.suffix) for i in range(max(self.tokens) + 1)])
        self.byte_of = byte_alphabet()
        self.char_of = {b: c for c, b in self.byte_of.items()}
        joined = np.zeros((256, 256), bool)
        for token in vocab:
            inner = token[: -len(self.suffix)] if self.suffix and token.endswith(self.suffix) and token != self.suffix else token
            codes = [self.byte_of[c] for c in inner if c in self.byte_of]
            joined[codes[:-1], codes[1:]] = True
        self.joined = joined
        self.alphabet = np.array([ord(self.char_of[b]) if b != ord(" ") else b for b in range(256)], "<u2")  # no pre-token has a space

    def cuts(self, parts: list[bytes]) -> dict[int, list[int]]:
        """The forced cuts inside parts, by the part's place: wherever a byte pair occurs inside no token."""
        data, ends = np.frombuffer(b"".join(parts), np.uint8), np.cumsum([len(p) for p in parts])
        at = np.flatnonzero(~self.joined[data[:-1], data[1:]]) + 1
        owner = np.searchsorted(ends, at, side="right")
        starts = ends - np.array([len(p) for p in parts])
        found: dict[int, list[int]] = {}
        for k, cut in zip(owner.tolist(), (at - starts[owner]).tolist(), strict=True):
            if cut:  # else where one part ends and the next begins
                found.setdefault(k, []).append(cut)
        return found

    def symbols(self, data: bytes) -> str:
        """A character of the vocabulary's alphabet for each byte; spaces stay."""
        return self.alphabet[np.frombuffer(data, np.uint8)].tobytes().decode("utf-16-le")

    def pretoken_ids(self, pretokens: list[str]) -> list[bytes]:
        """The ids of each pre-token: its fragments encoded apart, then concatenated. An added token is a pre-token of its own.

        Fragments that end their pre-token, nearly all of them, go to the library together, parted by spaces.
        """
        data = [p.encode("utf-8", "surrogatepass") for p in pretokens]
        cut, before, ends = self.cuts(data), {}, data.copy()
        for k, at in cut.items():
            pieces = [data[k][a:b] for a, b in itertools.pairwise([0, *at, len(data[k])])]
            before[k] = packed([t.id for p in self.symbols(b" ".join(pieces[:-1])).split(" ") for t in self.inner.tokenize(p)])
            ends[k] = pieces[-1]
        joined = self.symbols(b" ".join(ends))
        ids = np.array(self.last.encode_batch_fast([joined], add_special_tokens=False)[0].ids, "<u4")
        stops = (4 * (np.flatnonzero(self.ends_word[ids]) + 1)).tolist()
        data = ids.tobytes()
        out = [data[a:b] for a, b in zip([0, *stops], stops, strict=False)]
        for k, first in before.items():
            out[k] = first + out[k]
        if not self.added.keys().isdisjoint(pretokens):
            out = [packed([self.added[p]]) if p in self.added else ids for p, ids in zip(pretokens, out, strict=True)]
        return out

    def normalised(self, chunk: str) -> str:
        if not chunk.isascii():
            chunk = unicodedata.normalize("NFC", chunk).replace("Σ", "σ")  # the library lowers each character by itself
        return chunk.lower()

    def pretokens(self, chunk: str) -> list[str]:
        """The pre-tokens and added tokens of a text without white space. Nothing but an added token's own text gives that text as one pre-token."""
        out: list[str] = []
        for k, part in enumerate(self.added_pattern.split(chunk)):
            out += [part] if k % 2 else self.pretoken.findall(self.normalised(part))
        return out

    def split_chunks(self, chunks: list[str]) -> tuple[list[bool], list[str], list[list[str]]]:
        """Whether each chunk is one pre-token, the normalised chunks, and the pre-tokens of the others. All chunks are normalised together, parted by a character that they don't hold."""
        joined = "\n".join(chunks)
        if self.added_start.search(joined):
            return [False] * len(chunks), chunks, list(map(self.pretokens, chunks))
        plain = self.normalised(joined).split("\n")
        whole = list(map(str.isalpha, plain))
        split: list[list[str]] = [[]]
        for found in self.pretoken_or_end.findall("\n".join(compress(plain, map(not_, whole)))):
            if found == "\n":
                split.append([])
            else:
                split[-1].append(found)
        return whole, plain, split

    def chunks(self, text: str) -> list[str]:
        """The parts of a text between its forced cuts at white space."""
        if _SPLIT_MORE.search(text):
            return [c for c in _WHITE.split(text) if c]
        return text.split()

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(b"".join(self.pretoken_ids([p for c in self.chunks(text) for p in self.pretokens(c)])), "<u4").tolist()

    def decode(self, ids: list[int]) -> str:
        """Tokens joined by one space, as the library does for a file that names no decoder."""
        tokens = self.tokens
        return " ".join([tokens[i] for i in ids])


class Generations:
    """A cache of bounded bytes: when the younger of two generations is full, the older goes. Long keys are kept for one call only."""

    def __init__(self, compute: Callable[[list[str]], Iterable[object]], limit: int):
        self.compute, self.limit, self.size = compute, limit, 0
        self.young: dict[str, object] = {}
        self.old: dict[str, object] = {}
        self.passing: list[str] = []

    def holding(self, keys: set[str]) -> dict[str, object]:
        """A mapping that has all these keys, until the next call; those unknown so far are computed together."""
        for k in self.passing:
            self.young.pop(k, None)
        self.passing = []
        if self.size >= self.limit:
            self.old, self.young, self.size = self.young, {}, 0
        missing = keys.difference(self.young)
        old = self.old
        known = {k: old[k] for k in missing if k in old}
        if unknown := list(missing.difference(known)):
            known.update(zip(unknown, self.compute(unknown), strict=True))
            self.passing = [k for k in unknown if len(k) > KEPT_CHARACTERS]
        self.young.update(known)
        size = sys.getsizeof
        self.size += sum(map(size, known)) + sum(map(size, known.values())) + ENTRY_BYTES * len(known) - sum(size(k) + size(known[k]) + ENTRY_BYTES for k in self.passing)
        return self.young

    def values(self, lists: list[list[str]]) -> list[list[object]]:
        """The value of each key of each list. Values are true; a key is looked up once unless it is unknown so far."""
        get = self.young.get
        found = [list(map(get, keys)) for keys in lists]
        holes = [list(compress(range(len(v)), map(not_, v))) for v in found]
        known = self.holding({keys[i] for keys, at in zip(lists, holes, strict=True) for i in at})
        for keys, own, at in zip(lists, found, holes, strict=True):
            for i in at:
                own[i] = known[keys[i]]
        return found


@lru_cache(maxsize=4)
def codec(path: str) -> Codec:
    """One for each Python worker."""
    return Codec(path)


@lru_cache(maxsize=4)
def chunk_cache(path: str, limit: int = CACHE_BYTES) -> Generations:
    """Chunk -> its ids as little-endian unsigned 32-bit integers; one for each Python worker."""
    c = codec(path)
    pretokens = Generations(c.pretoken_ids, limit // 2)

    def ids(own: list[str]) -> bytes:
        """Of a chunk of so many pre-tokens that they aren't held together."""
        groups = (own[i : i + PRETOKENS_AT_ONCE] for i in range(0, len(own), PRETOKENS_AT_ONCE))
        return b"".join([b"".join(map(pretokens.holding(set(g)).__getitem__, g)) for g in groups])

    def compute(chunks: list[str]) -> list[bytes]:
        whole, plain, split = c.split_chunks(chunks)
        large = {k: ids(own) for k, own in enumerate(split) if len(own) > PRETOKENS_AT_ONCE}
        known = pretokens.holding(set(compress(plain, whole)).union(*(own for k, own in enumerate(split) if k not in large))).__getitem__
        parts = iter(range(len(split)))
        return [known(p) if w else large[k] if (k := next(parts)) in large else b"".join(map(known, split[k])) for w, p in zip(whole, plain, strict=True)]

    return Generations(compute, limit)


def release() -> None:
    """Drops this worker's vocabularies and caches; what needs them next builds them anew."""
    chunk_cache.cache_clear()
    codec.cache_clear()
    gc.collect()


def in_parts(text: str) -> list[str]:
    """A text cut at white space into parts of about CHARACTERS_AT_ONCE."""
    parts, at = [], 0
    while len(text) - at > CHARACTERS_AT_ONCE:
        cut = _WHITE.search(text, at + CHARACTERS_AT_ONCE)
        if cut is None:
            break
        parts.append(text[at : cut.start()])
        at = cut.start()
    return [*parts, text[at:]]


def joined_chunks(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.DictionaryArray]:
    """The bytes of the texts, each with a line feed behind it and a space for white space beyond ASCII; where they begin in it, where their chunks do, and the chunks."""
    plain = (t if t.isascii() else _OTHER_WHITE.sub(" ", t) for t in texts)
    encoded = [t.encode("utf-8", "surrogatepass") for t in plain]
    data = np.frombuffer(b"\n".join([*encoded, b""]), np.uint8)
    inside = ~_WHITE_BYTE[data]
    edges = np.diff(np.r_[np.int8(0), inside.view(np.int8)])
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    ends_at = np.r_[0, np.cumsum(ends - starts)].astype(np.int32)
    chunks = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(ends_at), pa.py_buffer(data[inside])]).dictionary_encode()
    return data, np.cumsum([0, *[len(t) + 1 for t in encoded]]), starts, chunks


def different(chunks: pa.DictionaryArray) -> list[str]:
    """Each different chunk, in the dictionary's order."""
    if not len(chunks):
        return []
    return b"\n".join(chunks.dictionary.to_numpy(zero_copy_only=False).tolist()).decode("utf-8", "surrogatepass").split("\n")  # no chunk has a line feed


def joined_ids(cache: Generations, texts: list[str]) -> list[bytes]:
    """The ids of each text. Each different chunk of the texts is looked up once, and Arrow puts what it encodes to in every place."""
    _, begins, starts, chunks = joined_chunks(texts)
    if not len(starts):
        return [b""] * len(texts)
    keys = different(chunks)
    ids = pa.array(list(map(cache.holding(set(keys)).__getitem__, keys)), pa.large_binary()).take(chunks.indices)
    first = np.searchsorted(starts, begins)  # of each text's chunks
    at = np.frombuffer(ids.buffers()[1], np.int64)[first + ids.offset].tolist()
    found = memoryview(ids.buffers()[2])
    return [bytes(found[a:b]) for a, b in itertools.pairwise(at)]


def encode_bytes(path: str, texts: list[str], limit: int = CACHE_BYTES) -> list[bytes]:
    """The ids of whole texts as little-endian unsigned 32-bit integers."""
    collects = gc.isenabled()
    gc.disable()  # hundreds of thousands of strings and no cycle
    try:
        cache = chunk_cache(path, limit)
        if max(map(len, texts), default=0) <= CHARACTERS_AT_ONCE:
            return joined_ids(cache, texts)
        return [b"".join([joined_ids(cache, [p])[0] for p in in_parts(t)]) for t in texts]
    finally:
        if collects:
            gc.enable()


def encode(docs: DataFrame, vocabulary: str | None = None, decoded: bool = False) -> DataFrame:
    """doc_id and `ids` (array<int>) of each whole text; with decoded, also `decoded`, the text that the ids give back.

    One row for each input row, repeated ones included; null and empty texts give an empty array, and a very long text its ids in
    parts cut at white space. Nothing is compared, so there are no ties. Only doc_id and text are read, so other columns may have
    any name. An empty table gives no row.
    """
    path = vocabulary or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = codec(path).tokens
        table = [tokens.get(i, "") for i in range(max(tokens) + 1)]
        for batch in batches:
            for part in slices(batch):
                found = encode_bytes(path, part.column("text").to_pylist())
                offsets = np.cumsum([0, *[len(b) // 4 for b in found]])
                flat = np.frombuffer(b"".join(found), "<u4").astype(np.int32)
                out = [part.column("doc_id"), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat))]
                if decoded:
                    out.append(pa.array([" ".join([table[i] for i in np.frombuffer(b, "<u4").tolist()]) for b in found], pa.string()))
                yield pa.RecordBatch.from_arrays(out, names)

    names = ["doc_id", "ids", "decoded"][: 3 if decoded else 2]
    return identified(docs).mapInArrow(run, "doc_id long, ids array<int>" + ", decoded string" * decoded)


def decode(rows: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id and `decoded`, the text of each row's `ids`, repeated rows included; null counts as no ids. Other columns may have any name. An empty table gives no row."""
    path = vocabulary or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            texts = [c.decode(ids or []) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "decoded"])

    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(run, "doc_id long, decoded string")


def op1(spark, sf_dir: str) -> DataFrame:
    """Token count and digests of the ids and of the decoded text, of every document."""
    from tempora.llm.common import documents

    rows = encode(documents(spark, sf_dir), decoded=True)
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
