"""Toxicity scores: gradient-boosted trees over dense features, with isotonic calibration.

Features of a text: densities of a learned lexicon (words and word beginnings that mark labelled toxic texts), lexicon words
near a second-person pronoun, capitals, punctuation, obfuscated spellings. The lexicon is learned with the trees' rows left
out: labelled rows fall in folds, the features of a fold's rows come from the lexicon of the other folds, and the isotonic
map is fitted on scores of trees that didn't see the row. Only the fit is bounded, by SAMPLE_ROWS labelled rows; scoring reads
every whole text.
"""

from __future__ import annotations

import re
import sys
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tempora.llm.bpe import Generations
from tempora.llm.common import documents, identified, slices, small_batches, stage, tidy

#: The most labelled rows a fit uses: those of least hash of their doc_id.
SAMPLE_ROWS = 20_000
FOLDS = 5
#: Share of rows, by crc32 of doc_id, that no fit sees.
HELD_OUT_MODULUS = 5
#: Bytes of a generation of the cache of chunks' codes, of which two are held.
CACHE_BYTES = 16 << 20
#: Counts of terms that a task gathers before it passes them on; they are summed up afterwards.
HELD_TERMS = 100_000
#: The most terms in a lexicon: weaker ones than these are left out, so the model that goes to every task has a bounded size.
LEXICON_TERMS = 4_000
STEM_LENGTHS = (4, 5, 6)
#: Words within this distance of a second-person pronoun count as directed at the reader.
NEAR_WORDS = 3

SECOND_PERSON = frozenset("you your yours yourself yourselves u ur thou thee thy du dich dir dein deine deiner ihr euch euer tu te toi ton ta tes vous votre vos tú ti usted ustedes vosotros os vuestro".split())

_WORD = re.compile(r"[^\W\d_]+")
_LEET = str.maketrans("0134578@$!|€", "oleastbasile")
#: What a disguised word may be made of: chunks are parted at all else.
_PIECE = re.compile(r"[\w@$!|*€.-]+")
_SYMBOLS_INSIDE = re.compile(r"[^\W_][0-9@$!|*€._-]+[^\W_]")
_RUN = re.compile(r"([^\W\d_])\1{2,}")
_STRIP = " \t\n\r\v\f.,;:?!\"'()[]{}<>#%&*+-=/\\|~^`_$"

LEXICON, STEM, SECOND, OBFUSCATED, HIDDEN, CAPITALS = 1, 2, 4, 8, 16, 32
#: Above the flags, a code holds the rounded weight, 15 at most: no log odds of a sample of less than a million rows are larger.
WEIGHT_SHIFT = 6

FEATURES = ("log_words", "lexicon", "stems", "weight", "log_hits", "strongest", "near_second", "second", "hidden", "obfuscated", "capital_words", "capitals", "punctuation", "exclamations", "digits", "hit_share")


def held_out(doc_id: Column) -> Column:
    """By the id's text. A row without an id isn't held out, but no fit sees it either."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % HELD_OUT_MODULUS == 0, F.lit(False))


def bare(chunk: str) -> str:
    """The letters of a chunk's first word, in lower case."""
    word = _WORD.search(chunk)
    return word.group().lower() if word else ""


def words_of(text: str) -> set[str]:
    """All words of a text, in lower case."""
    return {w.lower() for w in set(_WORD.findall(text))}


def terms(word: str) -> list[str]:
    """A word and its beginnings; a beginning ends in a star."""
    return [word, *[word[:n] + "*" for n in STEM_LENGTHS if len(word) > n]] if word else []


class Scanner:
    """Turns texts into feature rows, given a lexicon (term -> weight)."""

    def __init__(self, lexicon: dict[str, float], cached: int = CACHE_BYTES):
        self.lexicon = lexicon
        self.stems = {t[: min(STEM_LENGTHS)] for t in lexicon if t.endswith("*")}
        self.codes = Generations(lambda chunks: [self.word_codes(c) for c in chunks], cached)

    def found(self, word: str) -> tuple[int, float]:
        kind, weight = 0, 0.0
        for term in terms(word) if word[: min(STEM_LENGTHS)] in self.stems else (word,):
            if (w := self.lexicon.get(term)) is not None:
                kind |= STEM if term.endswith("*") else LEXICON
                weight = max(weight, w)
        return kind, weight

    def code(self, chunk: str) -> int:
        word = bare(chunk)
        code, weight = self.found(word)
        if word in SECOND_PERSON:
            code |= SECOND
        inner = chunk.strip(_STRIP)
        if not inner.isalpha() and _SYMBOLS_INSIDE.search(inner) or _RUN.search(inner):
            code |= OBFUSCATED
            plain = _RUN.sub(r"\1", "".join(_WORD.findall(inner.lower().translate(_LEET))))
            hidden, w = self.found(plain)
            if hidden and not code & (LEXICON | STEM):
                code |= HIDDEN
                weight = max(weight, w)
        if len(inner) > 2 and inner.isupper():
            code |= CAPITALS
        return code | min(15, round(weight)) << WEIGHT_SHIFT

    def word_codes(self, chunk: str) -> bytes:
        """The codes of all words of a chunk, as 16-bit numbers; one for a chunk without words. What only shows in the whole chunk or piece is in the code of its first word."""
        inner = chunk.strip(_STRIP)
        if inner.isalpha() and not _RUN.search(inner):  # one word, which most chunks are: nothing is disguised
            word = inner.lower()
            code, weight = self.found(word)
            code |= (word in SECOND_PERSON and SECOND) | (len(inner) > 2 and inner.isupper() and CAPITALS)
            return (code | min(15, round(weight)) << WEIGHT_SHIFT).to_bytes(2, sys.byteorder)
        pieces = [p for p in _PIECE.findall(chunk) if _WORD.search(p)]
        codes = [self.code(w) for p in pieces for w in (p, *_WORD.findall(p)[1:])] if len(pieces) > 1 else [0, *map(self.code, _WORD.findall(chunk)[1:])]
        whole, flags = self.code(chunk), (1 << WEIGHT_SHIFT) - 1
        codes[0] = (codes[0] | whole) & flags | max(codes[0] >> WEIGHT_SHIFT, whole >> WEIGHT_SHIFT) << WEIGHT_SHIFT
        return np.array(codes, np.uint16).tobytes()

    def features(self, texts: list[str]) -> np.ndarray:
        chunks = [t.split() for t in texts]
        known = self.codes.holding(set().union(*chunks)).__getitem__
        out = np.zeros((len(texts), len(FEATURES)))
        for row, (text, own) in enumerate(zip(texts, chunks, strict=True)):
            codes = np.frombuffer(b"".join(map(known, own)), np.uint16)
            n = max(1, len(codes))
            hits = np.flatnonzero(codes & (LEXICON | STEM | HIDDEN))
            second = np.flatnonzero(codes & SECOND)
            near = 0
            if len(hits) and len(second):
                at = np.searchsorted(second, hits)
                gap = np.minimum(np.abs(second[np.minimum(at, len(second) - 1)] - hits), np.abs(second[np.maximum(at - 1, 0)] - hits))
                near = int((gap <= NEAR_WORDS).sum())
            weights = codes[hits] >> WEIGHT_SHIFT
            data = np.bincount(np.frombuffer(text.encode("utf-8", "replace"), np.uint8), minlength=256)
            size = max(1, int(data.sum()))
            marks = int(data[33:48].sum() + data[58:65].sum() + data[91:97].sum() + data[123:127].sum())
            per = lambda flag: np.count_nonzero(codes & flag) / n  # noqa: B023, E731
            out[row] = (np.log1p(len(codes)), per(LEXICON), per(STEM), weights.sum() / n, np.log1p(len(hits)), weights.max(initial=0), near / n, len(second) / n, per(HIDDEN), per(OBFUSCATED), per(CAPITALS), data[65:91].sum() / size, marks / size, data[33] / size, data[48:58].sum() / size, len(hits) / n)
        return out


@dataclass
class Trees:
    """Gradient-boosted regression trees for the logistic loss, grown level by level on binned features."""

    base: float
    rate: float
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]]  # feature and threshold of each inner node, value of each leaf
    depth: int

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, rounds: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 32, least: float = 1.0) -> Trees:
        share = min(max(y.mean(), 1e-3), 1 - 1e-3)
        model = cls(float(np.log(share / (1 - share))), rate, [], depth)
        edges = [np.unique(np.quantile(f, np.linspace(0, 1, bins + 1)[1:-1])) for f in x.T]
        edges = [np.unique(np.append(e, np.quantile(f[f > 0], np.linspace(0, 1, 9)[:-1]) - 1e-12)) if (f > 0).any() else e for e, f in zip(edges, x.T, strict=True)]
        binned = np.stack([np.searchsorted(e, f, side="left") for e, f in zip(edges, x.T, strict=True)], 1)
        width = max(len(e) for e in edges) + 1
        raw = np.full(len(y), model.base)
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-raw))
            grad, hess = y - p, np.maximum(p * (1 - p), 1e-6)
            feature, cut = np.zeros(2**depth - 1, int), np.full(2**depth - 1, np.inf)
            node = np.zeros(len(y), int)
            for level in range(depth):
                first, count = 2**level - 1, 2**level
                gain, best = np.full(count, 1e-6), [None] * count
                for j, e in enumerate(edges):
                    if not len(e):
                        continue
                    place = (node - first) * width + binned[:, j]
                    g = np.bincount(place, grad, count * width).reshape(count, width).cumsum(1)
                    h = np.bincount(place, hess, count * width).reshape(count, width).cumsum(1)
                    gl, hl, gt, ht = g[:, : len(e)], h[:, : len(e)], g[:, -1:], h[:, -1:]
                    score = gl**2 / (hl + least) + (gt - gl) ** 2 / (ht - hl + least) - gt**2 / (ht + least)
                    score[(hl < 0.1) | (ht - hl < 0.1)] = 0
                    k = score.argmax(1)
                    for n in np.flatnonzero(score[np.arange(count), k] > gain):
                        gain[n], best[n] = score[n, k[n]], (j, e[k[n]])
                for n, b in enumerate(best):
                    if b:
                        feature[first + n], cut[first + n] = b
                node = 2 * node + 1 + (x[np.arange(len(y)), feature[node]] > cut[node])
            leaf = node - (2**depth - 1)
            value = np.bincount(leaf, grad, 2**depth) / (np.bincount(leaf, hess, 2**depth) + least)
            model.trees.append((feature, cut, value))
            raw += rate * value[leaf]
        return model

    def raw(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.base), np.arange(len(x))
        for feature, cut, value in self.trees:
            node = np.zeros(len(x), int)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            out += self.rate * value[node - (2**self.depth - 1)]
        return out


def isotonic(scores: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: mean score and label share of each block, in rising order of both."""
    order = np.argsort(scores, kind="stable")
    blocks: list[list[float]] = []  # label sum, score sum, rows
    for s, y in zip(scores[order].tolist(), labels[order].tolist(), strict=True):
        blocks.append([y, s, 1])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][2] >= blocks[-1][0] * blocks[-2][2]:
            y2, s2, n2 = blocks.pop()
            blocks[-1] = [blocks[-1][0] + y2, blocks[-1][1] + s2, blocks[-1][2] + n2]
    b = np.array(blocks)
    return b[:, 1] / b[:, 2], (b[:, 0] + 0.01 * labels.mean()) / (b[:, 2] + 0.01)


@dataclass
class Model:
    """Lexicon, trees and calibration; trees None: too few labels of a kind, and every text gets the share of label 1."""

    lexicon: dict[str, float]
    trees: Trees | None
    knots: np.ndarray
    values: np.ndarray
    share: float

    def scores(self, features: np.ndarray) -> np.ndarray:
        if self.trees is None:
            return np.full(len(features), self.share)
        return np.clip(np.interp(self.trees.raw(features), self.knots, self.values), 0, 1)


def lexicon_of(toxic: Counter, clean: Counter, n_toxic: int, n_clean: int, most: int = LEXICON_TERMS) -> dict[str, float]:
    """Terms that mark toxic texts, weighted by their log odds; the strongest `most` of them, of equals the first in order."""
    least = max(3, n_toxic // 250)
    scored = []
    for term, t in toxic.items():
        if t >= least:
            odds = np.log((t + 0.5) / (n_toxic + 1)) - np.log((clean.get(term, 0) + 0.5) / (n_clean + 1))
            if odds > 2.5:
                scored.append((-odds * np.log1p(t), term, float(odds)))
    return {term: odds for _, term, odds in sorted(scored)[:most]}


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, holdout: bool = True, lexicon_terms: int = LEXICON_TERMS) -> Model:
    """Fits on at most sample_rows labelled documents, none of them held out, and keeps at most lexicon_terms terms.

    Labels other than 0 and 1, null ids and ids with two labels are left out; of documents that repeat an id the least text counts.
    Null texts count as empty, and very long ones are read whole. With fewer than five labels of a kind the model gives every text
    the share of label 1; so it does without any document or label. Only doc_id, text and toxic are read.
    """
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("_max")).where("toxic = _max")
    if holdout:
        known = known.where(~held_out(F.col("doc_id")))
    chosen = known.select("doc_id", F.col("toxic").cast("int").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    found = identified(docs).join(F.broadcast(chosen), "doc_id")  # at most sample_rows ids
    rows = stage(found.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic")), "toxicity-sample")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: defaultdict[tuple[int, int], Counter] = defaultdict(Counter)

        def counted() -> pa.RecordBatch:
            columns = list(zip(*[(t, f, y, n) for (f, y), terms_of in found.items() for t, n in terms_of.items()], strict=True)) or [()] * 4
            found.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int32(), pa.int32(), pa.int64()), strict=True)], ["term", "fold", "toxic", "n"])

        for batch in batches:
            for doc_id, text, toxic in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "toxic")), strict=True):
                fold = zlib.crc32(b"fold-%d" % doc_id) % FOLDS
                own = {t for w in words_of(text) for t in terms(w)}
                found[fold, toxic].update(own)
                found[fold, toxic][""] += 1
                if sum(map(len, found.values())) >= HELD_TERMS:
                    yield counted()
        yield counted()

    counts = rows.mapInArrow(tidy(count), "term string, fold int, toxic int, n long").groupBy("term", "fold", "toxic").agg(F.sum("n").alias("n"))
    toxic_total = F.sum(F.when(F.col("toxic") == 1, F.col("n"))).over(_by_term())
    kept = counts.withColumn("_t", toxic_total).where("_t >= 3 or term = ''")  # terms in toxic texts of the sample: bounded by it
    toxic, clean = [Counter() for _ in range(FOLDS)], [Counter() for _ in range(FOLDS)]
    for r in kept.select("term", "fold", "toxic", "n").toLocalIterator():
        (toxic if r["toxic"] else clean)[r["fold"]][r["term"]] += r["n"]
    all_toxic, all_clean = sum(toxic, Counter()), sum(clean, Counter())
    n_toxic, n_clean = all_toxic.pop("", 0), all_clean.pop("", 0)
    share = n_toxic / max(1, n_toxic + n_clean)
    if min(n_toxic, n_clean) < 5:
        return Model({}, None, np.zeros(1), np.zeros(1), share)
    lexicons = []
    for f in range(FOLDS):
        t, c = all_toxic.copy(), all_clean.copy()
        t.subtract(toxic[f]), c.subtract(clean[f])
        lexicons.append(lexicon_of(t, c, n_toxic - toxic[f][""], n_clean - clean[f][""], lexicon_terms))

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanners = [Scanner(x, CACHE_BYTES // FOLDS) for x in lexicons]
        for batch in batches:
            for part in slices(batch):
                folds = np.array([zlib.crc32(b"fold-%d" % i) % FOLDS for i in part.column("doc_id").to_pylist()])
                texts, out = part.column("text").to_pylist(), np.zeros((part.num_rows, len(FEATURES)))
                for f in range(FOLDS):
                    at = np.flatnonzero(folds == f)
                    out[at] = scanners[f].features([texts[i] for i in at])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("toxic"), pa.array(folds.astype(np.int32)), pa.array(list(out))], ["doc_id", "toxic", "fold", "x"])

    table = rows.mapInArrow(tidy(featured), "doc_id long, toxic int, fold int, x array<double>").toPandas().sort_values("doc_id", kind="stable")
    x, y, fold = np.array(table["x"].tolist()), table["toxic"].to_numpy(float), table["fold"].to_numpy()
    raw = np.zeros(len(y))
    for f in range(FOLDS):
        if (fold == f).any():
            raw[fold == f] = Trees.fit(x[fold != f], y[fold != f]).raw(x[fold == f])
    return Model(lexicon_of(all_toxic, all_clean, n_toxic, n_clean, lexicon_terms), Trees.fit(x, y), *isotonic(raw, y), share)


def _by_term():
    from pyspark.sql import Window

    return Window.partitionBy("term")


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score (0 to 1) of each row's whole text.

    Null and empty texts are scored as texts without words, very long ones like any other; repeated rows are each returned, with
    one score. Only doc_id and text are read, so other columns may have any name. An empty table gives no row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(model.lexicon)
        for batch in batches:
            for part in slices(batch):
                scores = model.scores(scanner.features(part.column("text").to_pylist()))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(scores)], ["doc_id", "score"])

    return identified(docs).mapInArrow(run, "doc_id long, score double")


def reject(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The rows whose score is under the threshold (a score that equals it goes), with all their columns, whatever their names.

    Null texts count as empty and stay null; repeated rows stay or go together. An empty table gives no row.
    """
    schema = docs.schema
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(model.lexicon)
        for batch in batches:
            for part in slices(batch):
                scores = model.scores(scanner.features([t or "" for t in part.column("text").to_pylist()]))
                yield part.filter(pa.array(scores < threshold))

    return docs.mapInArrow(tidy(run), schema)


def op7(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    scored = score(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
