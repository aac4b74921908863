"""Personal data, found in plain and disguised spellings, with spans in the characters of the text as it is.

A transducer reads a text once and writes a normalised copy: homoglyphs (full-width and other compatibility forms, Cyrillic and
Greek letters that look Latin, digits of other scripts) become their ASCII letter or digit, invisible characters vanish,
spelled digits become digits, and "at" and "dot" disguises become @ and a dot. Each written character carries the source span
it came from, so a span found in the copy maps back to source characters.

The base identifiers are found in the text as it is and always stay. What the copy adds must hold at least one character that
the transducer has changed or, in an address, a Latin letter that isn't ASCII, and be well formed; it may hold base spans, as
where only half of an address is disguised, but doesn't lie in one. Disguised words are rewritten only between
characters that make an address likely, so that ordinary prose is left alone. Where all of an address's marks are plain words,
its ending is one of ENDINGS, or any after a single "dot" between words that aren't COMMON: other addresses in words are missed.
"""

from __future__ import annotations

import bisect
import itertools
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tempora.llm.common import documents, identified, slices, small_batches, tidy

KINDS = ("email", "ip", "card", "phone")

Span = tuple[int, int, int]  # start, end, place of the kind in KINDS

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: Latin letters of other languages, which mail systems take as well.
_ACCENTED = frozenset(c for c in map(chr, range(0xC0, 0x250)) if c.isalpha())
_WIDE = re.compile("[\u00c0-\u024f]")
_AFTER_AT = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_DIGIT = re.compile("[0-9]")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    return (odd + sum(d * 2 - 9 * (d > 4) for d in map(int, digits[-2::-2]))) % 10 == 0


def emails(text: str, local: frozenset[str] = _LOCAL) -> Iterator[tuple[int, int]]:
    """Leftmost matches that don't overlap: the longest run of local characters before each @ that a domain follows."""
    free = at = 0  # matches begin at or after free
    while (m := _AFTER_AT.search(text, at)) is not None:
        start = m.start()
        while start > free and text[start - 1] in local:
            start -= 1
        if start < m.start():
            yield start, m.end()
            free = at = m.end()
        else:
            at = m.start() + 1


def base_spans(text: str, local: frozenset[str] = _LOCAL) -> list[Span]:
    """The identifiers of a text as it is, in the order of KINDS and then of their start. local: what may stand before an @."""
    found: list[Span] = []
    if "@" in text:
        found += [(a, b, 0) for a, b in emails(text, local)]
    if _DIGIT.search(text):
        if "." in text:
            found += [(m.start(), m.end(), 1) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split("."))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 12 and 12 <= len(digits := m.group().replace(" ", "").replace("-", "")) <= 19 and luhn(digits):
                found.append((m.start(), m.end(), 2))
        if "+" in text:
            found += [(m.start(), m.end(), 3) for m in _PHONE.finditer(text) if 9 <= sum(map(str.isdigit, m.group())) <= 15]
    return found


#: Letters of other scripts that look like a Latin one.
HOMOGLYPHS = dict(zip("аеорсухіјѕԁһԛԝАВЕКМНОРСТХІЈЅαονρικτυΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "aeopcyxijsdhqwABEKMHOPCTXIJSaovpiktuABEZHIKMNOPTYX", strict=True))
INVISIBLE = "\u00ad\u200b\u200c\u200d\u2060\ufeff"
#: Other full stops, and characters that stand for an at sign or a hyphen.
MARKS = {"。": ".", "．": ".", "｡": ".", "․": ".", "·": ".", "＠": "@", "﹫": "@", "‐": "-", "‑": "-", "‒": "-", "–": "-", "−": "-", "\u00a0": " ", "\u2009": " ", "\u202f": " "}
#: The digits' names in the four languages of the corpus.
SPELLED = {w: str(d) for names in ("zero one two three four five six seven eight nine", "null eins zwei drei vier fünf sechs sieben acht neun", "zéro un deux trois quatre cinq six sept huit neuf", "cero uno dos tres cuatro cinco seis siete ocho nueve") for d, w in enumerate(names.split())}
PLUS = frozenset(("plus", "más"))

#: Characters that may need another in their place; accented letters of the corpus's languages aren't among them.
_STRANGE = re.compile("[" + "".join(HOMOGLYPHS) + INVISIBLE + "".join(MARKS) + "\u00b2\u00b3\u00b9\u0660-\u0669\u06f0-\u06f9\u0966-\u096f\u2070-\u2089\u2460-\u24ff\uff01-\uff5e\U0001d400-\U0001d7ff]")

_NAMES = "|".join(sorted(SPELLED, key=len, reverse=True))
_DOT = "dot|punkt|point|punto"
_AT = "at|ät|arroba|arobase"
_TOKEN = rf"(?:(?:{_NAMES})(?![^\W_])|[0-9]+)"
#: At least three digits or their names in a row, perhaps with a plus before and dots between.
_DIGIT_RUN = re.compile(rf"(?<![^\W_])(?:(?:plus|más)[ \t]+)?{_TOKEN}(?:(?:[ \t]+(?:{_DOT})[ \t]+|[ \t.,()-]{{1,3}}){_TOKEN}){{2,}}")
_RUN_PART = re.compile(rf"(?P<plus>plus|más)[ \t]+|(?P<dot>[ \t]+(?:{_DOT})[ \t]+)|(?P<name>{_NAMES})(?![^\W_])|(?P<digits>[0-9]+)|(?P<gap>[ \t]+)|.")
_BEFORE = r"(?<![ \t])[ \t]*+"
_BRACKETED = re.compile(rf"{_BEFORE}[\[({{<][ \t]*+(?:(?P<at>{_AT}|@)|(?P<dot>{_DOT}|\.))[ \t]*+[\])}}>][ \t]*+")
_AT_MARK = rf"(?:{_BEFORE}[\[({{<][ \t]*+(?:{_AT}|@)[ \t]*+[\])}}>][ \t]*+|(?<![ \t])[ \t]++(?:{_AT})[ \t]++|{_BEFORE}@[ \t]*+|_at_|-at-)"
_DOT_MARK = rf"(?:{_BEFORE}[\[({{<][ \t]*+(?:{_DOT}|\.)[ \t]*+[\])}}>][ \t]*+|(?<![ \t])[ \t]++(?:{_DOT})[ \t]++|_dot_|-dot-)"
#: name at host dot ending: what stands for the at sign, and at least one dot of the host, in words or brackets.
_ADDRESS = re.compile(rf"(?P<at>{_AT_MARK})[a-z0-9](?:[a-z0-9-]|\.(?=[a-z0-9])|{_DOT_MARK}(?=[a-z0-9]))*")
_DOT_IN = re.compile(_DOT_MARK)
_LOCAL_LOW = frozenset("abcdefghijklmnopqrstuvwxyz0123456789.%+_-")
#: What a host ends in, where all its marks are plain words.
ENDINGS = frozenset("com org net edu gov mil int info biz name io ai co me dev app tv eu us uk de fr es it pt nl be ch at pl se no dk fi ie ca au nz jp cn in br mx ar cl ru tech online store shop site xyz cloud blog agency museum travel jobs pro mobi news media live life world group email digital systems software page team work zone academy example test invalid local".split())
#: After a plain "dot", any other ending of letters counts as well, if the host is one word and neither of the two is one of these: "looked at the dot on the map".
COMMON = frozenset("a an the this that these those each every any some no one his her its our your my their first last next same red blue green black white yellow small big on in of to is was and or at by for with from as but if when where which who that so then than into over under near above below dot point home".split())
_HINTS = ("dot", "punkt", "point", "punto", "(at", "[at", "{at", "<at", "( at", "[ at", "(@", "[@", "(.", "[.", "arroba", "arobase")

Edit = tuple[int, int, str]


def _plain(char: str) -> str:
    """The ASCII character that this one stands for, nothing for an invisible one; else itself."""
    if char in INVISIBLE:
        return ""
    known = HOMOGLYPHS.get(char) or MARKS.get(char)
    if known:
        return known
    folded = unicodedata.normalize("NFKC", char)
    if len(folded) == 1 and folded.isascii():
        return folded
    digit = unicodedata.digit(char, None)
    return char if digit is None else str(digit)


class Tape:
    """A normalised text whose characters know the span of source characters that they came from, and whether they differ."""

    def __init__(self, text: str):
        self.text, self.starts, self.ends, self.changed = text, range(len(text)), range(1, len(text) + 1), bytes(len(text))

    def rewrite(self, edits: list[Edit]) -> None:
        """Puts other characters in the place of spans, which are in order and don't overlap."""
        text, starts, ends, changed, at = [], [], [], bytearray(), 0
        for a, b, new in edits:
            text.append(self.text[at:a]), starts.extend(self.starts[at:a]), ends.extend(self.ends[at:a]), changed.extend(self.changed[at:a])
            text.append(new), starts.extend([self.starts[a]] * len(new)), ends.extend([self.ends[b - 1]] * len(new)), changed.extend(b"\1" * len(new))
            at = b
        text.append(self.text[at:]), starts.extend(self.starts[at:]), ends.extend(self.ends[at:]), changed.extend(self.changed[at:])
        self.text, self.starts, self.ends, self.changed = "".join(text), starts, ends, bytes(changed)

    def source(self, a: int, b: int) -> tuple[int, int]:
        return self.starts[a], self.ends[b - 1]


def strange_characters(text: str) -> list[Edit]:
    if text.isascii():
        return []
    return [(m.start(), m.end(), p) for m in _STRANGE.finditer(text) if (p := _plain(m.group())) != m.group()]


def spelled_digits(low: str) -> list[Edit]:
    edits: list[Edit] = []
    for run in _DIGIT_RUN.finditer(low):
        parts, named = list(_RUN_PART.finditer(low, *run.span())), False
        if not any(p["name"] for p in parts):
            continue
        for k, p in enumerate(parts):
            if p["plus"]:
                edits.append((*p.span(), "+"))
            elif p["dot"]:
                edits.append((*p.span(), "."))
            elif p["name"]:
                edits.append((*p.span(), SPELLED[p["name"]]))
            elif p["gap"] and 0 < k < len(parts) - 1 and (parts[k - 1]["name"] or parts[k - 1]["digits"]) and (parts[k + 1]["name"] or parts[k + 1]["digits"]):
                edits.append((*p.span(), ""))
    return edits


def _wording(mark: str) -> str:
    """The word in a mark for a dot; empty for a dot in brackets."""
    return "".join(c for c in mark if c.isalpha())


def local_start(low: str, at: int, floor: int, dots: dict[int, int], words: set[str]) -> int:
    """Where the local part before an at sign begins, at `at` if there is none: local characters, and dots in these words between them. dots: end of a mark -> its start."""
    start = at
    while start > floor and low[start - 1] in _LOCAL_LOW:
        start -= 1
        mark = dots.get(start)
        if mark is not None and mark > floor and low[mark - 1] in _LOCAL_LOW and low[start].isalnum() and _wording(low[mark:start]) in words:
            start = mark
    while start < at and low[start] == ".":
        start += 1
    return start


def address_marks(low: str) -> list[Edit]:
    """At signs and dots written as words or in brackets, where they make up an address."""
    edits: list[Edit] = []
    marks: dict[int, int] | None = None
    floor = 0  # a local part begins after the at sign before it, so all of them are found in linear time
    for m in _ADDRESS.finditer(low):
        at, host, before = m.span("at"), (m.end("at"), m.end()), floor
        floor = m.end("at")
        dots = [d.span() for d in _DOT_IN.finditer(low, *host)]
        if not dots and "." not in low[slice(*host)]:
            continue
        in_words = m["at"].strip(" \t").isalpha()  # then words for the dots and an ending must follow, lest prose count
        words = {_wording(low[a:b]) for a, b in dots}
        if in_words and not (dots and ends_well(low, host, dots)):
            continue
        if marks is None:
            marks = {d.end(): d.start() for d in _DOT_IN.finditer(low)}
        first = local_start(low, at[0], before, marks, words | ({""} if in_words else {"", *_DOT.split("|")}))
        if first == at[0]:
            continue
        if m["at"] != "@":
            edits += [(*d.span(), ".") for d in _DOT_IN.finditer(low, first, at[0])]
            edits.append((*at, "@"))
        edits += [(*d, ".") for d in dots]
    edits += [(m.start(), m.end(), "@" if m["at"] else ".") for m in _BRACKETED.finditer(low)]
    return edits


def ends_well(low: str, host: tuple[int, int], dots: list[tuple[int, int]]) -> bool:
    """Whether what follows the last dot of a host written in words is an ending."""
    ending = low[dots[-1][1] : host[1]]
    if ending in ENDINGS:
        return True
    name = low[host[0] : dots[0][0]]
    return len(dots) == 1 and "." not in name and low[slice(*dots[0])].strip(" \t") == "dot" and len(ending) > 1 and ending.isalpha() and not {name, ending} & COMMON


def in_order(edits: list[Edit]) -> list[Edit]:
    out: list[Edit] = []
    for e in sorted(edits):
        if not out or e[0] >= out[-1][1]:
            out.append(e)
    return out


def lowered(text: str) -> str:
    """In lower case, a character for each character."""
    low = text.lower()
    return low if len(low) == len(text) else "".join([c.lower() if len(c.lower()) == 1 else c for c in text])


_SPELLED_WORDS = frozenset(SPELLED)
_words = re.compile(r"[^\W_]+").findall


def disguised(text: str) -> Tape | None:
    """The tape of a text in which anything may be disguised, else None."""
    strange = strange_characters(text)
    low = lowered(text)
    hinted = any(h in low for h in _HINTS) or "_at_" in low or "-at-" in low
    spelled = not _SPELLED_WORDS.isdisjoint(_words(low))
    if not (strange or hinted or spelled):
        return None
    tape = Tape(text)
    if strange:
        tape.rewrite(strange)
        low = lowered(tape.text)
    edits = in_order((spelled_digits(low) if spelled else []) + (address_marks(low) if hinted or strange else []))
    if not (strange or edits):
        return None
    tape.rewrite(edits)
    return tape


def added_spans(text: str, base: list[Span]) -> list[Span]:
    """What the normalised copy shows besides: spans with a changed or an accented character in them that lie in no base span."""
    tape = disguised(text)
    if tape is None:
        if "@" not in text or not _WIDE.search(text):
            return []
        tape = Tape(text)
    found: list[Span] = []
    own = sorted(base)
    starts, reach = [x[0] for x in own], list(itertools.accumulate((x[1] for x in own), max))
    free = dict.fromkeys(range(len(KINDS)), 0)  # where the last span of a kind ends
    for a, b, kind in base_spans(tape.text, _LOCAL | _ACCENTED):
        start, end = tape.source(a, b)
        odd = tape.changed.find(1, a, b) >= 0 or end - start != b - a or not kind and _WIDE.search(tape.text, a, b)
        if odd and start >= free[kind]:
            before = bisect.bisect_right(starts, start)  # base spans that begin no later than this one
            if not before or reach[before - 1] < end:
                found.append((start, end, kind))
                free[kind] = end
    return found


def find_spans(text: str) -> tuple[list[Span], list[Span]]:
    """Base spans and added spans, by start and then by kind."""
    base = base_spans(text)
    by_start = lambda s: (s[0], s[2], s[1])
    return sorted(base, key=by_start), sorted(added_spans(text, base), key=by_start)


SPANS = "array<struct<kind:string,start:int,end:int,base:boolean>>"


def find(docs: DataFrame) -> DataFrame:
    """doc_id and spans (kind, start, end in code points, base) of each row's whole text, by start and then by kind.

    Null and empty texts have no spans; repeated rows are each returned; a very long text is read whole, in linear time. Of spans
    that begin together the kinds' order decides. Only doc_id and text are read, so other columns may have any name. An empty
    table gives no row.
    """
    kind_type = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                rows = []
                for text in part.column("text").to_pylist():
                    base, added = find_spans(text)
                    tagged = sorted([(s, k, e, True) for s, e, k in base] + [(s, k, e, False) for s, e, k in added])
                    rows.append([{"kind": KINDS[k], "start": s, "end": e, "base": b} for s, k, e, b in tagged])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(rows, kind_type)], ["doc_id", "spans"])

    return identified(docs).mapInArrow(run, f"doc_id long, spans {SPANS}")


def masked(text: str) -> str:
    """The text with each stretch of personal data replaced by its kind in brackets; of overlapping spans the first names it."""
    base, added = find_spans(text)
    if not base and not added:
        return text
    out, at = [], 0
    for start, end, kind in sorted(base + added):
        if start >= at:
            out += [text[at:start], f"[{KINDS[kind].upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def mask(docs: DataFrame) -> DataFrame:
    """All rows and columns, with personal data in the text masked; n_chars, where there is one, follows the text.

    A null text stays null, an empty one empty; repeated rows are each returned. Columns may have any name. An empty table gives no row.
    """
    place = docs.columns.index("text")
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                texts = [t if t is None else masked(t) for t in part.column("text").to_pylist()]
                yield part.set_column(place, part.schema.field(place), pa.array(texts, part.schema.field(place).type))

    out = docs.mapInArrow(tidy(run), docs.schema)
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def written(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _of_kind(kind: str):
    return lambda s: s["kind"] == kind


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = F.filter("spans", lambda s: s["base"])
    counts = [F.size(F.filter(base, _of_kind(k))).cast("long").alias(f"n_{k}") for k in KINDS]
    added = F.size(F.filter("spans", lambda s: ~s["base"])).cast("long").alias("n_added")
    return find(documents(spark, sf_dir)).select("doc_id", *counts, F.sha2(written(base), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"), added)
