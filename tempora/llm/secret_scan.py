"""Secrets, found by what their literals are assigned to.

A lexer reads the places of a text where a name meets a value: assignments and comparisons of source code, keys of JSON, YAML,
INI and environment files, attributes and elements of markup, options of command lines, setters. Each gives a pair of a name and
an expression of literals and other names. Names that were given a constant before stand for it, also inside concatenations and
templates, so a literal counts for every name that it reaches. A literal is scored by how sensitive the most telling such name
is, and by how it is spelled: length, kinds of characters, entropy; placeholders, paths and sentences count against it.

The base patterns are found in the text as it is and always stay. A literal is added if its score suffices and no base span
holds it already. Every step takes time in proportion to the text: a constant of any size is kept as what it is made of, and of
long texts only what their score needs.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tempora.llm.common import documents, identified, slices

KINDS = ("assign", "access", "hex", "literal")
Span = tuple[int, int, int]  # start, end, place of the kind in KINDS

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile("AKIA[A-Z0-9]+")
_HEX = re.compile("[0-9a-f]{32,}")
_ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")


def base_spans(text: str, low: str) -> list[Span]:
    """The identifiers of a text as it is; low: the same with letters A to Z in lower case, or fully so."""
    found: list[Span] = []
    if any(w in low for w in _ASSIGN_WORDS):
        found += [(*m.span(), 0) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        found += [(*m.span(), 1) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    return found + [(*m.span(), 2) for m in _HEX.finditer(text)]


#: How much a word of a name says, in the four languages of the corpus: fixed values.
NAME_WORDS = {
    "password": 3, "passwd": 3, "pwd": 3, "passphrase": 3, "passcode": 3, "secret": 3, "secrets": 3, "credential": 3, "credentials": 3, "apikey": 3,
    "passwort": 3, "kennwort": 3, "geheimnis": 3, "contraseña": 3, "contrasena": 3, "secreto": 3, "motdepasse": 3, "mdp": 3,
    "token": 2, "pass": 2, "bearer": 2, "authorization": 2, "auth": 2, "jwt": 2, "hmac": 2, "clave": 2, "key": 1, "pin": 1, "salt": 1, "signature": 1,
}
#: A word before "key" that makes it a secret one.
KEY_WORDS = frozenset("api access private secret signing encryption master account storage shared auth service deploy".split())
#: A last word that says the value is only about the secret.
ABOUT = frozenset("hint length size count file path url uri endpoint name names id type field label regex pattern prefix suffix policy placeholder title text message error enabled expiry expires ttl format version input button column".split())
#: Values that stand for one to be filled in, by a part of at most PART characters or as a whole of at most as many; or by a tag.
PLACEHOLDER_PART = re.compile(r"(?i)change[-_ ]?me|example|placeholder|your[-_ ]|dummy|sample|redacted|replace|insert|todo|x{4}|\*{3}|\.{3}")
PLACEHOLDER_WHOLE = re.compile(r"(?i)none|null|nil|true|false|undefined|default|string|required|optional|password|secret|token|test|testing")
PART = 16
_HINTS = tuple(w for w in NAME_WORDS if len(w) > 3) + ("pwd", "key", "jwt", "mdp", "mot de passe", "mot_de_passe")
#: "pin" as a word of a name; in lower case alone it would be found inside too many words.
_PIN = re.compile("(?<![a-z])pin(?![a-z])|Pin(?![a-z])|PIN")
#: A literal counts from this score on.
LEAST_SCORE = 4.0
LEAST_LENGTH = 6
#: Texts of more characters are kept as a Said.
LONG_TEXT = 4096

_STRING = r'''"(?:[^"\\\n]|\\.)*+"|'(?:[^'\\\n]|\\.)*+'|`(?:[^`\\]|\\.)*+`'''
_NAME = r"[^\W\d][\w$-]*+(?:\.[^\W\d][\w$-]*+)*+"
#: A name, perhaps quoted or a subscript, and what joins it to its value.
_SITE = re.compile(
    rf"""(?<![\w$.-])(?:
        (?P<quote>["']?)(?P<name>\$?{_NAME})(?P=quote)\]?[ \t]*+(?P<op>===?|!==?|=>|:=|\?=|\+=|=(?!=)|:(?![:/]))[ \t]*+
      | --(?P<option>[^\W\d][\w-]*+)(?:=|[ \t]++)(?=["'\w])
      | (?P<setter>{_NAME})\([ \t]*+(?=["'])
    ) | <(?P<element>[^\W\d][\w.-]*+)>(?=[^<\s])""",
    re.X,
)
_TERM = re.compile(rf"(?P<prefix>[A-Za-z]{{0,2}}(?=[\"'`]))?(?P<string>{_STRING})|(?P<shell>\$\{{?(?P<var>\w++)\}}?)(?![^\s,;)\]}}+\"'])|(?P<name>{_NAME})(?![\w$@/=%!?*&^#~-])")
_BARE = re.compile(r"""[^\s"'`,;{}()\[\]<>]++""")
_ELEMENT_TEXT = re.compile(r"[^<\n]++")
_JOINT = re.compile(r"[ \t]*+(?:\+|\.\.|\.(?=[ \t]*[\"'$])|&|\|\|)?[ \t]*+(?:\\\n[ \t]*+)?")
_CALL = re.compile(r"\((?=[ \t]*+[\"'])[ \t]*+")
_SCHEME = re.compile(r"(?:Bearer|Basic|Token|Digest)[ \t]++(?=[^\s\"'])", re.I)
_INSIDE = re.compile(r"\$?\{\{?[ \t]*+(\w++)[ \t]*+\}?\}|\$(\w++)")
_ANNOTATION = re.compile(rf"(?:{_NAME})(?:\[[\w., \[\]]*\])?[ \t]*+=(?!=)[ \t]*+")
_CAMEL = re.compile(r"[A-Z]+(?=[A-Z][a-z])|[A-Z]?[^\W\d_A-Z]+|[A-Z]+|\d+")

def name_score(name: str) -> float:
    """How sensitive a name is; 0 if it says nothing."""
    words = [w.lower() for w in _CAMEL.findall(name)]
    if not words or words[-1] in ABOUT:
        return 0.0
    joined = "".join(words)
    best = max([float(NAME_WORDS.get(w, 0)) for w in words] + [3.0 if w in joined else 0.0 for w in ("motdepasse", "apikey")])
    for before, word in zip(words, words[1:], strict=False):
        if word in ("key", "keys") and before in KEY_WORDS:
            best = 3.0
    return best


@dataclass(frozen=True)
class Said:
    """What the score of a text depends on, whatever its length; that of a joined text follows from those of its parts."""

    length: int
    counts: dict[str, int]
    head: str
    tail: str
    opened: bool  # has a <
    closed: bool  # has a >
    placeholder: bool
    address: bool

    @classmethod
    def of(cls, text: str) -> Said:
        opened = text.find("<")
        tagged = opened >= 0 and text.rfind(">") > opened
        return cls(len(text), Counter(text), text[:PART], text[-PART:], opened >= 0, ">" in text, tagged or bool(PLACEHOLDER_PART.search(text)), "://" in text)

    def __add__(self, other: Said) -> Said:
        counts, seam = dict(self.counts), self.tail + other.head
        for c, n in other.counts.items():
            counts[c] = counts.get(c, 0) + n
        placeholder = self.placeholder or other.placeholder or (self.opened and other.closed) or bool(PLACEHOLDER_PART.search(seam))
        address = self.address or other.address or "://" in seam
        return Said(self.length + other.length, counts, (self.head + other.head)[:PART], (self.tail + other.tail)[-PART:], self.opened or other.opened, self.closed or other.closed, placeholder, address)

    def score(self) -> float:
        if self.length < LEAST_LENGTH or self.placeholder or (self.length <= PART and PLACEHOLDER_WHOLE.fullmatch(self.head)):
            return -5.0
        spaces = sum(n for c, n in self.counts.items() if c.isspace())
        if self.address or self.head.startswith(("/", "./", "~/")) or spaces > 5:
            return -5.0
        kinds = sum(any(map(f, self.counts)) for f in (str.islower, str.isupper, str.isdigit, lambda c: not c.isalnum() and not c.isspace()))
        shares = [n / self.length for n in self.counts.values()]
        bits = -sum(p * math.log2(p) for p in shares if p)
        score = 1.0 * (self.length >= 8) + 0.5 * (self.length >= 16) + 0.5 * (kinds >= 2) + 0.5 * (kinds >= 3) + 0.5 * (bits >= 3)
        return score - 0.5 * spaces - 1.5 * (bits < 1.5)


def joined(texts: list[str | Said]) -> str | Said:
    """What is said one after another: as it is, or if that is long, by what its score needs."""
    if all(isinstance(x, str) for x in texts) and sum(map(len, texts)) <= LONG_TEXT:
        return "".join(texts)
    return reduce(Said.__add__, [Said.of(x) if isinstance(x, str) else x for x in texts])


def literal_score(value: str | Said) -> float:
    """How much a literal looks like a secret, from -5 to 3."""
    return (Said.of(value) if isinstance(value, str) else value).score()


#: A score, minus the number of the name among those bound, and the name: of equal scores the first name counts.
Best = tuple[float, int, str]
NONE: Best = (-math.inf, 0, "")


@dataclass(eq=False, slots=True)
class Constant:
    """What a name may stand for: a literal, or the constants that it is made of; what they say together; the best names reached."""

    said: str | Said
    span: tuple[int, int] | None  # where its only literal stands; none if it has several
    below: tuple[Constant, ...] = ()
    alone: Best = NONE  # of names that stand for no other literal
    among: Best = NONE  # of names that stand for several


@dataclass
class Reading:
    """A text as the lexer goes through it: what names stand for by now, and all constants, in the order of their making."""

    text: str

    def __post_init__(self) -> None:
        self.constants: dict[str, Constant] = {}
        self._made: list[Constant] = []
        self._named = 0
        self._bare_end = self._last_digit = -1

    def run(self) -> None:
        at = 0
        while (m := _SITE.search(self.text, at)) is not None:
            at = self._element(m) if m["element"] else self._site(m)

    def _element(self, m: re.Match) -> int:
        body = _ELEMENT_TEXT.match(self.text, m.end())
        if not self.text.startswith(f"</{m['element']}>", body.end()):
            return m.end()
        value = body.group().rstrip()
        self._bind(m["element"], self._literal(body.start(), body.start() + len(value)))
        return body.end()

    def _site(self, m: re.Match) -> int:
        name, at = (m["name"] or m["option"] or m["setter"]).lstrip("$"), m.end()
        if m["setter"] and not re.match(r"(?:.*\.)?(?:set|with|add)_?[^\W\d]", name, re.I):
            return at
        if m["op"] == ":" and (note := _ANNOTATION.match(self.text, at)) is not None:
            at = note.end()
        if (scheme := _SCHEME.match(self.text, at)) is not None:
            at = scheme.end()
        value, end = self._expression(at, bare=m["op"] in ("=", ":", ":=", "?=", "=>") or bool(m["option"]))
        if value is None:
            return m.end()
        if m["op"] == "+=" and (before := self._known(name)) is not None:
            value = self._constant([before, value], [before.said, value.said])
        self._bind(name, value)
        # A value may itself be a name with a value: {"a": b = "c"}.
        return max(m.end(), end)

    def _expression(self, at: int, bare: bool) -> tuple[Constant | None, int]:
        """Literals and names joined by operators or side by side, as one constant, and where it ends."""
        below: list[Constant] = []
        said: list[str | Said] = []
        end, known = at, False
        while (t := _TERM.match(self.text, at)) is not None:
            if t["string"]:
                own = self._literal(t.start("string") + 1, t.end() - 1)
                below += [own, *self._template(self.text[slice(*own.span)])]
                said.append(own.said)
            elif (constant := self._known(t["var"] or t["name"])) is not None:
                below.append(constant)
                said.append(constant.said)
            elif t["name"] and (call := _CALL.match(self.text, t.end())) is not None and not known:
                at = call.end()  # a function around a literal: decode("...")
                continue
            else:
                break
            known, end = True, t.end()
            joint = _JOINT.match(self.text, end)
            at = joint.end()
            if not joint.group().strip() and not (t["string"] and self.text[at : at + 1] in "\"'`"):
                break
        if known:
            return self._constant(below, said), end
        if bare and (run := self._bare(at)) > at:
            return self._literal(at, at + len(self.text[at:run].rstrip(".:!?"))), run
        return None, end

    def _bare(self, at: int) -> int:
        """Where a value without quotes ends. It must have a digit, as mere words follow such marks in prose and code; a run of characters is read once, however many marks it holds."""
        if at >= self._bare_end:
            run = _BARE.match(self.text, at)
            if run is None:
                return at
            self._bare_end = run.end()
            self._last_digit = max((k for k in range(at, run.end()) if self.text[k].isdigit()), default=-1)
        return self._bare_end if self._last_digit >= at else at

    def _literal(self, start: int, end: int) -> Constant:
        self._made.append(Constant(joined([self.text[start:end]]), (start, end)))
        return self._made[-1]

    def _constant(self, below: Iterable[Constant], said: list[str | Said]) -> Constant:
        below = tuple(dict.fromkeys(below))
        if len(below) == len(said) == 1:
            return below[0]
        spans = {c.span for c in below}
        self._made.append(Constant(joined(said), spans.pop() if len(spans) == 1 else None, below))
        return self._made[-1]

    def _template(self, value: str) -> list[Constant]:
        """The constants that a string's own ${name} or {name} stand for."""
        if "{" not in value and "$" not in value:
            return []
        return [c for m in _INSIDE.finditer(value) if (c := self._known(m[1] or m[2])) is not None]

    def _known(self, name: str | None) -> Constant | None:
        return self.constants.get((name or "").removeprefix("self.").removeprefix("this."))

    def _bind(self, name: str, value: Constant) -> None:
        self.constants[name.removeprefix("self.").removeprefix("this.")] = value
        said = name_score(name)
        if said:
            self._named += 1
            best = said + literal_score(value.said), -self._named, name
            if value.span:
                value.alone = max(value.alone, best)
            else:
                value.among = max(value.among, best)

    def reached(self) -> dict[tuple[int, int], tuple[float, str]]:
        """The literals that names of some score stand for, with the best such name's score and name."""
        found: dict[tuple[int, int], Best] = {}
        for c in reversed(self._made):  # a constant is made after those below it
            for part in c.below:
                part.alone, part.among = max(part.alone, c.alone), max(part.among, c.among)
            if not c.below:
                # A part of a larger constant counts with it, unless it says nothing by itself: separators, templates.
                text = self.text[slice(*c.span)]
                best = c.alone if c.among <= c.alone or len(text) < 4 or _INSIDE.search(text) else c.among
                if best > found.get(c.span, NONE):
                    found[c.span] = best
        return {span: (score, name) for span, (score, _, name) in found.items()}


def literals(text: str) -> list[tuple[int, int, str, float]]:
    """start, end, name and score of the literals that a sensitive name has reached, by start."""
    reading = Reading(text)
    reading.run()
    return sorted((a, b, name, score) for (a, b), (score, name) in reading.reached().items())


def added_spans(text: str, low: str, base: list[Span]) -> list[Span]:
    """All literals of enough score that lie in no base span. They never overlap, as the lexer goes on behind each."""
    if not any(h in low for h in _HINTS) and not ("pin" in low and _PIN.search(text)):
        return []
    found: list[Span] = []
    own, k, reach = sorted(base), 0, 0
    for a, b, _, score in literals(text):
        while k < len(own) and own[k][0] <= a:
            reach, k = max(reach, own[k][1]), k + 1
        if score >= LEAST_SCORE and b > reach:
            found.append((a, b, 3))
    return found


def find_spans(text: str) -> tuple[list[Span], list[Span]]:
    """Base spans and added spans, by start and then by kind."""
    low = text.lower()
    base = base_spans(text, low)
    by_start = lambda s: (s[0], s[2], s[1])
    return sorted(base, key=by_start), sorted(added_spans(text, low, base), key=by_start)


def find(docs: DataFrame) -> DataFrame:
    """doc_id and spans (kind, start, end in code points, base) of each row's whole text, by start and then by kind.

    Null and empty texts have no spans; repeated rows are each returned; a very long text is read whole. Of spans that begin
    together the kinds' order decides; a name bound twice stands for its latest value. Only doc_id and text are read, so other
    columns may have any name. An empty table gives no row.
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

    return identified(docs).mapInArrow(run, "doc_id long, spans array<struct<kind:string,start:int,end:int,base:boolean>>")


def _of_kind(kind: str):
    return lambda s: s["kind"] == kind


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = F.filter("spans", lambda s: s["base"])
    written = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    counts = [F.size(F.filter(base, _of_kind(k))).cast("long").alias(f"n_{k}") for k in KINDS[:3]]
    added = F.size(F.filter("spans", lambda s: ~s["base"])).cast("long").alias("n_added")
    return find(documents(spark, sf_dir)).select("doc_id", *counts, F.sha2(written(base), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"), added)
