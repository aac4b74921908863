"""Texts that models answer with: envelopes, fences and strict JSON. Nothing is repaired; what doesn't hold is named."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

MOST_BYTES = 16_384


def occurrences(text: Column, part: str) -> Column:
    return ((F.length(text) - F.length(F.replace(text, F.lit(part), F.lit("")))) / len(part)).cast("int")


def unfenced(text: Column) -> Column:
    """What an outer Markdown JSON fence of its own lines encloses; any other text as it is."""
    lines = F.split(F.regexp_replace(F.trim(text), "\r\n?", "\n"), "\n")
    fenced = (F.size(lines) >= 3) & F.trim(F.element_at(lines, 1)).isin("```json", "```") & (F.trim(F.element_at(lines, -1)) == "```")
    return F.when(fenced, F.array_join(F.slice(lines, 2, F.greatest(F.lit(0), F.size(lines) - 2)), "\n")).otherwise(text)


def envelope(text: Column, tag: str) -> dict[str, Column]:
    """body and answer of a text with exactly one open and one close tag in order, and a status that says what is wrong."""
    opening, closing = f"<{tag}>", f"</{tag}>"
    a, b = F.instr(text, opening), F.instr(text, closing)
    n_open, n_close = occurrences(text, opening), occurrences(text, closing)
    body = F.trim(F.substr(text, a + len(opening), b - a - len(opening)))
    answer = F.trim(F.substr(text, b + len(closing)))
    status = F.when((n_open == 0) & (n_close == 0), "no_tags").when((n_open != 1) | (n_close != 1), "unbalanced_tags").when(b < a, "tags_out_of_order").when((body == "") | (answer == ""), "empty_part").otherwise("ok")
    return {"status": status, "body": F.when(status == "ok", body), "answer": F.when(status == "ok", answer)}


def recovered_envelope(text: Column, tag: str) -> Column:
    """A text whose close tag is missing, with one put before its only JSON object, if nothing else is ambiguous; else as it is."""
    opening, closing = f"<{tag}>", f"</{tag}>"
    recoverable = (occurrences(text, opening) == 1) & (occurrences(text, closing) == 0) & F.rlike(text, F.lit(r"^\s*<" + tag + r">[^{}]*\S[^{}]*\{[^{}]*\}\s*$"))
    at = F.instr(text, "{")
    return F.when(recoverable, F.concat(F.substr(text, F.lit(1), at - 1), F.lit(closing), F.substr(text, at))).otherwise(text)


def _closed_object(raw: str, keys: frozenset[str], enum_key: str, allowed: frozenset[str]) -> str:
    if raw is None:
        return "missing"
    if len(raw.encode()) > MOST_BYTES:
        return "too_long"

    class Repeated(ValueError):
        pass

    def unique(pairs):
        if len({k for k, _ in pairs}) != len(pairs):
            raise Repeated
        return dict(pairs)

    def no_constant(_):
        raise ValueError

    try:
        value = json.loads(raw, object_pairs_hook=unique, parse_constant=no_constant)
    except Repeated:
        return "repeated_key"
    except (ValueError, RecursionError):
        return "not_json"
    if not isinstance(value, dict):
        return "not_an_object"
    if set(value) != keys:
        return "other_keys"
    return "ok" if isinstance(value[enum_key], str) and value[enum_key] in allowed else "other_value"


def strict_answer(keys: set[str], enum_key: str, allowed: set[str]):
    """A column function: ok, or what is wrong with a JSON answer of a closed shape. Repeated keys can't be seen by the built-in parsers, hence Arrow batches of Python."""
    wanted, values = frozenset(keys), frozenset(allowed)

    @F.pandas_udf("string")
    def parse(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for raw in batches:
            yield raw.map(lambda r: _closed_object(r, wanted, enum_key, values))

    return parse


def verb(text: Column) -> Column:
    """The verb of a program line such as <char0> [Walk] <door> (3)."""
    return F.lower(F.regexp_extract(text, r"\[([A-Za-z]+)\]", 1))


def program_line(actor: Column, verb_name: Column, target: Column, number: Column) -> Column:
    return F.format_string("<%s> [%s] <%s> (%d)", actor, verb_name, target, number)


def cited(citations: Column, known: Column) -> Column:
    """Whether all citations are among the known ones and none repeats."""
    return (F.size(F.array_except(citations, known)) == 0) & (F.size(F.array_distinct(citations)) == F.size(citations))


def question(entity: Column, state: Column, start_us: Column, end_us: Column) -> Column:
    """What a verifier is asked about a state in an interval."""
    return F.concat_ws("\n", F.concat(F.lit("Is the "), entity, F.lit(" "), state, F.lit("?")), F.format_string("Interval: %d to %d us.", start_us, end_us), F.lit("Answer yes, no or unknown, and cite what you saw."))
