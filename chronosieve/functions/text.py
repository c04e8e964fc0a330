"""Gates, fingerprints and small parsers on text columns."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# fixed values: what reads as an identifier, a date or a measurement
LONG_DIGITS = r"\d{7,}"
ISO_DATE = r"\b\d{4}-\d{2}-\d{2}\b"
UNITS = ["mmol/?l", "mg/?dl", "meq/?l", "g/?dl", "/ul", "k/ul", "mmhg", "mcg", "ng/?ml", "u/?l"]
VALUE_UNIT = rf"(?i)\b\d+(?:\.\d+)?\s?(?:{'|'.join(UNITS)})\b"


def blocked_reason(text: Column, forbidden: list[str] = (), exempt: Column | None = None, date: str = ISO_DATE, value_unit: str = VALUE_UNIT, digits: str = LONG_DIGITS) -> Column:
    """Why a text may not leave: id, date, value_unit or digits, in this order; null if it may. `exempt` lifts all but id."""
    free = exempt if exempt is not None else F.lit(False)
    has_id = F.lit(False)
    for x in forbidden:
        has_id = has_id | text.contains(x)
    return F.when(has_id, "id").when(~free & text.rlike(date), "date").when(~free & text.rlike(value_unit), "value_unit").when(~free & text.rlike(digits), "digits")


def leaked(text: Column, terms: Column, shortest: int = 4) -> Column:
    """Terms of at least `shortest` characters that occur in the text, case aside, sorted and unique."""
    low = F.lower(text)
    return F.array_sort(F.array_distinct(F.filter(F.transform(terms, F.lower), lambda t: (F.length(t) >= shortest) & low.contains(t))))


def fingerprint(items: Column) -> Column:
    """16 hex digits of the SHA-1 of the sorted distinct lower-case items."""
    return F.substring(F.sha1(F.concat_ws("|", F.array_sort(F.array_distinct(F.transform(items, F.lower))))), 1, 16)


def any_synonym(text: Column, synonyms: list[str]) -> Column:
    return F.exists(F.array(*map(F.lit, synonyms)), lambda s: F.lower(text).contains(F.lower(s)))


def content_key(names: Column) -> Column:
    """16 hex digits of the SHA-256 of the sorted entries, joined by bars: it changes when any entry does."""
    return F.substring(F.sha2(F.array_join(F.array_sort(names), "|"), 256), 1, 16)


def _balanced(text: str, quotes: bool) -> list[str]:
    """The outermost balanced {...} parts in one pass; with `quotes`, braces inside double quotes do not count."""
    found, depth, start, inside, skip = [], 0, 0, False, False
    for k, c in enumerate(text):
        if skip:
            skip = False
        elif inside:
            inside, skip = c != '"', c == "\\"
        elif c == '"':
            inside = quotes and depth > 0
        elif c == "{":
            start = start if depth else k
            depth += 1
        elif c == "}" and depth:
            depth -= 1
            if not depth:
                found.append(text[start : k + 1])
    return found


def _parsed(part: str) -> dict | None:
    """Strictly, or else with single quotes and line ends repaired."""
    for attempt in (part, part.replace("'", '"').replace("\n", " ")):
        try:
            value = json.loads(attempt)
        except ValueError:
            continue
        return value if isinstance(value, dict) else None
    return None


def _last_object(text: str | None) -> str | None:
    """The last outermost object of a text that parses, braces counted without regard to quotes first."""
    for quotes in (False, True):
        for part in reversed(_balanced(text or "", quotes)):
            value = _parsed(part)
            if value is not None:
                return json.dumps(value, sort_keys=True)
    return None


@F.pandas_udf(T.StringType())
def last_json_object(text: pd.Series) -> pd.Series:
    """Scanning for balanced braces is sequential, so this one is a pandas UDF."""
    return text.map(_last_object)


def last_fragment(text: Column, schema: str) -> Column:
    """The last {...} without inner closing brace that parses as `schema`, or null."""
    parts = F.reverse(F.regexp_extract_all(text, F.lit(r"(?s)\{.*?\}"), F.lit(0)))
    parsed = F.transform(parts, lambda x: F.from_json(x, schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__bad"}))
    return F.try_element_at(F.filter(parsed, lambda x: x.isNotNull()), F.lit(1))


def compact_items(items: Column, fields: list[str], n: int = 8, cut: int = 1800) -> Column:
    """The first n structs of an array with some fields only, as JSON of at most `cut` characters."""
    small = F.transform(F.slice(items, 1, n), lambda x: F.struct(*[x[f].alias(f) for f in fields]))
    return F.substring(F.to_json(small), 1, cut)
