"""Automatic checks of questions about charts: what a stem gives away, and what an answer must hold.

A check is a boolean column for each dimension; merged() lets a reviewer's verdict
restrict it. Word lists are arguments; the defaults below are the fixed ones.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: phrases that assert a direction, and phrases that name an owner
ASSERTIONS = [
    "will rise", "will fall", "will increase", "will decrease", "will drop", "will climb",
    "will remain", "will stay", "will normalize", "will worsen", "will improve",
    "expected to rise", "expected to fall", "expected to increase", "expected to decrease",
    "likely to rise", "likely to fall", "likely to increase", "likely to decrease",
    "trend upward", "trend downward", "trending up", "trending down",
]
OWNER_REVEALS = [
    "belongs to patient a", "belongs to patient b", "produced by patient a", "produced by patient b",
    "post-state belongs to patient", "post-state is from patient a", "post-state is from patient b",
    "owner is patient", "answer is patient a", "answer is patient b", "correct answer is patient",
    "labs shown are from patient a", "labs shown are from patient b",
]


def phrases_in(text: Column, phrases: list[str]) -> Column:
    """The phrases that a text holds, case aside, sorted and unique."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.array_sort(F.array_distinct(F.filter(F.array(*map(F.lit, phrases)), lambda p: low.contains(p))))


def whole_words(words: list[str]) -> str:
    """A pattern that finds any of the words as a whole, next to no letter, mark, digit or underscore of any script.

    \\b would not do: engines differ in whether it knows more than ASCII letters (Java's
    does until 18, and DuckDB's finds "la" in "lañada").
    """
    edge = r"[^\pL\pM\pN_]"
    return f"(^|{edge})({'|'.join(words)})({edge}|$)"


def markers_in(text: Column, markers: list[str]) -> Column:
    """How many different markers a text holds, case aside."""
    return F.size(phrases_in(text, markers))


def cites_value(text: Column) -> Column:
    return F.coalesce(text, F.lit("")).rlike("[0-9]")


def chart_checks(stem: Column, gold: Column, chart: Column, chain: Column, cited: Column, markers: list[str], elsewhere: list[str]) -> dict[str, Column]:
    """For questions whose answer is a set of measurements.

    gold: labels asked for; chart: map from the chart's labels to whether any value
    is abnormal; chain: steps of the reasoning; cited: whether a reference is attached.
    """
    low = F.lower(F.coalesce(stem, F.lit("")))
    known = F.map_keys(chart)
    inside = F.filter(gold, lambda g: F.array_contains(known, g))
    named = F.exists(known, lambda k: low.contains(F.lower(k)))
    steps = F.array_join(chain, " -> ")
    arrows = F.regexp_count(steps, F.lit("->"))
    return {
        "answerable": (F.size(gold) > 0) & (F.size(inside) == F.size(gold)) & (F.size(phrases_in(stem, elsewhere)) == 0) & ~named,
        "specific": F.exists(inside, lambda g: F.coalesce(F.try_element_at(chart, g), F.lit(False))),
        "causal": (arrows >= 2) | ((arrows >= 1) & (markers_in(steps, markers) >= 2)),
        "grounded": F.coalesce(cited, F.lit(False)),
    }


def direction_checks(stem: Column, targets: Column, truth: Column, expected: Column, reasons: Column, cited: Column, markers: list[str], leak: str) -> dict[str, Column]:
    """For questions whose answer is a direction for each target.

    truth, expected, reasons, cited: maps by target of the true direction, the
    expected one, its justification and whether a reference is attached; leak: a
    pattern that the stem must not match, such as whole_words.
    """
    at = lambda m, t, other: F.coalesce(F.try_element_at(m, t), F.lit(other))
    real = F.filter(targets, lambda t: F.map_contains_key(truth, t))
    right = (F.size(real) > 0) & F.forall(real, lambda t: F.initcap(at(expected, t, "")) == F.element_at(truth, t))
    n_causal = F.size(F.filter(real, lambda t: markers_in(at(reasons, t, ""), markers) >= 1))
    return {
        "answerable": right & (F.size(real) == F.size(targets)) & ~F.lower(F.coalesce(stem, F.lit(""))).rlike(leak),
        "specific": F.exists(real, lambda t: cites_value(at(reasons, t, ""))),
        "causal": n_causal >= F.greatest(F.lit(1), F.floor(F.size(real) / 2)),
        "grounded": (F.size(real) > 0) & F.forall(real, lambda t: at(cited, t, False)),
    }


def owner_checks(stem: Column, owner: Column, predicted: Column, reason: Column, features: Column, cited: Column, markers: list[str], leak: str) -> dict[str, Column]:
    """For questions whose answer is one of two owners."""
    return {
        "answerable": (F.trim(F.upper(F.coalesce(predicted, F.lit("")))) == owner) & ~F.lower(F.coalesce(stem, F.lit(""))).rlike(leak),
        "specific": cites_value(reason),
        "causal": (markers_in(reason, markers) >= 1) & (F.size(features) >= 1),
        "grounded": F.coalesce(cited, F.lit(False)),
    }


def merged(auto: dict[str, Column], review: dict[str, Column]) -> dict[str, Column]:
    """Each dimension passes if the automatic check does and the review, where there is one, does too; accept: all of them."""
    out = {d: c & F.coalesce(review.get(d, F.lit(None).cast("boolean")), F.lit(True)) for d, c in auto.items()}
    accept = F.lit(True)
    for c in out.values():
        accept = accept & c
    return out | {"accept": accept}
