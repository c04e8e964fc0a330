"""Differences between timestamps, to the microsecond, and what is built on them."""

from pyspark.sql import Column
from pyspark.sql import functions as F

HOUR_US, DAY_US = 3_600_000_000, 86_400_000_000


def _col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def micros_between(a, b) -> Column:
    """Microseconds from a to b, negative if b is before a."""
    return F.timestamp_diff("MICROSECOND", _col(a), _col(b))


def hours_between(a, b) -> Column:
    return micros_between(a, b) / F.lit(float(HOUR_US))


def whole_days(a, b) -> Column:
    """Whole days from a to b, rounded down."""
    return F.floor(micros_between(a, b) / F.lit(float(DAY_US))).cast("long")


def age_at(t, birth_year, default: int = 50) -> Column:
    """Year of t minus the year of birth, `default` where that is unknown."""
    return F.coalesce(F.year(_col(t)) - _col(birth_year), F.lit(default))


def age_from_anchor(t, anchor_age, anchor_year) -> Column:
    """The age at a reference year, carried on to the year of t."""
    return _col(anchor_age) + F.year(_col(t)) - _col(anchor_year)


def hours_from(anchor, t, digits: int = 1) -> Column:
    """Signed hours from the anchor, rounded; negative before it."""
    return F.round(hours_between(anchor, t), digits)


def time_zero(intime, first_event, offset_hours: float = 24) -> Column:
    """The first event if there is one, else the time of arrival and an offset."""
    return F.coalesce(_col(first_event), F.timestamp_add("MICROSECOND", F.lit(int(offset_hours * HOUR_US)), _col(intime)))
