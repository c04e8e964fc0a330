"""Directions, flags, deviations and translations of measured values."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def direction(before, after, share: float = 0.2, base: str = "positive") -> Column:
    """rising / falling / stable by relative change.

    base says when there is no relative change: `positive`, from 0 or less any
    positive value is a rise; `nonzero`, only from 0; `product`, never, as the
    values are compared with multiples of the first.
    """
    b, a = _col(before), _col(after)
    if base == "product":
        return F.when(a > b * (1 + share), "rising").when(a < b * (1 - share), "falling").otherwise("stable")
    none = b <= 0 if base == "positive" else b == 0
    change = (a - b) / b
    return F.when(none, F.when(a > 0, "rising").otherwise("stable")).when(change > share, "rising").when(change < -share, "falling").otherwise("stable")


def direction_in_range(before, after, low, high, share: float = 0.15) -> Column:
    """Stable inside the reference range, else the way the value moved; without a usable range by relative change."""
    b, a, lo, hi = map(_col, (before, after, low, high))
    usable = lo.isNotNull() & hi.isNotNull() & (lo < hi)
    moved = F.when(a >= b, "Rising").otherwise("Falling")
    rel = (a - b) / (F.abs(b) + 1e-6)
    return F.when(usable, F.when(a.between(lo, hi), "Stable").otherwise(moved)).otherwise(F.when(rel > share, "Rising").when(rel < -share, "Falling").otherwise("Stable"))


def range_flag(value, low, high) -> Column:
    v = _col(value)
    return F.when(v < _col(low), "low").when(v > _col(high), "abnormal")


def pct_change(before, after) -> Column:
    b = _col(before)
    return F.when(b > 0, (_col(after) - b) / b * 100).otherwise(0.0)


def z_on_range(value, low, high) -> Column:
    """Deviation from the middle of a range, in quarters of the range."""
    lo, hi = _col(low), _col(high)
    return (_col(value) - (lo + hi) / 2) / ((hi - lo) / 4)


def translated(value, mean_a, sd_a, mean_b, sd_b) -> Column:
    """The value of population b at the z-score that `value` has in population a."""
    return _col(mean_b) + (_col(value) - _col(mean_a)) / _col(sd_a) * _col(sd_b)


def rounded(x, digits: int) -> Column:
    """x to so many digits, halves away from zero, as decimals of nine digits count them.

    70.85 moved from 50 and 15 to 50 and 5 is 56.95, which binary arithmetic makes
    56.949999999999996; whether that is a half must not hang on its last bits. What no
    such decimal holds (no number, or 1e19 and more) is rounded as it is.
    """
    v = _col(x)
    return F.coalesce(F.round(v.try_cast("decimal(28,9)"), digits).cast("double"), F.round(v, digits))


def translated_like(value, mean_a, sd_a, mean_b, sd_b) -> Column:
    """`translated`, `rounded` to whole numbers where the value is one, else to one digit."""
    v, t = _col(value), translated(value, mean_a, sd_a, mean_b, sd_b)
    return F.when(v == F.floor(v), rounded(t, 0)).otherwise(rounded(t, 1))


def translated_or_middle(value, mean_a, sd_a, mean_b, sd_b, low, high) -> Column:
    """The translation to one digit where it lies in the range of b, else the middle of that range; the middle also without a deviation."""
    lo, hi = _col(low), _col(high)
    t = rounded(translated(value, mean_a, F.nullif(_col(sd_a), F.lit(0)), mean_b, sd_b), 1)
    return F.when(t.between(lo, hi), t).otherwise(F.round((lo + hi) / 2, 2))


def range_side(value, low, high) -> Column:
    return F.when(_col(value) > _col(high), "HIGH").when(_col(value) < _col(low), "LOW").otherwise("NORMAL")


def percent_outside(value, low, high) -> Column:
    """How far a value lies from its nearer limit, the upper one if it is above it, in percent of that limit."""
    limit = F.when(_col(value) > _col(high), _col(high)).otherwise(_col(low))
    return F.abs(_col(value) - limit) / limit * 100


def rescaled_age(age, kind, factors: dict[str, float]) -> Column:
    """The age in years of another kind, at least 1; unchanged for kinds without a factor. factors: years for one human year."""
    out = _col(age).cast("double")
    for k, f in factors.items():
        out = F.when(_col(kind) == k, F.greatest(F.lit(1.0), F.round(_col(age) * f))).otherwise(out)
    return out


def renamed(value, kind, names: dict[str, dict[str, str]], default: str) -> Column:
    """What a value is called for a kind."""
    out = F.lit(default)
    for k, own in names.items():
        for v, n in own.items():
            out = F.when((_col(kind) == k) & (_col(value) == v), n).otherwise(out)
    return out


def overridden(struct: Column, **fields) -> Column:
    """A copy of a struct with some fields set; the original stays."""
    for k, v in fields.items():
        struct = struct.withField(k, v if isinstance(v, Column) else F.lit(v))
    return struct


def severity_bin(score) -> Column:
    # fixed values: the names of the bins
    s = _col(score)
    return F.when(s < 4, "mild").when(s < 7, "moderate").when(s < 10, "moderately_severe").otherwise("severe")


def difficulty(n_context) -> Column:
    n = _col(n_context)
    return F.when(n <= 1, "hard").when(n == 2, "medium").otherwise("easy")


def gap_bonus(hours) -> Column:
    return F.when(_col(hours).between(6, 24), 1.0).otherwise(0.5)


def relative_gap(before, after) -> Column:
    """How far the first value misses the second, relative to the second; 1 or 0 where that is not positive."""
    b, a = _col(before), _col(after)
    return F.when(a > 0, F.abs(a - b) / a).otherwise(F.when(a != b, 1.0).otherwise(0.0))


def window_score(n_signals, error, hours) -> Column:
    """3 for each signal between, twice the error of the last value, and the bonus for the gap."""
    return 3 * _col(n_signals) + 2 * _col(error) + gap_bonus(hours)
