"""Column builders: no jobs, no Python workers, all inside whole-stage codegen."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: an unsigned number with a decimal point, or else a run of digits.
FIRST_NUMBER = r"\d+\.\d+|\d+"
# Fixed value: how a readable date begins.
ISO_DATE_START = r"^\d{4}-\d{2}-\d{2}"
# Fixed value: whole numbers as text, with an all-zero fraction allowed ("2", "2.0").
WHOLE_NUMBER = r"^\s*[+-]?\d+(\.0*)?\s*$"


def col(name: str) -> Column:
    """Column by its literal name, dots and blanks included."""
    return F.col("`" + name.replace("`", "``") + "`")


# --- text and codes ---------------------------------------------------------


def first_number(c: Column) -> Column:
    """First unsigned number in a text, as double; null when there is none."""
    return F.regexp_substr(c, F.lit(FIRST_NUMBER)).try_cast("double")


def normalise_code(c: Column, missing: str | None = "0") -> Column:
    """Code text as plain integer text (``"2.0"`` -> ``"2"``).

    Only a missing code becomes ``missing``; unreadable text stays null so that
    it can be counted. The detour by decimal keeps 18-digit codes exact.
    """
    text = c.cast("string")
    whole = F.when(text.rlike(WHOLE_NUMBER), text.try_cast("decimal(38,0)"))
    code = whole.cast("string")
    return code if missing is None else F.when(c.isNull(), F.lit(missing)).otherwise(code)


def number_code(c: Column) -> Column:
    """Code of a floating-point column as text, ``1.0`` form kept, missing as ``nan``."""
    return F.coalesce(c.cast("string"), F.lit("nan"))


def text_flag(c: Column) -> Column:
    """Text booleans to 0/1; anything but ``True`` (missing included) is 0."""
    return F.when(c.cast("string") == "True", 1).otherwise(0)


def false_text_to_int(c: Column) -> Column:
    """The text ``False`` becomes 0, ``True`` 1, the rest is cast to integer."""
    t = c.cast("string")
    return (
        F.when(F.lower(t) == "false", F.lit(0))
        .when(F.lower(t) == "true", F.lit(1))
        .otherwise(t.try_cast("double").try_cast("int"))
    )


def break_label(c: Column, every: int = 10) -> Column:
    """Line break after every ``every`` characters, none at the end."""
    return F.regexp_replace(c, f"(?s)(.{{{every}}})(?=.)", "$1\n")


def strip_brackets(c: Column) -> Column:
    return F.regexp_replace(c, r"[\[\]]", "")


def run_stamp() -> Column:
    """Current time as ``yyyyMMdd_HHmmss`` text."""
    return F.date_format(F.current_timestamp(), "yyyyMMdd_HHmmss")


# --- dates ------------------------------------------------------------------


def is_bad_date(c: Column) -> Column:
    """True where a text does not begin like an ISO date (missing counts as bad)."""
    return ~F.coalesce(c.rlike(ISO_DATE_START), F.lit(False))


def parse_date(c: Column, strict: bool = False) -> Column:
    """Text to date. ``strict`` fails on unreadable text, else it becomes null."""
    return F.to_date(c) if strict else F.try_to_date(c)


def days_between(later: Column, earlier: Column) -> Column:
    """Whole calendar days between two dates."""
    return F.date_diff(later.cast("date"), earlier.cast("date"))


def floor_days_between(later: Column, earlier: Column) -> Column:
    """Whole days between two timestamps, floored (12 hours early is -1)."""
    micros = F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))
    return F.floor(micros / F.lit(86_400_000_000)).cast("int")


# --- conditions -------------------------------------------------------------


def fix_values(c: Column, corrections: dict) -> Column:
    """Replace single known-bad values, leave the rest."""
    out = c
    for bad, good in corrections.items():
        out = F.when(c == F.lit(bad), F.lit(good)).otherwise(out)
    return out


def known(c: Column) -> Column:
    """A number with NaN as missing: the marker that tables written from pandas keep."""
    return F.nullif(c, F.lit(float("nan")))


def present(c: Column) -> Column:
    """True where a value of any plain type is there, NaN being none."""
    return F.coalesce(c.cast("string") != "NaN", F.lit(False))


def temperature_class(c: Column, high: float = 38, low: float = 36) -> Column:
    """2 from ``high`` up, 0 from ``low`` up, 1 below; missing stays missing."""
    c = known(c)
    return F.when(c >= high, 2).when(c >= low, 0).when(c.isNotNull(), 1)


_COMPARE = {
    "<=": lambda m, t: m <= t,
    "<": lambda m, t: m < t,
    ">": lambda m, t: m > t,
    ">=": lambda m, t: m >= t,
}


def threshold_flag(
    measure: Column, recorded: Column, op: str, threshold: float, met: int = 1, unmet: int = 0
) -> Column:
    """Flag from a measurement; the recorded flag stands in for a missing one."""
    measure = known(measure)
    return (
        F.when(measure.isNull(), recorded)
        .when(_COMPARE[op](measure, threshold), met)
        .otherwise(unmet)
    )


def differs_flag(c: Column, literal: str) -> Column:
    """0 where the value equals ``literal``; 1 otherwise, missing included."""
    return F.when(c == literal, 0).otherwise(1)


def only_if_complete(score: Column, parts: Sequence[Column]) -> Column:
    """A score only where all of its parts are present."""
    return F.when(reduce(lambda a, b: a & b, [present(p) for p in parts]), score)


def presence(c: Column) -> Column:
    """1 where the value is above 0, else 0; missing counts as 0."""
    return F.coalesce((known(c) > 0).cast("int"), F.lit(0))


def duration_class(c: Column, long_after: float = 7) -> Column:
    """0 absent; 1 up to ``long_after`` days (negative totals too); 2 beyond."""
    return F.when(c == 0, 0).when(c <= long_after, 1).otherwise(2)


# --- rows -------------------------------------------------------------------


def row_sum(names: Sequence[str]) -> Column:
    """Sum over columns of one row, missing cells as 0."""
    return reduce(lambda a, b: a + b, [F.coalesce(col(n), F.lit(0)) for n in names], F.lit(0))


def positive_names(names: Sequence[str], default: str = "NEGATIVE") -> Column:
    """Names (sorted) of the columns that equal exactly 1, or ``[default]``."""
    hits = F.filter(
        F.array(*[F.when(col(n) == 1, F.lit(n)) for n in sorted(names)]), lambda x: x.isNotNull()
    )
    return F.when(F.size(hits) == 0, F.array(F.lit(default))).otherwise(hits)


def round_half_even(c: Column, digits: int = 1) -> Column:
    return F.bround(c, digits)


def scale_between(c: Column, low: float, high: float) -> Column:
    """Min-max scaling with known bounds; a constant column becomes 0."""
    width = high - low
    if not width:
        return F.when(c.isNotNull(), F.lit(0.0))
    return (c - F.lit(low)) / F.lit(width)
