"""Reading and writing dates, built from regular expressions and try_make_timestamp_ntz (no format guessing).

Readable forms, in order: year-first numeric with an optional time, day/month numeric with a four-digit year,
eight digits (yyyymmdd), and English month names ('31 Jan 2025', 'Jan 31, 2025')."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import vocab as V
from .numbers import is_date_type
from .text import let, strip

_CLOCK = r"[ T]+\d{1,2}:\d{2}(?::\d{2}(?:\.\d+)?)?"
_ZONE = r"\s*(?:Z|[+-]\d{2}:?\d{2})?$"
_YMD = r"^\d{4}[-/.]\d{1,2}[-/.]\d{1,2}(?:" + _CLOCK + ")?" + _ZONE
_DMY = r"^\d{1,2}[/.-]\d{1,2}[/.-]\d{4}(?:" + _CLOCK + ")?$"
_DMY_START = r"^\d{1,2}[/.-]\d{1,2}[/.-]\d{4}(?!\d)"
_MONTHS = "|".join(V.MONTH_NAMES)
_DAY_MONTH = rf"(?i)^(\d{{1,2}})[ \-/.]+({_MONTHS})[a-z]*\.?,?[ \-/.]+(\d{{4}})$"
_MONTH_DAY = rf"(?i)^({_MONTHS})[a-z]*\.?[ \-/.]+(\d{{1,2}}),?[ \-/.]+(\d{{4}})$"
SEPARATORS = ("/", ".", "-")

_JAVA = {"%Y": "yyyy", "%m": "MM", "%d": "dd", "%H": "HH", "%M": "mm", "%S": "ss"}


def java_format(fmt: str) -> str:
    """'%Y-%m-%d' -> 'yyyy-MM-dd'."""
    for code, letters in _JAVA.items():
        fmt = fmt.replace(code, letters)
    return fmt


def _part(numbers: Column, i: int) -> Column:
    return F.get(numbers, F.lit(i)).try_cast("int")


def _stamp(y: Column, m: Column, d: Column, numbers: Column | None = None, clock: Column | None = None) -> Column:
    """A timestamp from its parts; the time comes from numbers[3..5] where `clock` holds."""
    def time_part(i: int) -> Column:
        return F.lit(0) if numbers is None else F.coalesce(F.when(clock, _part(numbers, i)), F.lit(0))

    made = F.try_make_timestamp_ntz(y, m, d, time_part(3), time_part(4), time_part(5).cast("decimal(16,6)"))
    return F.when(m.between(1, 12) & d.between(1, 31), made)  # the failed attempt itself is slow, so it is rare


def _digits(t: Column) -> Column:
    return F.split(t, "[^0-9]+")


def numeric_parts(c: Column) -> Column:
    """struct(a, sep, b) of 'a/b/yyyy...', NULL for any other form."""
    t = strip(c.cast("string"))
    sep = F.regexp_extract(t, r"^\d{1,2}([/.-])", 1)
    return F.when(t.rlike(_DMY_START), let(_digits(t), lambda n: F.struct(
        _part(n, 0).alias("a"), sep.alias("sep"), _part(n, 1).alias("b"))))


def _named_month(t: Column) -> Column:
    def month(pattern, group):
        name = F.lower(F.substring(F.regexp_extract(t, pattern, group), 1, 3))
        return F.array_position(F.array(*[F.lit(m) for m in V.MONTH_NAMES]), name).cast("int")

    def number(pattern, group):
        return F.regexp_extract(t, pattern, group).try_cast("int")

    day_month = _stamp(number(_DAY_MONTH, 3), month(_DAY_MONTH, 2), number(_DAY_MONTH, 1))
    month_day = _stamp(number(_MONTH_DAY, 3), month(_MONTH_DAY, 1), number(_MONTH_DAY, 2))
    return F.when(t.rlike(_DAY_MONTH), day_month).when(t.rlike(_MONTH_DAY), month_day)


def _other_forms(t: Column) -> Column:
    def compact(part, a, n):
        return F.substring(part, a, n).try_cast("int")

    return (
        F.when(t.rlike(_YMD), let(_digits(t), lambda n: _stamp(_part(n, 0), _part(n, 1), _part(n, 2), n, F.lit(True))))
        .when(t.rlike(r"^\d{8}$"), _stamp(compact(t, 1, 4), compact(t, 5, 2), compact(t, 7, 2)))
        .when(t.rlike("[A-Za-z]{3}"), _named_month(t))
    )


def parse_date(c: Column, dtype: T.DataType | None = None, day_first_seps: list[str] | None = None) -> Column:
    """Any readable form, day/month tried both ways (month first, then day first; the other way round for the separators
    in `day_first_seps`); else NULL."""
    if dtype is not None and is_date_type(dtype):
        return c.cast("timestamp_ntz")

    def numeric(t: Column, n: Column) -> Column:
        def stamp(month: int, day: int) -> Column:
            return _stamp(_part(n, 2), _part(n, month), _part(n, day), n, F.lit(True))

        both = F.coalesce(stamp(0, 1), stamp(1, 0))
        if not day_first_seps:
            return both
        sep = F.regexp_extract(t, r"^\d{1,2}([/.-])", 1)
        return F.when(sep.isin(*day_first_seps), F.coalesce(stamp(1, 0), stamp(0, 1))).otherwise(both)

    def read(t: Column) -> Column:
        return F.when(t.rlike(_DMY), let(_digits(t), lambda n: numeric(t, n))).otherwise(_other_forms(t))

    return let(strip(c.cast("string")), read)


def day_month_evidence(c: Column) -> dict[str, Column]:
    """Aggregates: per separator, does any date prove day-first (a > 12) or month-first (b > 12)?"""
    parts = numeric_parts(c)
    out = {}
    for i, s in enumerate(SEPARATORS):
        same = parts["sep"] == s
        out[f"dia{i}"] = F.coalesce(F.bool_or(same & (parts["a"] > 12)), F.lit(False))
        out[f"mes{i}"] = F.coalesce(F.bool_or(same & (parts["b"] > 12)), F.lit(False))
    return out


def clear_separators(evidence: dict[str, bool]) -> list[str]:
    """Separators whose dates prove exactly one order."""
    return [s for i, s in enumerate(SEPARATORS) if evidence[f"dia{i}"] != evidence[f"mes{i}"]]


def day_first_separators(evidence: dict[str, bool], day_first: bool = True) -> list[str]:
    """The separators whose ambiguous dates are read day first."""
    clear = clear_separators(evidence)
    return [s for i, s in enumerate(SEPARATORS) if (evidence[f"dia{i}"] if s in clear else day_first)]


def unify_dates(c: Column, fmt: str, day_first_seps: list[str], dtype: T.DataType | None = None) -> Column:
    """FN-12: every readable date as text in one format; unreadable is NULL."""
    if dtype is not None and is_date_type(dtype):
        return F.date_format(c.cast("timestamp_ntz"), java_format(fmt))

    def numeric(t: Column, n: Column) -> Column:
        sep = F.regexp_extract(t, r"^\d{1,2}([/.-])", 1)
        a, b = _part(n, 0), _part(n, 1)
        first = (a > 12) | ((b <= 12) & (sep.isin(*day_first_seps) if day_first_seps else F.lit(False)))
        return _stamp(_part(n, 2), F.when(first, b).otherwise(a), F.when(first, a).otherwise(b), n, t.rlike(_DMY))

    def read(t: Column) -> Column:
        return F.when(t.rlike(_DMY_START), let(_digits(t), lambda n: numeric(t, n))).otherwise(_other_forms(t))

    return F.date_format(let(strip(c.cast("string")), read), java_format(fmt))


def ambiguous_date(c: Column, clear_seps: list[str]) -> Column:
    """Day and month are interchangeable and the column gives no clear hint for that separator."""
    def test(p: Column) -> Column:
        clear = p["sep"].isin(*clear_seps) if clear_seps else F.lit(False)
        return (p["a"] <= 12) & (p["b"] <= 12) & (p["a"] != p["b"]) & ~clear

    return F.coalesce(let(numeric_parts(c), test), F.lit(False))


def text_to_date(c: Column, fmt: str = "%Y-%m-%d", dtype: T.DataType | None = None) -> Column:
    """FN-13: text written in `fmt` (a trailing time is kept) as a timestamp; else NULL."""
    if dtype is not None and is_date_type(dtype):
        return c.cast("timestamp_ntz")
    base = fmt.split(" %H")[0]
    order = sorted(("%Y", "%m", "%d"), key=base.index)
    pattern = "^" + base.replace(".", r"\.")
    for code, digits in (("%Y", r"\d{4}"), ("%m", r"\d{1,2}"), ("%d", r"\d{1,2}")):
        pattern = pattern.replace(code, digits)

    def read(t: Column) -> Column:
        clock = t.rlike(pattern + _CLOCK + "$")
        return F.when(t.rlike(pattern + r"(?!\d)"), let(_digits(t), lambda n: _stamp(
            *[_part(n, order.index(code)) for code in ("%Y", "%m", "%d")], n, clock)))

    return let(strip(c), read)


def month_and_year(c: Column, fmt: str = "%Y-%m-%d", dtype: T.DataType | None = None) -> tuple[Column, Column]:
    stamp = text_to_date(c, fmt, dtype)
    return F.month(stamp), F.year(stamp)


def separator(c: Column) -> Column:
    """FN-26: '-' or '/' when only that one appears."""
    dash, slash = c.contains("-"), c.contains("/")
    return F.when(dash & ~slash, "-").when(slash & ~dash, "/")


def date_shape(t: Column) -> Column:
    """A trimmed text written like a date; bare numbers never are."""
    return t.rlike(V.DATE_SHAPE_RE) | t.rlike(r"^\d{8}$") | t.rlike("[A-Za-z]{3,}")


def guided_date_shape(c: Column) -> Column:
    t = strip(c.cast("string"))
    return t.rlike(V.GUIDED_DATE_ISO_RE) | t.rlike(V.GUIDED_DATE_LATIN_RE)
