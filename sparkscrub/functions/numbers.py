"""Reading numbers out of text, as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import vocab as V
from .text import let, strip


def is_numeric_type(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.NumericType)


def is_date_type(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType))


def finite(c: Column) -> Column:
    """Double without NaN and infinities."""
    value = c.cast("double")
    return F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value)


def strict_number(c: Column) -> Column:
    """Text that is a plain number, else NULL (the pattern keeps '12d' out)."""
    return F.when(c.rlike(V.NUMBER_RE), strip(c).try_cast("double"))


def without_currency(c: Column) -> Column:
    return F.regexp_replace(strip(c), V.CURRENCY_RE, "")


def _decimal_comma_last(s: Column) -> Column:
    return s.rlike(r",[^.,]*$")


def comma_evidence(c: Column) -> tuple[Column, Column]:
    """(proves decimal comma, proves thousands comma) for one text already without currency."""
    comma, dot = s_has(c, ","), s_has(c, ".")
    both_decimal = comma & dot & _decimal_comma_last(c)
    both_thousands = comma & dot & ~_decimal_comma_last(c)
    several = comma & ~dot & c.rlike(",.*,")
    single = comma & ~dot & ~c.rlike(",.*,") & (~c.rlike(r",[^,]{3}$") | c.rlike("^-*0,"))
    no = F.lit(False)
    return F.coalesce(both_decimal | single, no), F.coalesce(both_thousands | several, no)


def s_has(c: Column, piece: str) -> Column:
    return c.contains(piece)


def guided_digits(c: Column) -> Column:
    """FN-3's cleaned text: only an optional sign, digits and separators; anything else is NULL."""
    return let(without_currency(c), lambda s: F.when(s.rlike(r"^-?[\d.,]+$"), s))


def lenient_digits(c: Column) -> Column:
    """FN-4's cleaned text: letters make it NULL, other symbols are dropped."""
    def keep(s: Column) -> Column:
        return let(F.regexp_replace(s, r"[^\d,.\-]", ""), lambda k: F.when(~s.rlike(r"\p{L}") & ~k.isin("", "-"), k))

    return let(without_currency(c), keep)


def read_digits(digits: Column, decimal_comma: bool) -> Column:
    """The number in a cleaned text, once the column's comma is known."""
    return let(let(digits, lambda s: _resolve_separators(s, decimal_comma)), strict_number)


def _resolve_separators(s: Column, decimal_comma: bool) -> Column:
    comma, dot = s_has(s, ","), s_has(s, ".")
    as_decimal = F.replace(s, F.lit(","), F.lit("."))
    no_commas = F.replace(s, F.lit(","), F.lit(""))
    european = F.replace(F.replace(s, F.lit("."), F.lit("")), F.lit(","), F.lit("."))
    lone_decimal = F.lit(decimal_comma) | s.rlike("^-*0,") | ~s.rlike(r"^[^,]*(,[^,]{3})+$")
    return (
        F.when(comma & dot, F.when(_decimal_comma_last(s), european).otherwise(no_commas))
        .when(comma, F.when(lone_decimal, as_decimal).otherwise(no_commas))
        .otherwise(s)
    )


def parse_number(c: Column, dtype: T.DataType | None = None, decimal_comma: bool = False) -> Column:
    """FN-3: locale-tolerant number with a strict tail."""
    if dtype is not None and is_date_type(dtype):
        return F.lit(None).cast("double")
    if dtype is not None and not isinstance(dtype, T.StringType):
        return finite(c)
    return read_digits(guided_digits(c), decimal_comma)


def parse_number_lenient(c: Column, dtype: T.DataType | None = None, decimal_comma: bool = False,
                         mostly_plain: bool = False) -> Column:
    """FN-4: the plain reading when half of the column reads plainly, else the lenient one."""
    if dtype is not None and not isinstance(dtype, T.StringType):
        return parse_number(c, dtype)
    if mostly_plain:
        return strict_number(c)
    return read_digits(lenient_digits(c), decimal_comma)


def coordinate(c: Column, dtype: T.DataType | None = None) -> Column:
    """FN-5: the comma is always the decimal separator."""
    if dtype is not None and is_numeric_type(dtype):
        return finite(c)
    return strict_number(F.replace(strip(c.cast("string")), F.lit(","), F.lit(".")))


def rescue_coordinate(number: Column, low: float, high: float, reference: float | None = None) -> Column:
    """FN-6: a value out of range is divided by 10 up to 11 times until it fits; among the scales that fit, the
    one nearest the reference wins, or the first without one."""
    return let(number, lambda x: _rescue(x, low, high, reference))


def _rescue(number: Column, low: float, high: float, reference: float | None) -> Column:
    scaled = F.transform(F.sequence(F.lit(0), F.lit(11)), lambda k: number / F.pow(F.lit(10.0), k.cast("double")))
    fitting = F.filter(scaled, lambda x: (x >= low) & (x <= high))
    if reference is None:
        chosen = F.get(fitting, F.lit(0))
    else:
        ranked = F.transform(fitting, lambda x, i: F.struct(F.abs(x - reference).alias("d"), i.alias("i"), x.alias("x")))
        chosen = F.array_min(ranked)["x"]
    return F.when((number >= low) & (number <= high), number).otherwise(chosen)


def is_whole(c: Column) -> Column:
    return c == F.floor(c)


def number_text(c: Column) -> Column:
    """A number as people write it: 12.0 -> '12', whole numbers up to 2^53 in full, others without cutting digits."""
    whole = is_whole(c) & (F.abs(c) <= float(1 << 53))
    # the shortest text that reads back as the same number; written in full where that takes at most 12 decimals
    full = F.regexp_replace(c.cast("decimal(38,12)").cast("string"), r"\.?0+$", "")
    exact = (F.abs(c) < 1e15) & (full.try_cast("double") == c)
    return F.when(whole, c.cast("decimal(18,0)").cast("string")).when(exact, full).otherwise(c.cast("string"))


def decimals_in_use(c: Column, most: int = 6) -> Column:
    """FN-23 as an aggregate: the smallest d in 0..most with round(x, d) = x for every value."""
    fits = [F.bool_and(F.round(c, d) == c) for d in range(most + 1)]
    out = F.lit(most)
    for d in range(most, -1, -1):
        out = F.when(F.coalesce(fits[d], F.lit(True)), F.lit(d)).otherwise(out)
    return out
