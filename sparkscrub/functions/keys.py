"""Join-key expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let, squeeze, strip

_EMPTY_KEYS = ("", "nan", "none", "null")


def normalize_key(c: Column, mode: str = "texto", width: int = 0) -> Column:
    """FN-17: comparable form of a key column; empty keys are NULL."""
    if mode == "sin_cambios":
        return c
    s = strip(c.cast("string"))
    if mode == "codigo":
        s = F.regexp_replace(F.regexp_replace(s, r"\.0+$", ""), r"[^\d]", "")
    else:
        s = squeeze(F.lower(s))
    s = F.when(~s.isin(*_EMPTY_KEYS), s)
    if mode == "codigo" and width:
        s = F.when(F.length(s) < width, F.lpad(s, width, "0")).otherwise(s)
    return s


def flexible_key(c: Column) -> Column:
    """FN-18: very tolerant form, only to suggest keys."""
    def shape(s: Column) -> Column:
        return F.when(s == "", None).when(s.rlike(r"^\d+$"), F.regexp_replace(s, r"^0+(?=\d)", "")).otherwise(s)

    return let(F.regexp_replace(F.lower(strip(c.cast("string"))), r"\.0$", ""), shape)
