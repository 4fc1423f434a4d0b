"""Text column expressions. Everything here is a native expression: no Python runs per row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocab as V
from .names import strip_accents

_SPACES = "[" + "".join(rf"\u{ord(ch):04x}" for ch in V.WHITESPACE) + "]+"


def let(value: Column, body) -> Column:
    """body(value) with `value` worked out once: Spark would otherwise copy it into every place it is used."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(c: Column) -> Column:
    """Trim every kind of whitespace (trim() alone only removes spaces)."""
    return F.btrim(c, F.lit(V.WHITESPACE))


def squeeze(c: Column) -> Column:
    return F.regexp_replace(c, _SPACES, " ")


def is_blank(c: Column) -> Column:
    """NULL or whitespace only (classic cleaning)."""
    return c.isNull() | (strip(c.cast("string")) == "")


def is_null(c: Column, tokens=V.NULL_TOKENS) -> Column:
    """NULL, blank or one of the null texts (guided cleaning)."""
    return c.isNull() | F.lower(strip(c.cast("string"))).isin(*tokens)


def clean_text(c: Column, lower: bool = True, spaces: bool = True, quotes: bool = True) -> Column:
    """Standard text: trimmed, outer double quotes off, optionally lower case and single spaces."""
    out = strip(c)
    if quotes:
        out = strip(F.btrim(out, F.lit('"')))
    if lower:
        out = F.lower(out)
    return squeeze(out) if spaces else out


def fold(c: Column) -> Column:
    """Lower case, no accents, single spaces."""
    return strip(squeeze(F.translate(F.lower(c), V.ACCENTED, V.PLAIN)))


def alnum_key(c: Column) -> Column:
    """Folded text where every run of other characters is one space ('N/A' -> 'n a')."""
    ascii_only = F.regexp_replace(fold(c), r"[^\x00-\x7f]", "")
    return F.btrim(F.regexp_replace(ascii_only, "[^a-z0-9]+", " "))


def mask(c: Column) -> Column:
    """Digit -> 9, upper -> A, other letter -> a."""
    digits = F.regexp_replace(c, r"\p{Nd}", "9")
    return F.regexp_replace(F.regexp_replace(digits, r"\p{Lu}", "A"), r"(?!A)\p{L}", "a")


def pending_date(c: Column) -> Column:
    """A text that says the date has not happened yet."""
    return F.coalesce(fold(c.cast("string")).isin(*V.PENDING_DATE_VALUES), F.lit(False))


def valid_state(c: Column, valid=V.VALID_STATES) -> Column:
    accepted = [" ".join(strip_accents(str(v).strip().lower()).split()) for v in valid]
    return F.coalesce(fold(c.cast("string")).isin(*accepted), F.lit(False))


def _capital(word: Column) -> Column:
    return F.concat(F.upper(F.substring(word, 1, 1)), F.lower(F.substr(word, F.lit(2))))


def proper_case(c: Column) -> Column:
    """Proper-name case: connectors lower unless first, known acronyms upper, apostrophe parts capitalised.

    The text is cut into words and separators (spaces, hyphens), which are kept as they are."""
    def recase(piece: Column, position: Column, first: Column) -> Column:
        letters = F.lower(F.regexp_replace(piece, "[^a-zA-Z]", ""))
        parts = F.transform(F.split(piece, "'"), _capital)
        return (
            F.when(piece.rlike(r"^[\s\-]"), piece)
            .when((position > first) & fold(piece).isin(*V.LOWERCASE_CONNECTORS), F.lower(piece))
            .when(letters.isin(*V.NAME_ACRONYMS), F.upper(piece))
            .otherwise(F.array_join(parts, "'"))
        )

    def rebuild(pieces: Column) -> Column:
        first = F.when(F.get(pieces, F.lit(0)).rlike(r"^[\s\-]"), F.lit(1)).otherwise(F.lit(0))
        return F.array_join(F.transform(pieces, lambda p, i: recase(p, i, first)), "")

    return F.when(c == "", c).otherwise(let(F.regexp_extract_all(c, F.lit(r"([^\s\-]+|[\s\-]+)"), 1), rebuild))


def one_edit_typo(a: Column, b: Column) -> Column:
    """One substitution, insertion, deletion or adjacent swap between two words of at least five characters
    that start alike and hold no digit."""
    n = F.length(a)
    at = F.transform(F.sequence(F.lit(1), n), lambda i: F.when(F.substr(a, i, F.lit(1)) != F.substr(b, i, F.lit(1)), i))
    differing = F.filter(at, lambda i: i.isNotNull())
    i, j = F.get(differing, F.lit(0)), F.get(differing, F.lit(1))
    swap = (
        (n == F.length(b)) & (F.size(differing) == 2) & (j == i + 1)
        & (F.substr(a, i, F.lit(1)) == F.substr(b, j, F.lit(1)))
        & (F.substr(a, j, F.lit(1)) == F.substr(b, i, F.lit(1)))
    )
    guard = (
        (n >= 5) & (F.length(b) >= 5) & (F.substring(a, 1, 1) == F.substring(b, 1, 1))
        & ~a.rlike(r"\d") & ~b.rlike(r"\d") & (F.abs(n - F.length(b)) <= 1)
    )
    return F.coalesce(guard & ((F.levenshtein(a, b) == 1) | swap), F.lit(False))
