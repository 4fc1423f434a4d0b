"""Decisions taken from column names alone: plain string work on the schema, on the driver."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable

from . import vocab as V


def strip_accents(text: str) -> str:
    return "".join(ch for ch in unicodedata.normalize("NFKD", text) if not unicodedata.combining(ch))


def humps(name) -> list[str]:
    """A name cut before every capital that follows a small letter or a digit."""
    return re.split(r"(?<=[a-z0-9])(?=[A-Z])", str(name))


def name_tokens(name) -> list[str]:
    """The plain words of a name: 'nroFactura Año-2' has nro, factura, ano and 2."""
    return [token for hump in humps(name) for token in re.findall("[a-z0-9]+", strip_accents(hump).lower())]


def normalize_name(name) -> str:
    """One spelling of a name: its tokens joined by underscores."""
    return "_".join(name_tokens(name))


def result_words(name) -> set[str]:
    """Small-letter words of a name with their accents, as the vocabularies of computed columns are compared."""
    return {word for hump in humps(name) for word in re.findall("[a-záéíóúñ0-9]+", hump.lower())}


def matches(name, words: Iterable[str]) -> bool:
    """Whether a word names this column: a whole token (digits may be glued on), or, for a multi-word
    pattern, a piece of the normalised name."""
    whole, tokens = normalize_name(name), name_tokens(name)
    for word in words:
        pattern = normalize_name(word)
        if "_" in pattern:
            if pattern in whole:
                return True
        elif pattern and any(re.fullmatch(rf"\d*{pattern}|{pattern}\d+", token) for token in tokens):
            return True
    return False


def columns_named(columns: Iterable[str], words: Iterable[str]) -> list[str]:
    words = tuple(words)
    return [c for c in columns if matches(c, words)]


def is_id(name) -> bool:
    whole = normalize_name(name)
    return "id" in whole.split("_") or any(part in whole for part in V.ID_SUBSTRINGS)


def plain_words(name) -> list[str]:
    """ASCII words of a name, without splitting camelCase."""
    text = unicodedata.normalize("NFKD", str(name)).encode("ascii", "ignore").decode().lower()
    return [w for w in re.split(r"[^a-z0-9]+", text) if w]


def is_key_like(name) -> bool:
    """Plates, SKUs, 'nro_guia', 'numero_cuenta'...: codes never averaged nor filled."""
    if is_id(name) or matches(name, V.KEY_EXTRA_WORDS):
        return True
    words = plain_words(name)
    if set(words) & set(V.KEY_EXTRA_TOKENS):
        return True
    return len(words) >= 2 and words[0] in V.NUMBER_PREFIXES and words[1] in V.NUMBERED_NOUNS


def is_coordinate(name) -> bool:
    return matches(name, V.COORDINATE_WORDS)


def coordinate_kind(name) -> str | None:
    if matches(name, V.LATITUDE_WORDS):
        return "latitud"
    return "longitud" if matches(name, V.LONGITUDE_WORDS) else None


def coordinate_range(name) -> tuple[float, float] | None:
    return {"latitud": V.LATITUDE_RANGE, "longitud": V.LONGITUDE_RANGE}.get(coordinate_kind(name))


def plausible_range(name) -> tuple[float, float] | None:
    tokens = name_tokens(name)
    return next((limits for word, limits in V.PLAUSIBLE_RANGES.items() if word in tokens), None)


def is_non_negative(name) -> bool:
    return matches(name, V.NON_NEGATIVE_WORDS)


def accepts_pending(name) -> bool:
    return matches(name, V.PENDING_DATE_WORDS)


def phone_digit_range(countries: Iterable[str] | None = None) -> tuple[int, int]:
    """Union of the ranges of the known countries; E.164 when none is known."""
    known = [V.PHONE_DIGITS[k] for k in map(normalize_name, countries or ()) if k in V.PHONE_DIGITS]
    if not known:
        return V.INTERNATIONAL_DIGITS
    return min(lo for lo, _ in known), max(hi for _, hi in known)


def date_format(key: str) -> str:
    return V.DATE_FORMATS.get(key, V.DATE_FORMATS["aaaa-mm-dd"])


def fixed_value(value):
    """A typed 'null' means NULL."""
    return None if isinstance(value, str) and value.strip().lower() == "null" else value


def snake_names(columns: Iterable[str]) -> list[str]:
    """snake_case names; repeats get _2, _3..."""
    seen: dict[str, int] = {}
    out = []
    for column in columns:
        text = re.sub(r"[^\w\s]", "", str(column).strip().lower())
        text = re.sub(r"_+", "_", re.sub(r"\s+", "_", text)).strip("_") or "columna"
        seen[text] = seen.get(text, 0) + 1
        out.append(text if seen[text] == 1 else f"{text}_{seen[text]}")
    return out


def deduplicate_names(columns: Iterable[str]) -> list[str]:
    """Repeated names become a, a.1, a.2; a generated name never collides with a present one."""
    counts: dict[str, int] = {}
    used: set[str] = set()
    out = []
    for column in columns:
        k = counts.get(column, 0)
        counts[column] = k + 1
        candidate = base = column if k == 0 else f"{column}.{k}"
        extra = 1
        while candidate in used:
            candidate, extra = f"{base}.{extra}", extra + 1
        used.add(candidate)
        out.append(candidate)
    return out


def repair_header(columns: Iterable[str | None]) -> list[str]:
    """Empty or 'Unnamed: N' headers become Columna_sin_nombre_N; repeats get _2, _3."""
    seen: dict[str, int] = {}
    out = []
    for i, column in enumerate(columns, 1):
        text = (column or "").strip()
        if not text or re.fullmatch(r"(?i)unnamed:\s*\d+", text):
            text = f"Columna_sin_nombre_{i}"
        seen[text] = seen.get(text, 0) + 1
        out.append(text if seen[text] == 1 else f"{text}_{seen[text]}")
    return out
