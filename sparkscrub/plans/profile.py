"""The profile: every per-column fact the operators need, in as few passes over the table as possible.

A pass turns each row into one small struct per column and aggregates by column name. There are only as many groups
as columns and Spark combines them before the shuffle, so a pass is one scan plus a handful of shuffled rows.
Facts are kept on the driver: one small row per column."""

from __future__ import annotations

import math
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import dates, names, numbers, text
from ..functions import vocab as V
from .quantiles import column_quantiles

QUARTILES = [0.25, 0.5, 0.75]
FEW_VALUES = 0.05  # distinct share below which a text column is profiled through its distinct values
_TEXT_FACTS = ("token_nulls", "blanks", "email", "phone_base", "phone", "plain_number", "plain_filled", "number_start", "guided_number",
               "lenient_number", "g_dec", "g_tho", "l_dec", "l_tho", "date_like", "not_pending", "readable_date", "guided_date",
               "dictionary_date", "leading_zero", "all_digits", "max_length", "mean_length")


def col(name: str) -> Column:
    return F.col(f"`{name}`")


def is_flat(dtype: T.DataType) -> bool:
    """Nested and binary columns pass through untouched and unprofiled."""
    return not isinstance(dtype, (T.ArrayType, T.MapType, T.StructType, T.BinaryType, T.VariantType))


def unpivot(df: DataFrame, values: dict[str, Column], keep: list[Column] | None = None) -> DataFrame:
    """(columna, v[, kept columns]) with one row per cell of the named values (one common type)."""
    cells = F.array(*[F.struct(F.lit(n).alias("columna"), c.alias("v")) for n, c in values.items()])
    return df.select(*(keep or []), F.explode(cells).alias("__cell")).select(
        *[k for k in ([c for c in df.select(*(keep or [])).columns] if keep else [])], "__cell.columna", "__cell.v")


def distinct_sketch(hashed: Column, present: Column | None = None) -> Column:
    """Estimated distinct count (about 5 %) from 64-bit hashes: one small mergeable sketch per group."""
    value = hashed if present is None else F.when(present, hashed)
    return F.approx_count_distinct(value)


class Profile:
    """Lazily computed facts about the columns of one table."""

    def __init__(self, df: DataFrame, columns: list[str] | None = None, tokens=V.NULL_TOKENS, limit: int | None = None):
        self.df = df
        self.tokens = tuple(tokens)
        self.types = {f.name: f.dataType for f in df.schema.fields}
        self.columns = [c for c in (columns or df.columns) if is_flat(self.types[c]) and not c.startswith("__")]
        self.limit = limit
        self._quantiles: dict[str, list[float] | None] = {}
        self._exact_distinct: dict[str, int] = {}
        self._numbers: dict[tuple[str, bool], dict] = {}

    # -- column groups ---------------------------------------------------------------------------
    def is_text(self, name: str) -> bool:
        return isinstance(self.types[name], T.StringType)

    def is_numeric(self, name: str) -> bool:
        return numbers.is_numeric_type(self.types[name])

    def is_date(self, name: str) -> bool:
        return numbers.is_date_type(self.types[name])

    def is_bool(self, name: str) -> bool:
        return isinstance(self.types[name], T.BooleanType)

    # -- pass 1: counts and text ratios -------------------------------------------------------------
    @cached_property
    def rows(self) -> int:
        return int(next(iter(self.text.values()))["n"]) if self.columns else self.df.count()

    @cached_property
    def text(self) -> dict[str, dict]:
        """Counts of every column and, for text columns, how many values pass each content test."""
        counts = self._plain_counts(self.columns)
        textual = [c for c in self.columns if self.is_text(c) and counts[c]["data"]]
        if not textual:
            return counts
        # A column with few distinct values is tested value by value, weighted; one with many goes straight through,
        # since gathering its values first would shuffle them all.
        few = [c for c in textual if counts[c]["approx_distinct"] <= FEW_VALUES * counts[c]["data"]]
        many = [c for c in textual if c not in few]
        parts = []
        if few:
            parts.append(unpivot(self.df, {c: col(c) for c in few}).groupBy("columna", "v").agg(F.count(F.lit(1)).alias("w")))
        if many:
            parts.append(unpivot(self.df, {c: col(c) for c in many}).withColumn("w", F.lit(1).cast("long")))
        cells = (parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])).withColumn("present", F.col("v").isNotNull())
        cells = cells.withColumn("t", text.strip("v")).withColumn("has_digit", F.col("t").rlike("[0-9]"))
        v, t, present = F.col("v"), F.col("t"), F.col("present")
        is_text, filled, has_digit = t.isNotNull(), t != "", F.col("has_digit")
        weak = [c for c in names.columns_named(self.columns, V.DATE_WEAK_WORDS)]
        named_weak = F.col("columna").isin(*weak) if weak else F.lit(False)
        staged = {  # worked out once per cell; what needs a digit is skipped where there is none
            "data": F.when(is_text, ~F.lower(t).isin(*self.tokens)).otherwise(present),
            "guided": F.when(has_digit, numbers.guided_digits(t)), "lenient": F.when(has_digit, numbers.lenient_digits(t)),
            "number": has_digit & t.rlike(V.NUMBER_RE), "stamp": F.when(has_digit, dates.parse_date(t)),
            "pending": F.when(named_weak, text.pending_date(t)),
            "digits": F.when(has_digit, F.length(F.regexp_replace(t, r"\D", ""))).otherwise(0),
        }
        cells = cells.withColumns(staged)
        data, guided, lenient, number, digits = map(F.col, ("data", "guided", "lenient", "number", "digits"))
        readable, pending = F.col("stamp").isNotNull(), F.col("pending")
        phone_base = is_text & ~(has_digit & (
            t.rlike(r"\b(?:19|20)\d{2}\b") | t.rlike(r"^-?[\d.,]*\d[.,]\d{1,2}$")
            | t.rlike(r"^-\d{1,3}[.,]\d{3,}$|^\d{1,3}[.,]\d{5,}$")))
        g_dec, g_tho = numbers.comma_evidence(guided)
        l_dec, l_tho = numbers.comma_evidence(lenient)

        def n(condition: Column) -> Column:
            return F.sum(F.when(condition, F.col("w")).otherwise(0))

        agg = cells.groupBy("columna").agg(
            F.sum("w").alias("n"),
            n(~present).alias("nulls"),
            n(present & ~data).alias("token_nulls"),
            n(is_text & ~filled).alias("blanks"),
            n(data).alias("data"),
            n(is_text & t.rlike(V.EMAIL_RE)).alias("email"),
            n(phone_base).alias("phone_base"),
            n(phone_base & digits.between(7, 15)).alias("phone"),
            n(is_text & number).alias("plain_number"),
            n(is_text & filled & number).alias("plain_filled"),
            n(is_text & filled & has_digit & t.rlike(V.NUMBER_START_RE)).alias("number_start"),
            n(is_text & data & numbers.read_digits(guided, False).isNotNull()).alias("guided_number"),
            n(is_text & numbers.read_digits(lenient, False).isNotNull()).alias("lenient_number"),
            F.bool_or(g_dec).alias("g_dec"), F.bool_or(g_tho).alias("g_tho"),
            F.bool_or(l_dec).alias("l_dec"), F.bool_or(l_tho).alias("l_tho"),
            n(is_text & dates.date_shape(t) & readable).alias("date_like"),
            n(is_text & filled & ~pending).alias("not_pending"),
            n(is_text & filled & ~pending & readable).alias("readable_date"),
            n(is_text & data & dates.guided_date_shape(v)).alias("guided_date"),
            n(is_text & data & (t.rlike(V.DICTIONARY_DATE_ISO_RE) | t.rlike(V.DICTIONARY_DATE_LATIN_RE))).alias("dictionary_date"),
            n(is_text & data & t.rlike(r"^0\d+$")).alias("leading_zero"),
            n(is_text & filled & t.rlike(r"^\d+$")).alias("all_digits"),
            F.max(F.when(is_text & data, F.length(t))).alias("max_length"),
            F.try_divide(F.sum(F.when(is_text & data, F.length(t) * F.col("w"))), n(is_text & data)).alias("mean_length"),
        )
        for r in agg.collect():
            counts[r["columna"]].update(r.asDict())
        return counts

    def _plain_counts(self, columns: list[str]) -> dict[str, dict]:
        """Rows, nulls and estimated distinct values of every column: one narrow aggregation, no text work."""
        aggs = []
        for i, c in enumerate(columns):
            value = numbers.finite(col(c)) if isinstance(self.types[c], (T.DoubleType, T.FloatType)) else col(c)
            aggs += [F.count(value).alias(f"n{i}"), distinct_sketch(F.xxhash64(value), value.isNotNull()).alias(f"d{i}")]
        row = self.df.agg(F.count(F.lit(1)).alias("n"), *aggs).first()
        return {c: {**dict.fromkeys(_TEXT_FACTS, 0), "n": row["n"], "nulls": row["n"] - row[f"n{i}"], "data": row[f"n{i}"],
                    "approx_distinct": row[f"d{i}"]} for i, c in enumerate(columns)}

    # -- readings of a column as number ---------------------------------------------------------------
    def guided_comma(self, name: str) -> bool:
        facts = self.text[name]
        return bool(facts["g_dec"] and not facts["g_tho"])

    def guided_number(self, name: str) -> Column:
        comma = self.guided_comma(name) if self.is_text(name) else False
        return numbers.parse_number(col(name), self.types[name], comma)

    def lenient_number(self, name: str) -> Column:
        if not self.is_text(name):
            return numbers.parse_number(col(name), self.types[name])
        facts = self.text[name]
        plain = facts["plain_number"] >= 0.5 * max(facts["n"], 1)
        return numbers.parse_number_lenient(col(name), self.types[name], bool(facts["l_dec"] and not facts["l_tho"]), plain)

    # -- content tests ----------------------------------------------------------------------------------
    def filled(self, name: str) -> int:
        f = self.text[name]
        return f["n"] - f["nulls"] - f["blanks"]

    def present(self, name: str) -> int:
        f = self.text[name]
        return f["n"] - f["nulls"]

    def looks_email(self, name: str, threshold: float = 0.6) -> bool:
        base = self.present(name)
        return bool(base and self.is_text(name) and self.text[name]["email"] / base >= threshold)

    def looks_phone(self, name: str, threshold: float = 0.7) -> bool:
        f = self.text[name]
        return bool(f["phone_base"] and f["phone"] / f["phone_base"] >= threshold)

    def looks_date(self, name: str, threshold: float = 0.7) -> bool:
        if self.is_date(name):
            return True
        base = self.present(name)
        return bool(base and self.is_text(name) and self.text[name]["date_like"] / base >= threshold)

    def weak_date_confirmed(self, name: str, threshold: float = 0.3) -> bool:
        """A column named only by a weak date word counts when its values do not contradict it."""
        if self.is_date(name):
            return True
        if not self.is_text(name):
            return False
        f = self.text[name]
        return f["not_pending"] == 0 or f["readable_date"] / f["not_pending"] >= threshold

    def guided_date(self, name: str, threshold: float = 0.9) -> bool:
        if self.is_date(name):
            return True
        f = self.text[name]
        return self.is_text(name) and f["data"] >= 3 and f["guided_date"] / f["data"] >= threshold

    def mostly_number(self, name: str) -> bool:
        """More than 70 % of the non-null values read plainly as numbers."""
        base = self.present(name)
        return bool(base and self.is_text(name) and self.text[name]["plain_number"] / base > 0.7)

    def guided_numeric(self, name: str, threshold: float = 0.9) -> bool:
        if self.is_numeric(name):
            return True
        f = self.text[name]
        return bool(self.is_text(name) and f["data"] and f["guided_number"] / f["data"] >= threshold)

    def number_with_suffix(self, name: str) -> bool:
        base = self.filled(name)
        return bool(base and self.text[name]["number_start"] / base > 0.7)

    def distinct_share(self, name: str, threshold: float) -> float:
        """Distinct / present; estimated when far from the threshold, exact near it."""
        base = self.filled(name)
        if not base:
            return 0.0
        estimate = self.text[name]["approx_distinct"] / base
        if abs(estimate - threshold) > 0.25 * max(threshold, estimate):
            return estimate
        return self.exact_distinct([name])[name] / base

    def exact_distinct(self, wanted: list[str]) -> dict[str, int]:
        """Exact distinct counts of several columns: distinct cells first (hot values combine map-side)."""
        missing = [c for c in wanted if c not in self._exact_distinct]
        if missing:
            cells = unpivot(self.df, {c: F.when(~text.is_blank(col(c)), numbers.finite(col(c)).cast("string") if self.is_numeric(c)
                                                else col(c).cast("string")) for c in missing})
            counts = cells.filter("v is not null").distinct().groupBy("columna").count().collect()
            found = {r["columna"]: r["count"] for r in counts}
            self._exact_distinct.update({c: found.get(c, 0) for c in missing})
        return {c: self._exact_distinct[c] for c in wanted}

    # -- columns by meaning -------------------------------------------------------------------------------
    def detect(self, words, content=None, exclude=(), exclude_words=()) -> list[str]:
        """COL-8: by name; only when no name matches, by content on non-numeric, non-id columns."""
        named = [c for c in names.columns_named(self.columns, words) if c not in exclude]
        if named or content is None:
            return named
        return [c for c in self.columns if c not in exclude and not names.is_id(c)
                and not names.matches(c, exclude_words) and not self.is_numeric(c) and content(c)]

    @cached_property
    def email_columns(self) -> list[str]:
        return self.detect(V.EMAIL_WORDS, self.looks_email)

    @cached_property
    def phone_columns(self) -> list[str]:
        return self.detect(V.PHONE_WORDS, self.looks_phone, exclude_words=V.NOT_PHONE_WORDS)

    @cached_property
    def date_columns(self) -> list[str]:
        """Classic: strong names; weak names confirmed by content; else content alone."""
        strong = names.columns_named(self.columns, V.DATE_STRONG_WORDS)
        weak = [c for c in names.columns_named(self.columns, V.DATE_WEAK_WORDS)
                if c not in strong and not names.is_id(c) and self.looks_date(c)]
        if strong or weak:
            return strong + weak
        return [c for c in self.columns if not names.is_id(c) and not self.is_numeric(c) and self.looks_date(c)]

    @cached_property
    def guided_date_columns(self) -> list[str]:
        out = []
        for c in self.columns:
            weak = names.matches(c, V.DATE_WEAK_WORDS) and not names.is_id(c)
            other = (names.is_id(c) or names.is_coordinate(c) or names.matches(c, V.EMAIL_WORDS)
                     or names.matches(c, V.PHONE_WORDS))
            if names.matches(c, V.DATE_STRONG_WORDS) or (weak and self.weak_date_confirmed(c)) or (
                    not other and self.guided_date(c)):
                out.append(c)
        return out

    def role(self, name: str, threshold: float = 0.9) -> str:
        """COL-10: id, coordinate, e-mail, phone, date, number or text, tested in a fixed order."""
        if names.is_coordinate(name):
            return "coordenada"
        if names.is_key_like(name):
            return "id"
        if names.matches(name, V.EMAIL_WORDS):
            return "email"
        if names.matches(name, V.PHONE_WORDS):
            return "telefono"
        if name in self.guided_date_columns or self.guided_date(name):
            return "fecha"
        return "numerica" if self.guided_numeric(name, threshold) else "texto"

    @cached_property
    def roles(self) -> dict[str, str]:
        return {c: self.role(c) for c in self.columns}

    @cached_property
    def text_columns(self) -> list[str]:
        """COL-18: text worth standardising, proper names left alone."""
        return [c for c in self.columns if self.role(c, 0.6) in ("texto", "email")
                and not names.matches(c, V.PROPER_NAME_WORDS)]

    @cached_property
    def serial_by_name(self) -> list[str]:
        ids = [c for c in self.columns if names.is_id(c)]
        serial = [c for c in self.columns if c not in ids and names.matches(c, V.SERIAL_WORDS + V.POSITION_WORDS)]
        phones = self.detect(V.PHONE_WORDS, self.looks_phone, exclude=ids, exclude_words=V.NOT_PHONE_WORDS)
        return list(dict.fromkeys(ids + serial + phones))

    @cached_property
    def serial_by_content(self) -> list[str]:
        """COL-11: integers, nearly all unique and nearly all of one length of six digits or more."""
        candidates = [c for c in self.columns if c not in self.serial_by_name and not names.is_id(c)
                      and names.plausible_range(c) is None and not names.is_non_negative(c)
                      and (self.is_numeric(c) or self.is_text(c)) and self.present(c) >= 5]
        facts = self.number_facts(candidates)
        near = [c for c in candidates if facts[c]["n"] >= 0.9 * self.present(c) and facts[c]["whole"]
                and facts[c]["approx_distinct"] >= 0.8 * facts[c]["n"]]
        if not near:
            return []
        values = {c: self.lenient_number(c) for c in near}
        lengths = unpivot(self.df, values).filter("v is not null").groupBy(
            "columna", F.length(F.abs(F.col("v")).cast("decimal(38,0)").cast("string")).alias("len")).count().collect()
        distinct = unpivot(self.df, values).filter("v is not null").distinct().groupBy("columna").count().collect()
        unique = {r["columna"]: r["count"] for r in distinct}
        out = []
        for c in near:
            sizes = sorted(((r["count"], -r["len"]) for r in lengths if r["columna"] == c), reverse=True)
            top, length = sizes[0][0], -sizes[0][1]
            total = sum(s[0] for s in sizes)
            if unique[c] / total >= 0.95 and length >= 6 and top / total >= 0.9:
                out.append(c)
        return out

    @cached_property
    def not_outlier_columns(self) -> list[str]:
        """COL-12: ids, serial numbers, positions and phones never go through outlier checks."""
        return list(dict.fromkeys(self.serial_by_name + self.serial_by_content))

    @cached_property
    def outlier_columns(self) -> list[str]:
        """Numeric columns plus text that mostly reads as numbers, without the excluded ones."""
        out = [c for c in self.columns if self.is_numeric(c) and c not in self.not_outlier_columns]
        for c in self.columns:
            if c in out or c in self.not_outlier_columns or not self.is_text(c):
                continue
            base = self.present(c)
            f = self.text[c]
            lenient = f["plain_number"] if f["plain_number"] >= 0.5 * max(base, 1) else f["lenient_number"]
            if self.mostly_number(c) or (base and lenient / base > 0.7):
                out.append(c)
        return out

    @cached_property
    def never_filled(self) -> set[str]:
        """COL-19: text where a mode would invent data (e-mails, dates by name, mostly distinct text)."""
        out = set()
        for c in self.columns:
            if not self.filled(c) or self.reads_as_number(c):
                continue
            if names.matches(c, V.EMAIL_WORDS + V.DATE_WORDS) or self.looks_email(c) or self.distinct_share(c, 0.5) > 0.5:
                out.add(c)
        return out

    def reads_as_number(self, name: str) -> bool:
        """At least half of the filled values are numbers under the lenient reading."""
        if self.is_numeric(name):
            return bool(self.filled(name))
        if not self.is_text(name) or not self.filled(name):
            return False
        f = self.text[name]
        count = f["plain_number"] if f["plain_number"] >= 0.5 * max(f["n"], 1) else f["lenient_number"]
        return count >= 0.5 * self.filled(name)

    # -- pass 2: numbers ------------------------------------------------------------------------------------
    def number_facts(self, wanted: list[str], guided: bool = False) -> dict[str, dict]:
        missing = [c for c in wanted if (c, guided) not in self._numbers]
        values = {c: self.guided_number(c) if guided else self.lenient_number(c) for c in missing}
        self._numbers.update({(c, guided): f for c, f in number_facts(self.df, values).items()})
        return {c: self._numbers[(c, guided)] for c in wanted}

    def quartiles(self, wanted: list[str], guided: bool = False) -> dict[str, list[float] | None]:
        missing = [c for c in wanted if (c, guided) not in self._quantiles]
        values = {c: self.guided_number(c) if guided else self.lenient_number(c) for c in missing}
        extra = {} if self.limit is None else {"limit": self.limit}
        known = {c: self._numbers[(c, guided)] for c in missing if (c, guided) in self._numbers}
        for c, q in column_quantiles(self.df, values, QUARTILES, self.rows, known, **extra).items():
            self._quantiles[(c, guided)] = q
        return {c: self._quantiles[(c, guided)] for c in wanted}

    def heavy_tailed(self, wanted: list[str]) -> list[str]:
        """COL-13: long natural tails, whose high values are legitimate."""
        facts = self.number_facts(wanted)
        wanted = [c for c in wanted if facts[c]["n"] >= 30 and facts[c]["negatives"] == 0
                  and facts[c]["approx_distinct"] >= 8 and (facts[c]["skew"] or 0) >= 2.0]
        quartiles = {c: q for c, q in self.quartiles(wanted).items() if q and q[2] > q[0]}
        if not quartiles:
            return []
        few = [c for c in quartiles if facts[c]["approx_distinct"] < 15]
        exact = self.exact_distinct(few) if few else {}
        aggs = []
        for i, (c, q) in enumerate(quartiles.items()):
            low, high = fences(q)
            v = self.lenient_number(c)
            aggs.append(F.avg(((v < low) | (v > high)).cast("int")).alias(f"o{i}"))
        row = self.df.agg(*aggs).first()
        return [c for i, c in enumerate(quartiles) if row[f"o{i}"] >= 0.03 and exact.get(c, 10) >= 10]


def is_empty(df: DataFrame, name: str, tokens=V.NULL_TOKENS) -> Column:
    """NULL, NaN, or (text only) blank or a null text: only text is ever compared as text."""
    dtype = df.schema[name].dataType
    if isinstance(dtype, T.StringType):
        return text.is_null(col(name), tokens)
    return (numbers.finite(col(name)) if isinstance(dtype, (T.DoubleType, T.FloatType)) else col(name)).isNull()


def fences(quartiles: list[float], factor: float = 1.5) -> tuple[float, float]:
    q1, q3 = quartiles[0], quartiles[2]
    return q1 - factor * (q3 - q1), q3 + factor * (q3 - q1)


def bounded_scale(q3: float | None) -> int | None:
    """COL-14: the ceiling of a 1-5 or 1-10 scale, when the third quartile suggests one."""
    return None if q3 is None else next((top for top in V.BOUNDED_SCALES if q3 <= top), None)


def adjusted_skew(n: int, skew: float | None) -> float | None:
    """Sample skewness from the population form."""
    if skew is None or n < 3 or math.isnan(skew):
        return None
    return skew * math.sqrt(n * (n - 1)) / (n - 2)


def number_facts(df: DataFrame, values: dict[str, Column]) -> dict[str, dict]:
    """Moments, extremes and flags of several numeric readings, in one pass."""
    if not values:
        return {}
    v = F.col("v")
    agg = unpivot(df, values).groupBy("columna").agg(
        F.count("v").alias("n"), F.count(F.lit(1)).alias("rows"), F.avg("v").alias("mean"),
        F.stddev_samp("v").alias("std"), F.min("v").alias("min"), F.max("v").alias("max"),
        F.skewness("v").alias("skewness"), F.bool_and(numbers.is_whole(v)).alias("whole"),
        F.count_if(v < 0).alias("negatives"), F.count_if(v == 0).alias("zeros"),
        F.bool_and(v.isin(0.0, 1.0)).alias("zero_one"), distinct_sketch(F.xxhash64("v"), v.isNotNull()).alias("approx_distinct"),
        F.max(F.abs(v)).alias("max_abs"),
    )
    out = {r["columna"]: r.asDict() for r in agg.collect()}
    for facts in out.values():
        facts["skew"] = adjusted_skew(facts["n"], facts["skewness"])
    return {c: out[c] for c in values}
