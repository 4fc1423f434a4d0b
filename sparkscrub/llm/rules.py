"""Quality rules of documents: a table of thresholds compiled into one projection of native expressions.

`measures` counts what the rules need, all from one word array and one line array of the whole text. A rule says that a part of a whole
lies between two shares; shares are compared as whole numbers (100 * part against percent * whole), so no rounding decides. `verdict`
compiles a table of rules into one Column; `apply_rules` adds the counts, the names of the rules that failed and the verdict to a table.
Nothing is shuffled and no Python runs. A row's memory grows with its own text (about 150 bytes a word).

Null and empty texts have no words: their counts are 0 and they fail the base rules. Repeated rows are judged one by one. Columns of
the input whose names clash with the counts are replaced by them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let
from .common import WORD

_WHITE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
#: Frequent function words of English, French, German and Spanish.
STOP_WORDS = (
    "the of and to a in is that it for was on with as be are by at from this "
    "le la les de des du et un une que qui est en dans pour par pas sur au ce il elle "
    "der die das und den von zu mit sich ist nicht ein eine auf dem im für als auch es "
    "el los las del y se por con no su para lo más"
).split()
#: What may stand around a stop word.
_EDGES = ".,;:?()\"'«»"


@dataclass(frozen=True)
class Rule:
    """`least` <= 100 * part / whole <= `most`, where the limits are given; of a whole of nothing every share is in order."""

    name: str
    part: str
    whole: str
    least: int | None = None
    most: int | None = None

    def holds(self) -> Column:
        part, whole = F.col(self.part) * 100, F.col(self.whole)
        out = F.lit(True)
        if self.least is not None:
            out = out & (part >= whole * self.least)
        if self.most is not None:
            out = out & (part <= whole * self.most)
        return out


#: Texts that fail one of these are not looked at further.
BASE = (
    Rule("words", "n_words", "one", least=5000),
    Rule("repeated_words", "n_repeat_words", "n_words", most=50),
)
#: Word lengths in hundredths of characters; the others in percent.
DEFAULT = (
    Rule("word_length", "word_chars", "n_words", least=300, most=1000),
    Rule("symbols", "n_symbols", "n_words", most=10),
    Rule("letters", "n_letter_words", "n_words", least=80),
    Rule("stop_words", "n_stop_words", "n_words", least=5),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", most=50),
    Rule("bullet_lines", "n_bullet_lines", "n_lines", most=90),
    Rule("cut_lines", "n_cut_lines", "n_lines", most=30),
)


def _repeated(words: Column) -> Column:
    """Words in windows of three that occur twice or more; equal windows stand side by side once sorted."""
    at = lambda i: F.get(words, i)
    windows = F.transform(F.sequence(F.lit(0), F.size(words) - 3),
                          lambda i: F.struct(F.xxhash64(at(i), at(i + 1), at(i + 2)).alias("h"), at(i).alias("a"), at(i + 1).alias("b"), at(i + 2).alias("c"), i.alias("i")))

    def same(s: Column, x: Column, k: Column) -> Column:
        other = F.get(s, k)
        return F.coalesce((x["h"] == other["h"]) & (x["a"] == other["a"]) & (x["b"] == other["b"]) & (x["c"] == other["c"]), F.lit(False))

    def covered(s: Column) -> Column:
        found = F.filter(s, lambda x, k: same(s, x, k - 1) | same(s, x, k + 1))
        return F.size(F.array_distinct(F.flatten(F.transform(found, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))))

    return F.when(F.size(words) < 4, F.lit(0)).otherwise(let(F.sort_array(windows), covered))


def _kept_by(values: Column, test) -> Column:
    return F.size(F.filter(values, test))


def measures(text: Column, stop_words: list[str] = STOP_WORDS) -> Column:
    """One struct of counts (all long) of a whole text."""
    text = F.coalesce(text, F.lit(""))
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(_WHITE)) != "")

    def counted(both: Column) -> Column:
        w, lines = both["w"], both["l"]
        counts = {
            "n_words": F.size(w),
            "word_chars": F.length(F.translate(text, _WHITE, "")),
            "n_symbols": F.length(text) - F.length(F.translate(text, SYMBOLS, "")),
            "n_letter_words": _kept_by(w, lambda x: F.regexp_like(x, F.lit(r"\p{L}"))),
            "n_stop_words": _kept_by(w, lambda x: F.lower(F.btrim(x, F.lit(_EDGES))).isin(*stop_words)),
            "n_repeat_words": _repeated(w),
            "n_lines": F.size(lines),
            "n_dup_lines": F.size(lines) - F.size(F.array_distinct(lines)),
            "n_bullet_lines": _kept_by(lines, lambda x: F.substring(F.ltrim(x, F.lit(_WHITE)), 1, 1).isin("-", "*", "•")),
            "n_cut_lines": _kept_by(lines, lambda x: F.rtrim(x, F.lit(_WHITE)).endswith("...") | F.rtrim(x, F.lit(_WHITE)).endswith("…")),
        }
        return F.struct(*(c.cast("long").alias(n) for n, c in counts.items()))

    return let(F.struct(words.alias("w"), lines.alias("l")), counted)


COUNTS = ("n_words", "word_chars", "n_symbols", "n_letter_words", "n_stop_words", "n_repeat_words", "n_lines", "n_dup_lines", "n_bullet_lines", "n_cut_lines")


def verdict(rules: tuple[Rule, ...]) -> Column:
    """True where all rules hold."""
    out = F.lit(True)
    for rule in rules:
        out = out & rule.holds()
    return out


def apply_rules(docs: DataFrame, rules: tuple[Rule, ...] = DEFAULT, base: tuple[Rule, ...] = BASE, text: str = "text") -> DataFrame:
    """`docs` with the counts, `base_failed`, `failed_rules` (names, in the order of the table) and `kept`."""
    own = [c for c in docs.columns if c not in {*COUNTS, "one", "base_failed", "failed_rules", "kept"}]
    clear = [docs[f"`{c.replace('`', '``')}`"] for c in own]
    counted = docs.select(*clear, measures(docs[f"`{text}`"]).alias("__m"))
    quoted = [f"`{c.replace('`', '``')}`" for c in own]
    counted = counted.select(*quoted, *(F.col("__m")[c].alias(c) for c in COUNTS), F.lit(1).cast("long").alias("one"))
    failed = F.filter(F.array(*(F.when(~r.holds(), F.lit(r.name)) for r in (*base, *rules))), lambda x: x.isNotNull())
    return counted.select(*quoted, *COUNTS, (~verdict(base)).alias("base_failed"), failed.alias("failed_rules"), (verdict(base) & verdict(rules)).alias("kept"))


_STOP_SQL = ", ".join(f"'{w}'" for w in STOP_WORDS)
SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
s AS (SELECT r, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws,
  list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ls FROM d),
g AS (SELECT r, unnest(list_transform(range(1, len(ws) - 1), lambda i: {{'i': i, 'g': [ws[i], ws[i + 1], ws[i + 2]]}})) AS x FROM s WHERE len(ws) > 3),
t AS (SELECT r, x.i AS i, count(*) OVER (PARTITION BY r, x.g) AS times FROM g),
c AS (SELECT r, count(DISTINCT i + k) AS n FROM t, (VALUES (0), (1), (2)) AS v(k) WHERE times > 1 GROUP BY r),
m AS (SELECT doc_id, len(ws) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
  length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words,
  len(list_filter(ws, lambda w: regexp_matches(w, '\p{{L}}'))) AS letters, len(ls) AS lines,
  len(list_filter(ws, lambda w: lower(trim(w, '.,;:?()"''«»')) IN ({_STOP_SQL}))) AS stops,
  len(list_filter(ls, lambda l: regexp_matches(l, '^[\x20\x09-\x0D]*[-*•]'))) AS bullets,
  len(list_filter(ls, lambda l: regexp_matches(l, '(\.\.\.|…)[\x20\x09-\x0D]*$'))) AS cut_lines
  FROM s LEFT JOIN c USING (r)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND word_chars BETWEEN 3 * n_words AND 10 * n_words AND 10 * n_symbols <= n_words AND 5 * letters >= 4 * n_words
  AND 20 * stops >= n_words AND 2 * n_dup_lines <= lines AND 10 * bullets <= 9 * lines AND 10 * cut_lines <= 3 * lines AS kept
FROM b
"""
