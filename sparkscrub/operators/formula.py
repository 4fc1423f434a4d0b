"""total = quantity x price - discount + tax + shipping: finding the rule and the rows that break it."""

from __future__ import annotations

from collections.abc import Callable
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import names
from ..functions import vocab as V

TOLERANCE = 0.01
MIN_RATE = 0.5
BATCH = 150  # combinations tested per pass

Reader = Callable[[str], Column]


def formula_columns(columns: list[str]) -> list[str]:
    words = V.TOTAL_WORDS + V.QUANTITY_WORDS + V.PRICE_WORDS + V.DISCOUNT_WORDS + V.TAX_WORDS + V.SHIPPING_WORDS
    return names.columns_named(columns, words)


def expected_total(rule: dict, number: Reader) -> Column:
    value = number(rule["cantidad"]) * number(rule["precio"])
    if rule.get("descuento"):
        value = value - F.coalesce(number(rule["descuento"]), F.lit(0.0))
    for part in ("impuesto", "envio"):
        if rule.get(part):
            value = value + F.coalesce(number(rule[part]), F.lit(0.0))
    return value


def breaks_rule(rule: dict, number: Reader) -> Column:
    """True where total and expected are both known and differ by more than the tolerance."""
    total, expected = number(rule["total"]), expected_total(rule, number)
    limit = F.greatest(F.abs(expected) * rule.get("tolerancia", TOLERANCE), F.lit(0.01))
    return F.coalesce(F.abs(total - expected) > limit, F.lit(False))


def rule_text(rule: dict) -> str:
    out = f"{rule['cantidad']} × {rule['precio']}"
    for part, sign in (("descuento", "−"), ("impuesto", "+"), ("envio", "+")):
        if rule.get(part):
            out += f" {sign} {rule[part]}"
    return out


def candidate_rules(columns: list[str], tolerance: float = TOLERANCE) -> list[dict]:
    """Every combination the names allow, adjustments tried before leaving them out."""
    total, quantity, price = (names.columns_named(columns, w) for w in (V.TOTAL_WORDS, V.QUANTITY_WORDS, V.PRICE_WORDS))
    used = {*total, *quantity, *price}
    extras = [[c for c in names.columns_named(columns, w) if c not in used] + [None]
              for w in (V.DISCOUNT_WORDS, V.TAX_WORDS, V.SHIPPING_WORDS)]
    rules = []
    for t, c, p, d, i, e in product(total, quantity, price, *extras):
        chosen = [x for x in (d, i, e) if x]
        if len({t, c, p}) == 3 and len(set(chosen)) == len(chosen):
            rules.append({"total": t, "cantidad": c, "precio": p, "descuento": d, "impuesto": i, "envio": e,
                          "tolerancia": tolerance})
    return rules


def match_rates(df: DataFrame, rules: list[dict], number: Reader) -> list[float | None]:
    """Share of checkable rows each rule explains: one aggregation per batch of rules."""
    rates: list[float | None] = []
    for start in range(0, len(rules), BATCH):
        batch = rules[start:start + BATCH]
        aggs = []
        for i, rule in enumerate(batch):
            known = number(rule["total"]).isNotNull() & expected_total(rule, number).isNotNull()
            aggs += [F.count_if(known).alias(f"n{i}"), F.count_if(known & ~breaks_rule(rule, number)).alias(f"m{i}")]
        row = df.agg(*aggs).first()
        rates += [row[f"m{i}"] / row[f"n{i}"] if row[f"n{i}"] else None for i in range(len(batch))]
    return rates


def best_rule(df: DataFrame, columns: list[str], number: Reader, tolerance: float = TOLERANCE,
              min_rate: float = MIN_RATE) -> tuple[dict | None, float]:
    """The rule that explains most rows (the first on ties), or None below the minimum rate."""
    rules = candidate_rules(columns, tolerance)
    best, best_rate = None, -1.0
    for rule, rate in zip(rules, match_rates(df, rules, number) if rules else []):
        if rate is not None and rate > best_rate:
            best, best_rate = rule, rate
    return (best, best_rate) if best is not None and best_rate >= min_rate else (None, max(best_rate, 0.0))
