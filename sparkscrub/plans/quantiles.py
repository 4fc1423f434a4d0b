"""Exact quantiles and running totals that stay distributed.

``percentile`` keeps every distinct value of a group in one buffer, which is fine while the group is small. Beyond that two scans do it:
the first sketches the quantiles, which gives a pair of values around every wanted rank whose ranks are close together for certain; the
second counts what lies below and on each pair and lists what lies strictly between. The list is bounded by the sketch's rank error, whatever
the values are. NaN and infinities are no values on either path.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

GROUP_LIMIT = 1_000_000  # rows of one group that a buffer or a single window may hold
PERCENTILE_LIMIT = 100_000  # beyond this many rows two scans are quicker than percentile()
ACCURACY = 10_000  # rank error of the sketch: rows / ACCURACY
COLUMNS_PER_JOB = 40


def _value(c: Column) -> Column:
    v = c.cast("double")
    return F.when(~F.isnan(v) & (F.abs(v) != float("inf")), v)


def _accuracy(rows: int) -> int:
    """Keeps the list between two sketched quantiles near 5 / ACCURACY of the rows, and below some hundred thousand values."""
    return min(1_000_000, max(ACCURACY, rows // 20_000))


def _around(probs: list[float], rows: int) -> list[float]:
    """Per wanted quantile a lower and an upper probability whose sketched values enclose its two ranks."""
    slack = 1.5 / _accuracy(rows) + 2 / max(rows, 1)
    return [x for p in probs for x in (max(0.0, p - slack), min(1.0, p + slack))]


def _second_scan(v: Column, low: Column, high: Column) -> list[Column]:
    return [F.count_if(v < low), F.count_if(v == low), F.sort_array(F.collect_list(F.when((v > low) & (v < high), v))), F.count_if(v == high)]


def _at_rank(rank: int, low: float, high: float, below: int, on_low: int, between: list[float], on_high: int) -> float:
    rank -= below
    if 0 <= rank < on_low:
        return low
    rank -= on_low
    if 0 <= rank < len(between):
        return between[rank]
    if len(between) <= rank < len(between) + on_high:
        return high
    raise ValueError("the quantile sketch missed its bound")


def _ranks(n: int, probs: list[float]) -> list[int]:
    out = set()
    for p in probs:
        position = p * (n - 1)
        out |= {math.floor(position), math.ceil(position)}
    return sorted(out)


def _interpolate(n: int, probs: list[float], at: dict[int, float]) -> list[float]:
    out = []
    for p in probs:
        position = p * (n - 1)
        low, high = math.floor(position), math.ceil(position)
        out.append(at[low] if low == high else at[low] + (at[high] - at[low]) * (position - low))
    return out


def column_quantiles(df: DataFrame, values: dict[str, Column], probs: list[float], rows: int | None = None,
                     known: dict[str, dict] | None = None, limit: int = PERCENTILE_LIMIT) -> dict[str, list[float] | None]:
    """Exact linear-interpolated quantiles of several columns: one job while they fit a buffer, else two wide scans.

    `known` is accepted for callers that have facts already; the scans do not need them."""
    if not values:
        return {}
    rows = df.count() if rows is None else rows
    out: dict[str, list[float] | None] = {}
    names = list(values)
    for start in range(0, len(names), COLUMNS_PER_JOB):
        own = names[start:start + COLUMNS_PER_JOB]
        narrow = df.select(*[_value(values[n]).alias(f"v{i}") for i, n in enumerate(own)])
        if rows <= limit:
            row = narrow.agg(*[F.percentile(f"v{i}", [float(p) for p in probs]).alias(f"q{i}") for i in range(len(own))]).first()
            out.update({n: row[f"q{i}"] for i, n in enumerate(own)})
            continue
        around = _around(probs, rows)
        first = narrow.agg(*[c for i in range(len(own)) for c in (F.count(f"v{i}").alias(f"n{i}"), F.min(f"v{i}").alias(f"a{i}"), F.max(f"v{i}").alias(f"z{i}"),
                                                                 F.percentile_approx(f"v{i}", around, _accuracy(rows)).alias(f"q{i}"))]).first()
        pairs = {}
        for i in range(len(own)):
            if first[f"n{i}"]:
                wide = _around(probs, first[f"n{i}"])  # fewer filled rows make the two ranks relatively further apart
                found = first[f"q{i}"] if wide == around else narrow.agg(F.percentile_approx(f"v{i}", wide, _accuracy(rows))).first()[0]
                for k in range(len(probs)):
                    low = first[f"a{i}"] if wide[2 * k] == 0 else found[2 * k]
                    high = first[f"z{i}"] if wide[2 * k + 1] == 1 else found[2 * k + 1]
                    pairs[i, k] = (low, high)
        aggs = [c.alias(f"{'leih'[j]}{i}_{k}") for (i, k), (low, high) in pairs.items()
                for j, c in enumerate(_second_scan(F.col(f"v{i}"), F.lit(low), F.lit(high)))]
        second = narrow.agg(*aggs).first() if aggs else {}
        for i, n in enumerate(own):
            if not first[f"n{i}"]:
                out[n] = None
                continue
            at = {}
            for k, p in enumerate(probs):
                for rank in _ranks(first[f"n{i}"], [p]):
                    at[rank] = _at_rank(rank, *pairs[i, k], *[second[f"{x}{i}_{k}"] for x in "leih"])
            out[n] = _interpolate(first[f"n{i}"], probs, at)
    return out


def group_median(df: DataFrame, group: str, value: Column, limit: int = GROUP_LIMIT) -> DataFrame:
    """(grupo, mediana, n) with an exact median per group, NULL being a group of its own.

    When some group is larger than `limit`, every group goes through the two scans; the pairs join the rows by group, a join that adaptive
    execution can split when a group is hot."""
    data = df.select(F.col(f"`{group}`").alias("grupo"), _value(value).alias("v"))
    most = data.groupBy("grupo").agg(F.count("v").alias("n")).agg(F.max("n")).first()[0] or 0
    if most <= limit:
        return data.groupBy("grupo").agg(F.percentile("v", F.lit(0.5)).alias("mediana"), F.count("v").alias("n"))
    accuracy = _accuracy(most)
    slack = 1.5 / accuracy
    pairs = data.groupBy("grupo").agg(F.count("v").alias("n"), F.min("v").alias("a"), F.max("v").alias("z"),
                                      F.percentile_approx("v", [0.5 - slack, 0.5 + slack], accuracy).alias("q"))
    sure = F.col("n") >= 8 * accuracy // 3  # below that a sketch of this accuracy is exact but its two ranks need not enclose both middles
    pairs = pairs.select(F.col("grupo").alias("g"), "n", F.when(sure, F.col("q")[0]).otherwise(F.col("a")).alias("low"),
                         F.when(sure, F.col("q")[1]).otherwise(F.col("z")).alias("high"))
    joined = data.join(pairs, F.col("grupo").eqNullSafe(F.col("g")))
    v, low, high = F.col("v"), F.col("low"), F.col("high")
    counts = joined.groupBy("grupo", "n", "low", "high").agg(*[c.alias(x) for x, c in zip(("below", "on_low", "between", "on_high"), _second_scan(v, low, high))])

    def at(rank: Column) -> Column:
        r = rank - F.col("below")
        inner = r - F.col("on_low")
        return F.when(r < F.col("on_low"), F.col("low")).when(inner < F.size("between"), F.get("between", inner.cast("int"))).otherwise(F.col("high"))

    last = F.col("n") - 1
    median = (at(F.floor(last / 2)) + at(F.ceil(last / 2))) / 2
    return counts.select("grupo", F.when(F.col("n") > 0, median).alias("mediana"), "n")


def running_total(df: DataFrame, part: list[str], order: list[str], value: str, out: str, rows: int | None = None,
                  limit: int = GROUP_LIMIT) -> DataFrame:
    """Sum of `value` over the rows before and at each row, within `part`, in `order` (which must be unique per part).

    A small table uses one window. A large one is range-partitioned, its slices are summed on their own and the
    slice totals (one row per slice) are added back, so no task sees a whole part."""
    rows = df.count() if rows is None else rows
    plain = Window.partitionBy(*[F.col(c) for c in part]).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    if rows <= limit:
        return df.withColumn(out, F.sum(value).over(plain))
    slices = max(2, min(20_000, math.ceil(rows / limit * 4)))
    sliced = materialize(df.repartitionByRange(slices, *part, *order).withColumn("__slice", F.spark_partition_id()))
    totals = sliced.groupBy("__slice", *part).agg(F.sum(value).alias("__total"))
    before = Window.partitionBy(*part).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.withColumn("__offset", F.coalesce(F.sum("__total").over(before), F.lit(0))).drop("__total")
    local = Window.partitionBy("__slice", *part).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    joined = sliced.withColumn("__local", F.sum(value).over(local)).join(offsets, ["__slice", *part])
    return joined.withColumn(out, F.col("__local") + F.col("__offset")).drop("__slice", "__local", "__offset")
