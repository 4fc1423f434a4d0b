"""Greedy clusters of similar texts, found through an inverted index.

Texts are taken in a given order; each joins the first earlier leader whose ratio with it reaches the threshold, else it leads itself. Two
texts of lengths a and b with ratio t have M >= t (a + b) / 2 matched characters in blocks. Between two blocks that follow each other at
least one character is unmatched, so there are at most a + b - 2 M + 1 blocks, and the texts share at least M minus that number of bigrams:

    o(a, b) = (1.5 t - 1) (a + b) - 1        (bigrams counted with their repetitions)

Two sets that share o members share k of the first n - o + k members in any common order. So every text gives the k-subsets of its first
bigrams, rare ones first, as keys (k is chosen by length so that there are few keys), and texts that reach the threshold meet under at least
one key. Texts so short that o is not positive give the keys of their single characters instead, with o = t (a + b) / 2.

What meets is compared exactly. Three steps settle the order: (1) a text that is the first of all its keys leads for certain, and what resembles it
follows; a few such rounds cost one comparison per member of a key. (2) What is left is compared under its keys, and rounds over the
found links decide who leads: a text leads when no earlier text it resembles is open or leads. (3) Every follower takes its first leader."""

from __future__ import annotations

import difflib
import math
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize

#: Keys of one text at most, for its choice of k; rounds of step 1; bigrams whose frequency orders the sets (all others count as rarer).
SUBSETS, SWEEPS, ORDERED = 200, 3, 50_000
#: Texts that are compared one after the other instead.
FEW = 300


def similar(a: str, b: str, threshold: float) -> bool:
    """Ratcliff-Obershelp ratio of (a, b), with its two cheap upper bounds tested first."""
    matcher = difflib.SequenceMatcher(None, a, b)
    return (matcher.real_quick_ratio() >= threshold and matcher.quick_ratio() >= threshold
            and matcher.ratio() >= threshold)


class Bounds:
    """What lengths allow at a threshold."""

    def __init__(self, threshold: float):
        self.t = threshold
        self.rate = 1.5 * threshold - 1
        # the shortest texts share no bigram for certain; they and all they may resemble also have keys of characters
        self.short = math.floor(1 / (2 * self.rate)) if self.rate > 0.01 else None

    def shortest(self, length: int) -> int:
        """Least length of a text that one of `length` may resemble."""
        return max(1, math.ceil(length * self.t / (2 - self.t) - 1e-9))

    def bigrams(self, length: int) -> int:
        """Bigrams shared for certain with an equally long or longer text."""
        return math.ceil(self.rate * 2 * length - 1 - 1e-9)

    def chars(self, length: int) -> int:
        return math.ceil(self.t * length - 1e-9)

    def longest(self, length: int) -> int:
        return math.floor(length * (2 - self.t) / self.t + 1e-9)

    def subset(self, n: int, shared: int) -> int:
        """How many members a key holds, when the longer text of a pair has up to n members and so many are shared for certain."""
        return next((k for k in (3, 2) if k <= shared and math.comb(n - shared + k, k) <= SUBSETS), 1)

    def prefixes(self, length: int) -> list[tuple[str, int, int]]:
        """(kind, members in a key, members of the prefix) of all keys that a text of `length` has."""
        kinds: dict[tuple[str, int], int] = {}
        for other in range(self.shortest(length), length + 1):  # lengths of the shorter text of a pair
            by_char = self.short is None or other <= self.short
            kind, own, most = ("c", length, self.longest(other)) if by_char else ("b", length - 1, self.longest(other) - 1)
            shared = self.chars(other) if by_char else self.bigrams(other)
            k = self.subset(most, shared)
            kinds[kind, k] = max(kinds.get((kind, k), 0), min(own, own - shared + k))
        return [(kind, k, size) for (kind, k), size in kinds.items()]


def _members(text: str, kind: str) -> list[str]:
    """Characters or bigrams, each with how often it has come before."""
    met: Counter = Counter()
    out = []
    for piece in (text if kind == "c" else (text[i:i + 2] for i in range(len(text) - 1))):
        met[piece] += 1
        out.append(f"{piece}{met[piece]}")
    return out


def _keys_of(threshold: float, frequency: dict[str, int]):
    bounds = Bounds(threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plans: dict[int, list] = {}
        for batch in batches:
            rows, keys = [], []
            for i, text in enumerate(batch["norm"].to_pylist()):
                plan = plans.setdefault(len(text), bounds.prefixes(len(text)))
                for kind, k, size in plan:
                    first = sorted(_members(text, kind), key=lambda m: (frequency.get(m, 0), m))[:size]
                    for subset in combinations(first, k):
                        rows.append(i)
                        keys.append(f"{kind}{k}\u0001" + "\u0001".join(subset))
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([batch[c].take(at) for c in ("columna", "orden", "norm")] + [pa.array(keys, pa.string())], names=["columna", "orden", "norm", "clave"])

    return run


def _alike(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fits = [similar(a, b, threshold) for a, b in zip(batch["antes"].to_pylist(), batch["norm"].to_pylist())]
            yield batch.filter(pa.array(fits, pa.bool_()))

    return run


def _pairs(earlier: DataFrame, later: DataFrame, threshold: float) -> DataFrame:
    """(columna, orden, norm, antes, orden_antes) of texts that meet an earlier one under a key and resemble it."""
    a = earlier.select("columna", "clave", F.col("orden").alias("orden_antes"), F.col("norm").alias("antes"))
    met = later.join(a, ["columna", "clave"]).filter("orden_antes < orden").select("columna", "orden", "norm", "antes", "orden_antes").distinct()
    return met.repartition("columna", "norm").mapInArrow(_alike(threshold), met.schema)


def _in_order(threshold: float):
    """The clusters of one column's few texts, one after the other."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        leaders, out = [], []
        for menos, texto, norm in sorted(zip(rows["menos"], rows["texto"], rows["norm"]), key=lambda r: (r[0], r[1].encode())):
            lead = next((x for x in leaders if similar(x, norm, threshold)), None)
            if lead is None:
                leaders.append(norm)
            out.append((rows["columna"].iloc[0], norm, lead or norm))
        return pd.DataFrame(out, columns=["columna", "norm", "lider"])

    return run


def leader_clusters(norms: DataFrame, threshold: float, sweeps: int = SWEEPS, few: int = FEW) -> DataFrame:
    """(columna, norm, lider) of (columna, norm, menos, texto); texts are taken in the order of (menos, texto). Texts are distinct in a column.

    Up to `few` texts need no index: a task takes those of a column in order."""
    norms = materialize(norms.select("columna", "norm", "menos", "texto"))
    if norms.limit(few + 1).count() <= few:
        return norms.groupBy("columna").applyInPandas(_in_order(threshold), "columna string, norm string, lider string")
    ordered = materialize(norms.select("columna", F.struct("menos", "texto", "norm").alias("orden"), "norm"))
    pieces = ordered.select(F.explode(F.sequence(F.lit(1), F.greatest(F.length("norm") - 1, F.lit(1)))).alias("i"), "norm")
    frequent = pieces.groupBy(F.expr("substr(norm, i, 2)").alias("m")).count().orderBy(F.desc("count"), "m").limit(ORDERED).collect()
    frequency = {f"{r['m']}1": r["count"] for r in frequent}
    keys = materialize(ordered.mapInArrow(_keys_of(threshold, frequency), f"columna string, orden {ordered.schema['orden'].dataType.simpleString()}, norm string, clave string"))
    shared = keys.groupBy("columna", "clave").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("columna", "clave")
    keys = materialize(keys.join(shared, ["columna", "clave"]))

    own = ["columna", "norm"]
    leaders = ordered.select(*own).join(keys.select(*own).distinct(), own, "left_anti")  # meets nobody
    followers = leaders.limit(0)
    open_keys = keys
    for _ in range(sweeps):
        first = open_keys.groupBy("columna", "clave").agg(F.min("orden").alias("primera"))
        sure = open_keys.join(first, ["columna", "clave"]).groupBy(*own).agg(F.bool_and(F.col("orden") == F.col("primera")).alias("lidera")).filter("lidera").select(*own)
        sure = materialize(sure)
        if sure.isEmpty():
            break
        rest = open_keys.join(sure, own, "left_anti")
        joined = materialize(_pairs(open_keys.join(sure, own, "left_semi"), rest, threshold).select(*own).distinct())
        leaders, followers = materialize(leaders.union(sure)), materialize(followers.union(joined))
        open_keys = materialize(rest.join(joined, own, "left_anti"))
        if open_keys.isEmpty():
            break

    links = materialize(_pairs(open_keys, open_keys, threshold).select("columna", "norm", "antes"))
    waiting = open_keys.select(*own).distinct()
    while not waiting.isEmpty():
        held = links.join(waiting, own, "left_semi")
        still = held.join(waiting.select("columna", F.col("norm").alias("antes")), ["columna", "antes"], "left_semi").select(*own).distinct()
        sure = materialize(waiting.join(still, own, "left_anti"))
        after = waiting.join(sure, own, "left_anti")
        joined = materialize(held.join(sure.select("columna", F.col("norm").alias("antes")), ["columna", "antes"], "left_semi").select(*own).distinct())
        leaders, followers = materialize(leaders.union(sure)), materialize(followers.union(joined))
        waiting = materialize(after.join(joined, own, "left_anti"))

    led = _pairs(keys.join(leaders, own, "left_semi"), keys.join(followers, own, "left_semi"), threshold)
    chosen = led.groupBy(*own).agg(F.min_by("antes", "orden_antes").alias("lider"))
    return leaders.select("columna", "norm", F.col("norm").alias("lider")).union(chosen)
