"""Which columns of two tables may join: containment measured on samples of keys, and counted on all keys where that decides.

Keys are worked out once per cell and written as 64-bit hashes; everything after that reads these. A column with many keys is sampled by
hash: its keys whose hash lies below a bound, chosen so that about SAMPLE of them remain. The bound depends on the key alone, so the sample
is even over the distinct keys whatever their frequencies, and partial samples merge by union. A column with few keys is its own sample.
One scan of the other table's hashes looks them up in the samples; what is shuffled are the hits and, per task, at most about SAMPLE keys a
column. Only pairs of two large columns that may reach the wanted share are then counted on all keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import names, numbers
from ..functions.keys import flexible_key
from ..plans.profile import is_flat
from ..session import fresh_path
from .rows import q

#: Keys in a column's sample. A share of 30 % is off by less than 0.75 points in two of three samples.
SAMPLE = 4096
#: Points below the wanted share at which a pair is still counted exactly (more than six of those deviations).
SLACK = 5.0
WANTED = 30.0
#: Sampled keys of one side (12 bytes each) up to which they are broadcast.
BROADCAST_KEYS = 2_000_000
_SCHEMA = "columna_a string, columna_b string, mismo_nombre boolean, coincidencia_pct double"


def as_text(df: DataFrame, name: str) -> Column:
    if isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType)):
        return numbers.number_text(numbers.finite(q(name)))
    return q(name).cast("string")


class Side:
    """One table: its usable columns, its sampled keys and how many each column has."""

    def __init__(self, df: DataFrame, sample: int):
        self.df = df
        self.columns = [f.name for f in df.schema.fields if is_flat(f.dataType)]
        positions = range(len(self.columns))
        self.hashed = self._written(self._cells().select("pos", F.xxhash64("k").alias("h")))
        about = dict.fromkeys(positions, 0) | {r["pos"]: r["n"] for r in self.hashed.groupBy("pos").agg(F.approx_count_distinct("h").alias("n")).collect()}
        self.whole = [about[i] <= sample for i in positions]
        bounds = F.array(*[F.lit((1 << 63) - 1 if self.whole[i] else -(1 << 63) + int(sample / about[i] * 2.0**64)).cast("long") for i in positions])
        self.sampled = self._written(self.hashed.filter(F.col("h") <= F.get(bounds, F.col("pos"))).distinct())
        self.sizes = dict.fromkeys(positions, 0) | {r["pos"]: r["n"] for r in self.sampled.groupBy("pos").agg(F.count("*").alias("n")).collect()}

    def _written(self, df: DataFrame) -> DataFrame:
        spark, path = df.sparkSession, fresh_path(df.sparkSession, "llaves")
        df.write.parquet(path)
        return spark.read.schema("pos int, h long").parquet(path)

    def _cells(self) -> DataFrame:
        """(pos, k): the key of every cell that has one. Cells become rows first, so the key is one expression, which the filter does not repeat."""
        texts = F.array(*[F.struct(F.lit(i).alias("pos"), as_text(self.df, c).alias("t")) for i, c in enumerate(self.columns)])
        long = self.df.select(F.explode(texts).alias("x")).select("x.*").filter("t is not null")
        return long.select("pos", F.explode(F.array(flexible_key(F.col("t")))).alias("k")).filter("k is not null")


def _hits(sampled: Side, other: Side) -> dict[tuple[int, int], int]:
    """How many sampled keys of each column of one side occur in each column of the other (one row per pair of columns)."""
    side = sampled.sampled.withColumnRenamed("pos", "s")
    side = F.broadcast(side) if sum(sampled.sizes.values()) <= BROADCAST_KEYS else side
    met = other.hashed.join(side, "h").select("s", "pos", "h").distinct()
    return {(r["s"], r["pos"]): r["n"] for r in met.groupBy("s", "pos").agg(F.count("*").alias("n")).collect()}


def _exact(a: Side, b: Side, pairs: list[tuple[int, int]]) -> tuple[dict, dict, dict]:
    """Keys of each named column and keys that each pair shares, over all rows. Cells become distinct (column, key) pairs, grouped by key
    into the set of columns holding it, so a frequent key is one row and no pair of rows is formed."""
    def by_key(side: Side, wanted: set[int], name: str) -> tuple[DataFrame, dict]:
        sets = side.hashed.filter(F.col("pos").isin(*wanted)).distinct().groupBy("h").agg(F.collect_set("pos").alias(name))  # at most one per column
        sizes = {r["pos"]: r["n"] for r in sets.select(F.explode(name).alias("pos")).groupBy("pos").agg(F.count("*").alias("n")).collect()}
        return sets, sizes

    sets_a, sizes_a = by_key(a, {i for i, _ in pairs}, "a")
    sets_b, sizes_b = by_key(b, {j for _, j in pairs}, "b")
    both = sets_a.join(sets_b, "h").select(F.explode("a").alias("a"), "b").select("a", F.explode("b").alias("b"))
    return sizes_a, sizes_b, {(r["a"], r["b"]): r["n"] for r in both.groupBy("a", "b").agg(F.count("*").alias("n")).collect()}


def shared_keys(a: DataFrame, b: DataFrame, sample: int = SAMPLE) -> list[tuple[str, str, bool, float, int, int]]:
    """(column of A, column of B, same name, share, position in A, position in B) of every pair of columns that shares at least WANTED
    percent of the keys of the smaller column, or a name and any key. Columns with fewer than two keys are left out; null and blank
    cells are no keys. Shares count all keys, told apart by 64-bit hashes."""
    if not all(any(is_flat(f.dataType) for f in df.schema.fields) for df in (a, b)):
        return []
    left, right = Side(a, sample), Side(b, sample)
    of_a, of_b = _hits(left, right), {(i, j): n for (j, i), n in _hits(right, left).items()}
    found, open_pairs = [], []
    for i, ca in enumerate(left.columns):
        for j, cb in enumerate(right.columns):
            same = names.normalize_name(ca) == names.normalize_name(cb)
            small = [s.sizes[k] for s, k in ((left, i), (right, j)) if s.whole[k]]
            if min(small, default=2) < 2:
                continue
            # a column known whole is surely the smaller one beside another whole one, or far below the (estimated) size of a sampled one
            if len(small) == 2 or min(small, default=sample) <= sample // 2:
                hits = of_a.get((i, j), 0) if left.whole[i] and left.sizes[i] == min(small) else of_b.get((i, j), 0)
                if hits:
                    found.append((ca, cb, same, hits / min(small) * 100, i, j))
            elif same or max(of_a.get((i, j), 0) / max(left.sizes[i], 1), of_b.get((i, j), 0) / max(right.sizes[j], 1)) * 100 >= WANTED - SLACK:
                open_pairs.append((i, j, same))
    if open_pairs:
        sizes_a, sizes_b, common = _exact(left, right, [(i, j) for i, j, _ in open_pairs])
        found += [(left.columns[i], right.columns[j], same, common[i, j] / min(sizes_a[i], sizes_b[j]) * 100, i, j)
                  for i, j, same in open_pairs if (i, j) in common]
    return [pair for pair in found if pair[3] >= WANTED or pair[2]]


def suggest_keys(a: DataFrame, b: DataFrame, most: int = 8) -> DataFrame:
    """JN-1: column pairs whose flexible keys overlap, best first (at most `most` rows)."""
    pairs = a.sparkSession.createDataFrame(shared_keys(a, b), _SCHEMA.replace("coincidencia_pct", "share") + ", pos_a int, pos_b int")
    return (pairs.withColumn("coincidencia_pct", F.round("share", 1)).orderBy(F.desc("coincidencia_pct"), F.desc("mismo_nombre"), "pos_a", "pos_b")
            .limit(most).select("columna_a", "columna_b", "mismo_nombre", "coincidencia_pct"))
