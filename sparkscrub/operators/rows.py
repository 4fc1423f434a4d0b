"""Row identity, repeated rows and joins against lookups whose size is checked."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROW_ID = "_row_id"
LITERAL_LIMIT = 200
BROADCAST_LIMIT = 200_000


def q(name: str) -> Column:
    return F.col(f"`{name}`")


def with_row_id(df: DataFrame, name: str = ROW_ID) -> DataFrame:
    """0-based row numbers in reading order. `df` must be a plain scan, whose partitions are the same on every read.

    Rows are counted per partition and the offsets (one row per partition) join the rows; nothing is collected."""
    raw = df.withColumn("__mid", F.monotonically_increasing_id()).withColumn("__p", F.shiftright("__mid", 33))
    counts = raw.groupBy("__p").agg(F.count(F.lit(1)).alias("__n"))
    offsets = counts.select("__p", (F.sum("__n").over(Window.orderBy("__p")) - F.col("__n")).alias("__offset"))  # one row per partition
    position = F.col("__mid").bitwiseAND(F.lit((1 << 33) - 1))
    joined = raw.join(offsets, "__p")
    return joined.withColumn(name, F.col("__offset") + position).drop("__mid", "__p", "__offset")


def require_unique(df: DataFrame, row_id: str) -> None:
    """An error when a row id is missing or stands on two rows (counts combined per task; stops at the first)."""
    wrong = df.groupBy(q(row_id)).agg(F.count(F.lit(1)).alias("n")).filter((F.col("n") > 1) | q(row_id).isNull())
    if not wrong.isEmpty():
        raise ValueError(f"la columna {row_id} debe ser única y no tener nulos")


def repeated_rows(df: DataFrame, keys: list[str], row_id: str) -> DataFrame:
    """Row ids of every row whose key appeared in an earlier row (NULL equals NULL).

    The first id per key is a map-side combined minimum, so a key that fills a third of the table costs one row per
    partition; the rest follows from an anti join on the unique row id, which cannot be skewed."""
    firsts = df.groupBy(*[q(k) for k in keys]).agg(F.min(q(row_id)).alias(row_id))
    return df.select(q(row_id)).join(firsts.select(row_id), row_id, "left_anti")


def repeated_cells(df: DataFrame, columns: list[str], row_id: str) -> DataFrame:
    """(row id, columna) of every cell that repeats an earlier non-blank value of its column."""
    from ..functions.text import is_blank

    cells = F.array(*[F.struct(F.lit(c).alias("columna"), F.when(~is_blank(q(c)), q(c).cast("string")).alias("v"))
                      for c in columns])
    long = df.select(q(row_id), F.explode(cells).alias("x")).select(q(row_id), "x.columna", "x.v").filter("v is not null")
    firsts = long.groupBy("columna", "v").agg(F.min(q(row_id)).alias(row_id)).select("columna", row_id)
    return long.select("columna", row_id).join(firsts, ["columna", row_id], "left_anti")


def flag_rows(df: DataFrame, ids: DataFrame, row_id: str, flag: str) -> DataFrame:
    """A true/false column for the rows listed in `ids` (unique ids, so the join is even)."""
    marked = ids.select(q(row_id)).withColumn(flag, F.lit(True))
    return df.join(marked, row_id, "left").withColumn(flag, F.coalesce(q(flag), F.lit(False)))


def literal_map(pairs: dict[str, str], key: Column) -> Column:
    entries = F.create_map(*[F.lit(x) for x in chain.from_iterable(pairs.items())])
    return F.element_at(entries, key)


def attach_lookup(df: DataFrame, column: str, lookup: DataFrame, out: str) -> DataFrame:
    """Add `out` = lookup value of `column`. `lookup` has (texto, destino) with unique, frequent-value-free texts.

    A few entries become a literal map; up to a checked bound the table is broadcast; beyond it a shuffle join is
    used, which adaptive execution splits when a value is hot."""
    sample = lookup.limit(LITERAL_LIMIT + 1).collect()
    if len(sample) <= LITERAL_LIMIT:
        pairs = {r["texto"]: r["destino"] for r in sample}
        value = literal_map(pairs, q(column)) if pairs else F.lit(None).cast("string")
        return df.withColumn(out, value)
    small = lookup.limit(BROADCAST_LIMIT + 1).count() <= BROADCAST_LIMIT
    side = lookup.select(F.col("texto").alias("__t"), F.col("destino").alias(out))
    return df.join(F.broadcast(side) if small else side, q(column) == F.col("__t"), "left").drop("__t")
