"""Turning a raw, headerless table into a proper one: title rows, header repair, footnotes, stacking."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import names
from ..operators.rows import ROW_ID, q

HEADER_SEARCH = 20


def find_header(raw: DataFrame, row_id: str = ROW_ID) -> tuple[int | None, list[str | None]]:
    """SRC-5: (row id, cells) of the first of the first 20 rows that is at least half filled with distinct texts."""
    columns = [c for c in raw.columns if c != row_id]
    head = raw.orderBy(row_id).limit(HEADER_SEARCH).collect()
    for row in head:
        filled = [str(row[c]).strip() for c in columns if row[c] is not None]
        if len(filled) >= max(2, len(columns) * 0.5) and len(set(filled)) == len(filled):
            return row[row_id], [row[c] for c in columns]
    return (head[0][row_id], [head[0][c] for c in columns]) if head else (None, [])


def trim_notes(df: DataFrame, row_id: str = ROW_ID) -> DataFrame:
    """SRC-6: drop the nearly empty rows at the end; sparse rows in the middle stay."""
    columns = [c for c in df.columns if c != row_id]
    filled = reduce(lambda a, b: a + b, [q(c).isNotNull().cast("int") for c in columns])
    sizes = df.groupBy(filled.alias("k")).agg(F.count(F.lit(1)).alias("n"), F.max(row_id).alias("last")).orderBy("k").collect()
    total = sum(r["n"] for r in sizes)  # one row per number of filled cells
    if not total:
        return df
    expanded, middle = 0, []
    for r in sizes:
        for wanted in ((total - 1) // 2, total // 2):
            if expanded <= wanted < expanded + r["n"]:
                middle.append(r["k"])
        expanded += r["n"]
    median = sum(middle) / len(middle)
    if not median:
        return df
    limit = max(1, median * 0.3)
    last = max((r["last"] for r in sizes if r["k"] > limit), default=None)
    return df.limit(0) if last is None else df.filter(q(row_id) <= last)


def drop_empty_unnamed(df: DataFrame) -> DataFrame:
    """SRC-7: unnamed columns without a single value go away."""
    unnamed = [c for c in df.columns if c.startswith("Columna_sin_nombre_")]
    if not unnamed:
        return df
    row = df.agg(*[F.count(q(c)).alias(c) for c in unnamed]).first()
    return df.drop(*[c for c in unnamed if not row[c]])


def shape_sheet(raw: DataFrame, row_id: str = ROW_ID) -> DataFrame:
    """SRC-5 to SRC-7 in order: header found and repaired, data below it, empty columns and footnotes removed."""
    header_id, header = find_header(raw, row_id)
    if header_id is None:
        return raw
    columns = [c for c in raw.columns if c != row_id]
    body = raw.filter(q(row_id) > header_id).select(q(row_id), *[q(c) for c in columns]).toDF(row_id, *names.repair_header(
        None if h is None else str(h) for h in header))
    return trim_notes(drop_empty_unnamed(body), row_id)


def unique_columns(df: DataFrame) -> DataFrame:
    """SRC-8: a, a.1, a.2."""
    return df.toDF(*names.deduplicate_names(df.columns))


def stack(tables: dict[str, DataFrame], source: str = "_hoja") -> DataFrame:
    """SRC-9: union by name, missing columns NULL, first column saying where a row came from (not for one table)."""
    if len(tables) == 1:
        return next(iter(tables.values()))
    parts = [df.select(F.lit(name).alias(source), *[q(c) for c in df.columns]) for name, df in tables.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def name_tables(files: dict[str, dict[str, DataFrame]], wanted: list[str] | None = None) -> dict[str, DataFrame]:
    """SRC-10: {file: {table: df}} flattened; a table name used by two files becomes file__table."""
    seen = [t for inner in files.values() for t in inner]
    out: dict[str, DataFrame] = {}
    for file, inner in files.items():
        for t, df in inner.items():
            name = f"{file}__{t}" if seen.count(t) > 1 else t
            while name in out or (name != t and name in seen):
                name += "_"
            out[name] = df
    if wanted is not None:
        missing = [t for t in wanted if t not in out]
        if missing:
            raise ValueError(f"no se encontraron las tablas: {', '.join(missing)}; hay: {', '.join(out)}")
        out = {t: out[t] for t in wanted}
    return out
