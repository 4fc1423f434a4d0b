"""SQL sources and sinks: JDBC databases and the session's own catalog, plus the dispatch over all sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .delimited import TEXT_EXTENSIONS, coordinates_to_numbers, read_delimited
from .shape import name_tables

CATALOG = "catalog:"
MODES = {"replace": "overwrite", "append": "append", "fail": "errorifexists"}


def jdbc_options(url: str, query: str | None = None, table: str | None = None, partition: dict | None = None,
                 fetch_size: int = 10_000) -> dict[str, str]:
    """Reader options. `partition` = {column, lower, upper, parts} splits the read among executors."""
    if not query and not table:
        raise ValueError("indique 'query' o 'table' para cargar datos SQL")
    options = {"url": url, "fetchsize": str(fetch_size)}
    if partition:
        options |= {"partitionColumn": partition["column"], "lowerBound": str(partition["lower"]),
                    "upperBound": str(partition["upper"]), "numPartitions": str(partition["parts"]),
                    "dbtable": f"({query}) q" if query else table}
    else:
        options |= {"query": query} if query else {"dbtable": table}
    return options


def read_sql(spark: SparkSession, url: str, query: str | None = None, table: str | None = None, partition: dict | None = None,
             **properties) -> DataFrame:
    """SRC-11: a table or query from a JDBC database, or from the session's catalog (`catalog:`)."""
    if url.startswith(CATALOG):
        if not query and not table:
            raise ValueError("indique 'query' o 'table' para cargar datos SQL")
        return spark.sql(query) if query else spark.table(table)
    return spark.read.format("jdbc").options(**jdbc_options(url, query, table, partition), **properties).load()


def write_sql(df: DataFrame, url: str, table: str, if_exists: str = "replace", location: str | None = None, **properties) -> str:
    """SRC-14: replace, append or fail. In the catalog the table may live at a given shared location."""
    mode = MODES[if_exists]
    if url.startswith(CATALOG):
        writer = df.write.mode(mode).format("parquet")
        (writer.option("path", f"{location}/{table}") if location else writer).saveAsTable(table)
    else:
        df.write.mode(mode).format("jdbc").options(url=url, dbtable=table, batchsize="10000", **properties).save()
    return table


def read_table(spark: SparkSession, source: str, kind: str = "auto", **options) -> DataFrame:
    """SRC-12: one entry point; a known extension wins over `kind`."""
    lower = source.lower().rstrip("/")
    if lower.endswith(TEXT_EXTENSIONS):
        kind = "csv"
    elif lower.endswith((".parquet", ".orc", ".json")):
        kind = lower.rsplit(".", 1)[1]
    elif kind == "auto" and (lower.startswith("jdbc:") or source.startswith(CATALOG)):
        kind = "sql"
    if kind == "csv":
        return coordinates_to_numbers(read_delimited(spark, source, **options))
    if kind == "sql":
        return read_sql(spark, source, **options)
    if kind in ("parquet", "orc", "json"):
        return coordinates_to_numbers(spark.read.format(kind).options(**options).load(source))
    raise ValueError(f"no se pudo detectar el tipo de fuente de '{source}'; indique kind='csv', 'parquet', 'orc', 'json' o 'sql'")


def shortest_names(folders: set[str]) -> dict[str, str]:
    """The fewest last parts of each folder's path that tell it from the others."""
    out = {}
    for folder in folders:
        parts = folder.split("/")
        for n in range(1, len(parts) + 1):
            tail = "/".join(parts[-n:])
            if n == len(parts) or sum(f == tail or f.endswith("/" + tail) for f in folders) == 1:
                break
        out[folder] = tail
    return out


def read_tables(spark: SparkSession, sources: list[str], wanted: list[str] | None = None, **options) -> dict[str, DataFrame]:
    """SRC-10 over files: each file is a table named after it."""
    def stem(path: str) -> str:
        return path.rstrip("/").rsplit("/", 1)[-1].rsplit(".", 1)[0]

    paths = list(dict.fromkeys(p.rstrip("/") for p in sources))
    folders = {p: (p.rsplit("/", 1)[0] if "/" in p else "datos") for p in paths}
    short = shortest_names(set(folders.values()))
    tables: dict[str, dict[str, DataFrame]] = {}
    for p in paths:
        tables.setdefault(short[folders[p]], {})
        name = stem(p) if stem(p) not in tables[short[folders[p]]] else p.rsplit("/", 1)[-1]
        tables[short[folders[p]]][name] = read_table(spark, p, **options)
    return name_tables(tables, wanted)
