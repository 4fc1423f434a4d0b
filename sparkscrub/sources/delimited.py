"""Delimited text: sniffing, typed reading, ragged rows, and writing."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names, numbers
from ..functions import text as X
from ..operators.rows import q
from ..plans.profile import Profile
from . import quoted

# Spark reads Latin-1 but not its Windows variant: the 32 positions that differ are translated after reading.
_C1 = [b for b in range(0x80, 0xA0) if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D)]
_C1_LATIN, _C1_WINDOWS = "".join(map(chr, _C1)), bytes(_C1).decode("cp1252")
TEXT_EXTENSIONS = (".csv", ".txt", ".tsv", ".tab")
SEPARATORS = (",", ";", "\t", "|")
HEAD_BYTES = 1 << 16  # for the header and separator of a file; data are never judged by it


def sniff_encodings(spark: SparkSession, path: str) -> dict[str, list[str]]:
    """{encoding: files}, decided per file from all of its bytes.

    A byte-order mark of UTF-16 in the first file speaks for all files. Otherwise the lines are read as raw bytes, in splits, and a file is
    UTF-8 when all its lines are, else Windows-1252, or Latin-1 when it has bytes that the former leaves undefined."""
    if _head_bytes(spark, path, 2) in (b"\xff\xfe", b"\xfe\xff"):
        return {"UTF-16": [path]}
    line = F.col("value")
    undefined = ~F.is_valid_utf8(line) & F.hex(line.cast("binary")).rlike("^(..)*(81|8D|8F|90|9D)")
    files = spark.read.text(path).groupBy(F.input_file_name().alias("file")).agg(F.bool_and(F.is_valid_utf8(line)).alias("utf8"), F.bool_or(undefined).alias("odd"))
    kinds = files.groupBy(F.when(F.col("utf8"), "UTF-8").when(F.col("odd"), "ISO-8859-1").otherwise("windows-1252").alias("kind"))
    found = kinds.agg(F.count("*").alias("n")).collect()
    if len(found) <= 1:
        return {found[0]["kind"] if found else "UTF-8": [path]}
    return {r["kind"]: sorted(r["files"]) for r in kinds.agg(F.collect_list("file").alias("files")).collect()}


def has_line_breaks(spark: SparkSession, path: str) -> bool:
    """Whether some line holds an odd number of quotes, so that a quoted cell may go on in the next line."""
    value = F.col("value")
    odd = (F.length(value) - F.length(F.replace(value, F.lit('"'), F.lit("")))) % 2 == 1
    return bool(spark.read.text(path).agg(F.bool_or(odd)).first()[0])


def _head_bytes(spark: SparkSession, path: str, size: int) -> bytes:
    jvm = spark.sparkContext._jvm
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(hadoop)
    statuses = fs.globStatus(root)
    if not statuses:
        raise FileNotFoundError(path)
    first = statuses[0]
    if first.isDirectory():
        inside = sorted((s.getPath() for s in fs.listStatus(first.getPath())
                         if s.isFile() and not s.getPath().getName().startswith(("_", "."))), key=lambda p: p.getName())
        if not inside:
            raise ValueError("la carpeta no tiene archivos de datos")
        first_path = inside[0]
    else:
        first_path = first.getPath()
    stream = fs.open(first_path)
    try:
        want = min(size, int(fs.getFileStatus(first_path).getLen()))
        return bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream, want)) if want else b""
    finally:
        stream.close()


def sniff_separator(head: list[str]) -> tuple[str, bool]:
    """(separator, whether a leading 'sep=;' line names it)."""
    if head and re.fullmatch(r"(?i)sep=.", head[0].strip("﻿").strip()):
        return head[0].strip("﻿").strip()[4], True
    first = next((line for line in head if line.strip()), "")
    best = max(SEPARATORS, key=first.count)
    return (best if first.count(best) else ","), False


def read_text_table(spark: SparkSession, path: str, sep: str | None = None, encoding: str | None = None) -> DataFrame:
    """SRC-1 / SRC-3: every column as text. Surplus cells become columna_extra_N, short rows are padded with NULL.

    The first record of every file is its header, whatever later rows hold. Files are read in splits, also when quoted cells hold line
    breaks (only UTF-16 is then read whole). Files of different encodings are read apart and put together."""
    encodings = {encoding: [path]} if encoding else sniff_encodings(spark, path)
    kind = next(iter(encodings))
    head = _head_bytes(spark, path, HEAD_BYTES).decode("ISO-8859-1" if kind != "UTF-16" and kind != "UTF-8" else kind, "ignore").lstrip("\ufeff").splitlines()
    if not any(line.strip() for line in head):
        raise ValueError("el archivo está vacío: no tiene encabezados ni datos")
    found, named = sniff_separator(head)
    sep = sep or found
    header_line = next(line for line in head[1 if named else 0:] if line.strip())
    if kind == "windows-1252":
        header_line = header_line.translate(str.maketrans(_C1_LATIN, _C1_WINDOWS))
    first_cells = _split_line(spark, header_line, sep)
    header = names.repair_header(first_cells)
    several = "UTF-16" in encodings or has_line_breaks(spark, path)
    wide = max(len(header), _width(spark, path, sep, "ISO-8859-1" if kind != "UTF-16" else kind))
    columns = header + [f"columna_extra_{i}" for i in range(len(header) + 1, wide + 1)]
    schema = ", ".join(f"`c{i}` string" for i in range(len(columns)))
    parts = []
    for name, files in encodings.items():
        options = {"sep": sep, "encoding": "ISO-8859-1" if name == "windows-1252" else name, "multiLine": str(several).lower(), "escape": '"', "mode": "PERMISSIVE",
                   "enforceSchema": "true", "header": "true"}
        if several and name != "UTF-16":
            raw = quoted.read(spark, files, sep, options["encoding"], len(columns), {"escape": '"', "mode": "PERMISSIVE"})
        else:
            raw = spark.read.options(**options).schema(schema).csv(files)
        if name == "windows-1252":
            raw = raw.select(*[F.translate(q(c), _C1_LATIN, _C1_WINDOWS).alias(c) for c in raw.columns])
        parts.append(raw)
    raw = reduce(DataFrame.unionByName, parts)
    if named:  # the sep= line was taken for the header: the header itself is the row equal to it
        same = [q(f"c{i}").eqNullSafe(F.lit(cell if cell != "" else None)) for i, cell in enumerate(first_cells)]
        raw = raw.filter(~reduce(lambda x, y: x & y, same))
    if several and wide > len(header):  # separators inside quoted line breaks were counted as cells
        extra = [f"c{i}" for i in range(len(header), wide)]
        used = raw.agg(*[F.count(c).alias(c) for c in extra]).first()
        kept = max((i + 1 for i, c in enumerate(extra) if used[c]), default=0)
        columns = columns[:len(header) + kept]
        raw = raw.select(*raw.columns[:len(columns)])
    return raw.toDF(*columns)


def _split_line(spark: SparkSession, line: str, sep: str) -> list[str]:
    import csv

    return next(csv.reader([line], delimiter=sep))


def _width(spark: SparkSession, path: str, sep: str, encoding: str) -> int:
    """Most cells in any line (separators inside quotes do not count)."""
    lines = spark.read.option("encoding", encoding).csv(path, sep="\u0001", schema="l string", quote="")
    bare = F.regexp_replace("l", '"[^"]*"', "")
    row = lines.agg(F.max(F.length(bare) - F.length(F.replace(bare, F.lit(sep), F.lit(""))))).first()
    return (row[0] or 0) + 1


def code_columns(df: DataFrame) -> list[str]:
    """SRC-2: text columns of digits only where some value starts with a zero: they stay text."""
    aggs = []
    for i, c in enumerate(df.columns):
        v = X.strip(q(c))
        aggs += [F.coalesce(F.bool_and(F.when(v != "", v.rlike(r"^\d+$"))), F.lit(False)).alias(f"d{i}"),
                 F.coalesce(F.bool_or(v.rlike(r"^0\d+$")), F.lit(False)).alias(f"z{i}")]
    row = df.agg(*aggs).first()
    return [c for i, c in enumerate(df.columns) if row[f"d{i}"] and row[f"z{i}"]]


def infer_types(df: DataFrame) -> DataFrame:
    """Cast text columns whose every value is a whole number or a number; codes with leading zeros stay text."""
    codes = set(code_columns(df))
    aggs = []
    for i, c in enumerate(df.columns):
        v = X.strip(q(c))
        known = F.when(v != "", v)
        aggs += [F.bool_and(known.rlike(r"^[+-]?\d{1,18}$")).alias(f"i{i}"), F.bool_and(known.rlike(
            r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$")).alias(f"n{i}")]
    row = df.agg(*aggs).first()
    new = {}
    for i, c in enumerate(df.columns):
        v = X.strip(q(c))
        if c in codes:
            continue
        if row[f"i{i}"]:
            new[c] = v.try_cast("bigint")
        elif row[f"n{i}"]:
            new[c] = v.try_cast("double")
        else:
            new[c] = F.when(q(c) != "", q(c))
    return df.withColumns(new)


def read_delimited(spark: SparkSession, path: str, sep: str | None = None, encoding: str | None = None,
                   typed: bool = True) -> DataFrame:
    df = read_text_table(spark, path, sep, encoding)
    return infer_types(df) if typed else df


def coordinates_to_numbers(df: DataFrame) -> DataFrame:
    """Coordinate columns with a decimal comma become numbers when every value can be read."""
    profile = Profile(df, [c for c in df.columns if names.is_coordinate(c)])
    mine = [c for c in profile.columns if profile.is_text(c)]
    if not mine:
        return df
    row = df.agg(*[F.bool_and(F.when(~X.is_blank(q(c)), numbers.coordinate(q(c)).isNotNull())).alias(c) for c in mine]).first()
    return df.withColumns({c: numbers.coordinate(q(c)) for c in mine if row[c]})


def all_text(df: DataFrame) -> DataFrame:
    """SRC-4: every column as text, nulls as '', 10115.0 as '10115', midnight-only timestamps as dates."""
    from ..functions.numbers import is_date_type

    stamps = [f.name for f in df.schema.fields if is_date_type(f.dataType)]
    whole = df.agg(*[F.coalesce(F.bool_and(F.date_trunc("day", q(c)) == q(c)), F.lit(True)).alias(c) for c in stamps]).first() if stamps else {}
    out = []
    for f in df.schema.fields:
        c = q(f.name)
        if f.name in stamps:
            c = F.date_format(c, "yyyy-MM-dd" if whole[f.name] else "yyyy-MM-dd HH:mm:ss")
        elif f.dataType.typeName() in ("double", "float"):
            c = numbers.number_text(numbers.finite(c))
        out.append(F.coalesce(c.cast("string"), F.lit("")).alias(f.name))
    return df.select(*out)


def write_delimited(df: DataFrame, path: str, if_exists: str = "replace", bom: bool = False, sep: str = ",") -> str:
    """SRC-13: a folder of CSV parts with header; `bom` marks the first header for spreadsheet programs."""
    mode = {"replace": "overwrite", "append": "append", "fail": "errorifexists"}[if_exists]
    if bom:
        df = df.withColumnRenamed(df.columns[0], "﻿" + df.columns[0])
    df.write.mode(mode).options(header=True, escape='"', sep=sep, ignoreLeadingWhiteSpace=False,
                                ignoreTrailingWhiteSpace=False).csv(path)
    return path


def write_report(tables: dict[str, DataFrame], base: str) -> list[str]:
    """SRC-15: summary and detail side by side."""
    return [write_delimited(df, f"{base}_{name}") for name, df in tables.items()]


