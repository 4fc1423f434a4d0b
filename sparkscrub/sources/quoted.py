"""Records of delimited text whose quoted cells hold line breaks, read in splits.

A line can be judged only if one knows whether it starts inside a quoted cell, and a split does not know that of its first line. So a first
scan runs every split from both states and keeps what each leads to: a map of two states (the same, the other one, or always one of them).
Composing the maps of the splits before it gives the state a split starts in; that is a window over one row per split. A second scan cuts
the lines into records. What a record leaves in other splits (the tail of one, whole middles, the head of the last) is put together by
file and place; there are at most two such pieces per split. All else stays where it was read: as many tasks as splits.

A quote opens a cell only at the cell's start; doubled quotes stand for one; what follows a closing quote up to the separator is plain text.
Line breaks are \\n or \\r\\n, and stay as they are inside quotes. Blank lines outside quotes are no records."""

from __future__ import annotations

import re
from collections.abc import Iterator
from urllib.parse import unquote

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

QUOTE = b'"'
_CLOSING = re.compile(rb'[^"]*+(?:""[^"]*+)*+"')


def inside_after(line: bytes, inside: bool, sep: bytes) -> bool:
    """Whether a quoted cell is open at the end of `line`, given whether one was open at its start."""
    at, opening = 0, sep + QUOTE
    if not inside and not line.startswith(QUOTE):
        at = line.find(opening)
        if at < 0:
            return False
        at += len(sep)
    at += not inside  # behind the opening quote
    while True:
        closed = _CLOSING.match(line, at)
        if closed is None:
            return True
        at = line.find(opening, closed.end())
        if at < 0:
            return False
        at += len(opening)


def _lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(file, start of the split, line); lines of a split follow each other in one task."""
    text = spark.read.option("lineSep", "\n").text(paths)
    return text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.col("value").cast("binary").alias("line"))


def _splits(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], pa.Array]]:
    """Runs of lines of one split."""
    for batch in batches:
        starts, files = batch["start"].to_pylist(), batch["file"].to_pylist()
        at = 0
        for k in range(1, batch.num_rows + 1):
            if k == batch.num_rows or starts[k] != starts[at] or files[k] != files[at]:
                yield (files[at], starts[at]), batch["line"].slice(at, k - at)
                at = k


def _with_quotes(lines: pa.Array) -> list[int]:
    return pc.indices_nonzero(pc.match_substring(lines, QUOTE)).to_pylist()


def _maps(sep: bytes):
    """One row per split: the state its end is in when it starts outside and when it starts inside a quoted cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends: dict[tuple[str, int], list[bool]] = {}
        for split, lines in _splits(batches):
            state = ends.setdefault(split, [False, True])
            for i in _with_quotes(lines):
                line = lines[i].as_py()
                state[0] = inside_after(line, state[0], sep)
                state[1] = inside_after(line, state[1], sep)
        if ends:
            yield pa.RecordBatch.from_arrays([pa.array([f for f, _ in ends]), pa.array([s for _, s in ends], pa.int64()), pa.array([e[0] for e in ends.values()]),
                                              pa.array([e[1] for e in ends.values()])], names=["file", "start", "from_plain", "from_quoted"])

    return run


def open_splits(lines: DataFrame, sep: bytes) -> DataFrame:
    """(file, start, inside) of the splits that start (`inside`) or end inside a quoted cell."""
    maps = lines.mapInArrow(_maps(sep), "file string, start long, from_plain boolean, from_quoted boolean")
    order = Window.partitionBy("file").orderBy("start")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    # a split either fixes the state or keeps or turns it: the last fixed state, turned as often as splits since then do
    turns = F.sum((F.col("from_plain") & ~F.col("from_quoted")).cast("int"))
    fixed = F.when(F.col("from_plain") == F.col("from_quoted"), (F.col("from_plain").cast("int") + F.col("turned")) % 2)
    maps = maps.withColumn("turned", turns.over(upto)).withColumn("fixed", fixed)
    since = F.coalesce(F.last("fixed", ignorenulls=True).over(before), F.lit(0))
    turned = F.coalesce(F.lag("turned").over(order), F.lit(0))
    maps = maps.withColumn("inside", (since + turned) % 2 == 1)
    return maps.filter("inside or if(inside, from_quoted, from_plain)").select("file", "start", "inside")


def _records(sep: bytes, inside: set[tuple[str, int]]):
    """(kind, file, start, first, text): whole records, and the tail, middle and head of those that lie in several splits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, open_, parts, begun, first = None, False, [], False, False

        def rows(kind: str, texts, first: bool = False) -> pa.RecordBatch:
            texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.binary())
            n = len(texts)
            return pa.RecordBatch.from_arrays([pa.array([kind] * n, pa.string()), pa.array([split[0]] * n), pa.array([split[1]] * n, pa.int64()), pa.array([first] * n), texts],
                                              names=["kind", "file", "start", "first", "text"])

        def plain(texts: pa.Array) -> Iterator[pa.RecordBatch]:
            """Lines that are records each; the first record of a file is its header."""
            nonlocal first
            texts = texts.filter(pc.not_equal(pc.binary_length(texts), 0))
            texts = texts.filter(pc.not_equal(texts, pa.scalar(b"\r", pa.binary())))
            if first and len(texts):
                first, texts = False, texts.slice(1)
            if len(texts):
                yield rows("record", texts)

        def left_open() -> Iterator[pa.RecordBatch]:
            if open_ and split is not None:
                yield rows("tail" if begun else "middle", [b"\n".join(parts)], begun and first)

        for this, lines in _splits(batches):
            if this != split:
                yield from left_open()
                split, open_, parts, begun, first = this, this in inside, [], False, this[1] == 0
            at = 0
            for i in [*_with_quotes(lines), len(lines)]:
                between = lines.slice(at, i - at)
                if open_:
                    parts += between.to_pylist()
                else:
                    yield from plain(between)
                if i < len(lines):
                    line = lines[i].as_py()
                    was_open, open_ = open_, inside_after(line, open_, sep)
                    if was_open:
                        parts.append(line)
                    elif open_:
                        parts, begun = [line], True
                    else:
                        yield from plain(lines.slice(i, 1))
                    if was_open and not open_:
                        if not begun:
                            yield rows("head", [b"\n".join(parts)])
                        elif first:
                            first = False  # a header of several lines
                        else:
                            yield rows("record", [b"\n".join(parts)])
                        parts, begun = [], False
                at = i + 1
        yield from left_open()

    return run


def records(spark: SparkSession, paths: list[str], sep: str, encoding: str = "UTF-8") -> DataFrame:
    """(record): every record of the files but each file's first, as text. `encoding` is one of one byte per ASCII character."""
    lines, mark = _lines(spark, paths), sep.encode("latin-1" if encoding != "UTF-8" else "utf-8")
    unsettled = open_splits(lines, mark).collect()  # some of the splits, which the driver plans one by one anyway
    inside = {(r["file"], r["start"]) for r in unsettled if r["inside"]}
    schema = "kind string, file string, start long, first boolean, text binary"
    found = lines.mapInArrow(_records(mark, inside), schema).filter("kind = 'record'").select("text")
    as_text = F.decode("text", encoding) if encoding != "UTF-8" else F.col("text").cast("string")
    record = F.regexp_replace(as_text, "\\r$", "").alias("record")
    if not unsettled:
        return found.select(record)
    touched = [unquote(f) for f in sorted({r["file"] for r in unsettled})]
    unclosed = _lines(spark, touched).mapInArrow(_records(mark, inside), schema).filter("kind <> 'record'")
    order = Window.partitionBy("file").orderBy("start", F.col("kind") == "tail")
    pieces = unclosed.withColumn("place", F.row_number().over(order)).withColumn("number", F.sum((F.col("kind") == "tail").cast("int")).over(order))
    whole = pieces.groupBy("file", "number").agg(F.array_sort(F.collect_list(F.struct("place", "text"))).alias("parts"), F.bool_or("first").alias("first"))
    joined = whole.filter("not first").select(F.expr(
        "aggregate(slice(parts, 2, greatest(size(parts) - 1, 0)), parts[0].text, (a, p) -> concat(a, cast('\\n' as binary), p.text))").alias("text"))
    return found.union(joined).select(record)


def read(spark: SparkSession, paths: list[str], sep: str, encoding: str, columns: int, options: dict[str, str]) -> DataFrame:
    """The records as `columns` text columns c0, c1, ..."""
    schema = ", ".join(f"`c{i}` string" for i in range(columns))
    parsed = records(spark, paths, sep, encoding).select(F.from_csv("record", schema, {**options, "sep": sep, "multiLine": "true"}).alias("r"))
    return parsed.select("r.*")
