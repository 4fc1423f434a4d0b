"""Benchmark decontamination by pigeonhole pieces and Myers' bit-parallel distance.

A test item of m characters may appear with k = floor(rate * m) edits. Cut into k + 1 pieces, one piece must appear unchanged.
An Aho-Corasick automaton finds the pieces in one pass over each whole document; around every hit the item is searched with
Myers' algorithm. Both sides are lower-cased and runs of white space become one space.

Items with a null or empty text match nothing, as do null and empty documents. An item without an id is searched like any other and
reported with a null id; `clean` reads no ids. Items shorter than 1 / rate characters must appear unchanged.
Rows that repeat an id are answered one by one. The documents are only scanned, never shuffled; the items are broadcast in blocks
of at most `BLOCK_CHARS` characters (or a single longer item), one scan for each block."""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tidy

#: Edits allowed per character of an item.
RATE = 0.05
BLOCK_CHARS = 2_000_000


def normal(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def pieces(length: int, errors: int) -> list[tuple[int, int]]:
    """errors + 1 stretches that cover an item, as even as can be."""
    cuts = [length * i // (errors + 1) for i in range(errors + 2)]
    return list(zip(cuts[:-1], cuts[1:]))


def edit_search(pattern: str, masks: dict[str, int], text: str, errors: int) -> tuple[int, int] | None:
    """(fewest edits, end) of the best appearance of `pattern` in `text` with at most `errors` edits; the earliest end of these.

    Myers' recurrence on column differences, one machine word as wide as the pattern."""
    m = len(pattern)
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, distance = full, 0, m
    best = None
    for end, character in enumerate(text, 1):
        eq = masks.get(character, 0)
        x = eq | down
        diagonal = ((((x & up) + up) ^ up) | x) & full
        plus, minus = down | (full & ~(diagonal | up)), up & diagonal
        if plus & top:
            distance += 1
        elif minus & top:
            distance -= 1
        plus, minus = (plus << 1) & full, (minus << 1) & full
        up, down = minus | (full & ~(diagonal | plus)), plus & diagonal
        if distance <= errors and (best is None or distance < best[0]):
            best = (distance, end)
            if not distance:
                break
    return best


class Matcher:
    """Finds items in normalised texts."""

    def __init__(self, items: list[tuple[int | None, str]], rate: float):
        import ahocorasick

        self.items, self.automaton = [], ahocorasick.Automaton()
        owners: dict[str, list[tuple[int, int]]] = {}
        for item_id, text in items:
            text = normal(text)
            if not text:
                continue
            errors = math.floor(rate * len(text))
            masks: dict[str, int] = {}
            for i, c in enumerate(text):
                masks[c] = masks.get(c, 0) | 1 << i
            for a, b in pieces(len(text), errors):
                owners.setdefault(text[a:b], []).append((len(self.items), a))
            self.items.append((item_id, text, errors, masks))
        for piece, own in owners.items():
            self.automaton.add_word(piece, (len(piece), own))
        if owners:
            self.automaton.make_automaton()

    def find(self, text: str) -> list[tuple[int | None, int, int]]:
        """(item id, fewest edits, end of that appearance) for every item in `text`."""
        if not self.items:
            return []
        windows: dict[int, list[list[int]]] = {}
        for last, (length, own) in self.automaton.iter(text):
            for which, offset in own:
                _, item, errors, _ = self.items[which]
                start = last + 1 - length - offset
                low, high = max(0, start - errors), min(len(text), start + len(item) + errors)
                spans = windows.setdefault(which, [])
                if spans and low <= spans[-1][1] and low >= spans[-1][0]:
                    spans[-1][1] = max(high, spans[-1][1])
                else:
                    spans.append([low, high])
        found = []
        for which, spans in windows.items():
            item_id, item, errors, masks = self.items[which]
            exact = text.find(item)
            if exact >= 0:
                found.append((item_id, 0, exact + len(item)))
                continue
            hits = [(d, low + end) for low, high in spans for d, end in [edit_search(item, masks, text[low:high], errors) or (None, 0)] if d is not None]
            if hits:
                found.append((item_id, *min(hits)))
        return found


_MATCHERS: dict[str, Matcher] = {}


def _matcher(name: str, shared, rate: float) -> Matcher:
    """The matcher of a block, made once per Python worker."""
    if name not in _MATCHERS:
        _MATCHERS.clear()
        _MATCHERS[name] = Matcher(shared.value, rate)
    return _MATCHERS[name]


def item_blocks(items: DataFrame, item_id: str, text: str) -> Iterator[list[tuple[int | None, str]]]:
    """The items in lists whose size is checked before they are collected."""
    items = items.select(F.col(item_id).cast("long").alias("id"), F.col(text).alias("text")).filter("length(text) > 0")
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, math.ceil(2 * total / BLOCK_CHARS))  # hashing is uneven: aim at half
    for block in range(n):
        rows = items.filter(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == block).collect()
        yield sorted((tuple(r) for r in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))


def matches(docs: DataFrame, items: DataFrame, rate: float = RATE) -> DataFrame:
    """(doc_id, item_id, errors, found_end): every item found in every document; found_end counts characters of the normalised text."""
    spark = docs.sparkSession
    out: DataFrame | None = None

    def task(shared) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        name = uuid.uuid4().hex

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            matcher = _matcher(name, shared, rate)
            for batch in batches:
                rows = [(i.as_py(), *hit) for i, t in zip(batch["doc_id"], batch["text"]) for hit in matcher.find(normal(t.as_py()))]
                columns = list(zip(*rows)) or [(), (), (), ()]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "item_id", "errors", "found_end"])

        return run

    for block in item_blocks(items, "item_id", "text"):
        part = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
            task(spark.sparkContext.broadcast(block)), "doc_id long, item_id long, errors long, found_end long")
        out = part if out is None else out.union(part)
    return out


def clean(docs: DataFrame, items: DataFrame, rate: float = RATE, text: str = "text") -> DataFrame:
    """The rows of `docs` in which no item is found, with all their columns."""
    spark = docs.sparkSession

    def task(shared) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        name = uuid.uuid4().hex

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            matcher = _matcher(name, shared, rate)
            for batch in batches:
                yield batch.filter(pa.array([not matcher.find(normal(t.as_py())) for t in batch[text]], pa.bool_()))

        return run

    for block in item_blocks(items.select(F.lit(0).alias("item_id"), "text"), "item_id", "text"):
        docs = docs.mapInArrow(tidy(task(spark.sparkContext.broadcast(block))), docs.schema)
    return docs
