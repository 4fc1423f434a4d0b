"""Token counts by section: every whole document is encoded once, and its tokens' character spans are joined to the sections' intervals.

Sections are the lines of a text (each with its line break) or the fields of a row, set one after the other. Both sides are sorted, so the
interval join is one merge per document. A token that crosses a boundary belongs to the section that RULE names:

* "first": the section of its first character (the default);
* "last": the section of its last character;
* "most": the section with most of its characters, the earlier one of two.

Tokens that are parts of one character count where the character stands. Every token counts exactly once. A null or empty text is one empty
section without tokens; null fields are empty. Rows that repeat an id are answered one by one."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tidy
from .encoder import encoder
from .tokens import runs


def line_starts(text: str) -> np.ndarray:
    """The first character of each line; a final line break starts no further line."""
    breaks = np.flatnonzero(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32) == 10) + 1
    return np.r_[0, breaks[breaks < len(text)]]


def assign(low: np.ndarray, high: np.ndarray, starts: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """(section of each token, whether it crosses a boundary) for spans [low, high) and sorted section starts."""
    first = np.searchsorted(starts, low, "right") - 1
    last = np.searchsorted(starts, np.maximum(high - 1, low), "right") - 1
    if rule == "first":
        chosen = first
    elif rule == "last":
        chosen = last
    elif rule == "most":
        chosen = first.copy()
        ends = np.r_[starts[1:], np.iinfo(np.int64).max]
        for i in np.flatnonzero(first != last):
            own = np.arange(first[i], last[i] + 1)
            chosen[i] = own[np.argmax(np.minimum(ends[own], high[i]) - np.maximum(starts[own], low[i]))]
    else:
        raise ValueError(f"unknown rule {rule!r}")
    return chosen, first != last


def token_counts(docs: DataFrame, path: str, rule: str = "first", fields: list[str] | None = None) -> DataFrame:
    """doc_id, section, start, length, n_tokens, n_crossing: one row for each section of each row of `docs`.

    Sections are the lines of `text`, or the given `fields`, which are joined by line breaks that belong to the field before. n_crossing
    counts the tokens allotted to the section that reach beyond it. Row-local."""
    names = ["doc_id", "section", "start", "length", "n_tokens", "n_crossing"]
    if fields:
        joined = F.concat_ws("\n", *[F.coalesce(F.col(f).cast("string"), F.lit("")) for f in fields])
        bounds = F.array(*[F.coalesce(F.length(F.col(f).cast("string")), F.lit(0)) for f in fields])
    else:
        joined, bounds = F.col("text"), F.lit(None).cast("array<int>")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), joined.alias("text"), bounds.alias("sizes"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = encoder(path, offsets=True)
        for batch in batches:
            for at, texts in runs(batch["text"]):
                _, cuts, low, high = model.encode(texts)
                out: list[list[np.ndarray]] = [[] for _ in range(5)]
                for k, text in enumerate(texts):
                    sizes = batch["sizes"][at + k].as_py()
                    starts = line_starts(text) if sizes is None else np.cumsum([0] + [s + 1 for s in sizes[:-1]])
                    section, crossing = assign(low[cuts[k]:cuts[k + 1]], high[cuts[k]:cuts[k + 1]], starts, rule)
                    n = len(starts)
                    for column, values in zip(out, (np.arange(n), starts, np.diff(np.r_[starts, max(len(text), starts[-1])]), np.bincount(section, minlength=n),
                                                    np.bincount(section[crossing], minlength=n))):
                        column.append(values)
                owner = np.repeat(np.arange(len(texts)), [len(x) for x in out[0]])
                yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(at, len(texts)).take(pa.array(owner)), *[pa.array(np.concatenate(c), pa.int64()) for c in out]],
                                                 names=names)

    return rows.mapInArrow(tidy(run), "doc_id long, section long, start long, length long, n_tokens long, n_crossing long")
