"""How far the sources of one language differ in their words.

A task reads whole documents as bytes: one `bytes.translate` lowers A-Z and turns every separator into a space, `bytes.split` gives the
terms and one Counter per document their frequencies. The counters of a task are added up per language and source and given on when they
hold `ENTRIES` terms, so a worker's memory is bounded and what is shuffled is far smaller than the text.

Each language keeps the terms of at least `least` of its documents. A group (language and source) gives a kept term the scaled share
p = 1 + floor(10^9 (count + 1) / (N + V)). The divergence f = floor((p - q)^2 / q) is summed over all kept terms for every ordered pair of
sources, also over terms that one or both lack. That sum is done in blocks of terms, each a dense matrix of at most `CELLS` counts of all
sources of the language; a block gives one partial sum per pair of sources, as many as the result has rows.

All numbers are exact integers. Null texts, languages and sources are ''. Groups without terms take part with counts of 0; a language
without kept terms gives pairs of value 0. Repeated rows are documents of their own. No other columns are read."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

SCALE = 1_000_000_000
#: Terms that the counters of a task hold before they are given on.
ENTRIES = 200_000
#: Bytes of a text that are split at once.
PIECE = 1 << 22
#: Counts in the matrix of one block of terms.
CELLS = 1 << 19

#: Lower case for A-Z, a space for every other ASCII character that is no letter; bytes of longer characters stay.
TABLE = bytes(b if b >= 0x80 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


def terms(text: bytes) -> Counter:
    """Frequencies of the terms of a whole text; a long one is split piece by piece, between terms."""
    clear, found, at = text.translate(TABLE), Counter(), 0
    while at < len(clear):
        end = len(clear)
        if end - at > PIECE:
            end = clear.rfind(b" ", at, at + PIECE)
            if end < 0:
                end = clear.find(b" ", at + PIECE)
                end = len(clear) if end < 0 else end
        found.update(clear[at:end].split())
        at = end + 1
    return found


def _given(counts: dict) -> Iterator[pa.RecordBatch]:
    """The counters of a task as rows."""
    for (lang, source), (times, docs) in counts.items():
        names = list(times)
        if names:
            n = len(names)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang]).take(pa.array(np.zeros(n, np.int64))), pa.array([source]).take(pa.array(np.zeros(n, np.int64))), pa.array(names, pa.binary()).cast(pa.string()),
                 pa.array([times[t] for t in names], pa.int64()), pa.array([docs[t] for t in names], pa.int64())], names=["lang", "source", "term", "n", "docs"])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict = {}
    held = 0
    for batch in batches:
        langs, sources, texts = batch["lang"].to_pylist(), batch["source"].to_pylist(), batch["text"].cast(pa.binary())
        for i, group in enumerate(zip(langs, sources)):
            times, docs = counts.setdefault(group, (Counter(), Counter()))
            held -= len(times)
            own = terms(texts[i].as_py())
            times.update(own)
            docs.update(own.keys())
            held += len(times)
            if held > ENTRIES:
                yield from _given(counts)
                counts, held = {}, 0
    yield from _given(counts)


def share(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(10^9 * count / total) without leaving 64 bits: long division, three digits at a time."""
    out, rest = np.zeros_like(count), count
    for _ in range(3):
        step = rest * 1000
        out, rest = out * 1000 + step // total, step % total
    return 1 + out


def _share(count, total):
    """The same as a Column."""
    return (F.lit(1) + F.expr(f"cast({SCALE} as decimal(10,0)) * cast({count} as decimal(19,0)) div cast({total} as decimal(19,0))")).cast("long")


def _block_sums(block: pa.Table) -> pa.Table:
    """Partial sums of all ordered pairs of sources; rows without a term introduce the sources."""
    lang = block["lang"][0]
    known = block.filter(pc.is_null(block["term"]))
    held = block.filter(pc.is_valid(block["term"]))
    names = known["source"].combine_chunks()
    total = known["n"].to_numpy() + known["v"].to_numpy()
    row = pc.index_in(held["source"].combine_chunks(), value_set=names).to_numpy(zero_copy_only=False)
    words = held["term"].combine_chunks().dictionary_encode()
    counts = np.zeros((len(names), len(words.dictionary)), dtype=np.int64)
    counts[row, words.indices.to_numpy()] = held["n"].to_numpy()
    p = share(counts + 1, total[:, None])
    first, second, value = [], [], []
    for s in range(len(names)):
        gap = p[s] - p
        sums = (gap * gap // p).sum(axis=1)
        others = np.flatnonzero(np.arange(len(names)) != s)
        first.append(np.full(len(others), s))
        second.append(others)
        value.append(sums[others])
    return pa.table({"lang": pa.array([lang.as_py()] * sum(map(len, value)), pa.string()), "source": names.take(pa.array(np.concatenate(first))),
                     "item": names.take(pa.array(np.concatenate(second))), "value": pa.array(np.concatenate(value), pa.int64())})


def term_counts(docs: DataFrame, least: int = 3) -> DataFrame:
    """(lang, source, term, n, lang_n, first) of every kept term that a group has; `first` marks one row of each term of a language."""
    text = docs.select(*(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    counted = text.mapInArrow(_count, "lang string, source string, term string, n long, docs long")
    # dealt once, by language and term: both the groups' sums and the language's are worked out there
    summed = counted.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    of_term = Window.partitionBy("lang", "term")
    whole = summed.select("lang", "source", "term", "n", F.sum("docs").over(of_term).alias("in_docs"), F.sum("n").over(of_term).alias("lang_n"),
                          (F.col("source") == F.min("source").over(of_term)).alias("first"))
    return whole.filter(F.col("in_docs") >= least).drop("in_docs")


def audit(docs: DataFrame, least: int = 3, top: int = 200) -> DataFrame:
    """(lang, source, part, item, value, rank): all pairs of sources of a language, and each group's `top` terms above the language's share."""
    kept = stored(term_counts(docs, least), "terms")
    groups = docs.select(*(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source"))).distinct()
    langs = kept.groupBy("lang").agg(F.sum(F.col("first").cast("long")).alias("v"), F.sum("n").alias("lang_total"))
    sizes = groups.groupBy("lang").agg(F.count("*").alias("sources")).join(langs, "lang", "left").na.fill(0, ["v", "lang_total"])
    blocks = F.greatest(F.lit(1), F.ceil(F.col("v") * F.col("sources") / CELLS)).cast("int")
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    facts = groups.join(totals, ["lang", "source"], "left").na.fill(0, ["total"]).join(sizes.withColumn("blocks", blocks), "lang")
    facts = stored(facts, "groups")

    headers = facts.select("lang", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "source", F.lit(None).cast("string").alias("term"), F.col("total").alias("n"), "v")
    entries = kept.join(facts.select("lang", "source", "blocks"), ["lang", "source"]).select(
        "lang", F.pmod(F.xxhash64("term"), "blocks").cast("int").alias("block"), "source", "term", "n", F.lit(0).cast("long").alias("v"))
    partial = headers.union(entries).groupBy("lang", "block").applyInArrow(_block_sums, "lang string, source string, item string, value long")
    pairs = partial.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    in_order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(in_order).alias("rank"))

    shares = kept.join(facts, ["lang", "source"]).select("lang", "source", F.col("term").alias("item"), _share("n + 1", "total + v").alias("p"), _share("lang_n + 1", "lang_total + v").alias("q"))
    found = shares.filter("p > q").select("lang", "source", "item", F.expr("(p - q) * (p - q) div q").alias("value"))
    best = found.withColumn("rank", F.row_number().over(in_order)).filter(F.col("rank") <= top)
    return pairs.union(best.select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank"))


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
w AS (SELECT r, lang, source, translate(unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM d),
k AS (SELECT lang, term, count(*) AS n FROM w GROUP BY ALL HAVING count(DISTINCT r) >= 3),
g AS (SELECT DISTINCT lang, source FROM d),
o AS (SELECT w.lang, w.source, w.term, count(*) AS n FROM w JOIN k USING (lang, term) GROUP BY ALL),
v AS (SELECT lang, count(*) AS v, sum(n) AS total FROM k GROUP BY lang),
t AS (SELECT lang, source, sum(n) AS total FROM o GROUP BY ALL),
c AS (SELECT g.lang, g.source, k.term, coalesce(o.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(o.n, 0) + 1)) // (coalesce(t.total, 0) + v.v) AS p,
  1 + (1000000000::HUGEINT * (k.n + 1)) // (v.total + v.v) AS lang_p
  FROM g JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN o ON o.lang = g.lang AND o.source = g.source AND o.term = k.term LEFT JOIN t ON t.lang = g.lang AND t.source = g.source),
s AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM c a JOIN c b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
both_parts AS (SELECT * FROM pairs UNION ALL SELECT lang, source, 'term', term, (p - lang_p) * (p - lang_p) // lang_p FROM c WHERE n > 0 AND p > lang_p),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM both_parts)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INT) AS rank FROM ranked WHERE part = 'pair' OR rank <= 200
"""
