"""Exact Jaccard self-join of documents' word-shingle sets, answered with the relations between sets.

Copies of a set are one set. Two sets of similarity t share one of the first n - ceil(t n) + 1 shingles in any order of all shingles. The
order used has a zone of hashes first, twice as large as that prefix. In the zone shingles that one set alone holds come first, then the
others, rare ones before frequent ones; behind the zone the order is by hash. The zone's part of every set is indexed and counted over all
sets; most sets' prefixes then hold nothing that another set has, and they are done. Sets that meet in the index form neighbourhoods,
which are cut into blocks by set size, and compared there in two rounds. The first round has a parity sketch of each set (2 to 4 bits per
shingle): the sketches of two sets differ in at most as many bits as the sets differ in shingles, so pairs that differ in too many bits
are ruled out for certain. What is left forms new neighbourhoods, and only their sets are compared in full. Within a pair of blocks

* lists hold positions of sets in order of size, and a set reads only the stretch of each list whose sizes can reach the threshold and
  that stands before it; the rest is skipped (index skipping), and
* the overlaps of a set that is close to the previous one are derived from that one's overlaps: only the lists of the shingles
  in which the two differ are read (answer skipping).

Links inside a task are reduced to a spanning forest, so a group of m near copies sends m links, not m². No link is lost: every
pair that can reach the threshold meets in exactly one task. Shingles are 64-bit hashes; two sets are told apart by 128 bits."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import hashed_words, likely, mix, slices, slot_bits, stored, tidy, tidy_group
from .components import components

#: A block holds about so many sets and shingles, with sketches and with full sets.
SKETCH_BLOCK, SET_BLOCK = (1024, 2_000_000), (512, 200_000)
#: Neighbourhoods of up to so many sets share blocks.
SMALL = 64
#: Rows (of 24 bytes) of the cuts of large neighbourhoods that are broadcast; more of them are joined over so many salts.
BROADCAST_CUTS, SALTS = 200_000, 16


def shingle_sets(data: np.ndarray, bounds: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingles of all rows one after the other, n + 1 cuts).

    A row with fewer than `width` words has its whole sequence as one shingle; a row without words has none."""
    h, row = hashed_words(data, bounds)
    n_rows = len(bounds) - 1
    per_row = np.bincount(row, minlength=n_rows)
    first = np.cumsum(per_row) - per_row
    short = np.flatnonzero((per_row > 0) & (per_row < width))
    value, owner = h[:0], row[:0]
    if len(h) >= width:
        value = np.zeros(len(h) - width + 1, dtype=np.uint64)
        for k in range(width):
            value = mix(value * np.uint64(0x9FB21C651E98DF25) + h[k:len(h) - width + 1 + k])
        inside = row[:len(value)] == row[width - 1:]
        value, owner = value[inside], row[:len(inside)][inside]
    if len(short):
        extra = np.array([np.bitwise_xor.reduce(mix(h[first[i]:first[i] + per_row[i]] + np.arange(per_row[i], dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)))
                          for i in short], dtype=np.uint64)
        value, owner = np.r_[value, extra], np.r_[owner, short]
        order = np.argsort(owner, kind="stable")
        value, owner = value[order], owner[order]
    cuts = np.searchsorted(owner, np.arange(n_rows + 1))
    sets = [np.unique(value[a:b]) for a, b in zip(cuts[:-1], cuts[1:])]
    return np.concatenate([*sets, h[:0]]), np.cumsum([0, *map(len, sets)])


def _fingerprints(values: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    one, two = np.r_[np.uint64(0), np.cumsum(mix(values), dtype=np.uint64)], np.r_[np.uint64(0), np.cumsum(mix(values ^ np.uint64(0x94D049BB133111EB)), dtype=np.uint64)]
    return (one[cuts[1:]] - one[cuts[:-1]]).view(np.int64), (two[cuts[1:]] - two[cuts[:-1]]).view(np.int64)


def sketch(values: np.ndarray) -> bytes:
    """Parity of the number of shingles in each of 2^k slots, 2^k from 2 to 4 slots per shingle."""
    size = max(64, 1 << (2 * len(values) - 1).bit_length())
    return np.packbits(np.bincount((values & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1, bitorder="little").tobytes()


def needed(a, b, share: int):
    """Least overlap of sets of sizes a and b with 100 * overlap >= share * union."""
    return -(-share * (a + b) // (100 + share))


def _first_pass(width: int):
    """Per document the size, fingerprint and sketch of its set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, end, data, bounds in slices(batch["text"]):
                values, cuts = shingle_sets(data, bounds, width)
                one, two = _fingerprints(values, cuts)
                sketches = [sketch(values[a:b]) for a, b in zip(cuts[:-1], cuts[1:])]
                yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(start, end - start), pa.array(np.diff(cuts), pa.int64()), pa.array(one), pa.array(two),
                                                  pa.array(sketches, pa.binary())], names=["doc_id", "n", "f1", "f2", "sketch"])

    return run


def zone(share: int) -> int:
    """Shingles whose upper 32 bits are below this are counted exactly: twice the part of a set that its prefix is."""
    return min(1 << 32, (1 << 32) * 2 * (100 - share) // 100)


def _index_pass(width: int, share: int):
    """(shingle, f1, n, inside) for the zone's shingles of every set (`inside` of them), and for those behind it that its prefix needs.

    Copies in the same stretch of a task are written once."""
    limit = np.uint64(zone(share))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set = set()
        for batch in batches:
            for _, _, data, bounds in slices(batch["text"]):
                values, cuts = shingle_sets(data, bounds, width)
                one, two = _fingerprints(values, cuts)
                n = np.diff(cuts)
                picks, who, inside = [], [], np.zeros(len(n), np.int32)
                for i in np.flatnonzero(n):
                    if (one[i], two[i]) in seen:
                        continue
                    seen.add((one[i], two[i]))
                    own = values[cuts[i]:cuts[i + 1]]  # sorted, so the zone comes first
                    inside[i] = np.searchsorted(own, limit << np.uint64(32)) if limit < 1 << 32 else len(own)
                    picks.append(own[:max(inside[i], int(n[i] - -(-share * n[i] // 100) + 1))])
                    who.append(np.full(len(picks[-1]), i))
                if len(seen) > 20_000:
                    seen = set()
                if picks:
                    of = np.concatenate(who)
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(picks).view(np.int64)), pa.array(one[of]), pa.array(n[of], pa.int32()), pa.array(inside[of])],
                                                     names=["shingle", "f1", "n", "inside"])

    return run


def _set_pass(width: int):
    """One row with the set itself for every pair of blocks that a (rep, f1, f2, area, pairs, text) row takes part in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, end, data, bounds in slices(batch["text"]):
                values, cuts = shingle_sets(data, bounds, width)
                one, two = _fingerprints(values, cuts)
                part = batch.slice(start, end - start)
                same = (one == part["f1"].to_numpy()) & (two == part["f2"].to_numpy())
                pairs = part["pairs"].to_pylist()
                rows = [(i, p["pair"], p["side"]) for i in np.flatnonzero(same) for p in pairs[i]]
                for at in range(0, len(rows), 500):
                    own = rows[at:at + 500]
                    at_row = pa.array([r[0] for r in own], pa.int64())
                    yield pa.RecordBatch.from_arrays(
                        [part["rep"].take(at_row), part["area"].take(at_row), pa.array([r[1] for r in own], pa.string()), pa.array([r[2] for r in own], pa.int32()),
                         pa.array([values[cuts[r[0]]:cuts[r[0] + 1]].tobytes() for r in own], pa.binary())], names=["rep", "area", "pair", "side", "members"])

    return run


class Forest:
    """Union-find over small integers."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)
        return a != b


def join_block(sets: list[np.ndarray], left: np.ndarray, share: int, counts: dict[str, int] | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the links between sets; with two sides, only links across them.

    `left` is True for sets of the first side; all True means a join of one side with itself. `counts` takes how many list entries were
    read, how many of the same lists were skipped by position, and how many lists answers derived from the previous set's spared."""
    order = np.argsort([len(s) for s in sets], kind="stable")
    sets = [sets[i] for i in order]
    side = left[order]
    across = not side.all()
    n = np.array([len(s) for s in sets])
    held = np.concatenate(sets)
    _, word, times = np.unique(held, return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), n)
    shared = times[word] > 1
    word, owner = word[shared], owner[shared]
    cut = np.searchsorted(owner, np.arange(len(sets) + 1))
    by_word = np.argsort(word, kind="stable")  # within a list positions rise, so sizes rise too
    lists, heads = owner[by_word], np.searchsorted(word[by_word], np.arange(len(times) + 1))

    tally = counts if counts is not None else {}
    tally.update({k: tally.get(k, 0) for k in ("read", "skipped", "spared")})

    def reading(tokens: np.ndarray, low: int, high: int) -> np.ndarray:
        """How often each set from position low to high is in the lists of `tokens`; the lists' other stretches are skipped."""
        parts = [lists[heads[t]:heads[t + 1]] for t in tokens]
        whole = sum(map(len, parts))
        parts = [p[np.searchsorted(p, low):np.searchsorted(p, high)] for p in parts]
        entries = np.concatenate([*parts, lists[:0]])
        tally["read"] += len(entries)
        tally["skipped"] += whole - len(entries)
        return np.bincount(entries - low, minlength=high - low)

    forest, found = Forest(len(sets)), []
    before = None
    for x in range(len(sets)):
        low = int(np.searchsorted(n, -(-share * n[x] // 100)))  # rises with x, so what is known of the previous set reaches as far down
        own = word[cut[x]:cut[x + 1]]
        overlap = None
        if before is not None and low < x:
            y, known, known_low = before
            other = word[cut[y]:cut[y + 1]]
            plus = np.setdiff1d(own, other, assume_unique=True)
            common = len(own) - len(plus)
            if common * 2 > len(own):
                minus = np.setdiff1d(other, own, assume_unique=True)
                overlap = np.empty(x - low, np.int64)
                overlap[:y - low] = known[low - known_low:] + reading(plus, low, y) - reading(minus, low, y)
                overlap[y - low:] = common  # y is the set just before x
                tally["spared"] += common
        if overlap is None:
            overlap = reading(own, low, x)
        before = (x, overlap, low)
        for y in np.flatnonzero(overlap >= needed(n[low:x], n[x], share)) + low:
            if (not across or side[x] != side[y]) and forest.join(x, int(y)):
                found.append((int(order[x]), int(order[y])))
    return found


def sketch_block(n: np.ndarray, sketches: list[bytes], left: np.ndarray, share: int) -> list[tuple[int, int]]:
    """A spanning forest of the pairs that the sketches do not rule out; arguments as in join_block."""
    order = np.argsort(n, kind="stable")
    n, side, across = n[order], left[order], not left.all()
    rows = [np.frombuffer(sketches[i], np.uint64) for i in order]
    width = np.array([len(r) for r in rows])  # rises with n
    edges = np.flatnonzero(np.r_[True, width[1:] != width[:-1], True])
    classes = [(int(a), int(b), np.stack(rows[a:b])) for a, b in zip(edges[:-1], edges[1:])]
    forest, found = Forest(len(n)), []
    for x in range(len(n)):
        low = int(np.searchsorted(n, -(-share * n[x] // 100)))
        for a, b, matrix in classes:
            a2, b2 = max(a, low), min(b, x)
            if a2 >= b2:
                continue
            own = rows[x]
            while len(own) > matrix.shape[1]:  # folding a sketch gives the sketch of half as many slots
                own = own[:len(own) // 2] ^ own[len(own) // 2:]
            differ = np.bitwise_count(matrix[a2 - a:b2 - a] ^ own).sum(1, dtype=np.int64)
            for y in np.flatnonzero(differ <= n[a2:b2] + n[x] - 2 * needed(n[a2:b2], n[x], share)) + a2:
                if (not across or side[x] != side[y]) and forest.join(x, int(y)):
                    found.append((int(order[x]), int(order[y])))
    return found


def _by_area(rows: pd.DataFrame, compare) -> pd.DataFrame:
    """Links found by `compare` inside each neighbourhood; small neighbourhoods share a block."""
    reps, area = rows["rep"].to_numpy(), rows["area"].to_numpy()
    left = (rows["side"] == 0).to_numpy()
    order = np.argsort(area, kind="stable")
    links = []
    for group in np.split(order, np.flatnonzero(np.diff(area[order])) + 1):
        if len(group) > 1:
            links += [(reps[group[a]], reps[group[b]]) for a, b in compare(group, left[group])]
    return pd.DataFrame(links, columns=["a", "b"], dtype="int64")


def _sketch_task(share: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        n, sketches = rows["n"].to_numpy(), rows["sketch"].tolist()
        return _by_area(rows, lambda group, left: sketch_block(n[group], [sketches[i] for i in group], left, share))

    return run


def _join_task(share: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        sets = [np.frombuffer(m, np.uint64) for m in rows["members"]]
        return _by_area(rows, lambda group, left: join_block([sets[i] for i in group], left, share))

    return run


def _blocks(areas: DataFrame, reps: DataFrame, met: DataFrame, share: int, limits: tuple[int, int], label: str) -> DataFrame:
    """(rep, f1, f2, n, area, pairs): the pairs of blocks in which each set of a neighbourhood is compared, and on which side."""
    most_sets, most_shingles = limits
    band = F.floor(F.log("n") / -math.log(share / 100) + 1e-9).cast("int")
    members = stored(areas.join(reps, "rep").withColumn("band", band), f"{label}-members")
    totals = members.groupBy("area").agg(F.count("*").alias("area_sets"), F.sum("n").alias("area_shingles"))
    totals = totals.withColumn("small", (F.col("area_sets") <= SMALL) & (F.col("area_shingles") <= most_shingles // 4))
    in_band = members.join(totals.filter("not small").select("area"), "area", "left_semi").groupBy("area", "band").agg(F.count("*").alias("sets"), F.sum("n").alias("shingles"))
    parts = F.greatest(F.lit(1), F.ceil(F.col("sets") / most_sets), F.ceil(F.col("shingles") / most_shingles)).cast("long")
    cuts = stored(in_band.select("area", "band", parts.alias("parts")), f"{label}-cuts")  # of large neighbourhoods alone
    n_small = totals.filter("small").agg(F.sum("area_sets"), F.sum("area_shingles")).first()
    shelves = max(1, math.ceil((n_small[0] or 0) / most_sets), math.ceil((n_small[1] or 0) / most_shingles))
    block = F.when(F.col("small"), F.pmod(F.xxhash64("area"), F.lit(shelves))).otherwise(F.pmod(F.xxhash64("rep"), F.col("parts")))
    if cuts.count() <= BROADCAST_CUTS:
        cut_members = members.join(F.broadcast(cuts), ["area", "band"], "left")
    else:  # a neighbourhood may hold a third of all sets: its rows are dealt out over salts
        salted = members.withColumn("salt", F.pmod(F.xxhash64("rep"), F.lit(SALTS)))
        copies = cuts.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
        cut_members = salted.join(copies, ["area", "band", "salt"], "left").drop("salt")
    placed = cut_members.withColumn("small", F.col("parts").isNull()).select("rep", "f1", "f2", "n", "area", "band", "small", block.alias("block"))
    placed = stored(placed, f"{label}-placed")

    # two blocks are compared when their sizes fit and an indexed shingle lies in both
    large = placed.filter("not small").select("f1", "area", "band", "block")
    entries = met.filter("level = band").select("shingle", "f1").join(large, "f1").select("shingle", "area", "band", "block").distinct()
    theirs = entries.withColumnsRenamed({"band": "band2", "block": "block2"})
    fits = (F.col("band2") == F.col("band") + 1) | ((F.col("band2") == F.col("band")) & (F.col("block") < F.col("block2")))
    across = stored(entries.join(theirs, ["shingle", "area"]).filter(fits).select("area", "band", "block", "band2", "block2").distinct(), f"{label}-across")
    name = F.concat_ws(":", "area", "band", "block", "band2", "block2")
    first_side = across.select("area", "band", "block", F.struct(name.alias("pair"), F.lit(0).alias("side")).alias("p"))
    second_side = across.select("area", F.col("band2").alias("band"), F.col("block2").alias("block"), F.struct(name.alias("pair"), F.lit(1).alias("side")).alias("p"))
    roles = first_side.union(second_side).groupBy("area", "band", "block").agg(F.collect_list("p").alias("others"))
    own = F.struct(F.when(F.col("small"), F.concat_ws(":", F.lit("shelf"), "block")).otherwise(F.concat_ws(":", "area", "band", "block")).alias("pair"),
                   F.lit(0).alias("side"))
    none = F.array().cast("array<struct<pair:string,side:int>>")
    return placed.join(roles, ["area", "band", "block"], "left").select("rep", "f1", "f2", "n", "area", F.concat(F.array(own), F.coalesce("others", none)).alias("pairs"))


def linked_sets(docs: DataFrame, share: int = 90, width: int = 3) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of `docs` (doc_id, text).

    component_id is the smallest id reachable by links, the document itself included. Two documents are linked when
    100 * common shingles >= share * all shingles of both. Rows without words link with nothing. Rows that repeat an id are
    each given their own text's answer. A row with a null id answers with the smallest id it is linked to, null if none."""
    docs = docs.select("doc_id", "text")
    documents = stored(docs.mapInArrow(tidy(_first_pass(width)), "doc_id long, n long, f1 long, f2 long, sketch binary"), "sets")
    reps = documents.filter("n > 0").groupBy("f1", "f2").agg(F.min("doc_id").alias("rep"), F.max("n").alias("n")).filter("rep is not null")

    index = stored(docs.mapInArrow(tidy(_index_pass(width, share)), "shingle long, f1 long, n int, inside int"), "index")
    meeting = index.groupBy("shingle").agg(F.min("f1").alias("lo"), F.max("f1").alias("hi"), F.count("*").alias("times"))
    meeting = stored(meeting.filter("lo <> hi").select("shingle", "times"), "meeting")
    met_bits = slot_bits(meeting, "shingle")
    held = likely(index, "shingle", met_bits).join(meeting, "shingle").distinct()
    held = held.withColumn("zoned", F.shiftrightunsigned("shingle", 32) < zone(share))
    of_set = Window.partitionBy("f1", "zoned")
    free = F.col("n") - F.ceil(F.col("n") * share / 100) + 1 - (F.col("inside") - F.count("*").over(of_set))  # what unshared shingles leave of the prefix
    held = held.withColumn("free", free).withColumn("place", F.row_number().over(of_set.orderBy("times", "shingle")))
    # the prefixes' shared shingles; sets meet there in neighbouring sizes (each entry stands in its own band and the next)
    met = held.filter("not zoned or place <= free").withColumn("band", F.floor(F.log("n") / -math.log(share / 100) + 1e-9).cast("int"))
    met = stored(met.select("shingle", "f1", "band", F.explode(F.array(F.col("band"), F.col("band") + 1)).alias("level")), "met")
    met_bits[1].destroy()
    levels = met.groupBy("shingle", "level").agg(F.min("f1").alias("lo"), F.max("f1").alias("hi")).filter("lo <> hi").select("shingle", "level", "lo")
    edges = met.join(levels, ["shingle", "level"]).select("f1", "lo").filter("f1 <> lo").distinct()
    areas = components(edges, "f1", "lo").select(F.col("node").alias("f1"), F.col("component").alias("area"))
    areas = reps.select("f1", "rep").join(areas, "f1").select("rep", "area")

    roles = _blocks(areas, reps, met, share, SKETCH_BLOCK, "near")
    sketches = documents.select(F.col("doc_id").alias("rep"), "f1", "f2", "sketch").join(roles, ["rep", "f1", "f2"])
    sketches = sketches.select("rep", "area", "n", "sketch", F.explode("pairs").alias("p")).select("rep", "area", "n", "sketch", "p.pair", "p.side")
    close = stored(sketches.groupBy("pair").applyInPandas(tidy_group(_sketch_task(share)), "a long, b long"), "close")

    areas = components(close, "a", "b").select(F.col("node").alias("rep"), F.col("component").alias("area"))
    roles = stored(_blocks(areas, reps, met, share, SET_BLOCK, "set"), "roles")
    rep_bits = slot_bits(roles, "rep")
    wanted = likely(docs, "doc_id", rep_bits)
    sets = wanted.join(roles.withColumn("doc_id", F.col("rep")), "doc_id").select("rep", "f1", "f2", "area", "pairs", "text").mapInArrow(
        tidy(_set_pass(width)), "rep long, area long, pair string, side int, members binary")
    links = stored(sets.groupBy("pair").applyInPandas(tidy_group(_join_task(share)), "a long, b long"), "links")

    rep_bits[1].destroy()
    classes = components(links, "a", "b").select(F.col("node").alias("rep"), F.col("component").alias("class"))
    answers = reps.select("f1", "f2", "rep").join(classes, "rep", "left").select("f1", "f2", F.coalesce("class", "rep").alias("class"))
    with_words = documents.filter("n > 0").join(answers, ["f1", "f2"], "left")
    without = documents.filter("n = 0").withColumn("class", F.col("doc_id"))
    return with_words.select("doc_id", F.col("n").alias("n_shingles"), F.col("class").alias("component_id")).union(
        without.select("doc_id", "n", "class"))
