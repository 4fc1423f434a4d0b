"""Exact near-duplicate vectors by cover trees and dual traversal.

A tree's nodes have nested levels of halving radii: a node's children are its own centre and further points, so that all its points are within
half its radius of a child. Distances are chords between unit vectors. Of two nodes with centres further apart than the link distance and
their two covering radii no points are linked, and the pair is dropped; if the centres are so near that all points must be linked, they
are counted without a look; otherwise the nodes' children are compared. Single points are decided by their cosine in double precision.

On Spark, equal vectors of a label are one. Each label's vectors are dealt to cells around centres (a greedy net of a bounded sample per label),
cells over `CELL` vectors are split; every cell has its exact covering radius. Pairs of cells that the bound does not rule out are tasks:
each builds the two trees and walks them. A task returns link counts and a spanning forest, never all pairs, so a large group of near
copies stays linear. In high dimensions, where vectors without a near copy are nearly orthogonal, the bound drops no cells and every pair
of cells of one label is a task; that is the method's limit, not a matter of Spark.

Null labels, and vectors that are null, empty or zero or hold null or non-finite components, link with nothing; nor do vectors of different
lengths. Rows that repeat an id are rows of their own. A null id answers with the smallest id it reaches."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored
from .components import components
from .jaccard import Forest

#: Vectors of a cell at most, and of the sample that a label's centres come from (about).
CELL = 2048
SAMPLE = 1024
#: Vectors of a label that meet its centres in one task (about).
SLICE = 8192
#: Two nodes with at most LEAF pairs of points are settled by those pairs' cosines.
LEAF = 1 << 12
_SLACK = 1e-9


class CoverTree:
    """Cover tree over unit vectors; a node's points are order[start:end], its children nodes or points."""

    def __init__(self, unit: np.ndarray):
        self.unit = unit
        self.cosine = unit @ unit.T  # of one cell, so CELL x CELL numbers at most
        self.order = np.arange(len(unit))
        self.centre, self.radius, self.start, self.end, self.children = [], [], [], [], []
        self._add(0, 0, len(unit), 2.0)
        at = 0
        while at < len(self.centre):  # nodes are split in the order they are made
            self._split(at)
            at += 1

    def _add(self, centre: int, start: int, end: int, reach: float) -> int:
        members = self.order[start:end]
        self.centre.append(centre)
        self.radius.append((float(chord(self.cosine[centre][members]).max()) if end - start > 1 else 0.0, reach))
        self.start.append(start)
        self.end.append(end)
        self.children.append(np.zeros(0, int))
        return len(self.centre) - 1

    def _split(self, node: int) -> None:
        start, end = self.start[node], self.end[node]
        if end - start <= 1:
            return
        covering, reach = self.radius[node]
        while reach / 2 >= covering and reach > 1e-6:  # levels with one child
            reach /= 2
        half = reach / 2 if reach > 1e-6 else -1.0
        rest = self.order[start:end].copy()
        groups, centre = [], self.centre[node]
        while len(rest):
            near = chord(self.cosine[centre][rest]) <= half
            near[rest == centre] = True
            groups.append((centre, rest[near]))
            rest = rest[~near]
            centre = int(rest[0]) if len(rest) else -1
        at, kids = start, []
        for own, members in groups:
            self.order[at:at + len(members)] = members
            kids.append(self._add(own, at, at + len(members), half))
            at += len(members)
        self.children[node] = np.array(kids)

    def finish(self) -> None:
        del self.cosine
        self.centre, self.start, self.end = np.array(self.centre), np.array(self.start), np.array(self.end)
        self.radius = np.array([r[0] for r in self.radius])


def chord(cosine: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, 2 - 2 * cosine))


def tree_of(unit: np.ndarray) -> CoverTree:
    tree = CoverTree(unit)
    tree.finish()
    return tree


def dual_links(a: CoverTree, b: CoverTree, same: bool, raw_a: np.ndarray, raw_b: np.ndarray, weight_a: np.ndarray, weight_b: np.ndarray, least: float):
    """(links of a's points, links of b's points, forest) over all pairs; with `same`, a is b and pairs are unordered and distinct."""
    reach = math.sqrt(2 - 2 * least)
    links_a, links_b = np.zeros(len(weight_a)), np.zeros(len(weight_b))
    forest, edges = Forest(len(weight_a) + (0 if same else len(weight_b))), []
    shift = 0 if same else len(weight_a)

    def link(x: int, y: int) -> None:
        if forest.join(x, y + shift):
            edges.append((x, y))

    def exact(xs: np.ndarray, ys: np.ndarray, cosine: np.ndarray) -> np.ndarray:
        """Cosines, those next to the threshold from the vectors themselves."""
        near = np.abs(cosine - least) < 1e-9
        if near.any():
            x, y = raw_a[xs[near]], raw_b[ys[near]]
            cosine[near] = (x * y).sum(1) / (np.sqrt((x * x).sum(1)) * np.sqrt((y * y).sum(1)))
        return cosine

    def settle(left: np.ndarray, right: np.ndarray, small: np.ndarray, own: bool) -> None:
        """All pairs of points of the pairs of nodes marked in `small`: one product where these fill much of it, else pair by pair."""
        rows, columns = np.flatnonzero(small.any(1)), np.flatnonzero(small.any(0))
        m, n = left[rows], right[columns]
        wanted = small[np.ix_(rows, columns)]
        tall, wide = a.end[m] - a.start[m], b.end[n] - b.start[n]
        if tall @ wanted @ wide * 8 >= tall.sum() * wide.sum():
            blocks = [(np.arange(len(m)), np.arange(len(n)))]
        else:
            blocks = [(np.array([i]), np.flatnonzero(w)) for i, w in enumerate(wanted)]
        for i, j in blocks:
            node_x, node_y = np.repeat(i, tall[i]), np.repeat(j, wide[j])
            xs = np.concatenate([a.order[a.start[k]:a.end[k]] for k in m[i]])
            ys = np.concatenate([b.order[b.start[k]:b.end[k]] for k in n[j]])
            cosine = a.unit[xs] @ b.unit[ys].T
            x, y = np.nonzero(cosine >= least - 1e-9)
            take = wanted[node_x[x], node_y[y]]
            if own:  # points of one node: each pair once
                take &= (rows[node_x[x]] != columns[node_y[y]]) | (xs[x] < ys[y])
            x, y = x[take], y[take]
            hit = exact(xs[x], ys[y], cosine[x, y]) >= least
            x, y = xs[x[hit]], ys[y[hit]]
            np.add.at(links_a, x, weight_b[y])
            np.add.at(links_b, y, weight_a[x])
            for p, q in zip(x.tolist(), y.tolist()):
                link(p, q)

    stack = [(np.array([0]), np.array([0]), same)]
    while stack:
        left, right, own = stack.pop()
        cosine = a.unit[a.centre[left]] @ b.unit[b.centre[right]].T
        far = chord(cosine)
        spread = a.radius[left][:, None] + b.radius[right][None, :]
        maybe = far <= reach + spread + _SLACK
        if own:  # one set of nodes with itself: each pair of nodes once
            maybe &= np.arange(len(left))[:, None] <= np.arange(len(right))[None, :]
        size_a, size_b = a.end[left] - a.start[left], b.end[right] - b.start[right]
        single = (size_a == 1)[:, None] & (size_b == 1)[None, :]
        for i, j in np.argwhere(maybe & single):
            x, y = a.centre[left[i]], b.centre[right[j]]
            if own and i == j:
                continue
            value = cosine[i, j]
            if abs(value - least) < 1e-9:
                value = float(raw_a[x] @ raw_b[y]) / math.sqrt(float(raw_a[x] @ raw_a[x]) * float(raw_b[y] @ raw_b[y]))
            if value >= least:
                links_a[x] += weight_b[y]
                links_b[y] += weight_a[x]
                link(x, y)
        certain = maybe & ~single & (far + spread <= reach - _SLACK)
        open_ = maybe & ~single
        small = open_ & ~certain & (size_a[:, None] * size_b[None, :] <= LEAF)
        if small.any():
            settle(left, right, small, own)
        for i, j in np.argwhere(open_ & ~small):
            m, n = left[i], right[j]
            self_pair = own and i == j
            if certain[i, j] and not self_pair or self_pair and 2 * a.radius[m] <= reach - _SLACK:
                xs, ys = a.order[a.start[m]:a.end[m]], b.order[b.start[n]:b.end[n]]
                if self_pair:
                    links_a[xs] += weight_a[xs].sum() - weight_a[xs]
                else:
                    links_a[xs] += weight_b[ys].sum()
                    links_b[ys] += weight_a[xs].sum()
                for x in xs:
                    link(int(x), int(ys[0]))
                for y in ys:
                    link(int(xs[0]), int(y))
                continue
            if self_pair:
                stack.append((a.children[m], a.children[m], True))
            elif size_b[j] == 1 or (size_a[i] > 1 and a.radius[m] >= b.radius[n]):
                stack.append((a.children[m], np.array([n]), False))
            else:
                stack.append((np.array([m]), b.children[n], False))
    if same:
        links_a += links_b
    return links_a, links_b, edges


def _unit(vectors: np.ndarray) -> np.ndarray:
    scaled = vectors / np.abs(vectors).max(1, keepdims=True)  # very large and very small components keep their direction
    return scaled / np.sqrt((scaled * scaled).sum(1, keepdims=True))


def _vectors(values: pd.Series) -> np.ndarray:
    return np.stack([np.frombuffer(v, "<f8") for v in values])


def _walk(least: float):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["side", "rep"])
        parts = [rows[rows["side"] == s] for s in (0, 1)]
        raw = [_vectors(p["vector"]) if len(p) else None for p in parts]
        scaled = [r if r is None else r / np.abs(r).max(1, keepdims=True) for r in raw]
        trees = [t if t is None else tree_of(_unit(t)) for t in raw]
        weights = [p["copies"].to_numpy(float) for p in parts]
        reps = [p["rep"].to_numpy() for p in parts]
        same = raw[1] is None
        b = 0 if same else 1
        links_a, links_b, edges = dual_links(trees[0], trees[b], same, scaled[0], scaled[b], weights[0], weights[b], least)
        out = [pd.DataFrame({"rep": reps[0], "links": links_a, "other": pd.array([None] * len(reps[0]), "Int64")})]
        if not same:
            out.append(pd.DataFrame({"rep": reps[1], "links": links_b, "other": pd.array([None] * len(reps[1]), "Int64")}))
        if edges:
            x, y = np.array(edges).T
            out.append(pd.DataFrame({"rep": reps[0][x], "links": 0.0, "other": pd.array(reps[b][y], "Int64")}))
        done = pd.concat(out).astype({"links": "int64"})
        return done[(done["links"] > 0) | done["other"].notna()]

    return run


def _net(rows: pd.DataFrame) -> pd.DataFrame:
    """Centres of a label's cells: a greedy net of the sample, the furthest point next, until there are enough."""
    rows = rows.sort_values("rep")
    unit = _unit(_vectors(rows["vector"]))
    wanted = int(rows["cells"].iloc[0])
    chosen, far = [0], chord(unit @ unit[0])
    while len(chosen) < min(wanted, len(unit)) and far.max() > 1e-6:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, chord(unit @ unit[chosen[-1]]))
    return pd.DataFrame({"space": rows["space"].iloc[0], "cell": range(len(chosen)), "centre": [unit[c].tolist() for c in chosen]})


def _assign(points: pd.DataFrame, centres: pd.DataFrame) -> pd.DataFrame:
    """The nearest centre of every vector of one slice of a label, and the distance to it."""
    names = ["space", "rep", "copies", "vector", "cell", "far"]
    if points.empty:
        return points.reindex(columns=names)
    centres = centres.sort_values("cell")
    cosine = _unit(_vectors(points["vector"])) @ np.stack(centres["centre"].to_list()).T
    return points.assign(cell=centres["cell"].to_numpy()[cosine.argmax(1)], far=chord(cosine.max(1)))[names]


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows as (vec_id, space, vector): space is label and length, both null where nothing can be linked."""
    for batch in batches:
        spaces, vectors = [], []
        for label, value in zip(batch["label"], batch["embedding"]):
            vector = None
            if label.is_valid and value.is_valid and len(value.values) and not value.values.null_count:
                vector = value.values.to_numpy(zero_copy_only=False).astype("<f8")
                if not np.isfinite(vector).all() or not vector.any():
                    vector = None
            spaces.append(None if vector is None else f"{label.as_py()}/{len(vector)}")
            vectors.append(None if vector is None else (vector + 0.0).tobytes())
        yield pa.RecordBatch.from_arrays([batch["vec_id"], pa.array(spaces, pa.string()), pa.array(vectors, pa.binary())], names=["vec_id", "space", "vector"])


def near_vectors(vectors: DataFrame, least: float = 0.93, cell: int = CELL, sample: int = SAMPLE) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of vec_id, embedding, label."""
    packed = stored(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", "label").mapInArrow(_pack, "vec_id long, space string, vector binary")
                    .withColumn("print", F.md5("vector")), "packed")
    usable = packed.filter("space is not null")
    groups = usable.groupBy("space", "print").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"))
    groups = stored(groups.filter("rep is not null"), "groups")
    points = groups.join(usable.select(F.col("vec_id").alias("rep"), "space", "print", "vector"), ["space", "print", "rep"]).dropDuplicates(["space", "print"])
    points = stored(points.select("space", "print", "rep", "copies", "vector"), "points")

    sizes = points.groupBy("space").agg(F.count("*").alias("size")).withColumn("cells", F.ceil(F.col("size") / (cell // 2)))
    share = F.pmod(F.xxhash64("print"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sampled = points.join(sizes, "space").filter(share <= F.lit(float(sample)) / F.col("size")).select("space", "rep", "vector", F.least("cells", F.lit(sample // 4)).alias("cells"))
    centres = sampled.groupBy("space").applyInPandas(_net, "space string, cell long, centre array<double>")
    middle = F.transform(F.sequence(F.lit(1), F.expr("octet_length(vector) div 8")), lambda i: F.lit(0.0))
    lone = points.join(centres, "space", "left_anti").groupBy("space").agg(F.max(middle).alias("centre"))  # the sample of a small label may be empty
    centres = stored(centres.union(lone.select("space", F.lit(0).cast("long"), "centre")), "centres")
    # A label is dealt to slices of about SLICE vectors; each slice meets the label's centres once.
    slices = sizes.select("space", F.ceil(F.col("size") / SLICE).cast("long").alias("slices"))
    sliced = points.join(slices, "space").select("space", "rep", "copies", "vector", F.pmod(F.xxhash64("print"), F.col("slices")).alias("slice"))
    met = centres.join(slices, "space").select("space", "cell", "centre", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1)).alias("slice"))
    placed = stored(sliced.groupBy("space", "slice").cogroup(met.groupBy("space", "slice")).applyInPandas(
        _assign, "space string, rep long, copies long, vector binary, cell long, far double"), "placed")
    parts = placed.groupBy("space", "cell").agg(F.count("*").alias("size"), F.max("far").alias("radius"))
    parts = stored(parts.withColumn("parts", F.ceil(F.col("size") / cell).cast("long")), "cells")
    cells = parts.join(centres, ["space", "cell"])
    blocks = cells.select("space", "cell", "centre", "radius", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    other = blocks.select("space", *[F.col(c).alias(f"{c}2") for c in ("cell", "centre", "radius", "part")])
    apart = F.sqrt(F.aggregate(F.zip_with("centre", "centre2", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))
    ordered = (F.col("cell") < F.col("cell2")) | ((F.col("cell") == F.col("cell2")) & (F.col("part") <= F.col("part2")))
    pairs = blocks.join(other, "space").filter(ordered & (apart <= math.sqrt(2 - 2 * least) + F.col("radius") + F.col("radius2") + _SLACK))
    name = F.concat_ws(":", "space", "cell", "part", "cell2", "part2")
    role = lambda side: F.struct(name.alias("pair"), F.lit(side).alias("side")).alias("role")
    roles = pairs.select("space", "cell", "part", role(0)).union(
        pairs.filter("not (cell = cell2 and part = part2)").select("space", F.col("cell2").alias("cell"), F.col("part2").alias("part"), role(1)))
    dealt = placed.join(parts.select("space", "cell", "parts"), ["space", "cell"]).withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts")))
    tasks = dealt.join(roles, ["space", "cell", "part"]).select("role.pair", "role.side", "rep", "copies", "vector")
    found = stored(tasks.groupBy("pair").applyInPandas(_walk(least), "rep long, links long, other long"), "links")

    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    classes = components(found.filter("other is not null"), "rep", "other").select(F.col("node").alias("rep"), F.col("component").alias("class"))
    answers = groups.join(links, "rep", "left").join(classes, "rep", "left").select(
        "space", "print", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("class", "rep").alias("component_id"))
    rows = packed.select("vec_id", "space", "print").join(answers, ["space", "print"], "left")
    component = F.coalesce("component_id", "vec_id")
    return rows.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
