"""Connected components of a link table: local contraction, then alternating large and small stars."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import tidy

#: Links that one task contracts at once (about 100 bytes each).
LOCAL_LINKS = 300_000


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The links of a partition as stars: (node, smallest node it reaches here)."""
    parts = [np.stack([b["u"].to_numpy(), b["v"].to_numpy()], 1) for b in batches if b.num_rows]
    if not parts:
        return
    nodes, ends = np.unique(np.concatenate(parts), return_inverse=True)
    ends = ends.reshape(-1, 2)
    label = np.arange(len(nodes))
    while True:  # hook the larger root to the smaller, then shorten paths
        a, b = label[ends[:, 0]], label[ends[:, 1]]
        open_ = a != b
        if not open_.any():
            break
        ends = ends[open_]
        np.minimum.at(label, np.maximum(a, b)[open_], np.minimum(a, b)[open_])
        while (label != label[label]).any():
            label = label[label]
    moved = label != np.arange(len(nodes))
    yield pa.RecordBatch.from_arrays([pa.array(nodes[moved]), pa.array(nodes[label[moved]])], names=["u", "v"])


def _large(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    lowest = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(lowest, "u").filter("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small(edges: DataFrame) -> DataFrame:
    lowest = edges.groupBy("u").agg(F.min("v").alias("m"))
    onward = edges.join(lowest, "u").filter("v <> m").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v"))
    return onward.union(lowest.select("u", F.col("m").alias("v"))).distinct()


def _is_done(edges: DataFrame) -> bool:
    """Every node has one link, to a node that has none."""
    repeated = edges.groupBy("u").count().filter("count > 1").select("u")
    chained = edges.join(edges.select(F.col("v").alias("u")).distinct(), "u", "left_semi").select("u")
    return repeated.union(chained).isEmpty()


def components(links: DataFrame, a: str, b: str, local: int = LOCAL_LINKS) -> DataFrame:
    """(node, component) for every node with a link; component is the smallest node it reaches.

    Nodes are integers; links may repeat, run in either direction and join a node with itself. Partitions of at most about `local` links are
    contracted to stars, and rounds of two joins bring the stars of different partitions together, until no node is in two of them. Every
    step is written to the checkpoint folder. A hub is only ever the key of a combined minimum and of a join that can be split."""
    edges = links.select(F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v")).filter("u <> v")
    edges = materialize(edges)
    while True:
        parts = max(1, math.ceil(edges.count() / local))
        edges = materialize(edges.coalesce(parts).mapInArrow(tidy(_contract), "u long, v long"))
        if parts == 1 or _is_done(edges):
            break
        edges = materialize(_small(_large(edges)))
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.union(nodes.select("component", "component").distinct())
