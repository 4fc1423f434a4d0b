"""Operators as filters of a table of documents: every stage keeps the columns it was given."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import jaccard, quality


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Rows whose quality score reaches the threshold; row-local after the fit."""
    model = quality.fit(docs, labels)
    out = "__quality" + "_" * max(map(len, docs.columns))  # no column of the caller's has this name
    return quality.score(docs, model, out=out).filter(F.col(out) >= threshold).drop(out)


def keep_distinct(docs: DataFrame, share: int = 80, width: int = 5) -> DataFrame:
    """One document of each class of linked documents, the one with the smallest id.

    Rows with a null id are kept. Rows that repeat an id are one document: of these the smallest row stays."""
    classes = jaccard.linked_sets(docs, share, width)
    lost = classes.filter("doc_id <> component_id").select("doc_id")
    repeated = classes.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").select("doc_id")
    kept = docs.join(lost, "doc_id", "left_anti")
    if repeated.isEmpty():
        return kept
    rows = kept.join(repeated, "doc_id", "left_semi").select("doc_id", F.struct(*(kept[f"`{c.replace('`', '``')}`"] for c in kept.columns)).alias("row"))
    once = rows.groupBy("doc_id").agg(F.min("row").alias("row")).select("row.*")
    return kept.join(repeated, "doc_id", "left_anti").union(once)
