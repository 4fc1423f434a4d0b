"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every source gets a share of all words by its weight, at most `most` times its own size; what is over goes to the others by weight.
A source is first taken whole as often as its target allows. The rest is a weighted sample without replacement: each document has an
exponential key -ln(u) / weight, u from a hash of its id, and the documents with the smallest keys are taken while their sizes fit the
remaining budget; the one that crosses it is taken if that ends nearer to the target.

The running total over a source is found in two steps: about sqrt(documents) key ranges per source are summed, and only the range in
which the budget ends is sorted, so a source with a third of all rows is never in one task. What is applied to the documents is one cut
(key, id) per source.

Null texts have no words, a null source is a source of its own, a null id counts as -1. Rows that repeat an id share its key: they are
taken or left together."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored, word_count

WEIGHTS = (5, 2, 1)
MOST = 3
#: Characters that lower a document's quality weight.
NOISE = "0123456789|#$%&*!<>{}[]"


def quality_weight(text: str) -> Column:
    """The fourth power of the share of characters that are no noise, at least 0.05."""
    share = F.try_divide(F.length(F.translate(text, NOISE, "")), F.length(text))
    return F.coalesce(F.greatest(F.lit(0.05), share * share * share * share), F.lit(0.05))


def uniform(doc_id: str, seed: str) -> Column:
    """A number in (0, 1) that depends on the id and the seed alone."""
    text = F.concat(F.lit(seed), F.coalesce(F.col(doc_id).cast("string"), F.lit("-1")))
    return (F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("long") + 1) / F.lit(2.0**48 + 2)


def key(doc_id: str, text: str, seed: str) -> Column:
    return -F.log(uniform(doc_id, seed)) / quality_weight(text)


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size, documents, target) from one row per source (source, source_size, documents)."""
    everything = Window.partitionBy()
    ranked = sizes.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    ranked = ranked.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), ((F.col("rank") - 1) % len(weights) + 1).cast("int")))
    ranked = ranked.withColumn("cap", F.col("source_size") * most)
    filling = Window.orderBy(F.col("cap") / F.col("w"), "rank")
    ranked = (ranked.withColumn("all", F.sum("source_size").over(everything))
              .withColumn("caps_before", F.coalesce(F.sum("cap").over(filling.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
              .withColumn("w_left", F.sum("w").over(filling.rowsBetween(0, Window.unboundedFollowing))))
    ranked = ranked.withColumn("full", (F.col("all") - F.col("caps_before")) / F.col("w_left") * F.col("w") >= F.col("cap"))
    left = F.col("all") - F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0)).over(everything)
    open_weight = F.sum(F.when(F.col("full"), 0).otherwise(F.col("w"))).over(everything)
    level = F.try_divide(left, open_weight)
    target = F.when(F.col("full"), F.col("cap").cast("double")).otherwise(level * F.col("w"))
    return ranked.select("source", "source_size", "documents", target.alias("target"))


def cuts(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: str = "mix-1") -> tuple[DataFrame, DataFrame]:
    """(sized documents, one row per source with its epochs and cut). `docs` has doc_id, source, text."""
    sized = stored(docs.select("doc_id", "source", word_count("text").alias("size"), key("doc_id", "text", seed).alias("key")), "sized")
    sized = sized.withColumn("id", F.coalesce("doc_id", F.lit(-1)))
    sources = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("documents")), weights, most)
    sources = sources.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.try_divide("target", "source_size"))).otherwise(0))
    sources = sources.withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size")).withColumn("ranges", F.ceil(F.sqrt("documents")))
    sources = stored(sources, "sources")
    named = sources.select(F.col("source").alias("name"), "rest", "ranges")
    placed = sized.join(named, F.col("source").eqNullSafe(F.col("name"))).withColumn("range", F.floor(F.col("ranges") * (1 - F.exp(-F.col("key")))))
    ordered = Window.partitionBy("source").orderBy("range")
    sums = placed.groupBy("source", "range", "rest").agg(F.sum("size").alias("inside")).withColumn("end", F.sum("inside").over(ordered))
    last = (sums.filter("end > rest").groupBy("source").agg(F.min_by(F.struct("range", (F.col("end") - F.col("inside")).alias("before")), "range").alias("r"))
            .select(F.col("source").alias("name"), "r.*"))
    border = placed.drop("name").join(last.withColumnRenamed("range", "last"), F.col("source").eqNullSafe(F.col("name")) & (F.col("range") == F.col("last")))
    steps = border.groupBy("source", "key", "id", "before", "rest").agg(F.sum("size").alias("size"))
    steps = steps.withColumn("end", F.col("before") + F.sum("size").over(Window.partitionBy("source").orderBy("key", "id")))
    fits = (F.col("end") <= F.col("rest")) | (F.col("rest") - (F.col("end") - F.col("size")) > F.col("size") / 2)
    inner = steps.filter(fits).groupBy("source").agg(F.max(F.struct("key", "id")).alias("cut")).select(F.col("source").alias("name2"), "cut")
    plan = sources.join(last, F.col("source").eqNullSafe(F.col("name")), "left").join(inner, F.col("source").eqNullSafe(F.col("name2")), "left")
    plan = plan.select("source", "source_size", "target", "epochs", F.col("ranges"), F.col("range").alias("last"), "cut")
    return sized, stored(plan, "cuts")


def copies() -> Column:
    """How often a document is taken, from its key and id and its source's plan (p_ columns)."""
    at = F.floor(F.col("p_ranges") * (1 - F.exp(-F.col("key"))))
    below = F.col("p_last").isNull() | (at < F.col("p_last"))
    inside = (at == F.col("p_last")) & F.coalesce(F.struct("key", "id") <= F.col("p_cut"), F.lit(False))
    return (F.col("p_epochs") + F.when((F.col("p_target") > F.col("p_epochs") * F.col("p_source_size")) & (below | inside), 1).otherwise(0)).cast("int")


def _planned(docs: DataFrame, plan: DataFrame, source: str) -> DataFrame:
    plan = plan.select(*[F.col(c).alias(f"p_{c}") for c in plan.columns])
    return docs.join(plan, F.col(source).eqNullSafe(F.col("p_source")), "left")


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: str = "mix-1") -> DataFrame:
    """doc_id, size, source_size, target, taken for every row; taken counts the words of all copies."""
    sized, plan = cuts(docs, weights, most, seed)
    return _planned(sized, plan, "source").select("doc_id", "size", F.col("p_source_size").alias("source_size"), F.col("p_target").alias("target"),
                                                  (copies() * F.col("size")).alias("taken"))


def mix_documents(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: str = "mix-1") -> DataFrame:
    """The mix itself: the rows of `docs`, each as often as it is taken. Only one row per source meets the documents; they are not shuffled by id."""
    _, plan = cuts(docs.select("doc_id", "source", "text"), weights, most, seed)
    body = docs.select(F.struct(*[F.col(f"`{c.replace('`', '``')}`") for c in docs.columns]).alias("row"), F.col("source").alias("own_source"),
                       F.coalesce("doc_id", F.lit(-1)).alias("id"), key("doc_id", "text", seed).alias("key"))
    taken = _planned(body, plan, "own_source").withColumn("n", copies()).filter("n > 0")
    return taken.select("row", F.explode(F.array_repeat(F.lit(0), F.col("n"))).alias("copy")).select("row.*")


SQL = rf"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size,
    CASE WHEN length(text) > 0 THEN length(translate(text, '{NOISE}', '')) / CAST(length(text) AS DOUBLE) ELSE 0 END AS plain,
    (CAST('0x' || substr(md5('mix-1' || coalesce(CAST(doc_id AS VARCHAR), '-1')), 1, 12) AS BIGINT) + 1) / (pow(2.0, 48) + 2) AS u
  FROM documents),
keyed AS (SELECT *, -ln(u) / greatest(0.05, plain * plain * plain * plain) AS key FROM sized),
sources AS (
  SELECT *, 3 * source_size AS cap, CASE (rank - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w
  FROM (SELECT source, sum(size) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM sized GROUP BY source) s),
filling AS (
  SELECT *, sum(source_size) OVER () AS total,
    coalesce(sum(cap) OVER (ORDER BY cap / CAST(w AS DOUBLE), rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS caps_before,
    sum(w) OVER (ORDER BY cap / CAST(w AS DOUBLE), rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS w_left
  FROM sources),
decided AS (SELECT *, CAST(total - caps_before AS DOUBLE) / CAST(w_left AS DOUBLE) * w >= cap AS is_full FROM filling),
targets AS (
  SELECT source, source_size, CASE WHEN is_full THEN CAST(cap AS DOUBLE) ELSE
    CAST(total - sum(CASE WHEN is_full THEN cap ELSE 0 END) OVER () AS DOUBLE) / CAST(nullif(sum(CASE WHEN is_full THEN 0 ELSE w END) OVER (), 0) AS DOUBLE) * w END AS target
  FROM decided),
plans AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS epochs FROM targets),
running AS (
  SELECT k.*, p.source_size, p.target, p.epochs, p.target - p.epochs * p.source_size AS rest,
    sum(size) OVER (PARTITION BY k.source ORDER BY key, coalesce(doc_id, -1)) AS till
  FROM keyed k JOIN plans p ON k.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(source_size AS BIGINT) AS source_size, target,
  CAST(size * (epochs + CASE WHEN rest > 0 AND (till <= rest OR rest - (till - size) > size / 2.0) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM running
"""
