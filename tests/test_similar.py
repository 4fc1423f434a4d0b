"""Clusters of similar texts and typo neighbours against all pairs."""

import difflib
import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from sparkscrub.functions.text import one_edit_typo
from sparkscrub.operators import similar, variants
from sparkscrub.plans.profile import Profile

SCHEMA = "columna string, norm string, menos long, texto string"


def greedy(rows, threshold):
    out = {}
    for column in {r[0] for r in rows}:
        leaders = []
        for _, norm, _, _ in sorted((r for r in rows if r[0] == column), key=lambda r: (r[2], r[3].encode())):
            lead = next((x for x in leaders if similar.similar(x, norm, threshold)), None)
            out[column, norm] = lead or norm
            if lead is None:
                leaders.append(norm)
    return out


def words(rng, n, alphabet="abcdé "):
    base = ["".join(rng.choice(alphabet) for _ in range(rng.choice([1, 2, 3, 4, 6, 9, 14, 30]))) for _ in range(n)]
    for w in base[: n // 2]:
        k = rng.randrange(len(w) + 1)
        base += [w[:k] + rng.choice(alphabet) + w[k:], w[:k] + w[k + 1:], w[::-1]]
    return [w for w in dict.fromkeys(base) if w]


@pytest.mark.parametrize("threshold", [0.6, 0.85])
def test_clusters_equal_the_greedy_order(spark, threshold):
    rng = random.Random(int(threshold * 100))
    rows = [(c, w, -rng.randint(1, 5), w.upper()) for c in ("x", "y") for w in words(rng, 70)]
    for sweeps in ((0, 1) if threshold == 0.85 else (1,)):
        got = {(r.columna, r.norm): r.lider for r in similar.leader_clusters(spark.createDataFrame(rows, SCHEMA), threshold, sweeps, few=0).collect()}
        assert got == greedy(rows, threshold)
    few = {(r.columna, r.norm): r.lider for r in similar.leader_clusters(spark.createDataFrame(rows, SCHEMA), threshold, few=10_000).collect()}
    assert few == got


@pytest.mark.parametrize("threshold", [0.55, 0.7, 0.85, 0.95])
def test_texts_that_reach_the_threshold_meet(threshold):
    """Every pair at the threshold has a key in common, whatever the order of the bigrams."""
    rng = random.Random(3)
    texts = words(rng, 60)
    bounds = similar.Bounds(threshold)

    def keys(text):
        return {(kind, k, s) for kind, k, size in bounds.prefixes(len(text)) for s in itertools.combinations(sorted(similar._members(text, kind), key=lambda m: (hash(m) % 7, m))[:size], k)}

    held = {t: keys(t) for t in texts}
    met = 0
    for a, b in itertools.combinations(texts, 2):
        if max(difflib.SequenceMatcher(None, a, b).ratio(), difflib.SequenceMatcher(None, b, a).ratio()) >= threshold:
            met += 1
            assert held[a] & held[b], (a, b)
    assert met > 3 and all(len(h) <= 2000 for h in held.values()) and math.isfinite(bounds.rate)


def test_typos_equal_all_pairs(spark):
    """5,000 values of one column: the neighbourhood index finds what comparing all pairs finds."""
    rng = random.Random(9)
    stems = ["".join(rng.choice("abcdefghilmnoprstu") for _ in range(rng.randint(4, 9))) for _ in range(1500)]
    names_ = []
    for s in stems:
        k = rng.randrange(1, len(s))
        names_ += [s, s[:k] + s[k + 1:], s[:k] + "x" + s[k:], s[:k - 1] + s[k:k + 1] + s[k - 1:k] + s[k + 1:], s[:k] + "é" + s[k + 1:]]
    names_ = list(dict.fromkeys(names_))[:5000]
    rows = [("c", w, w, rng.choice([1, 2, 40, 90]), i + 1, True) for i, w in enumerate(names_)]
    spellings = spark.createDataFrame(rows, "columna string, clave string, principal string, filas long, puesto int, typos boolean")
    taken = spark.createDataFrame([("c", names_[7])], "columna string, clave string")
    got = {r.clave: r.a3 for r in variants._rare_typos(spellings, taken).collect()}
    a, b = spellings.select(F.col("clave").alias("a"), F.col("filas").alias("fa"), F.col("puesto").alias("pa")), spellings.select(
        F.col("clave").alias("b"), F.col("filas").alias("fb"), F.col("puesto").alias("pb"), F.col("principal").alias("d"))
    pairs = a.join(b, (F.substring("a", 1, 1) == F.substring("b", 1, 1)) & (F.abs(F.length("a") - F.length("b")) <= 1))
    pairs = pairs.filter((F.col("pb") < F.col("pa")) & (F.col("fa") <= F.greatest(F.lit(3.0), 0.1 * F.col("fb"))) & one_edit_typo(F.col("a"), F.col("b")))
    want = {r.a: r.d for r in pairs.groupBy("a").agg(F.min_by("d", "pb").alias("d")).collect() if r.a != names_[7]}
    assert got == want and len(want) > 500


def test_many_values_in_suggestions(spark):
    rows = [(f"ciudad{chr(97 + i // 26)}{chr(97 + i % 26)}",) for i in range(200) for _ in range(40)] + [("ciudaaa",), ("ciudadzzz",)]
    got = {r.valor: r.unificar_a for r in variants.suggest_equivalences(Profile(spark.createDataFrame(rows, "lugar string")), max_values=1000).collect()}
    assert got["ciudaaa"] == "ciudadaa" and got["ciudadaa"] == ""
