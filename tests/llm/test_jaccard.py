import random

import numpy as np
import pytest

from sparkscrub.llm import common, jaccard, stages
from tests.llm.brute import jaccard_classes

SCHEMA = "doc_id long, text string, source string, n int, f1 string"


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 4)))
    passage = [word() for _ in range(60)]
    rows = []
    for family in range(12):
        base = [word() for _ in range(rng.choice([1, 2, 3, 30, 90, 300]))] + (passage if family % 3 == 0 else [])
        for _ in range(rng.choice([1, 4, 25])):
            own = list(base)
            for _ in range(rng.randint(0, 1 + len(own) // 60)):
                own[rng.randrange(len(own))] = word()
            text = rng.choice([" ", "\n", "\t "]).join(own)
            rows.append(text.upper() if rng.random() < 0.2 else text)
    rows += ["", None, "   \n", "x", "x", "x y", "X  y", "long " * 5000, "long " * 5001 + "end"]
    return [(i * 3 + 1, t, None if i % 5 else "s", 1, "clash") for i, t in enumerate(rows)]


@pytest.mark.parametrize("share,width", [(90, 3), (80, 5)])
def test_classes_match_brute_force(spark, share, width):
    rows = corpus(share)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.linked_sets(spark.createDataFrame(rows, SCHEMA), share, width).collect()}
    want = jaccard_classes([r[:2] for r in rows], share, width)
    assert got == want
    assert len({c for _, c in want.values()}) < len(want)


def test_blocks_of_one_neighbourhood(spark, monkeypatch):
    """Small blocks make every comparison cross blocks."""
    monkeypatch.setattr(jaccard, "SKETCH_BLOCK", (5, 600))
    monkeypatch.setattr(jaccard, "SET_BLOCK", (4, 500))
    monkeypatch.setattr(jaccard, "SMALL", 2)
    rows = corpus(7)
    got = {r.doc_id: r.component_id for r in jaccard.linked_sets(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {i: c for i, (_, c) in jaccard_classes([r[:2] for r in rows], 90, 3).items()}


def test_empty_table_repeats_and_nulls(spark):
    assert jaccard.linked_sets(spark.createDataFrame([], SCHEMA)).collect() == []
    rows = [(4, "a b c d"), (4, "a b c d"), (9, "A B C D"), (None, "a b c d"), (None, "other words here"), (5, "z")]
    got = sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0) for r in jaccard.linked_sets(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(0, 1, 0), (0, 2, 4), (4, 2, 4), (4, 2, 4), (5, 1, 5), (9, 2, 4)]
    kept = stages.keep_distinct(spark.createDataFrame(rows, "doc_id long, text string"), 90, 3)
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 0, 4, 5]


def test_sketches_never_rule_out_a_link():
    rng = np.random.default_rng(1)
    for n in (3, 40, 700):
        base = np.unique(rng.integers(0, 1 << 62, n).astype(np.uint64))
        for k in range(0, n // 8 + 1, max(1, n // 40)):
            other = np.unique(np.r_[base[k:], rng.integers(0, 1 << 62, k // 2).astype(np.uint64)])
            common = len(np.intersect1d(base, other))
            linked = 100 * common >= 90 * (len(base) + len(other) - common)
            found = jaccard.sketch_block(np.array([len(base), len(other)]), [jaccard.sketch(base), jaccard.sketch(other)], np.array([True, True]), 90)
            assert found or not linked


def test_skipping_by_position_and_by_answers():
    """Sets of many sizes: stretches of lists that sizes rule out are not read, near copies read only what differs, and no link is lost."""
    rng = np.random.default_rng(5)
    pool = rng.integers(0, 1 << 62, 4000).astype(np.uint64)
    sets = []
    for n in range(20, 400, 20):
        base = rng.choice(pool, n, replace=False)
        for k in range(4):
            sets.append(np.unique(np.r_[base[k:], rng.choice(pool, k)]))
    sets = [sets[i] for i in rng.permutation(len(sets))]
    for left in (np.ones(len(sets), bool), np.arange(len(sets)) % 2 == 0):
        counts: dict = {}
        found = jaccard.join_block(sets, left, 80, counts)
        ours, want = jaccard.Forest(len(sets)), jaccard.Forest(len(sets))
        for a, b in found:
            ours.join(a, b)
        pairs = 0
        for a in range(len(sets)):
            for b in range(a):
                common = len(np.intersect1d(sets[a], sets[b]))
                if (left.all() or left[a] != left[b]) and 100 * common >= 80 * (len(sets[a]) + len(sets[b]) - common):
                    want.join(a, b)
                    pairs += 1
        assert pairs and [ours.find(i) for i in range(len(sets))] == [want.find(i) for i in range(len(sets))]
        assert counts["skipped"] > counts["read"] > 0 and counts["spared"] > 0


def test_long_texts_are_hashed_in_slices():
    text = ("Word " * 50 + "x" * 700 + "\n\t" + "é" * 90 + " End ").encode() * 3
    data = np.frombuffer(text, np.uint8)
    bounds = np.array([0, len(data)])
    plain = common.hashed_words(data, bounds, 1 << 20)
    for limit in (1, 7, 64, 500):
        sliced = common.hashed_words(data, bounds, limit)
        assert (sliced[0] == plain[0]).all() and (sliced[1] == plain[1]).all()


def test_stage_keeps_columns_and_one_row_of_an_id(spark):
    rows = [(1, "b c d e f g", 5), (1, "a c d e f g", 6), (2, "x y", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `odd ``na.me` int")
    for parts in (1, 4):
        kept = stages.keep_distinct(docs.repartition(parts))
        assert kept.columns == docs.columns and sorted(map(tuple, kept.collect())) == [(1, "a c d e f g", 6), (2, "x y", 7)]
