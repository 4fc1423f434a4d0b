import random
import re
import subprocess
import sys
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

from sparkscrub.llm import divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "text string, lang string, source string, term string, n long, block int"


def brute(rows, least=3, top=200):
    groups, of_group, in_docs = set(), defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        found = Counter(t.translate(LOWER) for t in TERM.findall(text or ""))
        of_group[lang, source].update(found)
        in_docs[lang].update(found.keys())
    out = []
    for lang, source in groups:
        kept = [t for t, n in in_docs[lang].items() if n >= least]
        others = sorted(s for g, s in groups if g == lang)

        def shares(counts):
            whole = sum(counts[t] for t in kept) + len(kept)
            return {t: 1 + 10**9 * (counts[t] + 1) // whole for t in kept}

        own, all_counts = shares(of_group[lang, source]), Counter()
        for s in others:
            all_counts.update(of_group[lang, s])
        whole = shares(all_counts)
        pairs = [(sum((own[t] - q[t]) ** 2 // q[t] for t in kept), s) for s in others if s != source for q in [shares(of_group[lang, s])]]
        terms = [((own[t] - whole[t]) ** 2 // whole[t], t) for t in kept if of_group[lang, source][t] and own[t] > whole[t]]
        for part, items in (("pair", pairs), ("term", terms)):
            items.sort(key=lambda x: (-x[0], x[1].encode()))
            out += [(lang, source, part, t, v, r) for r, (v, t) in enumerate(items, 1) if part == "pair" or r <= top]
    return sorted(out)


def corpus(seed, n):
    rng = random.Random(seed)
    words = ["a", "B", "été", "Été", "x1y", "don't", "日本", "naïve", "Zz", "q", " ", "ſ", "\U0001f600"] + [f"w{chr(97 + i)}" for i in range(20)]
    texts = [None, "", " \t", "1234 --"] + [" ".join(rng.choices(words, k=rng.randint(1, 60))) for _ in range(n)]
    rows = [(t, rng.choice(["en", "de", "", None]), rng.choice(["s0", "s0", "s0", "s1", "S2", "é", "", None])) for t in texts]
    return rows + rows[:5] + [(None, "xx", "only"), ("1 2", "xx", "other")]


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, monkeypatch, seed):
    for name, value in {"ENTRIES": 40, "PIECE": 30, "CELLS": 25}.items():  # many chunks, pieces and blocks
        monkeypatch.setattr(divergence, name, value)
    rows = corpus(seed, 120)
    docs = spark.createDataFrame([(*r, "clash", 1, 2) for r in rows], SCHEMA).repartition(5)
    assert sorted(map(tuple, divergence.audit(docs, top=7).collect())) == brute(rows, top=7)
    assert divergence.audit(docs.limit(0)).collect() == []


FRESH = """
import sys
import pyarrow as pa
from sparkscrub.llm import divergence
block = pa.ipc.open_stream(sys.stdin.buffer).read_all()
print(sorted(tuple(row.values()) for row in divergence._block_sums(block).to_pylist()))
"""


def test_block_sums_in_a_fresh_worker():
    """Idle workers end after a minute, and a new one has not counted terms: the block comes as a stream, as making arrays here would load more of Arrow."""
    columns = {"lang": ["en"] * 4, "source": ["a", "b", "a", "b"], "term": [None, None, "x", "y"], "n": [2, 5, 2, 5], "v": [2, 2, 0, 0]}
    block, sink = pa.table(columns), pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, block.schema) as out:
        out.write_table(block)
    p, q = [1 + 10**9 * n // 4 for n in (3, 1)], [1 + 10**9 * n // 7 for n in (1, 6)]
    want = [("en", s, t, sum((x - y) ** 2 // y for x, y in zip(own, other))) for s, t, own, other in (("a", "b", p, q), ("b", "a", q, p))]
    run = subprocess.run([sys.executable, "-c", FRESH], cwd=Path(__file__).parents[2], input=sink.getvalue().to_pybytes(), capture_output=True, timeout=120)
    assert run.stdout.decode().strip() == str(want), run.stderr.decode()


def test_long_text_in_pieces(monkeypatch):
    text = " ".join(["Alpha", "be-ta", "é" * 50] * 400).encode()
    whole = divergence.terms(text)
    for size in (1, 7, 64):
        monkeypatch.setattr(divergence, "PIECE", size)
        assert divergence.terms(text) == whole
    assert whole == {b"alpha": 400, b"be": 400, b"ta": 400, "é".encode() * 50: 400}


def test_shares_beyond_64_bits():
    count, total = np.array([1, 2**40, 10**14]), np.array([3, 2**45 + 1, 10**14 + 7])
    assert divergence.share(count, total).tolist() == [1 + 10**9 * int(c) // int(t) for c, t in zip(count, total)]


def test_shares_as_column(spark):
    row = spark.range(1).selectExpr("cast(1e14 as long) as n", "cast(1e14 as long) + 7 as whole").select(divergence._share("n", "whole").alias("p")).first()
    assert row.p == 1 + 10**9 * 10**14 // (10**14 + 7)
