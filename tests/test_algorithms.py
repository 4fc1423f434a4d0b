"""The distributed algorithms against brute force on small data, with their limits lowered so the large path runs."""

import difflib
import random

import pytest
from pyspark.sql import functions as F

from sparkscrub.operators import joins, stats
from sparkscrub.operators.rows import repeated_cells, repeated_rows
from sparkscrub.operators.variants import leader_clusters, spelling_variants
from sparkscrub.plans.profile import Profile
from sparkscrub.plans.quantiles import column_quantiles, group_median, running_total

rng = random.Random(7)


@pytest.fixture(scope="module")
def numbers(spark):
    rows = [(i % 3 if i % 3 < 2 else None, rng.choice([rng.gauss(0, 1) * 1e6, float(rng.randint(0, 5)), 1e12]), i) for i in range(3000)]
    return spark.createDataFrame(rows, "g int, v double, i long")


def test_quantiles_by_brackets_equal_percentile(numbers):
    probs = [0.0, 0.25, 0.5, 0.75, 0.99, 1.0]
    values = {"v": F.col("v"), "i": F.col("i").cast("double")}
    exact = column_quantiles(numbers, values, probs)
    bracketed = column_quantiles(numbers, values, probs, limit=10)
    for c in values:
        assert bracketed[c] == pytest.approx(exact[c], rel=1e-12)


def test_group_median_with_hot_groups(numbers):
    hot = {r["grupo"]: (r["mediana"], r["n"]) for r in group_median(numbers, "g", F.col("v"), limit=10).collect()}
    plain = {r["grupo"]: (r["mediana"], r["n"]) for r in group_median(numbers, "g", F.col("v")).collect()}
    assert hot.keys() == plain.keys() == {0, 1, None}
    for g in hot:
        assert hot[g][0] == pytest.approx(plain[g][0]) and hot[g][1] == plain[g][1]


def test_running_total_slices(numbers):
    small = {r["i"]: r["t"] for r in running_total(numbers.fillna(-1, ["g"]), ["g"], ["i"], "i", "t").collect()}
    sliced = {r["i"]: r["t"] for r in running_total(numbers.fillna(-1, ["g"]), ["g"], ["i"], "i", "t", limit=100).collect()}
    assert small == sliced and len(small) == 3000


def test_rank_correlations(spark):
    rows = [(float(rng.randint(0, 9)), rng.choice([None, float(rng.randint(0, 6)), rng.random()])) for _ in range(300)]
    df = spark.createDataFrame(rows, "x double, y double")
    both = [(x, y) for x, y in rows if y is not None]
    sign = lambda d: (d > 0) - (d < 0)
    c = sum(sign(a[0] - b[0]) * sign(a[1] - b[1]) for i, a in enumerate(both) for b in both[:i])
    n0 = len(both) * (len(both) - 1) / 2
    tx = sum(a[0] == b[0] for i, a in enumerate(both) for b in both[:i])
    ty = sum(a[1] == b[1] for i, a in enumerate(both) for b in both[:i])
    assert stats.kendall(df, F.col("x"), F.col("y")) == pytest.approx(c / ((n0 - tx) * (n0 - ty)) ** 0.5)
    import pandas as pd

    p = pd.DataFrame(both, columns=["x", "y"]).rank()
    assert stats.spearman(df, F.col("x"), F.col("y")) == pytest.approx(p["x"].corr(p["y"]))


def test_all_rank_correlations_in_one_pass(spark, monkeypatch):
    """Columns with ties, with gaps in different rows, without data, constant, and all values different; hot values; sliced running totals."""
    import pandas as pd

    draw = random.Random(11)
    columns = {"hot": lambda: 0.0 if draw.random() < 0.4 else draw.random(), "ties": lambda: float(draw.randint(0, 4)), "other": draw.random,
               "gap": lambda: draw.choice([None, draw.random()]), "gap2": lambda: draw.choice([None, -1.5, float(draw.randint(0, 9))]),
               "flat": lambda: 3.0, "none": lambda: None, "zero": lambda: draw.choice([0.0, -0.0, 1.0])}
    rows = [tuple(make() for make in columns.values()) for _ in range(400)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in columns))
    frame = pd.DataFrame(rows, columns=list(columns), dtype=float)
    monkeypatch.setattr(stats, "running_total", lambda *a: running_total(*a, limit=50))
    got = stats.rank_correlations(df, {c: F.col(c) for c in columns})
    assert len(got) == 28
    for a, b, r in got:
        want = frame[[a, b]].dropna().rank()
        want = want[a].corr(want[b]) if len(want) >= 3 else float("nan")
        assert r is None if want != want else r == pytest.approx(want), (a, b)
    plain = {(r.columna_a, r.columna_b): r.correlacion for r in stats.correlation(df, {c: F.col(c) for c in columns}).collect()}
    for (a, b), r in plain.items():
        want = frame[[a, b]].dropna()
        want = want[a].corr(want[b]) if len(want) >= 3 and want[a].nunique() > 1 and want[b].nunique() > 1 else None
        assert r is None if want is None else r == pytest.approx(want, abs=1e-4), (a, b)
    assert stats.rank_correlations(df.limit(0), {"hot": F.col("hot"), "gap": F.col("gap")}) == [("hot", "gap", None)]


def test_leader_clusters_in_several_rounds(spark):
    words = list(dict.fromkeys("".join(rng.choice("abcde") for _ in range(rng.randint(4, 9))) for _ in range(150)))
    words += [w[:-1] + "z" for w in words[:40]]
    words = list(dict.fromkeys(words))
    order = sorted(words, key=lambda w: (-len(w) % 3, w))
    leaders, expected = [], {}
    for w in order:
        lead = next((x for x in leaders if difflib.SequenceMatcher(None, x, w).ratio() >= 0.75), None)
        expected[w] = lead or w
        if lead is None:
            leaders.append(w)
    rows = [("c", w, -len(w) % 3, w) for w in words]
    df = spark.createDataFrame(rows, "columna string, norm string, menos long, texto string")
    got = {r["norm"]: r["lider"] for r in leader_clusters(df, 0.75, few=0).collect()}
    assert got == expected


def test_spelling_variants(spark):
    rows = [("San José",)] * 5 + [("san jose ",)] * 2 + [("SanJosé",), ("Heredia",), ("Heredia",), ("Hredia",), ("Cartago",)]
    got = {r["texto"]: r["destino"] for r in spelling_variants(spark.createDataFrame(rows, "c string"), ["c"]).collect()}
    assert got == {"san jose ": "San José", "SanJosé": "San José", "Hredia": "Heredia"}


def test_repeats_with_a_hot_key(spark):
    df = spark.createDataFrame([(i, "x" if i % 3 == 0 else str(i), None if i % 5 else "y") for i in range(60)], "_row_id long, a string, b string")
    seen, expected = set(), set()
    for r in df.orderBy("_row_id").collect():
        key = (r["a"], r["b"])
        expected |= {r["_row_id"]} if key in seen else set()
        seen.add(key)
    assert {r[0] for r in repeated_rows(df, ["a", "b"], "_row_id").collect()} == expected
    cells = {(r["columna"], r["_row_id"]) for r in repeated_cells(df, ["a", "b"], "_row_id").collect()}
    assert cells == {("a", i) for i in range(3, 60, 3)} | {("b", i) for i in range(5, 60, 5)}


def test_joins_keep_null_keys_and_drop_b_nulls(spark):
    a = spark.createDataFrame([("1", 1), (" 1 ", 2), (None, 3), ("9", 4)], "k string, x int")
    b = spark.createDataFrame([("1", "p"), ("2", "q"), (None, "r"), ("", "s")], "k string, y string")
    count = lambda how: {r["_merge"]: r["filas"] for r in joins.merge(a, b, ["k"], ["k"], how).indicator_counts().collect()}
    assert count("left") == {"both": 2, "left_only": 2}
    assert count("outer") == {"both": 2, "left_only": 2, "right_only": 1}
    assert count("right") == {"both": 2, "right_only": 1} and count("inner") == {"both": 2}
    right = joins.merge(a, b, ["k"], ["k"], "right").result().filter("x is null").first()
    assert (right["k"], right["y"]) == ("2", "q")
    audit = joins.merge(a, b, ["k"], ["k"], "left").audit()
    assert (audit["filas_a"], audit["filas_b"], audit["descartadas_b"], audit["pct_filas_con_pareja"]) == (4, 4, 2, 50.0)
    with pytest.raises(ValueError):
        joins.merge(a, b.unionAll(b), ["k"], ["k"], validate="many_to_one")


def test_codes_lose_their_zeros(spark):
    a = spark.createDataFrame([("01067",), ("10115",), ("20095",)], "cp string")
    b = spark.createDataFrame([(1067,), (10115,), (20095,), (80331,)], "cp int")
    assert joins.code_width(a, ["cp"], b, ["cp"]) == 5
    done, diagnosis = joins.run_merge(a, b, ["cp"], ["cp"])
    assert diagnosis["pct_filas_con_pareja"] == 100.0 and done.result().count() == 3


def test_heavy_tail_and_serials(spark):
    rows = [(float(i ** 9), 10_000_000 + i, 5) for i in range(1, 200)]
    p = Profile(spark.createDataFrame(rows, "poblacion double, engranaje long, nivel int"))
    assert p.heavy_tailed(["poblacion", "nivel"]) == ["poblacion"] and p.serial_by_content == ["engranaje"]


def test_relations_equal_trying_every_form(spark):
    """Candidates from a sample, counted exactly, against all forms on all rows; noise, gaps and seldom filled columns among them."""
    import numpy as np

    rng_ = np.random.default_rng(3)
    n, rows = 14, 3000
    v = np.round(rng_.uniform(1, 500, (rows, n)), 2)
    v[:, 3] = np.round(v[:, 0] * v[:, 1], 2)
    v[:, 5] = v[:, 3] - v[:, 2]
    v[:, 7] = v[:, 5] / v[:, 3]
    v[rng_.random(rows) < 0.09, 3] += 700  # holds in 91 %
    v[:, 9] = v[:, 8] - v[:, 6]
    v[rng_.random(rows) < 0.5, 9] = np.nan
    v[:, 11] = np.where(np.arange(rows) % 150 == 0, v[:, 10] + v[:, 0], np.nan)  # 20 rows
    df = spark.createDataFrame([tuple(None if np.isnan(x) else float(x) for x in r) for r in v], ", ".join(f"x{i} double" for i in range(n)))
    got = {(r["columna"], r["op"], r["a"], r["b"]): r["acierto"] for r in stats.relation_rates(df, {f"x{i}": F.col(f"x{i}") for i in range(n)})}
    want = {}
    with np.errstate(all="ignore"):
        for t in range(n):
            for b in range(n):
                for c in range(n):
                    for op in stats.OPERATIONS:
                        if len({t, b, c}) == 3 and (op != "producto" or b < c):
                            known, close = stats._near(v[:, t], stats._operate(op, v[:, b], v[:, c]))
                            if known.sum() >= 8 and close.sum() >= 0.9 * known.sum():
                                want[f"x{t}", op, f"x{b}", f"x{c}"] = close.sum() / known.sum()
    assert got == pytest.approx(want) and ("x3", "producto", "x0", "x1") in got and ("x0", "resta", "x11", "x10") in got


def test_choice_of_relations(spark):
    """From the statement of the rule: differences before products before quotients, then names, then the column furthest to the right."""
    facts = [("costo", 0, 5.0, 9.0, 0, 0, 0), ("precio_unitario", 1, 3.0, 9.0, 0, 0, 1), ("cantidad", 2, 4.0, 9.0, 0, 0, 0), ("total", 3, 12.0, 99.0, 0, 1, 0), ("ganancia", 4, 7.0, 90.0, 1, 0, 0)]
    table = spark.createDataFrame(facts, "nombre string, posicion int, media double, mayor double, palabras_resta int, palabras_total int, palabras_unidad int")
    forms = [("total", "producto", "precio_unitario", "cantidad", 1.0), ("precio_unitario", "cociente", "total", "cantidad", 1.0), ("cantidad", "cociente", "total", "precio_unitario", 1.0),
             ("ganancia", "resta", "total", "costo", 0.95), ("costo", "resta", "total", "ganancia", 0.95)]
    relations = spark.createDataFrame([(i, *f) for i, f in enumerate(forms)], "lugar int, " + stats.RELATION)
    got = {r.columna: (r.op, r.a, r.b) for r in stats.choose_relations(relations, table).collect()}
    assert got == {"total": ("producto", "precio_unitario", "cantidad"), "precio_unitario": ("cociente", "total", "cantidad"), "ganancia": ("resta", "total", "costo")}


def test_fill_values_round_as_one(spark):
    from sparkscrub.operators import steps

    values = [0.125, 2.675, 3542.285, -0.125, 1e-9, None, 7.0]
    df = spark.createDataFrame([(v,) for v in values], "m double")
    assert [r.m for r in steps.rounded(df, "m", 2).collect()] == [None if v is None else round(v, 2) for v in values]
