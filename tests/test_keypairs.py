"""Key suggestion: sampled pairs against all keys of all columns."""

import random

from sparkscrub.operators import keypairs


def _key(value):
    if value is None:
        return None
    s = str(value).strip().lower()
    s = s[:-2] if s.endswith(".0") else s
    return (s.lstrip("0") or "0" if s.isdigit() else s) or None


def _brute(a, b, wanted=30):
    """a, b: column name -> values."""
    keys = [{c: {_key(v) for v in values} - {None} for c, values in side.items()} for side in (a, b)]
    out = {}
    for ca, ka in keys[0].items():
        for cb, kb in keys[1].items():
            if min(len(ka), len(kb)) >= 2 and ka & kb:
                share = len(ka & kb) / min(len(ka), len(kb)) * 100
                if share >= wanted or ca == cb:
                    out[ca, cb] = share
    return out


def _frame(spark, columns):
    return spark.createDataFrame(list(zip(*columns.values())), ", ".join(f"`{c}` string" for c in columns)).repartition(4)


def test_pairs_equal_all_keys(spark):
    rng = random.Random(5)
    n = 3000

    def some(values, nulls=0.05):
        return [None if rng.random() < nulls else rng.choice(values) for _ in range(n)]

    wide, shifted = [str(i) for i in range(2500)], [str(i) for i in range(1200, 3700)]
    hot = ["7"] * n  # one key fills the column: fewer than two keys, no pair
    a = {"id": some(wide), "code": some([f"00{i}" for i in range(40)]), "x.y": some(["", "  ", "A", "b"]), "far": some([f"z{i}" for i in range(900)]), "hot": hot,
         "skewed": ["1"] * (n // 3) + some(wide)[n // 3:], "empty": [None] * n}
    b = {"ref": some(shifted), "code": some([f"{i}.0" for i in range(30, 90)]), "far": some([f"w{i}" for i in range(900)] + ["z5"]), "x.y": some(["a", "B ", "c"]),
         "low": some([f"z{i}" for i in range(850, 4000)]), "hot": hot}
    df_a, df_b = _frame(spark, a), _frame(spark, b)
    want = _brute(a, b)
    for sample in (300, 4096):  # sampled large columns, then all columns whole
        got = {(p[0], p[1]): round(p[3], 9) for p in keypairs.shared_keys(df_a, df_b, sample)}
        assert got == {p: round(share, 9) for p, share in want.items()}, sample


def test_same_name_is_found_however_few_keys_are_shared(spark):
    a = spark.range(20000).selectExpr("cast(id as string) as clave")
    b = spark.range(19990, 40000).selectExpr("cast(id as string) as clave")
    assert [(p[0], p[2], round(p[3], 3)) for p in keypairs.shared_keys(a, b)] == [("clave", True, 0.05)]


def test_tables_without_rows_or_columns(spark):
    empty = spark.createDataFrame([], "k string, n long")
    full = spark.range(10).selectExpr("cast(id as string) as k", "id as n")
    nested = spark.sql("SELECT array(1, 2) AS k")
    for a, b in ((empty, full), (full, empty), (empty, empty), (nested, full)):
        assert keypairs.suggest_keys(a, b).collect() == []
