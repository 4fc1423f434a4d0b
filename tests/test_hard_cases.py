"""Cases that once gave wrong rows: literal inputs with literal answers."""

import pytest
from pyspark.sql import functions as F

from sparkscrub.functions import keys, numbers
from sparkscrub.operators import actions, detect, joins, stats
from sparkscrub.operators import steps as S
from sparkscrub.operators.variants import suggest_equivalences
from sparkscrub.plans import recipe
from sparkscrub.plans.profile import Profile
from sparkscrub.plans.quantiles import column_quantiles
from sparkscrub.session import fresh_path
from sparkscrub.sources import delimited, sql


def put(spark, folder, name, data: bytes):
    path = f"{folder}/{name}"
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target)
    out.write(data)
    out.close()
    return path


def test_quantiles_with_infinities(spark):
    df = spark.range(400_000).select(F.when(F.col("id") == 7, float("inf")).when(F.col("id") == 8, float("nan")).when(F.col("id") == 9, float("-inf"))
                                     .otherwise(F.col("id") % 1000).alias("v"))
    for limit in (100_000, 1_000_000):
        assert column_quantiles(df, {"v": F.col("v")}, [0.0, 0.25, 0.5, 1.0], limit=limit)["v"] == pytest.approx([0.0, 249.75, 500.0, 999.0], abs=0.76)
    a, b = (column_quantiles(df, {"v": F.col("v")}, [0.1, 0.5, 0.9], limit=x)["v"] for x in (100_000, 1_000_000))
    assert a == b


def test_group_medians_do_not_depend_on_the_number_of_groups(spark):
    for groups in (3, 2500):
        rows = spark.range(groups * 3).select((F.col("id") % groups).alias("g"), (F.lit(10) + F.floor(F.col("id") / groups) * 5).cast("long").alias("v"))
        rows = rows.union(spark.createDataFrame([(0, None)], "g long, v long"))
        steps = recipe.from_json(recipe.to_json([S.fit_rule(rows, "v", "mediana_por_grupo", group="g")]))
        batch = spark.createDataFrame([(0, None), (1, 7), (99999, None), (0, 150)], "g long, v long")
        out = recipe.apply(batch, steps)
        assert out.schema["v"].dataType.simpleString() == "bigint"
        assert sorted((r.g, r.v) for r in out.collect()) == [(0, 15), (0, 150), (1, 7), (99999, 15)]


def test_keys_of_large_doubles(spark):
    row = spark.range(1).select(*[numbers.number_text(F.lit(x)).alias(f"c{i}") for i, x in enumerate((1e15, 1234567890123456.0, 1.5e-13, 0.1, -2.50))]).first()
    assert tuple(row) == ("1000000000000000", "1234567890123456", "1.5E-13", "0.1", "-2.5")
    code = spark.range(1).select(keys.normalize_key(numbers.number_text(F.lit(1e15)), "codigo")).first()[0]
    assert code == "1000000000000000"
    a = spark.createDataFrame([(1234567890123456, "x")], "k long, va string")
    b = spark.createDataFrame([(1234567890123456.0, "y")], "k double, vb string")
    assert joins.merge(a, b, ["k"], ["k"]).df.filter("_merge = 'both'").count() == 1


def test_collapse_and_duplicates_keep_whole_rows(spark):
    a = spark.createDataFrame([("1",)], "k string")
    b = spark.createDataFrame([("1", "Zoe", "aaa"), ("1", "Ana", "zzz")], "k string, n string, m string")
    got = joins.run_merge(a, b, ["k"], ["k"])[0].result().first()
    assert (got["n"], got["m"]) == ("Ana", "zzz")
    d = spark.createDataFrame([("k", 1, "z"), ("k", 2, "a")], "k string, x int, y string")
    assert [tuple(r) for r in S.apply_step(d, {"tipo": "duplicados", "ignorar": ["x", "y"]}).collect()] == [("k", 1, "z")]


def test_keys_of_different_kinds_do_not_stop(spark):
    a, b = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([("1",), ("odd",)], "k string")
    assert joins.diagnose(a, b, ["k"], ["k"], "sin_cambios")["llaves_de_a_en_b"] == 1


def test_decimal_comma_in_filters_and_derived_columns(spark):
    df = spark.createDataFrame([("7,650",), ("1,5",), ("0,25",), ("12,75",)], "tasa string")
    step = S.fit_filters(df, ["tasa>100"])
    assert S.apply_step(df, step).count() == 0
    made = S.apply_step(df, S.fit_derived(df, ["doble = [tasa] * 2"]))
    assert sorted(r.doble for r in made.collect()) == [0.5, 3.0, 15.3, 25.5]


def test_two_statistics_on_one_column(spark):
    rows = [(i, v) for i, v in enumerate(["1", "2", "2", "3", None, "x", "2", "4", "5", "2"])]
    df = spark.createDataFrame(rows, "_row_id long, monto string")
    done = actions.clean(detect.analyze(df), {"faltante": "reemplazar_media", "tipo_invalido": "reemplazar_moda"}).df
    assert {r["monto"] for r in done.collect()} >= {"2", "2.625"} or {float(r["monto"]) for r in done.collect()} >= {2.0, 2.625}


def test_the_last_correction_of_a_cell_counts(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(["1", "2", "2", None])], "_row_id long, monto string")
    fixes = spark.createDataFrame([("faltante", "monto", 3, "7", 1), ("faltante", "monto", 3, "4", 2)], "tipo string, columna string, fila long, valor string, orden int")
    done = actions.clean(detect.analyze(df), {"faltante": "editar_individualmente"}, corrections=fixes).df
    assert str([r["monto"] for r in done.collect() if r["_row_id"] == 3][0]).startswith("4")


def test_same_file_name_in_folders_named_alike(spark):
    folder = fresh_path(spark, "named")
    for year in ("y1", "y2"):
        spark.range(3).write.parquet(f"{folder}/{year}/data/x.parquet")
    spark.range(2).write.parquet(f"{folder}/y1/data/y.parquet")
    tables = sql.read_tables(spark, [f"{folder}/{y}/data/x.parquet" for y in ("y1", "y2")] + [f"{folder}/y1/data/y.parquet"])
    assert sorted(tables) == ["y", "y1/data__x", "y2/data__x"]


def test_rows_like_the_header_and_late_accents(spark):
    folder = fresh_path(spark, "text")
    path = put(spark, folder, "a.csv", b"a,b\n1,2\na,b\n3,4\n")
    assert [tuple(r) for r in delimited.read_text_table(spark, path).collect()] == [("1", "2"), ("a", "b"), ("3", "4")]
    late = b"n,t\n" + b"1,plain text here\n" * 6000 + "2,café €\n".encode("cp1252")
    path = put(spark, folder, "b.csv", late)
    assert delimited.read_text_table(spark, path).filter("n = '2'").first()["t"] == "café €"
    path = put(spark, folder, "c.csv", 'n,t\n1,"x, y\nz, w"\n2,é,more\n'.encode())
    assert [tuple(r) for r in delimited.read_text_table(spark, path).collect()] == [("1", "x, y\nz, w", None), ("2", "é", "more")]


def test_relations_of_many_columns_and_equal_operands(spark):
    base = spark.range(400)
    wide = base.select(*[((F.col("id") * (i + 3) * 37) % (101 + i)).cast("double").alias(f"x{i}") for i in range(29)])
    wide = wide.withColumn("total", F.col("x27") * F.col("x28"))
    found = {(r.columna, r.op) for r in stats.computed_columns(wide).collect()}
    assert ("total", "producto") in found
    same = base.select((F.col("id") % 7 * 0.001).alias("a"), (F.col("id") % 90 + 10.0).alias("b"), (F.col("id") % 90 + 10.0).alias("c"))
    assert not [r for r in stats.relation_rates(same, {c: F.col(c) for c in same.columns}) if r["op"] == "resta" and r["columna"] == "a"]


def test_equivalence_rules(spark):
    rows = ["M"] * 9 + ["male"] * 4 + ["F"] * 6 + ["unknown"]
    table = spark.createDataFrame([(x, y) for x, y in zip(rows, ["Heredia"] * 12 + ["HEREDIA"] * 3 + ["Hredia", "Alajuela", "Alajuela", "Alajuelita", "Alajuelita"])], "sexo string, lugar string")
    got = {(r.columna, r.valor): r.unificar_a for r in suggest_equivalences(Profile(table)).collect()}
    assert got["sexo", "male"] == "M" and got["sexo", "M"] == "" and got["sexo", "unknown"] == "No indica"
    assert got["lugar", "HEREDIA"] == "Heredia" and got["lugar", "Hredia"] == "Heredia" and got["lugar", "Alajuelita"] == ""
