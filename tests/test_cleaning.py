"""The sample of sixteen rows, cleaning properties, recipes and sources, end to end."""

import pytest
from pyspark.sql import functions as F

from sparkscrub.operators import actions, detect, steps
from sparkscrub.operators.dictionary import Dictionary
from sparkscrub.plans import recipe as R
from sparkscrub.plans.profile import Profile
from sparkscrub.session import fresh_path
from sparkscrub.sources import delimited, sql
from sparkscrub.streaming.replay import replay_files, streamable

SAMPLE = [(1, "Ana", 25.0, "600500", "Ventas"), (2, "Luis", 30.0, "650000", "IT"), (3, "Sara", None, "700000", "IT"), (4, "Juan", 45.0, "abc", "Ventas"),
          (5, "Eva", 28.0, "620000", "RRHH"), (6, "Leo", 150.0, "610000", "IT"), (7, "Mia", 33.0, "640000", "Ventas"), (8, "Ian", 29.0, "999999999", "RRHH"),
          (9, "Zoe", 41.0, "-800000", "IT"), (10, "Max", 38.0, "600000", "Ventas"), (10, "Max", 38.0, "600000", "Ventas"), (12, "Ada", None, "630000", "RRHH"),
          (13, "Teo", 36.0, "615000", "IT"), (14, "Noa", 27.0, "605000", "IT"), (15, "Gil", 31.0, "625000", "Ventas"), (16, "Pia", 35.0, "645000", "RRHH")]


@pytest.fixture(scope="module")
def sample(spark):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(SAMPLE)], "_row_id long, id long, nombre string, edad double, salario string, departamento string")
    return df.persist()


@pytest.fixture(scope="module")
def analysis(sample):
    return detect.analyze(sample)


def test_sample_findings(analysis):
    by_type = {r["tipo"]: r["hallazgos"] for r in analysis.by_type().collect()}
    assert by_type == {"faltante": 2, "duplicado": 1, "id_duplicado": 1, "tipo_invalido": 1, "atipico": 3}
    assert sum(by_type.values()) == sum(r["hallazgos"] for r in analysis.by_column().collect())
    odd = {(r["columna"], r["valor_original"]) for r in analysis.findings().filter("tipo = 'atipico'").collect()}
    assert odd == {("edad", "150"), ("salario", "999999999"), ("salario", "-800000")}


def test_sample_cleaning(analysis, sample):
    done = actions.clean(analysis, {"tipo_invalido": "reemplazar_mediana"})
    out = {r["_row_id"]: r for r in done.df.collect()}
    log = done.log.collect()
    assert len(out) == len(SAMPLE) - sum(r["accion_aplicada"] == "eliminar_fila" for r in log)
    assert out[2]["edad"] == 34.0 and out[3]["salario"] == "620000" and out[5]["edad"] == 51.0 and float(out[7]["salario"]) < 999999999
    assert out[0]["_revisar_calidad"] == "" and float(out[8]["salario"]) > 0
    again = detect.analyze(done.df.drop("_revisar_calidad"), only={"faltante", "duplicado", "tipo_invalido"})
    assert again.findings().count() == 0


def test_last_action_wins_and_types(spark):
    df = spark.createDataFrame([(0, " ana ", 1, "a"), (1, "Eva", None, "b"), (2, "Leo", 3, "a")], "_row_id long, nombre string, n int, c string")
    a = detect.analyze(df, only={"espacio_extra", "capitalizacion_incorrecta", "faltante"})
    out = actions.clean(a, {"capitalizacion_incorrecta": "usar_sugerido"}).df
    assert [r["nombre"] for r in out.orderBy("_row_id").collect()] == ["Ana", "Eva", "Leo"] and out.schema["n"].dataType.simpleString() == "int"
    text = actions.clean(a, {"faltante": "valor_fijo"}, fixed={"n": "ninguno"}).df
    assert [r["n"] for r in text.orderBy("_row_id").collect()] == ["1", "ninguno", "3"]


def test_limits_never_clip_coordinates(spark):
    df = spark.createDataFrame([(i, 9.0 + i / 100, float(i % 7)) for i in range(40)] + [(40, 9953281.0, 900.0)], "_row_id long, latitud double, quejas double")
    a = detect.analyze(df, only={"atipico"})
    last = actions.clean(a).df.filter("_row_id = 40").first()
    assert last["latitud"] == 9953281.0 and last["quejas"] == 5.0 and "latitud" in last["_revisar_calidad"]


def test_null_rules(spark):
    df = spark.createDataFrame([("a", "1,5"), ("a", "2,5"), ("b", "10,25"), ("b", None), (None, "n/a")], "g string, v string")
    step = steps.fit_rule(df, "v", "mediana_por_grupo", group="g")
    got = [r["v"] for r in steps.apply_step(df, step).collect()]
    assert got == [1.5, 2.5, 10.25, 10.25, 2.5]
    with pytest.raises(ValueError):
        steps.fit_rule(spark.createDataFrame([("x",), (None,)], "v string"), "v", "mediana")
    years = steps.apply_step(spark.createDataFrame([(2008.0,), (None,)], "anio double"), steps.fit_rule(
        spark.createDataFrame([(2008.0,), (None,)], "anio double"), "anio", "no_indica"))
    assert [r[0] for r in years.collect()] == ["2008", "No indica"]
    assert steps.suggest_rule("numerica", 70.0, "monto") == "dejar" and steps.suggest_rule("id", 2.0) == "eliminar_fila"
    assert steps.combine_limits({"a": (0, None)}, {"a": (1, 9), "b": (None, 2)}) == {"a": (1, 9), "b": (None, 2)}


def test_recipe_on_batch_and_stream(spark):
    df = spark.createDataFrame([("  Ana ", "sí", "1.234,50", "31/01/2025"), ("EVA", "no", "", "2025-02-01"), ("Leo", "si", "7,25", "n/a"), ("Mia", "Si", "10,00", "15/03/2025")] * 5,
                               "Nombre string, Activo string, Monto string, Fecha string")
    recipe = R.fit(df, R.configure(df), date_parts=["*"], typed_dates=True)
    assert streamable(recipe) and R.from_json(R.to_json(recipe)) == recipe
    batch = R.apply(df, recipe)
    assert batch.columns == ["nombre", "activo", "monto", "fecha", "fecha_mes", "fecha_anio"]
    first = batch.filter("nombre = 'Ana'").first()
    assert (first["activo"], first["monto"], first["fecha_mes"], first["fecha_anio"]) == ("Sí", 1234.5, 1, 2025)
    source, target, control = (fresh_path(spark, x) for x in ("in", "out", "ck"))
    df.repartition(3).write.parquet(source)
    replay_files(spark, source, df.schema, recipe, target, control).awaitTermination()
    assert sorted(map(str, spark.read.parquet(target).collect())) == sorted(map(str, batch.collect()))


def test_delimited_round_trip(spark, tmp_path):
    path = tmp_path / "datos.csv"
    path.write_bytes("sep=;\nnombre;cp;monto;nota\nJosé;01067;1,5;\"a;b\"\nAna;10115;2;x;sobra\n\nEva;20095\n".encode("cp1252"))
    df = delimited.read_delimited(spark, str(path))
    got = [tuple(r) for r in df.collect()]
    assert df.columns == ["nombre", "cp", "monto", "nota", "columna_extra_5"]
    assert sorted(got) == sorted([("José", "01067", "1,5", "a;b", None), ("Ana", "10115", "2", "x", "sobra"), ("Eva", "20095", None, None, None)])
    utf16 = tmp_path / "u.txt"
    utf16.write_bytes("a\tb\n1\tñ\n".encode("utf-16"))
    assert [tuple(r) for r in delimited.read_delimited(spark, str(utf16)).collect()] == [(1, "ñ")]
    empty = tmp_path / "vacio.csv"
    empty.write_text("\n")
    with pytest.raises(ValueError):
        delimited.read_delimited(spark, str(empty))


def test_sql_options():
    options = sql.jdbc_options("jdbc:postgresql://h/db", table="t", partition={"column": "id", "lower": 1, "upper": 9, "parts": 4})
    assert options["partitionColumn"] == "id" and options["numPartitions"] == "4" and options["dbtable"] == "t"
    assert sql.jdbc_options("jdbc:x", query="select 1")["query"] == "select 1"
    with pytest.raises(ValueError):
        sql.jdbc_options("jdbc:x")


def test_dictionary_of_sample(sample):
    d = Dictionary(sample, ["id", "nombre", "edad", "salario", "departamento"])
    assert d.types == {"id": "Entero", "nombre": "Texto", "edad": "Entero", "salario": "Texto", "departamento": "Categoría"}
    assert d.value_summary("departamento") == "IT, Ventas, RRHH"
    rows = {r["campo"]: r for r in d.table().collect()}
    assert rows["edad"]["nulos"] == "Sí (2)" and rows["edad"]["completitud_pct"] == 87.5


def test_profile_of_nested_and_nan(spark):
    df = spark.createDataFrame([(1.0, [1]), (float("nan"), [2]), (None, None)], "v double, a array<int>")
    p = Profile(df)
    assert p.columns == ["v"] and p.text["v"]["nulls"] == 2
    assert detect.findings(df.withColumn("_row_id", F.lit(1)), detect.missing(p)).count() == 2


@pytest.mark.parametrize("proof, want", [("25/06/1995", "1995-06-05"), ("06/25/1995", "1995-05-06"), ("2024-01-31", "1995-05-06")])
def test_normalised_dates_follow_the_order_the_column_proves(spark, proof, want):
    """'05/06/1995' is read as the other dates with its separator show; month first when they show nothing or both orders."""
    texts = ["05/06/1995", proof, "2024-13-01", "99/05/2024", "", "03-04-2020"]
    df = spark.createDataFrame(list(enumerate(texts)), "_row_id long, fecha string")
    done = actions.clean(detect.analyze(df, only={"fecha_invalida"}, date_columns=["fecha"]), {"fecha_invalida": "normalizar_formato_fecha"})
    out = [r["fecha"] for r in done.df.orderBy("_row_id").collect()]
    assert out == [want, "2024-01-31" if proof.startswith("2024") else "1995-06-25", "2024-13-01", "99/05/2024", "", "2020-03-04"]
    both = df.union(spark.createDataFrame([(6, "25/06/1995"), (7, "06/25/1995")], df.schema))
    done = actions.clean(detect.analyze(both, only={"fecha_invalida"}, date_columns=["fecha"]), {"fecha_invalida": "normalizar_formato_fecha"})
    assert done.df.filter("_row_id = 0").first()["fecha"] == "1995-05-06"
