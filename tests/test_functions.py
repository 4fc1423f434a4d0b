"""Literal cases of names and scalar functions."""

import datetime

import pytest
from pyspark.sql import functions as F

from sparkscrub.functions import dates, keys, names, numbers, rules, text
from sparkscrub.operators import steps


def values(spark, inputs, build):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], "i int, s string")
    return [r[0] for r in df.select(build(F.col("s")).alias("v"), "i").orderBy("i").select("v").collect()]


def test_names():
    assert names.normalize_name("Teléfono_Cliente") == "telefono_cliente"
    assert names.normalize_name("FechaVenta") == "fecha_venta"
    assert not names.matches("Updated", ["date"]) and names.matches("telefono1", ["telefono"])
    assert names.is_id("ID_Cliente") and names.is_id("codigoPostal") and not names.is_id("video")
    assert names.is_key_like("nro_guia") and names.is_key_like("placa") and not names.is_key_like("total")
    assert names.coordinate_range("lat_cliente") == (-90.0, 90.0) and names.coordinate_kind("plato") is None
    assert names.plausible_range("edad_cliente") == (0, 120) and names.is_non_negative("cantidad")
    assert names.phone_digit_range(["CR", "México"]) == (8, 10) and names.phone_digit_range(["marte"]) == (7, 15)
    assert names.snake_names(["Fecha Venta", "fecha  venta", "¿Qué?"]) == ["fecha_venta", "fecha_venta_2", "qué"]
    assert names.deduplicate_names(["a", "a", "a.1"]) == ["a", "a.1", "a.1.1"]
    assert names.repair_header(["x", None, "Unnamed: 3", "x"]) == ["x", "Columna_sin_nombre_2", "Columna_sin_nombre_3", "x_2"]
    assert names.fixed_value(" NULL ") is None and names.date_format("raro") == "%Y-%m-%d"


def test_numbers(spark):
    texts = ["1,234.56", "1.234,56", "7,5", "0,303", "7,650", "₡7,650", "P10", "12d", "-5", "1.2.3", "", None]
    assert values(spark, texts, numbers.parse_number) == [
        1234.56, 1234.56, 7.5, 0.303, 7650.0, 7650.0, None, None, -5.0, None, None, None]
    assert values(spark, ["7,650"], lambda c: numbers.parse_number(c, None, True)) == [7.65]
    assert values(spark, ["7,650 *", "n3", "-"], numbers.parse_number_lenient) == [7650.0, None, None]
    shown = spark.range(1).select(*[numbers.number_text(F.lit(v)).alias(str(i)) for i, v in enumerate((12.0, 0.1, 27194765.0, -1.25))])
    assert tuple(shown.first()) == ("12", "0.1", "27194765", "-1.25")


def test_coordinates(spark):
    def first(c):
        return numbers.rescue_coordinate(numbers.coordinate(c), -90.0, 90.0)

    def near(c):
        return numbers.rescue_coordinate(numbers.coordinate(c), -90.0, 90.0, 9.5)

    got = values(spark, ["9053281", "943751", "-84.0907246", "10,13727", "x"], first)
    assert got[:2] == [pytest.approx(9.053281), pytest.approx(9.43751)]
    assert got[2:] == [-84.0907246, 10.13727, None]
    assert values(spark, ["943751", "843751"], near) == [pytest.approx(9.43751), pytest.approx(8.43751)]


def test_text(spark):
    assert values(spark, ["ana perez", "JUAN PEREZ", "o'brien", "de la cruz", "acme sa", "maria de la cruz-lopez", " x "], text.proper_case) == [
        "Ana Perez", "Juan Perez", "O'Brien", "De la Cruz", "Acme SA", "Maria de la Cruz-Lopez", " X "]
    assert values(spark, ["  San  José\t", "N/A", "München"], text.fold) == ["san jose", "n/a", "munchen"]
    assert values(spark, ["N/A", "München"], text.alnum_key) == ["n a", "munchen"]
    assert values(spark, [' "Hola  Mundo" ', None], text.clean_text) == ["hola mundo", None]
    assert values(spark, ["ab-12 Ñ"], text.mask) == ["aa-99 A"]
    assert values(spark, ["", " \t", "#REF!", "n/a", "x", None], text.is_null) == [True, True, True, True, False, True]


def test_one_edit(spark):
    pairs = [("hredia", "heredia"), ("alajuela", "alajuelita"), ("herdeia", "heredia"), ("casas", "cosas"), ("abc1d", "abc2d"), ("eredia", "heredia")]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a string, b string")
    mine = [r[0] for r in df.orderBy("i").select(text.one_edit_typo(F.col("a"), F.col("b"))).collect()]
    assert mine == [True, False, True, True, False, False]


def test_dates(spark):
    texts = ["2025-01-31", "31/01/2025", "01/31/2025", "31-1-2025", "31 Jan 2025", "05/06/2025", "2024-13-01", "Pendiente", "2025-01-31 10:20:30", "20250131"]
    assert values(spark, texts, lambda c: dates.unify_dates(c, "%Y-%m-%d", ["/"])) == [
        "2025-01-31"] * 5 + ["2025-06-05", None, None, "2025-01-31", "2025-01-31"]
    assert values(spark, texts[:1] + texts[8:9], dates.text_to_date) == [datetime.datetime(2025, 1, 31), datetime.datetime(2025, 1, 31, 10, 20, 30)]
    df = spark.createDataFrame([(t,) for t in ("31/01/2025", "05/06/2025", "1-2-2025")], "d string")
    step = steps.fit_dates(df, ["d"])
    assert step["items"][0]["dia_primero"] == ["/", ".", "-"] and step["items"][0]["sin_duda"] == ["/"]
    report = steps.date_report(df, step).first()
    assert (report["ilegibles"], report["ambiguas"]) == (0, 1)


def test_keys(spark):
    assert values(spark, ["10115.0", " 10115 ", "1067", "nan", "123456"], lambda c: keys.normalize_key(c, "codigo", 5)) == ["10115", "10115", "01067", None, "123456"]
    assert values(spark, ["007.0", "0", "00", " AB "], keys.flexible_key) == ["7", "0", "0", "ab"]


def test_rules(spark):
    assert rules.parse_filter("ventas>1,000") == ("ventas", ">", 1000) and rules.parse_filter("c=Heredia") == ("c", "==", "Heredia")
    df = spark.createDataFrame([(1.0, 2.0, 0.0), (None, 2.0, 1.0)], "a double, b double, c double")
    got = df.select(rules.derived_column(df, "round([a] / [B], 2) ** 2 + 1"), rules.derived_column(df, "[a] / [c]"),
                    rules.derived_column(df, "-log([b]) + abs([c] - 3)"), rules.derived_column(df, "5 - [b] % 2")).collect()
    assert tuple(got[0])[:2] == (1.25, None) and got[1][0] is None and got[0][2] == pytest.approx(2.306853, abs=1e-5) and got[0][3] == 5.0
    for bad in ("__import__('os')", "[a].b", "[zz] + 1", "sum([a])", "[a] if 1 else 2", "'x' * 3"):
        with pytest.raises(ValueError):
            rules.derived_column(df, bad)
