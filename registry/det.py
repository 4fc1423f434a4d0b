"""Detectors, actions and the audit."""

from pyspark.sql import functions as F

from sparkscrub.operators import actions, audit, detect, formula
from sparkscrub.operators.rows import ROW_ID, repeated_cells, repeated_rows
from sparkscrub.plans.profile import Profile
from sparkscrub.session import fresh_path
from sparkscrub.streaming import repeats

from .base import query, union_all
from .fixtures import dirty, duck

C_COLUMNS = ["id", "nombre", "email", "telefono", "saldo", "segmento", "estado", "nacion"]
EMAIL_OK = r"regexp_full_match(trim(email), '[^@\s]+@[^@\s]+\.[^@\s]{2,}') AND NOT contains(email, '..') AND email NOT LIKE '.%' AND NOT regexp_matches(email, '\.@')"
MONEY = "TRY_CAST(replace(saldo, '$', '') AS DOUBLE)"
DATE = "coalesce(try_strptime(fecha_pago, '%Y-%m-%d'), try_strptime(fecha_pago, '%d/%m/%Y'))"


def profiled(spark, sf, name):
    df = dirty(spark, sf, name)
    return Profile(df, [c for c in df.columns if c != ROW_ID])


def found(profile, checks, *columns):
    return detect.findings(profile.df, checks).select(*(columns or ("tipo", "columna", "fila", "valor_original")))


def _quartiles(table: str, column: str, where: str = "true") -> str:
    return (f"SELECT '{column}' AS columna, quantile_cont({column}, 0.25) AS q1, quantile_cont({column}, 0.75) AS q3, "
            f"quantile_cont({column}, 0.5) AS med FROM {table} WHERE {where}")


@query("det_01_missing", duck("dirty_customer", "dirty_lineitem") + """
SELECT 'faltante' AS tipo, 'email' AS columna, _row_id AS fila, email AS valor_original FROM dirty_customer WHERE trim(email) = ''
UNION ALL SELECT 'faltante', 'cantidad', _row_id, NULL FROM dirty_lineitem WHERE cantidad IS NULL""")
def _(spark, sf):
    a, b = profiled(spark, sf, "dirty_customer"), profiled(spark, sf, "dirty_lineitem")
    return found(a, detect.missing(a)).unionByName(found(b, detect.missing(b)))


@query("det_02_duplicate_rows", duck("dirty_customer") + f"""
SELECT _row_id FROM (SELECT _row_id, row_number() OVER (PARTITION BY {', '.join(C_COLUMNS)} ORDER BY _row_id) AS rn FROM dirty_customer)
WHERE rn > 1""")
def _(spark, sf):
    return repeated_rows(dirty(spark, sf, "dirty_customer"), C_COLUMNS, ROW_ID)


def _arriving(spark, df, files=20):
    """`df` as files of a stream."""
    path = fresh_path(spark, "llegadas")
    df.repartition(files).write.parquet(path)
    return path


@query("det_02_stream_duplicates", duck("dirty_customer") + f"""
SELECT _row_id FROM (SELECT _row_id, row_number() OVER (PARTITION BY {', '.join(C_COLUMNS)} ORDER BY _row_id) AS rn FROM dirty_customer)
WHERE rn > 1""")
def _(spark, sf):
    """The customers arrive in 20 files, in any order; the rows given out are those of the batch detector."""
    df = dirty(spark, sf, "dirty_customer")
    target = fresh_path(spark, "repetidas")
    repeats.find_repeats(spark, _arriving(spark, df), df.schema, C_COLUMNS, ROW_ID, target, fresh_path(spark, "estado"), whole_rows=True).awaitTermination()
    return spark.read.schema("columna string, fila long").parquet(target).select(F.col("fila").alias("_row_id"))


@query("det_09_stream_repeated_ids", duck("dirty_customer") + """
SELECT 'id' AS columna, _row_id FROM (SELECT _row_id, row_number() OVER (PARTITION BY id ORDER BY _row_id) AS rn FROM dirty_customer)
WHERE rn > 1""")
def _(spark, sf):
    df = dirty(spark, sf, "dirty_customer")
    target = fresh_path(spark, "repetidas")
    repeats.find_repeats(spark, _arriving(spark, df), df.schema, ["id"], ROW_ID, target, fresh_path(spark, "estado")).awaitTermination()
    return spark.read.schema("columna string, fila long").parquet(target).select("columna", F.col("fila").alias("_row_id"))


L_COLUMNS = ["l_orderkey", "l_linenumber", "l_returnflag"]


@query("det_02_duplicate_lines", duck("dirty_lineitem") + f"""
SELECT _row_id FROM (SELECT _row_id, row_number() OVER (PARTITION BY {', '.join(L_COLUMNS)} ORDER BY _row_id) AS rn FROM dirty_lineitem) WHERE rn > 1""")
def _(spark, sf):
    return repeated_rows(dirty(spark, sf, "dirty_lineitem"), L_COLUMNS, ROW_ID)


@query("det_03_wrong_type", duck("dirty_customer") + """
SELECT 'tipo_invalido' AS tipo, 'saldo' AS columna, _row_id AS fila, saldo AS valor_original FROM dirty_customer
WHERE trim(saldo) <> '' AND TRY_CAST(saldo AS DOUBLE) IS NULL""")
def _(spark, sf):
    p = profiled(spark, sf, "dirty_customer")
    return found(p, detect.wrong_type(p))


@query("det_04_extra_spaces", duck("dirty_customer") + "\n" + union_all([
    f"SELECT '{c}' AS columna, _row_id AS fila, {c} AS valor_original, trim({c}) AS valor_sugerido FROM dirty_customer "
    f"WHERE {c} <> trim({c}) AND trim({c}) <> ''" for c in ("nombre", "email", "telefono", "saldo", "segmento", "estado")]))
def _(spark, sf):
    p = profiled(spark, sf, "dirty_customer")
    return found(p, detect.extra_spaces(p), "columna", "fila", "valor_original", "valor_sugerido")


@query("det_05_bad_dates", duck("dirty_orders") + f""",
p AS (SELECT _row_id, fecha_pago, {DATE} AS d, contains(fecha_pago, '/') AS barra FROM dirty_orders),
m AS (SELECT count(*) FILTER (WHERE d IS NOT NULL AND NOT barra) >= count(*) FILTER (WHERE d IS NOT NULL AND barra) AS guion FROM p)
SELECT _row_id AS fila, fecha_pago AS valor_original,
  CASE WHEN d IS NULL THEN 'Formato de fecha no reconocido'
       WHEN d < TIMESTAMP '1993-01-01' THEN 'Fecha fuera de rango (anterior a 1993-01-01)'
       WHEN guion THEN 'Formato de fecha inconsistente: usa separador ''/'', pero el resto de la columna usa ''-'''
       ELSE 'Formato de fecha inconsistente: usa separador ''-'', pero el resto de la columna usa ''/''' END AS detalle
FROM p, m WHERE fecha_pago <> 'Pendiente' AND (d IS NULL OR d < TIMESTAMP '1993-01-01' OR barra = guion)""")
def _(spark, sf):
    p = profiled(spark, sf, "dirty_orders")
    return found(p, detect.bad_dates(p, earliest="1993-01-01"), "fila", "valor_original", "detalle")


@query("det_06_bad_emails", duck("dirty_customer") + f"""
SELECT 'email_invalido' AS tipo, 'email' AS columna, _row_id AS fila, email AS valor_original FROM dirty_customer
WHERE trim(email) <> '' AND NOT ({EMAIL_OK})""")
def _(spark, sf):
    p = profiled(spark, sf, "dirty_customer")
    return found(p, detect.bad_emails(p))


@query("det_07_bad_phones", duck("dirty_customer") + r"""
SELECT 'telefono_invalido' AS tipo, 'telefono' AS columna, _row_id AS fila, telefono AS valor_original FROM dirty_customer
WHERE trim(telefono) <> '' AND NOT (regexp_full_match(trim(telefono), '[\d\s\-\+\(\)]+')
  AND length(regexp_replace(telefono, '[^0-9]', '', 'g')) BETWEEN 8 AND 11)""")
def _(spark, sf):
    p = profiled(spark, sf, "dirty_customer")
    return found(p, detect.bad_phones(p, countries=["Costa Rica", "Guatemala"]))


@query("det_08_phone_first_digit", duck("dirty_customer") + r"""
SELECT _row_id AS fila, telefono AS valor_original FROM dirty_customer
WHERE NOT (length(regexp_replace(telefono, '[^0-9]', '', 'g')) BETWEEN 7 AND 15 AND substr(regexp_replace(telefono, '[^0-9]', '', 'g'), 1, 1) IN ('2', '6'))""")
def _(spark, sf):
    p = profiled(spark, sf, "dirty_customer")
    return found(p, detect.bad_phones(p, country_code=False, first_digits=["2", "6"]), "fila", "valor_original")


@query("det_09_repeated_ids", duck("dirty_customer") + """
SELECT 'id' AS columna, _row_id FROM (SELECT _row_id, row_number() OVER (PARTITION BY id ORDER BY _row_id) AS rn FROM dirty_customer)
WHERE rn > 1""")
def _(spark, sf):
    p = profiled(spark, sf, "dirty_customer")
    return repeated_cells(p.df, detect.key_columns(p), ROW_ID)


@query("det_09_repeated_line_keys", duck("dirty_lineitem") + """
SELECT 'l_orderkey' AS columna, _row_id FROM (SELECT _row_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY _row_id) AS rn FROM dirty_lineitem) WHERE rn > 1""")
def _(spark, sf):
    return repeated_cells(dirty(spark, sf, "dirty_lineitem"), ["l_orderkey"], ROW_ID)


_EXPECTED = "round(cantidad * precio_unitario, 2)"
_BROKEN = "cantidad IS NOT NULL AND abs(total - cantidad * precio_unitario) > greatest(abs(cantidad * precio_unitario) * 0.01, 0.01)"
RULE = {"total": "total", "cantidad": "cantidad", "precio": "precio_unitario", "tolerancia": 0.01}


@query("det_10_bad_formula", duck("dirty_lineitem") + f"""
SELECT _row_id AS fila, round(total, 2) AS total, round({_EXPECTED}, 2) AS esperado FROM dirty_lineitem WHERE {_BROKEN}""")
def _(spark, sf):
    p = profiled(spark, sf, "dirty_lineitem")
    out = found(p, detect.bad_formula(p, RULE), "fila", "valor_original", "valor_sugerido")
    return out.select("fila", F.round(F.col("valor_original").cast("double"), 2).alias("total"),
                      F.round(F.col("valor_sugerido").cast("double"), 2).alias("esperado"))


_SIGNS = [(d, i) for d in ("l_discount", None) for i in ("l_tax", None)]


def _rate(price: str, discount: str | None, tax: str | None) -> str:
    e = f"(cantidad * {price}" + (f" - coalesce({discount}, 0)" if discount else "") + (f" + coalesce({tax}, 0)" if tax else "") + ")"
    return (f"SELECT '{price}' AS precio, '{discount or ''}' AS descuento, '{tax or ''}' AS impuesto, "
            f"round(count(*) FILTER (WHERE abs(total - {e}) <= greatest(abs({e}) * 0.01, 0.01)) * 1.0 / count(*) FILTER (WHERE {e} IS NOT NULL), 4) AS tasa FROM d")


@query("det_11_formula_search", duck("dirty_lineitem") + """,
d AS (SELECT *, precio_unitario / 2 AS tarifa FROM dirty_lineitem)
""" + union_all([_rate(c, d, i) for c in ("precio_unitario", "tarifa") for d, i in _SIGNS]))
def _(spark, sf):
    """Every form that the names of all columns allow, with and without discount and tax."""
    df = dirty(spark, sf, "dirty_lineitem").withColumn("tarifa", F.col("precio_unitario") / 2)
    p = Profile(df, [c for c in df.columns if c != ROW_ID])
    rules = formula.candidate_rules(p.columns)
    rates = formula.match_rates(df, rules, p.guided_number)
    return spark.createDataFrame([(r["precio"], r.get("descuento") or "", r.get("impuesto") or "", round(x, 4)) for r, x in zip(rules, rates)],
                                 "precio string, descuento string, impuesto string, tasa double")


@query("det_12_formula_rows", duck("dirty_lineitem") + f"""
SELECT _row_id + 1 AS fila, total, {_EXPECTED} AS esperado, 'cantidad × precio_unitario' AS formula FROM dirty_lineitem WHERE {_BROKEN}""")
def _(spark, sf):
    return audit.formula_violations(profiled(spark, sf, "dirty_lineitem"), RULE)


@query("det_13_bad_states", duck("dirty_customer") + """
SELECT 'estado_invalido' AS tipo, 'estado' AS columna, _row_id AS fila, estado AS valor_original FROM dirty_customer
WHERE lower(trim(estado)) NOT IN ('activo', 'inactivo', 'pendiente')""")
def _(spark, sf):
    p = profiled(spark, sf, "dirty_customer")
    return found(p, detect.bad_states(p))


@query("det_14_bad_case", duck("dirty_customer") + """
SELECT _row_id AS fila, nombre AS valor_original, upper(left(trim(nombre), 1)) || lower(substr(trim(nombre), 2)) AS valor_sugerido
FROM dirty_customer WHERE left(trim(nombre), 1) <> upper(left(trim(nombre), 1))""")
def _(spark, sf):
    p = profiled(spark, sf, "dirty_customer")
    return found(p, detect.bad_case(p), "fila", "valor_original", "valor_sugerido")


@query("det_15_spelling_variants", duck("dirty_customer") + """,
n AS (SELECT segmento AS texto, count(*) AS filas, CASE WHEN upper(segmento) = 'HOUSEHOLDD' THEN 'HOUSEHOLD' ELSE upper(segmento) END AS grupo
      FROM dirty_customer GROUP BY segmento),
c AS (SELECT grupo, arg_min(texto, struct_pack(a := -filas, b := texto)) AS destino FROM n GROUP BY grupo)
SELECT 'texto_inconsistente' AS tipo, _row_id AS fila, segmento AS valor_original, destino AS valor_sugerido
FROM dirty_customer JOIN n ON segmento = texto JOIN c USING (grupo) WHERE texto <> destino""")
def _(spark, sf):
    a = detect.analyze(dirty(spark, sf, "dirty_customer"), only={"texto_inconsistente"})
    return a.findings().select("tipo", "fila", "valor_original", "valor_sugerido")


def _fences(columns) -> str:
    return "f AS (" + union_all([_quartiles("dirty_lineitem", c) for c in columns]) + ")"


_OUT = ("cantidad", "precio_unitario", "total")


@query("det_16_outliers_iqr", duck("dirty_lineitem") + ", " + _fences(_OUT) + "\n" + union_all([
    f"SELECT '{c}' AS columna, _row_id AS fila, round({c}, 2) AS valor FROM dirty_lineitem, f WHERE columna = '{c}' "
    f"AND ({c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1))" for c in _OUT]))
def _(spark, sf):
    p = profiled(spark, sf, "dirty_lineitem")
    return found(p, detect.outliers(p, "iqr", columns=list(_OUT), logical=False), "columna", "fila", "valor_original").select(
        "columna", "fila", F.round(F.col("valor_original").cast("double"), 2).alias("valor"))


_Z = union_all([f"SELECT '{c}' AS columna, _row_id AS fila, round({c}, 2) AS valor FROM dirty_lineitem, "
                f"(SELECT avg({c}) AS m, stddev_samp({c}) AS s FROM dirty_lineitem) WHERE abs(({c} - m) / s) > 3" for c in _OUT])


@query("det_17_outliers_zscore", duck("dirty_lineitem") + "\n" + _Z)
def _(spark, sf):
    p = profiled(spark, sf, "dirty_lineitem")
    return found(p, detect.outliers(p, "zscore", columns=list(_OUT), logical=False), "columna", "fila", "valor_original").select(
        "columna", "fila", F.round(F.col("valor_original").cast("double"), 2).alias("valor"))


@query("det_18_outliers_logical", duck("dirty_lineitem", "dirty_geo") + """
SELECT 'cantidad' AS columna, _row_id AS fila, cantidad AS valor FROM dirty_lineitem WHERE cantidad < 0
UNION ALL SELECT 'total', _row_id, total FROM dirty_lineitem WHERE total < 0
UNION ALL SELECT 'latitud', _row_id, TRY_CAST(replace(latitud, ',', '.') AS DOUBLE) FROM dirty_geo
  WHERE abs(TRY_CAST(replace(latitud, ',', '.') AS DOUBLE)) > 90
UNION ALL SELECT 'longitud', _row_id, TRY_CAST(longitud AS DOUBLE) FROM dirty_geo WHERE abs(TRY_CAST(longitud AS DOUBLE)) > 180""")
def _(spark, sf):
    parts = []
    for name in ("dirty_lineitem", "dirty_geo"):
        p = profiled(spark, sf, name)
        parts.append(found(p, detect.outliers(p, "ninguno"), "columna", "fila", "valor_original").select(
            "columna", "fila", F.col("valor_original").cast("double").alias("valor")))
    return parts[0].unionByName(parts[1])


@query("det_19_outliers_merged", duck("dirty_lineitem") + ", " + _fences(_OUT) + ", " + """
z AS (SELECT avg(cantidad) m1, stddev_samp(cantidad) s1, avg(precio_unitario) m2, stddev_samp(precio_unitario) s2, avg(total) m3, stddev_samp(total) s3 FROM dirty_lineitem)
""" + union_all([
    f"SELECT '{c}' AS columna, _row_id AS fila, {c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1) AS iqr, abs(({c} - m{i}) / s{i}) > 3 AS z, "
    f"{c} < 0 AS logico FROM dirty_lineitem, f, z WHERE columna = '{c}' AND ({c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1) "
    f"OR abs(({c} - m{i}) / s{i}) > 3 OR {c} < 0)" for i, c in enumerate(_OUT, 1)]))
def _(spark, sf):
    p = profiled(spark, sf, "dirty_lineitem")
    d = F.col("detalle")
    return found(p, detect.outliers(p, "ambos", columns=list(_OUT)), "columna", "fila", "detalle").select(
        "columna", "fila", d.contains("método IQR").alias("iqr"), d.contains("Z-score=").alias("z"),
        d.contains("Valor negativo").alias("logico"))


ALL_CUSTOMER = f"""
h AS (SELECT 'faltante' AS tipo, 'email' AS columna, _row_id AS fila FROM dirty_customer WHERE trim(email) = ''
  UNION ALL SELECT 'duplicado', NULL, _row_id FROM (SELECT _row_id, row_number() OVER (PARTITION BY {', '.join(C_COLUMNS)} ORDER BY _row_id) rn FROM dirty_customer) WHERE rn > 1
  UNION ALL SELECT 'tipo_invalido', 'saldo', _row_id FROM dirty_customer WHERE TRY_CAST(saldo AS DOUBLE) IS NULL
  UNION ALL SELECT 'espacio_extra', 'nombre', _row_id FROM dirty_customer WHERE nombre <> trim(nombre)
  UNION ALL SELECT 'espacio_extra', 'estado', _row_id FROM dirty_customer WHERE estado <> trim(estado)
  UNION ALL SELECT 'email_invalido', 'email', _row_id FROM dirty_customer WHERE trim(email) <> '' AND NOT ({EMAIL_OK})
  UNION ALL SELECT 'telefono_invalido', 'telefono', _row_id FROM dirty_customer WHERE telefono = '12-34'
  UNION ALL SELECT 'id_duplicado', 'id', _row_id FROM (SELECT _row_id, row_number() OVER (PARTITION BY id ORDER BY _row_id) rn FROM dirty_customer) WHERE rn > 1
  UNION ALL SELECT 'texto_inconsistente', 'segmento', _row_id FROM dirty_customer WHERE segmento = 'HOUSEHOLDD' OR segmento <> upper(segmento)
  UNION ALL SELECT 'estado_invalido', 'estado', _row_id FROM dirty_customer WHERE estado = 'zzz'
  UNION ALL SELECT 'capitalizacion_incorrecta', 'nombre', _row_id FROM dirty_customer WHERE left(trim(nombre), 1) <> upper(left(trim(nombre), 1)))"""


@query("det_20_analyze_all", duck("dirty_customer") + "," + ALL_CUSTOMER + " SELECT tipo, columna, fila FROM h")
def _(spark, sf):
    return detect.analyze(dirty(spark, sf, "dirty_customer")).findings().select("tipo", "columna", "fila")


@query("det_21_findings_by_type", duck("dirty_customer") + "," + ALL_CUSTOMER + """
SELECT 'tipo' AS eje, tipo AS valor, count(*) AS hallazgos FROM h GROUP BY tipo
UNION ALL SELECT 'columna', coalesce(columna, '(fila completa)'), count(*) FROM h GROUP BY columna""")
def _(spark, sf):
    a = detect.analyze(dirty(spark, sf, "dirty_customer"))
    return a.by_type().select(F.lit("tipo").alias("eje"), F.col("tipo").alias("valor"), "hallazgos").unionByName(
        a.by_column().select(F.lit("columna").alias("eje"), F.col("columna").alias("valor"), "hallazgos"))


@query("det_20_analyze_lines", duck("dirty_lineitem") + f"""
SELECT 'faltante' AS tipo, 'cantidad' AS columna, _row_id AS fila FROM dirty_lineitem WHERE cantidad IS NULL
UNION ALL SELECT 'formula_incorrecta', 'total', _row_id FROM dirty_lineitem WHERE {_BROKEN}
UNION ALL SELECT 'duplicado', NULL, _row_id FROM (SELECT _row_id, row_number() OVER (PARTITION BY l_orderkey, l_partkey, l_suppkey, l_linenumber, cantidad, precio_unitario,
  total, l_discount, l_tax, l_returnflag, l_shipdate ORDER BY _row_id) AS rn FROM dirty_lineitem) WHERE rn > 1""")
def _(spark, sf):
    lines = detect.analyze(dirty(spark, sf, "dirty_lineitem"), only={"faltante", "duplicado", "formula_incorrecta"}, formula=RULE)
    return lines.findings().select("tipo", "columna", "fila")


# -- actions ---------------------------------------------------------------------------------------------------
def cleaned(spark, sf, name, only, config=None, **options):
    return actions.clean(detect.analyze(dirty(spark, sf, name), only=only), config, **options)




@query("act_01_apply_defaults", duck("dirty_customer") + f"""
SELECT id, trim(nombre) AS nombre, email, telefono, saldo, segmento, trim(estado) AS estado, nacion FROM (
  SELECT *, row_number() OVER (PARTITION BY {', '.join(C_COLUMNS)} ORDER BY _row_id) AS rn FROM dirty_customer) WHERE rn = 1""")
def _(spark, sf):
    return actions.clean(detect.analyze(dirty(spark, sf, "dirty_customer"))).df.select(*C_COLUMNS)


@query("act_02_mark_only", duck("dirty_customer") + """
SELECT _row_id, estado, CASE WHEN estado = 'zzz' THEN 'estado_invalido:estado' ELSE '' END AS _revisar_calidad FROM dirty_customer""")
def _(spark, sf):
    return cleaned(spark, sf, "dirty_customer", {"estado_invalido"}).df.select("_row_id", "estado", "_revisar_calidad")


@query("act_03_drop_rows", duck("dirty_customer") + f"""
SELECT _row_id, email FROM dirty_customer WHERE NOT (trim(email) <> '' AND NOT ({EMAIL_OK}))""")
def _(spark, sf):
    return cleaned(spark, sf, "dirty_customer", {"email_invalido"}, {"email_invalido": "eliminar_fila"}).df.select("_row_id", "email")


@query("act_04_replace_statistics", duck("dirty_lineitem") + """,
m AS (SELECT avg(cantidad) AS media, quantile_cont(cantidad, 0.5) AS mediana FROM dirty_lineitem),
t AS (SELECT arg_min(cantidad, struct_pack(a := -n, b := cantidad)) AS moda FROM (SELECT cantidad, count(*) AS n FROM dirty_lineitem WHERE cantidad IS NOT NULL GROUP BY 1))
SELECT _row_id, l_partkey, round(coalesce(cantidad, media), 4) AS con_media, round(coalesce(cantidad, mediana), 4) AS con_mediana, round(coalesce(cantidad, moda), 4) AS con_moda
FROM dirty_lineitem, m, t""")
def _(spark, sf):
    p = profiled(spark, sf, "dirty_lineitem")
    fill = {a: actions.replacements(p, {"cantidad": f"reemplazar_{a}"})["cantidad"] for a in ("media", "mediana", "moda")}
    c = F.col("cantidad")
    return p.df.select("_row_id", "l_partkey", *[F.round(F.coalesce(c, F.lit(float(v))), 4).alias(f"con_{a}") for a, v in fill.items()])


@query("act_05_winsorize", duck("dirty_lineitem") + """,
f AS (SELECT quantile_cont(precio_unitario, 0.25) q1, quantile_cont(precio_unitario, 0.75) q3, quantile_cont(cantidad, 0.25) c1, quantile_cont(cantidad, 0.75) c3 FROM dirty_lineitem)
SELECT _row_id, l_partkey, round(least(greatest(precio_unitario, greatest(q1 - 1.5 * (q3 - q1), 0)), q3 + 1.5 * (q3 - q1)), 2) AS precio,
  CASE WHEN cantidad IS NOT NULL THEN least(greatest(cantidad, ceil(greatest(c1 - 1.5 * (c3 - c1), 0))), floor(c3 + 1.5 * (c3 - c1))) END AS cantidad
FROM dirty_lineitem, f""")
def _(spark, sf):
    p = profiled(spark, sf, "dirty_lineitem")
    limits = actions.winsor_limits(p, ["precio_unitario", "cantidad"])
    return p.df.select("_row_id", "l_partkey", F.round(actions.clip(F.col("precio_unitario"), *limits["precio_unitario"]), 2).alias("precio"),
                       actions.clip(F.col("cantidad"), *limits["cantidad"]).alias("cantidad"))


@query("act_06_fixed_value", duck("dirty_customer") + """
SELECT _row_id, CASE WHEN estado = 'zzz' THEN 'pendiente' ELSE estado END AS estado, CASE WHEN telefono <> '12-34' THEN telefono END AS telefono FROM dirty_customer""")
def _(spark, sf):
    done = cleaned(spark, sf, "dirty_customer", {"estado_invalido", "telefono_invalido"},
                   {"estado_invalido": "valor_fijo", "telefono_invalido": "valor_fijo"},
                   fixed={("estado_invalido", "estado"): "pendiente", "telefono": "NULL"})
    return done.df.select("_row_id", "estado", "telefono")


@query("act_07_blank_to_null", duck("dirty_customer") + "SELECT _row_id, nullif(trim(email), '') AS email FROM dirty_customer")
def _(spark, sf):
    return cleaned(spark, sf, "dirty_customer", {"faltante"}, {"faltante": "rellenar_nan"}).df.select("_row_id", "email")


@query("act_08_use_suggestion", duck("dirty_lineitem") + f"""
SELECT _row_id, l_partkey, round(CASE WHEN {_BROKEN} THEN {_EXPECTED} ELSE total END, 2) AS total FROM dirty_lineitem""")
def _(spark, sf):
    a = detect.analyze(dirty(spark, sf, "dirty_lineitem"), only={"formula_incorrecta"}, formula=RULE)
    return actions.clean(a, {"formula_incorrecta": "usar_sugerido"}).df.select("_row_id", "l_partkey", F.round("total", 2).alias("total"))


@query("act_09_edit_cells", duck("dirty_customer") + """
SELECT _row_id, CASE WHEN telefono = '12-34' AND _row_id % 20 = 0 THEN '8' || lpad(CAST(id AS VARCHAR), 7, '0') ELSE telefono END AS telefono,
  CASE WHEN telefono = '12-34' AND _row_id % 20 <> 0 THEN 'telefono_invalido:telefono' ELSE '' END AS _revisar_calidad FROM dirty_customer""")
def _(spark, sf):
    df = dirty(spark, sf, "dirty_customer")
    edits = df.filter((F.col("telefono") == "12-34") & (F.col("_row_id") % 20 == 0)).select(
        F.lit("telefono_invalido").alias("tipo"), F.lit("telefono").alias("columna"), F.col("_row_id").alias("fila"),
        F.concat(F.lit("8"), F.lpad(F.col("id").cast("string"), 7, "0")).alias("valor"))
    return cleaned(spark, sf, "dirty_customer", {"telefono_invalido"}, {"telefono_invalido": "editar_individualmente"},
                   corrections=edits).df.select("_row_id", "telefono", "_revisar_calidad")


@query("act_10_digit_patches", duck("dirty_customer") + """
SELECT _row_id, CASE WHEN telefono = '12-34' THEN '10000000' ELSE '9' || substr(telefono, 2) END AS telefono FROM dirty_customer""")
def _(spark, sf):
    df = dirty(spark, sf, "dirty_customer")
    new = F.when(F.col("telefono") == "12-34", "10000000").otherwise(F.concat(F.lit("9"), F.substring("telefono", 2, 20)))
    patches = actions.digit_patches(df, df.select("_row_id", new.alias("valor")), "_row_id", "telefono")
    return actions.apply_patches(df, patches, "_row_id", "telefono").select("_row_id", "telefono")


@query("act_11_normalize_dates", duck("dirty_orders") + f"""
SELECT _row_id, coalesce(strftime({DATE}, '%d/%m/%Y'), fecha_pago) AS fecha_pago FROM dirty_orders""")
def _(spark, sf):
    """'05/06/1995' is read day first because the column's other '/' dates prove that order."""
    a = detect.analyze(dirty(spark, sf, "dirty_orders"), only={"fecha_invalida"})
    return actions.clean(a, {"fecha_invalida": "normalizar_formato_fecha"}, date_formats={"fecha_pago": "dd/mm/aaaa"}).df.select(
        "_row_id", "fecha_pago")


@query("act_12_imputation_guards", duck("dirty_customer") + """
SELECT _row_id, email, saldo, CASE WHEN trim(email) = '' THEN 'faltante:email' ELSE '' END AS marca FROM dirty_customer""")
def _(spark, sf):
    done = cleaned(spark, sf, "dirty_customer", {"faltante"}, {"faltante": "reemplazar_moda"})
    return done.df.select("_row_id", "email", "saldo", F.col("_revisar_calidad").alias("marca"))


@query("act_13_quality_mark", duck("dirty_customer") + "," + ALL_CUSTOMER + """,
m AS (SELECT fila, string_agg(tipo || ':' || columna, '; ' ORDER BY CASE tipo WHEN 'email_invalido' THEN 1 WHEN 'telefono_invalido' THEN 2 ELSE 3 END) AS marca
      FROM h WHERE tipo IN ('email_invalido', 'telefono_invalido', 'estado_invalido') GROUP BY fila)
SELECT _row_id, coalesce(marca, '') AS marca FROM dirty_customer LEFT JOIN m ON fila = _row_id""")
def _(spark, sf):
    done = cleaned(spark, sf, "dirty_customer", {"email_invalido", "telefono_invalido", "estado_invalido"})
    return done.df.select("_row_id", F.col("_revisar_calidad").alias("marca"))


@query("act_14_action_log", duck("dirty_customer") + "," + ALL_CUSTOMER + """
SELECT tipo, coalesce(columna, '(fila completa)') AS columna,
  CASE tipo WHEN 'duplicado' THEN 'eliminar_fila' WHEN 'espacio_extra' THEN 'usar_sugerido' ELSE 'marcar_solo' END AS accion_aplicada, count(*) AS n
FROM h GROUP BY tipo, columna""")
def _(spark, sf):
    log = actions.clean(detect.analyze(dirty(spark, sf, "dirty_customer"))).log
    return log.groupBy("tipo", "columna", "accion_aplicada").agg(F.count(F.lit(1)).alias("n"))


@query("act_15_quality_report", duck("dirty_customer") + "," + ALL_CUSTOMER + """
SELECT 'Total de hallazgos' AS "Indicador", CAST(count(*) AS VARCHAR) AS "Valor" FROM h
UNION ALL SELECT 'Filas analizadas', CAST(count(*) AS VARCHAR) FROM dirty_customer UNION ALL SELECT 'Columnas analizadas', '8'
UNION ALL SELECT 'Archivo/fuente analizada', 'clientes'
UNION ALL SELECT 'tipo: ' || tipo, CAST(count(*) AS VARCHAR) FROM h GROUP BY tipo
UNION ALL SELECT 'columna: ' || coalesce(columna, '(fila completa)'), CAST(count(*) AS VARCHAR) FROM h GROUP BY columna""")
def _(spark, sf):
    a = detect.analyze(dirty(spark, sf, "dirty_customer"))
    summary = actions.report(a, actions.clean(a).log, "clientes")["resumen"]
    return summary.filter(F.col("Indicador") != "Fecha de análisis")


# -- audit --------------------------------------------------------------------------------------------------------
@query("aud_01_type_mapping", """
SELECT * FROM (VALUES ('id', 'bigint', 'identificador / llave', ''), ('nombre', 'string', 'texto', ''), ('email', 'string', 'email', ''),
 ('telefono', 'string', 'teléfono', ''), ('saldo', 'string', 'número', 'leída como texto'), ('segmento', 'string', 'texto', ''),
 ('estado', 'string', 'texto', ''), ('nacion', 'int', 'número', '')) t(columna, tipo_leido, tipo_esperado, revisar)""")
def _(spark, sf):
    return audit.type_mapping(profiled(spark, sf, "dirty_customer"))


@query("aud_02_nulls", duck("dirty_customer") + """
SELECT columna, nulos, round(nulos * 100.0 / filas, 1) AS porcentaje FROM (
  SELECT 'email' AS columna, count(*) FILTER (WHERE email = '') AS nulos, count(*) AS filas FROM dirty_customer
  UNION ALL SELECT 'saldo', count(*) FILTER (WHERE saldo = 'n/a'), count(*) FROM dirty_customer)""")
def _(spark, sf):
    return audit.null_table(profiled(spark, sf, "dirty_customer"))


@query("aud_03_duplicates", duck("dirty_customer") + f"""
SELECT count(*) AS filas, count(*) - (SELECT count(*) FROM (SELECT DISTINCT {', '.join(C_COLUMNS)} FROM dirty_customer)) AS duplicados FROM dirty_customer""")
def _(spark, sf):
    return audit.duplicate_count(dirty(spark, sf, "dirty_customer"), C_COLUMNS)


@query("aud_03_duplicate_examples", duck("dirty_customer") + f"""
SELECT _row_id, id, nombre FROM (SELECT *, row_number() OVER (PARTITION BY {', '.join(C_COLUMNS)} ORDER BY _row_id) AS rn FROM dirty_customer)
WHERE rn > 1 ORDER BY _row_id LIMIT 50""")
def _(spark, sf):
    return audit.duplicate_examples(dirty(spark, sf, "dirty_customer"), C_COLUMNS).select("_row_id", "id", "nombre")


@query("aud_04_impossible_values", duck("dirty_lineitem") + """
SELECT 'cantidad' AS columna, _row_id + 1 AS fila, cantidad AS valor FROM dirty_lineitem WHERE cantidad < 0""")
def _(spark, sf):
    out = audit.impossible_values(profiled(spark, sf, "dirty_lineitem"))
    return out.select("columna", "fila", F.col("valor").cast("double").alias("valor"))


@query("aud_05_formula_check", duck("dirty_lineitem") + """,
e AS (SELECT _row_id, total, cantidad * precio_unitario - l_discount + l_tax AS e1, cantidad * precio_unitario - l_discount AS e2, cantidad * precio_unitario + l_tax AS e3,
  cantidad * precio_unitario AS e4 FROM dirty_lineitem),
u AS (SELECT _row_id, total, k, e FROM (SELECT _row_id, total, unnest([e1, e2, e3, e4]) AS e, unnest([1, 2, 3, 4]) AS k FROM e)),
r AS (SELECT k, count(*) FILTER (WHERE abs(total - e) <= greatest(abs(e) * 0.01, 0.01)) * 1.0 / count(e) AS tasa FROM u GROUP BY k),
b AS (SELECT arg_max(k, struct_pack(t := tasa, k := -k)) AS k FROM r)
SELECT _row_id + 1 AS fila, total, round(e, 2) AS esperado FROM u JOIN b USING (k) WHERE abs(total - e) > greatest(abs(e) * 0.01, 0.01)""")
def _(spark, sf):
    p = profiled(spark, sf, "dirty_lineitem")
    return audit.formula_violations(p, audit.formula_rule(p)).select("fila", "total", "esperado")


@query("aud_06_checklist", duck("dirty_customer") + f""",
n AS (SELECT count(*) AS filas, count(*) FILTER (WHERE email = '') + count(*) FILTER (WHERE saldo = 'n/a') AS nulos,
  count(*) - count(DISTINCT ({', '.join(C_COLUMNS)})) AS dup FROM dirty_customer)
SELECT 1 AS n, format('{{:,}} filas × 8 columnas', filas) AS resultado, 'ok' AS estado FROM n
UNION ALL SELECT 2, '1 columnas que deberían ser número o fecha se leyeron como texto: saldo', 'revisar'
UNION ALL SELECT 3, format('{{:,}} celdas nulas en 2 columnas', nulos), 'revisar' FROM n
UNION ALL SELECT 4, format('{{:,}} filas duplicadas', dup), 'revisar' FROM n
UNION ALL SELECT 5, 'No se encontraron valores imposibles', 'ok'""")
def _(spark, sf):
    return audit.checklist(dirty(spark, sf, "dirty_customer")).select("n", "resultado", "estado")


@query("aud_07_audit_pair", duck("dirty_customer", "dirty_orders") + f"""
SELECT 'A' AS tabla, 1 AS n, format('{{:,}} filas × 5 columnas', count(*)) AS resultado FROM dirty_orders
UNION ALL SELECT 'B', 1, format('{{:,}} filas × 8 columnas', count(*)) FROM dirty_customer""")
def _(spark, sf):
    pair = audit.audit_pair(dirty(spark, sf, "dirty_orders"), dirty(spark, sf, "dirty_customer"))
    return pair.filter("n = 1").select("tabla", "n", "resultado")
