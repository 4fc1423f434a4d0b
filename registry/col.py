"""Column discovery and guided cleaning."""

from pyspark.sql import functions as F

from sparkscrub.operators import steps as S
from sparkscrub.operators.dictionary import Dictionary
from sparkscrub.operators.rows import ROW_ID
from sparkscrub.operators.variants import suggest_equivalences
from sparkscrub.plans import recipe as R
from sparkscrub.plans.profile import Profile, bounded_scale
from sparkscrub.session import fresh_path
from sparkscrub.streaming.replay import replay_files

from .base import query, union_all
from .det import DATE, EMAIL_OK, MONEY, profiled
from .fixtures import dirty, duck, table

TEXTS = ("nombre", "email", "telefono", "saldo", "segmento", "estado")
NULL = "({c} IS NULL OR lower(trim({c})) IN ('', 'nan', 'none', 'null', 'n/a'))"


def null_of(column: str) -> str:
    return NULL.format(c=column)


def rows(spark, values, schema):
    return spark.createDataFrame(values, schema)


def per_text(expression: str) -> str:
    return union_all([f"SELECT '{c}' AS columna, {expression.replace('{c}', c)} FROM dirty_customer" for c in TEXTS])


@query("col_04_looks_email", duck("dirty_customer") + "\n" + per_text(
    "round(count(*) FILTER (WHERE " + EMAIL_OK.replace("email", "{c}") + ") * 1.0 / count({c}), 4) AS proporcion, "
    "count(*) FILTER (WHERE " + EMAIL_OK.replace("email", "{c}") + ") * 1.0 / count({c}) >= 0.6 AS parece"))
def _(spark, sf):
    p = profiled(spark, sf, "dirty_customer")
    return rows(spark, [(c, round(p.text[c]["email"] / p.present(c), 4), p.looks_email(c)) for c in TEXTS],
                "columna string, proporcion double, parece boolean")


_BASE = (r"NOT regexp_matches(trim({c}), '\b(?:19|20)\d{2}\b') AND NOT regexp_matches(trim({c}), '^-?[\d.,]*\d[.,]\d{1,2}$') "
         r"AND NOT regexp_matches(trim({c}), '^-\d{1,3}[.,]\d{3,}$|^\d{1,3}[.,]\d{5,}$')")
_PHONE = "length(regexp_replace({c}, '[^0-9]', '', 'g')) BETWEEN 7 AND 15"


@query("col_05_looks_phone", duck("dirty_customer") + "\n" + per_text(
    f"count(*) FILTER (WHERE {_BASE}) AS candidatos, count(*) FILTER (WHERE {_BASE} AND {_PHONE}) AS telefonos, "
    f"coalesce(count(*) FILTER (WHERE {_BASE} AND {_PHONE}) * 1.0 / nullif(count(*) FILTER (WHERE {_BASE}), 0) >= 0.7, false) AS parece"))
def _(spark, sf):
    p = profiled(spark, sf, "dirty_customer")
    return rows(spark, [(c, p.text[c]["phone_base"], p.text[c]["phone"], p.looks_phone(c)) for c in TEXTS],
                "columna string, candidatos long, telefonos long, parece boolean")


@query("col_06_looks_date", duck("dirty_orders") + f"""
SELECT 'fecha_pago' AS columna, count(*) FILTER (WHERE {DATE} IS NOT NULL) AS fechas, count(*) FILTER (WHERE {DATE} IS NOT NULL) * 1.0 / count(*) >= 0.7 AS parece,
  count(*) FILTER (WHERE regexp_matches(fecha_pago, '^[0-9]')) AS con_forma FROM dirty_orders
UNION ALL SELECT 'prioridad', 0, false, 0 UNION ALL SELECT 'id_cliente', 0, false, 0""")
def _(spark, sf):
    p = profiled(spark, sf, "dirty_orders")
    return rows(spark, [(c, p.text[c]["date_like"], p.looks_date(c), p.text[c]["guided_date"]) for c in ("fecha_pago", "prioridad", "id_cliente")],
                "columna string, fechas long, parece boolean, con_forma long")


_IDS = ("id", "nombre", "telefono", "segmento")


@query("col_07_looks_id", duck("dirty_customer") + "\n" + union_all([
    f"SELECT '{c}' AS columna, count(DISTINCT {c}) AS distintos, count(DISTINCT {c}) * 1.0 / count({c}) >= 0.95 AS parece FROM dirty_customer" for c in _IDS]))
def _(spark, sf):
    p = profiled(spark, sf, "dirty_customer")
    exact = p.exact_distinct(list(_IDS))
    return rows(spark, [(c, exact[c], exact[c] / p.filled(c) >= 0.95) for c in _IDS], "columna string, distintos long, parece boolean")


@query("col_08_detect_columns", """
SELECT * FROM (VALUES ('por nombre', 'email'), ('por nombre', 'telefono'), ('por contenido', 'campo_1'), ('por contenido', 'campo_2'), ('fecha', 'campo_3')) t(nivel, columna)""")
def _(spark, sf):
    """By name on the customer table; by content once its columns have names that say nothing."""
    p = profiled(spark, sf, "dirty_customer")
    dated = dirty(spark, sf, "dirty_orders").select(F.col("fecha_pago").alias("campo_3"))
    blind = Profile(p.df.select(F.col("email").alias("campo_1"), F.col("telefono").alias("campo_2"), F.col("segmento").alias("campo_4")))
    found = [("por nombre", c) for c in p.email_columns + p.phone_columns]
    found += [("por contenido", c) for c in blind.email_columns + blind.phone_columns]
    return rows(spark, found + [("fecha", c) for c in Profile(dated).date_columns], "nivel string, columna string")


@query("col_09_numeric_text", duck("dirty_customer") + "\n" + per_text(
    f"round(count(TRY_CAST({{c}} AS DOUBLE)) * 1.0 / count({{c}}), 4) AS estricta, "
    f"round(count(*) FILTER (WHERE NOT {NULL} AND TRY_CAST(replace({{c}}, '$', '') AS DOUBLE) IS NOT NULL) * 1.0 / count(*) FILTER (WHERE NOT {NULL}), 4) AS tolerante"))
def _(spark, sf):
    p = profiled(spark, sf, "dirty_customer")
    return rows(spark, [(c, round(p.text[c]["plain_number"] / p.present(c), 4), round(p.text[c]["guided_number"] / p.text[c]["data"], 4)) for c in TEXTS],
                "columna string, estricta double, tolerante double")


@query("col_10_roles", """
SELECT * FROM (VALUES ('dirty_customer', 'id', 'id'), ('dirty_customer', 'nombre', 'texto'), ('dirty_customer', 'email', 'email'), ('dirty_customer', 'telefono', 'telefono'),
 ('dirty_customer', 'saldo', 'numerica'), ('dirty_customer', 'segmento', 'texto'), ('dirty_customer', 'estado', 'texto'), ('dirty_customer', 'nacion', 'numerica'),
 ('dirty_orders', 'id_pedido', 'id'), ('dirty_orders', 'id_cliente', 'id'), ('dirty_orders', 'fecha_pago', 'fecha'), ('dirty_orders', 'monto', 'numerica'), ('dirty_orders', 'prioridad', 'texto'),
 ('dirty_geo', 'latitud', 'coordenada'), ('dirty_geo', 'longitud', 'coordenada'), ('dirty_geo', 'nacion', 'numerica')) t(tabla, columna, rol)""")
def _(spark, sf):
    found = [(n, c, r) for n in ("dirty_customer", "dirty_orders", "dirty_geo") for c, r in profiled(spark, sf, n).roles.items()]
    return rows(spark, found, "tabla string, columna string, rol string")


@query("col_11_serial_numbers", """
SELECT 'num_engranaje' AS columna WHERE (SELECT count(*) FROM customer) >= 5""")
def _(spark, sf):
    df = table(spark, sf, "customer").select((F.col("c_custkey") + 10_000_000).alias("num_engranaje"), "c_acctbal", F.col("c_nationkey").alias("nivel"))
    return rows(spark, [(c,) for c in Profile(df).serial_by_content], "columna string")


@query("col_12_not_outlier_columns", """
SELECT * FROM (VALUES ('dirty_customer', 'id'), ('dirty_customer', 'telefono'), ('dirty_orders', 'id_pedido'), ('dirty_orders', 'id_cliente')) t(tabla, columna)""")
def _(spark, sf):
    found = [(n, c) for n in ("dirty_customer", "dirty_orders", "dirty_geo") for c in profiled(spark, sf, n).not_outlier_columns]
    return rows(spark, found, "tabla string, columna string")


_HEAVY = """SELECT '{c}' AS columna, skewness({c}) >= 2 AND min({c}) >= 0 AND count({c}) >= 30 AND count(DISTINCT {c}) >= 10
  AND avg(CASE WHEN {c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1) THEN 1.0 ELSE 0 END) >= 0.03 AS cola
  FROM {t}, (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM {t})"""


@query("col_13_heavy_tail", "WITH e AS (SELECT value, value * value * value AS cubo, event_id % 100 AS parejo FROM events) " + union_all([
    _HEAVY.replace("{c}", c).replace("{t}", "e") for c in ("value", "cubo", "parejo")]))
def _(spark, sf):
    v = F.col("value")
    df = table(spark, sf, "events").select("value", (v * v * v).alias("cubo"), (F.col("event_id") % 100).alias("parejo"))
    columns = ["value", "cubo", "parejo"]
    heavy = Profile(df).heavy_tailed(columns)
    return rows(spark, [(c, c in heavy) for c in columns], "columna string, cola boolean")


@query("col_14_bounded_scale", """
SELECT c AS columna, q3, CASE WHEN q3 <= 5 THEN 5 WHEN q3 <= 10 THEN 10 END AS techo FROM (
  SELECT 'l_linenumber' AS c, quantile_cont(l_linenumber, 0.75) AS q3 FROM lineitem UNION ALL SELECT 'l_quantity', quantile_cont(l_quantity, 0.75) FROM lineitem
  UNION ALL SELECT 'quejas', quantile_cont(l_orderkey % 11, 0.75) FROM lineitem)""")
def _(spark, sf):
    df = table(spark, sf, "lineitem").select("l_linenumber", "l_quantity", (F.col("l_orderkey") % 11).alias("quejas"))
    quart = Profile(df).quartiles(df.columns)
    return rows(spark, [(c, float(x[2]), bounded_scale(x[2])) for c, x in quart.items()], "columna string, q3 double, techo int")


@query("col_16_decimal_comma", """
SELECT * FROM (VALUES ('europea', true), ('inglesa', false), ('miles', false), ('proporcion', true)) t(columna, coma_decimal)""")
def _(spark, sf):
    price = F.format_number("l_extendedprice", 2)
    df = table(spark, sf, "lineitem").select(
        F.translate(price, ",.", ".,").alias("europea"), price.alias("inglesa"), F.format_number(F.col("l_extendedprice") * 1000, 0).alias("miles"),
        F.translate(F.col("l_discount").cast("string"), ".", ",").alias("proporcion"))
    p = Profile(df)
    return rows(spark, [(c, p.guided_comma(c)) for c in df.columns], "columna string, coma_decimal boolean")


_NP = ("cantidad", "l_linenumber", "total", "marca")


@query("col_17_numeric_profile", duck("dirty_lineitem") + ", d AS (SELECT *, l_orderkey % 2 AS marca FROM dirty_lineitem) " + union_all([
    f"SELECT '{c}' AS columna, count(DISTINCT {c}) = 2 AND bool_and({c} IN (0, 1)) AS binaria, bool_and({c} = floor({c})) AS entera, "
    f"bool_and({c} = floor({c})) AND count(DISTINCT {c}) <= 10 AS pocos_valores FROM d" for c in _NP]))
def _(spark, sf):
    df = dirty(spark, sf, "dirty_lineitem").withColumn("marca", F.col("l_orderkey") % 2)
    facts = S.numeric_profile(Profile(df, list(_NP)), list(_NP))
    return rows(spark, [(c, f["binaria"], f["entera"], f["pocos_valores"]) for c, f in facts.items()],
                "columna string, binaria boolean, entera boolean, pocos_valores boolean")


@query("col_18_text_to_standardise", "SELECT unnest(['email', 'segmento', 'estado']) AS columna")
def _(spark, sf):
    return rows(spark, [(c,) for c in profiled(spark, sf, "dirty_customer").text_columns], "columna string")


@query("col_19_never_filled", "SELECT unnest(['email', 'nombre']) AS columna")
def _(spark, sf):
    return rows(spark, [(c,) for c in sorted(profiled(spark, sf, "dirty_customer").never_filled)], "columna string")


@query("col_21_semantic_types", """
SELECT * FROM (VALUES ('id', 'Entero'), ('nombre', 'Texto'), ('email', 'Texto'), ('telefono', 'Texto (código)'), ('saldo', 'Decimal'),
 ('segmento', 'Categoría'), ('estado', 'Categoría'), ('nacion', 'Entero')) t(columna, tipo)""")
def _(spark, sf):
    df = dirty(spark, sf, "dirty_customer")
    d = Dictionary(df, [c for c in df.columns if c != ROW_ID])
    return rows(spark, list(d.types.items()), "columna string, tipo string")


# -- guided cleaning ----------------------------------------------------------------------------------------------
def _diagnosis(column: str, kind: str, role: str) -> str:
    return (f"SELECT '{column}' AS columna, '{kind}' AS tipo, '{role}' AS rol, count(*) FILTER (WHERE {null_of(f'CAST({column} AS VARCHAR)')} AND {column} IS NOT NULL) AS vacios_texto, "
            f"count(*) FILTER (WHERE {column} IS NULL) AS nulos_reales, count(*) AS n FROM dirty_customer")


@query("gui_01_null_diagnosis", duck("dirty_customer") + ", d AS (" + union_all([
    _diagnosis(*x) for x in (("id", "número", "identificador / llave"), ("nombre", "texto", "texto"), ("email", "texto", "email"), ("telefono", "texto", "teléfono"),
                             ("saldo", "texto", "número"), ("segmento", "texto", "texto"), ("estado", "texto", "texto"), ("nacion", "número", "número"))]) + """)
SELECT columna, tipo, rol, vacios_texto, nulos_reales, vacios_texto + nulos_reales AS total, round((vacios_texto + nulos_reales) * 100.0 / n, 2) AS porcentaje FROM d""")
def _(spark, sf):
    return S.null_diagnosis(profiled(spark, sf, "dirty_customer")).drop("semaforo", "orden")


@query("gui_02_null_like_texts", duck("dirty_geo") + """
SELECT 'sin dato' AS texto, count(*) AS celdas, 'latitud (' || count(*) || ')' AS columnas FROM dirty_geo WHERE latitud = 'sin dato'""")
def _(spark, sf):
    return S.null_like_texts(dirty(spark, sf, "dirty_geo"), ["latitud", "longitud"])


@query("gui_03_suggested_rules", duck("dirty_customer", "dirty_lineitem") + """
SELECT * FROM (VALUES ('email', 'no_indica', 'No indica'), ('saldo', 'mediana', ''), ('id', 'dejar', ''), ('cantidad', 'mediana', ''), ('total', 'dejar', '')) t(columna, regla, valor)""")
def _(spark, sf):
    found = []
    for n, wanted in (("dirty_customer", ("email", "saldo", "id")), ("dirty_lineitem", ("cantidad", "total"))):
        found += [(r["columna"], r["regla"], r["valor"]) for r in S.suggested_rules(profiled(spark, sf, n)) if r["columna"] in wanted]
    return rows(spark, found, "columna string, regla string, valor string")


@query("gui_04_snake_names", "SELECT c_custkey AS clave_cliente, c_name AS nombre_completo, c_name AS nombre_completo_2, c_acctbal AS saldo FROM customer")
def _(spark, sf):
    df = table(spark, sf, "customer").select(F.col("c_custkey").alias(" Clave  Cliente "), F.col("c_name").alias("Nombre (completo)"),
                                             F.col("c_name").alias("nombre completo"), F.col("c_acctbal").alias("Saldo!"))
    return S.apply_step(df, S.fit_names(df))


@query("gui_05_blanks_to_null", duck("dirty_customer") + f"""
SELECT _row_id, CASE WHEN NOT {null_of('email')} THEN email END AS email, CASE WHEN NOT {null_of('saldo')} THEN saldo END AS saldo FROM dirty_customer""")
def _(spark, sf):
    return S.apply_step(dirty(spark, sf, "dirty_customer"), S.fit_blanks(["email", "saldo"])).select("_row_id", "email", "saldo")


@query("gui_06_standard_text", duck("dirty_customer") + """
SELECT _row_id, trim(nombre) AS nombre, lower(trim(estado)) AS estado, lower(segmento) AS segmento FROM dirty_customer""")
def _(spark, sf):
    df = S.apply_step(dirty(spark, sf, "dirty_customer"), S.fit_text(["estado", "segmento"]))
    return S.apply_step(df, S.fit_text(["nombre"], lower=False)).select("_row_id", "nombre", "estado", "segmento")


@query("gui_07_to_numeric", duck("dirty_customer") + f"SELECT _row_id, {MONEY} AS saldo FROM dirty_customer")
def _(spark, sf):
    p = profiled(spark, sf, "dirty_customer")
    return S.apply_step(p.df, S.fit_numbers(p, ["saldo"])).select("_row_id", "saldo")


@query("gui_07_values_lost", duck("dirty_customer") + f"""
SELECT 'saldo' AS columna, count(*) FILTER (WHERE NOT {null_of('saldo')}) AS con_dato, count({MONEY}) AS leidos,
  count(*) FILTER (WHERE NOT {null_of('saldo')}) - count({MONEY}) AS perdidos FROM dirty_customer""")
def _(spark, sf):
    return S.numbers_lost(profiled(spark, sf, "dirty_customer"), ["saldo"])


_AXIS = """
n AS (SELECT *, TRY_CAST(replace(trim(latitud), ',', '.') AS DOUBLE) AS lat, TRY_CAST(replace(trim(longitud), ',', '.') AS DOUBLE) AS lon FROM dirty_geo),
f AS (SELECT round(quantile_cont(lat, 0.5) FILTER (WHERE abs(lat) <= 90), 6) AS rlat, round(quantile_cont(lon, 0.5) FILTER (WHERE abs(lon) <= 180), 6) AS rlon FROM n),
c AS (SELECT _row_id, arg_min(lat / power(10.0, k), abs(lat / power(10.0, k) - rlat)) FILTER (WHERE abs(lat / power(10.0, k)) <= 90) AS lat2,
  arg_min(lon / power(10.0, k), abs(lon / power(10.0, k) - rlon)) FILTER (WHERE abs(lon / power(10.0, k)) <= 180) AS lon2 FROM n, f, range(12) r(k) GROUP BY _row_id),
g AS (SELECT n._row_id, latitud, lat, lon, CASE WHEN abs(lat) <= 90 THEN lat ELSE lat2 END AS flat, CASE WHEN abs(lon) <= 180 THEN lon ELSE lon2 END AS flon FROM n LEFT JOIN c USING (_row_id))"""


@query("gui_08_coordinates", duck("dirty_geo") + "," + _AXIS + "SELECT _row_id, round(flat, 6) AS latitud, round(flon, 6) AS longitud FROM g")
def _(spark, sf):
    df = dirty(spark, sf, "dirty_geo")
    out = S.apply_step(df, S.fit_coordinates(df, "latitud", "longitud"))
    return out.select("_row_id", F.round("latitud", 6).alias("latitud"), F.round("longitud", 6).alias("longitud"))


@query("gui_08_coordinate_report", duck("dirty_geo") + "," + _AXIS + """
SELECT 'latitud' AS columna, count(*) FILTER (WHERE abs(lat) > 90) AS fuera_de_rango, count(*) FILTER (WHERE abs(lat) > 90 AND flat IS NOT NULL) AS rescatados, count(*) FILTER (WHERE flat IS NULL) AS sin_arreglo FROM g
UNION ALL SELECT 'longitud', count(*) FILTER (WHERE abs(lon) > 180), count(*) FILTER (WHERE abs(lon) > 180 AND flon IS NOT NULL), count(*) FILTER (WHERE flon IS NULL) FROM g""")
def _(spark, sf):
    df = dirty(spark, sf, "dirty_geo")
    return S.coordinate_report(df, S.fit_coordinates(df, "latitud", "longitud"))


@query("gui_09_dates_one_format", duck("dirty_orders") + f"SELECT _row_id, strftime({DATE}, '%Y-%m-%d') AS fecha_pago FROM dirty_orders")
def _(spark, sf):
    df = dirty(spark, sf, "dirty_orders")
    return S.apply_step(df, S.fit_dates(df, ["fecha_pago"])).select("_row_id", "fecha_pago")


@query("gui_09_date_report", duck("dirty_orders") + f"""
SELECT 'fecha_pago' AS columna, count(DISTINCT regexp_replace(regexp_replace(fecha_pago, '[0-9]', '9', 'g'), '[A-Za-z]+', 'a', 'g')) AS formas,
  count(*) FILTER (WHERE {DATE} IS NULL) AS ilegibles, 0 AS ambiguas FROM dirty_orders""")
def _(spark, sf):
    df = dirty(spark, sf, "dirty_orders")
    return S.date_report(df, S.fit_dates(df, ["fecha_pago"]))


@query("gui_10_filters", duck("dirty_customer") + f"""
SELECT _row_id, saldo FROM dirty_customer WHERE coalesce({MONEY} >= 100, false) AND coalesce(lower(trim(estado)) <> 'activo', true)""")
def _(spark, sf):
    df = dirty(spark, sf, "dirty_customer")
    return S.apply_step(df, S.fit_filters(df, ["saldo>=100", "estado!=Activo"])).select("_row_id", "saldo")


@query("gui_11_drop_duplicates", duck("dirty_customer") + """
SELECT min(_row_id) AS _row_id, id, nombre, telefono FROM (SELECT _row_id, id, lower(trim(nombre)) AS nombre, telefono FROM dirty_customer) GROUP BY id, nombre, telefono""")
def _(spark, sf):
    df = S.apply_step(dirty(spark, sf, "dirty_customer").select("_row_id", "id", "nombre", "telefono"), S.fit_text(["nombre"]))
    return S.apply_step(df, {"tipo": "duplicados", "ignorar": ["_row_id"]})


_LIM = """
f AS (SELECT quantile_cont(precio_unitario, 0.25) AS q1, quantile_cont(precio_unitario, 0.75) AS q3 FROM dirty_lineitem),
k AS (SELECT round(q3 + 1.5 * (q3 - q1), 6) AS tope, greatest(0, round(q1 - 1.5 * (q3 - q1), 6)) AS piso FROM f)"""


def _limits(spark, sf, action):
    df = dirty(spark, sf, "dirty_lineitem").select("_row_id", "l_partkey", "cantidad", "precio_unitario")
    p = Profile(df, ["cantidad", "precio_unitario"])
    return df, S.fit_limits(p, True, ["precio_unitario"], 1.5, action)


@query("gui_12_limits_rule", duck("dirty_lineitem") + "," + _LIM + """
SELECT 'cantidad' AS columna, 0.0 AS minimo, NULL::DOUBLE AS maximo UNION ALL SELECT 'precio_unitario', CAST(printf('%.4f', piso) AS DOUBLE), CAST(printf('%.4f', tope) AS DOUBLE) FROM k""")
def _(spark, sf):
    step = _limits(spark, sf, "nulo")[1]
    return rows(spark, [(c, None if lo is None else round(float(lo), 4), None if hi is None else round(float(hi), 4)) for c, (lo, hi) in step["limites"].items()],
                "columna string, minimo double, maximo double")


@query("gui_13_limits_null", duck("dirty_lineitem") + "," + _LIM + """
SELECT _row_id, l_partkey, CASE WHEN cantidad >= 0 THEN cantidad END AS cantidad, CASE WHEN precio_unitario BETWEEN piso AND tope THEN precio_unitario END AS precio_unitario FROM dirty_lineitem, k""")
def _(spark, sf):
    return S.apply_step(*_limits(spark, sf, "nulo"))


@query("gui_13_limits_clip", duck("dirty_lineitem") + "," + _LIM + """
SELECT _row_id, l_partkey, CASE WHEN cantidad < 0 THEN 0 ELSE cantidad END AS cantidad, round(CASE WHEN precio_unitario > tope THEN tope WHEN precio_unitario < piso THEN piso ELSE precio_unitario END, 4) AS precio_unitario FROM dirty_lineitem, k""")
def _(spark, sf):
    return S.apply_step(*_limits(spark, sf, "limitar")).withColumn("precio_unitario", F.round("precio_unitario", 4))


@query("gui_13_limits_drop_and_mark", duck("dirty_lineitem") + "," + _LIM + """
SELECT 'eliminar_fila' AS accion, count(*) FILTER (WHERE NOT coalesce(cantidad < 0 OR precio_unitario NOT BETWEEN piso AND tope, false)) AS filas, 0 AS marcadas FROM dirty_lineitem, k
UNION ALL SELECT 'marcar', count(*), count(*) FILTER (WHERE cantidad < 0) + count(*) FILTER (WHERE precio_unitario NOT BETWEEN piso AND tope) FROM dirty_lineitem, k""")
def _(spark, sf):
    dropped = S.apply_step(*_limits(spark, sf, "eliminar_fila")).agg(F.lit("eliminar_fila").alias("accion"), F.count(F.lit(1)).alias("filas"), F.lit(0).cast("long").alias("marcadas"))
    marked = S.apply_step(*_limits(spark, sf, "marcar"))
    return dropped.unionByName(marked.agg(F.lit("marcar").alias("accion"), F.count(F.lit(1)).alias("filas"),
                                          F.sum(F.col("cantidad_atipico").cast("long") + F.col("precio_unitario_atipico").cast("long")).alias("marcadas")))


_BROKEN = "coalesce(abs(total - cantidad * precio_unitario) > greatest(abs(cantidad * precio_unitario) * 0.01, 0.01), false)"


def _formula(spark, sf, action):
    df = dirty(spark, sf, "dirty_lineitem").select("_row_id", "l_partkey", "cantidad", "precio_unitario", "total")
    return S.apply_step(df, S.fit_formula(Profile(df, ["cantidad", "precio_unitario", "total"]), action))


@query("gui_14_formula_mark", duck("dirty_lineitem") + f"SELECT _row_id, l_partkey, {_BROKEN} AS total_revisar FROM dirty_lineitem")
def _(spark, sf):
    return _formula(spark, sf, "marcar").select("_row_id", "l_partkey", "total_revisar")


@query("gui_14_formula_recompute", duck("dirty_lineitem") + f"SELECT _row_id, l_partkey, round(CASE WHEN {_BROKEN} THEN round(cantidad * precio_unitario, 2) ELSE total END, 2) AS total FROM dirty_lineitem")
def _(spark, sf):
    return _formula(spark, sf, "recalcular").select("_row_id", "l_partkey", F.round("total", 2).alias("total"))


@query("gui_14_formula_drop", duck("dirty_lineitem") + f"SELECT _row_id, l_partkey, total FROM dirty_lineitem WHERE NOT {_BROKEN}")
def _(spark, sf):
    return _formula(spark, sf, "eliminar_fila").select("_row_id", "l_partkey", "total")


@query("gui_15_derived_columns", """
SELECT l_orderkey, l_linenumber, l_partkey, round(l_extendedprice * (1 - l_discount), 4) AS neto, round(l_extendedprice * (1 - l_discount) * (1 + l_tax) / l_quantity + 1e-7, 4) AS por_unidad FROM lineitem""")
def _(spark, sf):
    step = S.fit_derived(table(spark, sf, "lineitem"), ["neto = [l_extendedprice] * (1 - [l_discount])", "por_unidad = [neto] * (1 + [L Tax]) / [l_quantity]"])
    out = S.apply_step(table(spark, sf, "lineitem"), step)
    return out.select("l_orderkey", "l_linenumber", "l_partkey", F.round("neto", 4).alias("neto"), F.round(F.col("por_unidad") + 1e-7, 4).alias("por_unidad"))


_EQUIV = """
v AS (SELECT segmento AS valor, count(*) AS filas FROM dirty_customer GROUP BY 1),
m AS (SELECT upper(valor) AS u, arg_max(valor, filas) AS principal, max(filas) AS mayor FROM v GROUP BY 1),
t AS (SELECT valor, filas, CASE WHEN valor = 'HOUSEHOLDD' AND filas <= greatest(3, 0.1 * (SELECT mayor FROM m WHERE u = 'HOUSEHOLD')) THEN 'HOUSEHOLD'
  WHEN valor <> principal THEN principal ELSE '' END AS unificar_a FROM v JOIN m ON upper(valor) = u)"""


@query("gui_16_suggest_equivalences", duck("dirty_customer") + "," + _EQUIV + "SELECT 'segmento' AS columna, valor, filas, unificar_a FROM t")
def _(spark, sf):
    return suggest_equivalences(profiled(spark, sf, "dirty_customer")).filter("columna = 'segmento'")


@query("gui_17_unify_values", duck("dirty_customer") + "," + _EQUIV + """
SELECT _row_id, CASE WHEN unificar_a <> '' THEN unificar_a ELSE segmento END AS segmento FROM dirty_customer JOIN t ON segmento = valor""")
def _(spark, sf):
    p = profiled(spark, sf, "dirty_customer")
    found = [r.asDict() for r in suggest_equivalences(p, ["segmento"]).collect()]
    return S.apply_step(p.df, S.fit_equivalences(found)).select("_row_id", "segmento")


def _ruled(spark, sf, name, keep, *rules_):
    df = dirty(spark, sf, name).select(*keep)
    for r in rules_:
        df = S.apply_step(df, S.fit_rule(df, *r))
    return df


@query("gui_18_leave_drop_column_drop_row", duck("dirty_customer") + f"SELECT _row_id, email FROM dirty_customer WHERE NOT {null_of('saldo')}")
def _(spark, sf):
    return _ruled(spark, sf, "dirty_customer", ["_row_id", "email", "saldo", "estado"], ("email", "dejar"), ("estado", "eliminar_columna"), ("saldo", "eliminar_fila")).drop("saldo")


@query("gui_19_fill_values", duck("dirty_customer") + f"""
SELECT _row_id, CASE WHEN {null_of('email')} THEN 'No indica' ELSE email END AS email, CASE WHEN {null_of('saldo')} THEN '0' ELSE saldo END AS saldo FROM dirty_customer""")
def _(spark, sf):
    return _ruled(spark, sf, "dirty_customer", ["_row_id", "email", "saldo"], ("email", "no_indica"), ("saldo", "cero"))


@query("gui_19_fill_mode_and_fixed", duck("dirty_lineitem") + """,
t AS (SELECT arg_min(cantidad, struct_pack(a := -n, b := cantidad)) AS moda FROM (SELECT cantidad, count(*) AS n FROM dirty_lineitem WHERE cantidad IS NOT NULL GROUP BY 1))
SELECT _row_id, l_partkey, CAST(coalesce(cantidad, moda) AS DOUBLE) AS moda, CAST(coalesce(cantidad, 7) AS DOUBLE) AS fijo FROM dirty_lineitem, t""")
def _(spark, sf):
    df = dirty(spark, sf, "dirty_lineitem").select("_row_id", "l_partkey", F.col("cantidad").alias("moda"), F.col("cantidad").alias("fijo"))
    for r in (("moda", "moda"), ("fijo", "valor_fijo", "7")):
        df = S.apply_step(df, S.fit_rule(df, *r))
    return df.withColumns({c: F.col(c).cast("double") for c in ("moda", "fijo")})


@query("gui_20_fill_median_mean", duck("dirty_lineitem", "dirty_customer") + f""",
a AS (SELECT round(avg(cantidad), 2) AS media FROM dirty_lineitem), b AS (SELECT round(quantile_cont({MONEY}, 0.5), 2) AS mediana FROM dirty_customer)
SELECT 'cantidad' AS columna, _row_id, round(coalesce(cantidad, media), 4) AS valor FROM dirty_lineitem, a
UNION ALL SELECT 'saldo', _row_id, round(coalesce({MONEY}, mediana), 4) FROM dirty_customer, b""")
def _(spark, sf):
    a = _ruled(spark, sf, "dirty_lineitem", ["_row_id", "cantidad"], ("cantidad", "media"))
    b = _ruled(spark, sf, "dirty_customer", ["_row_id", "saldo"], ("saldo", "mediana"))
    return a.select(F.lit("cantidad").alias("columna"), "_row_id", F.round("cantidad", 4).alias("valor")).unionByName(
        b.select(F.lit("saldo").alias("columna"), "_row_id", F.round("saldo", 4).alias("valor")))


@query("gui_21_group_median", duck("dirty_customer") + f""",
g AS (SELECT nacion, CAST(printf('%.2f', quantile_cont({MONEY}, 0.5)) AS DOUBLE) AS m FROM dirty_customer GROUP BY nacion), t AS (SELECT CAST(printf('%.2f', quantile_cont({MONEY}, 0.5)) AS DOUBLE) AS m FROM dirty_customer)
SELECT _row_id, nacion, round(coalesce({MONEY}, g.m, t.m), 4) AS saldo FROM dirty_customer JOIN g USING (nacion), t""")
def _(spark, sf):
    out = _ruled(spark, sf, "dirty_customer", ["_row_id", "nacion", "saldo"], ("saldo", "mediana_por_grupo", "", "nacion"))
    return out.withColumn("saldo", F.round("saldo", 4))


@query("gui_22_closing_fill", duck("dirty_customer") + f""",
b AS (SELECT round(quantile_cont({MONEY}, 0.5), 2) AS mediana FROM dirty_customer)
SELECT _row_id, CASE WHEN {null_of('email')} THEN 'No indica' ELSE email END AS email, round(coalesce({MONEY}, mediana), 4) AS saldo FROM dirty_customer, b""")
def _(spark, sf):
    df = dirty(spark, sf, "dirty_customer").select("_row_id", "email", "saldo")
    return S.apply_step(df, S.fit_closing(Profile(df, ["email", "saldo"]))).withColumn("saldo", F.round("saldo", 4))


@query("gui_23_typed_dates", duck("dirty_orders") + f"SELECT _row_id, {DATE} AS fecha_pago FROM dirty_orders")
def _(spark, sf):
    df = dirty(spark, sf, "dirty_orders").select("_row_id", "fecha_pago")
    df = S.apply_step(df, S.fit_dates(df, ["fecha_pago"]))
    return S.apply_step(df, S.fit_typed_dates(["fecha_pago"]))


@query("gui_24_date_parts", duck("dirty_orders") + f"""
SELECT _row_id, strftime({DATE}, '%Y-%m-%d') AS fecha_pago, CAST(month({DATE}) AS INTEGER) AS fecha_pago_mes, CAST(year({DATE}) AS INTEGER) AS fecha_pago_anio FROM dirty_orders""")
def _(spark, sf):
    df = dirty(spark, sf, "dirty_orders").select("_row_id", "fecha_pago")
    df = S.apply_step(df, S.fit_dates(df, ["fecha_pago"]))
    return S.apply_step(df, S.fit_date_parts(df, ["fecha_pago"]))


def _orders_recipe(df):
    return R.fit(df, R.configure(df, ignore=[ROW_ID]))


_CLEAN_ORDERS = f"""SELECT _row_id, id_pedido, id_cliente, coalesce(strftime({DATE}, '%Y-%m-%d'), 'No indica') AS fecha_pago, monto, lower(prioridad) AS prioridad FROM dirty_orders"""


@query("gui_25_run_all_steps", duck("dirty_orders") + "\n" + _CLEAN_ORDERS)
def _(spark, sf):
    df = dirty(spark, sf, "dirty_orders")
    return R.apply(df, _orders_recipe(df))


@query("gui_26_final_audit", duck("dirty_orders") + f"""
SELECT 'filas' AS medida, count(*) AS antes, count(*) AS despues FROM dirty_orders UNION ALL SELECT 'columnas', 5, 5 UNION ALL SELECT 'duplicados', 0, 0
UNION ALL SELECT 'nulos', 0, count(*) FILTER (WHERE {DATE} IS NULL) FROM dirty_orders""")
def _(spark, sf):
    df = dirty(spark, sf, "dirty_orders").drop("_row_id")
    return S.final_audit(df, S.apply_step(df, S.fit_dates(df, ["fecha_pago"])))


@query("gui_27_recipe_replay", duck("dirty_orders") + "\n" + _CLEAN_ORDERS)
def _(spark, sf):
    df = dirty(spark, sf, "dirty_orders")
    return R.apply(df, R.from_json(R.to_json(_orders_recipe(df))))


@query("gui_27_recipe_stream", duck("dirty_orders") + "\n" + _CLEAN_ORDERS)
def _(spark, sf):
    """The orders arrive as files; the frozen recipe cleans them as a stream, and the sink is read back."""
    df = dirty(spark, sf, "dirty_orders")
    source, target, checkpoint = (fresh_path(spark, x) for x in ("entrada", "limpio", "control"))
    df.write.parquet(source)
    replay_files(spark, source, df.schema, _orders_recipe(df), target, checkpoint).awaitTermination()
    return spark.read.parquet(target)
