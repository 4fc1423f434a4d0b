"""Scalar functions over whole tables."""

from pyspark.sql import functions as F

from sparkscrub.functions import dates, keys, numbers, rules, text
from sparkscrub.functions import vocab as V
from sparkscrub.operators.variants import spelling_variants
from sparkscrub.plans.profile import unpivot

from .base import query, quoted, union_all
from .fixtures import dirty, duck, table

TOKENS = quoted(V.NULL_TOKENS)


@query("fn_01_is_null", duck("dirty_customer") + f"""
SELECT _row_id, coalesce(saldo IS NULL OR lower(trim(saldo)) IN ({TOKENS}), false) AS nulo FROM dirty_customer""")
def _(spark, sf):
    return dirty(spark, sf, "dirty_customer").select("_row_id", text.is_null(F.col("saldo")).alias("nulo"))


@query("fn_02_is_blank", duck("dirty_customer") + """
SELECT _row_id, email IS NULL OR trim(email) = '' AS vacio FROM dirty_customer""")
def _(spark, sf):
    return dirty(spark, sf, "dirty_customer").select("_row_id", text.is_blank(F.col("email")).alias("vacio"))


@query("fn_03_parse_number", """
SELECT l_orderkey, l_linenumber, l_partkey, round(l_extendedprice, 2) AS valor FROM lineitem""")
def _(spark, sf):
    money = F.concat(F.lit("₡ "), F.format_number("l_extendedprice", 2))
    df = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", money.alias("t"))
    return df.select("l_orderkey", "l_linenumber", "l_partkey", numbers.parse_number(F.col("t")).alias("valor"))


@query("fn_04_parse_number_lenient", """
SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_orderkey % 7 <> 0 THEN round(l_extendedprice, 2) END AS valor FROM lineitem""")
def _(spark, sf):
    european = F.translate(F.format_number("l_extendedprice", 2), ",.", ".,")
    t = F.when(F.col("l_orderkey") % 7 == 0, F.concat(F.lit("P"), european)).otherwise(F.concat(F.lit("EUR "), european, F.lit(" *")))
    df = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", t.alias("t"))
    return df.select("l_orderkey", "l_linenumber", "l_partkey", numbers.parse_number_lenient(F.col("t")).alias("valor"))


@query("fn_05_coordinate", duck("dirty_geo") + """
SELECT _row_id, TRY_CAST(replace(trim(latitud), ',', '.') AS DOUBLE) AS latitud FROM dirty_geo""")
def _(spark, sf):
    return dirty(spark, sf, "dirty_geo").select("_row_id", numbers.coordinate(F.col("latitud")).alias("latitud"))


@query("fn_06_rescue_coordinate", duck("dirty_geo") + """,
n AS (SELECT _row_id, TRY_CAST(replace(trim(latitud), ',', '.') AS DOUBLE) AS v FROM dirty_geo),
c AS (SELECT _row_id, v, k, v / power(10.0, k) AS x FROM n CROSS JOIN range(12) r(k)),
b AS (SELECT _row_id, arg_min(x, struct_pack(d := abs(x - 9.15), k := k)) AS x FROM c WHERE x BETWEEN -90 AND 90 GROUP BY _row_id)
SELECT n._row_id, round(CASE WHEN n.v BETWEEN -90 AND 90 THEN n.v ELSE b.x END, 6) AS latitud FROM n LEFT JOIN b USING (_row_id)""")
def _(spark, sf):
    v = numbers.rescue_coordinate(numbers.coordinate(F.col("latitud")), -90.0, 90.0, 9.15)
    return dirty(spark, sf, "dirty_geo").select("_row_id", F.round(v, 6).alias("latitud"))


@query("fn_08_clean_text", duck("dirty_customer") + r"""
SELECT _row_id, regexp_replace(lower(trim(trim(trim(nombre), '"'))), '\s+', ' ', 'g') AS nombre,
  regexp_replace(lower(trim(trim(trim(estado), '"'))), '\s+', ' ', 'g') AS estado FROM dirty_customer""")
def _(spark, sf):
    return dirty(spark, sf, "dirty_customer").select(
        "_row_id", text.clean_text(F.col("nombre")).alias("nombre"), text.clean_text(F.col("estado")).alias("estado"))


@query("fn_09_proper_case", duck("dirty_customer") + r"""
SELECT _row_id, regexp_extract(nombre, '^\s*') || upper(substr(trim(nombre), 1, 1)) || lower(substr(trim(nombre), 2))
  || regexp_extract(nombre, '\s*$') AS nombre FROM dirty_customer""")
def _(spark, sf):
    return dirty(spark, sf, "dirty_customer").select("_row_id", text.proper_case(F.col("nombre")).alias("nombre"))


@query("fn_10_fold", r"""
SELECT doc_id, md5(trim(regexp_replace(strip_accents(lower(text)), '\s+', ' ', 'g'))) AS huella FROM documents""")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(text.fold(F.col("text"))).alias("huella"))


@query("fn_11_alnum_key", r"""
SELECT doc_id, md5(trim(regexp_replace(regexp_replace(strip_accents(lower(text)), '[^\x00-\x7f]', '', 'g'), '[^a-z0-9]+', ' ', 'g'))) AS huella
FROM documents""")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(text.alnum_key(F.col("text"))).alias("huella"))


_DATE = "coalesce(try_strptime(fecha_pago, '%Y-%m-%d'), try_strptime(fecha_pago, '%d/%m/%Y'))"


@query("fn_12_unify_dates", duck("dirty_orders") + f"""
SELECT _row_id, strftime({_DATE}, '%d/%m/%Y') AS fecha FROM dirty_orders""")
def _(spark, sf):
    df = dirty(spark, sf, "dirty_orders")
    row = df.agg(*[e.alias(k) for k, e in dates.day_month_evidence(F.col("fecha_pago")).items()]).first().asDict()
    seps = dates.day_first_separators(row)
    return df.select("_row_id", dates.unify_dates(F.col("fecha_pago"), "%d/%m/%Y", seps).alias("fecha"))


@query("fn_13_text_to_date", duck("dirty_orders") + """
SELECT _row_id, try_strptime(fecha_pago, '%Y-%m-%d') AS fecha FROM dirty_orders""")
def _(spark, sf):
    return dirty(spark, sf, "dirty_orders").select("_row_id", dates.text_to_date(F.col("fecha_pago")).alias("fecha"))


@query("fn_14_month_year", duck("dirty_orders") + """
SELECT _row_id, CAST(month(try_strptime(fecha_pago, '%d/%m/%Y')) AS INTEGER) AS mes,
  CAST(year(try_strptime(fecha_pago, '%d/%m/%Y')) AS INTEGER) AS anio FROM dirty_orders""")
def _(spark, sf):
    month, year = dates.month_and_year(F.col("fecha_pago"), "%d/%m/%Y")
    return dirty(spark, sf, "dirty_orders").select("_row_id", month.alias("mes"), year.alias("anio"))


@query("fn_15_pending_date", duck("dirty_orders") + f"""
SELECT _row_id, lower(strip_accents(trim(fecha_pago))) IN ({quoted(V.PENDING_DATE_VALUES)}) AS pendiente FROM dirty_orders""")
def _(spark, sf):
    return dirty(spark, sf, "dirty_orders").select("_row_id", text.pending_date(F.col("fecha_pago")).alias("pendiente"))


@query("fn_16_valid_state", duck("dirty_customer") + """
SELECT _row_id, lower(strip_accents(trim(estado))) IN ('activo', 'inactivo', 'pendiente') AS valido FROM dirty_customer""")
def _(spark, sf):
    return dirty(spark, sf, "dirty_customer").select("_row_id", text.valid_state(F.col("estado")).alias("valido"))


@query("fn_17_normalize_key", duck("dirty_orders") + r"""
SELECT _row_id, CASE WHEN length(k) < 6 THEN lpad(k, 6, '0') ELSE k END AS codigo, lower(trim(id_cliente)) AS llave FROM (
  SELECT _row_id, id_cliente, regexp_replace(regexp_replace(trim(id_cliente), '\.0+$', ''), '[^0-9]', '', 'g') AS k FROM dirty_orders)""")
def _(spark, sf):
    c = F.col("id_cliente")
    return dirty(spark, sf, "dirty_orders").select("_row_id", keys.normalize_key(c, "codigo", 6).alias("codigo"),
                                                   keys.normalize_key(c).alias("llave"))


@query("fn_18_flexible_key", duck("dirty_customer") + """
SELECT _row_id, ltrim(telefono, '0') AS telefono, CAST(id AS VARCHAR) AS id FROM (
  SELECT _row_id, id, CASE WHEN telefono = '12-34' THEN '12-34' ELSE '00' || telefono END AS telefono FROM dirty_customer)""")
def _(spark, sf):
    padded = F.when(F.col("telefono") == "12-34", F.col("telefono")).otherwise(F.concat(F.lit("00"), "telefono", F.lit(".0")))
    return dirty(spark, sf, "dirty_customer").select("_row_id", keys.flexible_key(padded).alias("telefono"),
                                                     keys.flexible_key(F.col("id")).alias("id"))


_WORDS = ["household", "machinery", "furniture", "automobile", "building"]


@query("fn_19_one_edit", duck("dirty_customer") + f"""
SELECT _row_id, w AS palabra, damerau_levenshtein(lower(segmento), w) = 1 AND left(lower(segmento), 1) = left(w, 1) AS tipeo
FROM dirty_customer CROSS JOIN (SELECT unnest([{quoted(_WORDS)}]) AS w) ws""")
def _(spark, sf):
    words = F.explode(F.array(*[F.lit(w) for w in _WORDS])).alias("palabra")
    df = dirty(spark, sf, "dirty_customer").select("_row_id", F.lower("segmento").alias("s"), words)
    return df.select("_row_id", "palabra", text.one_edit_typo(F.col("s"), F.col("palabra")).alias("tipeo"))


@query("fn_20_similarity_clusters")
def _(spark, sf):
    """Spellings of part types and priorities drawn together by similarity ratio (no SQL counterpart)."""
    return spelling_variants(table(spark, sf, "part").select("p_type", "p_brand"), ["p_type", "p_brand"], 0.85)


@query("fn_21_mask", duck("dirty_customer") + """
SELECT _row_id, regexp_replace(telefono, '[0-9]', '9', 'g') AS telefono,
  regexp_replace(regexp_replace(regexp_replace(trim(nombre), '[0-9]', '9', 'g'), '[A-Z]', 'A', 'g'), '[a-z]', 'a', 'g') AS nombre
FROM dirty_customer""")
def _(spark, sf):
    return dirty(spark, sf, "dirty_customer").select("_row_id", text.mask(F.col("telefono")).alias("telefono"),
                                                     text.mask(text.strip(F.col("nombre"))).alias("nombre"))


@query("fn_22_traffic_lights", duck("dirty_customer") + """
SELECT nacion, round(pct, 2) AS pct,
  CASE WHEN pct = 0 THEN '✅' WHEN pct < 5 THEN '🟢' WHEN pct < 30 THEN '🟡' WHEN pct < 70 THEN '🟠' ELSE '🔴' END AS luz_nulos,
  CASE WHEN 100 - pct >= 95 THEN '✅' WHEN 100 - pct >= 80 THEN '🟢' WHEN 100 - pct >= 50 THEN '🟡' ELSE '🔴' END AS luz_pareja
FROM (SELECT nacion, 100.0 * count(*) FILTER (WHERE email = '' OR saldo = 'n/a') / count(*) AS pct FROM dirty_customer GROUP BY nacion)""")
def _(spark, sf):
    bad = text.is_null(F.col("email")) | text.is_null(F.col("saldo"))
    pct = dirty(spark, sf, "dirty_customer").groupBy("nacion").agg((F.count_if(bad) * 100.0 / F.count(F.lit(1))).alias("p"))
    return pct.select("nacion", F.round("p", 2).alias("pct"), rules.null_light(F.col("p")).alias("luz_nulos"),
                      rules.match_light(100 - F.col("p")).alias("luz_pareja"))


def _decimals(column: str) -> str:
    tests = " ".join(f"WHEN bool_and(round({column}, {d}) = {column}) THEN {d}" for d in range(7))
    return f"SELECT '{column}' AS columna, CAST(CASE {tests} ELSE 6 END AS INTEGER) AS decimales FROM lineitem"


_NUMBERS = ("l_quantity", "l_extendedprice", "l_discount")


@query("fn_23_decimals_in_use", union_all([_decimals(c) for c in _NUMBERS]))
def _(spark, sf):
    cells = unpivot(table(spark, sf, "lineitem"), {c: F.col(c) for c in _NUMBERS})
    return cells.groupBy("columna").agg(numbers.decimals_in_use(F.col("v")).alias("decimales"))


@query("fn_24_derived_column", """
SELECT l_orderkey, l_linenumber, l_partkey, round(l_extendedprice * (1 - l_discount), 4) AS neto,
  round(CASE WHEN l_discount <> 0 THEN l_tax / l_discount END, 4) AS razon,
  round(sqrt(l_quantity) + power(l_tax, 2), 4) AS mezcla FROM lineitem""")
def _(spark, sf):
    df = table(spark, sf, "lineitem")
    made = {"neto": "[l_extendedprice] * (1 - [l_discount])", "razon": "[l_tax] / [l_discount]",
            "mezcla": "sqrt([l_quantity]) + [l_tax] ** 2"}
    return df.select("l_orderkey", "l_linenumber", "l_partkey",
                     *[F.round(rules.derived_column(df, e), 4).alias(n) for n, e in made.items()])


@query("fn_25_row_filter", duck("dirty_lineitem") + """
SELECT _row_id, l_partkey, total FROM dirty_lineitem
WHERE coalesce(cantidad <> 7, true) AND coalesce(total > 1000, false) AND lower(l_returnflag) = 'r'""")
def _(spark, sf):
    df = dirty(spark, sf, "dirty_lineitem")
    for f in ("cantidad!=7", "total>1000", "l_returnflag==R"):
        df = df.filter(rules.filter_condition(df, *rules.parse_filter(f)))
    return df.select("_row_id", "l_partkey", "total")


@query("fn_26_date_separator", duck("dirty_orders") + """
SELECT _row_id, CASE WHEN contains(fecha_pago, '-') AND NOT contains(fecha_pago, '/') THEN '-'
  WHEN contains(fecha_pago, '/') AND NOT contains(fecha_pago, '-') THEN '/' END AS separador FROM dirty_orders""")
def _(spark, sf):
    return dirty(spark, sf, "dirty_orders").select("_row_id", dates.separator(F.col("fecha_pago")).alias("separador"))
