"""A declared dimensional model: validation, key checks and loading."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .rows import q


def validate_model(model: dict, tables: dict[str, DataFrame]) -> list[str]:
    """MOD-1: missing tables, key columns that do not exist, references to unknown tables or columns."""
    errors = []
    for name, spec in model.items():
        df = tables.get(spec.get("hoja"))
        if df is None:
            errors.append(f"'{name}': la tabla de origen '{spec.get('hoja')}' no fue cargada")
            continue
        pk = spec.get("clave_primaria")
        if pk and pk not in df.columns:
            errors.append(f"'{name}': la llave primaria '{pk}' no existe")
        for fk in spec.get("claves_foraneas", []):
            if fk["columna"] not in df.columns:
                errors.append(f"'{name}': la columna FK '{fk['columna']}' no existe")
            target = model.get(fk["tabla_referencia"])
            if target is None:
                errors.append(f"'{name}': referencia a '{fk['tabla_referencia']}', que no está en el modelo")
                continue
            other = tables.get(target.get("hoja"))
            if other is not None and fk["columna_referencia"] not in other.columns:
                errors.append(f"'{name}': la FK apunta a '{fk['columna_referencia']}' de '{fk['tabla_referencia']}', que no existe")
    return errors


def is_fact(spec: dict) -> bool:
    return bool(spec.get("claves_foraneas"))


def table_kinds(model: dict) -> dict[str, str]:
    """MOD-4: facts have foreign keys; a referenced table with foreign keys of its own is a snowflake dimension."""
    referenced = {fk["tabla_referencia"] for s in model.values() for fk in s.get("claves_foraneas", [])}
    return {n: ("dimensión copo de nieve" if n in referenced else "hecho") if is_fact(s) else "dimensión" for n, s in model.items()}


def bad_primary_keys(df: DataFrame, key: str) -> DataFrame:
    """MOD-2: (clave, filas, problema) of null or repeated keys; repeats combine before the shuffle."""
    counts = df.groupBy(q(key).cast("string").alias("clave")).agg(F.count(F.lit(1)).alias("filas"))
    return counts.filter(F.col("clave").isNull() | (F.col("filas") > 1)).withColumn(
        "problema", F.when(F.col("clave").isNull(), "nula").otherwise("repetida"))


def orphans(fact: DataFrame, column: str, dimension: DataFrame, reference: str) -> DataFrame:
    """MOD-3: (clave, filas) of foreign keys without a row in the dimension. The fact is reduced to its distinct keys
    first, so a key that fills a third of it costs one row in the join."""
    used = fact.filter(q(column).isNotNull()).groupBy(q(column).alias("clave")).agg(F.count(F.lit(1)).alias("filas"))
    known = dimension.select(q(reference).alias("clave"))
    return used.join(known, "clave", "left_anti")


def check_model(model: dict, tables: dict[str, DataFrame]) -> DataFrame:
    """(tabla, clave, comprobacion, valores, filas): every primary and foreign key of the model checked."""
    parts = []
    for name, spec in model.items():
        df = tables[spec["hoja"]]
        checks = []
        if spec.get("clave_primaria"):
            checks.append((spec["clave_primaria"], "PK", bad_primary_keys(df, spec["clave_primaria"])))
        for fk in spec.get("claves_foraneas", []):
            target = tables[model[fk["tabla_referencia"]]["hoja"]]
            checks.append((fk["columna"], f"FK {fk['tabla_referencia']}", orphans(df, fk["columna"], target, fk["columna_referencia"])))
        parts += [bad.agg(F.lit(name).alias("tabla"), F.lit(key).alias("clave"), F.lit(what).alias("comprobacion"),
                          F.count(F.lit(1)).alias("valores"), F.coalesce(F.sum("filas"), F.lit(0)).alias("filas"))
                  for key, what, bad in checks]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def load_model(spark: SparkSession, model: dict, tables: dict[str, DataFrame], write, if_exists: str = "replace") -> list[str]:
    """SRC-16: validate, write every table (dimensions first), then check the declared keys.

    `write(df, table, if_exists)` is one of the sinks; keys are checked on the data instead of being left to a database."""
    errors = validate_model(model, tables)
    if errors:
        raise ValueError("el modelo tiene errores: " + "; ".join(errors))
    messages = []
    for name in sorted(model, key=lambda n: is_fact(model[n])):
        write(tables[model[name]["hoja"]], name, if_exists)
        messages.append(f"datos escritos: {name}")
    for row in check_model(model, tables).collect():  # one row per declared key
        state = "correcta" if not row["valores"] else f"{row['valores']} valores con problema en {row['filas']} filas"
        messages.append(f"{row['comprobacion']} {row['tabla']}.{row['clave']}: {state}")
    return messages
