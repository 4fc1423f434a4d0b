"""Corrections: what each kind of finding does to its cell, as one expression per column, plus the action log.

Statistics come from the table as it arrived. When several findings fall on one cell the last one in detection order
that changes the value wins, so a column's expression is the list of its actions in reverse order."""

from __future__ import annotations

import math
from dataclasses import dataclass
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import dates, names, numbers, text
from ..functions import vocab as V
from ..plans.profile import Profile, bounded_scale, fences
from .detect import WHOLE_ROW, Analysis, Check
from .rows import q
from .variants import value_counts

DEFAULT_ACTIONS = {
    "faltante": "reemplazar_mediana", "duplicado": "eliminar_fila", "atipico": "limitar", "tipo_invalido": "marcar_solo",
    "fecha_invalida": "marcar_solo", "email_invalido": "marcar_solo", "telefono_invalido": "marcar_solo",
    "id_duplicado": "marcar_solo", "formula_incorrecta": "marcar_solo", "texto_inconsistente": "marcar_solo",
    "estado_invalido": "marcar_solo", "capitalizacion_incorrecta": "marcar_solo", "espacio_extra": "usar_sugerido",
}
ACTIONS = {"eliminar_fila", "reemplazar_media", "reemplazar_mediana", "reemplazar_moda", "limitar", "marcar_solo",
           "valor_fijo", "usar_sugerido", "editar_individualmente", "normalizar_formato_fecha", "rellenar_nan"}
STATISTICAL = ("reemplazar_media", "reemplazar_mediana", "reemplazar_moda")
_DIRECT_FIXED = {"fecha_invalida", "email_invalido", "telefono_invalido", "id_duplicado", "formula_incorrecta",
                 "texto_inconsistente", "estado_invalido", "capitalizacion_incorrecta", "espacio_extra"}
_SUGGESTED = {"formula_incorrecta", "texto_inconsistente", "capitalizacion_incorrecta", "espacio_extra"}
_EDITABLE = _DIRECT_FIXED | {"faltante", "tipo_invalido", "atipico"}
MARK = "_revisar_calidad"


# -- replacement values (ACT-4) ---------------------------------------------------------------------------
def column_modes(df: DataFrame, profile: Profile, columns: list[str]) -> dict[str, object]:
    """Most frequent value per column, the smallest on ties: one job for all columns."""
    as_number = [c for c in columns if profile.reads_as_number(c)]
    out: dict[str, object] = dict.fromkeys(columns)
    if as_number:
        from ..plans.profile import unpivot

        cells = unpivot(df, {c: profile.lenient_number(c) for c in as_number}).filter("v is not null")
        tops = cells.groupBy("columna", "v").count().groupBy("columna").agg(
            F.min(F.struct((-F.col("count")).alias("n"), "v"))["v"].alias("v"))
        out.update({r["columna"]: r["v"] for r in tops.collect()})
    textual = [c for c in columns if c not in as_number]
    if textual:
        tops = value_counts(df, textual).groupBy("columna").agg(
            F.min(F.struct((-F.col("filas")).alias("n"), F.col("valor").alias("v")))["v"].alias("v"))
        out.update({r["columna"]: r["v"] for r in tops.collect()})
    return out


def replacements(profile: Profile, wanted: dict[str, str]) -> dict[str, object]:
    """column -> mean, median or mode; text columns always get the mode."""
    numeric = {c: a for c, a in wanted.items() if profile.reads_as_number(c)}
    means = [c for c, a in numeric.items() if a == "reemplazar_media"]
    medians = [c for c, a in numeric.items() if a == "reemplazar_mediana"]
    modes = [c for c, a in wanted.items() if c not in numeric or a == "reemplazar_moda"]
    out: dict[str, object] = {}
    out.update({c: f["mean"] for c, f in profile.number_facts(means).items()})
    out.update({c: (quart[1] if quart else None) for c, quart in profile.quartiles(medians).items()})
    out.update(column_modes(profile.df, profile, modes) if modes else {})
    return out


# -- winsor limits (ACT-5) -----------------------------------------------------------------------------------
def logical_limits(name: str) -> tuple[float | None, float | None]:
    limits = names.plausible_range(name)
    if limits:
        return limits
    return (0, None) if names.is_non_negative(name) else (None, None)


def winsor_limits(profile: Profile, columns: list[str], factor: float = 1.5) -> dict[str, tuple]:
    """IQR fences cut by the logical range; whole-number columns round them inwards, crossed limits become the median."""
    quartiles, facts = profile.quartiles(columns), profile.number_facts(columns)
    out = {}
    for c in columns:
        quart = quartiles[c]
        low, high = fences(quart, factor) if quart else (None, None)
        floor, top = logical_limits(c)
        if top is None and floor is not None:
            top = bounded_scale(quart[2] if quart else None)
        low = max((x for x in (low, floor) if x is not None), default=None)
        high = min((x for x in (high, top) if x is not None), default=None)
        if facts[c]["n"] and facts[c]["whole"]:
            low = None if low is None else math.ceil(low)
            high = None if high is None else math.floor(high)
            if low is not None and high is not None and low > high:
                low = high = round(quart[1])
        out[c] = (low, high)
    return out


def clip(value: Column, low, high) -> Column:
    """The value inside its limits; NULL stays NULL."""
    out = value if low is None else F.greatest(value, F.lit(float(low)))
    out = out if high is None else F.least(out, F.lit(float(high)))
    return F.when(value.isNotNull(), out)


# -- individual corrections (ACT-9, ACT-10) --------------------------------------------------------------------
def attach_corrections(df: DataFrame, corrections: DataFrame, row_id: str) -> DataFrame:
    """Corrections (tipo, columna, fila, valor) become one map per row, joined on the unique row id.

    Of several corrections of one cell the last counts: the largest `orden` when the table has that column, else the largest value."""
    order = F.struct("orden", "valor") if "orden" in corrections.columns else F.struct("valor")
    cells = corrections.groupBy(F.col("fila").alias(row_id), F.concat_ws("\u0001", "tipo", "columna").alias("cell")).agg(F.max(order)["valor"].alias("valor"))
    per_row = cells.groupBy(row_id).agg(F.map_from_entries(F.collect_list(F.struct("cell", "valor"))).alias("__edits"))
    return df.join(per_row, row_id, "left")


def digit_patches(original: DataFrame, corrections: DataFrame, key: str, column: str) -> DataFrame:
    """ACT-10: (key, columna, posicion, digito) for every character a correction changes; position 0 replaces the
    whole value when the length changes. `corrections` has (key, valor)."""
    both = original.select(q(key), F.coalesce(q(column).cast("string"), F.lit("")).alias("old")).join(
        corrections.select(q(key), F.coalesce(F.col("valor").cast("string"), F.lit("")).alias("new")), key)
    changed = both.filter("old <> new").withColumn("columna", F.lit(column))
    whole = changed.filter(F.length("old") != F.length("new")).select(
        q(key), "columna", F.lit(0).alias("posicion"), F.col("new").alias("digito"))
    cells = changed.filter((F.length("old") == F.length("new"))).select(
        q(key), "columna", "old", "new", F.explode(F.sequence(F.lit(1), F.length("new"))).alias("posicion"))
    single = cells.select(q(key), "columna", "posicion", F.substr("new", F.col("posicion"), F.lit(1)).alias("digito"),
                          F.substr("old", F.col("posicion"), F.lit(1)).alias("was"))
    return whole.unionByName(single.filter("digito <> was").drop("was"))


def apply_patches(df: DataFrame, patches: DataFrame, key: str, column: str) -> DataFrame:
    """Apply character patches by business key: all patches of a key are folded over its value in order."""
    mine = patches.filter(F.col("columna") == column).groupBy(key).agg(F.sort_array(F.collect_list(
        F.struct("posicion", "digito"))).alias("__p"))
    patched = F.aggregate("__p", q(column).cast("string"), lambda acc, p: F.when(p["posicion"] == 0, p["digito"])
                          .otherwise(F.overlay(acc, p["digito"], p["posicion"], F.lit(1))))
    return df.join(mine, key, "left").withColumn(column, F.when(F.col("__p").isNull(), q(column).cast("string"))
                                                 .otherwise(patched)).drop("__p")


# -- order of day and month (ACT-11) --------------------------------------------------------------------------------
def day_first_columns(profile: Profile, columns: list[str]) -> dict[str, list[str]]:
    """column -> the separators whose readable dates prove day first and never month first; the others are read month first."""
    textual = [c for c in columns if profile.is_text(c)]
    aggs = []
    for i, c in enumerate(textual):
        readable = F.when(dates.parse_date(q(c)).isNotNull(), q(c))
        aggs += [e.alias(f"{k}_{i}") for k, e in dates.day_month_evidence(readable).items()]
    row = profile.df.agg(*aggs).first().asDict() if aggs else {}
    return {c: dates.day_first_separators({k.rpartition("_")[0]: v for k, v in row.items() if k.rpartition("_")[2] == str(i)}, day_first=False)
            for i, c in enumerate(textual)}


# -- applying actions (ACT-1) -------------------------------------------------------------------------------------
@dataclass
class _Step:
    """A check with the action chosen for it."""

    check: Check
    action: Column        # action as logged
    new: Column | None    # value written, as text; None when the cell is not written
    writes: Column        # whether the cell is written
    logged: Column        # new value as logged, as text
    note: Column
    marked: Column        # left uncorrected
    number: Column | None = None  # the value written as a number; None when it may be other text
    whole: bool = False   # the number written is always whole
    typed: bool = False   # the text written is a value of the column's own type
    drops: bool = False   # the row goes away


@dataclass
class Cleaning:
    """Result of applying actions: the cleaned table and its action log, both lazy."""

    analysis: Analysis
    steps: list[_Step]
    formats: dict[str, str]
    day_first: dict[str, list[str]]
    df_in: DataFrame

    def _steps_on(self, name: str) -> list[_Step]:
        return [s for s in self.steps if s.check.columna == name and s.new is not None]

    def _new_value(self, name: str) -> Column | None:
        """The column after its actions, in its declared type (text unless every written value fits the type)."""
        dtype = self.analysis.profile.types[name]
        mine = self._steps_on(name)
        value = None
        if mine and numbers.is_numeric_type(dtype) and all(s.number is not None for s in mine):
            keeps = isinstance(dtype, T.DecimalType) or all(s.whole for s in mine)
            value = numbers.finite(q(name))
            for s in mine:  # later steps wrap earlier ones, so the last one wins
                value = F.when(s.check.when & s.writes, s.number).otherwise(value)
            value = value.cast(dtype if keeps else T.DoubleType())
        elif mine:
            value = numbers.number_text(numbers.finite(q(name))) if numbers.is_numeric_type(dtype) else q(name).cast("string")
            for s in mine:
                value = F.when(s.check.when & s.writes, s.new).otherwise(value)
            if not numbers.is_numeric_type(dtype) and all(s.typed for s in mine):
                value = value.cast(dtype)
        if name in self.formats:
            base = (value if value is not None else q(name)).cast("string")
            stamp = dates.parse_date(base, day_first_seps=self.day_first.get(name))
            return F.coalesce(F.when(~text.is_blank(base), F.date_format(stamp, dates.java_format(self.formats[name]))), base)
        return value

    @property
    def df(self) -> DataFrame:
        """The cleaned table, with the quality mark when anything was left uncorrected and without dropped rows."""
        profile = self.analysis.profile
        out = []
        for f in self.df_in.schema.fields:
            if f.name.startswith("__"):
                continue
            value = self._new_value(f.name) if f.name in profile.columns else None
            out.append(q(f.name) if value is None else value.alias(f.name))
        dropping = [s.check.when for s in self.steps if s.drops]
        df = self.df_in
        marks = [F.when(s.check.when & s.marked, F.lit(s.check.tipo if s.check.columna is None
                                                       else f"{s.check.tipo}:{s.check.columna}")) for s in self.steps]
        if marks:
            name = MARK
            while name in df.columns:
                name += "_"
            out.append(F.concat_ws("; ", *marks).alias(name))
        if dropping:
            df = df.filter(~reduce(lambda a, b: a | b, dropping))
        return df.select(*out)

    @property
    def log(self) -> DataFrame:
        """ACT-14: one row per finding with the action applied."""
        row_id = self.analysis.row_id
        rows = []
        for s in self.steps:
            logged = s.logged
            if s.check.tipo == "fecha_invalida" and s.check.columna in self.formats:
                logged = self._new_value(s.check.columna)
            rows.append(F.when(s.check.when, F.struct(
                F.lit(s.check.tipo).alias("tipo"), F.lit(s.check.columna or WHOLE_ROW).alias("columna"),
                q(row_id).alias("fila"), s.check.original.cast("string").alias("valor_original"),
                s.action.alias("accion_aplicada"), logged.cast("string").alias("valor_nuevo"),
                F.concat(s.check.detalle.cast("string"), s.note).alias("detalle"))))
        touched = self.df_in.filter(reduce(lambda a, b: a | b, [s.check.when for s in self.steps]))
        return touched.select(F.explode(F.array_compact(F.array(*rows))).alias("f")).select("f.*")


@dataclass
class _Facts:
    """What the writers need: worked out once for the whole table."""

    profile: Profile
    fixed: dict
    statistics: dict[str, dict[str, object]]
    limits: dict[str, tuple]
    heavy: set[str]
    edits: Column | None


def _literal(value) -> Column:
    if isinstance(value, float) and value.is_integer() and abs(value) < 1e15:
        value = int(value)
    return F.lit(None).cast("string") if value is None else F.lit(str(value))


def _put(step: _Step, value) -> None:
    """Write one literal value, remembering whether it is a number."""
    step.new, step.writes, step.logged = _literal(value), F.lit(True), _literal(value)
    try:
        number = None if value is None else float(value)
        step.number = F.lit(number).cast("double")
        step.whole = number is None or number.is_integer()
    except (TypeError, ValueError):
        step.number = None


def _drop(step: _Step, action: str, facts: _Facts) -> None:
    step.logged, step.drops = F.lit("(fila eliminada)"), True


def _blank(step: _Step, action: str, facts: _Facts) -> None:
    _put(step, None)
    step.typed = True


def _statistic(step: _Step, action: str, facts: _Facts) -> None:
    _put(step, facts.statistics[action].get(step.check.columna))
    step.typed = step.check.tipo != "atipico"
    if action != "reemplazar_moda" and not facts.profile.reads_as_number(step.check.columna):
        step.note = F.concat(step.note, F.lit(V.MODE_NOTE))


def _fixed(step: _Step, action: str, facts: _Facts) -> None:
    k = step.check
    value = names.fixed_value(facts.fixed.get((k.tipo, k.columna), facts.fixed.get(k.columna)))
    _put(step, value)
    step.typed = value is None and k.tipo in ("faltante", "tipo_invalido")


def _limit(step: _Step, action: str, facts: _Facts) -> None:
    c = step.check.columna
    number, own = facts.profile.lenient_number(c), facts.limits.get(c, (None, None))
    clipped = clip(number, *own)
    written = numbers.number_text(clipped)
    step.new, step.writes, step.number = written, number.isNotNull(), clipped
    step.whole = all(x is None or float(x).is_integer() for x in own)
    logged = F.when(number.isNotNull(), written)
    if c in facts.heavy:  # a high value inside the logical range stays
        same = clipped == number
        step.action, step.note = F.when(same, F.lit("marcar_solo")).otherwise(F.lit(action)), F.when(same, F.lit(V.HEAVY_CLIP_NOTE)).otherwise(F.lit(""))
        logged, step.marked = F.when(same, step.logged).otherwise(logged), same
    step.logged = logged


def _suggested(step: _Step, action: str, facts: _Facts) -> None:
    suggestion = step.check.sugerido.cast("string")
    step.new, step.writes = suggestion, step.check.sugerido.isNotNull()
    step.number = step.check.sugerido.try_cast("double") if step.check.tipo == "formula_incorrecta" else None
    step.logged = F.coalesce(suggestion, step.logged)


def _edited(step: _Step, action: str, facts: _Facts) -> None:
    k, original = step.check, step.logged
    given, value = F.lit(False), F.lit(None).cast("string")
    if facts.edits is not None:
        key = F.lit(f"{k.tipo}\u0001{k.columna}")
        given, value = F.coalesce(F.map_contains_key(facts.edits, key), F.lit(False)), F.element_at(facts.edits, key)
    step.new, step.writes, step.logged = value, given, F.when(given, value).otherwise(original)
    step.marked = ~given | F.coalesce(value.eqNullSafe(original), F.lit(False))
    step.number = value.try_cast("double") if facts.profile.is_numeric(k.columna) else None


#: What an action does to the cells of a kind of finding. A pair that is not listed leaves the cell as it is.
WRITERS = {
    **{(t, "eliminar_fila"): _drop for t in DEFAULT_ACTIONS},
    ("faltante", "rellenar_nan"): _blank,
    **{(t, a): _statistic for t in ("faltante", "tipo_invalido", "atipico") for a in STATISTICAL},
    **{(t, "valor_fijo"): _fixed for t in (*sorted(_DIRECT_FIXED), "faltante", "tipo_invalido")},
    ("atipico", "limitar"): _limit,
    **{(t, "usar_sugerido"): _suggested for t in sorted(_SUGGESTED)},
    **{(t, "editar_individualmente"): _edited for t in sorted(_EDITABLE)},
}


def clean(analysis: Analysis, config: dict[str, str] | None = None, fixed: dict | None = None,
          corrections: DataFrame | None = None, date_formats: dict[str, str] | None = None, factor: float = 1.5) -> Cleaning:
    """ACT-1: look up what each check's action writes and build the cleaned table and the log.

    `fixed` maps (tipo, columna) or columna to a value; `corrections` is a table (tipo, columna, fila, valor)."""
    config = {**DEFAULT_ACTIONS, **(config or {})}
    unknown = set(config.values()) - ACTIONS
    if unknown:
        raise ValueError(f"acciones desconocidas: {', '.join(sorted(unknown))}")
    profile, checks = analysis.profile, analysis.checks
    df = analysis.df if corrections is None else attach_corrections(analysis.df, corrections, analysis.row_id)
    # ACT-12: columns where a computed value would be invented
    guarded = set(profile.not_outlier_columns) | {c for c in profile.columns if names.is_coordinate(c)}
    if any(config[k.tipo] in STATISTICAL for k in checks if k.tipo in ("faltante", "tipo_invalido")):
        guarded |= profile.never_filled
    outliers = [k.columna for k in checks if k.tipo == "atipico"]
    changes = config["atipico"] == "limitar" or config["atipico"] in STATISTICAL
    heavy = set(profile.heavy_tailed([c for c in outliers if c not in guarded])) if changes and outliers else set()
    limits = winsor_limits(profile, outliers, factor) if config["atipico"] == "limitar" and outliers else {}
    limits.update({c: logical_limits(c) for c in heavy})
    needs: dict[str, dict[str, str]] = {}  # one column may need several statistics
    for k in checks:
        if WRITERS.get((k.tipo, config[k.tipo])) is _statistic and k.columna not in guarded:
            needs.setdefault(config[k.tipo], {})[k.columna] = config[k.tipo]
    facts = _Facts(profile, fixed or {}, {action: replacements(profile, columns) for action, columns in needs.items()}, limits, heavy,
                   q("__edits") if corrections is not None else None)

    def refusal(k: Check) -> str:
        """Why a check's action is not carried out ('' when it is)."""
        statistic = WRITERS.get((k.tipo, config[k.tipo])) is _statistic
        if k.columna in guarded and (statistic if k.tipo != "atipico" else (statistic or config[k.tipo] == "limitar") and names.is_coordinate(k.columna)):
            return V.NO_FILL_NOTE
        return V.HEAVY_NOTE if k.tipo == "atipico" and statistic and k.columna in heavy else ""

    steps = []
    for k in checks:
        note = refusal(k)
        action = "marcar_solo" if note else config[k.tipo]
        step = _Step(k, F.lit(action), None, F.lit(False), k.original.cast("string"), F.lit(note), F.lit(action == "marcar_solo"))
        writer = WRITERS.get((k.tipo, action))
        if writer:
            writer(step, action, facts)
        steps.append(step)
    formats = {}
    if config["fecha_invalida"] == "normalizar_formato_fecha":
        formats = {k.columna: names.date_format((date_formats or {}).get(k.columna, "aaaa-mm-dd"))
                   for k in checks if k.tipo == "fecha_invalida"}
    return Cleaning(analysis, steps, formats, day_first_columns(profile, list(formats)), df)


# -- report (ACT-15) -------------------------------------------------------------------------------------------------
def report(analysis: Analysis, log: DataFrame, source: str = "", when: datetime | None = None) -> dict[str, DataFrame]:
    """summary (Indicador, Valor) and detail sorted by column and row."""
    spark = log.sparkSession
    by_type = log.groupBy("tipo").agg(F.count(F.lit(1)).alias("n")).select(
        F.concat(F.lit("tipo: "), "tipo").alias("Indicador"), F.col("n").cast("string").alias("Valor"))
    by_column = log.groupBy("columna").agg(F.count(F.lit(1)).alias("n")).select(
        F.concat(F.lit("columna: "), "columna").alias("Indicador"), F.col("n").cast("string").alias("Valor"))
    total = log.agg(F.lit("Total de hallazgos").alias("Indicador"), F.count(F.lit(1)).cast("string").alias("Valor"))
    head = [("Fecha de análisis", (when or datetime.now()).strftime("%Y-%m-%d %H:%M:%S")),
            ("Archivo/fuente analizada", source or "N/D"), ("Filas analizadas", str(analysis.profile.rows)),
            ("Columnas analizadas", str(len(analysis.profile.columns)))]
    head += [(f"excluida de atípicos por contenido: {c}", "parece un identificador de un solo uso")
             for c in analysis.excluded_by_content]
    summary = spark.createDataFrame(head, "Indicador string, Valor string").unionByName(total).unionByName(
        by_type).unionByName(by_column)
    return {"resumen": summary, "detalle": log.orderBy("columna", "fila")}
