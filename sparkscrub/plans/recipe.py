"""The replayable recipe: `fit` runs the guided cleaning and freezes what it learnt; `apply` repeats it."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame

from ..functions import names
from ..functions import vocab as V
from ..operators import steps as S
from ..operators.variants import suggest_equivalences
from .profile import Profile


def null_tokens(extra=None) -> tuple[str, ...]:
    """Texts that count as null: blank, the chosen ones and spreadsheet errors."""
    chosen = ("nan", "none", "null", "n/a") if extra is None else tuple(str(t).strip().lower() for t in extra)
    return ("",) + chosen + tuple(e for e in V.SHEET_ERRORS if e not in chosen)


def configure(df: DataFrame, tokens_extra=None, snake: bool = True, blanks: bool = True, text: bool = True,
              text_columns=None, numeric=None, latitude=None, longitude=None, latitude_range=None, longitude_range=None,
              dates=None, date_format: str = "%Y-%m-%d", day_first: bool = True, duplicates: bool = False,
              impossible: bool = False, iqr_columns=None, factor: float = 1.5, outlier_action: str = "nulo",
              filters=None, formulas: bool = False, formula_action: str = "marcar", derived=None,
              ignore: list[str] | None = None) -> dict:
    """Choices for `fit`; None means 'choose by name and content', an empty list means none.

    Columns may be named as in the table or in snake_case. `ignore` lists columns left out of every step."""
    ignore = list(ignore or [])
    columns = [c for c in df.columns if c not in ignore]
    tokens = null_tokens(tokens_extra)
    if tokens_extra is None:
        textual = [f.name for f in df.schema.fields if f.name in columns and f.dataType.typeName() == "string"]
        if textual:
            found = S.null_like_texts(df, textual, tokens).select("texto").collect()  # at most the candidate list
            tokens += tuple(sorted(r["texto"] for r in found))
    renamed = dict(zip(df.columns, names.snake_names(df.columns))) if snake else {c: c for c in df.columns}
    renamed.update({c: c for c in ignore})
    view = df.withColumnsRenamed({a: b for a, b in renamed.items() if a != b})
    profile = Profile(view, [renamed[c] for c in columns], tokens)

    def known(chosen, what):
        out = []
        for name in chosen:
            target = name if name in view.columns else renamed.get(name)
            if target is None:
                raise ValueError(f"{what}: la columna '{name}' no existe")
            out.append(target)
        return out

    by_name = profile.guided_date_columns
    axis = {kind: next((c for c in profile.columns if names.coordinate_kind(c) == kind), None) for kind in ("latitud", "longitud")}
    return {
        "tokens": tokens, "nombres": {a: b for a, b in renamed.items() if a != b} if snake else None, "vacios": blanks,
        "ignorar": ignore,
        "texto": (profile.text_columns if text_columns is None else known(text_columns, "texto")) if text else None,
        "numericas": [c for c in profile.columns if not profile.is_numeric(c) and profile.roles[c] == "numerica"]
        if numeric is None else known(numeric, "numéricas"),
        "latitud": axis["latitud"] if latitude is None else latitude, "longitud": axis["longitud"] if longitude is None else longitude,
        "rango_latitud": latitude_range, "rango_longitud": longitude_range,
        "fechas": by_name if dates is None else known(dates, "fechas"), "formato": date_format, "dia_primero": day_first,
        "filtros": list(filters or []), "duplicados": duplicates, "imposibles": impossible,
        "iqr": known(iqr_columns or [], "IQR"), "factor": factor, "accion_atipicos": outlier_action,
        "formulas": formula_action if formulas else None, "derivadas": list(derived or []),
    }


def fit(df: DataFrame, config: dict, overrides: dict[str, dict] | None = None, word: str = V.NO_DATA_WORD,
        unify: bool = True, equivalences: list[dict] | None = None, close: bool = True, close_numbers: str = "mediana",
        close_dates: bool = True, typed_dates: bool = False, date_parts: list[str] | None = None,
        month: bool = True, year: bool = True) -> list[dict]:
    """GUI-25: global steps in their fixed order, equivalences, one null rule per column, closing fill, typed dates and
    date parts. Returns the recipe, a JSON-ready list of frozen steps."""
    tokens, ignore = tuple(config["tokens"]), config["ignorar"]
    recipe: list[dict] = []
    current: Profile | None = None  # facts of the table as it is now, shared by the steps that need them

    def add(step: dict | None) -> None:
        nonlocal df, current
        if step:
            recipe.append(step)
            df, current = S.apply_step(df, step), None

    def profiled() -> Profile:
        nonlocal current
        current = current or Profile(df, [c for c in df.columns if c not in ignore], tokens)
        return current

    if config["nombres"]:
        add({"tipo": "nombres", "mapa": config["nombres"]})
    columns = [c for c in df.columns if c not in ignore]
    raw = profiled()
    if config["vacios"]:
        add(S.fit_blanks(columns, tokens))
    if config["texto"] is not None:
        add(S.fit_text(config["texto"]) if config["texto"] else None)
        proper = [c for c in columns if c not in config["texto"] and names.matches(c, V.PROPER_NAME_WORDS)
                  and raw.role(c, 0.6) == "texto"]
        add(S.fit_text(proper, lower=False) if proper else None)
    numeric = [c for c in config["numericas"] if c in columns]
    add(S.fit_numbers(raw, numeric) if numeric else None)
    if config["latitud"] or config["longitud"]:
        add(S.fit_coordinates(df, config["latitud"], config["longitud"], config["rango_latitud"], config["rango_longitud"]))
    dated = [c for c in config["fechas"] if c in columns]
    if dated:
        add(S.fit_dates(df, dated, config["formato"], config["dia_primero"], tokens))
    if config["filtros"]:
        add(S.fit_filters(df, config["filtros"]))
    if config["duplicados"]:
        add({"tipo": "duplicados", "ignorar": ignore})
    if config["imposibles"] or config["iqr"]:
        add(S.fit_limits(profiled(), config["imposibles"], config["iqr"], config["factor"], config["accion_atipicos"]))
    if config["formulas"]:
        add(S.fit_formula(profiled(), config["formulas"]))
    if config["derivadas"]:
        add(S.fit_derived(df, config["derivadas"]))
    if unify:
        rows = equivalences if equivalences is not None else [
            r.asDict() for r in suggest_equivalences(profiled(), word=word).collect()]  # columns x 30 at most
        step = S.fit_equivalences(rows)
        add(step if step["mapeos"] else None)
    rules = S.suggested_rules(profiled(), word)
    for rule in rules:
        rule.update((overrides or {}).get(rule["columna"], {}))
        if typed_dates and rule["columna"] in dated and rule["regla"] == "no_indica":
            rule["regla"] = "dejar"
        if rule["regla"] == "no_indica" and not str(rule.get("valor", "")).strip():
            rule["valor"] = word
    for rule in rules:  # in order: a rule that drops rows changes what the next one sees
        if rule["regla"] != "dejar" and rule["columna"] in df.columns:
            add(S.fit_rule(df, rule["columna"], rule["regla"], rule["valor"], rule.get("grupo", ""), tokens))
    if close:
        add(S.fit_closing(profiled(), close_numbers, close_dates and not typed_dates, word))
    if typed_dates and dated:
        add(S.fit_typed_dates(dated, config["formato"]))
    if date_parts:
        wanted = dated if date_parts in (["*"], ["todas"]) else date_parts
        add(S.fit_date_parts(df, wanted, config["formato"], month, year))
    return recipe


def apply(df: DataFrame, recipe: list[dict]) -> DataFrame:
    """Repeat a recipe on another batch or on a stream."""
    for step in recipe:
        df = S.apply_step(df, step)
    return df


def to_json(recipe: list[dict]) -> str:
    return json.dumps(recipe, ensure_ascii=False, indent=1)


def from_json(text: str) -> list[dict]:
    return json.loads(text)
