"""Issue detectors. A detector is a list of row-local checks; all checks run in one scan that explodes findings.

What a check needs to know about the whole column (quartiles, dominant separator, spelling map, repeated rows) is
worked out first and enters the check as a literal or as a helper column."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates, names, numbers, text
from ..functions import vocab as V
from ..plans.profile import Profile, bounded_scale, fences
from . import formula as rule_of
from .rows import ROW_ID, attach_lookup, flag_rows, q, repeated_cells, repeated_rows, require_unique
from .variants import spelling_variants, variant_columns

FINDING = ("tipo", "columna", "fila", "valor_original", "detalle", "valor_sugerido")
WHOLE_ROW = "(fila completa)"


@dataclass
class Check:
    """One rule on one column: where it fires and what it reports."""

    tipo: str
    columna: str | None
    fires: Column
    original: Column
    detalle: Column
    sugerido: Column = field(default_factory=lambda: F.lit(None).cast("string"))

    @property
    def when(self) -> Column:
        return F.coalesce(self.fires, F.lit(False))


def shown(profile: Profile, name: str) -> Column:
    """A cell as text, numbers without scientific notation."""
    return numbers.number_text(numbers.finite(q(name))) if profile.is_numeric(name) else q(name).cast("string")


def _text_columns(profile: Profile) -> list[str]:
    return [c for c in profile.columns if profile.is_text(c)]


def missing(profile: Profile) -> list[Check]:
    """DET-1."""
    out = []
    for c in profile.columns:
        value = numbers.finite(q(c)) if profile.is_numeric(c) else q(c)
        detail = F.when(value.isNull(), "Valor vacío/nulo").otherwise("Valor vacío (celda en blanco o solo con espacios)")
        empty = text.is_blank(value) if profile.is_text(c) else value.isNull()
        out.append(Check("faltante", c, empty, value.cast("string"), detail))
    return out


def duplicates(profile: Profile, flag: str) -> list[Check]:
    """DET-2; `flag` is the helper column made by `repeated_rows`."""
    whole = F.to_json(F.struct(*[q(c) for c in profile.columns]), {"ignoreNullFields": "false"})
    return [Check("duplicado", None, q(flag), whole, F.lit("Fila duplicada (idéntica a una anterior)"))]


def wrong_type(profile: Profile) -> list[Check]:
    """DET-3."""
    return [Check("tipo_invalido", c, ~text.is_blank(q(c)) & ~q(c).rlike(V.NUMBER_RE), q(c),
                  F.lit("Se esperaba un valor numérico"))
            for c in _text_columns(profile) if c not in profile.phone_columns and profile.mostly_number(c)]


def extra_spaces(profile: Profile, columns: list[str] | None = None) -> list[Check]:
    """DET-4."""
    return [Check("espacio_extra", c, (text.strip(q(c)) != q(c)) & (text.strip(q(c)) != ""), q(c),
                  F.lit("Texto con espacios en blanco de más al inicio o al final"), text.strip(q(c)))
            for c in (columns if columns is not None else _text_columns(profile))]


def bad_dates(profile: Profile, columns: list[str] | None = None, earliest=None, latest=None) -> list[Check]:
    """DET-5: unreadable, out of range, or written with the less used separator."""
    columns = profile.date_columns if columns is None else columns
    textual = [c for c in columns if profile.is_text(c)]
    aggs = []
    for i, c in enumerate(textual):
        readable = ~text.is_blank(q(c)) & dates.parse_date(q(c)).isNotNull()
        aggs += [F.count_if(readable & (dates.separator(q(c)) == s)).alias(f"{k}{i}") for k, s in (("d", "-"), ("s", "/"))]
    row = profile.df.agg(*aggs).first() if aggs else None
    out = []
    for c in columns:
        parsed = dates.parse_date(q(c), profile.types[c])
        detail = F.when(parsed.isNull(), F.lit("Formato de fecha no reconocido"))
        if earliest is not None:
            detail = detail.when(parsed < F.lit(str(earliest)).cast("timestamp_ntz"),
                                 F.lit(f"Fecha fuera de rango (anterior a {str(earliest)[:10]})"))
        if latest is not None:
            detail = detail.when(parsed > F.lit(str(latest)).cast("timestamp_ntz"),
                                 F.lit(f"Fecha fuera de rango (posterior a {str(latest)[:10]})"))
        if c in textual:
            i = textual.index(c)
            dash, slash = row[f"d{i}"], row[f"s{i}"]
            if dash and slash:
                main, other = ("-", "/") if dash >= slash else ("/", "-")
                detail = detail.when(dates.separator(q(c)) == other, F.lit(
                    f"Formato de fecha inconsistente: usa separador '{other}', pero el resto de la columna usa '{main}'"))
        fires = ~text.is_blank(q(c)) & detail.isNotNull()
        if names.accepts_pending(c):
            fires = fires & ~text.pending_date(q(c))
        out.append(Check("fecha_invalida", c, fires, q(c).cast("string"), detail))
    return out


def bad_emails(profile: Profile, columns: list[str] | None = None) -> list[Check]:
    """DET-6."""
    return [Check("email_invalido", c, ~text.is_blank(q(c)) & ~text.strip(q(c).cast("string")).rlike(V.EMAIL_RE),
                  q(c).cast("string"), F.lit("Formato de correo electrónico inválido"))
            for c in (profile.email_columns if columns is None else columns)]


def phone_ok(value: Column, low: int, high: int, country_code: bool = True, pattern: str = V.PHONE_CHARS_RE,
             first_digits: list[str] | None = None) -> Column:
    """DET-7's rule, with DET-8's optional list of accepted first digits."""
    t = text.strip(value)
    digits = F.regexp_replace(t, r"\D", "")
    n = F.length(digits)
    length_ok = n.between(low, high)
    if country_code:
        length_ok = length_ok | n.between(low + 1, high + 3)
    ok = t.rlike(pattern) & length_ok
    return ok & F.substring(digits, 1, 1).isin(*first_digits) if first_digits else ok


def bad_phones(profile: Profile, columns: list[str] | None = None, pattern: str | None = None,
               digits: tuple[int, int] | None = None, countries: list[str] | None = None, country_code: bool = True,
               first_digits: list[str] | None = None) -> list[Check]:
    """DET-7 and DET-8. A custom pattern is anchored at the start, as a match is."""
    low, high = digits or names.phone_digit_range(countries)
    shown_range = f"{low}" if low == high else f"{low}-{high}"
    out = []
    for c in profile.phone_columns if columns is None else columns:
        value = shown(profile, c)
        ok = phone_ok(value, low, high, country_code, f"^(?:{pattern})" if pattern else V.PHONE_CHARS_RE, first_digits)
        out.append(Check("telefono_invalido", c, ~text.is_blank(value) & ~ok, value, F.lit(
            f"Formato/longitud de teléfono inválido (se esperaban {shown_range} dígitos)")))
    return out


def key_columns(profile: Profile, threshold: float = 0.9) -> list[str]:
    """Id-named columns that behave as primary keys: nearly unique, or half unique when first or named 'id'."""
    out = []
    for position, c in enumerate(profile.columns):
        if not names.is_id(c) or not profile.present(c):
            continue
        limit = min(threshold, 0.5) if position == 0 or c.strip().lower() == "id" else threshold
        if profile.distinct_share(c, limit) >= limit:
            out.append(c)
    return out


def repeated_ids(profile: Profile, columns: list[str], flag: str) -> list[Check]:
    """DET-9; `flag` is the helper array naming the repeated columns of the row."""
    return [Check("id_duplicado", c, F.array_contains(q(flag), c), shown(profile, c), F.lit(
        f"Valor repetido en columna identificadora '{c}' (la fila completa no es idéntica)")) for c in columns]


def plain_number(profile: Profile, name: str) -> Column:
    """The strict reading the classic formula check uses."""
    if profile.is_text(name):
        return numbers.strict_number(q(name))
    return numbers.parse_number(q(name), profile.types[name])


def bad_formula(profile: Profile, rule: dict | None = None, tolerance: float = 0.01) -> list[Check]:
    """DET-10 with DET-11's search when no rule is given."""
    def number(name):
        return plain_number(profile, name)

    if rule is None:
        rule, _ = rule_of.best_rule(profile.df, profile.columns, number, tolerance)
    if rule is None:
        return []
    expected = rule_of.expected_total(rule, number)
    detail = F.format_string(f"{rule['total']} no coincide con {rule_of.rule_text(rule)} (esperado ≈ %.2f)".replace(
        "%", "%%").replace("%%.2f", "%.2f"), expected)
    return [Check("formula_incorrecta", rule["total"], rule_of.breaks_rule(rule, number), shown(profile, rule["total"]),
                  detail, numbers.number_text(F.round(expected, 2)))]


def spelling(profile: Profile, columns: list[str]) -> list[Check]:
    """DET-15; helper columns '__canon_<c>' carry the most frequent spelling."""
    return [Check("texto_inconsistente", c, q(f"__canon_{c}").isNotNull(), q(c),
                  F.concat(F.lit("Posible variante/error de tipeo de '"), q(f"__canon_{c}"), F.lit("'")), q(f"__canon_{c}"))
            for c in columns]


def bad_states(profile: Profile, columns: list[str] | None = None, valid=V.VALID_STATES) -> list[Check]:
    """DET-13."""
    columns = names.columns_named(profile.columns, V.STATE_WORDS) if columns is None else columns
    return [Check("estado_invalido", c, ~text.is_blank(q(c)) & ~text.valid_state(q(c), valid), shown(profile, c),
                  F.lit(f"Valor de estado no reconocido (válidos: {', '.join(valid)})")) for c in columns]


def bad_case(profile: Profile, columns: list[str] | None = None) -> list[Check]:
    """DET-14."""
    if columns is None:
        columns = [c for c in names.columns_named(profile.columns, V.PROPER_NAME_WORDS)
                   if profile.is_text(c) and not names.is_id(c) and not names.matches(c, V.EMAIL_WORDS + V.PHONE_WORDS)
                   and not profile.looks_email(c)]
    out = []
    for c in columns:
        suggestion = text.proper_case(text.strip(q(c)))
        out.append(Check("capitalizacion_incorrecta", c, ~text.is_blank(q(c)) & (q(c) != text.proper_case(q(c))), q(c),
                         F.concat(F.lit("Capitalización inconsistente (sugerido: '"), suggestion, F.lit("')")), suggestion))
    return out


def logical_rule(profile: Profile, name: str, scale: int | None) -> tuple[Column, Column] | None:
    """DET-18 on one column: (fires, detail) from its name, or None when the name sets no limit."""
    area = names.coordinate_range(name)
    value = numbers.coordinate(q(name), profile.types[name]) if area else profile.lenient_number(name)
    limits = area or names.plausible_range(name)
    if limits:
        low, high = limits
        detail = (f"Coordenada fuera del rango geográfico [{low:g}, {high:g}]: posible error de captura (p. ej. falta "
                  "el punto decimal). Revíselo en el origen") if area else \
            f"Fuera del rango plausible [{low}, {high}] para este tipo de dato"
        return (value < low) | (value > high), F.lit(detail)
    if not names.is_non_negative(name):
        return None
    negative = F.lit("Valor negativo no valido para este tipo de dato (conteo/cantidad)")
    if scale is None:
        return value < 0, negative
    over = F.lit(f"Fuera del rango plausible [0, {scale}] inferido para esta columna (el resto de los datos sugiere "
                 f"una escala acotada 1-{scale})")
    return (value < 0) | (value > scale), F.when(value < 0, negative).otherwise(over)


def outliers(profile: Profile, method: str = "iqr", factor: float = 1.5, threshold: float = 3.0,
             columns: list[str] | None = None, logical: bool = True) -> list[Check]:
    """DET-16 to DET-19: statistical and logical rules of a cell merge into one finding."""
    columns = profile.outlier_columns if columns is None else columns
    quartiles = profile.quartiles(columns)
    facts = profile.number_facts(columns) if method in ("zscore", "ambos") else {}
    out = []
    for c in columns:
        value = profile.lenient_number(c)
        rules: list[tuple[Column, Column, str]] = []
        quart = quartiles[c]
        if method in ("iqr", "ambos") and quart and quart[2] != quart[0]:
            low, high = fences(quart, factor)
            rules.append(((value < low) | (value > high),
                          F.lit(f"Fuera de rango [{low:.2f}, {high:.2f}] (método IQR)"), ""))
        if method in ("zscore", "ambos") and facts[c]["std"]:
            z = (value - facts[c]["mean"]) / facts[c]["std"]
            detail = F.concat(F.lit("Z-score="), F.format_string("%.2f", z), F.lit(f" (umbral={threshold})"))
            rules.append((F.abs(z) > threshold, detail, " | también atípico por Z-score (%s)"))
        limit = logical_rule(profile, c, bounded_scale(quart[2] if quart else None)) if logical else None
        if limit:
            rules.append((*limit, " | también fuera de rango lógico (%s)"))
        if not rules:
            continue
        fires, detail = F.lit(False), F.lit("")
        for condition, note, also in rules:
            condition = F.coalesce(condition, F.lit(False))
            before, _, after = also.partition("%s")
            merged = F.when(fires, F.concat(F.lit(before), note, F.lit(after))).otherwise(note) if also else note
            detail = F.concat(detail, F.when(condition, merged).otherwise(F.lit("")))
            fires = fires | condition
        number = numbers.coordinate(q(c), profile.types[c]) if names.coordinate_range(c) else value
        out.append(Check("atipico", c, fires, numbers.number_text(number), detail))
    return out


# -- everything together ------------------------------------------------------------------------------------
@dataclass
class Analysis:
    """The table with its helper columns, the checks in detection order and the facts behind them."""

    df: DataFrame
    profile: Profile
    checks: list[Check]
    row_id: str

    @property
    def excluded_by_content(self) -> list[str]:
        return self.profile.serial_by_content

    def findings(self) -> DataFrame:
        return findings(self.df, self.checks, self.row_id)

    def by_type(self) -> DataFrame:
        return self.findings().groupBy("tipo").agg(F.count(F.lit(1)).alias("hallazgos"))

    def by_column(self) -> DataFrame:
        return self.findings().groupBy(F.coalesce("columna", F.lit(WHOLE_ROW)).alias("columna")).agg(
            F.count(F.lit(1)).alias("hallazgos"))


def findings(df: DataFrame, checks: list[Check], row_id: str = ROW_ID) -> DataFrame:
    """The finding table: one scan, one small array per row, exploded."""
    if not checks:
        return df.sparkSession.createDataFrame([], "tipo string, columna string, fila long, valor_original string, "
                                                   "detalle string, valor_sugerido string")
    cells = [F.when(k.when, F.struct(
        F.lit(k.tipo).alias("tipo"), F.lit(k.columna).cast("string").alias("columna"), q(row_id).alias("fila"),
        k.original.cast("string").alias("valor_original"), k.detalle.cast("string").alias("detalle"),
        k.sugerido.cast("string").alias("valor_sugerido"))) for k in checks]
    touched = df.filter(reduce(lambda a, b: a | b, [k.when for k in checks]))
    return touched.select(F.explode(F.array_compact(F.array(*cells))).alias("f")).select("f.*")


def analyze(df: DataFrame, row_id: str = ROW_ID, only: set[str] | None = None, method: str = "iqr", factor: float = 1.5,
            z_threshold: float = 3.0, numeric: list[str] | None = None, date_columns: list[str] | None = None,
            earliest=None, latest=None, email_columns: list[str] | None = None, phone_columns: list[str] | None = None,
            phone_pattern: str | None = None, phone_digits: tuple[int, int] | None = None,
            countries: list[str] | None = None, country_code: bool = True, id_columns: list[str] | None = None,
            formula: dict | None = None, tolerance: float = 0.01, text_columns: list[str] | None = None,
            similarity: float = 0.85, state_columns: list[str] | None = None, valid_states=V.VALID_STATES,
            case_columns: list[str] | None = None, profile: Profile | None = None) -> Analysis:
    """DET-20: every detector in a fixed order; `only` picks issue types. `df` carries a unique `row_id` column."""
    data_columns = [c for c in df.columns if c != row_id]
    profile = profile or Profile(df, data_columns)
    wanted = (lambda t: True) if only is None else (lambda t: t in only)
    checks: list[Check] = []
    if wanted("faltante"):
        checks += missing(profile)
    if wanted("duplicado") or wanted("id_duplicado"):
        require_unique(df, row_id)
    if wanted("duplicado"):
        df = flag_rows(df, repeated_rows(df, profile.columns, row_id), row_id, "__dup")
        checks += duplicates(profile, "__dup")
    if wanted("tipo_invalido"):
        checks += wrong_type(profile)
    if wanted("espacio_extra"):
        checks += extra_spaces(profile)
    if wanted("fecha_invalida"):
        checks += bad_dates(profile, date_columns, earliest, latest)
    if wanted("email_invalido"):
        checks += bad_emails(profile, email_columns)
    if wanted("telefono_invalido"):
        checks += bad_phones(profile, phone_columns, phone_pattern, phone_digits, countries, country_code)
    if wanted("id_duplicado"):
        ids = key_columns(profile) if id_columns is None else id_columns
        if ids:
            cells = repeated_cells(df, ids, row_id).groupBy(row_id).agg(F.collect_set("columna").alias("__rep"))
            df = df.join(cells, row_id, "left").withColumn("__rep", F.coalesce("__rep", F.array().cast("array<string>")))
            checks += repeated_ids(profile, ids, "__rep")
    if wanted("formula_incorrecta"):
        checks += bad_formula(profile, formula, tolerance)
    if wanted("texto_inconsistente"):
        columns = variant_columns(profile) if text_columns is None else text_columns
        if columns:
            lookup = spelling_variants(profile.df, columns, similarity).persist()
            for c in columns:
                df = attach_lookup(df, c, lookup.filter(F.col("columna") == c).select("texto", "destino"), f"__canon_{c}")
            checks += spelling(profile, columns)
    if wanted("estado_invalido"):
        checks += bad_states(profile, state_columns, valid_states)
    if wanted("capitalizacion_incorrecta"):
        checks += bad_case(profile, case_columns)
    if wanted("atipico"):
        checks += outliers(profile, method, factor, z_threshold, numeric)
    return Analysis(df, profile, checks, row_id)
