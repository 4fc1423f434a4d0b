"""Word lists, tables and patterns that decide results, kept together and unchanged."""

from __future__ import annotations

import unicodedata

# --- Fixed values: null texts ------------------------------------------------------------------
SHEET_ERRORS = ("#n/a", "#n/d", "#value!", "#valor!", "#ref!", "#div/0!", "#name?", "#nombre?", "#num!",
                "#null!", "#nulo!")
NULL_TOKENS = ("", "nan", "none", "null", "n/a") + SHEET_ERRORS
NULL_TOKENS_EXTRA = ("na", "-", "--", "s/d", "sin dato", "unknown", "desconocido",
                     "not available", "no disponible")
PROFILE_NULLS = ("", "nan", "none", "null", "n/a", "na", "nat", "<na>", "-", "--", "sin dato", "s/d")
NO_DATA_WORD = "No indica"

# --- Fixed values: column-name words ------------------------------------------------------------
ID_SUBSTRINGS = ("codigo", "folio", "identificador", "clave")
SERIAL_WORDS = (
    "chasis", "vin", "motor", "numero_motor", "serie_motor", "placa", "matricula", "patente",
    "sku", "codigo_barras", "ean", "upc", "gtin", "numero_serie", "serie", "numero_lote", "lote",
    "numero_parte", "part_number", "numero_pieza", "referencia",
    "numero_cuenta", "cuenta", "iban", "swift", "numero_poliza", "poliza", "numero_contrato", "contrato",
    "numero_factura", "factura", "expediente", "numero_expediente",
    "imei", "mac", "numero_serial", "serial",
    "codigo_postal", "postal_code", "postal", "zip", "zipcode", "zip_code", "plz", "cp",
    "codigo_producto", "numero_orden", "orden_compra", "numero_pedido", "pedido", "codigo_pedido", "tracking",
    "numero_tracking", "codigo_tracking", "guia", "numero_guia", "guia_envio", "awb", "conocimiento_embarque",
    "folio_pago", "numero_folio", "codigo_rastreo", "numero_seguimiento", "seguimiento", "numero_referencia",
    "referencia_pago",
)
LATITUDE_WORDS = ("latitud", "latitude", "lat")
LONGITUDE_WORDS = ("longitud", "longitude", "lon", "lng", "long")
COORDINATE_WORDS = LATITUDE_WORDS + LONGITUDE_WORDS + ("coordenada", "coordenadas", "coord", "coords", "gps")
NOT_PHONE_WORDS = SERIAL_WORDS + COORDINATE_WORDS
POSITION_WORDS = ("linea", "renglon", "item", "numero_linea", "num_linea", "nro_linea", "numero_item", "num_item",
                  "nro_item", "posicion", "orden_linea", "secuencia", "correlativo", "consecutivo", "detalle_linea")
EMAIL_WORDS = ("email", "correo", "e_mail", "mail", "correo_electronico")
PHONE_WORDS = ("telefono", "phone", "celular", "movil", "whatsapp", "numero_telefono", "phone_number", "tel",
               "mobile", "fax")
DATE_STRONG_WORDS = ("fecha", "date", "fec", "dob", "birth", "nacimiento", "created_at", "updated_at", "timestamp",
                     "vencimiento", "expiry")
DATE_WEAK_WORDS = ("ingreso", "egreso", "cobro", "pago", "entrega", "poder")
DATE_WORDS = DATE_STRONG_WORDS + DATE_WEAK_WORDS
PENDING_DATE_WORDS = ("cobro", "pago", "entrega", "ingreso")
TOTAL_WORDS = ("total", "monto", "importe", "amount", "subtotal", "salario", "sueldo", "costo", "cost")
QUANTITY_WORDS = ("cantidad", "qty", "quantity", "cant", "unidades", "horas", "hours", "peso", "weight")
PRICE_WORDS = ("precio", "price", "tarifa", "rate", "valor_unitario", "unit_price")
DISCOUNT_WORDS = ("descuento", "discount", "rebaja", "bonificacion", "dcto")
TAX_WORDS = ("impuesto", "iva", "tax", "itbis", "vat")
SHIPPING_WORDS = ("envio", "flete", "shipping", "freight", "logistico")
STATE_WORDS = ("estado", "status")
PROPER_NAME_WORDS = (
    "nombre", "apellido", "nombre_completo", "cliente", "vendedor", "proveedor", "empleado", "encargado",
    "responsable", "representante", "contacto", "gerente", "supervisor", "jefe", "doctor", "paciente", "estudiante",
    "alumno", "profesor", "maestro", "autor", "titular", "propietario", "empresa", "compania", "razon_social",
    "ciudad", "provincia", "canton", "distrito", "pais", "direccion", "calle", "avenida", "sucursal", "tienda",
    "local", "agencia", "oficina", "bodega", "almacen", "punto_venta",
)
PERSON_WORDS = ("nombre", "apellido", "apellidos", "nombres", "name", "contacto", "cliente", "empleado", "paciente",
                "estudiante", "alumno", "vendedor", "gerente", "jefe", "representante")
VARIANT_EXCLUDED = EMAIL_WORDS + PHONE_WORDS + DATE_WORDS + STATE_WORDS + (
    "nombre", "cliente", "direccion", "dirección", "observacion", "observación", "comentario")
NON_NEGATIVE_WORDS = (
    "cantidad", "qty", "quantity", "cant", "unidades", "horas", "hours", "peso", "weight", "quejas", "reclamos",
    "incidentes", "errores", "fallas", "devoluciones", "denuncias", "ausencias", "faltas", "llamadas", "visitas",
    "pedidos", "ordenes", "meses", "dias", "anios", "precio", "price", "costo", "cost", "monto", "importe",
    "salario", "sueldo", "total", "subtotal", "stock", "inventario",
)
PERIOD_WORDS = ("mes", "anio", "ano", "year", "month")
KEY_EXTRA_WORDS = ("postal", "zip", "zipcode", "cp", "codigo_postal", "postal_code")
KEY_EXTRA_TOKENS = ("placa", "patente", "sku", "vin", "chasis", "imei", "iban", "swift", "ean", "upc", "gtin",
                    "tracking", "guia", "awb", "carne", "carnet", "cedula", "dni", "pasaporte", "nit", "ruc", "rfc",
                    "curp", "mcc", "isbn", "uuid", "guid")
NUMBERED_NOUNS = ("cuenta", "poliza", "contrato", "factura", "pedido", "orden", "guia", "tracking", "serie", "lote",
                  "folio", "expediente", "referencia", "documento", "caso", "ticket", "reserva", "boleta", "recibo",
                  "comprobante", "tarjeta", "cliente", "empleado", "paciente", "estudiante", "matricula")
NUMBER_PREFIXES = ("num", "numero", "nro", "number")
SURVEY_WORDS = ("nps", "satisfaction", "satisfaccion", "rating", "survey", "encuesta", "calificacion", "puntuacion")
YEAR_WORDS = ("year", "years", "anio", "anios", "ano", "anos")
EVENT_COUNT_WORDS = ("reclamos", "visitas", "hijos", "dependientes", "intentos", "quejas", "devoluciones", "llamadas",
                     "fallas", "accidentes", "multas", "incidentes", "compras", "pedidos", "claims", "visits",
                     "children", "complaints", "attempts", "returns", "calls")
SCALE_WORDS = ("evaluacion", "calificacion", "puntaje", "puntuacion", "score", "rating", "nivel", "level", "prioridad",
               "riesgo", "grado", "satisfaccion", "escala", "ranking", "estrellas", "severidad", "desempeno")
RESULT_NAME_WORDS = {"total", "importe", "monto", "ingreso", "ingresos", "ventas", "venta", "revenue", "subtotal",
                     "bruto", "neto", "sum", "suma"}
DIFFERENCE_NAME_WORDS = {"ganancia", "utilidad", "profit", "margen", "diferencia", "diff", "neto", "saldo", "balance",
                         "resultado", "beneficio", "ahorro", "variacion", "delta", "gain"}
UNIT_NAME_WORDS = {"unit", "unitario", "unitaria", "unidad", "promedio", "avg", "medio", "por", "per", "tasa",
                   "ratio", "margen", "pct", "porcentaje", "proporcion", "rate", "indice"}

# --- Fixed values: cell vocabularies ------------------------------------------------------------
PENDING_DATE_VALUES = ("pendiente", "pendiente de pago", "pendiente de cobro", "pendiente de entrega", "por cobrar",
                       "por pagar", "por entregar", "no aplica", "n/a", "na", "no corresponde", "sin fecha",
                       "no fecha", "no definido", "no definida", "sin definir", "null", "none", "-")
VALID_STATES = ("activo", "inactivo", "pendiente")
LOWERCASE_CONNECTORS = ("de", "del", "la", "las", "los", "y", "e", "en", "a", "al", "con", "para", "por", "van",
                        "von", "der", "da", "do", "dos", "das")
NAME_ACRONYMS = ("sa", "srl", "ltda", "llc", "inc", "corp", "sac", "eirl", "cia", "sl", "sau", "spa", "gmbh", "plc",
                 "ii", "iii", "iv", "vi", "vii", "viii", "ix", "jr", "sr", "md", "phd")
SYNONYMS = {
    "genero": {
        "M": ("m", "male", "masculino", "hombre", "man", "h"),
        "F": ("f", "female", "femenino", "mujer", "woman"),
        "Other": ("other", "o", "otro", "divers", "diverse", "non binary", "nonbinary", "no binario"),
    },
    "si_no": {
        "Sí": ("si", "yes", "y", "true", "verdadero", "s"),
        "No": ("no", "n", "false", "falso"),
    },
}
NO_DATA_TEXTS = ("no indica", "sin dato", "desconocido", "unknown", "prefiero no decir", "prefiero no indicar",
                 "not available", "no disponible", "na", "n a")
BOOLEAN_TEXTS = ("si", "sí", "no", "s", "n", "yes", "y", "true", "false", "verdadero", "falso", "1", "0", "x",
                 "t", "f", "1.0", "0.0")
CONTENT_BOOLEANS = ("si", "sí", "no", "s", "n", "yes", "y", "true", "false", "verdadero", "falso", "1", "0", "x",
                    "t", "f", "activo", "inactivo", "on", "off")
SEX_TEXTS = ("m", "f", "h", "masculino", "femenino", "hombre", "mujer", "male", "female", "otro", "other")
PERIODICITY_TEXTS = ("mensual", "anual", "trimestral", "semestral", "bimestral", "quincenal", "semanal", "diario",
                     "monthly", "yearly", "annual", "quarterly", "weekly")
MONTH_NAMES = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")

# --- Fixed values: ranges and tables ------------------------------------------------------------
PLAUSIBLE_RANGES = {"edad": (0, 120), "age": (0, 120)}
BOUNDED_SCALES = (5, 10)
LATITUDE_RANGE = (-90.0, 90.0)
LONGITUDE_RANGE = (-180.0, 180.0)
INTERNATIONAL_DIGITS = (7, 15)
PHONE_DIGITS = {
    "cr": (8, 8), "costa_rica": (8, 8), "mx": (10, 10), "mexico": (10, 10), "co": (10, 10), "colombia": (10, 10),
    "ar": (10, 11), "argentina": (10, 11), "es": (9, 9), "espana": (9, 9), "spain": (9, 9), "us": (10, 10),
    "usa": (10, 10), "estados_unidos": (10, 10), "pa": (7, 8), "panama": (7, 8), "gt": (8, 8), "guatemala": (8, 8),
    "hn": (8, 8), "honduras": (8, 8), "ni": (8, 8), "nicaragua": (8, 8), "sv": (8, 8), "el_salvador": (8, 8),
    "cl": (9, 9), "chile": (9, 9), "pe": (9, 9), "peru": (9, 9), "ec": (9, 9), "ecuador": (9, 9), "ve": (10, 11),
    "venezuela": (10, 11), "br": (10, 11), "brasil": (10, 11), "brazil": (10, 11), "uy": (8, 9), "uruguay": (8, 9),
    "bo": (8, 8), "bolivia": (8, 8), "do": (10, 10), "republica_dominicana": (10, 10), "gb": (10, 10),
    "uk": (10, 10), "reino_unido": (10, 10), "de": (10, 11), "alemania": (10, 11), "germany": (10, 11), "fr": (9, 9),
    "francia": (9, 9), "france": (9, 9), "ca": (10, 10), "canada": (10, 10), "au": (9, 9), "australia": (9, 9),
}
DATE_FORMATS = {"aaaa-mm-dd": "%Y-%m-%d", "dd/mm/aaaa": "%d/%m/%Y", "mm/dd/aaaa": "%m/%d/%Y",
                "dd-mm-aaaa": "%d-%m-%Y"}
ROLE_LABELS = {"id": "identificador / llave", "coordenada": "coordenada", "email": "email", "telefono": "teléfono",
               "fecha": "fecha", "numerica": "número", "texto": "texto"}

# --- Fixed values: patterns ---------------------------------------------------------------------
EMAIL_RE = r"^(?!.*\.\.)(?!\.)[^@\s]+(?<!\.)@[^@\s]+\.[^@\s]{2,}$"
PHONE_CHARS_RE = r"^[\d\s\-\+\(\)]+$"
NUMBER_RE = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
NUMBER_START_RE = r"^\s*-?\d+([.,]\d+)?\b"
CURRENCY_RE = r"(?i)[\s$€£₡¥]|crc|usd|eur"
DATE_SHAPE_RE = r"^\d{1,4}[-/.]\d{1,2}[-/.]\d{1,4}([ T]\d{1,2}:\d{2}(:\d{2})?(\.\d+)?)?$"
GUIDED_DATE_ISO_RE = (r"^\d{4}[-/.]\d{1,2}[-/.]\d{1,2}(?:[ T]\d{1,2}:\d{2}(?::\d{2}(?:\.\d+)?)?)?"
                      r"(?:Z|[+-]\d{2}:?\d{2})?$")
GUIDED_DATE_LATIN_RE = r"^\d{1,2}[-/.]\d{1,2}[-/.]\d{2,4}(?:[ T]\d{1,2}:\d{2}(?::\d{2})?)?$"
DICTIONARY_DATE_ISO_RE = r"^\d{4}-\d{2}-\d{2}([ T]\d{2}:\d{2}(:\d{2})?)?$"
DICTIONARY_DATE_LATIN_RE = r"^\d{1,2}[/-]\d{1,2}[/-]\d{2,4}$"
PERCENT_RE = r"^-?\d+(?:[.,]\d+)?\s?%$"
MONEY_RE = r"(?i)^[-(]?\s?(?:[$€£¥₡]|US\$|CRC|USD|EUR)\s?\d[\d.,]*\)?$"
LOOSE_EMAIL_RE = r"^[^@\s]+@[^@\s]+\.[^@\s]+$"
URL_RE = r"(?i)^(?:https?://|www\.)\S+$"
IP_RE = r"^(?:\d{1,3}\.){3}\d{1,3}$"
HEX_COLOR_RE = r"(?i)^#(?:[0-9a-f]{3}|[0-9a-f]{6})$"
TIME_RE = r"(?i)^\d{1,2}:\d{2}(?::\d{2})?(?:\s?[ap]\.?m\.?)?$"

# Every character Python's str.strip() removes, for btrim().
WHITESPACE = "".join(chr(i) for i in range(0x3001) if chr(i).isspace())


def _accent_table() -> tuple[str, str]:
    """(accented, plain) for translate(): precomposed Latin letters by their NFKD base; bare marks are dropped."""
    pairs = {}
    for code in list(range(0xA0, 0x250)) + list(range(0x1E00, 0x1F00)):
        base = "".join(ch for ch in unicodedata.normalize("NFKD", chr(code)) if not unicodedata.combining(ch))
        if len(base) == 1 and base != chr(code):
            pairs[chr(code)] = base
    marks = "".join(chr(i) for i in range(0x300, 0x370))
    return "".join(pairs) + marks, "".join(pairs.values())


ACCENTED, PLAIN = _accent_table()

# --- Fixed values: concept words of column names, in order of precedence ---------------------------
CONCEPTS = {
    "resultado": "churn cancelacion cancelo cancel abandono abandon fuga fraude fraud mora morosidad default impago "
                 "conversion convirtio retencion retuvo survived supervivencia sobrevivio renovo renovacion recompra "
                 "desercion deserto",
    "contacto": "email correo mail telefono tel celular movil phone whatsapp",
    "geografia": "pais country ciudad city provincia province canton distrito region municipio localidad "
                 "barrio zona direccion address calle postal zip",
    "edad": "edad age",
    "tasa": "porcentaje pct percent tasa rate ratio proporcion indice index",
    "puntaje": "score rating puntaje puntuacion calificacion nota satisfaccion nps evaluacion ranking",
    "duracion": "duracion antiguedad tenure plazo demora retraso delay dias horas minutos segundos meses anios "
                "tiempo days hours minutes seconds months years",
    "tiempo_parte": "anio ano year mes month dia day semana week trimestre quarter hora hour periodo period",
    "cantidad": "cantidad qty quantity unidad unit pieza volumen stock inventario existencia conteo count n num "
                "nro numero visita intento reclamo hijo compra pedido queja devolucion llamada falla accidente "
                "multa incidente dependiente",
    "dinero": "precio price costo cost monto amount importe total ingreso income revenue venta sale pago payment "
              "tarifa fare fee comision salario salary sueldo saldo balance margen utilidad profit ganancia deuda "
              "debt gasto expense descuento discount impuesto tax iva prima premium cargo charge valor value "
              "presupuesto budget flete credito deposito retiro propina tip",
    "fisica": "peso weight altura height talla ancho largo profundidad temperatura temp presion velocidad "
              "distancia distance superficie capacidad potencia consumo kilometraje km humedad",
    "organizacion": "sucursal tienda store branch departamento department area equipo team empresa company sede "
                    "oficina almacen bodega agencia",
    "producto": "producto product articulo categoria category marca brand modelo model linea familia plato receta "
                "servicio service plan",
    "persona": "cliente customer usuario user empleado employee paciente patient estudiante student alumno "
               "proveedor supplier vendedor seller agente agent socio miembro member persona person apellido "
               "solicitante beneficiario asegurado conductor medico doctor profesor teacher",
    "demografia": "sexo sex genero gender nacionalidad ocupacion profesion escolaridad educacion "
                  "education civil marital idioma",
    "canal": "canal channel metodo method medio forma modalidad fuente source plataforma platform "
             "dispositivo device campana campaign",
    "proceso": "estado status etapa fase situacion resultado result condicion motivo razon reason causa cause "
               "prioridad priority severidad riesgo nivel level grado tipo type clase class",
    "texto_libre": "comentario comment observacion observation descripcion description detalle detail mensaje message "
                   "opinion resena review texto text asunto subject nota",
    "nombre": "nombre name titulo title etiqueta label",
}
GROUPING_CONCEPTS = ("resultado", "geografia", "tiempo_parte", "organizacion", "producto", "persona", "demografia", "canal", "proceso")

# --- Fixed values: notes of corrections ------------------------------------------------------------
NO_FILL_NOTE = (" | columna de código/identificador/coordenada/correo/texto libre: no se imputa ni se recorta "
                "(queda para revisión)")
HEAVY_NOTE = " | distribución con cola larga natural: el valor alto es legítimo, no se reemplaza"
HEAVY_CLIP_NOTE = (" | distribución con cola larga natural (p. ej. población, superficie): el valor alto es legítimo, "
                   "no se recorta")
MODE_NOTE = " | columna de texto: no admite media/mediana, se usó la moda"
