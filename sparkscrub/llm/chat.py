"""Chat formatting with a grammar round trip, in DataFrame operations only.

    <chat 0>                      header: 0 as is, 1 escaped
    ### user: Hello               a turn: role (percent-encoded) and text,
    </turn>                       closed on a line of its own

The parser cuts at the closing lines and refuses a control string ("### " or "</turn>") inside a text unless a backslash stands before it
in an escaped conversation. A conversation is rendered as it is and parsed again; if the turns do not come back, its texts are escaped (one
backslash more before every control string, whatever backslashes stand there) and it is rendered and parsed again; a conversation that
still differs is an error. Unescaping takes one backslash away, so nothing is lost.

Turns are ordered by turn, then role and text; null texts and roles are empty; rows that repeat are separate turns; a null conversation id
is a conversation of its own, of all rows without an id. A role that cannot be decoded is broken grammar. A conversation is one row of the
output, so one conversation must fit in a task; running totals and the collection share one shuffle by conversation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import let

HEAD = ("<chat 0>\n", "<chat 1>\n")
OPEN, CLOSE = "### ", "</turn>"
CONTROL = f"({OPEN}|{CLOSE})"
_ESCAPE = rf"(\\*){CONTROL}"
_UNESCAPE = rf"\\(\\*){CONTROL}"
_BARE = rf"(?<!\\){CONTROL}"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPE, r"\\$1$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _UNESCAPE, "$1$2")


def _turn(role: Column, text: Column) -> Column:
    return F.concat(F.lit(OPEN), role, F.lit(": "), text, F.lit(f"\n{CLOSE}\n"))


def parse(formatted: Column) -> Column:
    """The turns (role, text) of a formatted conversation; null if its grammar is broken."""
    escaped = F.substr(formatted, F.lit(7), F.lit(1)) == "1"
    parts = F.split(F.substr(formatted, F.lit(len(HEAD[0]) + 1)), f"\n{CLOSE}\n")
    parts = F.slice(parts, F.lit(1), F.size(parts) - 1)

    def one(part: Column) -> Column:
        colon = F.instr(part, ": ")
        name = F.when(colon > len(OPEN), F.substr(part, F.lit(len(OPEN) + 1), colon - len(OPEN) - 1))
        return F.struct(F.try_url_decode(name).alias("role"), F.substr(part, colon + 2).alias("text"))

    turns = F.transform(parts, one)
    bad = F.exists(parts, lambda p: ~p.startswith(OPEN)) | F.exists(turns, lambda t: t["role"].isNull()) | F.exists(turns, lambda t: F.when(escaped, t["text"].rlike(_BARE)).otherwise(t["text"].rlike(CONTROL)))
    plain = F.when(escaped, F.transform(turns, lambda t: F.struct(t["role"].alias("role"), unescape(t["text"]).alias("text")))).otherwise(turns)
    return F.when(~bad, plain)


def format_chats(rows: DataFrame, learn: str = "assistant") -> DataFrame:
    """conv_id, formatted, loss_spans: (start, length) in characters of the texts of `learn`, as they stand in `formatted`."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"))
    rows = rows.withColumns({"name": F.url_encode("role"), "safe": escape(F.col("text"))})
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    fixed = len(OPEN) + 2 + len(CLOSE) + 2
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("place", F.row_number().over(order))
    for k, column in enumerate(("text", "safe")):
        ends = F.sum(F.length("name") + F.length(column) + fixed).over(before)
        rows = rows.withColumn(f"start{k}", F.coalesce(ends, F.lit(0)) + len(HEAD[k]) + len(OPEN) + F.length("name") + 2)
    turns = F.sort_array(F.collect_list(F.struct("place", "role", "text", "name", "safe", "start0", "start1")))
    chats = rows.groupBy("conv_id").agg(turns.alias("turns"))
    source = F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))

    def rendered(k: int) -> Column:
        column = ("text", "safe")[k]
        return F.concat(F.lit(HEAD[k]), F.array_join(F.transform("turns", lambda t: _turn(t["name"], t[column])), ""))

    def spans(k: int) -> Column:
        column = ("text", "safe")[k]
        return F.transform(F.filter("turns", lambda t: t["role"] == learn),
                           lambda t: F.struct(t[f"start{k}"].cast("long").alias("start"), F.length(t[column]).cast("long").alias("length")))

    chats = chats.withColumn("raw", rendered(0))
    chats = chats.withColumn("same", F.coalesce(parse(F.col("raw")) == source, F.lit(False)))
    chats = chats.withColumn("formatted", F.when(F.col("same"), F.col("raw")).otherwise(rendered(1)))
    checked = F.when(F.col("same") | F.coalesce(parse(F.col("formatted")) == source, F.lit(False)), F.col("formatted"))
    checked = F.coalesce(checked, F.raise_error(F.lit("a conversation does not survive the round trip")).cast("string"))
    return chats.select("conv_id", checked.alias("formatted"), F.when(F.col("same"), spans(0)).otherwise(spans(1)).alias("loss_spans"))


def learnt(formatted: Column, spans: Column) -> Column:
    """The texts under the loss mask, cut out of `formatted` by its spans and unescaped.

    Every character has four bytes while it is cut, so a span costs its own length and not its place. The mark before a piece keeps a
    leading U+FEFF, which a decoder would take for a byte order mark."""
    mark = F.encode(F.lit("|"), "UTF-32")

    def cut(wide: Column, span: Column) -> Column:
        piece = F.substr(wide, (4 * span["start"] + 1).cast("int"), (4 * span["length"]).cast("int"))
        return F.substr(F.decode(F.concat(mark, piece), "UTF-32"), F.lit(2))

    texts = let(F.encode(formatted, "UTF-32"), lambda wide: F.transform(spans, lambda s: cut(wide, s)))
    return F.when(F.substr(formatted, F.lit(7), F.lit(1)) == "1", F.transform(texts, unescape)).otherwise(texts)


def digests(formatted: DataFrame) -> DataFrame:
    """What the formatted conversations say: turns, digests of turns and of the texts under the loss mask, sizes."""
    chats = formatted.select("conv_id", "formatted", "loss_spans", parse(F.col("formatted")).alias("turns"))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    chats = chats.withColumn("loss", F.array_join(learnt(F.col("formatted"), F.col("loss_spans")), ""))
    return chats.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(whole, 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"),
                        F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


SQL = r"""
WITH given AS (
  SELECT conv_id, turn, role, text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, len(regexp_extract_all(coalesce(text, ''), '### |</turn>')) AS controls FROM given)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(9 + sum(length(role) + length(text) + controls + 15) AS BIGINT) AS formatted_chars
FROM rows GROUP BY conv_id
"""
