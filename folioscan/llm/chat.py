"""Chat formatting with a grammar round trip (operator 3); DataFrame functions only.

    conversation := turn*
    turn         := "### " role mark ": " text " </turn>" newline
    role         := the role, percent-encoded        mark := "" | "/2"

Control strings inside a text (`###`, `</turn>`) get a backslash more than stood before
them. A deterministic parser splits rendered text at turn ends and takes off what escaping
put on. Each rendering is parsed again: it stands if it gives back exactly its turn, and
otherwise the next stronger escape is tried (all of `\\`, `#` and `<` replaced, mark `/2`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CONTROL = r"(###|</turn>)"
START, HEAD_END, END = "### ", ": ", " </turn>\n"
STRONG = "/2"


def _weak(text: Column) -> Column:
    return F.regexp_replace(text, r"(\\*)" + CONTROL, r"\\$1$2")


def _unweak(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(\\*)" + CONTROL, "$1$2")


def _strong(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("\\"), F.lit("\\b")), F.lit("#"), F.lit("\\h")), F.lit("<"), F.lit("\\l"))


def _unstrong(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("\\l"), F.lit("<")), F.lit("\\h"), F.lit("#")), F.lit("\\b"), F.lit("\\"))


def parse(formatted: Column) -> Column:
    """array<struct<role,text>> of a rendered conversation."""
    pieces = F.filter(F.split(formatted, END), lambda p: p != "")

    def turn(piece: Column) -> Column:
        head = F.substring_index(piece, HEAD_END, 1)
        name = F.substr(head, F.lit(len(START) + 1))
        body = F.substr(piece, F.char_length(head) + len(HEAD_END) + 1)
        strong = F.endswith(name, F.lit(STRONG))
        role = F.when(strong, F.substr(name, F.lit(1), F.char_length(name) - len(STRONG))).otherwise(name)
        return F.struct(F.url_decode(role).alias("role"), F.when(strong, _unstrong(body)).when(body.contains("\\"), _unweak(body)).otherwise(body).alias("text"))

    return F.transform(pieces, turn)


def _rendered(role: Column, text: Column, mark: str = "") -> Column:
    return F.concat(F.lit(START), role, F.lit(mark + HEAD_END), text, F.lit(END))


def render_turns(turns: DataFrame, role_col: str = "role", text_col: str = "text") -> DataFrame:
    """turns with `_role`, `_text` (nulls made empty), `_body` (the escaped text), `_strong` (by which escape) and `_rendered`."""
    role, text, weak = F.col("_role"), F.col("_text"), F.col("_weak")
    name = F.url_encode(role)
    source = F.array(F.struct(role.alias("role"), text.alias("text")))
    conflicting = text.rlike(CONTROL)
    back = parse(_rendered(name, weak))
    done = turns.withColumn("_role", F.coalesce(F.col(role_col).cast("string"), F.lit(""))).withColumn("_text", F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    done = done.withColumn("_weak", F.when(conflicting, _weak(text)).otherwise(text))
    done = done.withColumn("_plain", F.when(conflicting | text.contains("\\"), back == source).otherwise(F.lit(True)))
    done = done.withColumn("_strong", ~F.col("_plain")).withColumn("_body", F.when(F.col("_plain"), weak).otherwise(_strong(text)))
    return done.withColumn("_rendered", F.when(F.col("_plain"), _rendered(name, F.col("_body"))).otherwise(_rendered(name, F.col("_body"), STRONG))).drop("_weak", "_plain")


def format_conversations(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", loss_role: str = "assistant") -> DataFrame:
    """conv_id, formatted, loss_spans, identical of every conversation.

    loss_spans: array<struct<start,end,strong>> of code points, end exclusive: the escaped
    texts of loss_role's turns, and by which escape. identical: whether parsing `formatted`
    gives back the source turns (compared by MD5 here; each turn by itself was compared whole).
    Turns go by turn, then role, then text, so repeated turns all stay, in a fixed order,
    and null turns come first. Null texts and roles count as empty, rows with a null id form
    one conversation, other columns are ignored. A conversation is one string by nature: its
    rendered turns meet in one task, which holds that one conversation and no others.
    """
    rows = turns.select(F.col(id_col).alias("conv_id"), F.col(turn_col).alias("_turn"), F.col(role_col).alias("_in_role"), F.col(text_col).alias("_in_text"))
    rows = render_turns(rows, "_in_role", "_in_text")
    before = Window.partitionBy("conv_id").orderBy("_turn", "_role", "_text").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_at", F.coalesce(F.sum(F.char_length("_rendered")).over(before), F.lit(0)))
    body_at = F.col("_at") + F.char_length("_rendered") - F.char_length("_body") - len(END)
    span = F.struct(body_at.alias("start"), (body_at + F.char_length("_body")).alias("end"), F.col("_strong").alias("strong"))
    one = F.struct("_at", "_rendered", F.when(F.col("_role") == loss_role, span).alias("_span"), _digest(F.col("_role"), F.col("_text")).alias("_md5"))
    joined = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(one)).alias("t"))
    joined = joined.withColumn("formatted", F.array_join(F.transform("t", lambda x: x["_rendered"]), ""))
    return joined.select(
        "conv_id",
        "formatted",
        F.filter(F.transform("t", lambda x: x["_span"]), lambda s: s.isNotNull()).alias("loss_spans"),
        (F.transform(parse(F.col("formatted")), lambda x: _digest(x["role"], x["text"])) == F.transform("t", lambda x: x["_md5"])).alias("identical"),
    )


def _digest(role: Column, text: Column) -> Column:
    return F.md5(F.concat(role, F.lit("\n"), text))


def unescape(body: Column, strong: Column) -> Column:
    """The text of a loss span."""
    return F.when(strong, _unstrong(body)).when(body.contains("\\"), _unweak(body)).otherwise(body)


def loss_text(formatted: Column, loss_spans: Column) -> Column:
    """All text under the loss mask of a rendered conversation, cut out by its spans, in order, unescaped."""
    return F.array_join(F.transform(loss_spans, lambda s: unescape(F.substr(formatted, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")), s["strong"])), "")
