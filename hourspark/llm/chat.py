"""Chat formatting with a grammar round trip, in DataFrame functions only.

A conversation is rendered turn by turn as ``### role: text </turn>`` and a line feed.  Each rendered turn is
parsed again; if what comes back differs from the source, or holds a control string, its content is escaped
(a backslash before what conflicts), which always comes back identical.  The loss mask is a list of byte spans,
one for each assistant text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HEAD, SEPARATOR, END_MARK = "### ", ": ", "</turn>"
END = f" {END_MARK}\n"
LEARNT = "assistant"


def escaped(x: Column, role: bool = False) -> Column:
    x = F.replace(x, F.lit("\\"), F.lit("\\\\"))
    x = F.replace(x, F.lit("#"), F.lit("\\#"))
    x = F.replace(x, F.lit(END_MARK), F.lit("<\\/turn>"))
    return F.replace(x, F.lit(SEPARATOR), F.lit(":\\ ")) if role else x


def unescaped(x: Column) -> Column:
    return F.regexp_replace(x, r"(?s)\\(.)", "$1")


def rendered(role: Column, body: Column) -> Column:
    return F.concat(F.lit(HEAD), role, F.lit(SEPARATOR), body, F.lit(END))


def parsed(piece: Column) -> Column:
    """(role, text) of a rendered turn without its end; null if it is no sentence of the grammar."""
    cut = F.position(F.lit(SEPARATOR), piece)
    role, body = F.substr(piece, F.lit(len(HEAD) + 1), cut - len(HEAD) - 1), F.substr(piece, cut + len(SEPARATOR))
    clean = lambda x: ~F.contains(x, F.lit("###")) & ~F.contains(x, F.lit(END_MARK))
    whole = F.startswith(piece, F.lit(HEAD)) & (cut > len(HEAD)) & clean(role) & clean(body)
    return F.when(whole, F.struct(unescaped(role).alias("role"), unescaped(body).alias("text")))


def _comes_back(role: Column, text: Column) -> Column:
    """Whether the unescaped rendering of a turn parses to just this turn."""
    pieces = F.split(rendered(role, text), END, -1)
    back = parsed(pieces[0])
    return F.coalesce((F.size(pieces) == 2) & (back["role"] == role) & (back["text"] == text), F.lit(False))


def formatted(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation: conv_id, n_turns, formatted, loss (byte spans start, length) and identical.

    Turns follow ``turn`` (null first), ties by role and text; null roles and texts are empty; repeated rows are
    repeated turns; a null conv_id is a conversation of its own; an empty table gives no rows.  A conversation is
    one string, so its rows meet in one task; rows of different conversations spread.  identical: the reparsed
    whole equals the source turns.
    """
    rows = turns.select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    plain = _comes_back(F.col("role"), F.col("text"))
    rows = rows.withColumn("plain", plain)
    safe = rows.select(
        "conv_id", "turn", "role", "text", F.when(F.col("plain"), F.col("role")).otherwise(escaped(F.col("role"), True)).alias("r"),
        F.when(F.col("plain"), F.col("text")).otherwise(escaped(F.col("text"))).alias("b"),
    )
    size = F.octet_length("r") + F.octet_length("b") + len(HEAD) + len(SEPARATOR) + len(END)
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    safe = safe.withColumns({"upto": F.sum(size).over(order)})
    body = (F.col("upto") - F.octet_length("b") - len(END)).cast("int")
    span = F.when(F.col("role") == LEARNT, F.struct(body.alias("start"), F.octet_length("b").alias("length")))
    one = F.struct("upto", rendered(F.col("r"), F.col("b")).alias("piece"), span.alias("span"), F.struct("role", "text").alias("source"))
    whole = safe.groupBy("conv_id").agg(F.array_sort(F.collect_list(one)).alias("t"))
    whole = whole.select("conv_id", F.size("t").cast("long").alias("n_turns"), F.concat_ws("", F.col("t.piece")).alias("formatted"), F.array_compact("t.span").alias("loss"), F.col("t.source").alias("source"))
    return whole.withColumn("identical", recovered() == F.col("source")).drop("source")


def recovered(column: str = "formatted") -> Column:
    """The turns (role, text) of a formatted conversation, by the deterministic parser."""
    pieces = F.split(F.col(column), END, -1)
    return F.transform(F.slice(pieces, 1, F.greatest(F.size(pieces) - 1, F.lit(0))), parsed)


def learnt(column: str = "formatted", loss: str = "loss") -> Column:
    """The text under the loss mask, unescaped, in order, with nothing between."""
    spans = F.transform(F.array(F.col(column).cast("binary")), lambda raw: F.transform(F.col(loss), lambda s: unescaped(F.substr(raw, s["start"] + 1, s["length"]).cast("string"))))
    return F.concat_ws("", spans[0])


def digests(whole: DataFrame) -> DataFrame:
    """What a formatted table holds, read from its text and mask alone."""
    out = whole.select("conv_id", F.length("formatted").cast("long").alias("formatted_chars"), recovered().alias("turns"), learnt().alias("learnt"))
    told = F.concat_ws("", F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))))
    return out.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"),
        F.length("learnt").cast("long").alias("loss_chars"), F.sha2("learnt", 256).alias("loss_sha256"), "formatted_chars",
    )
