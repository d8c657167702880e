"""Chat formatting with a grammar round trip, in DataFrame functions only.

A turn is rendered ``<|im_start|>role NL text <|im_end|> NL``. A deterministic parser reads the
rendered text back; where the recovered turns differ from the source, the conversation is rendered
again with its conflicting content escaped, until both are identical.

Escaping is one-to-one: in ``<``, some backslashes, ``|`` it adds one backslash, and reading takes one
away. So a control string in a text can never be read as one, and a text that already looks escaped
comes back as it was. A line end in a role is written as backslash-n, a backslash as two.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
#: Rows, numbered where they are read, that are put together before whole conversations are built.
ROWS_PER_BLOCK = 4096


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def escape_role(role: Column) -> Column:
    return F.replace(F.replace(escape(role), F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))


def unescape_role(role: Column) -> Column:
    # a pair of backslashes is found from the left, so what is left of a single one begins a line end
    pieces = F.transform(F.split(role, r"\\\\"), lambda x: F.replace(x, F.lit("\\n"), F.lit("\n")))
    return unescape(F.array_join(pieces, "\\"))


def render(turns: Column, level: Column) -> Column:
    """array<struct<role,text>> to text; level 0 leaves content as it is, level 1 escapes it."""
    one = lambda t: F.concat(F.lit(START), F.when(level > 0, escape_role(t["role"])).otherwise(t["role"]), F.lit("\n"), F.when(level > 0, escape(t["text"])).otherwise(t["text"]), F.lit(END + "\n"))
    return F.array_join(F.transform(turns, one), "")


def parse(formatted: Column) -> Column:
    """Text to array<struct<role,text>>; null where it is not a sentence of the grammar."""
    parts = F.split(formatted, r"<\|im_start\|>", -1)
    body = F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))
    tail = END + "\n"
    good = (F.element_at(parts, 1) == "") & F.forall(body, lambda s: s.endswith(tail) & s.contains("\n") & (F.instr(s, END) == F.length(s) - len(tail) + 1))
    turn = lambda s: F.struct(
        unescape_role(F.substring_index(s, "\n", 1)).alias("role"),
        unescape(F.substring(s, F.instr(s, "\n") + 1, F.length(s) - F.instr(s, "\n") - len(tail))).alias("text"),
    )
    return F.when(good, F.transform(body, turn))


def format_chats(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", train_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row per conversation: id, ``formatted``, ``escape_level``, ``loss_spans``, ``identical``.

    ``loss_spans``: array of (turn, start, length): characters of the rendered turn (0-based, from its
    ``<|im_start|>``) on which a model is trained, the texts of ``train_roles`` without control strings.
    ``identical``: whether parsing gives the source turns (always true; kept as the proof).

    Rows of a conversation are taken by turn, ties by role and text, null turns first. Null roles and
    texts are empty; a null id is a conversation like any other. Repeated rows are turns of their own.
    Columns besides the four named ones are not read. An empty table gives no rows.

    Rows are first joined in blocks by where they are read, whatever their turns are, so a conversation that
    holds a large part of all rows is put together from pieces of bounded size.
    """
    rows = conversations.select(
        F.col(id_col).alias("conv_id"),
        F.col(turn_col).cast("long").alias("turn"),
        F.coalesce(F.col(role_col), F.lit("")).alias("role"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    ).withColumn("block", F.floor(F.monotonically_increasing_id() / ROWS_PER_BLOCK))
    blocks = rows.groupBy("conv_id", "block").agg(F.collect_list(F.struct("turn", "role", "text")).alias("turns"))
    chats = blocks.groupBy("conv_id").agg(F.collect_list("turns").alias("blocks"))
    chats = chats.select("conv_id", F.transform(F.sort_array(F.flatten("blocks")), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))
    tried = chats.withColumn("raw", render(F.col("turns"), F.lit(0)))
    tried = tried.withColumn("escape_level", F.when(parse(F.col("raw")).eqNullSafe(F.col("turns")), 0).otherwise(1))
    done = tried.withColumn("formatted", F.when(F.col("escape_level") == 0, F.col("raw")).otherwise(render(F.col("turns"), F.lit(1))))
    lead = lambda t: F.when(F.col("escape_level") > 0, escape_role(t["role"])).otherwise(t["role"])
    body = lambda t: F.when(F.col("escape_level") > 0, escape(t["text"])).otherwise(t["text"])
    spans = F.transform("turns", lambda t, i: F.when(t["role"].isin(*train_roles), F.struct(i.cast("long").alias("turn"), (F.length(lead(t)) + len(START) + 1).cast("long").alias("start"), F.length(body(t)).cast("long").alias("length"))))
    return done.select(
        "conv_id", "formatted", "escape_level", F.filter(spans, lambda s: s.isNotNull()).alias("loss_spans"),
        parse(F.col("formatted")).eqNullSafe(F.col("turns")).alias("identical"),
    )


def read_chats(formatted: DataFrame) -> DataFrame:
    """Read formatted conversations back: conv_id, ``turns`` as the parser finds them, ``loss_text`` (the text under the loss mask, unescaped), ``formatted``."""
    parts = F.split(F.col("formatted"), r"(?=<\|im_start\|>)")
    masked = F.transform("loss_spans", lambda s: unescape(F.substring(F.get(parts, s["turn"].cast("int")), s["start"].cast("int") + 1, s["length"].cast("int"))))
    return formatted.select("conv_id", "formatted", parse(F.col("formatted")).alias("turns"), F.array_join(masked, "").alias("loss_text"))


def chat_digest(formatted: DataFrame) -> DataFrame:
    """What the contract asks for, from the output alone."""
    back = read_chats(formatted)
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(whole.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
