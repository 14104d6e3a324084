"""Chat formatting: turns of typed content parts become one text with marked turns, placeholders and a loss mask.

A turn is ``<|turn|>role\\ncontent<|end|>\\n``. Inside roles and texts a backslash is doubled and ``<|`` becomes
``<\\|``, so the marks never occur there and :func:`unescape` gives back what went in. A role's line breaks are
escaped too. All steps are column expressions, one shuffle by conversation.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TURN, END = "<|turn|>", "<|end|>\n"
PARTS = "array<struct<type:string,text:string,ref:string,units:double>>"


@dataclass(frozen=True)
class Expansion:
    """Tokens that a placeholder stands for: so many for each unit (image tile, second of audio, document page)."""

    image: int = 256
    audio: int = 25
    document: int = 512


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def unescape_role(role: Column) -> Column:
    """A lone ``\\n`` pair is a line break; doubled backslashes are cut away first, so none hides in them."""
    plain = F.transform(F.split(role, r"\\\\"), lambda x: F.replace(F.replace(x, F.lit("<\\|"), F.lit("<|")), F.lit("\\n"), F.lit("\n")))
    return F.array_join(plain, "\\")


def text_parts(text: Column) -> Column:
    return F.array(F.struct(F.lit("text").alias("type"), F.coalesce(text, F.lit("")).alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("double").alias("units"))).cast(PARTS)


def visit(part: Column, by: Expansion) -> Column:
    """The piece of one part: ``text`` to insert, ``ref`` and ``tokens`` of what it stands for (0 for text)."""
    kind = F.coalesce(part["type"], F.lit("text"))
    units = F.coalesce(part["units"], F.lit(1.0))
    piece = F.when(kind == "text", F.coalesce(escape(part["text"]), F.lit("")))
    tokens = F.lit(0).cast("long")
    for name, each in (("image", by.image), ("audio", by.audio), ("document", by.document)):
        piece = piece.when(kind == name, f"<|{name}|>")
        tokens = F.when(kind == name, F.ceil(units * each).cast("long")).otherwise(tokens)
    piece = piece.otherwise(F.concat(F.lit("<|unknown:"), F.replace(escape(kind), F.lit("\n"), F.lit(" ")), F.lit("|>")))
    return F.struct(piece.alias("text"), F.when(kind != "text", part["ref"]).alias("ref"), F.when(kind != "text", kind).alias("kind"), tokens.alias("tokens"))


def format_turns(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", content: str = "content", learn: str = "assistant", by: Expansion = Expansion()) -> DataFrame:
    """One row per conversation: ``conv, n_turns, formatted, segments, loss_spans, attachments, expanded_tokens``.

    ``content`` is an array of typed parts (``PARTS``). ``segments`` cut the formatted text in order, each with
    its ``start`` (code points) and ``loss``: whether it is learnt; ``loss_spans`` are the learnt ones' bounds.
    ``attachments`` lists what the placeholders stand for, in order. Null content, parts, texts and roles count
    as empty; rows of the same turn are ordered by role and content; a null conversation id is a conversation of
    its own; other columns are not carried; an empty table gives no rows.
    """
    pieces = F.transform(F.coalesce(F.col(content), F.array().cast(PARTS)), lambda p: visit(p, by))
    rows = turns.select(
        F.col(conv).alias("__conv"), F.col(turn).alias("__turn"), F.coalesce(F.col(role), F.lit("")).alias("__role"),
        F.concat(F.lit(TURN), escape_role(F.coalesce(F.col(role), F.lit(""))), F.lit("\n")).alias("head"),
        F.array_join(F.transform(pieces, lambda p: p["text"]), "").alias("body"),
        F.filter(pieces, lambda p: p["kind"].isNotNull()).alias("att"),
    )
    order = Window.partitionBy("__conv").orderBy("__turn", "__role", "body")
    size = F.length("head") + F.length("body") + len(END)
    rows = rows.withColumns({"start": F.sum(size.cast("long")).over(order.rowsBetween(Window.unboundedPreceding, -1)), "loss": F.col("__role") == learn})
    begin = F.coalesce("start", F.lit(0).cast("long"))
    seg = F.struct(
        F.col("__turn").alias("turn"), F.col("__role").alias("role"), F.col("body").alias("b"),
        begin.alias("start"), F.col("head"), F.col("loss"), F.col("att"),
    )
    got = rows.groupBy("__conv").agg(F.array_sort(F.collect_list(F.struct(begin.alias("at"), seg.alias("s")))).alias("t"))
    turn_segments = F.flatten(F.transform("t", lambda x: F.array(
        F.struct(x["s"]["start"].alias("start"), x["s"]["head"].alias("text"), F.lit(False).alias("loss")),
        F.struct((x["s"]["start"] + F.length(x["s"]["head"])).alias("start"), x["s"]["b"].alias("text"), x["s"]["loss"].alias("loss")),
        F.struct((x["s"]["start"] + F.length(x["s"]["head"]) + F.length(x["s"]["b"])).alias("start"), F.lit(END).alias("text"), F.lit(False).alias("loss")),
    )))
    out = got.select(F.col("__conv").alias(conv), F.size("t").cast("long").alias("n_turns"), turn_segments.alias("segments"), F.flatten(F.transform("t", lambda x: x["s"]["att"])).alias("att"))
    return out.select(
        conv, "n_turns", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), "segments",
        F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: F.struct(s["start"], (s["start"] + F.length(s["text"])).alias("end"))).alias("loss_spans"),
        F.transform("att", lambda a: F.struct(a["kind"], a["ref"], a["tokens"])).alias("attachments"),
        F.aggregate("att", F.lit(0).cast("long"), lambda n, a: n + a["tokens"]).alias("expanded_tokens"),
    )


def read_turns(formatted: Column) -> Column:
    """The formatted text back as ``array<struct<role, text>>`` (placeholders stay as they are)."""
    turns = F.filter(F.split(formatted, r"<\|end\|>\n"), lambda x: x.startswith(TURN))
    cut = F.transform(turns, lambda x: F.substring(x, F.lit(len(TURN) + 1), F.length(x)))
    return F.transform(cut, lambda x: F.struct(
        unescape_role(F.substring_index(x, "\n", 1)).alias("role"),
        unescape(F.substring(x, F.instr(x, "\n") + 1, F.length(x))).alias("text"),
    ))
