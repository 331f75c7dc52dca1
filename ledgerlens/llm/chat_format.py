"""Chat formatting with Spark expressions only: sorted turn structs, merged same-role turns, one string and its loss mask.

Template: a block is ``<|start|>role<|say|>text<|end|>``.  Adjacent turns of one role share a block, their texts stand
apart by ``<|next|>``, so reading back gives the turns as they were.  Control strings inside texts and roles (the marks
of this template and of the common ``[INST]`` and ``<<SYS>>`` ones) get a backslash behind their first character;
where backslashes stand there already, one more.  That is reversible and leaves all other texts alone.

A conversation is cut into pieces of ``PIECE_TURNS`` turn numbers, so a very long one is spread over tasks; a block
that goes on in the next piece is left open there.  Only one small row a piece meets in a window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.llm.common import stored

START, SAY, NEXT, END = "<|start|>", "<|say|>", "<|next|>", "<|end|>"
#: Opening character, backslashes so far, the rest of a control string.
_REST = r"(\|[A-Za-z0-9_]+\|>|/?s>|/?INST\]|</?SYS>>)"
ESCAPE, UNESCAPE = r"([<\[])(\\*)" + _REST, r"([<\[])\\(\\*)" + _REST
PIECE_TURNS = 256
LEARNED = "assistant"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPE, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, UNESCAPE, "$1$2$3")


def _literal(mark: str) -> str:
    return mark.replace("|", r"\|")


def turn_pieces(rows: DataFrame, piece_turns: int = PIECE_TURNS) -> DataFrame:
    """One row per (conv_id, piece): ``blocks`` of adjacent same-role turns, each (role, texts), in order of
    (turn, role, text).  Turns without a number come first; null texts and roles are empty."""
    clean = rows.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    piece = F.coalesce(F.floor(F.col("turn") / piece_turns), F.lit(-(1 << 62)))
    turns = clean.groupBy("conv_id", piece.alias("piece")).agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    role = lambda i: F.get("turns", i)["role"]
    at = F.filter(F.sequence(F.lit(0), F.size("turns") - 1), lambda i: (i == 0) | (role(i) != role(i - 1)))
    to = lambda j: F.coalesce(F.get("at", j + 1), F.size("turns"))
    return turns.withColumn("at", at).select("conv_id", "piece", F.transform("at", lambda i, j: F.struct(
        role(i).alias("role"),
        F.transform(F.slice("turns", i + 1, to(j) - i), lambda t: t["text"]).alias("texts"))).alias("blocks"))


def format_conversations(rows: DataFrame, piece_turns: int = PIECE_TURNS, learned: str = LEARNED) -> DataFrame:
    """``rows(conv_id, turn, role, text)`` as formatted pieces.

    Returns (conv_id, piece, formatted, segments): the pieces of a conversation, concatenated in order, are its
    formatted text; ``segments`` are the same text cut into (text, loss), where ``loss`` marks exactly the escaped
    texts of ``learned`` turns.  Rows repeating a turn number are all kept, ordered by role and text.  Rows whose
    ``conv_id`` is null are one conversation.  Other columns are ignored.  No rows give no rows.
    """
    pieces = stored(turn_pieces(rows, piece_turns), "turn-pieces")
    ends = pieces.select("conv_id", "piece", F.get("blocks", F.lit(0))["role"].alias("first"),
                         F.element_at("blocks", -1)["role"].alias("last"))
    w = Window.partitionBy("conv_id").orderBy("piece")
    ends = ends.select("conv_id", "piece", F.coalesce(F.lag("last").over(w) == F.col("first"), F.lit(False)).alias("goes_on"),
                       F.coalesce(F.lead("first").over(w) == F.col("last"), F.lit(False)).alias("open"))
    ends = ends.where("goes_on or open").select(F.col("conv_id").alias("_c"), F.col("piece").alias("_p"), "goes_on", "open")
    joined = pieces.join(ends, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("piece") == F.col("_p")), "left")
    segment = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
    no = F.lit(False)

    def block(b: Column, j: Column) -> Column:
        head = F.when((j == 0) & F.coalesce("goes_on", no), F.lit(NEXT)).otherwise(F.concat(F.lit(START), escape(b["role"]), F.lit(SAY)))
        tail = F.when((j == F.size("blocks") - 1) & F.coalesce("open", no), F.lit("")).otherwise(F.lit(END))
        texts = F.transform(b["texts"], lambda t, i: F.array(
            segment(F.when(i == 0, head).otherwise(F.lit(NEXT)), no), segment(escape(t), b["role"] == learned)))
        return F.concat(F.flatten(texts), F.array(segment(tail, no)))

    cut = joined.select("conv_id", "piece", F.flatten(F.transform("blocks", block)).alias("segments"))
    return cut.select("conv_id", "piece", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), "segments")


def read_turns(formatted: Column) -> Column:
    """The turns (role, text) of a whole formatted conversation, in order."""
    blocks = F.split(formatted, _literal(END), -1)
    parts = F.transform(F.slice(blocks, 1, F.size(blocks) - 1), lambda b: F.split(F.substr(b, F.lit(len(START) + 1)), _literal(SAY), 2))
    return F.flatten(F.transform(parts, lambda p: F.transform(F.split(p[1], _literal(NEXT), -1), lambda t: F.struct(
        unescape(p[0]).alias("role"), unescape(t).alias("text")))))


def read_learned(segments: Column) -> Column:
    """The text under the loss mask, unescaped turn by turn, nothing between."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"])), "")


def conversations(pieces: DataFrame) -> DataFrame:
    """One row per conversation: ``formatted``, ``turns`` read back from it, ``learned`` read back from the mask."""
    whole = pieces.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct(
        "piece", "formatted", read_learned(F.col("segments")).alias("learned")))).alias("p"))
    join = lambda name: F.array_join(F.transform("p", lambda x: x[name]), "")
    whole = whole.select("conv_id", join("formatted").alias("formatted"), join("learned").alias("learned"))
    return whole.select("conv_id", "formatted", read_turns(F.col("formatted")).alias("turns"), "learned")
