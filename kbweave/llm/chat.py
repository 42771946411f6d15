"""Chat formatting with a grammar round trip, in DataFrame functions only.

Grammar of the output (one conversation is a sequence of turns):

    turn := START role NL body END NL

with START ``<|im_start|>``, END ``<|im_end|>``; role has no line break, and
neither role nor body holds START or END. Reading back undoes one escape step in
role and body. A turn is first rendered as it is and parsed again; where the
parser does not give back the very role and text, its content is escaped, which
the parser always reads back (rules below), so the second rendering is final.

Escape: a backslash is put after the ``<`` of every ``<|`` and ``<n|``, also
where backslashes already stand there (``<\\|`` becomes ``<\\\\|``); a line break
in a role becomes ``<n|``. The reverse removes one backslash. Both are one
regular expression each and inverse to each other for every string.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"


def escape(c: Column) -> Column:
    return F.regexp_replace(c, r"<(\\*)(n?\|)", r"<\\$1$2")


def escape_role(c: Column) -> Column:
    return F.replace(escape(c), F.lit("\n"), F.lit("<n|"))


def unescape(c: Column) -> Column:
    return F.regexp_replace(F.replace(c, F.lit("<n|"), F.lit("\n")), r"<\\(\\*)(n?\|)", "<$1$2")


def render(role: Column, body: Column) -> Column:
    return F.concat(F.lit(START), role, F.lit("\n"), body, F.lit(END + "\n"))


def parse(formatted: Column) -> Column:
    """Formatted text -> array of (role, body, text, ok); ``body`` is still
    escaped, ``ok`` tells whether the piece follows the grammar to its end."""
    def turn(piece):
        role = F.substring_index(piece, "\n", 1)
        rest = F.substr(piece, F.length(role) + 2)
        body = F.substring_index(rest, END, 1)
        return F.struct(unescape(role).alias("role"), body.alias("body"), unescape(body).alias("text"),
                        (piece == F.concat(role, F.lit("\n"), body, F.lit(END + "\n"))).alias("ok"))
    pieces = F.split(formatted, r"<\|im_start\|>")
    return F.transform(F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0))), turn)


def _reads_back(role: Column, text: Column) -> Column:
    got = parse(render(role, text))
    return ((F.size(got) == 1) & F.coalesce(F.get(got, F.lit(0))["ok"], F.lit(False))
            & F.coalesce(F.get(got, F.lit(0))["role"] == role, F.lit(False))
            & F.coalesce(F.get(got, F.lit(0))["text"] == text, F.lit(False)))


def format_chats(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
                 text: str = "text", learn: str = "assistant") -> DataFrame:
    """One row per conversation: ``(conv, formatted, loss_spans, round_trip_ok)``.

    Rows go by ``turn`` (null first), ties by role and text, repeated rows each
    give a turn. Null role or text counts as empty; a null conversation id is a
    conversation of its own; other columns are ignored; no rows give none.
    ``loss_spans`` holds start and length, in code points of ``formatted``, of
    every ``learn`` turn's body. ``round_trip_ok`` compares the turns read back
    from ``formatted`` with the source. A conversation is one string by
    definition, so its size bounds the largest row; escaping, checking and
    lengths are computed per turn before any shuffle."""
    t = turns.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"),
                     F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"),
                     F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    plain = F.col("plain")
    t = t.withColumn("plain", _reads_back(F.col("role"), F.col("text")))
    t = t.select("conv", "turn", "role", "text", (F.col("role") == learn).alias("learn"), F.xxhash64("role", "text").alias("h"),
                 F.when(plain, F.col("role")).otherwise(escape_role(F.col("role"))).alias("r"),
                 F.when(plain, F.col("text")).otherwise(escape(F.col("text"))).alias("b"))
    order = W.partitionBy("conv").orderBy("turn", "role", "text")     # as in the source, not as escaped
    size = F.length("r") + F.length("b") + F.lit(len(START) + len(END) + 2)
    t = (t.withColumn("no", F.row_number().over(order))
         .withColumn("start", F.sum(size.cast("long")).over(order.rowsBetween(W.unboundedPreceding, -1))))
    t = t.withColumn("start", F.coalesce("start", F.lit(0)) + F.length("r") + F.lit(len(START) + 1))
    g = t.groupBy("conv").agg(
        F.array_sort(F.collect_list(F.struct("no", "r", "b", "h"))).alias("turns"),
        F.array_sort(F.collect_list(F.when(F.col("learn"), F.struct(
            "start", F.length("b").cast("long").alias("length"))))).alias("loss_spans"))
    g = g.select(F.col("conv").alias(conv), F.array_join(F.transform(
        "turns", lambda x: render(x["r"], x["b"])), "").alias("formatted"), "loss_spans", F.col("turns.h").alias("h"))
    got = parse(F.col("formatted"))
    same = (F.forall(got, lambda x: x["ok"])
            & (F.transform(got, lambda x: F.xxhash64(x["role"], x["text"])) == F.col("h")))
    return g.select(conv, "formatted", "loss_spans", same.alias("round_trip_ok"))


def chat_digest(chats: DataFrame, conv: str = "conv_id", learn: str = "assistant") -> DataFrame:
    """What the formatted text says, read back from it alone."""
    got = chats.withColumn("got", parse(F.col("formatted")))
    all_turns = F.array_join(F.transform("got", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    learnt = F.array_join(F.transform(F.filter("got", lambda x: x["role"] == learn), lambda x: x["text"]), "")
    return got.select(
        conv, F.size("got").cast("long").alias("n_turns"), F.sha2(all_turns, 256).alias("turns_sha256"),
        F.length(learnt).cast("long").alias("loss_chars"), F.sha2(learnt, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        F.size("loss_spans").cast("long").alias("n_loss_spans"), "round_trip_ok")
