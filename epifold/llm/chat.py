"""Format conversations in windows of limited length, with DataFrame functions only.

Prefix sums of the turns' tokens cut a conversation into spans of whole turns:
a turn belongs to the stride of half the ``budget`` in which it starts. A window
holds the leading system turn again, as many of the turns before its span as the
budget leaves room for (at most ``history`` tokens), and its own span. Where the
span begins with an assistant turn, the turn before it, which it answers, always
comes along. Only assistant turns of its own span are under the loss mask, so
every target counts once.

A turn is written ``<s>role[INST]text[/INST]</s>``. Inside roles and texts a
backslash is doubled and a control string is broken by a backslash after its
first character, so control strings only come from the template and the texts
can be read back.

A window exceeds the budget only by its own last turn, which starts within the
stride, or by the turn that its first one answers; ``tokens`` shows it.

Turns are ranked and summed by their lengths and digests alone, over ranges of a
conversation (``operators.ranges``), so that one conversation may be of any
length; texts join them once the windows are known, and a window's text is all
that is ever held together.

Defined results: NULL roles and texts are empty, NULL turns come first, rows with
one turn number are ordered by role and the digest of the text and all kept. Rows
without ``conv_id`` are one conversation with a NULL id. Windows are numbered by
their stride; a stride in which no turn starts has none. Other columns are
ignored, an empty table has no window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from epifold.operators.joins import join_per_key
from epifold.operators.ranges import prefix_sums
from epifold.sources.storage import Scratch

# Control strings, all of which are broken inside texts.
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
OPEN, MIDDLE, CLOSE = "<s>", "[INST]", "[/INST]</s>"
BREAK = r"([<\[])(?=/?s>|/?INST\]|</?SYS>>)"
UNBREAK = r"(?s)\\(.)"

SYSTEM, ASSISTANT = "system", "assistant"
BUDGET = 512
#: Tokens that the template adds to a turn.
MARKUP = 4


def escape(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit(BREAK), F.lit(r"$1\\"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(UNBREAK), F.lit("$1"))


def tokens(text: Column) -> Column:
    """Tokens of a turn: its words and the template's."""
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long") + MARKUP


def _ranked(scratch: Scratch, rows: DataFrame) -> DataFrame:
    """Turns without their texts: (conv_id, turn, role, print, tokens, idx, start), ``idx`` from 1 on."""
    cells = rows.groupBy("conv_id", "turn", "role", "print").agg(F.first("tokens").alias("tokens"), F.count(F.lit(1)).alias("copies"))
    at = F.struct(F.col("turn").isNotNull(), "turn", "role", "print")
    cells = cells.withColumns({"at": at, "span": F.col("tokens") * F.col("copies")})
    fixed = lambda df: scratch.store(df, "cells")
    summed = prefix_sums(cells, ["conv_id"], "at", {"until": "copies", "stop": "span"}, fix=fixed)
    each = summed.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    return each.select(
        "conv_id",
        "turn",
        "role",
        "print",
        "tokens",
        (F.col("until") - F.col("copies") + F.col("k") + 1).alias("idx"),
        (F.col("stop") - F.col("tokens") * (F.col("copies") - F.col("k"))).alias("start"),
    )


def _placed(scratch: Scratch, rows: DataFrame, budget: int, history: int) -> DataFrame:
    """(conv_id, turn, role, print, tokens, idx, window, new): every turn of every window, without texts."""
    stride = max(1, budget // 2)
    turns = scratch.store(_ranked(scratch, rows).withColumn("window", F.floor(F.col("start") / stride).cast("long")), "turns")
    leading = (F.col("idx") == 1) & (F.col("role") == SYSTEM)
    system = turns.where(leading)
    spans = turns.groupBy("conv_id", "window").agg(
        F.min("start").alias("begin"),
        F.min("idx").alias("first"),
        F.min_by("role", "idx").alias("first_role"),
        F.sum("tokens").alias("own"),
    )
    spans = join_per_key(spans, system.select("conv_id", F.col("tokens").alias("kept")), ["conv_id"], "left")
    room = F.lit(budget) - F.col("own") - F.coalesce("kept", F.lit(0))
    answers = (F.col("first_role") == ASSISTANT) & (F.col("first") > 1)
    spans = scratch.store(spans.select("conv_id", "window", "begin", "first", F.least(F.lit(history), room).alias("room"), answers.alias("answers")), "spans")
    columns = ["conv_id", "turn", "role", "print", "tokens", "idx", "window"]
    # A turn is history of windows that start at most a budget behind its start.
    reach = -(-budget // stride) + 1
    later = turns.where(~leading).withColumn("window", F.explode(F.sequence(F.col("window") + 1, F.col("window") + reach)))
    later = join_per_key(later, spans, ["conv_id", "window"])
    recent = later.where((F.col("begin") - F.col("start") <= F.col("room")) & ~(F.col("answers") & (F.col("idx") == F.col("first") - 1)))
    asked = spans.where("answers").select("conv_id", F.col("window").alias("beside"), (F.col("first") - 1).alias("idx"))
    # One window at most begins behind a turn.
    prompts = join_per_key(turns.where(~leading).drop("window"), asked, ["conv_id", "idx"]).withColumnRenamed("beside", "window")
    again = join_per_key(spans.where("first > 1").select("conv_id", "window"), system.drop("window"), ["conv_id"])
    repeated = recent.select(columns).unionByName(prompts.select(columns)).unionByName(again.select(columns))
    return turns.select(*columns, F.lit(True).alias("new")).unionByName(repeated.withColumn("new", F.lit(False)))


def windows(turns: DataFrame, budget: int = BUDGET, history: int | None = None) -> DataFrame:
    """(conv_id, window, formatted, repeated, loss, tokens): one row per window.

    ``repeated`` counts the leading turns that are system or history, ``loss``
    lists the spans [start, stop) of characters under the mask.
    """
    empty = F.lit("")
    rows = turns.select(
        "conv_id",
        "turn",
        F.coalesce(F.col("role").cast("string"), empty).alias("role"),
        F.coalesce(F.col("text").cast("string"), empty).alias("text"),
    ).withColumn("print", F.md5(F.col("text").cast("binary")))
    with Scratch(turns.sparkSession, "chat") as scratch:
        lengths = rows.select("conv_id", "turn", "role", "print", tokens(F.col("text")).alias("tokens"))
        placed = scratch.keep(_placed(scratch, lengths, budget, budget if history is None else history))
    key = ["conv_id", "turn", "role", "print"]
    texts = rows.groupBy(*key).agg(F.first("text").alias("text"))
    role, text = escape(F.col("role")), escape(F.col("text"))
    written = join_per_key(placed, texts, key).select(
        "conv_id",
        "window",
        "idx",
        "tokens",
        "new",
        (F.col("role") == ASSISTANT).alias("target"),
        F.concat(F.lit(OPEN), role, F.lit(MIDDLE)).alias("head"),
        text.alias("body"),
    )
    written = written.withColumn("piece", F.concat("head", "body", F.lit(CLOSE)))
    in_window = Window.partitionBy("conv_id", "window").orderBy("idx")
    start = F.coalesce(F.sum(F.char_length("piece")).over(in_window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    written = written.withColumn("start", start + F.char_length("head"))
    span = F.struct(F.col("start"), (F.col("start") + F.char_length("body")).alias("stop"))
    return written.groupBy("conv_id", "window").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("idx", "piece"))), lambda x: x["piece"]), "").alias("formatted"),
        F.sum((~F.col("new")).cast("int")).cast("int").alias("repeated"),
        F.sort_array(F.collect_list(F.when(F.col("new") & F.col("target"), span))).alias("loss"),
        F.sum("tokens").alias("tokens"),
    )


def turns_of(formatted: Column, repeated: Column) -> Column:
    """Read the own turns of a window back: an array of (role, text)."""
    parts = F.split(formatted, F.lit("\\Q" + CLOSE + "\\E"), -1)
    own = F.slice(parts, repeated + 1, F.greatest(F.size(parts) - 1 - repeated, F.lit(0)))
    pair = F.transform(own, lambda p: F.split(F.substr(p, F.lit(len(OPEN) + 1)), F.lit("\\Q" + MIDDLE + "\\E"), -1))
    return F.transform(pair, lambda p: F.struct(unescape(p[0]).alias("role"), unescape(p[1]).alias("text")))


def masked(formatted: Column, loss: Column) -> Column:
    """The texts under the loss mask, unescaped."""
    return F.transform(loss, lambda s: unescape(F.substr(formatted, (s["start"] + 1).cast("int"), (s["stop"] - s["start"]).cast("int"))))
