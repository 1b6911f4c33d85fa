"""Chat formatting with relational operations: turns are collected, sorted, runs of one role merged, and concatenated.

The format of a conversation, one block per run of turns of one role:

    <|im_start|>role NEWLINE text (<|im_sep|>text)* <|im_end|> NEWLINE

Turns of one role that follow each other share a block; <|im_sep|> keeps them apart, so the turns can be read back as they were.
Inside roles and texts "<" becomes "<<>" wherever it stands before "|" or "<>", so no control string can occur there (a line end in
a role becomes <|nl|>); and the loss mask, a list of code point ranges, covers the assistant's texts alone. `parse` reads turns and loss text from the output only.

Defined results: a null text or role counts as empty; turns are ordered by turn number (null first), then role, then text; repeated
rows are repeated turns; a null conv_id is a conversation of its own; an empty table gives no rows; further columns are not read.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import pick

#: Fixed values of the format.
START, END, SEPARATOR, LINE_END = "<|im_start|>", "<|im_end|>", "<|im_sep|>", "<|nl|>"
LEARNED = "assistant"


def escaped(text: Column) -> Column:
    """A '<' before '|' or before an escaped '<' gets '<>' behind it: '<|' never stays, and `unescaped` undoes exactly this."""
    return F.regexp_replace(text, r"<(?=\||<>)", "<<>")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<<>", "<")


def _text(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def format_conversations(turns: DataFrame) -> DataFrame:
    """conv_id, formatted string, loss_spans array<struct<start, length>> (code points from 0)."""
    rows = pick(turns, "conv_id", "turn", "role", "text")
    one = F.struct(F.col("turn"), _text("role").alias("role"), _text("text").alias("text"))
    sorted_turns = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(one)).alias("turns"))

    # A block per run of one role; a turn opens a block if its role is not that of the turn before.
    opens = F.transform("turns", lambda t, i: F.when(i == 0, True).otherwise(t["role"] != F.get("turns", i - 1)["role"]))
    closes = F.transform("turns", lambda t, i: F.coalesce(F.get("turns", i + 1)["role"] != t["role"], F.lit(True)))
    flagged = sorted_turns.withColumn("opens", opens).withColumn("closes", closes)
    parts = F.transform("turns", lambda t, i: F.struct(
        F.when(F.get("opens", i), F.concat(F.lit(START), F.replace(escaped(t["role"]), F.lit("\n"), F.lit(LINE_END)), F.lit("\n"))).otherwise(F.lit(SEPARATOR)).alias("before"),
        escaped(t["text"]).alias("body"),
        F.when(F.get("closes", i), F.lit(END + "\n")).otherwise(F.lit("")).alias("behind"),
        (t["role"] == LEARNED).alias("learned")))
    written = flagged.select("conv_id", parts.alias("parts"))
    width = lambda p: F.length(p["before"]) + F.length(p["body"]) + F.length(p["behind"])
    # Start of each part: running sum of the widths, kept with the spans in one fold.
    spans = F.aggregate(
        "parts", F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("spans")),
        lambda acc, p: F.struct(
            (acc["at"] + width(p)).alias("at"),
            F.when(p["learned"], F.concat(acc["spans"], F.array(F.struct((acc["at"] + F.length(p["before"])).alias("start"), F.length(p["body"]).cast("long").alias("length"))))).otherwise(acc["spans"]).alias("spans")),
        lambda acc: acc["spans"])
    return written.select("conv_id", F.array_join(F.transform("parts", lambda p: F.concat(p["before"], p["body"], p["behind"])), "").alias("formatted"), spans.alias("loss_spans"))


def parse(formatted: DataFrame) -> DataFrame:
    """conv_id, formatted, turns array<struct<role, text>>, loss array<string> (unescaped), from the formatted string and its spans alone."""
    # A block ends at END + newline; an empty string stands behind the last one.
    blocks = F.filter(F.split("formatted", r"<\|im_end\|>\n"), lambda b: b != "")
    opened = formatted.withColumn("_blocks", F.transform(blocks, lambda b: F.struct(
        unescaped(F.replace(F.substring(F.substring_index(b, "\n", 1), len(START) + 1, 1 << 30), F.lit(LINE_END), F.lit("\n"))).alias("role"),
        F.split(F.substring(b, F.length(F.substring_index(b, "\n", 1)) + 2, F.lit(1 << 30)), r"<\|im_sep\|>").alias("texts"))))
    turns = F.flatten(F.transform("_blocks", lambda b: F.transform(b["texts"], lambda t: F.struct(b["role"].alias("role"), unescaped(t).alias("text")))))
    loss = F.transform("loss_spans", lambda s: unescaped(F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int"))))
    return opened.select("conv_id", "formatted", turns.alias("turns"), loss.alias("loss"))


def digests(parsed: DataFrame) -> DataFrame:
    spoken = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    learned = F.array_join("loss", "")
    return parsed.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(spoken, 256).alias("turns_sha256"),
        F.length(learned).cast("long").alias("loss_chars"), F.sha2(learned, 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))
