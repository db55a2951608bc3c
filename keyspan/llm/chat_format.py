"""Chat formatting by relational expressions only.

The turns of a conversation are collected as structs and sorted; adjacent turns of one role
become one block, in which a separator parts them; blocks are concatenated.  A control string
(`<|`) inside a role or text gets a backslash between its two characters, and one more if there
are some already, which reading back removes.  So every turn can be read from the output.

Defined results: a null text or role counts as empty; a null turn number sorts first; turns
with equal numbers are sorted by role and text, and repeated rows are repeated turns; rows with
a null conversation form one conversation; an empty table gives no rows; other columns are not
read.  A conversation is one output row, so its turns meet in one task; they are collected map
side first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END, NEXT = "<|im_start|>", "<|im_end|>", "<|im_sep|>"
LEARNED = "assistant"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\\\|", "<$1|")


def role_written(role: Column) -> Column:
    """A role on one line: a backslash becomes \\s and a line end \\n."""
    return escaped(F.replace(F.replace(role, F.lit("\\"), F.lit("\\s")), F.lit("\n"), F.lit("\\n")))


def role_read(role: Column) -> Column:
    return F.replace(F.replace(unescaped(role), F.lit("\\n"), F.lit("\n")), F.lit("\\s"), F.lit("\\"))


def formatted(turns: DataFrame) -> DataFrame:
    """Per conversation of turns (conv_id, turn, role, text): conv_id, formatted, and mask.

    mask has a struct (skip, take) for each turn: `skip` characters that are not learned from,
    then `take` characters of an assistant's text, and so on from where the last one ended.
    """
    none = F.lit("")
    rows = turns.select("conv_id", F.struct("turn", F.coalesce("role", none).alias("role"), F.coalesce("text", none).alias("text")).alias("t"))
    sorted_turns = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))

    def piece(t, i):
        first = (i == 0) | (F.get("turns", i - 1)["role"] != t["role"])
        last = (i == F.size("turns") - 1) | (F.get("turns", i + 1)["role"] != t["role"])
        return F.struct(
            F.when(first, F.concat(F.lit(START), role_written(t["role"]), F.lit("\n"))).otherwise(F.lit(NEXT)).alias("head"),
            escaped(t["text"]).alias("body"),
            F.when(last, F.lit(END + "\n")).otherwise(none).alias("tail"),
            (t["role"] == LEARNED).alias("learned"),
        )

    pieces = sorted_turns.select("conv_id", F.transform("turns", piece).alias("pieces"))

    def span(p, i):
        before = F.coalesce(F.length(F.get("pieces", i - 1)["tail"]), F.lit(0))
        unlearned = F.when(p["learned"], 0).otherwise(F.length(p["body"]))
        return F.struct((before + F.length(p["head"]) + unlearned).cast("long").alias("skip"), F.when(p["learned"], F.length(p["body"])).otherwise(0).cast("long").alias("take"))

    text = F.array_join(F.transform("pieces", lambda p: F.concat(p["head"], p["body"], p["tail"])), "")
    return pieces.select("conv_id", text.alias("formatted"), F.transform("pieces", span).alias("mask"))


def read_back(outputs: DataFrame) -> DataFrame:
    """conv_id, formatted and turns (an array of role, text, learned), from the formatted text and its mask alone."""
    block = F.split("formatted", r"<\|im_end\|>\n", -1)
    blocks = F.filter(block, lambda b: b != "")

    def turns_of(b):
        role = role_read(F.substring_index(F.substr(b, F.lit(len(START) + 1)), "\n", 1))
        body = F.regexp_replace(b, r"^[^\n]*\n", "")
        return F.transform(F.split(body, r"<\|im_sep\|>", -1), lambda x: F.struct(role.alias("role"), unescaped(x).alias("text"), F.length(x).alias("size")))

    found = outputs.select("conv_id", "formatted", "mask", F.flatten(F.transform(blocks, turns_of)).alias("turns"))
    under = F.zip_with("turns", "mask", lambda t, m: F.struct(t["role"].alias("role"), t["text"].alias("text"), ((m["take"] == t["size"]) & (t["role"] == LEARNED)).alias("learned")))
    return found.select("conv_id", "formatted", under.alias("turns"))


def digest(outputs: DataFrame) -> DataFrame:
    """What reading the outputs back gives, as counts and digests."""
    joined = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    learned = F.array_join(F.transform(F.filter("turns", lambda t: t["learned"]), lambda t: t["text"]), "")
    return read_back(outputs).select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(joined, 256).alias("turns_sha256"),
        F.length(learned).cast("long").alias("loss_chars"), F.sha2(learned, 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )
