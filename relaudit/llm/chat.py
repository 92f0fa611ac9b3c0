"""Chat formatting by prefix-target expansion, in DataFrame functions alone.

Every assistant turn is an example of its own: all turns before it as context, and its text alone trainable. The
template marks turns; control characters inside texts are escaped, so that no text can forge a mark and the formatted
string gives back exactly what went in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the template. Escaped texts hold none of "#", "<" and ":", so marks are found by plain search.
OPEN, NAME_END, CLOSE = "### ", ": ", "</turn>\n"
#: The backslash first: every backslash of an escaped text then begins a pair, and undoing the backslash last is exact.
ESCAPES = (("\\", "\\b"), ("#", "\\h"), ("<", "\\l"), (":", "\\c"))


def escaped(text: Column) -> Column:
    for plain, code in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescaped(text: Column) -> Column:
    for plain, code in reversed(ESCAPES):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def examples(turns: DataFrame) -> DataFrame:
    """``turns(conv_id, turn, role, text)`` to ``(conv_id, target, formatted, loss_start, loss_end)``.

    One row for each assistant turn, ``target`` its place in the conversation. Where turns follow the last assistant
    turn, or there is none, one more row with a null target holds the whole conversation and trains nothing. Turns are
    in order of ``turn``, nulls first, ties by role and text; a null role or text is empty; repeated rows stay. Other
    columns are ignored; an empty table gives an empty table. Loss places count code points of ``formatted``.
    """
    row = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    whole = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(row)).alias("t"))
    marked = F.transform("t", lambda x: F.concat(F.lit(OPEN), escaped(x["role"]), F.lit(NAME_END), escaped(x["text"]), F.lit(CLOSE)))
    n = F.size("t")
    places = F.filter(F.sequence(F.lit(1), n), lambda i: F.element_at("t", i)["role"] == "assistant")
    rest = F.when(F.element_at("t", n)["role"] == "assistant", F.array().cast("array<int>")).otherwise(F.array(F.lit(0)))
    each = whole.select("conv_id", "t", marked.alias("m"), F.explode(F.concat(places, rest)).alias("at"))
    each = each.withColumns({"upto": F.when(F.col("at") > 0, F.col("at")).otherwise(F.size("m")), "target": F.when(F.col("at") > 0, F.col("at") - 1)})
    each = each.withColumn("formatted", F.array_join(F.slice("m", F.lit(1), F.col("upto")), ""))
    end = F.when(F.col("at") > 0, F.length("formatted") - len(CLOSE)).cast("long")
    start = end - F.length(escaped(F.element_at("t", F.col("upto"))["text"]))
    return each.select("conv_id", "target", "formatted", start.alias("loss_start"), end.alias("loss_end"))


def read_back(formatted: Column) -> Column:
    """The turns of a formatted string as ``array<struct<role, text>>``."""
    pieces = F.split(formatted, CLOSE, -1)
    name = lambda p: F.substr(p, F.lit(len(OPEN) + 1), F.instr(p, NAME_END) - len(OPEN) - 1)
    text = lambda p: F.substr(p, F.instr(p, NAME_END) + len(NAME_END))
    return F.transform(F.slice(pieces, F.lit(1), F.size(pieces) - 1), lambda p: F.struct(unescaped(name(p)).alias("role"), unescaped(text(p)).alias("text")))


def digest(formatted: DataFrame) -> DataFrame:
    """For each conversation what its examples give back: turns, all text under the loss mask in order, and sizes.

    ``formatted_chars`` is the sum over the conversation's examples.
    """
    loss = F.when(F.col("target").isNull(), F.lit("")).otherwise(unescaped(F.substr("formatted", F.col("loss_start").cast("int") + 1, (F.col("loss_end") - F.col("loss_start")).cast("int"))))
    each = formatted.select("conv_id", F.length("formatted").cast("long").alias("n"), "formatted", F.coalesce("target", F.lit(2**31 - 1)).alias("target"), loss.alias("loss"))
    whole = each.groupBy("conv_id").agg(F.max_by("formatted", "n").alias("formatted"), F.sum("n").alias("formatted_chars"), F.array_sort(F.collect_list(F.struct("target", "loss"))).alias("losses"))
    text = F.array_join(F.transform("losses", lambda x: x["loss"]), "")
    turns = whole.select("conv_id", read_back(F.col("formatted")).alias("t"), text.alias("loss"), "formatted_chars")
    said = F.array_join(F.transform("t", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return turns.select("conv_id", F.size("t").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")
