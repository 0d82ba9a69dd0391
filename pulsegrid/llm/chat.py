"""Preference formatting of chosen and rejected conversations.

Both conversations of a pair are compared turn by turn; their longest common
prefix is rendered once as the prompt, and what follows in each as completions,
with masks that let only assistant turns count for the loss.  Everything is a
DataFrame expression over one row a pair.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values of the chat template.
OPEN, BREAK, CLOSE = "<|im_start|>", "\n", "<|im_end|>\n"


def turns(conversations: DataFrame) -> DataFrame:
    """``conv_id, turns`` with turns ``(role, text)`` in order of turn, role, text.

    A null role counts as user, a null text as empty, a null turn comes first;
    rows without a conv_id belong to no conversation and are left out.
    """
    one = F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("user")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = conversations.filter(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), one.alias("t"))
    held = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    return held.select("conv_id", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))


def alternatives(conversations: DataFrame, group: int = 256) -> DataFrame:
    """A pair for each conversation: ``pair_id, partner_id, chosen, rejected``.

    Chosen is the conversation itself.  Rejected is the same up to its last
    assistant turn, which is replaced by the last assistant turn of another
    conversation, so an answer to something else.  The other one is the next by
    id in a hashed group of about ``group`` (the last takes the first), which
    keeps every window small whatever the ids are.  A conversation without
    assistant turns has no pair; one that is alone in its group answers itself.
    """
    held = turns(conversations)
    last = F.array_max(F.filter(F.transform("turns", lambda t, i: F.when(t["role"] == "assistant", i)), lambda i: i.isNotNull()))
    held = held.withColumn("last", last).filter("last is not null")
    held = held.withColumn("answer", F.get("turns", F.col("last")))
    n = conversations.select("conv_id").filter("conv_id is not null").distinct().count()
    key = F.conv(F.substr(F.md5(F.col("conv_id").cast("string")), F.lit(1), F.lit(8)), 16, 10).cast("long")
    held = held.withColumn("part", key % max(1, n // group))
    order = Window.partitionBy("part").orderBy("conv_id")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    other = F.struct("conv_id", "answer")
    held = held.withColumn("other", F.coalesce(F.lead(other).over(order), F.first(other).over(whole)))
    return held.select(
        F.col("conv_id").alias("pair_id"),
        F.col("other.conv_id").alias("partner_id"),
        F.slice("turns", F.lit(1), F.col("last") + 1).alias("chosen"),
        F.concat(F.slice("turns", F.lit(1), F.col("last")), F.array("other.answer")).alias("rejected"),
    )


def rendered(t: Column) -> Column:
    return F.concat(F.lit(OPEN), t["role"], F.lit(BREAK), t["text"], F.lit(CLOSE))


def mask(rest: str) -> Column:
    """``[start, end)`` in characters of assistant texts with their closing mark."""
    empty = F.array().cast("array<struct<start:bigint,end:bigint>>")

    def step(s: Column, t: Column) -> Column:
        begin = s["at"] + F.length(F.lit(OPEN)) + F.length(t["role"]) + F.length(F.lit(BREAK))
        end = s["at"] + F.length(rendered(t))
        span = F.struct(begin.cast("long").alias("start"), end.cast("long").alias("end"))
        return F.struct(end.cast("long").alias("at"), F.when(t["role"] == "assistant", F.concat(s["out"], F.array(span))).otherwise(s["out"]).alias("out"))

    return F.aggregate(rest, F.struct(F.lit(0).cast("long").alias("at"), empty.alias("out")), step)["out"]


def format_preferences(pairs: DataFrame) -> DataFrame:
    """Prompt and masked completions for ``pairs(pair_id, chosen, rejected)``.

    Turns are ``(role, text)``; null conversations count as empty.  Where both
    are the same, everything is prompt and both completions are empty.  Other
    columns are kept.
    """
    both = pairs.withColumn("chosen", F.coalesce("chosen", F.array().cast("array<struct<role:string,text:string>>"))).withColumn("rejected", F.coalesce("rejected", F.array().cast("array<struct<role:string,text:string>>")))
    differs = F.zip_with("chosen", "rejected", lambda a, b: ~a.eqNullSafe(b))
    n = F.array_position(differs, True)
    both = both.withColumn("n_prefix", F.when(n == 0, F.size(differs)).otherwise(n - 1).cast("int"))
    d = both.select(
        *[c for c in pairs.columns if c not in ("chosen", "rejected")],
        "n_prefix",
        F.slice("chosen", F.lit(1), F.col("n_prefix")).alias("same"),
        *[F.slice(c, F.col("n_prefix") + 1, F.size(c)).alias(c) for c in ("chosen", "rejected")],
    )
    text = {c: F.array_join(F.transform(c, rendered), "") for c in ("same", "chosen", "rejected")}
    return d.select(
        *[c for c in pairs.columns if c not in ("chosen", "rejected")],
        F.col("n_prefix").cast("long").alias("n_prefix_turns"),
        text["same"].alias("prompt"),
        text["chosen"].alias("chosen"),
        text["rejected"].alias("rejected"),
        mask("chosen").alias("chosen_mask"),
        mask("rejected").alias("rejected_mask"),
    )
