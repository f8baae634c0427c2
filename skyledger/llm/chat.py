"""Preference formatting: a shared prompt and two masked completions per pair of conversations.

A pair is a chosen and a rejected conversation.  Their longest common turn prefix, role and text alike,
is rendered once as the prompt; what follows in each is its completion.  Training is on what the
assistant says: the mask of a completion lists the spans of its assistant turns, end marker included,
the header of a turn and other roles' turns left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The markers around a turn.
START, END = "<|im_start|>", "<|im_end|>"
ASSISTANT = "assistant"


def _header(role: Column) -> Column:
    return F.concat(F.lit(START), F.coalesce(role, F.lit("")), F.lit("\n"))


def _body(text: Column) -> Column:
    return F.concat(F.coalesce(text, F.lit("")), F.lit(END), F.lit("\n"))


def _turns(rows: DataFrame, side: str) -> DataFrame:
    """Turns with their place in the conversation, in order of turn; equal turns by role and text."""
    order = Window.partitionBy("pair").orderBy(F.asc_nulls_first("turn"), F.asc_nulls_first("role"), F.asc_nulls_first("text"))
    picked = rows.select(
        F.col("pair_id").alias("pair"), "turn", F.col("role").cast("string"), F.col("text").cast("string")
    )
    return picked.filter("pair is not null").select("pair", F.lit(side).alias("side"), F.row_number().over(order).alias("place"), "role", "text")


def preference_pairs(chosen: DataFrame, rejected: DataFrame) -> DataFrame:
    """One row per `pair_id` that either table of turns (`pair_id`, `turn`, `role`, `text`) has.

    `prompt`, `n_prompt_turns`, `chosen`, `rejected`, and for either completion the number of its turns
    and `chosen_mask`, `rejected_mask`: arrays of `start`, `end` (code points of that completion, end
    exclusive) to train on.

    Two turns are alike if their places, roles and texts are, null being like null only.  A null text
    or role renders as empty.  A side without turns has an empty completion and an empty prompt; equal
    sides have two empty completions.  Rows without `pair_id` are left out; turns given twice count
    twice.  Other columns are not looked at.

    Turns are shuffled once, by pair, and all else is done in that partitioning: windows over the two
    sides of a pair spill, and what a task gathers is no more than one pair, which is a row of the result.
    """
    turns = _turns(chosen, "chosen").unionByName(_turns(rejected, "rejected"))
    # A place at which both sides have the same turn has two rows and one distinct turn.
    place, pair = Window.partitionBy("pair", "place"), Window.partitionBy("pair")
    turn = F.struct("role", "text")
    differs = (F.count(F.lit(1)).over(place) < 2) | ~F.min(turn).over(place).eqNullSafe(F.max(turn).over(place))
    compared = turns.withColumn("differs", differs)
    first = F.coalesce(F.min(F.when(F.col("differs"), F.col("place"))).over(pair), F.max("place").over(pair) + 1)
    header, body = _header(F.col("role")), _body(F.col("text"))
    rendered = compared.withColumn("split", first).select(
        "pair",
        "side",
        "place",
        (F.col("place") < F.col("split")).alias("shared"),
        F.concat(header, body).alias("rendered"),
        F.length(header).alias("head"),
        # The newline behind the end marker is not trained on.
        (F.length(body) - 1).alias("said"),
        (F.col("role") == ASSISTANT).alias("assistant"),
    )
    # The start of each turn in its completion.
    before = Window.partitionBy("pair", "side", "shared").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    rendered = rendered.withColumn("start", F.coalesce(F.sum(F.length("rendered")).over(before), F.lit(0)))

    def text(wanted: Column) -> Column:
        parts = F.array_sort(F.collect_list(F.when(wanted, F.struct("place", "rendered"))))
        return F.array_join(F.transform(parts, lambda p: p["rendered"]), "")

    def mask(wanted: Column) -> Column:
        start = F.col("start") + F.col("head")
        span = F.struct(start.alias("start"), (start + F.col("said")).alias("end"))
        return F.array_sort(F.collect_list(F.when(wanted & F.coalesce("assistant", F.lit(False)), span)))

    # The prompt is rendered from the chosen side only.
    is_chosen, shared = F.col("side") == "chosen", F.col("shared")
    own_chosen, own_rejected = is_chosen & ~shared, ~is_chosen & ~shared
    return rendered.groupBy(F.col("pair").alias("pair_id")).agg(
        text(is_chosen & shared).alias("prompt"),
        F.count_if(is_chosen & shared).alias("n_prompt_turns"),
        text(own_chosen).alias("chosen"),
        F.count_if(own_chosen).alias("n_chosen_turns"),
        mask(own_chosen).alias("chosen_mask"),
        text(own_rejected).alias("rejected"),
        F.count_if(own_rejected).alias("n_rejected_turns"),
        mask(own_rejected).alias("rejected_mask"),
    )


def spans(mask: Column) -> Column:
    """A mask as text: start:end, comma-joined."""
    return F.array_join(F.transform(mask, lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",")


def degraded(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chosen and rejected turns made of plain conversations (`conv_id`, `turn`, `role`, `text`).

    Chosen is the conversation.  Rejected ends with one of its assistant replies, reversed: of n
    replies the one numbered `conv_id` mod n, so that pairs part early and late.  A conversation
    without a reply is rejected as it is.  The numbers of replies are counted in order of turns.

    One order of the turns numbers replies and finds the last one, and both sides start from the same
    shuffle.  Turns without `conv_id`, of which no pair can be made, are left out before it.
    """
    said = conversations.filter("conv_id IS NOT NULL")
    rows = said.select(F.col("conv_id").alias("pair_id"), "turn", F.col("role").cast("string"), F.col("text").cast("string"))
    rows = rows.repartition("pair_id")
    whole = Window.partitionBy("pair_id")
    so_far = whole.orderBy(F.asc_nulls_first("turn"), F.asc_nulls_first("text")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    reply = F.coalesce(F.col("role") == ASSISTANT, F.lit(False))
    numbered = rows.select("*", F.count_if(reply).over(so_far).alias("number"), F.count_if(reply).over(whole).alias("n"))
    chosen_reply = reply & (F.pmod("pair_id", "n") == F.col("number") - 1)
    ended = numbered.withColumn("last", F.max(F.when(chosen_reply, F.col("turn"))).over(whole))
    known = F.coalesce(F.col("turn") <= F.col("last"), (F.col("n") == 0) | F.col("turn").isNull())
    final = reply & F.col("turn").eqNullSafe(F.col("last"))
    text = F.when(final, F.reverse("text")).otherwise(F.col("text"))
    return rows, ended.filter(known).select("pair_id", "turn", "role", text.alias("text"))
