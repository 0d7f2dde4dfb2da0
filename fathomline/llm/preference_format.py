"""Preference formatting: one prompt for two conversations, and the two completions with their loss masks.

The longest common prefix of the turns of a chosen and a rejected conversation is rendered once as the prompt; what is
left of each is its completion. A completion's mask has the character ranges that a model is trained on: the text of
assistant turns with the mark that ends the turn, not the headers and not what others say.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathomline.llm.merkle import following

#: The rendering of a turn.
START, BREAK, END, CLOSE = "<|im_start|>", "\n", "<|im_end|>", "\n"
TRAINED = "assistant"


def rendered(turn: Column) -> Column:
    return F.concat(F.lit(START), turn["role"], F.lit(BREAK), turn["text"], F.lit(END + CLOSE))


def turns(conversations: DataFrame, *, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(id, turns): each conversation's turns in order as (role, text). Null roles and texts are empty; rows of one
    turn number stay, ordered by role and text; null turn numbers come first."""
    rows = conversations.select(F.col(id_col).alias("id"), F.struct(F.col(turn_col).alias("turn"), F.coalesce(role_col, F.lit("")).alias("role"), F.coalesce(text_col, F.lit("")).alias("text")).alias("t"))
    return rows.groupBy("id").agg(F.sort_array(F.collect_list("t")).alias("turns")).select(F.col("id").alias(id_col), F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))


def common_turns(a: Column, b: Column) -> Column:
    """How many turns from the first on are equal in both."""
    differ = F.array_position(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), False)
    return F.when(differ > 0, differ - 1).otherwise(F.size(a)).cast("int")


def _mask(part: Column) -> Column:
    """Ranges of the trained characters of a completion, by a fold that carries the length so far."""
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start: bigint, end: bigint>>").alias("spans"))

    def step(acc: Column, t: Column) -> Column:
        head = acc["at"] + F.char_length(t["role"]) + len(START + BREAK)
        end = head + F.char_length(t["text"]) + len(END)
        span = F.array(F.struct(head.cast("long").alias("start"), end.cast("long").alias("end")))
        return F.struct((end + len(CLOSE)).cast("long").alias("at"), F.when(t["role"] == TRAINED, F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    return F.aggregate(part, start, step, lambda acc: acc["spans"])


def formatted(pairs: DataFrame, *, chosen: str = "chosen", rejected: str = "rejected") -> DataFrame:
    """The other columns of ``pairs`` with prompt_turns, prompt, both completions and both masks; columns of those names
    are replaced.

    Both columns hold turns as (role, text); null counts as no turns. Equal conversations give empty completions."""
    made = ("prompt_turns", "prompt", "chosen", "rejected", "chosen_mask", "rejected_mask")
    keep = [c for c in pairs.columns if c not in (chosen, rejected, *made)]
    none = F.array().cast("array<struct<role: string, text: string>>")
    a, b = F.coalesce(F.col(chosen), none), F.coalesce(F.col(rejected), none)
    both = pairs.select(*[F.col(f"`{c}`") for c in keep], a.alias("__a"), b.alias("__b")).withColumn("__n", common_turns(F.col("__a"), F.col("__b")))

    def text(part: Column) -> Column:
        return F.array_join(F.transform(part, rendered), "")

    def rest(name: str) -> Column:
        return F.slice(name, F.col("__n") + 1, F.greatest(F.size(name) - F.col("__n"), F.lit(0)))

    both = both.withColumn("__ra", rest("__a")).withColumn("__rb", rest("__b"))
    return both.select(*[F.col(f"`{c}`") for c in keep], F.col("__n").alias("prompt_turns"), text(F.slice("__a", 1, F.col("__n"))).alias("prompt"), text(F.col("__ra")).alias("chosen"), text(F.col("__rb")).alias("rejected"), _mask(F.col("__ra")).alias("chosen_mask"), _mask(F.col("__rb")).alias("rejected_mask"))


def with_borrowed_answers(conversations: DataFrame, *, id_col: str = "conv_id") -> DataFrame:
    """(id, chosen, rejected) of conversations in ``turns`` form: the rejected one ends its last assistant turn with
    the last assistant text of the next conversation in order of id (the first after the last; empty if it has none).

    A conversation without an assistant turn is its own rejected form. Null ids are left out.
    """
    rows = conversations.where(F.col(id_col).isNotNull())
    said = F.filter("turns", lambda t: t["role"] == TRAINED)
    last = rows.select(F.col(id_col).alias("next_id"), F.coalesce(F.try_element_at(said, F.lit(-1))["text"], F.lit("")).alias("borrowed"))
    order = following(rows.select(id_col), id_col)
    joined = rows.join(order, id_col).join(last, "next_id")
    at = F.array_max(F.transform("turns", lambda t, k: F.when(t["role"] == TRAINED, k)))
    swapped = F.transform("turns", lambda t, k: F.when(k == F.col("at"), F.struct(t["role"].alias("role"), F.col("borrowed").alias("text"))).otherwise(t))
    return joined.withColumn("at", at).select(F.col(id_col), F.col("turns").alias("chosen"), swapped.alias("rejected"))
