"""Chat formatting for preference training.

The longest common prefix of the chosen and the rejected turns is rendered once,
as the prompt. What follows it is rendered for each side, with the spans that count
for the loss: texts and end marks of assistant turns. Built-in functions only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    begin: str = "<|"
    after_role: str = "|>\n"
    end: str = "<|end|>\n"
    learned: tuple[str, ...] = ("assistant",)
    no_role: str = "unknown"


def turns_of(conversations: DataFrame) -> DataFrame:
    """conv_id and its turns, array<struct<role, text>>, in turn order.

    Null text is empty, null role the template's ``no_role`` when rendered; rows that
    repeat a turn exactly count once, differing rows of one turn are ordered by role
    and text; null turns come first; null conv_id is a conversation of its own.
    """
    row = F.struct("turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    return conversations.groupBy("conv_id").agg(F.sort_array(F.collect_set(row)).alias("_rows")).select(
        "conv_id", F.transform("_rows", lambda r: F.struct(r["role"].alias("role"), r["text"].alias("text"))).alias("turns")
    )


def stale_answer_pairs(conversations: DataFrame) -> DataFrame:
    """One pair for each conversation: pair_id, chosen and rejected turns.

    Chosen is the conversation up to its last assistant turn. Rejected gives the
    conversation's first assistant answer again at that place; if there is only one
    answer, rejected stops before it. Without an assistant turn both sides are the
    whole conversation.
    """
    own = turns_of(conversations)
    is_answer = F.transform("turns", lambda t: F.coalesce(t["role"] == "assistant", F.lit(False)))
    own = own.withColumn("_first", F.array_position(is_answer, True)).withColumn(
        "_last", F.size("turns") + 1 - F.array_position(F.reverse(is_answer), True)
    )
    has, before = F.col("_first") > 0, F.slice("turns", 1, (F.greatest(F.col("_last"), F.lit(1)) - 1).cast("int"))
    chosen = F.when(has, F.slice("turns", 1, F.col("_last").cast("int"))).otherwise(F.col("turns"))
    stale = F.array(F.element_at("turns", F.greatest(F.col("_first"), F.lit(1)).cast("int")))
    rejected = F.when(~has, F.col("turns")).when(F.col("_first") == F.col("_last"), before).otherwise(F.concat(before, stale))
    return own.select(F.col("conv_id").alias("pair_id"), chosen.alias("chosen"), rejected.alias("rejected"))


def common_turns(a: Column, b: Column) -> Column:
    """Length of the longest common prefix of two arrays."""
    short = F.least(F.size(a), F.size(b))
    same = F.transform(F.sequence(F.lit(1), F.greatest(short, F.lit(1))), lambda i: F.try_element_at(a, i).eqNullSafe(F.try_element_at(b, i)))
    differs = F.array_position(same, False)
    return F.when(short == 0, 0).when(differs == 0, short).otherwise(differs - 1).cast("int")


def _head(turn: Column, t: Template) -> Column:
    return F.concat(F.lit(t.begin), F.coalesce(turn["role"], F.lit(t.no_role)), F.lit(t.after_role))


def render(turns: Column, t: Template) -> Column:
    return F.array_join(F.transform(turns, lambda x: F.concat(_head(x, t), x["text"], F.lit(t.end))), "")


def loss_spans(turns: Column, t: Template) -> Column:
    """[start, end) code point offsets into ``render(turns)`` of what learned roles say."""
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def step(acc: Column, turn: Column) -> Column:
        start = acc["at"] + F.length(_head(turn, t))
        end = start + F.length(turn["text"]) + len(t.end)
        span = F.array(F.struct(start.alias("start"), end.alias("end")))
        learned = F.coalesce(turn["role"].isin(*t.learned), F.lit(False))
        return F.struct(end.alias("at"), F.when(learned, F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    return F.aggregate(turns, zero, step)["spans"]


def format_preferences(pairs: DataFrame, template: Template = Template()) -> DataFrame:
    """Render ``pairs`` (pair_id, chosen, rejected; arrays of struct<role, text>).

    Returns pair_id, prompt_turns, prompt, chosen, rejected and the loss spans
    chosen_spans and rejected_spans inside the two completions. Defined results: a
    null side has no turns; sides that agree throughout have empty completions and no
    spans; null text is empty; repeated pairs each get a row; no pairs, no rows.
    """
    clean = "array<struct<role:string,text:string>>"
    side = lambda c: F.transform(F.coalesce(F.col(c).cast(clean), F.array().cast(clean)), lambda x: F.struct(x["role"].alias("role"), F.coalesce(x["text"], F.lit("")).alias("text")))
    own = pairs.select("pair_id", side("chosen").alias("_a"), side("rejected").alias("_b"))
    own = own.withColumn("prompt_turns", common_turns(F.col("_a"), F.col("_b")))
    rest = lambda c: F.slice(c, F.col("prompt_turns") + 1, F.greatest(F.size(c), F.lit(1)))
    own = own.withColumn("_rest_a", rest("_a")).withColumn("_rest_b", rest("_b"))
    return own.select(
        "pair_id",
        "prompt_turns",
        render(F.slice("_a", 1, F.col("prompt_turns")), template).alias("prompt"),
        render(F.col("_rest_a"), template).alias("chosen"),
        render(F.col("_rest_b"), template).alias("rejected"),
        loss_spans(F.col("_rest_a"), template).alias("chosen_spans"),
        loss_spans(F.col("_rest_b"), template).alias("rejected_spans"),
    )
