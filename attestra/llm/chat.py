"""Chat formatting by DataFrame expressions alone.

Collected turn structs are sorted, adjacent turns of one role share a header, and the text is joined
from an array. A text's own control strings are escaped: between < and | goes one backslash more than
the text has there, so no text holds a control string and each can be read back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END, NEXT = "<|im_start|>", "<|im_end|>\n", "<|im_next|>"
TRAINED_ROLE = "assistant"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\\\|", "<$1|")


def format_chats(turns: DataFrame, trained_role: str = TRAINED_ROLE) -> DataFrame:
    """(conv_id, formatted, loss_spans): one row for each conversation.

    ``turns``: conv_id, turn, role, text. Turns go by turn, then role, then text, null turns first;
    null roles and texts count as empty; a row without conv_id is a conversation of its own. Repeated
    rows are turns of their own. loss_spans are the [begin, end) code points of the trained role's texts.
    """
    turn = F.struct("turn", F.url_encode(F.coalesce("role", F.lit(""))).alias("role"), escape(F.coalesce("text", F.lit(""))).alias("text"))
    alone = F.when(F.col("conv_id").isNull(), F.monotonically_increasing_id())
    chats = turns.select("conv_id", alone.alias("alone"), turn.alias("turn")).groupBy("conv_id", "alone").agg(F.sort_array(F.collect_list("turn")).alias("turns"))

    def lead(t: Column, i: Column) -> Column:
        before = F.get(F.col("turns"), i - 1)["role"]
        header = F.concat(F.lit(START), t["role"], F.lit("\n"))
        return F.when(i == 0, header).when(before == t["role"], F.lit(NEXT)).otherwise(F.concat(F.lit(END), header))

    parts = F.transform("turns", lambda t, i: F.struct(lead(t, i).alias("lead"), t["text"].alias("text"), (t["role"] == F.url_encode(F.lit(trained_role))).alias("loss")))
    chats = chats.select("conv_id", parts.alias("parts"))
    formatted = F.concat(F.array_join(F.transform("parts", lambda p: F.concat(p["lead"], p["text"])), ""), F.lit(END))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<begin:int,end:int>>").alias("spans"))

    def step(s: Column, p: Column) -> Column:
        begin = s["at"] + F.length(p["lead"])
        end = begin + F.length(p["text"])
        more = F.array(F.struct(begin.alias("begin"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(p["loss"], F.concat(s["spans"], more)).otherwise(s["spans"]).alias("spans"))

    return chats.select("conv_id", formatted.alias("formatted"), F.aggregate("parts", start, step, lambda s: s["spans"]).alias("loss_spans"))


def read_chats(formatted: DataFrame) -> DataFrame:
    """(conv_id, turns, loss_text, formatted): what ``format_chats`` wrote, read back from its text and spans.

    turns are structs of role and text; loss_text joins what the spans cover, unescaped.
    """
    blocks = F.filter(F.split("formatted", r"<\|im_end\|>\n"), lambda b: b != "")

    def turns(b: Column) -> Column:
        role = F.url_decode(F.regexp_extract(b, r"^<\|im_start\|>([^\n]*)\n", 1))
        body = F.regexp_replace(b, r"^<\|im_start\|>[^\n]*\n", "")
        return F.transform(F.split(body, r"<\|im_next\|>"), lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))

    covered = F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), s["begin"] + 1, s["end"] - s["begin"])))
    return formatted.select("conv_id", F.flatten(F.transform(blocks, turns)).alias("turns"), F.array_join(covered, "").alias("loss_text"), "formatted")
