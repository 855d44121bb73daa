"""Chat formatting: preference pairs with a shared prompt and paired, masked completions; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read

TURN_START, TURN_END = "<|im_start|>", "<|im_end|>\n"


def conversations_as_turns(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation: its id and ``turns``, an array of (role, text) in order of turn.

    Rows without a conversation id belong to no conversation and are left out. A null role counts as
    ``user``, a null text as empty, null turn numbers come first; equal turn numbers are ordered by
    role, then text. Exact repeats of a row stay, as turns of their own.
    """
    ordered = F.array_sort(F.collect_list(F.struct(F.coalesce(F.col(turn).cast("long"), F.lit(-(2**63))).alias("turn"), F.coalesce(role, F.lit("user")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))))
    return conversations.where(F.col(conv_id).isNotNull()).groupBy(F.col(conv_id).alias("conv_id")).agg(F.transform(ordered, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))


def render(turns: Column) -> Column:
    """The turns as one string: each is ``<|im_start|>role``, a new line, its text and ``<|im_end|>``."""
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(TURN_START), t["role"], F.lit("\n"), t["text"], F.lit(TURN_END))), "")


def masked(turns: Column) -> Column:
    """The rendered turns cut into (text, train) spans: an assistant's text and its end are trained on, all else is masked."""
    def spans(t: Column) -> Column:
        learns = t["role"] == "assistant"
        head = F.struct(F.concat(F.lit(TURN_START), t["role"], F.lit("\n")).alias("text"), F.lit(False).alias("train"))
        body = F.struct(F.concat(t["text"], F.lit(TURN_END)).alias("text"), learns.alias("train"))
        return F.array(head, body)

    return F.flatten(F.transform(turns, spans))


def common_prefix(chosen: Column, rejected: Column) -> Column:
    """How many leading turns of the two arrays are equal in role and text."""
    shorter = F.least(F.size(chosen), F.size(rejected))
    differs = F.zip_with(F.slice(chosen, 1, shorter), F.slice(rejected, 1, shorter), lambda a, b: F.when(a == b, 0).otherwise(1))
    first = F.array_position(differs, 1)
    return F.when(first > 0, first - 1).otherwise(shorter).cast("long")


def format_preferences(pairs: DataFrame, chosen: str = "chosen", rejected: str = "rejected") -> DataFrame:
    """Adds ``n_prompt_turns``, ``prompt``, ``chosen_spans`` and ``rejected_spans`` to every pair.

    ``chosen`` and ``rejected`` are arrays of (role, text). Their longest common turn prefix is
    rendered once, as ``prompt``; what follows it in either is rendered as spans of (text, train).
    A null array counts as empty. When one conversation is a prefix of the other, its completion is
    an empty array; equal conversations have two empty completions. Pairs without a common turn have
    an empty prompt. Columns of the four names in ``pairs`` are replaced.
    """
    empty = F.array().cast("array<struct<role:string,text:string>>")
    a, b = F.coalesce(F.col(chosen), empty), F.coalesce(F.col(rejected), empty)
    n = common_prefix(a, b)
    rest = lambda turns, k: F.slice(turns, F.col(k).cast("int") + 1, F.size(turns))
    return pairs.withColumn("n_prompt_turns", n).withColumns({
        "prompt": render(F.slice(a, 1, F.col("n_prompt_turns").cast("int"))),
        "chosen_spans": masked(rest(a, "n_prompt_turns")),
        "rejected_spans": masked(rest(b, "n_prompt_turns")),
    })


def trained_ranges(spans: Column) -> Column:
    """The (start, end) offsets, in characters of the joined spans, of those that are trained on; the end is exclusive."""
    kind = "struct<at:bigint,ranges:array<struct<start:bigint,end:bigint>>>"

    def add(held: Column, span: Column) -> Column:
        end = held["at"] + F.length(span["text"])
        own = F.array(F.struct(held["at"].alias("start"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(span["train"], F.concat(held["ranges"], own)).otherwise(held["ranges"]).alias("ranges"))

    return F.aggregate(spans, F.struct(F.lit(0), F.array()).cast(kind), add)["ranges"]


def reply_pairs(turns: DataFrame) -> DataFrame:
    """(conv_id, partner_id, chosen, rejected): every conversation against itself with its last answer exchanged.

    The partner of 2k is 2k + 1 and the other way round. ``rejected`` has the turns before the last
    assistant turn and then the partner's last assistant turn; where there is no partner, or it has
    no such turn, only the turns before. A conversation without an assistant turn is rejected as it is.
    """
    turns = turns.withColumn("partner_id", F.col("conv_id").bitwiseXOR(F.lit(1)))
    answers = F.filter("turns", lambda t: t["role"] == "assistant")
    reply = turns.select(F.col("partner_id").alias("conv_id"), F.try_element_at(answers, F.lit(-1)).alias("reply"))
    back = F.array_position(F.reverse(F.transform("turns", lambda t: t["role"])), "assistant")
    joined = turns.withColumn("last", F.when(back > 0, F.size("turns") - back)).join(reply, "conv_id", "left")
    before = F.slice("turns", F.lit(1), F.col("last").cast("int"))
    swapped = F.when(F.col("reply").isNull(), before).otherwise(F.concat(before, F.array("reply")))
    return joined.select("conv_id", F.when(F.col("reply").isNotNull() & F.col("last").isNotNull(), F.col("partner_id")).alias("partner_id"), F.col("turns").alias("chosen"), F.when(F.col("last").isNull(), F.col("turns")).otherwise(swapped).alias("rejected"))


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation against the one with its last answer exchanged; masks are ``start:end`` character offsets, joined by ``;``."""
    out = format_preferences(reply_pairs(conversations_as_turns(read(spark, sf_dir, "conversations"))))
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: s["text"]), "")
    mask = lambda spans: F.array_join(F.transform(trained_ranges(spans), lambda r: F.concat_ws(":", r["start"], r["end"])), ";")
    texts = [f(F.col(f"{side}_spans")).alias(f"{side}_{name}") for side in ("chosen", "rejected") for name, f in (("text", joined), ("mask", mask))]
    return out.select("conv_id", "partner_id", "n_prompt_turns", "prompt", *texts)


OP2_SQL = """
WITH turns AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, 'user'), coalesce(text, '')) AS pos,
         coalesce(role, 'user') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL
), answers AS (SELECT conv_id, max(pos) AS last_pos, arg_max(text, pos) AS reply FROM turns WHERE role = 'assistant' GROUP BY conv_id),
rejected AS (
  SELECT turns.* FROM turns LEFT JOIN answers USING (conv_id) WHERE last_pos IS NULL OR pos < last_pos
  UNION ALL SELECT own.conv_id, own.last_pos, 'assistant', other.reply FROM answers own JOIN answers other ON other.conv_id = xor(own.conv_id, 1)
), both_sides AS (
  SELECT coalesce(a.conv_id, b.conv_id) AS conv_id, coalesce(a.pos, b.pos) AS pos, a.role AS a_role, a.text AS a_text, b.role AS b_role, b.text AS b_text,
         coalesce(a.role = b.role AND a.text = b.text, FALSE) AS same
  FROM turns a FULL JOIN rejected b ON a.conv_id = b.conv_id AND a.pos = b.pos
), marked AS (
  SELECT *, bool_and(same) OVER (PARTITION BY conv_id ORDER BY pos) AS shared,
         '<|im_start|>' || a_role || chr(10) || a_text || '<|im_end|>' || chr(10) AS a_whole, '<|im_start|>' || b_role || chr(10) || b_text || '<|im_end|>' || chr(10) AS b_whole
  FROM both_sides
), placed AS (
  SELECT *, coalesce(sum(length(a_whole)) FILTER (WHERE NOT shared) OVER w, 0) AS a_end, coalesce(sum(length(b_whole)) FILTER (WHERE NOT shared) OVER w, 0) AS b_end
  FROM marked WINDOW w AS (PARTITION BY conv_id ORDER BY pos)
), formatted AS (
  SELECT conv_id, count(*) FILTER (WHERE shared) AS n_prompt_turns, coalesce(string_agg(a_whole, '' ORDER BY pos) FILTER (WHERE shared), '') AS prompt,
         coalesce(string_agg(a_whole, '' ORDER BY pos) FILTER (WHERE NOT shared), '') AS chosen_text,
         coalesce(string_agg((a_end - length(a_text) - 11) || ':' || a_end, ';' ORDER BY pos) FILTER (WHERE NOT shared AND a_role = 'assistant'), '') AS chosen_mask,
         coalesce(string_agg(b_whole, '' ORDER BY pos) FILTER (WHERE NOT shared), '') AS rejected_text,
         coalesce(string_agg((b_end - length(b_text) - 11) || ':' || b_end, ';' ORDER BY pos) FILTER (WHERE NOT shared AND b_role = 'assistant'), '') AS rejected_mask
  FROM placed GROUP BY conv_id
)
SELECT f.conv_id, other.conv_id AS partner_id, n_prompt_turns, prompt, chosen_text, chosen_mask, rejected_text, rejected_mask
FROM formatted f LEFT JOIN answers own ON own.conv_id = f.conv_id LEFT JOIN answers other ON other.conv_id = xor(own.conv_id, 1)
"""
