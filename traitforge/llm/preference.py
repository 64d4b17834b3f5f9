"""Preference formatting: a shared prompt and two masked completions from paired conversations.

Of a chosen and a rejected conversation the longest common prefix of turns is rendered once, as
prompt; what follows on either side is rendered as completion, with the character ranges that are
trained on: the texts of assistant turns and their end marks. Everything is expressions over one
array of turns for each conversation, which is the unit that is rendered.

Defined results: turns stand in order of their number, then role and text; a null role or text is
empty; turns without a conversation id belong to none and are left out; repeated turns are turns;
if one conversation is a prefix of the other, its completion is empty; a pair with one side only
is left out; very long turns are rendered whole; empty tables give empty tables; other columns,
whatever their names, are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

OPEN, CLOSE, TRAINED = "<|im_start|>", "<|im_end|>\n", "assistant"


def gather_turns(turns: DataFrame, key: str, name: str, turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(key, ``name``): the turns of each conversation in order, as an array of (role, text)."""
    item = F.struct(F.col(turn).alias("turn"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))
    ordered = F.array_sort(F.collect_list(item))
    return turns.filter(F.col(key).isNotNull()).groupBy(key).agg(F.transform(ordered, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias(name))


def common_prefix(a: Column, b: Column) -> Column:
    """Number of leading turns that two conversations share."""
    n = F.least(F.size(a), F.size(b))
    differ = F.filter(F.sequence(F.lit(1), n), lambda i: F.element_at(a, i) != F.element_at(b, i))
    return F.when(n == 0, 0).otherwise(F.coalesce(F.array_min(differ) - 1, n))


def render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(OPEN), t["role"], F.lit("\n"), t["text"], F.lit(CLOSE))), "")


def trained_ranges(turns: Column) -> Column:
    """Character ranges ``start-end`` of assistant texts with their end marks, comma-joined."""
    state = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("spans"))

    def add(s: Column, t: Column) -> Column:
        start = s["at"] + len(OPEN) + 1 + F.length(t["role"])
        end = start + F.length(t["text"]) + len(CLOSE)
        span = F.concat_ws("-", start.cast("string"), end.cast("string"))
        return F.struct(end.alias("at"), F.when(t["role"] == TRAINED, F.array_append(s["spans"], span)).otherwise(s["spans"]).alias("spans"))

    return F.aggregate(turns, state, add, lambda s: F.array_join(s["spans"], ","))


def format_preferences(chosen: DataFrame, rejected: DataFrame, key: str) -> DataFrame:
    """One row for each pair: prompt, completions, trained ranges. The inputs come from
    :func:`gather_turns`, with columns ``chosen`` and ``rejected``."""
    paired = chosen.join(rejected, key).withColumn("n", common_prefix(F.col("chosen"), F.col("rejected")))
    rest = lambda c: F.slice(F.col(c), F.col("n") + 1, F.size(c))
    paired = paired.select(key, "n", F.slice("chosen", F.lit(1), F.col("n")).alias("shared"), rest("chosen").alias("good"), rest("rejected").alias("bad"))
    return paired.select(
        key,
        F.col("n").cast("long").alias("prompt_turns"),
        F.size("good").cast("long").alias("chosen_turns"),
        F.size("bad").cast("long").alias("rejected_turns"),
        render(F.col("shared")).alias("prompt"),
        render(F.col("good")).alias("chosen"),
        render(F.col("bad")).alias("rejected"),
        trained_ranges(F.col("good")).alias("chosen_trained"),
        trained_ranges(F.col("bad")).alias("rejected_trained"),
    )


def swapped_replies(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs from plain conversations: chosen as they are; rejected with the last assistant reply
    taken from the neighbour (conversation 2k and 2k+1 swap), or empty if that has none."""
    chosen = gather_turns(turns, "conv_id", "chosen")
    at = F.array_max(F.filter(F.sequence(F.lit(1), F.size("chosen")), lambda i: F.element_at("chosen", i)["role"] == TRAINED))
    marked = chosen.withColumn("last", at)
    reply = marked.select(F.col("conv_id").bitwiseXOR(F.lit(1)).alias("conv_id"), F.when(F.col("last").isNotNull(), F.element_at("chosen", F.col("last"))["text"]).alias("reply"))
    swapped = F.transform("chosen", lambda t, i: F.struct(t["role"].alias("role"), F.when(i + 1 == F.col("last"), F.coalesce("reply", F.lit(""))).otherwise(t["text"]).alias("text")))
    return chosen, marked.join(reply, "conv_id", "left").select("conv_id", swapped.alias("rejected"))


def op4_preference_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation against itself with the neighbour's last reply."""
    return format_preferences(*swapped_replies(table(spark, sf_dir, "conversations")), "conv_id")


OP4_SQL = r"""
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS p
  FROM conversations WHERE conv_id IS NOT NULL),
last AS (SELECT conv_id, max(p) AS p FROM t WHERE role = 'assistant' GROUP BY conv_id),
reply AS (SELECT xor(t.conv_id, 1) AS conv_id, text AS reply FROM t JOIN last USING (conv_id, p)),
b AS (
  SELECT t.conv_id, t.p, t.role, t.text, CASE WHEN t.p = last.p THEN coalesce(reply, '') ELSE t.text END AS other
  FROM t LEFT JOIN last ON t.conv_id = last.conv_id LEFT JOIN reply ON t.conv_id = reply.conv_id),
n AS (SELECT conv_id, coalesce(min(p) FILTER (WHERE text <> other) - 1, max(p)) AS n FROM b GROUP BY conv_id),
r AS (
  SELECT b.*, n, '<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10) AS ra, '<|im_start|>' || role || chr(10) || other || '<|im_end|>' || chr(10) AS rb FROM b JOIN n USING (conv_id)),
e AS (
  SELECT *, sum(length(ra)) FILTER (WHERE p > n) OVER w AS ea, sum(length(rb)) FILTER (WHERE p > n) OVER w AS eb FROM r
  WINDOW w AS (PARTITION BY conv_id ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT conv_id, CAST(any_value(n) AS BIGINT) AS prompt_turns, CAST(count(*) FILTER (WHERE p > n) AS BIGINT) AS chosen_turns, CAST(count(*) FILTER (WHERE p > n) AS BIGINT) AS rejected_turns,
  coalesce(string_agg(ra, '' ORDER BY p) FILTER (WHERE p <= n), '') AS prompt,
  coalesce(string_agg(ra, '' ORDER BY p) FILTER (WHERE p > n), '') AS chosen,
  coalesce(string_agg(rb, '' ORDER BY p) FILTER (WHERE p > n), '') AS rejected,
  coalesce(string_agg(CAST(ea - length(text) - 11 AS BIGINT) || '-' || CAST(ea AS BIGINT), ',' ORDER BY p) FILTER (WHERE p > n AND role = 'assistant'), '') AS chosen_trained,
  coalesce(string_agg(CAST(eb - length(other) - 11 AS BIGINT) || '-' || CAST(eb AS BIGINT), ',' ORDER BY p) FILTER (WHERE p > n AND role = 'assistant'), '') AS rejected_trained
FROM e GROUP BY conv_id
"""
