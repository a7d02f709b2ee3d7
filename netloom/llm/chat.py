"""Preference formatting of paired conversations (operator 5), in DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Fixed marks around a turn, and roles that a completion may learn from.
OPEN, CLOSE, END = "<|", "|>\n", "<|end|>\n"
LEARNT = ("assistant",)


def rendered(role: Column, text: Column) -> Column:
    return F.concat(F.lit(OPEN), role, F.lit(CLOSE), text, F.lit("\n" + END))


def preference_turns(chosen: DataFrame, rejected: DataFrame) -> DataFrame:
    """The rendered turns of chosen and rejected conversations: conv_id, part, turn, role, text, learn.

    Both inputs have (conv_id, turn, role, text); the two sides of a pair bear the same conv_id. A
    conversation's turns are those of its id by turn number; null roles and texts are empty.
    The longest common prefix ends before the first turn that is missing on one side or differs
    in role or text; its turns appear once, as part ``prompt``, and the others as ``chosen`` or
    ``rejected``. ``learn`` masks what a completion learns: its assistant turns, never the prompt.

    Only the point of divergence is aggregated per conversation, as a minimum, so a conversation
    of any length is spread over tasks. Rows without conv_id or turn are left out; where a
    turn of a conversation is repeated, the least (role, text) stands for it. Empty tables give
    no rows, and other columns are ignored.
    """

    def turns(df: DataFrame, side: str) -> DataFrame:
        rows = df.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
        rows = rows.where("conv_id is not null and turn is not null").groupBy("conv_id", "turn").agg(F.min(F.struct("role", "text")).alias(side))
        return rows

    both = turns(chosen, "chosen").join(turns(rejected, "rejected"), ["conv_id", "turn"], "full")
    fork = both.groupBy("conv_id").agg(F.min(F.when(~F.col("chosen").eqNullSafe(F.col("rejected")), F.col("turn"))).alias("fork"))
    placed = both.join(fork.withColumn("conv_id", F.col("conv_id").bitwiseXOR(F.lit(0).cast("long"))), "conv_id")
    shared = F.col("fork").isNull() | (F.col("turn") < F.col("fork"))
    part = lambda name, side: F.struct(F.lit(name).alias("part"), F.col(f"{side}.role").alias("role"), F.col(f"{side}.text").alias("text"))
    parts = F.when(shared, F.array(part("prompt", "chosen"))).otherwise(F.filter(F.array(part("chosen", "chosen"), part("rejected", "rejected")), lambda p: p["role"].isNotNull()))
    rows = placed.select("conv_id", "turn", F.explode(parts).alias("p"))
    learn = (F.col("p.part") != "prompt") & F.col("p.role").isin(*LEARNT)
    return rows.select("conv_id", "p.part", "turn", "p.role", rendered(F.col("p.role"), F.col("p.text")).alias("text"), learn.alias("learn"))


def preference_pairs(chosen: DataFrame, rejected: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, prompt, chosen, rejected, their masks, and numbers of turns.

    ``prompt`` is the common prefix rendered once, ``chosen`` and ``rejected`` the two completions.
    A mask lists ``start:end`` of the characters of its completion to learn from, end exclusive.
    Two equal conversations have empty completions. See ``preference_turns``, whose rows are the
    form for conversations too long to be one string.
    """
    rows = preference_turns(chosen, rejected)
    size = F.length("text").cast("long")
    before = F.sum(size).over(Window.partitionBy("conv_id", "part").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1))
    placed = rows.withColumn("at", F.coalesce(before, F.lit(0).cast("long"))).withColumn("span", F.when(F.col("learn"), F.concat_ws(":", F.col("at"), F.col("at") + size)))

    def joined(part: str, column: str, sep: str) -> Column:
        got = F.sort_array(F.collect_list(F.when(F.col("part") == part, F.struct("turn", F.col(column).alias("v")))))
        return F.array_join(F.transform(got, lambda x: x["v"]), sep)

    count = lambda part: F.count(F.when(F.col("part") == part, 1))
    return placed.groupBy("conv_id").agg(
        joined("prompt", "text", "").alias("prompt"),
        joined("chosen", "text", "").alias("chosen"),
        joined("rejected", "text", "").alias("rejected"),
        joined("chosen", "span", ",").alias("chosen_mask"),
        joined("rejected", "span", ",").alias("rejected_mask"),
        count("prompt").alias("n_prompt"),
        count("chosen").alias("n_chosen"),
        count("rejected").alias("n_rejected"),
    )


def with_rejected(conversations: DataFrame) -> DataFrame:
    """A rejected side for each conversation: itself, but for its last assistant turn, which says what that of the next id says.

    The conversation with the next id (conv_id + 1) lends the text of its own last assistant turn; if there is no such
    turn on either side, the conversation stays as it is. Rows without conv_id or turn are left out; null texts are lent and kept as nulls, where a
    turn is repeated all its rows get the lent text, columns other than conv_id, turn, role and text are left out, and an empty table gives no rows.
    """
    rows = conversations.select("conv_id", "turn", "role", "text").where("conv_id is not null and turn is not null")
    last = rows.where(F.col("role") == "assistant").groupBy("conv_id").agg(F.max(F.struct("turn", "text")).alias("last"))
    lent = last.select((F.col("conv_id") - 1).alias("conv_id"), F.struct(F.col("last.text").alias("text")).alias("lent"))
    point = last.select("conv_id", F.col("last.turn").alias("at")).join(lent, "conv_id")
    joined = rows.join(point.withColumn("conv_id", F.col("conv_id").bitwiseXOR(F.lit(0).cast("long"))), "conv_id", "left")
    swap = (F.col("turn") == F.col("at")) & (F.col("role") == "assistant")
    return joined.select("conv_id", "turn", "role", F.when(swap, F.col("lent.text")).otherwise(F.col("text")).alias("text"))


ORACLE = """
with rows_ as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text, role as r0, text as t0
               from conversations where conv_id is not null and turn is not null),
last_ as (select conv_id, max(turn) as turn from rows_ where r0 = 'assistant' group by conv_id),
said as (select l.conv_id, l.turn, max(r.text) as text from last_ l join rows_ r on r.conv_id = l.conv_id and r.turn = l.turn and r.r0 = 'assistant' group by all),
point as (select a.conv_id, a.turn, b.text from said a join said b on b.conv_id = a.conv_id + 1),
c as (select conv_id, turn, min({'role': role, 'text': text}) as s from rows_ group by all),
r as (select r.conv_id, r.turn, min({'role': r.role, 'text': case when r.r0 = 'assistant' and p.conv_id is not null then p.text else r.text end}) as s
      from rows_ r left join point p on p.conv_id = r.conv_id and p.turn = r.turn group by all),
both_ as (select coalesce(c.conv_id, r.conv_id) as conv_id, coalesce(c.turn, r.turn) as turn, c.s as c, r.s as r
          from c full join r on c.conv_id = r.conv_id and c.turn = r.turn),
fork as (select conv_id, min(case when c is distinct from r then turn end) as fork from both_ group by conv_id),
parts as (
  select b.conv_id, case when fork is null or turn < fork then 'prompt' else 'chosen' end as part, turn, c as s from both_ b join fork using (conv_id) where c is not null
  union all
  select b.conv_id, 'rejected', turn, r from both_ b join fork using (conv_id) where r is not null and fork is not null and turn >= fork),
told as (select conv_id, part, turn, s.role as role, '<|' || s.role || '|>' || chr(10) || s.text || chr(10) || '<|end|>' || chr(10) as text from parts),
placed as (select *, coalesce(sum(length(text)) over (partition by conv_id, part order by turn rows between unbounded preceding and 1 preceding), 0)::bigint as pos from told),
spans as (select *, case when part <> 'prompt' and role = 'assistant' then pos || ':' || (pos + length(text)) end as span from placed)
select conv_id,
  coalesce(string_agg(text, '' order by turn) filter (part = 'prompt'), '') as prompt,
  coalesce(string_agg(text, '' order by turn) filter (part = 'chosen'), '') as chosen,
  coalesce(string_agg(text, '' order by turn) filter (part = 'rejected'), '') as rejected,
  coalesce(string_agg(span, ',' order by turn) filter (part = 'chosen'), '') as chosen_mask,
  coalesce(string_agg(span, ',' order by turn) filter (part = 'rejected'), '') as rejected_mask,
  count(*) filter (part = 'prompt') as n_prompt, count(*) filter (part = 'chosen') as n_chosen, count(*) filter (part = 'rejected') as n_rejected
from spans group by conv_id
"""
