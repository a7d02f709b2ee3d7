"""How document filters interact, in every order: an audit on subset survivors from a SQL cube (operator 12)."""

from __future__ import annotations

import math
from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from netloom.operators.components import checkpointed

FILTERS = "ABCDE"
_BLANKS = r"[\x20\x09-\x0D]+"


def failures(text: Column) -> dict[str, Column]:
    """The conditions under which a text fails the filters that look at it alone; E looks at the table."""
    words = F.array_remove(F.split(text, _BLANKS), "")
    return {
        "A": F.size(words) < 100,
        "B": 100 * F.size(F.array_distinct(words)) < 80 * F.size(words),
        "C": 100 * (F.length(text) - F.length(F.regexp_replace(text, "[A-Z]", ""))).cast("long") > 10 * F.length(text).cast("long"),
        "D": text.rlike("[#$%&*|]"),
    }


def failed(docs: DataFrame) -> DataFrame:
    """``(doc_id, part, A, B, C, D, E)`` of each row of docs(doc_id, text, lang): which filters it fails.

    ``part`` is lang, or the empty string where that is null; a null text is empty. E is failed by a
    row whose text is, digest for digest, that of a row with a smaller doc_id; rows that share the
    least doc_id pass. A row without a doc_id passes E and makes no other row fail it.

    A row finds out whether it is the first of its text by its own id and digest together, so a text of
    a third of all rows is a key like any other.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    fails = failures(text)
    rows = checkpointed(docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"),
        F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"), *(fails[k].alias(k) for k in "ABCD"),
    ))
    firsts = rows.where("doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    later = F.col("doc_id").isNotNull() & F.col("first").isNull()
    return rows.join(firsts, ["doc_id", "digest"], "left").select("doc_id", "part", *"ABCD", later.alias("E"))


def survivors(flagged: DataFrame, labels: DataFrame) -> DataFrame:
    """``(part, chosen, n, good, toxic)``: the rows that pass all filters of each subset, a row for all 32 of each part.

    ``chosen`` has bit k set where the k-th filter is in the subset. Rows are counted by part and
    flags first, so that the cube works on 32 rows a part at most. A document is good if any row of labels(doc_id,
    quality, toxic) says quality 1, toxic likewise; null ids have no label.
    """
    spark = flagged.sparkSession
    marks = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.expr("int(quality <=> 1)")).alias("good"), F.max(F.expr("int(toxic <=> 1)")).alias("toxic"))
    counted = flagged.join(marks, "doc_id", "left").groupBy("part", *FILTERS)
    counted = checkpointed(counted.agg(F.count("*").alias("n"), F.sum(F.coalesce("good", F.lit(0))).alias("good"), F.sum(F.coalesce("toxic", F.lit(0))).alias("toxic")), slim=True)
    cube = spark.sql(
        """select part, A, B, C, D, E, grouping(A) as gA, grouping(B) as gB, grouping(C) as gC, grouping(D) as gD, grouping(E) as gE,
               sum(n) as n, sum(good) as good, sum(toxic) as toxic from {counted} group by part, cube (A, B, C, D, E)""",
        counted=counted,
    )
    passed = F.lit(True)
    for k in FILTERS:
        passed = passed & ((F.col(f"g{k}") == 1) | ~F.col(k))
    chosen = sum((1 - F.col(f"g{k}").cast("int")) * 2**i for i, k in enumerate(FILTERS))
    found = cube.where(passed).select("part", chosen.cast("int").alias("chosen"), "n", "good", "toxic")
    every = counted.select("part").distinct().select("part", F.explode(F.sequence(F.lit(0), F.lit(31))).alias("chosen"))
    return every.join(found, ["part", "chosen"], "left").na.fill(0, ["n", "good", "toxic"])


def orders(spark: SparkSession) -> DataFrame:
    """``(filter_order, step, filter, before)``: each step of each order; ``before`` is the subset applied earlier."""
    rows = []
    for order in permutations(range(len(FILTERS))):
        name = "".join(FILTERS[k] for k in order)
        rows += [(name, step + 1, k, sum(1 << j for j in order[:step])) for step, k in enumerate(order)]
    return spark.createDataFrame(rows, "filter_order string, step int, filter int, before int")


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """What each filter removes at each step of each order, by part: the columns below for all 120 orders of ABCDE.

    part, filter_order, step, then within the part: kept (after the step), removed (by it),
    redundant (failing its filter, but removed earlier), unique_fails (failing no other filter), good_lost
    and toxic_lost (removed by it, of that label), shapley (removed by its filter in all orders together).

    Each of these is a difference of two subsets' survivors, the one of the filters before a step and the one
    with its own as well; such pairs are joined once and looked up by every order. See ``failed`` and
    ``survivors`` for null values and repeated rows; an empty table has no parts and gives no rows; further columns are ignored.
    """
    subsets = checkpointed(survivors(failed(docs), labels), slim=True)
    before = subsets.select("part", F.col("chosen").alias("before"), "n", "good", "toxic", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("filter"))
    before = before.where("(before >> filter) & 1 = 0").withColumn("chosen", F.expr("before | (1 << filter)"))
    after = subsets.select("part", "chosen", F.col("n").alias("kept"), F.col("good").alias("good_kept"), F.col("toxic").alias("toxic_kept"))
    pairs = before.join(after, ["part", "chosen"]).select(
        "part", "before", "filter", "kept", (F.col("n") - F.col("kept")).alias("removed"),
        (F.col("good") - F.col("good_kept")).alias("good_lost"), (F.col("toxic") - F.col("toxic_kept")).alias("toxic_lost"),
    )
    size = F.bit_count("before")
    times = F.element_at(F.array(*(F.lit(math.factorial(k) * math.factorial(4 - k)) for k in range(5))), size + 1)
    alone = F.col("before") == F.lit(31) - F.expr("1 << filter")
    of = pairs.groupBy("part", "filter").agg(
        F.sum(F.when(F.col("before") == 0, F.col("removed"))).alias("fails"), F.sum(F.when(alone, F.col("removed"))).alias("unique_fails"), F.sum(times * F.col("removed")).alias("shapley")
    )
    told = pairs.join(of, ["part", "filter"]).join(F.broadcast(orders(docs.sparkSession)), ["before", "filter"])  # 600 rows
    counts = ["kept", "removed", (F.col("fails") - F.col("removed")).alias("redundant"), "unique_fails", "good_lost", "toxic_lost", "shapley"]
    return told.select("part", "filter_order", "step", *counts)


ORACLE = r"""
with recursive d as (select doc_id, coalesce(lang, '') as part, coalesce(text, '') as t from documents),
f as (select part, doc_id, t, list_filter(regexp_extract_all(t, '[^\x20\x09-\x0D]+'), lambda x: x <> '') as w,
  coalesce(doc_id > min(doc_id) over (partition by t), false) as fe from d),
g as (select part, [len(w) < 100, 100 * len(list_distinct(w)) < 80 * len(w), 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t),
  regexp_matches(t, '[#$%&*|]'), fe] as fail, coalesce(quality, 0) = 1 as good, coalesce(toxic, 0) = 1 as toxic from f left join labels l on l.doc_id = f.doc_id),
c as (select part, fail, count(*) as n, count(*) filter (good) as good, count(*) filter (toxic) as toxic from g group by all),
p as (select '' as o, 'ABCDE' as rest union all select o || substr(rest, i::bigint, 1), substr(rest, 1, i::int - 1) || substr(rest, i::int + 1)
  from p, lateral (select unnest(range(1, length(rest) + 1)) as i) where rest <> ''),
s as (select o, k::int as step, ascii(substr(o, k::int, 1)) - 64 as f, list_transform(string_split(substr(o, 1, k::int - 1), ''), lambda x: ascii(x) - 64) as earlier
  from p, lateral (select unnest(range(1, 6)) as k) where rest = ''),
h as (select part, o, step, f, fail[f] as own, len(list_filter(earlier, lambda e: e > 0 and fail[e])) > 0 as gone,
  len(list_filter(fail, lambda x: x)) = 1 as single, n, good, toxic from c, s),
r as (select part, o as filter_order, step, f,
  coalesce(sum(n) filter (not gone and not own), 0)::bigint as kept, coalesce(sum(n) filter (not gone and own), 0)::bigint as removed,
  coalesce(sum(n) filter (gone and own), 0)::bigint as redundant, coalesce(sum(n) filter (own and single), 0)::bigint as unique_fails,
  coalesce(sum(good) filter (not gone and own), 0)::bigint as good_lost, coalesce(sum(toxic) filter (not gone and own), 0)::bigint as toxic_lost from h group by all)
select part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) over (partition by part, f))::bigint as shapley from r
"""
