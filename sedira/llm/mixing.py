"""Mixing sources to target weights, in DataFrame functions only.

Tokens are counted by source, each source gets a rate of repetition (its target over its size), and every document is
emitted floor(rate) times, plus once more with the probability of the fraction f, decided by a hash u of its id and text:
the j-th (from 0) of rows that are equal in id, text and source is emitted once more if a multiple of 1 lies in
[j f - u, (j + 1) f - u), which is u < f for a row that is not repeated, and f of all copies for one that is.

Cases: a null text has size 0 (and is emitted like any other document of its source); a null source is a source of its
own, sorted last; a source without words has target 0 and rate 1, so its documents stay; an empty table gives an empty
result. `mix` returns the columns of the input whatever their names; `plan` adds columns that start with `mix_`, which
the input must not have.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sedira.llm.common import WORD, Scratch, copy_numbers, read

CAP = 3
#: Sources whose table (a name and two numbers each) is broadcast at most.
BROADCAST = 1 << 16


def tokens(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sized: DataFrame, weight: Column | None = None, cap: int = CAP) -> DataFrame:
    """(source, source_size, target): one row a source. `sized` has source and mix_size; `weight` is an expression over
    mix_rank (from 1, by code point, null last) and source, by default 1, 2, 3, repeating.

    Shares are of all words. A target stops at `cap` times its source's size and the excess goes to the others by
    weight until none is above: sources in the order of cap/weight are capped as long as the level that the others
    would reach is above their own, which is that procedure's fixed point. Only one row a source is sorted here.
    """
    weight = (F.col("mix_rank") - 1) % 3 + 1 if weight is None else weight
    by = sized.groupBy("source").agg(F.sum("mix_size").cast("long").alias("source_size"))
    by = by.withColumn("mix_rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    by = by.withColumn("mix_weight", weight.cast("double")).withColumn("mix_cap", (F.col("source_size") * cap).cast("double"))
    order = Window.orderBy(F.col("mix_cap") / F.col("mix_weight"), "mix_rank")
    before, after, whole = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing), order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("source_size").over(whole) - F.coalesce(F.sum("mix_cap").over(before), F.lit(0.0))) / F.sum("mix_weight").over(after)
    by = by.withColumn("mix_level", F.when(level * F.col("mix_weight") <= F.col("mix_cap"), level))
    by = by.withColumn("mix_level", F.max_by("mix_level", F.when(F.col("mix_level").isNotNull(), -F.col("mix_cap") / F.col("mix_weight"))).over(whole))
    target = F.least(F.col("mix_cap"), F.coalesce(F.col("mix_level") * F.col("mix_weight"), F.col("mix_cap")))
    return by.select("source", "source_size", target.alias("target"))


def unit(seed: int, *of: Column) -> Column:
    """A number in [0, 1) that depends on the arguments only: 52 bits of an md5."""
    h = F.md5(F.concat_ws(":", F.lit(str(seed)), *(F.coalesce(c.cast("string"), F.lit("")) for c in of)))
    return F.conv(F.substring(h, 1, 13), 16, 10).cast("double") / float(1 << 52)


def plan(docs: DataFrame, weight: Column | None = None, cap: int = CAP, seed: int = 2) -> DataFrame:
    """The documents with mix_size, mix_source_size, mix_target and mix_copies (how often the mix holds each).

    The table of sources is written and counted first: up to `BROADCAST` sources it is broadcast, and the documents stay
    where they are read; beyond that the join is left to the optimizer.
    """
    scratch = Scratch(docs.sparkSession)
    sized = copy_numbers(docs, scratch, "mix_nth", ["doc_id", "text", "source"]).withColumn("mix_size", tokens(F.col("text")))
    by = targets(docs.select("source", tokens(F.col("text")).alias("mix_size")), weight, cap).select(F.col("source").alias("mix_source"), F.col("source_size").alias("mix_source_size"), F.col("target").alias("mix_target"))
    by = scratch.keep(by, "sources")
    by = F.broadcast(by) if by.count() <= BROADCAST else by
    joined = sized.join(by, sized["source"].eqNullSafe(by["mix_source"])).drop("mix_source")
    rate = F.when(F.col("mix_source_size") > 0, F.least(F.lit(float(cap)), F.col("mix_target") / F.col("mix_source_size"))).otherwise(1.0)
    whole = F.floor(rate)
    part, u = rate - whole, unit(seed, F.col("doc_id"), F.col("text"))
    extra = F.ceil((F.col("mix_nth") + 1) * part - u) - F.ceil(F.col("mix_nth") * part - u)
    return joined.withColumn("mix_copies", (whole + extra).cast("long")).drop("mix_nth")


def mix(docs: DataFrame, weight: Column | None = None, cap: int = CAP, seed: int = 2) -> DataFrame:
    """The mixed corpus: the documents' own columns, each document as often as its plan says."""
    rows = docs.select(F.struct("*").alias("doc"), "doc_id", "text", "source")
    emitted = plan(rows, weight, cap, seed).where("mix_copies > 0").withColumn("mix_copy", F.explode(F.sequence(F.lit(1), F.col("mix_copies").cast("int"))))
    return emitted.select("doc.*")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return plan(docs).select("doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"), (F.col("mix_size") * F.col("mix_copies")).alias("taken"))


ORACLE_OP2 = r"""
WITH sized AS (
  SELECT doc_id, text, source, row_number() OVER (PARTITION BY doc_id, text, source) - 1 AS nth, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
by_source AS (
  SELECT source, sum(size)::BIGINT AS source_size, ((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::DOUBLE AS w FROM sized GROUP BY source),
capped AS (SELECT *, (source_size * 3)::DOUBLE AS cap, row_number() OVER (ORDER BY source ASC NULLS LAST) AS r FROM by_source),
levels AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / w, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(w) OVER (ORDER BY cap / w, r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM capped),
first_free AS (SELECT level FROM levels WHERE level * w <= cap ORDER BY cap / w, r LIMIT 1),
targets AS (SELECT source, source_size, least(cap, coalesce((SELECT level FROM first_free) * w, cap)) AS target FROM levels),
rates AS (SELECT *, CASE WHEN source_size > 0 THEN least(3.0::DOUBLE, target / source_size) ELSE 1.0::DOUBLE END AS rate FROM targets),
drawn AS (
  SELECT doc_id, size, nth, source_size, target, floor(rate) AS whole, rate - floor(rate) AS part,
    ('0x' || substr(md5('2:' || coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u
  FROM sized JOIN rates ON sized.source IS NOT DISTINCT FROM rates.source)
SELECT doc_id, size, source_size, target, (size * (whole + ceil((nth + 1) * part - u) - ceil(nth * part - u)))::BIGINT AS taken FROM drawn
"""
