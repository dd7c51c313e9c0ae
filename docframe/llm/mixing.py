"""Mixing sources to target weights along a time-varying curriculum, in DataFrame functions alone.

``targets`` fills the weights: every source gets words in proportion to its
weight, but at most ``MAX_REPEATS`` times what it has; what is cut off goes to
the others by weight.  With the sources in order of cap over weight this is one
pass of running sums: the level is reached at the first source whose share at
the level of the rest is under its cap.

Each source has a schedule, a piecewise linear weight over training time 0..1
whose integral says how much of its target is due by then.  A document that
starts at word c of its source's stream stands where the integral has reached
c; the inverse of a linear piece's integral is the root of a quadratic.
Documents are range-sorted by position.

Streams run in the order of the md5 of doc_id.  Running sums are taken in blocks
of the hash, 16 to the power of ``BLOCK_DIGITS`` for a source at most, first over the sums of the blocks and
then within each, so that no task holds a source.  One window runs over the
table of sources, which has a row for each source.

Null texts and texts without words have size 0 and are taken 0 times; null is a
source of its own and comes last.  Rows that are repeated are mixed one by one.
The last document of a source may be taken in part, so that the words taken
meet the target rounded to whole words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Written

MAX_REPEATS = 3
BLOCK_DIGITS = 3
WEIGHTS = (1, 2, 3)
#: (time, weight) knots of the schedules that sources take in turn: early, even, late.
SCHEDULES = (((0.0, 1.5), (0.6, 1.0), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (0.4, 1.0), (1.0, 1.5)))


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = MAX_REPEATS) -> DataFrame:
    """(source, source_size, turn, target) from (source, source_size)."""
    in_order = W.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(F.col("turn"), F.lit(len(weights))) + 1).cast("int"))
    ranked = sizes.withColumn("turn", F.row_number().over(in_order) - 1).withColumn("weight", weight).withColumn("cap", repeats * F.col("source_size"))
    by_cap = W.orderBy(F.col("cap") / F.col("weight"), "turn")
    everything = by_cap.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    open_to = ranked.withColumns({
        "capped": F.coalesce(F.sum("cap").over(by_cap.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)),
        "rest": F.sum("weight").over(by_cap.rowsBetween(0, W.unboundedFollowing)),
        "words": F.sum("source_size").over(everything),
    })
    level = (F.col("words") - F.col("capped")).cast("double") / F.col("rest").cast("double")
    reached = F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level"))
    final = open_to.withColumn("level", level).withColumn("reached", F.first(reached, ignorenulls=True).over(everything))
    return final.select("source", "source_size", "turn", F.least(F.col("cap").cast("double"), F.col("reached") * F.col("weight")).alias("target"))


def due_time(share: Column, turn: Column, schedules=SCHEDULES) -> Column:
    """When the integral of a source's schedule reaches ``share`` of the whole."""
    out = F.lit(None).cast("double")
    for k, knots in enumerate(schedules):
        area = [(t1 - t0) * (w0 + w1) / 2 for (t0, w0), (t1, w1) in zip(knots, knots[1:], strict=False)]
        whole, done, when = sum(area), 0.0, None
        for ((t0, w0), (t1, w1)), a in zip(zip(knots, knots[1:], strict=False), area, strict=True):
            due = share * F.lit(whole) - F.lit(done)
            slope = (w1 - w0) / (t1 - t0)
            if slope:
                at = F.lit(t0) + (F.sqrt(F.greatest(F.lit(w0 * w0) + F.lit(2 * slope) * due, F.lit(0.0))) - F.lit(w0)) / F.lit(slope)
            else:
                at = F.lit(t0) + due / F.lit(w0)
            done += a
            test = share * F.lit(whole) <= F.lit(done)
            when = F.when(test, at) if when is None else when.when(test, at)
        out = F.when(F.pmod(turn, F.lit(len(schedules))) == k, when.otherwise(F.lit(1.0))).otherwise(out)
    return out


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, schedules=SCHEDULES, repeats: int = MAX_REPEATS) -> DataFrame:
    """Per document its size, its source's size and target, the words taken and the positions of its passes, range-sorted."""
    tables = Written(docs.sparkSession)
    base = docs.select("doc_id", "source", word_count().alias("size"), F.coalesce(F.md5(F.col("doc_id").cast("string").cast("binary")), F.lit("")).alias("h"), F.xxhash64("text").alias("t"))
    sized = tables.put(base.withColumn("block", F.substring("h", 1, BLOCK_DIGITS)), "sizes")
    blocks = sized.groupBy("source", "block").agg(F.sum("size").alias("words"))
    per_source = targets(blocks.groupBy("source").agg(F.sum("words").alias("source_size")), weights, repeats)
    earlier = W.partitionBy("source").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    starts = blocks.withColumn("start", F.coalesce(F.sum("words").over(earlier), F.lit(0))).alias("b")
    plan = starts.join(per_source.alias("s"), F.col("b.source").eqNullSafe(F.col("s.source"))).select("b.source", "b.block", "start", "source_size", "turn", "target")
    inside = W.partitionBy("source", "block").orderBy("h", "doc_id", "t", "size").rowsBetween(W.unboundedPreceding, -1)
    placed = sized.withColumn("before", F.coalesce(F.sum("size").over(inside), F.lit(0))).alias("d")
    joined = placed.join(plan.alias("p"), F.col("d.source").eqNullSafe(F.col("p.source")) & (F.col("d.block") == F.col("p.block"))).select("doc_id", "size", "source_size", "turn", "target", (F.col("before") + F.col("start")).alias("at"))
    budget = F.round("target").cast("bigint")
    passes = F.when(F.col("source_size") > 0, F.expr("cast(round(target) as bigint) div source_size")).otherwise(F.lit(0))
    part = F.least(F.greatest(budget - F.col("passes") * F.col("source_size") - F.col("at"), F.lit(0)), F.col("size"))
    taken = joined.withColumn("passes", passes).withColumn("part", part)
    rounds = F.col("passes") + F.when(F.col("part") > 0, 1).otherwise(0)
    share = lambda k: (F.col("at") + k * F.col("source_size")).cast("double") / F.col("target")
    times = F.transform(F.sequence(F.lit(0).cast("bigint"), rounds - 1), lambda k: due_time(share(k), F.col("turn"), schedules))
    positions = F.when((rounds > 0) & (F.col("size") > 0), times).otherwise(F.array().cast("array<double>"))
    return taken.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("passes") + F.col("part")).cast("bigint").alias("taken"), positions.alias("positions")).orderBy(F.get("positions", F.lit(0)).asc_nulls_last(), "doc_id")
