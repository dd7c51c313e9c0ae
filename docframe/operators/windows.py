"""Window features that SQL has and Spark lacks, as rewrites to what it has."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docframe.sources.scratch import written


def qualify(df: DataFrame, test: Column, **windows: Column) -> DataFrame:
    """Filter on window values, which are computed after WHERE and dropped again."""
    return df.withColumns({f"_q_{k}": v for k, v in windows.items()}).where(test).select(*df.columns)


def groups_frame(df: DataFrame, partition: list[str], order: Column, start: int, end: int, name: str, value) -> DataFrame:
    """``value(window)`` over a GROUPS frame: peers get one dense rank, over which the frame is a range."""
    ranked = df.withColumn("_g", F.dense_rank().over(Window.partitionBy(*partition).orderBy(order)))
    return ranked.withColumn(name, value(Window.partitionBy(*partition).orderBy("_g").rangeBetween(start, end))).drop("_g")


def filtered(aggregate, x: Column, where: Column, window) -> Column:
    """agg(x) FILTER (WHERE ..) OVER (..)"""
    return aggregate(F.when(where, x)).over(window)


def count_distinct(x: Column, window) -> Column:
    return F.size(F.collect_set(x).over(window)).cast("bigint")


def sum_distinct(x: Column, window, zero=0) -> Column:
    return F.aggregate(F.collect_set(x).over(window), F.lit(zero).cast("double"), lambda a, b: a + b)


def range_count(df: DataFrame, partition: list[str], key: Column, before: int, after: int, name: str) -> DataFrame:
    """count(*) over a RANGE frame of an integer key; a null key's frame is the partition's null keys.

    A frame's count is the rows up to its end less the rows before its start.  Both
    are running counts in one sorted table of points: each distinct key with its rows,
    and the starts and ends of frames, which count nothing.  The sorted points are
    written once in blocks of at most 2^18; a block begins with what the earlier
    blocks of its partition hold, so neither a large partition nor a dense frame meets
    in one task.
    """
    keyed = df.withColumn("_key", key.cast("bigint"))
    at, side = F.col("_at"), F.col("_side")

    def point(at: Column, side: int, n: Column) -> Column:
        return F.struct(at.alias("_at"), F.lit(side).alias("_side"), n.alias("_n"))

    # At one place starts come before rows, and rows before ends; a frame up to the current row ends with its own rows.
    zero = F.lit(0).cast("bigint")
    points = [point(F.col("_key") - F.lit(before), 0, zero), point(F.col("_key"), 1, F.col("_n"))] + ([point(F.col("_key") + F.lit(after), 2, zero)] if after else [])
    peers = keyed.groupBy(*partition, "_key").agg(F.count(F.lit(1)).alias("_n"))
    spread = peers.select(*partition, F.explode(F.array(*points)).alias("_p")).select(*partition, "_p.*")
    split = written(spread.orderBy(*partition, "_at", "_side").withColumn("_block", F.shiftright(F.monotonically_increasing_id(), 18)), "range_points")
    held = split.groupBy(*partition, "_block").agg(F.sum("_n").alias("_n"))
    earlier = F.sum("_n").over(Window.partitionBy(*partition).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1))
    carried = held.select(*partition, F.lit(None).cast("bigint").alias("_at"), F.lit(-1).alias("_side"), F.coalesce(earlier, zero).alias("_n"), "_block")
    running = F.sum("_n").over(Window.partitionBy(*partition, "_block").orderBy("_at", "_side").rowsBetween(Window.unboundedPreceding, 0))
    ends = split.unionByName(carried).withColumn("_c", running).where(side.isin(0, 2 if after else 1))
    ends = ends.select(*partition, F.when(side == 0, at + F.lit(before)).otherwise(at - F.lit(after)).alias("_key"), F.when(side == 0, -F.col("_c")).otherwise(F.col("_c")).alias("_c"))
    # Dealt out first, as a map of keys beside the sort and the window has too little memory.
    counted = ends.repartition(*partition, "_key").groupBy(*partition, "_key").agg(F.sum("_c").alias("_v"))
    found = counted.select(*[F.col(c).alias(f"_p{i}") for i, c in enumerate(partition)], F.col("_key").alias("_k"), "_v")
    same = F.col("_key").eqNullSafe(F.col("_k"))
    for i, c in enumerate(partition):
        same = same & F.col(c).eqNullSafe(F.col(f"_p{i}"))
    return keyed.join(found, same).select(*df.columns, F.col("_v").alias(name))


def range_count_ms(df: DataFrame, partition: list[str], ts: str, before_ms: int, after_ms: int, name: str) -> DataFrame:
    """count(*) over a RANGE frame over time, in milliseconds."""
    return range_count(df, partition, F.unix_millis(F.col(ts).cast("timestamp")), before_ms, after_ms, name)


def lag_or(x: str, offset: int, default: Column, window) -> Column:
    """LAG whose default is evaluated on the current row."""
    return F.when(F.row_number().over(window) > offset, F.lag(x, offset).over(window)).otherwise(default)


def lead_or(x: str, offset: int, default: Column, partition_window, ordered_window) -> Column:
    left = F.count(F.lit(1)).over(partition_window) - F.row_number().over(ordered_window)
    return F.when(left >= offset, F.lead(x, offset).over(ordered_window)).otherwise(default)
