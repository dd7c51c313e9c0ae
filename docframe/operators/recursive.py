"""Recursive queries: rounds over the rows that the last round found."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from docframe.sources.scratch import scratch_path

MAX_ROUNDS, MAX_ROWS = 100, 100_000


def recursive(anchor: DataFrame, step: Callable[[DataFrame], DataFrame], distinct: bool = False, max_rounds: int = MAX_ROUNDS, max_rows: int = MAX_ROWS) -> DataFrame:
    """UNION ALL of the rounds, or with ``distinct`` UNION, which ends on cycles.

    Each round is written to the checkpoint folder, which cuts the lineage; an
    own folder is set only where the session names none.
    """
    spark = anchor.sparkSession
    root = scratch_path(spark, "recursive")

    def kept(df: DataFrame, n: int) -> DataFrame:
        df.write.parquet(f"{root}/{n}")
        return spark.read.schema(df.schema).parquet(f"{root}/{n}")

    fresh = kept(anchor.distinct() if distinct else anchor, 0)
    whole, rows = fresh, fresh.count()
    for n in range(1, max_rounds + 1):
        found = step(fresh).toDF(*anchor.columns)
        fresh = kept(found.distinct().subtract(whole) if distinct else found, n)
        new = fresh.count()
        if not new:
            return whole
        rows += new
        if rows > max_rows:
            raise RuntimeError(f"recursion passed {max_rows} rows")
        whole = whole.union(fresh)
    raise RuntimeError(f"recursion passed {max_rounds} rounds")
