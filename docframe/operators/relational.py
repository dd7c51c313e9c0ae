"""Joins, subquery predicates, set operations, limits and reshaping on DataFrames."""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docframe.functions.compare import ge, gt, le, lt
from docframe.sources.scratch import written


def _same(left: DataFrame, right: DataFrame, pairs: list[tuple[str, str]]) -> Column:
    return reduce(lambda a, b: a & b, [left[a].eqNullSafe(right[b]) for a, b in pairs])


def equi_join(left: DataFrame, right: DataFrame, pairs: list[tuple[str, str]], how: str = "inner", extra: Column | None = None) -> DataFrame:
    """Keys match by equality under the total order, so that null joins null."""
    test = _same(left, right, pairs)
    return left.join(right, test if extra is None else test & extra, how)


def theta_join(left: DataFrame, right: DataFrame, test: Column, how: str = "inner") -> DataFrame:
    return left.join(right, test, how)


def join_using(left: DataFrame, right: DataFrame, columns: list[str], how: str = "inner", suffix: str = "_r") -> DataFrame:
    """USING keeps the key columns of both sides."""
    renamed = right.select(*[F.col(c).alias(c + suffix) if c in columns else F.col(c) for c in right.columns])
    return left.join(renamed, reduce(lambda a, b: a & b, [left[c].eqNullSafe(renamed[c + suffix]) for c in columns]), how)


def semi_in(left: DataFrame, column: str, sub: DataFrame) -> DataFrame:
    """IN (subquery): null is in a list that holds null."""
    key = sub.toDF("_in").distinct()
    return left.join(key, left[column].eqNullSafe(key["_in"]), "left_semi")


def anti_in(left: DataFrame, column: str, sub: DataFrame) -> DataFrame:
    """NOT IN (subquery): two-valued, unlike SQL's."""
    key = sub.toDF("_in").distinct()
    return left.join(key, left[column].eqNullSafe(key["_in"]), "left_anti")


def exists(left: DataFrame, sub: DataFrame, test: Column) -> DataFrame:
    return left.join(sub, test, "left_semi")


def not_exists(left: DataFrame, sub: DataFrame, test: Column) -> DataFrame:
    return left.join(sub, test, "left_anti")


def quantified(left: DataFrame, column: str, op: str, quantifier: str, sub: DataFrame) -> DataFrame:
    """``column op ANY|ALL (subquery)``: ANY of nothing is false, ALL of nothing true.

    Order comparisons need only the least and the greatest value, one row that is
    broadcast; equality goes through semi and anti joins.
    """
    quantifier = quantifier.upper()
    quantifier = "ANY" if quantifier == "SOME" else quantifier
    if (op, quantifier) == ("=", "ANY"):
        return semi_in(left, column, sub)
    if (op, quantifier) == ("<>", "ALL"):
        return anti_in(left, column, sub)
    key = sub.toDF("_v")
    ends = key.agg(F.min("_v").alias("_low"), F.max("_v").alias("_high"), F.count(F.lit(1)).alias("_n"), F.count_if(F.col("_v").isNull()).alias("_nulls"))
    x, n = F.col(column), F.col("_n")
    low = F.when(F.col("_nulls") > 0, None).otherwise(F.col("_low"))  # null is the least value
    one = F.col("_high").eqNullSafe(low)
    tests = {
        (">", "ANY"): (n > 0) & gt(x, low), (">=", "ANY"): (n > 0) & ge(x, low), ("<", "ANY"): (n > 0) & lt(x, F.col("_high")), ("<=", "ANY"): (n > 0) & le(x, F.col("_high")),
        (">", "ALL"): (n == 0) | gt(x, F.col("_high")), (">=", "ALL"): (n == 0) | ge(x, F.col("_high")), ("<", "ALL"): (n == 0) | lt(x, low), ("<=", "ALL"): (n == 0) | le(x, low),
        ("=", "ALL"): (n == 0) | (one & x.eqNullSafe(low)), ("<>", "ANY"): (n > 0) & ~(one & x.eqNullSafe(low)),
    }
    return left.crossJoin(F.broadcast(ends)).where(tests[(op, quantifier)]).select(*[left[c] for c in left.columns])


def scalar_subquery(sub: DataFrame) -> Column:
    """A one-column subquery's value: null if it is empty, an error if it has several rows."""
    return sub.scalar()


# Set operations are positional and take the left names.
def union_all(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.union(b)


def union_distinct(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.union(b).distinct()


def intersect(a: DataFrame, b: DataFrame, every: bool = False) -> DataFrame:
    return a.intersectAll(b) if every else a.intersect(b)


def except_(a: DataFrame, b: DataFrame, every: bool = False) -> DataFrame:
    return a.exceptAll(b) if every else a.subtract(b)


# Limits.
def top(df: DataFrame, n: int, *order: Column) -> DataFrame:
    return df.orderBy(*order).limit(n)


def page(df: DataFrame, offset: int, n: int, *order: Column) -> DataFrame:
    """LIMIT -1 has no end, a negative OFFSET is 0."""
    out = df.orderBy(*order).offset(max(offset, 0))
    return out if n < 0 else out.limit(n)


def keyset_page(df: DataFrame, key: str, after, n: int) -> DataFrame:
    """The next n rows after a key; the filter reaches the scan."""
    return df.where(F.col(key) > F.lit(after)).orderBy(key).limit(n)


class SortKey(NamedTuple):
    """A sort key; null is the least value unless ``nulls_first`` says where it goes."""

    column: Column
    descending: bool = False
    nulls_first: bool | None = None

    def at_first(self) -> bool:
        return not self.descending if self.nulls_first is None else self.nulls_first

    def sort(self, column: Column, reverse: bool = False) -> Column:
        first = self.at_first() != reverse
        if self.descending != reverse:
            return column.desc_nulls_first() if first else column.desc_nulls_last()
        return column.asc_nulls_first() if first else column.asc_nulls_last()

    def before(self, a: Column, b: Column) -> Column:
        nulls = a.isNull() & b.isNotNull() if self.at_first() else a.isNotNull() & b.isNull()
        return nulls | F.coalesce(a > b if self.descending else a < b, F.lit(False))


def with_ties(df: DataFrame, n: int, *order: SortKey | Column) -> DataFrame:
    """The first n rows and all peers of the last; a bare column sorts ascending.

    The n-th key is found with a top-n, which is one row; the rows up to it are a
    filter.  So no window sorts the table in one task.
    """
    keys = [k if isinstance(k, SortKey) else SortKey(k) for k in order]
    names = [f"_k{i}" for i in range(len(keys))]
    edges = [f"_e{i}" for i in range(len(keys))]
    keyed = df.withColumns({c: k.column for c, k in zip(names, keys, strict=True)})
    first = keyed.orderBy(*[k.sort(F.col(c)) for c, k in zip(names, keys, strict=True)]).limit(n).select(*names)
    edge = first.orderBy(*[k.sort(F.col(c), reverse=True) for c, k in zip(names, keys, strict=True)]).limit(1).toDF(*edges)
    before, same = F.lit(False), F.lit(True)
    for c, e, k in zip(names, edges, keys, strict=True):
        before = before | (same & k.before(F.col(c), F.col(e)))
        same = same & F.col(c).eqNullSafe(F.col(e))
    return keyed.crossJoin(F.broadcast(edge)).where(before | same).select(*df.columns)


def rownum(df: DataFrame, *scan_key: Column, name: str = "rownum") -> DataFrame:
    """Rows numbered from 1 in scan order, before any filter.

    The range-sorted rows are written once with their task's number and their
    place in the task, so that the sizes of the tasks and the rows come from the
    same evaluation.  A row's number is its place plus the rows of the tasks
    before; only one row a task meets in one task.
    """
    keys = df.columns
    ordered = df.orderBy(*scan_key) if scan_key else df
    at = ordered.withColumn("_at", F.monotonically_increasing_id())
    split = written(at.select(*keys, F.shiftright("_at", 33).alias("_block"), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)).alias("_place")), "numbered")
    sizes = split.groupBy("_block").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("_block", F.coalesce(F.sum("_n").over(Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return split.join(F.broadcast(before), "_block").select(*keys, (F.col("_before") + F.col("_place") + 1).alias(name))


# Reshaping.
def pivot(df: DataFrame, group: list[str], column: str, values: dict, agg: str, value: str) -> DataFrame:
    """One output column for each listed value; counts of nothing are 0, other aggregates null."""
    done = df.groupBy(*group).pivot(column, list(values)).agg(F.expr(f"{agg}({value})"))
    out = [F.coalesce(F.col(f"`{v}`"), F.lit(0)).alias(a) if agg.lower() == "count" else F.col(f"`{v}`").alias(a) for v, a in values.items()]
    return done.select(*group, *out)


def unpivot(df: DataFrame, keep: list[str], columns: dict[str, str], name: str, value: str) -> DataFrame:
    """A row for each listed column whose cell isn't null."""
    renamed = df.select(*keep, *[F.col(c).alias(a) for c, a in columns.items()])
    return renamed.unpivot(keep, list(columns.values()), name, value).where(F.col(value).isNotNull())


def values(spark: SparkSession, *rows: tuple, names: list[str] | None = None) -> DataFrame:
    """VALUES; columns are called column1.. unless named."""
    width = len(rows[0])
    if any(len(r) != width for r in rows):
        raise ValueError("rows of different width")
    parts = [spark.range(1).select(*[F.lit(v).alias(n) for v, n in zip(r, names or [f"column{i + 1}" for i in range(width)], strict=True)]) for r in rows]
    return reduce(lambda a, b: a.union(b), parts)


def dual(spark: SparkSession) -> DataFrame:
    """One row without columns."""
    return spark.range(1).select()


# Table functions.
def string_split(df: DataFrame, text: str, separator: str, *keep: str, ordinal: bool = False, outer: bool = False) -> DataFrame:
    """A row for each part; the separator is literal.  ``outer`` keeps rows without parts."""
    if not separator:
        raise ValueError("empty separator")
    parts = F.split(F.col(text), "\\Q" + separator + "\\E", -1)
    if ordinal:
        made = df.select(*keep, (F.posexplode_outer if outer else F.posexplode)(parts).alias("_p", "value"))
        return made.select(*keep, "value", (F.col("_p") + 1).cast("bigint").alias("ordinal"))
    return df.select(*keep, (F.explode_outer if outer else F.explode)(parts).alias("value"))


def generate_series(spark: SparkSession, start: int, stop: int, step: int = 1) -> DataFrame:
    """Both ends included; nothing in the wrong direction."""
    if step == 0:
        raise ValueError("step is 0")
    n = max(0, (stop - start) // step + 1)
    if n > 1_000_000:
        raise ValueError("more than 1000000 rows")
    return spark.range(n).select((F.col("id") * step + start).alias("value"))


def series_apply(df: DataFrame, start: Column, stop: Column, *keep: str, step: int = 1, outer: bool = False) -> DataFrame:
    good = start <= stop if step > 0 else start >= stop
    made = F.when(good, F.sequence(start.cast("bigint"), stop.cast("bigint"), F.lit(step).cast("bigint")))
    return df.select(*keep, (F.explode_outer if outer else F.explode)(made).alias("value"))


def union_of_fields(*frames: DataFrame) -> DataFrame:
    """Documents with different fields in one table; absent fields are null, columns in order of name."""
    whole = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    return whole.select(*sorted(whole.columns))
