"""Aggregates and grouping sets."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docframe.functions.compare import col


def _when(x: Column, where: Column | None) -> Column:
    return x if where is None else F.when(where, x)


def count_rows(where: Column | None = None) -> Column:
    return F.count(F.lit(1)) if where is None else F.count(F.when(where, F.lit(1)))


def count(x, where: Column | None = None, distinct: bool = False) -> Column:
    x = _when(col(x), where)
    return F.count_distinct(x) if distinct else F.count(x)


def sum_(x, where: Column | None = None, distinct: bool = False) -> Column:
    """Integer overflow gives null."""
    x = _when(col(x), where)
    return F.sum_distinct(x) if distinct else F.try_sum(x)


def avg(x, where: Column | None = None) -> Column:
    return F.avg(_when(col(x), where))


def min_(x, where: Column | None = None) -> Column:
    return F.min(_when(col(x), where))


def max_(x, where: Column | None = None) -> Column:
    return F.max(_when(col(x), where))


def group_concat(x, separator: str = ",", order=None, distinct: bool = False, where: Column | None = None) -> Column:
    """Nulls are left out; all null gives null.  The order is that of ``order`` (then the text)."""
    text = _when(col(x).cast("string"), where)
    if distinct:
        gathered = F.array_sort(F.collect_set(text))
    else:
        pairs = F.collect_list(F.when(text.isNotNull(), F.struct(col(order if order is not None else x).alias("o"), text.alias("t"))))
        gathered = F.transform(F.array_sort(pairs), lambda s: s["t"])
    return F.when(F.size(gathered) > 0, F.array_join(gathered, separator))


def grouping_sets(df: DataFrame, sets: list[list[str]], keys: list[str], *aggregates: Column) -> DataFrame:
    """One pass with Expand; keys left out of a set are null."""
    return df.groupingSets([[F.col(k) for k in s] for s in sets], *[F.col(k) for k in keys]).agg(*aggregates)


def grouping_product(*items: list[list[str]]) -> list[list[str]]:
    """Several grouping items multiply into the sets of their unions."""
    out = [sum(parts, []) for parts in product(*items)]
    if len(out) > 16384:
        raise ValueError("too many grouping sets")
    return out


def rollup_sets(keys: list[str]) -> list[list[str]]:
    return [keys[:i] for i in range(len(keys), -1, -1)]


def cube_sets(keys: list[str]) -> list[list[str]]:
    if len(keys) > 12:
        raise ValueError("CUBE of more than 12 keys")
    return [[k for k, on in zip(keys, bits, strict=True) if on] for bits in product((True, False), repeat=len(keys))]
