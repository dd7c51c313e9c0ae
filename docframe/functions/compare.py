"""Comparisons under the total order, in which null is the least value and equals itself."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(x) -> Column:
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(x)


def eq(a, b) -> Column:
    return col(a).eqNullSafe(col(b))


def ne(a, b) -> Column:
    return ~eq(a, b)


def lt(a, b) -> Column:
    a, b = col(a), col(b)
    return (a.isNull() & b.isNotNull()) | F.coalesce(a < b, F.lit(False))


def le(a, b) -> Column:
    return lt(a, b) | eq(a, b)


def gt(a, b) -> Column:
    return lt(b, a)


def ge(a, b) -> Column:
    return le(b, a)


def known(test: Column, *operands) -> Column:
    """A test that is null only for null operands, as false for these; its parts still reach the scan."""
    for x in operands:
        test = col(x).isNotNull() & test
    return test


def between(x, low, high) -> Column:
    """False if any operand is null."""
    return known(col(x).between(col(low), col(high)), x, low, high)


def not_between(x, low, high) -> Column:
    """False, too, if any operand is null."""
    return known((col(x) < col(low)) | (col(x) > col(high)), x, low, high)


def in_list(x, *values) -> Column:
    """Null elements take part by equality."""
    out = F.lit(False)
    for v in values:
        out = out | eq(x, F.lit(v))
    return out


def like_pattern(pattern: str, escape: str | None = None) -> str:
    """A LIKE pattern with % _ and [classes] as an anchored regular expression."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        if escape and c == escape and i + 1 < len(pattern):
            i += 1
            out += re.escape(pattern[i])
        elif c == "%":
            out += ".*"
        elif c == "_":
            out += "."
        elif c == "[" and (end := pattern.find("]", i + 2)) > 0:
            inside = pattern[i + 1 : end]
            negated = inside.startswith("^")
            body = re.sub(r"([\\\[\]&])", r"\\\1", inside[negated:])
            out += f"[{'^' * negated}{body}]"
            i = end
        else:
            out += re.escape(c)
        i += 1
    return f"(?s)^{out}$"


def like(x, pattern: str, escape: str | None = None) -> Column:
    """False for null.  Plain patterns stay LIKE, so that prefixes reach the scan."""
    x = col(x)
    if "[" in pattern:
        return known(x.rlike(like_pattern(pattern, escape)), x)
    test = F.like(x, F.lit(pattern), F.lit(escape)) if escape else x.like(pattern)
    return known(test, x)


def ilike(x, pattern: str) -> Column:
    return known(col(x).ilike(pattern), x)


# Arithmetic: overflow and division by zero give null, integers divide towards zero.
def add(a, b) -> Column:
    return F.try_add(col(a), col(b))


def subtract(a, b) -> Column:
    return F.try_subtract(col(a), col(b))


def multiply(a, b) -> Column:
    return F.try_multiply(col(a), col(b))


def int_divide(a, b) -> Column:
    a, b = col(a).cast("bigint"), F.nullif(col(b).cast("bigint"), F.lit(0).cast("bigint"))
    return F.when((b == -1) & (a == F.lit(-(2**63))), None).otherwise(F.call_function("div", a, b))


def divide(a, b) -> Column:
    return F.try_divide(col(a).cast("double"), col(b).cast("double"))


def modulo(a, b) -> Column:
    b = col(b)
    return F.when(b != 0, F.try_mod(col(a), b))


def truth(x) -> Column:
    """The truth of a number: not zero."""
    return F.coalesce(col(x) != 0, F.lit(False))
