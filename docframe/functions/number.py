"""Numeric, conditional and conversion functions."""

from __future__ import annotations

import random

from pyspark.sql import Column
from pyspark.sql import functions as F

from .compare import col

abs_, coalesce, ifnull, nvl, nvl2, pi = F.abs, F.coalesce, F.ifnull, F.nvl, F.nvl2, F.pi


def round_(x, digits: int = 0) -> Column:
    """Half away from zero; an integer gives a double."""
    return F.round(col(x).cast("double"), digits)


def mod(a, b) -> Column:
    b = col(b)
    return F.when(b != 0, F.try_mod(col(a), b))


def power(a, b) -> Column:
    return F.pow(col(a), col(b))


def int_power(a, b: int) -> Column:
    """An integer's power stays an integer; overflow is an error."""
    out = F.lit(1).cast("bigint")
    for _ in range(b):
        out = out * col(a).cast("bigint")
    return out


def truncate(x, digits: int = 0) -> Column:
    x = col(x).cast("double")
    scale = F.lit(float(10**digits))
    return F.signum(x) * F.floor(F.abs(x) * scale) / scale


def floor(x) -> Column:
    """Keeps the type: a double stays one."""
    return F.floor(col(x)).cast("double")


def ceiling(x) -> Column:
    return F.ceil(col(x)).cast("double")


def _guard(test, value) -> Column:
    return F.when(test, value)


def sqrt(x) -> Column:
    return _guard(col(x) >= 0, F.sqrt(col(x).cast("double")))


def square(x) -> Column:
    return col(x).cast("double") * col(x).cast("double")


exp, sin, cos, tan, atan, degrees, radians = F.exp, F.sin, F.cos, F.tan, F.atan, F.degrees, F.radians


def cot(x) -> Column:
    return F.try_divide(F.lit(1.0), F.tan(col(x)))


def asin(x) -> Column:
    return _guard(F.abs(col(x)) <= 1, F.asin(col(x)))


def acos(x) -> Column:
    return _guard(F.abs(col(x)) <= 1, F.acos(col(x)))


def atn2(y, x) -> Column:
    return F.atan2(col(y), col(x))


def log(x, base=None) -> Column:
    ln = _guard(col(x) > 0, F.ln(col(x)))
    return ln if base is None else ln / F.ln(col(base))


def log10(x) -> Column:
    return _guard(col(x) > 0, F.log10(col(x)))


def sign(x) -> Column:
    return F.signum(col(x)).cast("bigint")


def rand() -> Column:
    """One value for the whole statement."""
    return F.lit(random.random())


def nullif(a, b) -> Column:
    return F.when(~col(a).eqNullSafe(col(b)), col(a))


def decode(x, *pairs) -> Column:
    """Null matches null; an odd last argument is the default."""
    x, out = col(x), None
    for key, value in zip(pairs[::2], pairs[1::2], strict=False):
        test, value = x.eqNullSafe(F.lit(key)), F.lit(value)
        out = F.when(test, value) if out is None else out.when(test, value)
    return out.otherwise(F.lit(pairs[-1])) if len(pairs) % 2 else out


def _any_null(xs) -> Column:
    out = F.lit(False)
    for x in xs:
        out = out | col(x).isNull()
    return out


def greatest(*xs) -> Column:
    """Null if any argument is."""
    return F.when(~_any_null(xs), F.greatest(*map(col, xs)))


def least(*xs) -> Column:
    return F.when(~_any_null(xs), F.least(*map(col, xs)))


def iif(test, a, b) -> Column:
    return F.when(F.coalesce(test, F.lit(False)), col(a)).otherwise(col(b))


def choose(i, *values) -> Column:
    return F.get(F.array(*map(col, values)), col(i) - 1)


def isnumeric(s) -> Column:
    return F.coalesce(F.trim(col(s)).rlike(r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$"), F.lit(False)).cast("bigint")


def isdate(s) -> Column:
    return F.expr(f"try_cast({s} AS timestamp) IS NOT NULL").cast("bigint") if isinstance(s, str) else col(s).try_cast("timestamp").isNotNull().cast("bigint")


def to_int(x, kind: str) -> Column:
    """CAST to an integer by the source's type: fractions are cut off, timestamps give milliseconds."""
    x = col(x)
    if kind == "timestamp":
        return F.unix_millis(x.cast("timestamp"))
    if kind == "string":
        return F.trim(x).cast("bigint")
    return x.cast("bigint")


def to_bit(s) -> Column:
    return F.lower(F.trim(col(s))).isin("1", "true")


def try_cast(x, kind: str) -> Column:
    return col(x).try_cast(kind)


def value_text(x, kind: str) -> Column:
    """Text as results print it: doubles with a point, timestamps in ISO form."""
    x = col(x)
    if kind == "timestamp":
        return F.date_format(x, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    return x.cast("string")


_STYLES = {0: "MMM d yyyy h:mma", 1: "MM/dd/yy", 2: "yy.MM.dd", 3: "dd/MM/yy", 4: "dd.MM.yy", 5: "dd-MM-yy", 6: "dd MMM yy", 7: "MMM dd, yy", 8: "HH:mm:ss", 10: "MM-dd-yy", 11: "yy/MM/dd", 12: "yyMMdd", 100: "MMM d yyyy h:mma", 101: "MM/dd/yyyy", 102: "yyyy.MM.dd", 103: "dd/MM/yyyy", 104: "dd.MM.yyyy", 105: "dd-MM-yyyy", 106: "dd MMM yyyy", 107: "MMM dd, yyyy", 108: "HH:mm:ss", 110: "MM-dd-yyyy", 111: "yyyy/MM/dd", 112: "yyyyMMdd", 113: "dd MMM yyyy HH:mm:ss:SSS", 114: "HH:mm:ss:SSS", 120: "yyyy-MM-dd HH:mm:ss", 121: "yyyy-MM-dd HH:mm:ss.SSS", 126: "yyyy-MM-dd'T'HH:mm:ss.SSS", 127: "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"}


def convert_date(ts, style: int) -> Column:
    """CONVERT of a timestamp to text; an unknown style is an error."""
    return F.date_format(col(ts), _STYLES[style])


def parse_date(s, style: int) -> Column:
    return F.try_to_timestamp(col(s), F.lit(_STYLES[style]))


def typeof(kind: str) -> str:
    """The type name of a column, from its type at planning time."""
    for prefix, name in (("array", "array"), ("struct", "object"), ("map", "object"), ("decimal", "decimal"), ("timestamp", "timestamp")):
        if kind.startswith(prefix):
            return name
    return {"void": "null", "boolean": "bool", "double": "float", "float": "float", "string": "text", "binary": "blob", "date": "timestamp"}.get(kind, "integer")
