"""String functions.  Places count characters from 1; null in gives null out unless noted."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .compare import col

upper, lower, char_length, octet_length = F.upper, F.lower, F.char_length, F.octet_length


def len_(s) -> Column:
    """Length without trailing blanks."""
    return F.char_length(F.rtrim(col(s)))


def locate(sub, s, start=1) -> Column:
    return F.when(col(start) < 1, F.lit(0)).otherwise(F.call_function("locate", col(sub), col(s), col(start)))


def instr(s, sub) -> Column:
    return F.call_function("locate", col(sub), col(s))


def charindex(sub, s, start=1) -> Column:
    return F.call_function("locate", col(sub), col(s), F.greatest(col(start), F.lit(1)))


def substr(s, start, length=None) -> Column:
    """Start 0 is before the text, a negative start counts from the end, a negative length takes what comes before."""
    s, start = col(s), col(start)
    n = F.char_length(s)
    first = F.when(start < 0, n + start + 1).otherwise(start)
    if length is None:
        low, high = F.greatest(first, F.lit(1)), n + 1
    else:
        length = col(length)
        low = F.greatest(F.when(length < 0, first + length).otherwise(first), F.lit(1))
        high = F.when(length < 0, first).otherwise(first + length)
    return F.when(s.isNull() | start.isNull(), None).otherwise(F.substring(s, low, F.greatest(high - low, F.lit(0))))


def left(s, n) -> Column:
    return F.left(col(s), col(n))


def right(s, n) -> Column:
    return F.when(col(n) == 0, F.lit("")).otherwise(F.right(col(s), col(n)))


def trim(s) -> Column:
    """Strips all white space, not blanks alone."""
    return F.regexp_replace(col(s), r"(?U)^\s+|\s+$", "")


def ltrim(s) -> Column:
    return F.regexp_replace(col(s), r"(?U)^\s+", "")


def rtrim(s) -> Column:
    return F.regexp_replace(col(s), r"(?U)\s+$", "")


def trim_set(s, chars: str, side: str = "both") -> Column:
    return {"both": F.btrim, "leading": F.ltrim, "trailing": F.rtrim}[side](col(s), F.lit(chars))


def concat(*parts) -> Column:
    """Null counts as empty."""
    return F.concat(*[F.coalesce(col(p).cast("string"), F.lit("")) for p in parts])


def concat_ws(separator, *parts) -> Column:
    """Null parts are left out; a null separator is empty."""
    return F.call_function("concat_ws", F.coalesce(col(separator), F.lit("")), *[col(p).cast("string") for p in parts])


def replace(s, old, new) -> Column:
    return F.when(col(old) == "", col(s)).otherwise(F.replace(col(s), col(old), col(new)))


def replicate(s, n) -> Column:
    return F.when(col(n) < 0, F.raise_error(F.lit("negative repeat count"))).otherwise(F.repeat(col(s), col(n)))


def reverse(s) -> Column:
    return F.reverse(col(s))


def space(n) -> Column:
    return replicate(F.lit(" "), n)


def str_(x, length: int = 10, decimals: int = 0) -> Column:
    """A number right-aligned; stars if it doesn't fit."""
    text = F.format_string(f"%.{decimals}f", F.round(col(x).cast("decimal(38,10)"), decimals).cast("double"))
    return F.when(F.char_length(text) > length, F.lit("*" * length)).otherwise(F.lpad(text, length, " "))


def quotename(s, delimiter: str = "[") -> Column:
    pairs = {"[": "[]", "]": "[]", "'": "''", '"': '""', "(": "()", ")": "()", "<": "<>", ">": "<>", "{": "{}", "}": "{}", "`": "``"}
    if delimiter not in pairs:
        return F.lit(None).cast("string")
    a, b = pairs[delimiter]
    return F.when(F.char_length(col(s)) <= 128, F.concat(F.lit(a), F.replace(col(s), F.lit(b), F.lit(b * 2)), F.lit(b)))


def ascii_(s) -> Column:
    """The first UTF-8 byte; 0 for an empty text."""
    return F.when(col(s) == "", F.lit(0)).otherwise(F.conv(F.substring(F.hex(F.encode(col(s), "utf-8")), 1, 2), 16, 10).cast("int"))


def char(n) -> Column:
    """A Latin-1 character; null outside 0 to 255."""
    return F.when(col(n).between(0, 255), F.chr(col(n)))


def nchar(n) -> Column:
    return F.decode(F.unhex(F.lpad(F.hex(col(n)), 8, "0")), "utf-32")


def unicode(s) -> Column:
    return F.ascii(col(s))


def translate(s, old: str, new: str) -> Column:
    if len(old) != len(new):
        raise ValueError("translate needs sets of equal length")
    return F.translate(col(s), old, new)


def stuff(s, start, length, insert) -> Column:
    s, start, length = col(s), col(start), col(length)
    n = F.char_length(s)
    whole = F.concat(F.substring(s, F.lit(1), start - 1), F.coalesce(col(insert), F.lit("")), F.substring(s, start + length, n))
    return F.when((start >= 1) & (start <= n) & (length >= 0), whole)


def string_escape(s) -> Column:
    """JSON escapes, the slash among them."""
    steps = (("\\", "\\\\"), ('"', '\\"'), ("/", "\\/"), ("\b", "\\b"), ("\f", "\\f"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"))
    return reduce(lambda c, p: F.replace(c, F.lit(p[0]), F.lit(p[1])), steps, col(s))


def _pad(f, s, n, pad) -> Column:
    return f(col(s), F.greatest(col(n), F.lit(0)), F.when(F.lit(pad) == "", F.lit(" ")).otherwise(F.lit(pad)))


def lpad(s, n, pad: str = " ") -> Column:
    return _pad(F.lpad, s, n, pad)


def rpad(s, n, pad: str = " ") -> Column:
    return _pad(F.rpad, s, n, pad)


def to_char(x) -> Column:
    return col(x).cast("string")


def to_number(s) -> Column:
    return col(s).cast("decimal(38,10)")


_DATE_TOKENS = (("yyyy", "yyyy"), ("MMMM", "MMMM"), ("MMM", "MMM"), ("dddd", "EEEE"), ("ddd", "EEE"), ("tt", "a"), ("yy", "yy"), ("MM", "MM"), ("dd", "dd"), ("HH", "HH"), ("hh", "hh"), ("mm", "mm"), ("ss", "ss"), ("fff", "SSS"), ("ff", "SS"), ("f", "S"), ("M", "M"), ("d", "d"), ("H", "H"), ("h", "h"), ("m", "m"), ("s", "s"), ("y", "y"), ("K", "'Z'"), ("zzz", "'+00:00'"))


def format_date(ts, pattern: str) -> Column:
    out, i = "", 0
    while i < len(pattern):
        for token, spark in _DATE_TOKENS:
            if pattern.startswith(token, i):
                out += spark
                i += len(token)
                break
        else:
            c = pattern[i]
            out += f"'{c}'" if c.isalpha() else "''" if c == "'" else c
            i += 1
    return F.date_format(col(ts), out)


def format_number(x, spec: str) -> Column:
    """The numeric formats C D E F G N P X with an optional precision."""
    kind, digits = spec[0].upper(), spec[1:]
    x = col(x)
    d = int(digits) if digits else 2
    decimal = x.cast("decimal(38,10)")
    if kind == "F":
        return F.format_string(f"%.{d}f", F.round(decimal, d))
    if kind == "N":
        return F.format_number(F.round(decimal, d), d)
    if kind == "C":
        body = F.concat(F.lit("$"), F.format_number(F.round(F.abs(decimal), d), d))
        return F.when(x < 0, F.concat(F.lit("("), body, F.lit(")"))).otherwise(body)
    if kind == "P":
        return F.concat(F.format_number(F.round(decimal * 100, d), d), F.lit("%"))
    if kind == "E":
        e = int(digits) if digits else 6
        raw = F.format_string(f"%.{e}E", x.cast("double"))
        return F.regexp_replace(raw, r"E([+-])(\d\d)$", r"E$10$2")
    if kind == "D":
        n = int(digits) if digits else 1
        return F.concat(F.when(x < 0, F.lit("-")).otherwise(F.lit("")), F.lpad(F.abs(x).cast("string"), F.greatest(F.lit(n), F.char_length(F.abs(x).cast("string"))), F.lit("0")))
    if kind == "X":
        n = int(digits) if digits else 1
        return F.lpad(F.hex(x), F.greatest(F.lit(n), F.char_length(F.hex(x))), F.lit("0"))
    if kind == "G":
        return x.cast("string")
    raise ValueError(f"unknown format {spec}")
