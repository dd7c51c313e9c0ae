"""JSON, hashes and identity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .compare import col


def json_extract(doc, path: str) -> Column:
    """The value at a path as text; null for bad JSON and for absent paths."""
    return F.get_json_object(col(doc), path)


def json_int(doc, path: str) -> Column:
    return F.try_variant_get(F.try_parse_json(col(doc)), path, "bigint")


def json_type(doc, path: str = "$") -> Column:
    value = F.try_variant_get(F.try_parse_json(col(doc)), path, "variant")
    kind = F.schema_of_variant(value)
    return (
        F.when(kind == "VOID", "null").when(kind == "BOOLEAN", "boolean").when(kind == "BIGINT", "integer")
        .when(kind.startswith("DECIMAL") | (kind == "DOUBLE"), "real").when(kind == "STRING", "text")
        .when(kind.startswith("ARRAY"), "array").when(kind.startswith("OBJECT"), "object")
    )


def json_valid(doc) -> Column:
    """One value and nothing behind it; the parser alone would stop after the first value."""
    whole = F.try_parse_json(F.concat(F.lit("["), col(doc), F.lit("]")))
    first, second = (F.try_variant_get(whole, f"$[{i}]", "variant") for i in (0, 1))
    return F.coalesce(first.isNotNull() & second.isNull(), F.lit(False))


def json_array_contains(doc, value, kind: str = "bigint") -> Column:
    """False for what is no array; null for null."""
    return F.when(col(doc).isNotNull(), F.coalesce(F.array_contains(F.from_json(col(doc), f"array<{kind}>"), value), F.lit(False)))


def openjson(df: DataFrame, doc: str, *keep: str, outer: bool = False) -> DataFrame:
    """A row (key, value, type) for each member of an object, or element of an array with its place."""
    raw = F.col(doc)
    is_array = F.ltrim(raw).startswith("[")
    pairs = F.when(
        is_array,
        F.transform(F.from_json(raw, "array<string>"), lambda v, i: F.struct(i.cast("string").alias("key"), v.alias("value"))),
    ).otherwise(F.transform(F.map_entries(F.from_json(raw, "map<string,string>")), lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value"))))
    rows = df.select(*keep, raw.alias("_doc"), (F.explode_outer if outer else F.explode)(pairs).alias("e"))
    path = F.when(F.ltrim("_doc").startswith("["), F.concat(F.lit("$["), F.col("e.key"), F.lit("]"))).otherwise(F.concat(F.lit("$['"), F.col("e.key"), F.lit("']")))
    inner = F.schema_of_variant(F.try_variant_get(F.try_parse_json("_doc"), path, "variant"))
    code = F.when(F.col("e.key").isNull(), None).when(inner == "VOID", 0).when(inner == "STRING", 1).when(inner == "BOOLEAN", 3).when(inner.startswith("ARRAY"), 4).when(inner.startswith("OBJECT"), 5).otherwise(2)
    return rows.select(*keep, F.col("e.key").alias("key"), F.col("e.value").alias("value"), code.cast("bigint").alias("type"))


def hashbytes(algorithm: str, x) -> Column:
    x = col(x).cast("string").cast("binary")
    return F.unhex({"MD5": F.md5, "SHA": F.sha1, "SHA1": F.sha1, "SHA2_256": lambda c: F.sha2(c, 256)}[algorithm](x))


def _literal(x) -> Column:
    """A text or integer as SQL spells it."""
    x = col(x)
    text = F.concat(F.lit("'"), F.replace(x.cast("string"), F.lit("'"), F.lit("''")), F.lit("'"))
    return F.coalesce(F.when(F.typeof(x) == "string", text).when(F.typeof(x) == "boolean", F.upper(x.cast("string"))).otherwise(x.cast("string")), F.lit("NULL"))


def checksum(*values) -> Column:
    """64-bit FNV-1a over the SQL literals of texts, integers and booleans, each followed by the unit separator.

    The state is kept in two halves of 32 bits, so that no product overflows.
    """
    if not values:
        raise ValueError("checksum needs an argument")
    whole = F.concat(*[part for v in values for part in (_literal(v), F.lit("\x1f"))])
    codes = F.transform(F.regexp_extract_all(F.hex(F.encode(whole, "utf-8")), F.lit(".."), F.lit(0)), lambda h: F.conv(h, 16, 10).cast("bigint"))
    # Fixed values of the hash: its offset basis and its prime, 2**40 + 0x1B3.
    basis, high_prime, low_prime, low_bits = 0xCBF29CE484222325, 0x100, 0x1B3, 0xFFFFFFFF
    number = lambda n: F.lit(n).cast("bigint")
    start = F.struct(number(basis >> 32).alias("hi"), number(basis & low_bits).alias("lo"))

    def step(h: Column, byte: Column) -> Column:
        lo = h["lo"].bitwiseXOR(byte)
        carry = F.shiftright(lo * number(low_prime), 32)
        hi = h["hi"] * number(low_prime) + lo * number(high_prime) + carry
        return F.struct(hi.bitwiseAND(number(low_bits)).alias("hi"), (lo * number(low_prime)).bitwiseAND(number(low_bits)).alias("lo"))

    return F.aggregate(codes, start, step, lambda h: F.shiftleft(h["hi"], 32).bitwiseOR(h["lo"]))


def newid() -> Column:
    """A time-ordered identifier (version 7): milliseconds, then random bits."""
    ms = F.lpad(F.hex(F.unix_millis(F.current_timestamp())), 12, "0")
    noise = F.replace(F.uuid(), F.lit("-"), F.lit(""))
    return F.lower(F.concat(F.substring(ms, 1, 8), F.lit("-"), F.substring(ms, 9, 4), F.lit("-7"), F.substring(noise, 1, 3), F.lit("-a"), F.substring(noise, 4, 3), F.lit("-"), F.substring(noise, 7, 12)))
