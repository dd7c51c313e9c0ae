"""Queries over the scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from docframe.catalogue import query
from docframe.functions import document as D
from docframe.functions import moment as M
from docframe.functions import number as N
from docframe.functions import text as S


def family(name: str, table: str, key: str, where: str | None = None, **pairs) -> None:
    """One query of many columns: each has a column expression and its SQL."""

    def body(t):
        df = getattr(t, table)
        df = df.where(where) if where else df
        return df.select(key, *[c().alias(n) for n, (c, _) in pairs.items()])

    query(name, f"SELECT {key}, " + ", ".join(f"{s} AS {n}" for n, (_, s) in pairs.items()) + f" FROM {table}" + (f" WHERE {where}" if where else ""))(body)


L = F.lit
family(
    "str_case_length", "documents", "doc_id",
    up=(lambda: S.upper("lang"), "upper(lang)"), low=(lambda: S.lower("text"), "lower(text)"), n=(lambda: S.char_length("text"), "CAST(length(text) AS INTEGER)"), bytes_=(lambda: S.octet_length("text"), "CAST(octet_length(encode(text)) AS INTEGER)"), len_=(lambda: S.len_(F.concat("lang", L("   "))), "CAST(length(lang) AS INTEGER)"),
)
family(
    "str_search", "part", "p_partkey",
    loc=(lambda: S.locate(L("a"), "p_name", 3), "CAST(CASE WHEN instr(substr(p_name, 3), 'a') = 0 THEN 0 ELSE instr(substr(p_name, 3), 'a') + 2 END AS INTEGER)"), pos=(lambda: S.instr("p_name", L("e")), "CAST(instr(p_name, 'e') AS INTEGER)"), chr_=(lambda: S.charindex(L("p"), "p_name", -4), "CAST(instr(p_name, 'p') AS INTEGER)"), position=(lambda: F.position(L("r"), F.col("p_type")), "CAST(position('r' IN p_type) AS INTEGER)"),
)
family(
    "str_substr", "part", "p_partkey",
    a=(lambda: S.substr("p_name", L(0), L(3)), "substr(p_name, 0, 3)"), b=(lambda: S.substr("p_name", L(-4)), "substr(p_name, -4)"), c=(lambda: S.substr("p_name", L(2), L(5)), "substr(p_name, 2, 5)"), d=(lambda: S.substr("p_name", L(4), L(-2)), "substr(p_name, 2, 2)"), e=(lambda: S.left("p_name", L(3)), "left(p_name, 3)"), f=(lambda: S.right("p_name", L(4)), "right(p_name, 4)"),
)
family(
    "str_trim_pad", "nation", "n_nationkey",
    a=(lambda: S.trim(F.concat(L("\t "), "n_name", L(" \n"))), "n_name"), b=(lambda: S.ltrim(F.concat(L("\t "), "n_name", L(" "))), "n_name || ' '"), c=(lambda: S.rtrim(F.concat(L(" "), "n_name", L("\n"))), "' ' || n_name"), d=(lambda: S.trim_set("n_name", "NAT"), "trim(n_name, 'NAT')"), e=(lambda: S.trim_set("n_name", "NAT", "leading"), "ltrim(n_name, 'NAT')"), f=(lambda: S.lpad("n_name", L(12), "*"), "lpad(n_name, 12, '*')"), g=(lambda: S.rpad("n_name", L(4)), "rpad(n_name, 4, ' ')"),
)
family(
    "str_build", "nation", "n_nationkey",
    a=(lambda: S.concat("n_name", F.when(F.col("n_nationkey") > 12, "x"), "n_regionkey"), "concat(n_name, CASE WHEN n_nationkey > 12 THEN 'x' END, n_regionkey)"), b=(lambda: S.concat_ws(L("-"), "n_name", F.when(F.col("n_nationkey") > 12, "x"), "n_regionkey"), "concat_ws('-', n_name, CASE WHEN n_nationkey > 12 THEN 'x' END, n_regionkey)"), c=(lambda: S.replace("n_name", L("A"), L("<>")), "replace(n_name, 'A', '<>')"), d=(lambda: S.replicate("n_name", F.col("n_regionkey")), "repeat(n_name, n_regionkey)"), e=(lambda: S.reverse("n_name"), "reverse(n_name)"), f=(lambda: F.concat(S.space(L(3)), "n_name"), "'   ' || n_name"), g=(lambda: S.stuff("n_name", L(2), L(1), L("--")), "CASE WHEN length(n_name) >= 2 THEN left(n_name, 1) || '--' || substr(n_name, 3) END"), h=(lambda: S.quotename(F.concat("n_name", L("]"))), "'[' || n_name || ']]]'"), i=(lambda: S.translate("n_name", "ANI", "xyz"), "translate(n_name, 'ANI', 'xyz')"),
)
family(
    "str_codes", "nation", "n_nationkey",
    a=(lambda: S.ascii_("n_name"), "CAST(ascii(n_name) AS INTEGER)"), b=(lambda: S.char(F.col("n_nationkey") + 65), "chr(n_nationkey + 65)"), c=(lambda: S.nchar(F.col("n_nationkey") + 960), "chr(n_nationkey + 960)"), d=(lambda: S.unicode(S.nchar(F.col("n_nationkey") + 960)), "n_nationkey + 960"), e=(lambda: S.string_escape(F.concat("n_name", L('/"\n'))), "n_name || '\\/\\\"\\n'"), f=(lambda: S.str_(F.col("n_nationkey") * 1.5, 8, 1), "lpad(format('{:.1f}', n_nationkey * 1.5), 8, ' ')"),
)
family(
    "str_format", "orders", "o_orderkey",
    n=(lambda: S.format_number(F.col("o_orderkey"), "N0"), "format('{:,}', o_orderkey)"), d=(lambda: S.format_number(F.col("o_orderkey"), "D8"), "lpad(CAST(o_orderkey AS VARCHAR), 8, '0')"), x=(lambda: S.format_number(F.col("o_orderkey"), "X6"), "lpad(upper(to_hex(o_orderkey)), 6, '0')"), t=(lambda: S.format_date("o_orderdate", "yyyy/MM/dd HH:mm"), "strftime(o_orderdate, '%Y/%m/%d %H:%M')"), m=(lambda: S.format_date("o_orderdate", "dddd, MMMM d"), "strftime(o_orderdate, '%A, %B %-d')"),
)
family(
    "num_round", "lineitem", "l_orderkey", "l_linenumber = 1",
    a=(lambda: N.round_("l_orderkey", -1), "round(CAST(l_orderkey AS DOUBLE), -1)"), b=(lambda: N.truncate(F.col("l_quantity") / 8, 2), "CASE WHEN l_quantity < 0 THEN -1.0 ELSE 1.0 END * floor(abs(l_quantity / 8) * 100.0) / 100.0"), c=(lambda: N.floor(F.col("l_quantity") / 3), "floor(l_quantity / 3)"), d=(lambda: N.ceiling(F.col("l_quantity") / 3), "ceil(l_quantity / 3)"), e=(lambda: N.sign(F.col("l_linenumber") - 1), "CAST(sign(l_linenumber - 1) AS BIGINT)"), f=(lambda: N.abs_(F.col("l_orderkey") - 30000), "abs(l_orderkey - 30000)"), g=(lambda: N.mod(F.col("l_orderkey"), F.col("l_suppkey") % 3), "l_orderkey % nullif(l_suppkey % 3, 0)"), h=(lambda: N.int_power(F.col("l_suppkey"), 3), "l_suppkey * l_suppkey * l_suppkey"), i=(lambda: N.square("l_quantity"), "l_quantity * l_quantity"),
)
R6 = lambda f: (lambda: F.round(f(), 6))
family(
    "num_math", "part", "p_partkey",
    a=(R6(lambda: N.sqrt(F.col("p_size") - 10)), "round(CASE WHEN p_size >= 10 THEN sqrt(p_size - 10) END, 6)"), b=(R6(lambda: N.log(F.col("p_size") - 10)), "round(CASE WHEN p_size > 10 THEN ln(p_size - 10) END, 6)"), c=(R6(lambda: N.log(F.col("p_size"), L(2.0))), "round(ln(p_size) / ln(2.0), 6)"), d=(R6(lambda: N.log10("p_size")), "round(log10(p_size), 6)"), e=(R6(lambda: N.asin(F.col("p_size") / 25)), "round(CASE WHEN p_size <= 25 THEN asin(p_size / 25) END, 6)"), f=(R6(lambda: N.acos(F.col("p_size") / 25)), "round(CASE WHEN p_size <= 25 THEN acos(p_size / 25) END, 6)"), g=(R6(lambda: F.sin("p_size") + F.cos("p_size") + N.atan("p_size")), "round(sin(p_size) + cos(p_size) + atan(p_size), 6)"), h=(R6(lambda: N.atn2(F.col("p_size").cast("double"), L(3.0))), "round(atan2(p_size, 3.0), 6)"), i=(R6(lambda: N.degrees("p_size") + N.radians("p_size")), "round(degrees(p_size) + radians(p_size), 6)"), j=(R6(lambda: N.exp(F.col("p_size") / 50) + N.pi()), "round(exp(p_size / 50) + pi(), 6)"), k=(R6(lambda: N.cot(F.col("p_size") * 1.0)), "round(1.0 / tan(p_size), 6)"), l=(R6(lambda: N.tan("p_size")), "round(tan(p_size), 6)"), m=(R6(lambda: N.power(F.col("p_size"), L(1.5))), "round(power(p_size, 1.5), 6)"),
)
_EVEN = "CASE WHEN o_orderkey % 2 = 0 THEN o_custkey END"
even = lambda: F.when(F.col("o_orderkey") % 2 == 0, F.col("o_custkey"))
family(
    "cond_null", "orders", "o_orderkey",
    a=(lambda: N.coalesce(even(), L(-1)), f"coalesce({_EVEN}, -1)"), b=(lambda: N.nullif(even(), L(7)), f"nullif({_EVEN}, 7)"), c=(lambda: N.nvl2(even(), L("some"), L("none")), f"CASE WHEN {_EVEN} IS NOT NULL THEN 'some' ELSE 'none' END"), d=(lambda: N.greatest(even(), F.col("o_orderkey")), f"CASE WHEN {_EVEN} IS NOT NULL THEN greatest({_EVEN}, o_orderkey) END"), e=(lambda: N.least(even(), F.col("o_orderkey")), f"CASE WHEN {_EVEN} IS NOT NULL THEN least({_EVEN}, o_orderkey) END"), f=(lambda: N.decode(even() % 3, None, "null", 0, "zero", 1, "one", "more"), f"CASE WHEN {_EVEN} IS NULL THEN 'null' WHEN {_EVEN} % 3 = 0 THEN 'zero' WHEN {_EVEN} % 3 = 1 THEN 'one' ELSE 'more' END"), g=(lambda: N.iif(even() > 50, L(1), L(0)), f"CASE WHEN {_EVEN} > 50 THEN 1 ELSE 0 END"), h=(lambda: N.choose((F.col("o_orderkey") % 5).cast("int"), L("a"), L("b"), L("c")), "CASE o_orderkey % 5 WHEN 1 THEN 'a' WHEN 2 THEN 'b' WHEN 3 THEN 'c' END"),
)
family(
    "cast_convert", "orders", "o_orderkey",
    a=(lambda: N.to_int(F.col("o_totalprice"), "double"), "CAST(trunc(o_totalprice) AS BIGINT)"), b=(lambda: N.to_int("o_orderdate", "timestamp"), "(epoch_us(o_orderdate) // 1000)"), c=(lambda: N.to_bit(F.when(F.col("o_orderkey") % 2 == 0, "TRUE").otherwise("0")), "o_orderkey % 2 = 0"), d=(lambda: N.try_cast(F.when(F.col("o_orderkey") % 3 == 0, "12").otherwise("1x"), "int"), "TRY_CAST(CASE WHEN o_orderkey % 3 = 0 THEN '12' ELSE '1x' END AS INTEGER)"), e=(lambda: N.isnumeric(F.when(F.col("o_orderkey") % 3 == 0, " -1.5e3 ").otherwise("1.5.")), "CAST(o_orderkey % 3 = 0 AS BIGINT)"), f=(lambda: N.isdate(F.when(F.col("o_orderkey") % 3 == 0, "2024-02-29").otherwise("2023-02-29")), "CAST(o_orderkey % 3 = 0 AS BIGINT)"), g=(lambda: N.convert_date("o_orderdate", 112), "strftime(o_orderdate, '%Y%m%d')"), h=(lambda: N.convert_date("o_orderdate", 103), "strftime(o_orderdate, '%d/%m/%Y')"), i=(lambda: N.convert_date("o_orderdate", 126), "strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.%g')"), j=(lambda: N.value_text("o_orderdate", "timestamp"), "strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.%gZ')"), k=(lambda: N.parse_date(N.convert_date("o_orderdate", 104), 104).cast("timestamp_ntz"), "date_trunc('day', o_orderdate)::TIMESTAMP"), l=(lambda: S.to_char("o_orderkey"), "CAST(o_orderkey AS VARCHAR)"), m=(lambda: S.to_number(S.to_char("o_orderkey")).cast("bigint"), "o_orderkey"),
)
_SUN = "CAST(floor((epoch(date_trunc('day', {0})) / 86400 + 4) / 7) AS BIGINT)"
_D2 = "(ts + INTERVAL 40 DAY + INTERVAL 5 HOUR)"
family(
    "dt_datediff", "events", "event_id",
    **{p: ((lambda p=p: M.datediff(p, "ts", F.timestamp_add("HOUR", L(965), F.col("ts")))), s) for p, s in {
        "year": f"date_diff('year', ts, {_D2})", "quarter": f"date_diff('quarter', ts, {_D2})", "month": f"date_diff('month', ts, {_D2})", "day": f"date_diff('day', ts, {_D2})", "hour": f"date_diff('hour', ts, {_D2})", "minute": f"date_diff('minute', ts, {_D2})", "second": f"date_diff('second', ts, {_D2})", "mcs": f"date_diff('microsecond', ts, {_D2})", "ns": f"date_diff('microsecond', ts, {_D2}) * 1000", "week": f"{_SUN.format(_D2)} - {_SUN.format('ts')}",
    }.items()},
)
family(
    "dt_datepart", "events", "event_id",
    **{p: ((lambda p=p: M.datepart(p, "ts")), s) for p, s in {
        "year": "year(ts)", "quarter": "quarter(ts)", "month": "month(ts)", "dayofyear": "dayofyear(ts)", "day": "day(ts)", "hour": "hour(ts)", "minute": "minute(ts)", "second": "second(ts)", "weekday": "dayofweek(ts) + 1", "week": "CAST(floor((dayofyear(ts) - 1 + dayofweek(date_trunc('year', ts))) / 7) + 1 AS BIGINT)", "millisecond": "millisecond(ts) % 1000", "mcs": "microsecond(ts) % 1000000", "ns": "microsecond(ts) % 1000000 * 1000", "yy": "year(ts)", "dy": "dayofyear(ts)",
    }.items()},
)
family(
    "dt_shift", "events", "event_id",
    a=(lambda: M.dateadd("month", L(1), F.col("ts")), "ts + INTERVAL 1 MONTH"), b=(lambda: M.dateadd("day", F.col("user_id") % 9, F.col("ts")), "ts + to_days(CAST(user_id % 9 AS INTEGER))"), c=(lambda: M.eomonth("ts", 1), "CAST(last_day(ts + INTERVAL 1 MONTH) AS TIMESTAMP)"), d=(lambda: M.to_date("ts"), "CAST(date_trunc('day', ts) AS TIMESTAMP)"), e=(lambda: M.datename("month", "ts"), "monthname(ts)"), f=(lambda: M.datename("weekday", "ts"), "dayname(ts)"), g=(lambda: M.from_parts(L(2024), F.month("ts"), L(5), F.hour("ts"), L(7), L(9)), "make_timestamp(2024, month(ts), 5, hour(ts), 7, 9.0)"), h=(lambda: M.ms_between("ts", L("2024-01-01").cast("timestamp_ntz")), "(epoch_us(ts) // 1000) - (epoch_us(TIMESTAMP '2024-01-01') // 1000)"), i=(lambda: M.shift_ms("ts", 1500), "make_timestamp((epoch_us(ts) // 1000) * 1000 + 1500000)"), j=(lambda: M.smalldatetime(L(2024), L(1), L(31), L(23), L(59), F.second("ts")), "TIMESTAMP '2024-01-31 23:59:00' + CASE WHEN second(ts) >= 30 THEN INTERVAL 1 MINUTE ELSE INTERVAL 0 MINUTE END"),
)
family(
    "json_scalar", "events", "event_id",
    a=(lambda: D.json_extract("props", "$.k"), "json_extract_string(props, '$.k')"), b=(lambda: D.json_int("props", "$.k") + 1, "CAST(json_extract_string(props, '$.k') AS BIGINT) + 1"), c=(lambda: D.json_type("props", "$.k"), "CASE WHEN json_extract_string(props, '$.k') IS NULL THEN NULL ELSE 'integer' END"), d=(lambda: D.json_valid(F.concat("props", F.when(F.col("event_id") % 2 == 0, "").otherwise("{"))), "json_valid(props || CASE WHEN event_id % 2 = 0 THEN '' ELSE '{' END)"), e=(lambda: D.json_array_contains(F.format_string("[%d, 5]", F.col("user_id") % 4), 2), "user_id % 4 = 2"), f=(lambda: D.json_extract("props", "$.missing"), "json_extract_string(props, '$.missing')"),
)
query("openjson", "SELECT event_id, 'k' AS key, json_extract_string(props, '$.k') AS value, CAST(2 AS BIGINT) AS type FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL")(lambda t: D.openjson(t.events, "props", "event_id"))
query("openjson_array", "SELECT event_id, CAST(i AS VARCHAR) AS key, CASE i WHEN 0 THEN CAST(user_id AS VARCHAR) ELSE event_type END AS value, CAST(CASE i WHEN 0 THEN 2 ELSE 1 END AS BIGINT) AS type FROM events, (VALUES (0), (1)) v(i)")(lambda t: D.openjson(t.events.withColumn("doc", F.format_string('[%d, "%s"]', "user_id", "event_type")), "doc", "event_id"))
family(
    "hash_bytes", "part", "p_partkey",
    a=(lambda: F.lower(F.hex(D.hashbytes("MD5", "p_name"))), "md5(p_name)"), b=(lambda: F.lower(F.hex(D.hashbytes("SHA1", "p_name"))), "sha1(p_name)"), c=(lambda: F.lower(F.hex(D.hashbytes("SHA2_256", "p_name"))), "sha256(p_name)"),
)
# FNV-1a in 128-bit integers over the bytes of the literals; the names are ASCII.
_FNV = (
    "list_reduce(list_prepend(14695981039346656037::UHUGEINT, list_transform(string_split({0}, ''), lambda c: CAST(ascii(c) AS UHUGEINT))),"
    " lambda a, b: (xor(a, b) * 1099511628211::UHUGEINT) % 18446744073709551616::UHUGEINT)"
)
_NAMED = "'''' || replace(n_name, '''', '''''') || '''' || chr(31) || CAST(n_regionkey AS VARCHAR) || chr(31) || 'NULL' || chr(31)"
query(
    "hash_checksum",
    f"SELECT n_nationkey, CAST(CASE WHEN h >= 9223372036854775808 THEN CAST(h AS HUGEINT) - 18446744073709551616 ELSE CAST(h AS HUGEINT) END AS BIGINT) AS v FROM (SELECT n_nationkey, {_FNV.format(_NAMED)} AS h FROM nation)",
)(lambda t: t.nation.select("n_nationkey", D.checksum("n_name", "n_regionkey", F.lit(None).cast("string")).alias("v")))
query("newid", "SELECT count(*) AS n, true AS ok FROM nation")(lambda t: t.nation.select(D.newid().alias("u")).agg(F.count_distinct("u").alias("n"), F.bool_and(F.col("u").rlike("^[0-9a-f]{8}-[0-9a-f]{4}-7[0-9a-f]{3}-a[0-9a-f]{3}-[0-9a-f]{12}$")).alias("ok")))
query("typeof", "SELECT 'integer' AS a, 'text' AS b, 'float' AS c, 'timestamp' AS d")(lambda t: t.spark.range(1).select(*[F.lit(N.typeof(dict(t.orders.dtypes)[c])).alias(n) for n, c in (("a", "o_orderkey"), ("b", "o_orderstatus"), ("c", "o_totalprice"), ("d", "o_orderdate"))]))
query("rand_per_statement", "SELECT 1 AS n")(lambda t: t.nation.select(N.rand().alias("r")).agg(F.count_distinct("r").cast("int").alias("n")))
query("now_per_statement", "SELECT 1 AS n")(lambda t: t.nation.select(M.now().alias("r")).agg(F.count_distinct("r").cast("int").alias("n")))
