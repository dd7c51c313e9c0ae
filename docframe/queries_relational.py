"""Queries over scans, joins, aggregates, windows, limits, sets and subqueries."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docframe.catalogue import query
from docframe.functions import compare as C
from docframe.operators import grouping as G
from docframe.operators import relational as R
from docframe.operators import windows as X
from docframe.operators.recursive import recursive

# Scans and predicates.
query("scan_count", "SELECT count(*) AS n FROM lineitem")(lambda t: t.lineitem.agg(F.count(F.lit(1)).alias("n")))
query("scan_project", "SELECT o_orderkey, o_totalprice * 2 AS twice FROM orders WHERE o_orderkey < 500")(lambda t: t.orders.where("o_orderkey < 500").select("o_orderkey", (F.col("o_totalprice") * 2).alias("twice")))
query("filter_eq_index", "SELECT o_orderkey FROM orders WHERE o_custkey = 7")(lambda t: t.orders.where("o_custkey = 7").select("o_orderkey"))
query("filter_between", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity BETWEEN 10 AND 12")(lambda t: t.lineitem.where(C.between("l_quantity", F.lit(10), F.lit(12))).select("l_orderkey", "l_linenumber"))
query("filter_not_between", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity NOT BETWEEN 3 AND 48")(lambda t: t.lineitem.where(C.not_between("l_quantity", F.lit(3), F.lit(48))).select("l_orderkey", "l_linenumber"))
query("filter_in", "SELECT p_partkey FROM part WHERE p_size IN (1, 5, 9)")(lambda t: t.part.where(F.col("p_size").isin(1, 5, 9)).select("p_partkey"))
query("filter_in_null", "SELECT e FROM (SELECT event_id AS e, CASE WHEN event_type = 'click' THEN NULL ELSE event_type END AS k FROM events) WHERE k IS NULL OR k = 'view'")(lambda t: t.events.select(F.col("event_id").alias("e"), F.when(F.col("event_type") != "click", F.col("event_type")).alias("k")).where(C.in_list("k", None, "view")).select("e"))
query("like_prefix", "SELECT p_partkey FROM part WHERE p_type LIKE 'S%'")(lambda t: t.part.where(C.like("p_type", "S%")).select("p_partkey"))
query("like_interior", "SELECT doc_id FROM documents WHERE text LIKE '%license%'")(lambda t: t.documents.where(C.like("text", "%license%")).select("doc_id"))
query("like_escape", "SELECT count(*) AS n FROM events WHERE props LIKE '%!%%' ESCAPE '!' OR props LIKE '{_k%'")(lambda t: t.events.where(C.like("props", "%!%%", "!") | C.like("props", "{_k%")).agg(F.count(F.lit(1)).alias("n")))
query("like_class", "SELECT p_partkey FROM part WHERE regexp_matches(p_brand, '^.*[2-4]$') AND NOT regexp_matches(p_brand, '^.*[^0-9].[2]$')")(lambda t: t.part.where(C.like("p_brand", "%[2-4]") & ~C.like("p_brand", "%[^0-9]_2")).select("p_partkey"))
query("ilike", "SELECT c_custkey FROM customer WHERE c_mktsegment ILIKE '%AuTo%'")(lambda t: t.customer.where(C.ilike("c_mktsegment", "%AuTo%")).select("c_custkey"))
query("case_searched", "SELECT s_suppkey, CASE WHEN s_acctbal < 0 THEN 'debt' WHEN s_acctbal < 5000 THEN 'some' ELSE 'rich' END AS class FROM supplier")(lambda t: t.supplier.select("s_suppkey", F.when(F.col("s_acctbal") < 0, "debt").when(F.col("s_acctbal") < 5000, "some").otherwise("rich").alias("class")))
query("case_simple", "SELECT l_returnflag, count(*) AS n FROM (SELECT CASE l_returnflag WHEN 'A' THEN 'x' WHEN 'R' THEN 'y' END AS l_returnflag FROM lineitem) GROUP BY 1")(lambda t: t.lineitem.select(F.when(F.col("l_returnflag") == "A", "x").when(F.col("l_returnflag") == "R", "y").alias("l_returnflag")).groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n")))

_NULLED = "(SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE user_id % 5 END AS a, CASE WHEN event_id % 4 = 0 THEN NULL ELSE user_id % 5 END AS b FROM events)"


def nulled(t):
    u = F.col("user_id") % 5
    return t.events.select("event_id", F.when(F.col("event_id") % 3 != 0, u).alias("a"), F.when(F.col("event_id") % 4 != 0, u).alias("b"))


query("null_safe_eq", f"SELECT event_id FROM {_NULLED} WHERE a IS NOT DISTINCT FROM b")(lambda t: nulled(t).where(C.eq("a", "b")).select("event_id"))
query("is_distinct", f"SELECT event_id FROM {_NULLED} WHERE a IS DISTINCT FROM b")(lambda t: nulled(t).where(C.ne("a", "b")).select("event_id"))
query("total_order_lt", f"SELECT event_id, ((a IS NULL AND b IS NOT NULL) OR coalesce(a < b, false)) AS lt, ((a IS NULL) OR coalesce(a <= b, false)) AS le FROM {_NULLED}")(lambda t: nulled(t).select("event_id", C.lt("a", "b").alias("lt"), C.le("a", "b").alias("le")))
query("is_null", f"SELECT count(*) AS n FROM {_NULLED} WHERE a IS NULL AND b IS NOT NULL")(lambda t: nulled(t).where("a IS NULL AND b IS NOT NULL").agg(F.count(F.lit(1)).alias("n")))
query("arith_int_div", "SELECT o_orderkey, CAST(o_orderkey // nullif(o_custkey % 4, 0) AS BIGINT) AS d, o_orderkey % nullif(o_custkey % 4, 0) AS m FROM orders")(lambda t: t.orders.select("o_orderkey", C.int_divide("o_orderkey", F.col("o_custkey") % 4).alias("d"), C.modulo("o_orderkey", F.col("o_custkey") % 4).alias("m")))
query("arith_overflow", "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN NULL ELSE o_orderkey + 1 END AS v FROM orders")(lambda t: t.orders.select("o_orderkey", C.subtract(C.add(F.when(F.col("o_orderkey") % 2 == 0, F.lit(2**63 - 1)).otherwise(F.col("o_orderkey")), F.lit(1)), F.lit(0)).alias("v")))
query("bitwise", "SELECT o_orderkey, o_orderkey & 12 AS a, o_orderkey | 3 AS b, xor(o_orderkey, 5) AS c, ~o_orderkey AS d FROM orders")(lambda t: t.orders.select("o_orderkey", F.col("o_orderkey").bitwiseAND(12).alias("a"), F.col("o_orderkey").bitwiseOR(3).alias("b"), F.col("o_orderkey").bitwiseXOR(5).alias("c"), F.bitwise_not("o_orderkey").alias("d")))
query("distinct", "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")(lambda t: t.lineitem.select("l_returnflag", "l_linestatus").distinct())
query("fromless", "SELECT 1 AS a, 'x' AS b")(lambda t: t.spark.range(1).select(F.lit(1).alias("a"), F.lit("x").alias("b")))
query("dual", "SELECT 7 AS a")(lambda t: R.dual(t.spark).select(F.lit(7).alias("a")))
query("values_rows", "SELECT * FROM (VALUES (1, 'a'), (2, 'b'), (3, NULL)) v(column1, column2)")(lambda t: R.values(t.spark, (1, "a"), (2, "b"), (3, None)))
query("derived_table", "SELECT k, n FROM (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY 1) WHERE n > 12")(lambda t: t.orders.groupBy(F.col("o_custkey").alias("k")).agg(F.count(F.lit(1)).alias("n")).where("n > 12"))
query("union_of_fields", "SELECT n_nationkey AS id, n_name AS name, NULL::INTEGER AS size FROM nation UNION ALL SELECT CAST(p_partkey AS INTEGER), NULL, p_size FROM part")(lambda t: R.union_of_fields(t.nation.select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name")), t.part.select(F.col("p_partkey").cast("int").alias("id"), F.col("p_size").alias("size"))))

# Joins.
query("join_inner", "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")(lambda t: R.equi_join(t.nation, t.region, [("n_regionkey", "r_regionkey")]).select("n_name", "r_name"))
query("join_composite", "SELECT count(*) AS n FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_suppkey = b.l_suppkey")(lambda t: R.equi_join(t.lineitem, t.lineitem.select(F.col("l_orderkey").alias("k"), F.col("l_suppkey").alias("s")), [("l_orderkey", "k"), ("l_suppkey", "s")]).agg(F.count(F.lit(1)).alias("n")))
_HALF = "(SELECT * FROM orders WHERE o_orderstatus = 'F')"
for _how, _word in (("left", "LEFT"), ("right", "RIGHT"), ("full", "FULL")):
    query(f"join_{_how}", f"SELECT c_custkey, count(o_orderkey) AS n FROM (SELECT * FROM customer WHERE c_acctbal > 0) c {_word} JOIN {_HALF} o ON c_custkey = o_custkey GROUP BY 1")(lambda t, how=_how: R.equi_join(t.customer.where("c_acctbal > 0"), t.orders.where("o_orderstatus = 'F'"), [("c_custkey", "o_custkey")], how).groupBy("c_custkey").agg(F.count("o_orderkey").alias("n")))
query("join_cross", "SELECT r_name, n_name FROM region CROSS JOIN nation")(lambda t: t.region.crossJoin(t.nation).select("r_name", "n_name"))
query("join_comma", "SELECT r_name, n_name FROM region, nation WHERE r_regionkey = n_regionkey AND n_nationkey > 5")(lambda t: t.region.crossJoin(t.nation).where("r_regionkey = n_regionkey AND n_nationkey > 5").select("r_name", "n_name"))
query("join_theta", "SELECT a.s_suppkey AS x, b.n_nationkey AS y FROM supplier a JOIN nation b ON a.s_nationkey < b.n_nationkey AND a.s_acctbal > 0")(lambda t: R.theta_join(t.supplier, t.nation, (F.col("s_nationkey") < F.col("n_nationkey")) & (F.col("s_acctbal") > 0)).select(F.col("s_suppkey").alias("x"), F.col("n_nationkey").alias("y")))
query("join_using", "SELECT a.k, a.n_name, b.k AS k_r, b.r_name FROM (SELECT n_regionkey AS k, n_name FROM nation) a JOIN (SELECT r_regionkey AS k, r_name FROM region) b USING (k)")(lambda t: R.join_using(t.nation.select(F.col("n_regionkey").alias("k"), "n_name"), t.region.select(F.col("r_regionkey").alias("k"), "r_name"), ["k"]))
query("join_self", "SELECT a.n_name AS x, b.n_name AS y FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")(lambda t: t.nation.alias("a").join(t.nation.alias("b"), F.expr("a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")).select(F.col("a.n_name").alias("x"), F.col("b.n_name").alias("y")))
query("join_nullsafe", f"SELECT CAST(sum(x.n * y.n) AS BIGINT) AS n FROM (SELECT a, count(*) AS n FROM {_NULLED} GROUP BY a) x JOIN (SELECT b, count(*) AS n FROM {_NULLED} GROUP BY b) y ON x.a IS NOT DISTINCT FROM y.b")(
    lambda t: R.equi_join(nulled(t).groupBy("a").agg(F.count(F.lit(1)).alias("m")), nulled(t).groupBy("b").agg(F.count(F.lit(1)).alias("k")), [("a", "b")]).agg(F.sum(F.col("m") * F.col("k")).alias("n"))
)
query("join_text_timestamp", "SELECT count(*) AS n FROM orders a JOIN (SELECT DISTINCT strftime(o_orderdate, '%Y-%m-%d') AS d FROM orders WHERE o_totalprice > 200000) b ON a.o_orderdate = CAST(b.d AS TIMESTAMP)")(
    lambda t: t.orders.join(t.orders.where("o_totalprice > 200000").select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("d")).distinct(), F.expr("o_orderdate = try_cast(d AS timestamp_ntz)")).agg(F.count(F.lit(1)).alias("n"))
)


@query("join_chain", """SELECT n_name, count(*) AS n_lines, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
WHERE o_orderstatus = 'F' GROUP BY n_name HAVING count(*) > 10""")
def join_chain(t):
    joined = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    revenue = F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2)
    return joined.where("o_orderstatus = 'F'").groupBy("n_name").agg(F.count(F.lit(1)).alias("n_lines"), revenue.alias("revenue")).where("n_lines > 10")


query("semi_in", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")(lambda t: R.semi_in(t.customer, "c_custkey", t.orders.where("o_totalprice > 300000").select("o_custkey")).select("c_custkey"))
query("semi_in_null", f"SELECT event_id FROM {_NULLED} x WHERE EXISTS (SELECT 1 FROM (SELECT b FROM {_NULLED} WHERE b IS NULL OR b > 2) y WHERE x.a IS NOT DISTINCT FROM y.b)")(lambda t: R.semi_in(nulled(t), "a", nulled(t).where("b IS NULL OR b > 2").select("b")).select("event_id"))
query("semi_exists", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")(lambda t: R.exists(t.customer, t.orders, F.expr("o_custkey = c_custkey AND o_orderstatus = 'P'")).select("c_custkey"))
query("anti_not_in", f"SELECT event_id FROM {_NULLED} x WHERE NOT EXISTS (SELECT 1 FROM (SELECT b FROM {_NULLED} WHERE b IS NULL OR b > 2) y WHERE x.a IS NOT DISTINCT FROM y.b)")(lambda t: R.anti_in(nulled(t), "a", nulled(t).where("b IS NULL OR b > 2").select("b")).select("event_id"))
query("anti_not_exists", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")(lambda t: R.not_exists(t.customer, t.orders, F.expr("o_custkey = c_custkey")).select("c_custkey"))

# Aggregates.
query("agg_basic", "SELECT l_returnflag, count(*) AS n, CAST(sum(l_linenumber) AS BIGINT) AS s, round(avg(l_quantity), 6) AS a, min(l_shipdate) AS lo, max(l_extendedprice) AS hi FROM lineitem GROUP BY 1")(lambda t: t.lineitem.groupBy("l_returnflag").agg(G.count_rows().alias("n"), G.sum_("l_linenumber").alias("s"), F.round(G.avg("l_quantity"), 6).alias("a"), G.min_("l_shipdate").alias("lo"), G.max_("l_extendedprice").alias("hi")))
query("agg_count_null", f"SELECT count(*) AS n, count(a) AS na, count(b) AS nb FROM {_NULLED}")(lambda t: nulled(t).agg(G.count_rows().alias("n"), G.count("a").alias("na"), G.count("b").alias("nb")))
query("agg_empty", "SELECT count(*) AS n, CAST(sum(n_nationkey) AS BIGINT) AS s FROM nation WHERE n_nationkey < 0")(lambda t: t.nation.where("n_nationkey < 0").agg(G.count_rows().alias("n"), G.sum_("n_nationkey").alias("s")))
query("agg_distinct", "SELECT o_orderstatus, count(DISTINCT o_custkey) AS n, CAST(sum(DISTINCT o_custkey) AS BIGINT) AS s FROM orders GROUP BY 1")(lambda t: t.orders.groupBy("o_orderstatus").agg(G.count("o_custkey", distinct=True).alias("n"), G.sum_("o_custkey", distinct=True).alias("s")))
query("agg_filter", "SELECT l_linestatus, count(*) FILTER (WHERE l_quantity > 25) AS n, CAST(sum(l_linenumber) FILTER (WHERE l_returnflag = 'R') AS BIGINT) AS s, count(DISTINCT l_suppkey) FILTER (WHERE l_tax > 0.05) AS d FROM lineitem GROUP BY 1")(lambda t: t.lineitem.groupBy("l_linestatus").agg(G.count_rows(F.col("l_quantity") > 25).alias("n"), G.sum_("l_linenumber", F.col("l_returnflag") == "R").alias("s"), G.count("l_suppkey", F.col("l_tax") > 0.05, distinct=True).alias("d")))
query("agg_string", "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_nationkey) AS names FROM nation GROUP BY 1")(lambda t: t.nation.groupBy("n_regionkey").agg(G.group_concat("n_name", ",", "n_nationkey").alias("names")))
query("agg_string_distinct", "SELECT o_orderstatus, string_agg(DISTINCT o_orderpriority, '|' ORDER BY o_orderpriority) AS p FROM orders GROUP BY 1")(lambda t: t.orders.groupBy("o_orderstatus").agg(G.group_concat("o_orderpriority", "|", distinct=True).alias("p")))
query("agg_having", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) >= 15")(lambda t: t.orders.groupBy("o_custkey").agg(G.count_rows().alias("n")).where("n >= 15"))
query("agg_composite", "SELECT o_custkey, CAST(coalesce(sum(o_orderkey), 0) + 1 AS BIGINT) AS s, count(*) * 2 AS n FROM orders GROUP BY 1")(lambda t: t.orders.groupBy("o_custkey").agg((F.coalesce(G.sum_("o_orderkey"), F.lit(0)) + 1).alias("s"), (G.count_rows() * 2).alias("n")))
query("agg_expression_key", "SELECT year(o_orderdate) AS y, o_custkey % 3 AS k, count(*) AS n FROM orders GROUP BY 1, 2")(lambda t: t.orders.groupBy(F.year("o_orderdate").cast("bigint").alias("y"), (F.col("o_custkey") % 3).alias("k")).agg(G.count_rows().alias("n")))
query("rollup", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")(lambda t: G.grouping_sets(t.lineitem, G.rollup_sets(["l_returnflag", "l_linestatus"]), ["l_returnflag", "l_linestatus"], G.count_rows().alias("n")))
query("cube", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")(lambda t: G.grouping_sets(t.lineitem, G.cube_sets(["l_returnflag", "l_linestatus"]), ["l_returnflag", "l_linestatus"], G.count_rows().alias("n")))
query("grouping_sets", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())")(lambda t: G.grouping_sets(t.orders, [["o_orderstatus"], ["o_orderpriority"], []], ["o_orderstatus", "o_orderpriority"], G.count_rows().alias("n")))
query("grouping_product", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus), ROLLUP (o_orderpriority)")(lambda t: G.grouping_sets(t.orders, G.grouping_product(G.rollup_sets(["o_orderstatus"]), G.rollup_sets(["o_orderpriority"])), ["o_orderstatus", "o_orderpriority"], G.count_rows().alias("n")))
query("grouping_fn", "SELECT l_returnflag, CAST(grouping(l_returnflag) AS INTEGER) AS g, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag)")(lambda t: t.lineitem.rollup("l_returnflag").agg(F.grouping("l_returnflag").cast("int").alias("g"), G.count_rows().alias("n")))
query("pivot_sum", "SELECT l_returnflag, CAST(sum(CASE WHEN l_linestatus = 'O' THEN l_linenumber END) AS BIGINT) AS o, CAST(sum(CASE WHEN l_linestatus = 'F' THEN l_linenumber END) AS BIGINT) AS f FROM lineitem GROUP BY 1")(lambda t: R.pivot(t.lineitem, ["l_returnflag"], "l_linestatus", {"O": "o", "F": "f"}, "sum", "l_linenumber"))
query("pivot_count", "SELECT user_id, count(CASE WHEN event_type = 'click' THEN 1 END) AS clicks, count(CASE WHEN event_type = 'none' THEN 1 END) AS nothing FROM events GROUP BY 1")(lambda t: R.pivot(t.events, ["user_id"], "event_type", {"click": "clicks", "none": "nothing"}, "count", "event_id"))
query("unpivot", "SELECT p_partkey, 'size' AS what, CAST(p_size AS DOUBLE) AS v FROM part UNION ALL SELECT p_partkey, 'price', nullif(p_retailprice, 0) FROM part WHERE p_partkey % 2 = 0")(lambda t: R.unpivot(t.part.select("p_partkey", F.col("p_size").cast("double").alias("p_size"), F.when(F.col("p_partkey") % 2 == 0, F.col("p_retailprice")).alias("p_retailprice")), ["p_partkey"], {"p_size": "size", "p_retailprice": "price"}, "what", "v"))

# Windows.


def _by():
    return W.partitionBy("user_id").orderBy("ts", "event_id")


def _peers():
    return W.partitionBy("user_id").orderBy("event_type")


query("win_rownum", "SELECT event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INTEGER) AS v FROM events")(lambda t: t.events.select("event_id", F.row_number().over(_by()).alias("v")))
query("win_rank", "SELECT event_id, CAST(rank() OVER (PARTITION BY user_id ORDER BY event_type) AS INTEGER) AS v FROM events")(lambda t: t.events.select("event_id", F.rank().over(_peers()).alias("v")))
query("win_dense", "SELECT event_id, CAST(dense_rank() OVER (PARTITION BY user_id ORDER BY event_type) AS INTEGER) AS v FROM events")(lambda t: t.events.select("event_id", F.dense_rank().over(_peers()).alias("v")))
query("win_rank_unordered", "SELECT n_nationkey, CAST(1 AS INTEGER) AS v FROM nation")(lambda t: t.nation.select("n_nationkey", F.rank().over(W.partitionBy("n_regionkey").orderBy(F.lit(1))).alias("v")))
query("win_ntile", "SELECT event_id, CAST(ntile(4) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INTEGER) AS v FROM events")(lambda t: t.events.select("event_id", F.ntile(4).over(_by()).alias("v")))
query("win_lag", "SELECT event_id, lag(value, 2) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS v, CASE WHEN row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) > 1 THEN lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) ELSE -event_id END AS d FROM events")(lambda t: t.events.select("event_id", F.lag("value", 2).over(_by()).alias("v"), X.lag_or("event_id", 1, -F.col("event_id"), _by()).alias("d")))
query("win_lead", "SELECT event_id, lead(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS v FROM events")(lambda t: t.events.select("event_id", F.lead("value").over(_by()).alias("v")))
query("win_first_last", "SELECT event_id, first_value(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS f, last_value(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS l FROM events")(lambda t: t.events.select("event_id", F.first("event_id").over(_by()).alias("f"), F.last("event_id").over(_by().rowsBetween(-1, 1)).alias("l")))
query("win_running", "SELECT event_id, CAST(sum(event_id) OVER (PARTITION BY user_id ORDER BY event_type) AS BIGINT) AS s, count(*) OVER (PARTITION BY user_id) AS n FROM events")(lambda t: t.events.select("event_id", F.sum("event_id").over(_peers()).alias("s"), F.count(F.lit(1)).over(W.partitionBy("user_id")).alias("n")))
query("win_rows", "SELECT event_id, CAST(sum(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS BIGINT) AS v, count(*) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS c FROM events")(lambda t: t.events.select("event_id", F.sum("event_id").over(_by().rowsBetween(-2, 0)).alias("v"), F.count(F.lit(1)).over(_by().rowsBetween(0, W.unboundedFollowing)).alias("c")))
query("win_rows_empty", "SELECT event_id, CAST(sum(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 FOLLOWING AND 3 FOLLOWING) AS BIGINT) AS v, count(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND 2 PRECEDING) AS c FROM events")(lambda t: t.events.select("event_id", F.sum("event_id").over(_by().rowsBetween(2, 3)).alias("v"), F.count("event_id").over(_by().rowsBetween(-3, -2)).alias("c")))
query("win_range_num", "SELECT p_partkey, count(*) OVER (PARTITION BY p_brand ORDER BY p_size RANGE BETWEEN 3 PRECEDING AND 1 FOLLOWING) AS v, count(*) OVER (PARTITION BY p_brand ORDER BY p_size DESC RANGE BETWEEN 2 PRECEDING AND CURRENT ROW) AS d FROM part")(lambda t: t.part.select("p_partkey", F.count(F.lit(1)).over(W.partitionBy("p_brand").orderBy("p_size").rangeBetween(-3, 1)).alias("v"), F.count(F.lit(1)).over(W.partitionBy("p_brand").orderBy(F.col("p_size").desc()).rangeBetween(-2, 0)).alias("d")))
query("win_range_interval", "SELECT event_id, count(*) OVER (PARTITION BY event_type ORDER BY date_trunc('millisecond', ts) RANGE BETWEEN INTERVAL 6 HOUR PRECEDING AND CURRENT ROW) AS v FROM events")(lambda t: X.range_count_ms(t.events, ["event_type"], "ts", 6 * 3600 * 1000, 0, "v").select("event_id", "v"))
query("win_groups", "SELECT p_partkey, CAST(sum(p_partkey) OVER (PARTITION BY p_brand ORDER BY p_size GROUPS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS BIGINT) AS v FROM part")(lambda t: X.groups_frame(t.part, ["p_brand"], F.col("p_size"), -1, 1, "v", lambda w: F.sum("p_partkey").over(w)).select("p_partkey", "v"))
query("win_filter", "SELECT event_id, count(*) FILTER (WHERE event_type = 'click') OVER (PARTITION BY user_id ORDER BY ts, event_id) AS v FROM events")(lambda t: t.events.select("event_id", X.filtered(F.count, F.lit(1), F.col("event_type") == "click", _by()).alias("v")))
query("win_distinct", "SELECT event_id, count(DISTINCT event_type) OVER (PARTITION BY user_id) AS v FROM events")(lambda t: t.events.select("event_id", X.count_distinct(F.col("event_type"), W.partitionBy("user_id")).alias("v")))
query("win_string", "SELECT n_nationkey, string_agg(n_name, '>') OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS v FROM nation")(lambda t: t.nation.select("n_nationkey", F.array_join(F.collect_list("n_name").over(W.partitionBy("n_regionkey").orderBy("n_nationkey")), ">").alias("v")))
query("qualify_top1", "SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) = 1")(lambda t: X.qualify(t.events, F.col("_q_n") == 1, n=F.row_number().over(W.partitionBy("user_id").orderBy(F.col("value").desc(), "event_id"))).select("user_id", "event_id"))

# Order and limits.
query("order_nulls", f"SELECT event_id, row_number() OVER (ORDER BY a ASC NULLS LAST, event_id) AS up, row_number() OVER (ORDER BY a DESC NULLS LAST, event_id DESC) AS down FROM {_NULLED}")(
    lambda t: R.rownum(nulled(t), F.col("a").asc_nulls_last(), F.col("event_id"), name="up").select("event_id", "up").join(R.rownum(nulled(t), F.col("a").desc_nulls_last(), F.col("event_id").desc(), name="down").select("event_id", "down"), "event_id")
)
query("order_default_nulls", f"SELECT event_id, a, row_number() OVER (ORDER BY a NULLS FIRST, event_id) AS n FROM {_NULLED}")(lambda t: R.rownum(nulled(t).select("event_id", "a"), F.col("a"), F.col("event_id"), name="n"))
query("limit_offset", "SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 35")(lambda t: R.page(t.orders.select("o_orderkey", "o_totalprice"), 35, 20, F.col("o_totalprice").desc(), F.col("o_orderkey")).select("o_orderkey"))
query("top_n", "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 15")(lambda t: R.top(t.lineitem.select("l_orderkey", "l_linenumber", "l_extendedprice"), 15, F.col("l_extendedprice").desc(), F.col("l_orderkey"), F.col("l_linenumber")))
query("with_ties", "SELECT p_partkey, p_size FROM part QUALIFY rank() OVER (ORDER BY p_size DESC, p_brand) <= 12")(lambda t: R.with_ties(t.part, 12, R.SortKey(F.col("p_size"), descending=True), F.col("p_brand")).select("p_partkey", "p_size"))
query("keyset_page", "SELECT o_orderkey FROM orders WHERE o_orderkey > 400 ORDER BY o_orderkey LIMIT 20")(lambda t: R.keyset_page(t.orders.select("o_orderkey"), "o_orderkey", 400, 20))
query("with_ties_nulls", f"SELECT event_id, a FROM {_NULLED} QUALIFY rank() OVER (ORDER BY a DESC NULLS FIRST) <= 7 UNION ALL SELECT event_id, a FROM {_NULLED} QUALIFY rank() OVER (ORDER BY a ASC NULLS LAST) <= 7")(
    lambda t: R.with_ties(nulled(t), 7, R.SortKey(F.col("a"), descending=True, nulls_first=True)).select("event_id", "a").union(R.with_ties(nulled(t), 7, R.SortKey(F.col("a"), nulls_first=False)).select("event_id", "a"))
)
query("rownum_lineitem", "SELECT l_orderkey, l_linenumber, row_number() OVER (ORDER BY l_orderkey, l_linenumber) AS rn FROM lineitem")(lambda t: R.rownum(t.lineitem, F.col("l_orderkey"), F.col("l_linenumber"), name="rn").select("l_orderkey", "l_linenumber", "rn"))
query("rownum_before_where", "SELECT c_custkey, rn FROM (SELECT *, row_number() OVER (ORDER BY c_custkey) AS rn FROM customer) WHERE c_nationkey = 3")(lambda t: R.rownum(t.customer, F.col("c_custkey"), name="rn").where("c_nationkey = 3").select("c_custkey", "rn"))

# Sets and subqueries.
_A, _B = "SELECT o_custkey % 50 AS k FROM orders WHERE o_orderstatus = 'F'", "SELECT o_custkey % 70 AS k FROM orders WHERE o_totalprice > 100000"


def _sets(t):
    return t.orders.where("o_orderstatus = 'F'").select((F.col("o_custkey") % 50).alias("k")), t.orders.where("o_totalprice > 100000").select((F.col("o_custkey") % 70).alias("k"))


for _name, _op, _f in (("union_all", "UNION ALL", R.union_all), ("union_distinct", "UNION", R.union_distinct), ("intersect", "INTERSECT", R.intersect), ("intersect_all", "INTERSECT ALL", lambda a, b: R.intersect(a, b, True)), ("except", "EXCEPT", R.except_), ("except_all", "EXCEPT ALL", lambda a, b: R.except_(a, b, True))):
    query(_name, f"{_A} {_op} {_B}")(lambda t, f=_f: f(*_sets(t)))
query("scalar_subquery", "SELECT o_orderkey FROM orders WHERE o_totalprice = (SELECT max(o_totalprice) FROM orders)")(lambda t: t.orders.where(F.col("o_totalprice") == R.scalar_subquery(t.orders.agg(F.max("o_totalprice")))).select("o_orderkey"))
query("corr_scalar", "SELECT o_orderkey FROM orders o WHERE o_totalprice = (SELECT max(o_totalprice) FROM orders i WHERE i.o_custkey = o.o_custkey)")(lambda t: t.orders.join(t.orders.groupBy(F.col("o_custkey").alias("k")).agg(F.max("o_totalprice").alias("m")), F.expr("o_custkey <=> k AND o_totalprice = m")).select("o_orderkey"))
query("corr_exists", "SELECT count(*) AS n FROM lineitem a WHERE EXISTS (SELECT 1 FROM lineitem b WHERE b.l_orderkey = a.l_orderkey AND b.l_linenumber > a.l_linenumber)")(lambda t: t.lineitem.alias("a").join(t.lineitem.alias("b"), F.expr("b.l_orderkey = a.l_orderkey AND b.l_linenumber > a.l_linenumber"), "left_semi").agg(F.count(F.lit(1)).alias("n")))
_Q = "SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000"
for _op, _word in (("<", "lt"), (">", "gt"), ("<=", "le"), (">=", "ge")):
    for _quant in ("ANY", "ALL"):
        query(f"{_quant.lower()}_{_word}", f"SELECT n_nationkey FROM nation WHERE n_nationkey {_op} {_quant} ({_Q})")(lambda t, op=_op, quant=_quant: R.quantified(t.nation, "n_nationkey", op, quant, t.supplier.where("s_acctbal > 5000").select("s_nationkey")).select("n_nationkey"))
query("any_eq", f"SELECT n_nationkey FROM nation WHERE n_nationkey = ANY ({_Q})")(lambda t: R.quantified(t.nation, "n_nationkey", "=", "ANY", t.supplier.where("s_acctbal > 5000").select("s_nationkey")).select("n_nationkey"))
query("all_ne", f"SELECT n_nationkey FROM nation WHERE n_nationkey <> ALL ({_Q})")(lambda t: R.quantified(t.nation, "n_nationkey", "<>", "ALL", t.supplier.where("s_acctbal > 5000").select("s_nationkey")).select("n_nationkey"))
query("all_empty", "SELECT n_nationkey FROM nation")(lambda t: R.quantified(t.nation, "n_nationkey", ">", "ALL", t.supplier.where("s_suppkey < 0").select("s_nationkey")).select("n_nationkey"))


@query("cte_chain", "WITH a AS (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY 1), b AS (SELECT n, count(*) AS m FROM a GROUP BY 1) SELECT n, m FROM b WHERE m > 1")
def cte_chain(t):
    a = t.orders.groupBy(F.col("o_custkey").alias("k")).agg(F.count(F.lit(1)).alias("n"))
    return a.groupBy("n").agg(F.count(F.lit(1)).alias("m")).where("m > 1")


_EDGES = "(SELECT n_nationkey AS a, (n_nationkey * 7 + 3) % 25 AS b FROM nation)"


def _edges(t):
    return t.nation.select(F.col("n_nationkey").alias("a"), ((F.col("n_nationkey") * 7 + 3) % 25).alias("b"))


query("cte_recursive_union", f"WITH RECURSIVE w AS (SELECT 1 AS node UNION SELECT b FROM w JOIN {_EDGES} ON node = a) SELECT node FROM w")(lambda t: recursive(t.spark.range(1).select(F.lit(1).alias("node")), lambda w, e=_edges(t): w.join(e, F.col("node") == F.col("a")).select("b"), distinct=True))
query("cte_recursive_all", f"WITH RECURSIVE w AS (SELECT 1 AS node, 0 AS depth UNION ALL SELECT b, depth + 1 FROM w JOIN {_EDGES} ON node = a WHERE depth < 6) SELECT node, depth FROM w")(lambda t: recursive(t.spark.range(1).select(F.lit(1).alias("node"), F.lit(0).alias("depth")), lambda w, e=_edges(t): w.where("depth < 6").join(e, F.col("node") == F.col("a")).select("b", (F.col("depth") + 1).alias("d"))))

# Table functions.
query("string_split_apply", "SELECT n_nationkey, unnest(string_split(n_name, 'A')) AS value FROM nation")(lambda t: R.string_split(t.nation, "n_name", "A", "n_nationkey"))
query("string_split_ordinal", "SELECT doc_id, value, CAST(i AS BIGINT) AS ordinal FROM (SELECT doc_id, unnest(string_split(text, '. ')) AS value, generate_subscripts(string_split(text, '. '), 1) AS i FROM documents)")(lambda t: R.string_split(t.documents, "text", ". ", "doc_id", ordinal=True))
query("outer_apply", "SELECT n_nationkey, value FROM nation LEFT JOIN LATERAL (SELECT unnest(range(1, CAST(n_regionkey AS BIGINT) + 1)) AS value) ON true")(lambda t: R.series_apply(t.nation, F.lit(1), F.col("n_regionkey"), "n_nationkey", outer=True))
query("cross_apply", "SELECT n_nationkey, unnest(range(1, CAST(n_regionkey AS BIGINT) + 1)) AS value FROM nation")(lambda t: R.series_apply(t.nation, F.lit(1), F.col("n_regionkey"), "n_nationkey"))
query("generate_series", "SELECT value FROM generate_series(3, 40, 4) s(value) UNION ALL SELECT value FROM generate_series(5, -6, -5) s(value)")(lambda t: R.generate_series(t.spark, 3, 40, 4).union(R.generate_series(t.spark, 5, -6, -5)).union(R.generate_series(t.spark, 5, 1)))
