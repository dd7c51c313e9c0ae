"""Queries over changed tables, views, the message log and scripts; all write below an own folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docframe.catalogue import query
from docframe.plans.explain import explain
from docframe.plans.script import Session
from docframe.sources import files
from docframe.sources.scratch import scratch_path
from docframe.sources.store import Database, ForeignKey, Index, Table, Trigger  # noqa: F401
from docframe.streaming.pubsub import Log, windowed_counts


def folder(spark) -> str:
    return scratch_path(spark, "tables")


def database(t) -> Database:
    db = Database(t.spark, folder(t.spark))
    db.create_table_as("customer", t.customer, primary_key="c_custkey")
    return db


_KEPT = "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer"


@query("ctas", "SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal > 1000")
def ctas(t) -> DataFrame:
    db = database(t)
    db.create_table_as("rich", db.read("customer").where("c_acctbal > 1000").select("c_custkey", "c_acctbal"))
    return db.read("rich")


@query("insert_select", f"{_KEPT} UNION ALL SELECT s_suppkey + 1000000, s_name, s_nationkey, s_acctbal, 'NEW' FROM supplier")
def insert_select(t) -> DataFrame:
    db = database(t)
    db.tables["customer"].defaults["c_mktsegment"] = "NEW"
    db.insert("customer", t.supplier.select((F.col("s_suppkey") + 1000000).alias("c_custkey"), F.col("s_name").alias("c_name"), F.col("s_nationkey").alias("c_nationkey"), F.col("s_acctbal").alias("c_acctbal")))
    return db.read("customer")


def _changes(t) -> DataFrame:
    return t.customer.where("c_custkey % 10 = 0").select(F.when(F.col("c_custkey") % 20 == 0, F.col("c_custkey")).otherwise(F.col("c_custkey") + 5000000).alias("c_custkey"), F.lit("new").alias("c_name"), "c_nationkey", F.lit(1.0).alias("c_acctbal"), "c_mktsegment")


_NEW = "(SELECT CASE WHEN c_custkey % 20 = 0 THEN c_custkey ELSE c_custkey + 5000000 END AS c_custkey, 'new' AS c_name, c_nationkey, CAST(1 AS DOUBLE) AS c_acctbal, c_mktsegment FROM customer WHERE c_custkey % 10 = 0)"


@query("insert_ignore", f"{_KEPT} UNION ALL SELECT * FROM {_NEW} WHERE c_custkey > 5000000")
def insert_ignore(t) -> DataFrame:
    db = database(t)
    db.insert("customer", _changes(t), "ignore")
    return db.read("customer")


@query("insert_replace", f"{_KEPT} WHERE c_custkey % 20 <> 0 UNION ALL SELECT * FROM {_NEW}")
def insert_replace(t) -> DataFrame:
    db = database(t)
    db.insert("customer", _changes(t), "replace")
    return db.read("customer")


@query("upsert", f"SELECT c_custkey, c_name, c_nationkey, CASE WHEN c_custkey % 20 = 0 AND c_acctbal > 0 THEN c_acctbal + 1 ELSE c_acctbal END AS c_acctbal, c_mktsegment FROM customer UNION ALL SELECT * FROM {_NEW} WHERE c_custkey > 5000000")
def upsert(t) -> DataFrame:
    db = database(t)
    db.insert("customer", _changes(t), "update", ("c_custkey",), {"c_acctbal": F.col("old.c_acctbal") + F.col("new.c_acctbal")}, F.col("old.c_acctbal") > 0)
    return db.read("customer")


@query("update_where", "SELECT c_custkey, c_name, c_nationkey, CASE WHEN c_nationkey = 3 THEN c_acctbal * 2 ELSE c_acctbal END AS c_acctbal, CASE WHEN c_nationkey = 3 THEN 'X' ELSE c_mktsegment END AS c_mktsegment FROM customer")
def update_where(t) -> DataFrame:
    db = database(t)
    db.update("customer", {"c_acctbal": F.col("c_acctbal") * 2, "c_mktsegment": F.lit("X")}, F.col("c_nationkey") == 3)
    return db.read("customer")


@query("update_from", "SELECT c_custkey, coalesce(n_name, c_name) AS c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey AND n_regionkey = 1")
def update_from(t) -> DataFrame:
    db = database(t)
    db.update("customer", {"c_name": F.col("s.n_name")}, F.expr("t.c_nationkey = s.n_nationkey AND s.n_regionkey = 1"), t.nation, [F.col("s.n_nationkey")])
    return db.read("customer")


@query("update_returning", "SELECT c_custkey, c_acctbal + 1 AS c_acctbal FROM customer WHERE c_nationkey = 5")
def update_returning(t) -> DataFrame:
    return database(t).update("customer", {"c_acctbal": F.col("c_acctbal") + 1}, F.col("c_nationkey") == 5).select("c_custkey", "c_acctbal")


@query("delete_where", f"{_KEPT} WHERE NOT c_acctbal < 500")
def delete_where(t) -> DataFrame:
    db = database(t)
    db.delete("customer", F.col("c_acctbal") < 500)
    return db.read("customer")


@query("delete_using", f"{_KEPT} WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2)")
def delete_using(t) -> DataFrame:
    db = database(t)
    db.delete("customer", F.expr("t.c_nationkey = s.n_nationkey AND s.n_regionkey = 2"), t.nation)
    return db.read("customer")


@query("merge", f"SELECT c.c_custkey, coalesce(s.c_name, c.c_name) AS c_name, c.c_nationkey, c.c_acctbal, c.c_mktsegment FROM customer c LEFT JOIN {_NEW} s USING (c_custkey) UNION ALL SELECT * FROM {_NEW} WHERE c_custkey > 5000000")
def merge(t) -> DataFrame:
    db = database(t)
    db.merge("customer", _changes(t), F.expr("t.c_custkey = s.c_custkey"), {"c_name": F.col("s.c_name")}, {c: F.col(f"s.{c}") for c in t.customer.columns})
    return db.read("customer")


@query("fk_cascade", "SELECT 'nation' AS tbl, count(*) AS n FROM nation WHERE n_regionkey <> 1 UNION ALL SELECT 'customer', count(*) FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey <> 1")
def fk_cascade(t) -> DataFrame:
    db = Database(t.spark, folder(t.spark))
    db.create_table_as("region", t.region, primary_key="r_regionkey")
    db.create_table_as("nation", t.nation, primary_key="n_nationkey", foreign_keys=(ForeignKey("n_regionkey", "region", "r_regionkey", "cascade"),))
    db.create_table_as("customer", t.customer, primary_key="c_custkey", foreign_keys=(ForeignKey("c_nationkey", "nation", "n_nationkey", "cascade"),))
    db.delete("region", F.col("r_regionkey") == 1)
    return db.read("nation").agg(F.count(F.lit(1)).alias("n")).select(F.lit("nation").alias("tbl"), "n").union(db.read("customer").agg(F.count(F.lit(1)).alias("n")).select(F.lit("customer").alias("tbl"), "n"))


@query("fk_set_null", "SELECT n_nationkey, CASE WHEN n_regionkey = 1 THEN NULL WHEN n_regionkey = 2 THEN 12 ELSE n_regionkey END AS n_regionkey FROM nation")
def fk_set_null(t) -> DataFrame:
    db = Database(t.spark, folder(t.spark))
    db.create_table_as("region", t.region, primary_key="r_regionkey")
    db.create_table_as("nation", t.nation, foreign_keys=(ForeignKey("n_regionkey", "region", "r_regionkey", "set null", "cascade"),))
    db.delete("region", F.col("r_regionkey") == 1)
    db.update("region", {"r_regionkey": F.col("r_regionkey") + 10}, F.col("r_regionkey") == 2)
    return db.read("nation").select("n_nationkey", "n_regionkey")


@query("view", "SELECT c_custkey FROM customer WHERE c_acctbal < 0 AND c_nationkey = 1")
def view(t) -> DataFrame:
    db = database(t)
    db.create_view("debtors", lambda: db.read("customer").where("c_acctbal < 0"))
    return db.sql("SELECT c_custkey FROM debtors WHERE c_nationkey = :n", {"n": 1})


@query("matview_refresh", "SELECT c_nationkey, count(*) AS n FROM customer WHERE c_acctbal >= 0 GROUP BY 1")
def matview_refresh(t) -> DataFrame:
    db = database(t)
    db.create_materialized_view("counts", lambda: db.read("customer").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n")))
    db.delete("customer", F.col("c_acctbal") < 0)
    db.refresh("counts")
    return db.read("counts")


@query("transaction", f"{_KEPT} WHERE c_nationkey <> 0")
def transaction(t) -> DataFrame:
    db = database(t)
    db.begin()
    db.delete("customer", F.col("c_nationkey") == 0)
    db.savepoint("a")
    db.delete("customer")
    db.rollback("a")
    db.commit()
    return db.read("customer")


@query("autoincrement", "SELECT CAST(row_number() OVER (ORDER BY r_regionkey) + 10 AS BIGINT) AS id, r_name AS name FROM region UNION ALL SELECT 10, 'first'")
def autoincrement(t) -> DataFrame:
    db = Database(t.spark, folder(t.spark))
    db.create_table("r", "id BIGINT, name STRING", primary_key="id", autoincrement="id")
    db.insert("r", t.spark.range(1).select(F.lit(10).alias("id"), F.lit("first").alias("name")))
    db.insert("r", t.region.orderBy("r_regionkey").select(F.col("r_name").alias("name")))
    return db.read("r")


@query("alter_table", "SELECT r_regionkey, r_name AS title, 7 AS extra FROM region")
def alter_table(t) -> DataFrame:
    db = Database(t.spark, folder(t.spark))
    db.create_table_as("r", t.region)
    db.rename_column("r", "r_name", "title")
    db.add_column("r", "extra", "int", 7, not_null=True)
    db.rename_table("r", "s")
    return db.read("s")


@query("trigger_audit", "SELECT c_custkey, c_acctbal AS before, c_acctbal + 5 AS after FROM customer WHERE c_nationkey = 2")
def trigger_audit(t) -> DataFrame:
    db = database(t)
    db.create_table("audit", "c_custkey BIGINT, before DOUBLE, after DOUBLE")
    db.create_trigger("customer", Trigger("log", "update", "after", lambda d, old, new: d.insert("audit", old.select("c_custkey", F.col("c_acctbal").alias("before")).join(new.select("c_custkey", F.col("c_acctbal").alias("after")), "c_custkey"))))
    db.update("customer", {"c_acctbal": F.col("c_acctbal") + 5}, F.col("c_nationkey") == 2)
    return db.read("audit")


@query("dictionary", "SELECT * FROM (VALUES ('customer', 'c_acctbal', 4, 'ANY'), ('customer', 'c_custkey', 1, 'ANY'), ('customer', 'c_mktsegment', 5, 'ANY'), ('customer', 'c_name', 2, 'ANY'), ('customer', 'c_nationkey', 3, 'ANY')) v(table_name, column_name, ordinal_position, data_type)")
def dictionary(t) -> DataFrame:
    return database(t).schema_columns()


query("dictionary_tables", "SELECT 'customer' AS table_name, 'BASE TABLE' AS table_type")(lambda t: database(t).schema_tables())
query("dictionary_master")(lambda t: database(t).master())


@query("csv_json_sinks", "SELECT n_nationkey, n_name, n_regionkey FROM nation UNION ALL SELECT n_nationkey, n_name, n_regionkey FROM nation")
def csv_json_sinks(t) -> DataFrame:
    root, schema = folder(t.spark), "n_nationkey int, n_name string, n_regionkey int"
    files.write_csv(t.nation, f"{root}/c")
    files.write_json(t.nation, f"{root}/j")
    return files.read_csv(t.spark, f"{root}/c", schema).union(files.read_json(t.spark, f"{root}/j", schema).select("n_nationkey", "n_name", "n_regionkey"))


@query("explain")
def explain_join(t) -> DataFrame:
    return explain(t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).where("o_totalprice > 10").groupBy("c_nationkey").count())


@query("script_loop", "SELECT CAST(55 AS BIGINT) AS total, 'caught' AS state")
def script_loop(t) -> DataFrame:
    s = Session(t.spark)
    s.declare("i", 1)
    s.declare("total", 0)

    def body():
        s.set("total", "@total + @i")
        s.set("i", "@i + 1")

    s.while_("@i <= 10", body)
    state = s.try_(lambda: s.throw("x"), lambda e: "caught")
    return t.spark.range(1).select(F.lit(s.variables["total"]).cast("bigint").alias("total"), F.lit(state).alias("state"))


@query("dialect_top", "SELECT n_name FROM nation ORDER BY n_name LIMIT 3")
def dialect_top(t) -> DataFrame:
    t.nation.createOrReplaceTempView("nation")
    return Session(t.spark).run("SELECT TOP (3) [n_name] FROM nation ORDER BY n_name;")


def _log(t) -> Log:
    log = Log(t.spark, folder(t.spark) + "/log")
    rows = t.events.select(F.concat(F.lit("ev."), "event_type").alias("channel"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ts_ms"), F.col("event_id").cast("string").alias("payload"), F.col("event_id").alias("k"))
    for rest in (0, 1):
        log.publish(rows.where(F.col("k") % 2 == rest), ["k"])
    return log


_LOG = "(SELECT row_number() OVER (ORDER BY event_id % 2, event_id) AS id, 'ev.' || event_type AS channel, (epoch_us(ts) // 1000) AS ts_ms, CAST(event_id AS VARCHAR) AS payload FROM events)"
query("pubsub_replay", f"SELECT id, channel, ts_ms, payload FROM {_LOG} WHERE channel = 'ev.click' AND id > 50")(lambda t: _log(t).replay("ev.click", 50))
query("pubsub_pattern", f"SELECT id, channel, ts_ms, payload FROM {_LOG} WHERE regexp_matches(channel, '^ev\\.[cv].*$')")(lambda t: _log(t).replay(pattern="ev.[cv]*"))
query("pubsub_channels", f"SELECT channel, count(*) AS messages, max(id) AS last_id FROM {_LOG} GROUP BY 1")(lambda t: _log(t).channels())


@query("pubsub_trim", f"SELECT id, channel, ts_ms, payload FROM {_LOG} WHERE id > (SELECT count(*) - 100 FROM events)")
def pubsub_trim(t) -> DataFrame:
    log = _log(t)
    log.trim(keep_rows=100)
    return log.messages()


@query("pubsub_subscribe", f"SELECT id, channel, ts_ms, payload FROM {_LOG} WHERE channel = 'ev.purchase'")
def pubsub_subscribe(t) -> DataFrame:
    """The stream's rows, written by a file sink up to the end of the log."""
    log, out = _log(t), folder(t.spark)
    q = log.subscribe("ev.purchase", files_per_trigger=1).writeStream.format("parquet").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start(f"{out}/rows")
    q.awaitTermination()
    return t.spark.read.schema("id bigint, channel string, ts_ms bigint, payload string").parquet(f"{out}/rows")


query("event_windows", "SELECT time_bucket(INTERVAL 6 HOUR, ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")(lambda t: windowed_counts(t.events, "ts", "6 hours", "event_type").select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n"))
