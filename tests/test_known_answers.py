"""Known answers on small tables, and what must be refused."""

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docframe.functions import compare as C
from docframe.functions import document as D
from docframe.functions import moment as M
from docframe.functions import text as S
from docframe.operators import grouping as G
from docframe.operators import relational as R
from docframe.operators import windows as X
from docframe.operators.recursive import recursive
from docframe.plans.script import Session, rewrite
from docframe.sources.store import ConstraintError, Database, ForeignKey, Index
from docframe.streaming.pubsub import Log


@pytest.fixture
def employees(spark):
    return spark.createDataFrame([(1, "a", "x", 30), (2, "a", "y", 20), (3, "a", "z", 20), (4, "b", "p", 10), (5, "b", "q", 40)], "id long, dept string, name string, salary long")


def values(df, column, *order):
    return [r[column] for r in df.orderBy(*order).collect()]


@pytest.mark.parametrize(("frame", "expected"), [((-1, 0), [10, 30, 40, 50, 70]), ((W.unboundedPreceding, 0), [10, 30, 50, 80, 120]), ((0, W.unboundedFollowing), [120, 110, 90, 70, 40]), ((2, 3), [50, 70, 40, None, None])])
def test_rows_frames(employees, frame, expected):
    w = W.orderBy("salary", "name").rowsBetween(*frame)
    assert values(employees.withColumn("v", F.sum("salary").over(w)), "v", "salary", "name") == expected


@pytest.mark.parametrize(("frame", "expected"), [((-1, 1), [50, 80, 80, 110, 70]), ((0, 1), [50, 70, 70, 70, 40])])
def test_groups_frames(employees, frame, expected):
    df = X.groups_frame(employees.withColumn("all", F.lit(1)), ["all"], F.col("salary"), *frame, "v", lambda w: F.sum("salary").over(w))
    assert values(df, "v", "salary", "name") == expected


def test_grouping_sets(spark):
    t = spark.createDataFrame([("a", "x", 1), ("a", "y", 2), ("b", "x", 3), ("b", "x", 4)], "g string, h string, v long")
    got = {tuple(r) for r in G.grouping_sets(t, [["g"], ["h"]], ["g", "h"], G.sum_("v").alias("s")).collect()}
    assert got == {(None, "x", 8), (None, "y", 2), ("a", None, 3), ("b", None, 7)}
    assert len(G.grouping_sets(t, G.cube_sets(["g", "h"]), ["g", "h"], G.sum_("v").alias("s")).collect()) == 8


def test_ties_and_quantifiers(spark):
    t = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), ("b", 4), ("b", 5)], "g string, v long")
    assert values(R.with_ties(t, 1, F.col("g")), "v", "v") == [1, 2]
    few, none = t.where("v >= 4").select("v"), t.where("v > 9").select("v")
    assert values(R.quantified(t, "v", ">", "ANY", few), "v", "v") == [5]
    assert values(R.quantified(t, "v", "<>", "ALL", few), "v", "v") == [1, 2, 3]
    assert R.quantified(t, "v", ">", "ANY", none).count() == 0 and R.quantified(t, "v", ">", "ALL", none).count() == 5


def test_null_order(spark):
    t = spark.createDataFrame([(None, None), (None, 1), (1, None), (1, 2)], "a int, b int")
    got = [tuple(r) for r in t.select(C.eq("a", "b"), C.lt("a", "b"), C.ge("a", "b"), C.between("a", F.lit(0), "b")).collect()]
    assert got == [(True, False, True, False), (False, True, False, False), (False, False, True, False), (False, True, False, True)]


def test_arithmetic(spark):
    t = spark.createDataFrame([(7, 2), (-7, 2), (7, 0), (2**63 - 1, 1)], "a long, b long")
    assert [tuple(r) for r in t.select(C.int_divide("a", "b"), C.modulo("a", "b"), C.add("a", "b")).collect()] == [(3, 1, 9), (-3, -1, -5), (None, None, 7), (2**63 - 1, 0, None)]


def test_like_classes_and_text(spark):
    t = spark.createDataFrame([("a1",), ("b2",), ("^x",), (None,)], "s string")
    assert values(t.where(C.like("s", "[a-b]_")), "s", "s") == ["a1", "b2"] and values(t.where(C.like("s", "[^a-z]%")), "s", "s") == ["^x"]
    row = spark.range(1).select(S.substr(F.lit("abcde"), 0, 2), S.substr(F.lit("abc"), -5, 3), S.quotename(F.lit("a]b")), S.stuff(F.lit("abc"), F.lit(9), F.lit(1), F.lit("x")), S.str_(F.lit(1234.5), 3), S.format_number(F.lit(-5.5), "C2"), S.format_number(F.lit(0.256), "P1")).first()
    assert tuple(row) == ("a", "a", "[a]]b]", None, "***", "($5.50)", "25.6%")


def test_recursion(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (2, 1)], "a int, b int")
    walk = recursive(spark.createDataFrame([(1,)], "n int"), lambda w: w.join(edges, w.n == edges.a).select("b"), distinct=True)
    assert values(walk, "n", "n") == [1, 2, 3]
    with pytest.raises(RuntimeError):
        recursive(spark.createDataFrame([(1,)], "n int"), lambda w: w.join(edges, w.n == edges.a).select("b"), max_rounds=4)


def test_apply(spark):
    items = spark.createDataFrame([(1, "a,b"), (2, "c"), (3, None)], "id int, tags string")
    assert R.string_split(items, "tags", ",", "id").count() == 3 and R.string_split(items, "tags", ",", "id", outer=True).count() == 4


def test_constraints(spark, tmp_path):
    db = Database(spark, f"file://{tmp_path}")
    db.create_table("p", "id BIGINT, v BIGINT", primary_key="id", checks=("v > 0",), not_null=("v",))
    db.create_table("c", "id BIGINT, pid BIGINT", foreign_keys=(ForeignKey("pid", "p", "id"),))
    rows = lambda *r: spark.createDataFrame(list(r), "id long, v long")
    db.insert("p", rows((1, 5), (2, 6)))
    for bad in (rows((1, 7)), rows((3, -1)), rows((4, None)), rows((None, 1))):
        with pytest.raises(ConstraintError):
            db.insert("p", bad)
    db.insert("c", spark.createDataFrame([(1, 1), (2, None)], "id long, pid long"))
    with pytest.raises(ConstraintError):
        db.insert("c", spark.createDataFrame([(3, 9)], "id long, pid long"))
    with pytest.raises(ConstraintError):
        db.delete("p", F.col("id") == 1)
    assert db.read("p").count() == 2 and db.read("c").count() == 2
    db.create_index("c", Index("u", ("pid",), unique=True))
    with pytest.raises(ConstraintError):
        db.insert("c", spark.createDataFrame([(4, 1)], "id long, pid long"))
    with pytest.raises(ConstraintError):
        db.merge("p", rows((1, 2), (1, 3)), F.expr("t.id = s.id"), {"v": F.col("s.v")})
    with pytest.raises(ValueError, match="deterministic"):
        db.create_materialized_view("m", lambda: db.read("p").withColumn("r", F.rand()))
    db.drop_table("p", cascade=True)
    db.dump(f"file://{tmp_path}/dump")
    assert spark.read.parquet(f"file://{tmp_path}/dump/c").count() == 2


def test_merge_known_answer(spark, tmp_path):
    db = Database(spark, f"file://{tmp_path}")
    db.create_table_as("stock", spark.createDataFrame([(1, 10), (2, 20)], "sku long, qty long"), primary_key="sku")
    db.merge("stock", spark.createDataFrame([(1, 5), (3, 30)], "sku long, qty long"), F.expr("t.sku = s.sku"), {"qty": F.col("s.qty")}, {"sku": F.col("s.sku"), "qty": F.col("s.qty")})
    assert sorted(map(tuple, db.read("stock").collect())) == [(1, 5), (2, 20), (3, 30)]


def test_empty_log_and_rewrites(spark, tmp_path):
    assert Log(spark, f"file://{tmp_path}/none").replay().count() == 0
    assert rewrite("SELECT a FROM t LIMIT 5, 10") == "SELECT a FROM t LIMIT 10 OFFSET 5" and rewrite("GO") == "" and rewrite("SELECT N'x' MINUS SELECT 1") == "SELECT 'x' EXCEPT SELECT 1"
    done, failed, error = Session(spark).batch("SELECT 1 AS a", "SELECT nope FROM nowhere", "SELECT 2")
    assert len(done) == 1 and failed == 1 and error is not None


def test_explain_gives_whole_details(spark):
    from docframe.plans.explain import explain

    df = spark.range(9).where(" OR ".join(f"id * {i} % 7 = {i}" for i in range(2, 40)) + " OR id % 1234567 = 3")
    assert any(r.op == "FILTER" and "1234567" in r.detail and len(r.detail) > 200 for r in explain(df).collect())


def test_row_numbers_of_wide_rows(spark, tmp_path):
    """400,000 rows of a skewed key, read from files: every number once, in order."""
    wide = spark.range(400_000).select((F.col("id") * 7919 % 1000).alias("k"), "id", F.repeat(F.lit("x"), 128).alias("pad"))
    wide.repartition(7).write.parquet(f"{tmp_path}/wide")
    got = R.rownum(spark.read.parquet(f"{tmp_path}/wide"), F.col("k"), F.col("id"), name="n")
    row = got.agg(F.count(F.lit(1)), F.countDistinct("n"), F.min("n"), F.max("n"), F.countDistinct("id")).first()
    assert tuple(row) == (400_000, 400_000, 1, 400_000, 400_000)
    step = got.select("k", F.lag("k").over(W.orderBy("n")).alias("before")).where("before > k").count()
    assert step == 0


def test_ties_follow_null_order(spark):
    t = spark.createDataFrame([(None,), (None,), (1,), (2,), (3,)], "a int")
    for key, want in ((R.SortKey(F.col("a"), True, True), [None, None]), (R.SortKey(F.col("a"), False, False), [1]), (R.SortKey(F.col("a")), [None, None]), (R.SortKey(F.col("a"), True), [3])):
        assert [r.a for r in R.with_ties(t, 1, key).collect()] == want


def test_rewrite_leaves_texts(spark):
    for same in ("SELECT 'A MINUS B' AS a", "SELECT 1 AS `x MINUS`", "SELECT x LIKE '[abc]%' FROM t", "SELECT 'vitamin N' AS v, 'it''s N''x' AS w", "SELECT 1 -- MINUS\n"):
        assert rewrite(same).strip() == same.strip()
    s = Session(spark, {"name": 5})
    assert tuple(s.run("SELECT '@name' AS a, @name AS b, N'[x]' AS c").first()) == ("@name", 5, "[x]")


def test_filters_reach_the_scan(spark):
    lines = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")

    def pushed(test):
        text = lines.where(test)._jdf.queryExecution().executedPlan().toString()
        return text[text.index("PushedFilters") :].split("]")[0]

    assert "GreaterThanOrEqual(l_quantity" in pushed(C.between("l_quantity", F.lit(10), F.lit(12)))
    assert "LessThan(l_quantity" in pushed(C.not_between("l_quantity", F.lit(3), F.lit(48)))
    assert "StringStartsWith(l_returnflag" in pushed(C.like("l_returnflag", "A%"))


def test_checksum_is_64_bits_of_all_arguments(spark):
    def fnv(*literals):
        h = 0xCBF29CE484222325
        for b in "".join(x + "\x1f" for x in literals).encode():
            h = (h ^ b) * 0x100000001B3 % 2**64
        return h - 2**64 if h >= 2**63 else h

    row = spark.range(1).select(D.checksum(F.lit("é'x"), F.lit(7), F.lit(None).cast("string")), D.checksum(F.lit(True)), D.checksum(F.lit(""))).first()
    assert tuple(row) == (fnv("'é''x'", "7", "NULL"), fnv("TRUE"), fnv("''"))


def test_parts_of_dates_by_short_names(spark):
    ts = F.lit("2024-01-31 10:11:12.123456").cast("timestamp_ntz")
    later = M.dateadd("ns", F.lit(9_007_199_254_740_993_999), ts)
    row = spark.range(1).select(
        M.dateadd("mm", F.lit(1), ts).cast("string"), M.dateadd("NS", F.lit(-1500), ts).cast("string"), M.dateadd("dw", F.lit(2), ts).cast("string"), M.datename("DW", ts),
        M.datepart("ns", ts), M.datediff("ns", ts, later), M.datediff("wk", ts, M.dateadd("ww", F.lit(3), ts)),
    ).first()
    assert tuple(row) == ("2024-02-29 10:11:12.123456", "2024-01-31 10:11:12.123454", "2024-02-02 10:11:12.123456", "Wednesday", 123456000, 9_007_199_254_740_993_000, 3)
    with pytest.raises(ValueError):
        M.datepart("fortnight", ts)


def test_range_frames_over_several_blocks(spark):
    from docframe import catalogue

    plan = catalogue.queries()["win_range_interval"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "RangeFrame" not in plan  # Spark would count each frame anew, in one task for each event_type
    dense = spark.range(600_000).select(F.lit("a").alias("g"), F.expr("id div 2").alias("t"))
    half = X.range_count(dense, ["g"], F.col("t"), 100_000, 0, "v")
    assert half.where(F.col("v") != 2 * (F.least(F.col("t"), F.lit(100_000)) + 1)).count() == 0 and half.count() == 600_000
    whole = X.range_count(dense, [], F.col("t"), 1000, 500, "v")
    assert whole.where(F.col("v") != 2 * (F.least(F.col("t"), F.lit(1000)) + F.least(F.lit(299_999) - F.col("t"), F.lit(500)) + 1)).count() == 0


@pytest.mark.parametrize(("before", "after"), [(3, 0), (0, 0), (2, 4), (0, 5), (6, -2), (-1, 3)])
def test_range_frames_with_nulls_and_peers(spark, before, after):
    rows = [(i, None if i % 11 == 0 else "abc"[i % 3], i % 4 or None, None if i % 7 == 0 else (i * i) % 40 - 20) for i in range(200)]
    df = spark.createDataFrame(rows, "id int, g string, h int, t int")
    got = {r.id: r.v for r in X.range_count(df, ["g", "h"], F.col("t"), before, after, "v").collect()}

    def in_frame(x, t):
        return x == t if x is None or t is None else t - before <= x <= t + after

    assert got == {i: sum(1 for _, g2, h2, t2 in rows if (g2, h2) == (g, h) and in_frame(t2, t)) for i, g, h, t in rows}
    assert X.range_count(df.where("false"), ["g"], F.col("t"), before, after, "v").collect() == []
