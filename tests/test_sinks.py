"""Sinks whose order and buckets are read back from the files, and checks in one pass a table."""

import random

from pyspark.sql import functions as F

from volpanel.operators import audit as A
from volpanel.session import scratch_path
from volpanel.sources import sinks as K


def plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def test_files_follow_the_order(spark):
    rng = random.Random(4)
    keys = [(rng.randint(0, 400), rng.choice("abcd"), i) for i in range(5000)]
    df = spark.createDataFrame(keys, "k int, c string, i int").repartition(7)
    path = scratch_path(spark, "ordered")
    K.write_ordered(df, path, ["k", "c", "i"])
    got = {(r.k, r.c, r.i): r.position for r in K.stored_order(spark, path).collect()}
    assert got == {key: n + 1 for n, key in enumerate(sorted(keys))}
    path = scratch_path(spark, "plain")
    df.write.parquet(path)
    assert {(r.k, r.c, r.i): r.position for r in K.stored_order(spark, path).collect()} != got


def test_bucketed_tables_join_and_group_without_an_exchange(spark):
    a = spark.range(3000).selectExpr("id % 97 AS k", "id AS v")
    b = spark.range(97).selectExpr("id AS k", "id * 2 AS w")
    tables = []
    for name, df in (("left", a), ("right", b)):
        path = scratch_path(spark, name)
        tables.append(K.write_bucketed(df, "t_" + path.rsplit("-", 1)[1], path, ["k"], buckets=4))
    joined = tables[0].join(tables[1].hint("merge"), "k")
    assert joined.count() == 3000 and "Exchange" not in plan(joined)
    grouped = tables[0].groupBy("k").agg(F.sum("v").alias("v"))
    assert grouped.count() == 97 and "Exchange" not in plan(grouped)
    assert "Exchange" in plan(a.join(b.hint("merge"), "k"))


def test_checks_of_a_table_share_one_pass_and_can_fail(spark):
    path = scratch_path(spark, "checked")
    spark.range(10).withColumn("s", F.lit("x")).write.parquet(path)
    table, other = spark.read.parquet(path), spark.range(3)
    found = A.checks({"some": (table, "count(1) > 5"), "none": (table, "count(1) > 50"), "null": (table, "max(CASE WHEN id > 99 THEN true END)"), "three": (other, "count(1) = 3")})
    assert {r.check: r.passed for r in found.collect()} == {"some": True, "none": False, "null": False, "three": True}
    assert plan(found).count("FileScan") == 1
