from pyspark.sql import functions as F

from codegauge.plans import plan_queries, queries


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def folder(spark, tmp_path):
    spark.range(40).select(F.col("id").alias("c_custkey"), (F.col("id") % 25).alias("c_nationkey")).write.parquet(f"{tmp_path}/customer.parquet")
    spark.range(30).select(F.col("id").alias("o_orderkey")).write.parquet(f"{tmp_path}/orders.parquet")
    spark.range(60).select((F.col("id") % 35).alias("l_orderkey"), (F.col("id") % 4).alias("l_suppkey"), (F.col("id") % 3).alias("l_linenumber")).write.parquet(f"{tmp_path}/lineitem.parquet")
    return str(tmp_path)


def test_parts_of_the_metrics_table_are_not_broadcast(spark, tmp_path):
    got = plan_queries.metrics_table(spark, folder(spark, tmp_path))
    assert "Broadcast" not in plan(got) and got.count() == 4 * sum(i % 6 != 5 for i in range(40))


def test_keys_meet_in_small_parts(spark, tmp_path):
    got = queries.key_equality(spark, folder(spark, tmp_path))
    assert "Broadcast" not in plan(got) and "REPARTITION_BY_NUM" in plan(got)
    assert sorted(map(tuple, got.collect())) == [(i, "left") for i in range(30, 35)]


def test_hard_tasks_are_widened_where_they_were_dealt_to(spark, tmp_path):
    p = plan(plan_queries.hard_tasks(spark, folder(spark, tmp_path)))
    assert "REPARTITION_BY_NUM" in p and "ENSURE_REQUIREMENTS" not in p


def test_grams_are_not_broadcast(spark):
    from codegauge.operators import ngram

    docs = spark.createDataFrame([(i, "ab"[i % 2], i % 3, ["x", "y", "z"][: 1 + i % 3]) for i in range(12)], "sample_idx long, author string, fold int, tokens array<string>")
    assert plan(ngram.grid(docs, [2], 3)).count("BroadcastHashJoin") == 0
