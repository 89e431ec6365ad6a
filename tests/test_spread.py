from codegauge.functions import scan
from codegauge.plans import code_queries, evaluate, plan_queries
from codegauge.sources.store import spread
from pyspark.sql import functions as F


def customers(spark, folder, n=30):
    spark.range(n).select(F.col("id").alias("c_custkey"), (F.col("id") % 25).alias("c_nationkey")).coalesce(1).write.parquet(f"{folder}/customer.parquet")
    return str(folder)


def test_parts_grow_with_rows(spark):
    rows = spark.range(100, numPartitions=1)
    assert spread(rows, 100).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert spread(rows, 100, "id", share=5).rdd.getNumPartitions() == 20


def test_code_of_one_file_is_read_by_all_cores(spark, tmp_path):
    sf, cores = customers(spark, tmp_path), spark.sparkContext.defaultParallelism
    assert cores > 1
    for q in (code_queries.code_facts, code_queries.function_records, code_queries.masked_python, code_queries.masked_c, code_queries.without_comments, plan_queries.masked_java):
        assert q(spark, sf).rdd.getNumPartitions() >= cores, q.__name__


def test_facts_alone(spark, tmp_path):
    rows = code_queries.samples(spark, customers(spark, tmp_path)).withColumn("task_id", F.concat_ws(":", "id", "language"))
    alone = {r.task_id: r for r in scan.with_facts(rows, functions=False).collect()}
    both = {r.task_id: r for r in scan.with_facts(rows).collect()}
    assert len(alone) == 60 and all(r.functions is None and r.facts == both[k].facts for k, r in alone.items()) and all(r.functions for r in both.values())


def test_records_do_not_go_as_arrow_batches(spark, tmp_path):
    plan = code_queries.function_records(spark, customers(spark, tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "BatchEvalPythonUDTF" in plan and "ArrowEvalPythonUDTF" not in plan


def test_submissions_are_read_by_all_cores(spark):
    base = spark.range(10, numPartitions=1).select(F.col("id").cast("string").alias("task_id"), F.lit("python").alias("language"), F.lit("def f(a):\n    return a\n").alias("code"), F.expr("named_struct('name', 'f', 'arity', 1)").alias("signature"), F.expr("named_struct('token_count', 9, 'ast_node_count', 9)").alias("human_metrics"))
    plan = evaluate.with_structure(base)._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan.partition("MapInPandas")[2]
    assert evaluate.with_structure(base).where("nonstub").count() == 10
