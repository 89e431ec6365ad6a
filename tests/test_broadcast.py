"""What is broadcast is bounded by what it holds, not by what the planner takes it for."""

import pytest
from pyspark.sql import functions as F

from codegauge.llm import simhash_dedup, source_mix
from codegauge.sources import store


def operators(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def docs(spark, tmp_path):
    rows = spark.range(3000).select("id", (F.col("id") % 3).cast("string").alias("source"), F.array_join(F.transform(F.sequence(F.lit(1), 20 + F.col("id") % 40), lambda i: F.md5((F.col("id") * i).cast("string"))), " ").alias("text"))
    rows.withColumnRenamed("id", "doc_id").write.parquet(f"{tmp_path}/documents")
    return spark.read.parquet(f"{tmp_path}/documents")


def test_exploded_tables_are_not_broadcast(spark, docs):
    fps = store.written(simhash_dedup.fingerprints(docs), "fps").select("fp").distinct()
    assert "Broadcast" not in operators(simhash_dedup.links(fps))
    assert "Broadcast" not in operators(simhash_dedup.dedup_groups(docs))
    assert "BroadcastExchange" not in operators(source_mix.mix(docs))
    assert "BroadcastExchange" not in operators(source_mix.mixed_rows(docs))


def test_tables_that_are_written_broadcast_small_ones_alone(spark, tmp_path, monkeypatch):
    seen = []
    real = store.settings
    monkeypatch.setattr(store, "settings", lambda s, **v: seen.append(v) or real(s, **v))
    for now, want in (("10485760", "262144"), ("-1", "-1"), ("10k", "10240")):
        with real(spark, spark__sql__autoBroadcastJoinThreshold=now):
            assert store.written(spark.range(3), "three").count() == 3
            assert spark.conf.get("spark.sql.autoBroadcastJoinThreshold") == now
        assert seen[0]["spark__sql__autoBroadcastJoinThreshold"] == want
        seen.clear()
