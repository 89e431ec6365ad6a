"""Tables that a plan writes to the folder driver and executors share, and reads again."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

BATCH_BYTES = 4 << 20
#: A table is broadcast if its files have so many bytes at most. In memory it may have a hundred times as many, once in the driver too.
BROADCAST_BYTES = 256 << 10


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, which driver and executors share. Where it is unset: a temporary one in local mode, else an error."""
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="codegauge-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def place(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/codegauge/{name}-{uuid.uuid4().hex}"


@contextmanager
def settings(spark: SparkSession, **values: str) -> Iterator[None]:
    """The session's settings (dots as __) for the executions that begin here; afterwards they are as before."""
    keys = {k.replace("__", "."): v for k, v in values.items()}
    old = {k: spark.conf.get(k, None) for k in keys}
    try:
        for k, v in keys.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def broadcast_bound(spark: SparkSession):
    """`settings` under which the planner broadcasts what it takes for BROADCAST_BYTES at most, or less if the session has less."""
    least = min(spark._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold(), BROADCAST_BYTES)
    values = {"spark__sql__autoBroadcastJoinThreshold": str(least)}
    if spark.conf.get("spark.sql.adaptive.autoBroadcastJoinThreshold", None):  # else it is as the other
        values["spark__sql__adaptive__autoBroadcastJoinThreshold"] = str(least)
    return settings(spark, **values)


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a table in the shared folder: cuts lineage, survives lost executors, and is computed once.

    The execution removes its shuffle files at its end: what is read later is the table. Rows that go to Python go
    in batches of BATCH_BYTES, however long they are. Tables of more than BROADCAST_BYTES are not broadcast.
    """
    spark = df.sparkSession
    with broadcast_bound(spark), settings(spark, spark__sql__classic__shuffleDependency__fileCleanup__enabled="true", spark__sql__execution__arrow__maxBytesPerBatch=str(BATCH_BYTES)):
        df.write.option("compression", "zstd").parquet(path := place(spark, name))
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, rows: int, *keys: str, share: int = 5_000) -> DataFrame:
    """df dealt to tasks of some `share` of its rows (by keys, or in turn), and to all cores at least.

    The number is fixed, so the planner does not put small parts together: rows that are small here may take long, or much memory, in the next step.
    """
    n = max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // share))
    return df.repartition(n, *keys)


def drop_written(*tables: DataFrame) -> None:
    """Deletes tables of `written` that nothing will read again."""
    for t in tables:
        for f in {x.rpartition("/")[0] for x in t.inputFiles()}:
            jvm = t.sparkSession._jvm
            path = jvm.org.apache.hadoop.fs.Path(f)
            path.getFileSystem(t.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
