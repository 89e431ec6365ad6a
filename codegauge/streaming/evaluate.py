"""Evaluation of predictions that arrive over time: the batch plan on each micro-batch.

Evaluation is row by row after its joins, so there is no state between batches; a batch sees the tasks and references of its own
predictions. Results are appended to a table; the checkpoint makes each batch count once a trigger, and a batch that is
replayed writes its own folder anew.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..plans import evaluate


def evaluate_stream(tasks: DataFrame, references: DataFrame, predictions: DataFrame, out: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Starts the query: out gets one folder batch=<n> of results for each micro-batch of predictions (task_id, code)."""

    def one(batch: DataFrame, number: int) -> None:
        batch = batch.select("task_id", "code").persist()
        try:
            mine = tasks.join(batch.select("task_id"), "task_id", "left_semi")
            known = references.join(batch.select("task_id"), "task_id", "left_semi")
            evaluate.evaluate(mine, known, batch).write.mode("overwrite").parquet(f"{out}/batch={number}")
        finally:
            batch.unpersist()

    return predictions.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
