"""Scalers over Structured Streaming: batch by batch into an estimator, or as a running aggregate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tabulon.functions.literals import quoted
from tabulon.operators.preprocessing import _Scaler



def fit_stream(estimator: _Scaler, stream: DataFrame, features: list[str], checkpoint: str, **trigger) -> StreamingQuery:
    """Starts a query that gives every micro-batch to ``partial_fit``.

    A batch that is delivered again after a failure is not counted twice: batches come in order of their ids.
    """
    seen = -1

    def take(batch: DataFrame, batch_id: int) -> None:
        nonlocal seen
        if batch_id > seen and not batch.isEmpty():
            estimator.partial_fit(batch, features)
        seen = max(seen, batch_id)

    writer = stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint)
    return (writer.trigger(**trigger) if trigger else writer).start()


def running_moments(stream: DataFrame, features: list[str]) -> DataFrame:
    """One row for each feature of all rows so far: ``feature, n, mean, var, low, high`` (complete output mode)."""
    pairs = F.explode(F.array(*(F.struct(F.lit(f).alias("feature"), F.expr(f"CAST({quoted(f)} AS DOUBLE)").alias("x")) for f in features)))
    rows = stream.select(pairs.alias("p")).select("p.feature", "p.x")
    return rows.groupBy("feature").agg(
        F.count("x").alias("n"), F.avg("x").alias("mean"), F.var_pop("x").alias("var"), F.min("x").alias("low"), F.max("x").alias("high")
    )
