"""M17 on arriving requests: a stream of requests meets the features at hand
(a stored table) and is scored inside the stream.  The join is stream-static,
so the stream keeps no state; a fitted pipeline transforms each micro-batch as
it would a table.  Each batch is a folder of its own below the sink and is
written as a whole, so a batch that is run again is not answered twice."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

REQUEST_SCHEMA = "request_id bigint, state string, comName string"


def answer_stream(spark: SparkSession, landing: str, sink: str, checkpoint: str, features: DataFrame,
                  answer: Callable[[DataFrame], DataFrame]):
    """Answer the landed requests (JSON lines) that have not been answered yet;
    ``answer`` maps requests joined with ``features`` to the rows written."""
    requests = spark.readStream.schema(REQUEST_SCHEMA).option("mode", "FAILFAST").json(landing)
    joined = requests.join(features, ["state", "comName"], "left")
    query = (joined.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
             .foreachBatch(lambda rows, n: answer(rows).write.mode("overwrite").parquet(f"{sink}/batch={n}")).start())
    query.awaitTermination()
    return query


def answers(spark: SparkSession, sink: str) -> DataFrame:
    """All answers written so far."""
    return spark.read.parquet(sink).drop("batch")
