"""Score CSV files as they arrive in a folder."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from phasegrid.plans.model import VariationalModel


def score_arriving(
    spark: SparkSession, model: VariationalModel, source: str, schema: StructType | str, target: str, checkpoint: str
) -> StreamingQuery:
    """Read new header-CSV files of ``source``, append scored rows to the parquet table ``target``.

    A file whose header differs from the schema, or a cell that does not fit its type, fails the query. ``checkpoint``
    lies on shared storage: after a loss the query goes on where it stopped.
    """
    arriving = (
        spark.readStream.schema(schema)
        .options(header=True, enforceSchema=False, mode="FAILFAST", escape='"', columnPruning=False)
        .csv(source)
    )
    return (
        model.score(arriving)
        .writeStream.format("parquet")
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start(target)
    )
