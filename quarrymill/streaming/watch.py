"""Watch arriving files for values that the model doesn't know."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from ..operators.drift import unknown_values


def watch_enum(spark: SparkSession, path: str, schema: StructType, column: str, known: list[str], sink: str, checkpoint: str):
    """Read what is new below ``path`` once, and append (batch, value) for unknown values to the Parquet folder ``sink``.

    Progress is kept in ``checkpoint``; a batch that runs again overwrites its own folder, so results count once.
    """

    def look(batch: DataFrame, number: int) -> None:
        found = unknown_values(batch, column, known)
        found.write.mode("overwrite").parquet(f"{sink}/batch={number}")

    stream = spark.readStream.schema(schema).parquet(path)
    query = stream.writeStream.foreachBatch(look).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema("value string, batch int").parquet(sink)
