"""What arrived since the last run, added to a table of what was seen: each key once, however often it arrives."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from tessera.sources.manifests import append_new


def ingest(spark: SparkSession, folder: str, schema: StructType, key: str, table: str, checkpoint: str) -> StreamingQuery:
    """Parquet files of a folder, once each; rows with a key that `table` (a folder) already has are ignored."""

    def add(batch: DataFrame, _: int) -> None:
        try:
            seen = batch.sparkSession.read.schema(schema).parquet(table)
        except Exception as error:
            if "PATH_NOT_FOUND" not in str(error):
                raise
            seen = None
        append_new(batch, seen, key).write.mode("append").parquet(table)

    stream = spark.readStream.schema(schema).parquet(folder)
    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
