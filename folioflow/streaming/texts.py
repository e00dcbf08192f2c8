"""The stateless text functions over a stream of documents. The batch engine has no event time, so there is no state to keep."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from folioflow.functions.text import strip_markdown


def read_documents(spark: SparkSession, path: str, schema: str, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def cleaned(docs: DataFrame, text: str = "text") -> DataFrame:
    """The stream with ``clean_text``; the same expression as in batch."""
    return docs.withColumn("clean_text", strip_markdown(F.col(text)))


def write_available(docs: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Writes all that is there now and stops; a later call goes on from there."""
    return docs.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
