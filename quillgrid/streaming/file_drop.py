"""The flowing-Markdown plan over a folder that documents keep arriving in. An extension: the batch operators run on each
micro-batch, which holds whole documents, so no state outlives one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators import lines as L
from ..sources.pages import document_lines

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def markdown_stream(spark: SparkSession, folder: str, out: str, checkpoint: str) -> StreamingQuery:
    """Starts a query from Parquet files under folder to Parquet under out, once over what is there."""

    def convert(batch: DataFrame, epoch: int) -> None:
        # the epoch's own folder is replaced, so a batch that runs again after a failure writes its rows once
        L.flowing_markdown(document_lines(batch)).write.mode("overwrite").parquet(f"{out}/epoch={epoch}")

    source = spark.readStream.schema(SCHEMA).parquet(folder)
    return source.writeStream.foreachBatch(convert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
