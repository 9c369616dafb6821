"""New files in a folder are ingested as they arrive."""

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from panelwise.plans.ingest import ingest_files
from panelwise.sources.store import Store


def ingest_stream(
    store: Store, folder: str, checkpoint: str, period: int | None = None, available_now: bool = True
) -> StreamingQuery:
    """Insert-only by key, so no watermark is needed. A micro-batch is one ingest of all its files; its run
    rows carry the batch, so that a batch that is repeated adds neither rows nor runs.

    The stream carries file paths only; the batch reader then reads the files in parallel.
    """
    paths = (
        store.spark.readStream.format("binaryFile")
        .schema("path STRING, modificationTime TIMESTAMP, length BIGINT, content BINARY")
        .option("pathGlobFilter", "*.csv")
        .load(folder)
        .select("path")
    )

    def add(batch: DataFrame, batch_id: int) -> None:
        marker = f"{checkpoint}#{batch_id}"
        if store.runs("ingestion_runs").where(F.col("stream_batch") == marker).limit(1).count():
            return  # this batch was recorded before the query was restarted
        # one path per file; the files' contents never come here
        paths = [row.path for row in batch.select("path").distinct().collect()]
        ingest_files(store, paths, period, stream_batch=marker)

    writer = paths.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
