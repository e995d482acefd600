"""Incremental ingest: a folder of JSON lines as a stream, each micro-batch one commit of the store.

The same cells give the same ids, so a batch that is delivered again after a failure adds nothing; the checkpoint folder remembers which files were read."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from strataweave.project import Project
from strataweave.sources.jsonl import parse_lines


def ingest_stream(project: Project, folder: str, checkpoint: str, schema_ref: str | None = None, id_field: str = "record_id", files_per_batch: int | None = None, once: bool = True) -> StreamingQuery:
    """Start the stream; with once it ends when all files that are there have been read."""
    source = project.spark.readStream.format("text")
    source = source.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else source

    def take(batch: DataFrame, _: int) -> None:
        project.ingest(parse_lines(batch, schema_ref, id_field))

    writer = source.load(folder).writeStream.foreachBatch(take).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
