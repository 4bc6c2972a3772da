"""Incremental ingest: new waveform files become chunk rows exactly once per file."""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..session import checkpoint_dir
from ..sources.files import decode_chunks

BINARY_FILE = "path STRING, modificationTime TIMESTAMP, length LONG, content BINARY"


def ingest_new_files(spark: SparkSession, folder: str, out: str, pattern: str = "*.edf", name: str = "ingest", checkpoint: str | None = None):
    """Process the files that arrived since the last run, then stop; the checkpoint is the resume list."""
    files = (
        spark.readStream.format("binaryFile").schema(BINARY_FILE).option("pathGlobFilter", pattern)
        .option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1000).load(folder)
    )
    return (
        decode_chunks(files).writeStream.format("parquet").partitionBy("channel")
        .option("checkpointLocation", checkpoint or f"{checkpoint_dir(spark)}/{name}").option("path", out)
        .trigger(availableNow=True).start()
    )
