"""Incremental indexing as a stream: each batch of files goes through the same functions as a batch run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lexarray.operators.lines import line_chunks
from lexarray.operators.segments import Segments


def stream_index(files: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Appends the line chunks of a stream of files (file_path, content, file_hash) to Parquet under target, each
    batch in a folder of its own that a repeated batch overwrites; a file's content is taken once a batch."""

    def write(batch: DataFrame, number: int) -> None:
        line_chunks(batch.dropDuplicates(["file_path", "file_hash"])).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return files.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_segments(files: DataFrame, store: Segments, checkpoint: str, name: str = "stream") -> StreamingQuery:
    """Keeps a store of segments up to date with a stream of rows (path, version, doc, language, content).

    In a batch the row of a path with the highest version counts; it replaces what the store has of the path, and one without
    content removes it. The manifest keeps the number of the last batch, so a batch that is given again changes nothing.
    """

    def write(batch: DataFrame, number: int) -> None:
        mark = f"batch of {name}"
        if store.manifest()["marks"].get(mark, -1) >= number:
            return
        newest = batch.groupBy("path").agg(F.max_by(F.struct("doc", "language", "content"), "version").alias("r")).select("path", "r.*")
        store.add(texts=newest.where("content is not null"), removed=newest.select("path"), marks=lambda added: {mark: number})

    return files.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
