"""Line-window chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def line_chunks(files: DataFrame, size: int = 15, overlap: int = 3) -> DataFrame:
    """Windows of `size` lines, each `overlap` lines into the one before, blank ones left out: file_path, content, start_line, end_line."""
    rows = files.select("file_path", F.split("content", "\n").alias("lines"))
    starts = rows.select("file_path", "lines", F.explode(F.sequence(F.lit(0), F.size("lines") - 1, F.lit(size - overlap))).alias("at"))
    content = F.array_join(F.slice("lines", F.col("at") + 1, F.lit(size)), "\n")
    out = starts.select("file_path", content.alias("content"), (F.col("at") + 1).alias("start_line"), F.least(F.col("at") + size, F.size("lines")).alias("end_line"), F.lit("code_block").alias("semantic_type"))
    return out.where(F.col("content").rlike(r"[^\s]"))
