"""Pages that arrive over time: late rows and copies are folded into counts as they come.

An extension beyond batch parity: extraction runs append files, and the same page may
come again from a later run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def page_stream(spark: SparkSession, folder: str, schema) -> DataFrame:
    """A stream of page rows from Parquet files that appear in ``folder``."""
    return spark.readStream.schema(schema).parquet(folder)


def distinct_rows(stream: DataFrame, lateness: str = "2 days") -> DataFrame:
    """Each (doc_id, page_index, run_id) once, as long as its copies come within ``lateness``."""
    return stream.withWatermark("extracted_at", lateness).dropDuplicatesWithinWatermark(["doc_id", "page_index", "run_id"])


def status_counts(stream: DataFrame, window: str = "1 hour", lateness: str = "2 days") -> DataFrame:
    """(window, doc_id, status, pages): rows by status and event time; state is dropped behind the watermark."""
    rows = stream.withWatermark("extracted_at", lateness)
    return rows.groupBy(F.window("extracted_at", window), "doc_id", "status").agg(F.count("*").alias("pages"))
