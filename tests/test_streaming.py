from pyspark.sql import functions as F

from pagewright.streaming import pages


def test_copies_are_dropped_and_counts_follow(spark, tmp_path):
    rows = [("d", 0, "r1", "ok"), ("d", 0, "r1", "ok"), ("d", 1, "r1", "page_failed")]
    df = spark.createDataFrame(rows, "doc_id string, page_index int, run_id string, status string").withColumn("extracted_at", F.lit("2024-01-01 00:00:00").cast("timestamp"))
    df.write.parquet(str(tmp_path / "in"))
    stream = pages.distinct_rows(pages.page_stream(spark, str(tmp_path / "in"), df.schema))
    q = stream.writeStream.format("memory").queryName("copies").outputMode("append").option("checkpointLocation", str(tmp_path / "c1")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("copies").count() == 2
    counts = pages.status_counts(pages.page_stream(spark, str(tmp_path / "in"), df.schema))
    q = counts.writeStream.format("memory").queryName("counts").outputMode("update").option("checkpointLocation", str(tmp_path / "c2")).start()
    q.processAllAvailable()
    q.stop()
    assert {(r.status, r.pages) for r in spark.table("counts").collect()} == {("ok", 2), ("page_failed", 1)}
