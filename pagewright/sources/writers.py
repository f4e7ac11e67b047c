"""Writers. Outputs are new: an existing path is refused, and a failed write leaves nothing behind."""

from __future__ import annotations

import hashlib
import json
import os
from functools import reduce
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def write_jsonl(df: DataFrame, path: str) -> None:
    """JSON lines with sorted keys; NaN and infinities are refused before anything is written."""
    floats = [c for c, k in df.dtypes if k in ("double", "float")]
    if floats:
        bad = reduce(lambda a, b: a | b, [F.isnan(c) | F.col(c).isin(float("inf"), float("-inf")) for c in floats])
        if not df.where(bad).isEmpty():
            raise ValueError("JSON has no NaN or infinity")
    df.select(*sorted(df.columns)).write.mode("errorifexists").json(path)


def write_json(value, path: str, spark: SparkSession | None = None) -> None:
    """One manifest: sorted keys, written beside the target and renamed; with ``spark``, on any storage that it can reach."""
    text = json.dumps(value, indent=2, sort_keys=True, ensure_ascii=False, allow_nan=False) + "\n"
    if spark is None:
        target = Path(path)
        part = target.with_name(f".{target.name}.part")
        part.write_text(text, encoding="utf-8")
        os.replace(part, target)
        return
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    part = jvm.org.apache.hadoop.fs.Path(target.getParent(), f".{target.getName()}.part")
    storage = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = storage.create(part, True)
    try:
        out.write(bytearray(text, "utf-8"))
    finally:
        out.close()
    if not storage.rename(part, target):
        raise FileExistsError(path)


def write_inventory(df: DataFrame, path: str) -> None:
    """CSV with a header; an empty frame gives files without rows."""
    df.write.mode("errorifexists").csv(path, header=True)


def write_reports(df: DataFrame, path: str) -> None:
    """Reports partitioned by company and year."""
    df.write.mode("errorifexists").partitionBy("company", "year").parquet(path)


def markdown_table(df: DataFrame, limit: int = 200) -> str:
    """A report's table of a small frame; refuses a frame that is not small."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} rows are no report")
    line = lambda cells: "| " + " | ".join(str(c).replace("|", "\\|") for c in cells) + " |"
    return "\n".join([line(df.columns), line("---" for _ in df.columns), *(line(r) for r in rows)]) + "\n"


def audit_report(title: str, gate: DataFrame, histogram: DataFrame, examples: DataFrame, each: int = 20) -> str:
    """An audit as Markdown: its state, issues by code, and the first ``each`` ids of every code.

    gate: ``audit.gate``; histogram: (code, count); examples: (code, entity, id).
    """
    state = gate.first()
    first = examples.withColumn("n", F.row_number().over(Window.partitionBy("code").orderBy("entity", "id"))).where(F.col("n") <= each).drop("n")
    shown = first.groupBy("code").agg(F.array_join(F.array_sort(F.collect_list(F.coalesce("id", F.lit("(none)")))), ", ").alias("examples"))
    counts = histogram.join(shown, "code", "left").orderBy(F.desc("count"), "code").select("code", "count", "examples")
    head = f"# {title}\n\n{'Ready' if state['ready'] else 'Blocked'}: {state['blocking']} blocking, {state['warnings']} warnings.\n\n"
    return head + markdown_table(counts)


def fingerprint(policy) -> str:
    """SHA-256 of a policy's canonical JSON."""
    return hashlib.sha256(json.dumps(policy, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
