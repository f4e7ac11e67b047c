"""Readers: JSON lines, manifests, marked reports in folders or archives, PDF folders, OCR payloads.

Nothing here reads a collection on the driver; only single configuration files are.
"""

from __future__ import annotations

import io
import json
import re
import struct
import tomllib
import zipfile
import zlib
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from pagewright.functions.text import PY_SPACE, normalize_search_text

DOCUMENT = "doc_id string, dataset string, pdf_path string, split string, page_count int, page_paths array<string>, source_path string, source_format string, metadata map<string,string>, sha256 string, registered_at timestamp"
TASK = "task_id string, doc_id string, task_type string, question string, answers array<string>, evidence_pages array<int>, target_fields map<string,string>, metadata map<string,string>"
MARKER = r"(?m)^# Page (\d+)[ \t]*$"


def read_jsonl(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """JSON lines; blank lines are skipped and a bad line ends the read."""
    return spark.read.schema(schema).json(path, mode="FAILFAST")


def audit_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """(path, line) of the non-blank lines that are no JSON object."""
    lines = spark.read.text(path).where(~F.col("value").rlike(f"^[{PY_SPACE}]*$"))
    object_like = F.try_parse_json("value")
    return lines.where(object_like.isNull() | ~F.col("value").rlike(rf"^[{PY_SPACE}]*\{{")).select(F.input_file_name().alias("path"), F.col("value").alias("line"))


def _text_file(path: str, spark: SparkSession | None) -> str:
    """One small file: local, or with ``spark`` on any storage that it can reach."""
    if spark is None:
        return Path(path).read_text(encoding="utf-8-sig")
    return spark.read.text(path, wholetext=True).first()[0].removeprefix("\ufeff")


def read_json(path: str, spark: SparkSession | None = None):
    """One manifest."""
    return json.loads(_text_file(path, spark))


def load_toml(path: str, spark: SparkSession | None = None) -> dict:
    """One configuration file."""
    return tomllib.loads(_text_file(path, spark))


def model_table(spark: SparkSession, config: dict) -> DataFrame:
    """(id, enabled, strategies) of a configuration's models."""
    rows = [(m["id"], m.get("enabled", True), list(m.get("strategies", []))) for m in config.get("models", [])]
    return spark.createDataFrame(rows, "id string, enabled boolean, strategies array<string>")


def with_defaults(documents: DataFrame) -> DataFrame:
    """Documents with the defaults of absent fields."""
    return documents.withColumns(
        {
            "split": F.coalesce("split", F.lit("unspecified")),
            "page_paths": F.coalesce("page_paths", F.array().cast("array<string>")),
            "source_path": F.coalesce("source_path", "pdf_path"),
            "metadata": F.coalesce("metadata", F.create_map().cast("map<string,string>")),
        }
    )


def load_documents(spark: SparkSession, path: str) -> DataFrame:
    return with_defaults(read_jsonl(spark, path, DOCUMENT))


def load_tasks(spark: SparkSession, path: str) -> DataFrame:
    t = read_jsonl(spark, path, TASK)
    return t.withColumns({c: F.coalesce(c, F.array().cast(k)) for c, k in (("answers", "array<string>"), ("evidence_pages", "array<int>"))})


def rebased(documents: DataFrame, root: str, strict: bool = False) -> DataFrame:
    """Documents whose path is the file name under ``root``; a checksum must be 64 hex digits.

    ``checksum_valid`` tells; with ``strict``, a frozen manifest with another checksum ends the job.
    """
    name = F.element_at(F.split(F.coalesce("source_path", "pdf_path"), r"[/\\]"), -1)
    valid = F.coalesce(F.col("sha256").rlike("^[0-9a-f]{64}$"), F.lit(False))
    if strict:
        valid = F.when(valid, valid).otherwise(F.raise_error(F.concat(F.lit("no checksum in a frozen manifest: "), F.coalesce("doc_id", F.lit("?")))).cast("boolean"))
    return documents.withColumn("source_path", F.concat(F.lit(root.rstrip("/") + "/"), name)).withColumn("checksum_valid", valid)


def markdown_reports(spark: SparkSession, folder: str) -> DataFrame:
    """(company, year, text) of ``folder/company/year.md``; a byte order mark is dropped."""
    df = spark.read.text(f"{folder}/*/*.md", wholetext=True).withColumn("p", F.input_file_name())
    key = lambda k: F.url_decode(F.regexp_extract("p", r"([^/]+)/([^/]+)\.md$", k))
    return df.select(key(1).alias("company"), key(2).alias("year"), F.regexp_replace("value", "^\\uFEFF", "").alias("text")).where(F.col("year").rlike(r"^\d{4}$"))


def _unzip(batches):
    for pdf in batches:
        for content in pdf.content:
            with zipfile.ZipFile(io.BytesIO(content)) as z:
                for name in z.namelist():
                    m = re.fullmatch(r"reports/([^/]+)/(\d{4})\.md", name)
                    if m:  # one member at a time: an archive may be larger than a batch
                        yield pd.DataFrame({"company": [m[1]], "year": [m[2]], "text": [z.read(name).decode("utf-8-sig")]})


def zipped_reports(spark: SparkSession, path: str) -> DataFrame:
    """(company, year, text) of the reports/company/year.md members of archives, one task per archive."""
    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInPandas(_unzip, "company string, year string, text string")


def split_marked(reports: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(pages, issues) of texts whose pages start at '# Page N' lines, which must count 1..n.

    pages: (key, page_index zero-based, page_text stripped); issues: (key, code).
    """
    t = F.col(text)
    numbers = F.regexp_extract_all(t, F.lit(MARKER), F.lit(1))
    df = reports.select(key, numbers.alias("n"), F.split(t, r"(?m)^# Page \d+[ \t]*$", -1).alias("parts"))
    counted = F.transform(F.sequence(F.lit(1), F.greatest(F.size("n"), F.lit(1))), lambda i: i.cast("string"))
    code = F.when(F.col("n").isNull() | (F.size("n") == 0), "no_markers").when(F.col("n") != counted, "not_contiguous")
    df = df.withColumn("code", code)
    pages = df.where("code is null").select(key, F.posexplode(F.slice("parts", 2, F.size("parts"))).alias("page_index", "p"))
    strip = F.regexp_replace("p", f"^[{PY_SPACE}]+|[{PY_SPACE}]+$", "")
    return pages.select(key, "page_index", strip.alias("page_text")), df.where("code is not null").select(key, "code")


def selection(path: str, spark: SparkSession | None = None) -> list[tuple[str, str]]:
    """The ordered unique (company, year) keys of a selection file."""
    keys = [(str(r["company"]), str(r["year"])) for r in read_json(path, spark)["reports"]]
    if len(set(keys)) != len(keys):
        raise ValueError("a selection names a report twice")
    return keys


def manual_checks(spark: SparkSession, path: str) -> DataFrame:
    """Review rows with ``code``: null, or the first rule that the row breaks."""
    schema = "task_id string, source_task_id string, company string, year string, status string, findings array<struct<code:string,detail:string>>, human_signoff boolean"
    df = spark.read.schema(schema).json(path, multiLine=True)
    again = F.count("*").over(Window.partitionBy("task_id")) > 1
    code = F.when(F.coalesce("task_id", F.lit("")) == "", "empty_task_id").when(again, "duplicate_task_id").when(~F.coalesce(F.col("status").isin("pass", "concern", "fail"), F.lit(False)), "unknown_status").when(F.col("findings").isNull(), "findings_not_a_list")
    return df.withColumn("code", code)


def file_index(spark: SparkSession, folder: str, suffix: str = "pdf") -> tuple[DataFrame, DataFrame]:
    """(first, duplicates): files by case-folded stem; the first path of a stem is the file, the rest are issues."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*.{suffix}").option("recursiveFileLookup", "true").load(folder).select("path", "length")
    stem = F.lower(F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1))
    ranked = files.withColumn("stem", stem).withColumn("n", F.row_number().over(Window.partitionBy("stem").orderBy("path")))
    return ranked.where("n = 1").drop("n"), ranked.where("n > 1").drop("n")


def checksums(spark: SparkSession, folder: str) -> DataFrame:
    """(path, sha256, size) of every file, for an artifact manifest."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return files.select("path", F.sha2("content", 256).alias("sha256"), F.col("length").alias("size"))


PAGE_ROW = "path string, page_index int, raw_text string, status string, error string, page_count int"
INSPECTION = "path string, page_count int, sample_pages array<int>, readable_pages int, sample_characters int, valid boolean, error string"


def _open_pdf(content: bytes):
    try:
        from pypdf import PdfReader  # optional plug-in
    except ImportError:
        raise RuntimeError("no PDF library is installed") from None
    return PdfReader(io.BytesIO(content)).pages


def _failure(e: Exception) -> str:
    return f"{type(e).__name__}: {e}"


def _pdf_pages(open_pdf):
    def run(batches):
        for pdf in batches:
            for path, content, expected in zip(pdf.path, pdf.content, pdf.expected):
                rows = []
                try:
                    opened = open_pdf(content)
                    n = len(opened)
                    for i in range(n):
                        try:
                            text = opened[i].extract_text() or ""
                            rows.append((path, i, text, "ok" if text.strip() else "blank_native_text", None, n))
                        except Exception as e:  # a page fails alone
                            rows.append((path, i, "", "page_failed", _failure(e), n))
                except Exception as e:
                    n = 1 if expected is None or expected != expected else max(1, int(expected))
                    rows = [(path, i, "", "document_failed", _failure(e), 0) for i in range(n)]
                yield pd.DataFrame(rows, columns=[c.split()[0] for c in PAGE_ROW.split(", ")])

    return run


def pdf_pages(spark: SparkSession, path: str, expected: DataFrame | None = None, open_pdf=_open_pdf) -> DataFrame:
    """One row for each page of each PDF; failures are rows, never lost pages.

    expected: (path, page_count) of a manifest: a document that cannot be opened gives that many failed pages, else one.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    if expected is None:
        files = files.withColumn("expected", F.lit(None).cast("int"))
    else:
        files = files.join(expected.groupBy("path").agg(F.max("page_count").alias("expected")), "path", "left").select("path", "content", "expected")
    return files.mapInPandas(_pdf_pages(open_pdf), PAGE_ROW)


def pdf_inspection(spark: SparkSession, path: str, open_pdf=_open_pdf) -> DataFrame:
    """One row for each PDF: pages, and whether its first, middle and last page have text."""

    def run(batches):
        for pdf in batches:
            rows = []
            for name, content in zip(pdf.path, pdf.content):
                try:
                    opened = open_pdf(content)
                    sample = sorted({0, len(opened) // 2, len(opened) - 1}) if len(opened) else []
                    texts = [(opened[i].extract_text() or "").strip() for i in sample]
                    rows.append((name, len(opened), sample, sum(map(bool, texts)), sum(map(len, texts)), len(opened) > 0, None))
                except Exception as e:
                    rows.append((name, 0, [], 0, 0, False, _failure(e)))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in INSPECTION.split(", ")])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, INSPECTION)


def png_problem(content: bytes) -> str | None:
    """Why ``content`` is no sound 8-bit RGB PNG, or None."""
    if content[:8] != b"\x89PNG\r\n\x1a\n":
        return "signature"
    at, kinds = 8, []
    while at + 12 <= len(content):
        size, kind = struct.unpack(">I4s", content[at : at + 8])
        body = content[at + 8 : at + 8 + size]
        if len(body) < size or at + 12 + size > len(content):
            return "truncated"
        if struct.unpack(">I", content[at + 8 + size : at + 12 + size])[0] != zlib.crc32(kind + body):
            return "checksum"
        if kinds and kind == b"IHDR":
            return "second_header"
        if not kinds and (kind != b"IHDR" or size != 13 or body[8:10] != b"\x08\x02" or 0 in struct.unpack(">II", body[:8])):
            return "header"
        kinds.append(kind)
        at += 12 + size
        if kind == b"IEND":
            return None if b"IDAT" in kinds and not size and at == len(content) else "structure"
    return "truncated" if at < len(content) else "structure"


def png_audit(spark: SparkSession, path: str) -> DataFrame:
    """(path, problem) of every image; null problem: sound."""

    def check(batches):
        for pdf in batches:
            yield pd.DataFrame({"path": pdf.path, "problem": [png_problem(c) for c in pdf.content]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(check, "path string, problem string")


def ocr_pages(lines: DataFrame) -> DataFrame:
    """(doc_id, page_index, lines, raw_text, search_text): a page's lines in order, copies dropped."""
    row = F.struct("line_order", "text", "confidence", "polygon") if "polygon" in lines.columns else F.struct("line_order", "text", "confidence")
    one = lines.groupBy("doc_id", "page_index", "line_order").agg(F.max(row).alias("l"))
    df = one.groupBy("doc_id", "page_index").agg(F.array_sort(F.collect_list("l")).alias("lines"))
    df = df.withColumn("raw_text", F.array_join(F.transform("lines", lambda x: x["text"]), "\n"))
    return df.withColumn("search_text", normalize_search_text(F.col("raw_text")))


def ocr_results(payloads: DataFrame) -> DataFrame:
    """Recognition payloads (rec_texts, rec_scores, rec_polys: parallel arrays) as lines.

    ``problem``: the arrays differ in length, a score is outside [0, 1], or a polygon has not four points.
    """
    n = F.size("rec_texts")
    problem = (
        F.when((n != F.size("rec_scores")) | (n != F.size("rec_polys")), "arrays_differ")
        .when(F.exists("rec_scores", lambda s: s.isNull() | F.isnan(s) | (s < 0) | (s > 1)), "score_out_of_range")
        .when(F.exists("rec_polys", lambda p: (F.size(p) != 4) | F.exists(p, lambda q: F.size(q) != 2)), "polygon_shape")
    )
    zipped = F.transform(F.arrays_zip("rec_texts", "rec_scores", "rec_polys"), lambda x, i: F.struct(i.alias("line_order"), x["rec_texts"].alias("text"), x["rec_scores"].alias("confidence"), x["rec_polys"].alias("polygon")))
    return payloads.withColumn("problem", problem).withColumn("lines", F.when(F.col("problem").isNull(), zipped)).withColumn("raw_text", F.when(F.col("problem").isNull(), F.array_join("rec_texts", "\n")))


def safe_name(doc_id: Column) -> Column:
    """A file name for a document id: 100 characters at most, all but ASCII letters, digits, '_' and '-' replaced
    one by one, and 12 hex digits of its SHA-256."""
    return F.concat(F.left(F.regexp_replace(doc_id, "[^A-Za-z0-9_-]", "_"), F.lit(100)), F.lit("-"), F.substring(F.sha2(doc_id, 256), 1, 12))
