"""Queries of the audit, selection, planning and metric operators, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from pagewright.functions import metrics
from pagewright.functions.text import is_blank
from pagewright.operators import audit, datasets, pages, planning
from pagewright.plans import sqltext as S
from pagewright.plans.ranking import _labels, _pages, _queries, _with
from pagewright.sources import readers
from pagewright.sources.tables import table

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return register


def _docs(spark, d):
    return pages.newest_documents(table(spark, d, "doc_records"))


def _tasks(spark, d):
    """Questions with their evidence, one row per stored row pair."""
    q = table(spark, d, "retrieval_queries", "task_id", "doc_id", "question").distinct()
    e = table(spark, d, "evidence_labels", "task_id", "doc_id", "evidence_pages").distinct()
    return q.join(e, ["task_id", "doc_id"], "left")


_TASKS = "tasks AS (SELECT q.task_id, q.doc_id, q.question, e.evidence_pages FROM (SELECT DISTINCT task_id, doc_id, question FROM retrieval_queries) q LEFT JOIN (SELECT DISTINCT task_id, doc_id, evidence_pages FROM evidence_labels) e USING (task_id, doc_id))"


@query(_with(S.PAGES) + "SELECT doc_id, page_index, md5(raw_text) AS text_md5, status FROM pages")
def page_relation(spark, d):
    return _pages(spark, d).select("doc_id", "page_index", F.md5("raw_text").alias("text_md5"), "status")


@query(_with(S.DOCS) + "SELECT doc_id, dataset, page_count, split, coalesce(source_path, pdf_path) AS path FROM docs")
def newest_documents(spark, d):
    return _docs(spark, d).select("doc_id", "dataset", "page_count", "split", F.coalesce("source_path", "pdf_path").alias("path"))


@query(_with(S.QUERIES) + "SELECT * FROM qs")
def query_allow_list(spark, d):
    return _queries(spark, d)


@query(_with(S.LABELS) + "SELECT task_id, doc_id, array_to_string(evidence_pages, ',') AS evidence_pages FROM labels")
def label_projection(spark, d):
    return _labels(spark, d).select("task_id", "doc_id", F.array_join(F.col("evidence_pages").cast("array<string>"), ",").alias("evidence_pages"))


@query("SELECT task_id, array_to_string(list_transform(evidence_pages, lambda p: p + 1), ',') AS one_based FROM (SELECT DISTINCT task_id, doc_id, evidence_pages FROM evidence_labels WHERE evidence_pages IS NOT NULL)")
def page_offsets(spark, d):
    e = table(spark, d, "evidence_labels").distinct().where("evidence_pages is not null")
    return e.select("task_id", F.array_join(F.transform("evidence_pages", lambda p: (p + 1).cast("string")), ",").alias("one_based"))


# Formats of numbers as the metrics read them; see _number_sql below.
_WIDE = "[" + S.SPACE.replace("{", "{{").replace("}", "}}") + "]"


def _number_sql(c: str, space: str = r"\s") -> str:
    whole = f"regexp_extract({c}, '[-+]?\\(?\\$?{space}*([0-9][0-9,]*(?:\\.[0-9]+)?){space}*\\)?', {{}})"
    v = f"try_cast(replace({whole.format(1)}, ',', '') AS DOUBLE)"
    w = whole.format(0)
    return f"CASE WHEN {w} = '' THEN NULL WHEN starts_with(ltrim({w}), '-') OR (contains({w}, '(') AND contains({w}, ')')) THEN -{v} ELSE {v} END"


_MANIFEST = _with(
    _TASKS,
    "stored AS (SELECT coalesce(source_path, pdf_path) AS path FROM doc_records WHERE source_format = 'pdf')",
    "first AS (SELECT doc_id, arg_max(page_count, ({'a': registered_at, 'b': page_count})) AS page_count FROM (SELECT doc_id, coalesce(registered_at, TIMESTAMP '0001-01-01') AS registered_at, coalesce(page_count, -1) AS page_count FROM doc_records) GROUP BY doc_id)",
    "known AS (SELECT t.*, nullif(f.page_count, -1) AS page_count FROM tasks t JOIN first f USING (doc_id))",
)
_MANIFEST_ISSUES = f"""
SELECT 'duplicate_doc_id' AS code, 'document' AS entity, doc_id AS id FROM (SELECT doc_id FROM doc_records GROUP BY doc_id HAVING count(*) > 1)
UNION ALL SELECT 'duplicate_task_id', 'task', task_id FROM (SELECT task_id FROM tasks GROUP BY task_id HAVING count(*) > 1)
UNION ALL SELECT 'empty_doc_id', 'document', doc_id FROM doc_records WHERE NOT {S.not_blank('doc_id')}
UNION ALL SELECT 'invalid_page_count', 'document', doc_id FROM doc_records WHERE page_count IS NULL OR page_count <= 0
UNION ALL SELECT 'missing_source_path', 'document', doc_id FROM doc_records WHERE coalesce(source_path, pdf_path, '') = ''
UNION ALL SELECT 'not_ocr_input_ready', 'document', doc_id FROM doc_records WHERE source_format IS NULL OR source_format <> 'pdf'
UNION ALL SELECT 'orphan_task', 'task', task_id FROM tasks WHERE doc_id NOT IN (SELECT doc_id FROM first)
UNION ALL SELECT 'empty_question', 'task', task_id FROM known WHERE NOT {S.not_blank('question')}
UNION ALL SELECT 'empty_evidence_pages', 'task', task_id FROM known WHERE evidence_pages IS NULL OR len(evidence_pages) = 0
UNION ALL SELECT 'duplicate_evidence_page', 'task', task_id FROM known WHERE len(evidence_pages) <> len(list_distinct(evidence_pages))
UNION ALL SELECT 'empty_answers', 'task', task_id FROM known WHERE question IS NULL OR {_number_sql('question', _WIDE)} IS NULL
UNION ALL SELECT 'missing_source_file', 'document', doc_id FROM doc_records WHERE coalesce(source_path, pdf_path) <> '' AND coalesce(source_path, pdf_path) NOT IN (SELECT path FROM stored WHERE path IS NOT NULL)
UNION ALL SELECT 'invalid_evidence_page', 'task', task_id FROM known WHERE len(list_filter(evidence_pages, lambda p: p IS NULL OR p < 0 OR p >= page_count)) > 0"""


def _issues(spark, d):
    """The questions' first numbers stand for answers, and the paths of the PDF records for the files that exist."""
    docs = table(spark, d, "doc_records")
    answer = metrics.parse_number(F.col("question"))
    tasks = _tasks(spark, d).withColumn("task_type", F.lit("question_answering")).withColumn("answers", F.when(answer.isNotNull(), F.array(datasets.answer_text(answer))))
    files = docs.where("source_format = 'pdf'").select(F.coalesce("source_path", "pdf_path").alias("path"))
    return audit.manifest_issues(docs, tasks, files)


@query(_MANIFEST + _MANIFEST_ISSUES)
def audit_manifest(spark, d):
    return _issues(spark, d)


@query(_MANIFEST + f"SELECT code, count(*) AS count FROM ({_MANIFEST_ISSUES}) GROUP BY code")
def audit_issue_histogram(spark, d):
    return audit.histogram(_issues(spark, d))


@query(_MANIFEST + f"SELECT count(*) FILTER (code <> 'not_ocr_input_ready') AS blocking, count(*) FILTER (code = 'not_ocr_input_ready') AS warnings, count(*) FILTER (code <> 'not_ocr_input_ready') = 0 AS ready FROM ({_MANIFEST_ISSUES})")
def audit_gate(spark, d):
    return audit.gate(_issues(spark, d))


@query("SELECT doc_id, page_index, count(*) AS count FROM native_pages GROUP BY ALL HAVING count(*) > 1")
def audit_duplicate_pages(spark, d):
    return audit.duplicates(table(spark, d, "native_pages"), "doc_id", "page_index")


_DIST = " UNION ALL ".join(f"SELECT '{n}' AS field, coalesce(CAST({e} AS VARCHAR), 'unspecified') AS value, count(*) AS count FROM {t} GROUP BY ALL" for n, e, t in (("dataset", "dataset", "doc_records"), ("split", "split", "doc_records"), ("source_format", "source_format", "doc_records"), ("sector", "metadata['sector']", "doc_records"), ("status", "status", "native_pages"), ("evidence_count", "len(evidence_pages)", "evidence_labels")))


@query(_DIST)
def audit_distributions(spark, d):
    docs, p, e = table(spark, d, "doc_records"), table(spark, d, "native_pages"), table(spark, d, "evidence_labels")
    parts = [audit.distribution(docs, c, c) for c in ("dataset", "split", "source_format")]
    parts += [audit.distribution(docs, F.col("metadata")["sector"], "sector"), audit.distribution(p, "status", "status")]
    n = F.when(F.col("evidence_pages").isNotNull(), F.size("evidence_pages"))
    return audit.union([*parts, audit.distribution(e, n, "evidence_count")])


@query(_with(S.DOCS, "s AS (SELECT page_count AS v, row_number() OVER (ORDER BY page_count) - 1 AS i, count(*) OVER () AS n FROM docs WHERE page_count IS NOT NULL)") + "SELECT q AS quantile, v AS value FROM s, (VALUES ('min', 0.0), ('p25', 1.0), ('median', 2.0), ('p75', 3.0), ('max', 4.0)) w(q, k) WHERE i = CASE q WHEN 'min' THEN 0 WHEN 'max' THEN n - 1 WHEN 'p25' THEN n // 4 WHEN 'median' THEN n // 2 ELSE 3 * n // 4 END")
def page_count_quantiles(spark, d):
    return audit.index_quantiles(_docs(spark, d), "page_count")


@query(_with(S.PAGES, S.DOCS) + "SELECT d.doc_id, d.page_count AS expected, coalesce(p.n, 0) AS present, coalesce(p.lo = 0 AND p.hi = p.n - 1 AND p.n = d.page_count, false) AS contiguous FROM docs d LEFT JOIN (SELECT doc_id, count(*) AS n, min(page_index) AS lo, max(page_index) AS hi FROM pages GROUP BY doc_id) p USING (doc_id)")
def audit_contiguity(spark, d):
    return audit.contiguity(_pages(spark, d), _docs(spark, d))


@query(
    _with(S.PAGES)
    + """SELECT doc_id, count(*) AS pages, count(*) FILTER (status = 'ok') AS ok_pages, count(*) FILTER (status = 'blank_native_text') AS blank_pages,
  count(*) FILTER (status IN ('page_failed', 'document_failed')) AS failed_pages, CAST(sum(length(raw_text)) AS BIGINT) AS characters,
  coalesce(string_agg(CASE WHEN status = 'blank_native_text' THEN CAST(page_index AS VARCHAR) END, ',' ORDER BY page_index), '') AS blank_page_list,
  coalesce(string_agg(CASE WHEN status IN ('page_failed', 'document_failed') THEN CAST(page_index AS VARCHAR) END, ',' ORDER BY page_index), '') AS failed_page_list FROM pages GROUP BY doc_id"""
)
def extraction_summary(spark, d):
    return audit.extraction_summary(_pages(spark, d))


@query(
    " UNION ALL ".join(
        f"SELECT DISTINCT '{code}' AS code, doc_id, page_index FROM native_pages WHERE {cond}"
        for code, cond in (
            ("negative_page", "page_index < 0"),
            ("not_zero_based", "page_index_base <> 0"),
            ("checksum_mismatch", "document_sha256 <> expected_document_sha256"),
            ("ok_without_text", f"NOT {S.not_blank('raw_text')} AND status = 'ok'"),
            ("text_without_ok", f"{S.not_blank('raw_text')} AND status <> 'ok'"),
            ("wrong_character_count", "raw_text IS NOT NULL AND coalesce(raw_character_count, -1) <> length(raw_text)"),
        )
    )
)
def cached_page_issues(spark, d):
    return audit.cached_page_issues(table(spark, d, "native_pages"))


@query(
    """SELECT 'report_without_tasks' AS code, doc_id AS key FROM (SELECT DISTINCT doc_id FROM doc_records WHERE doc_id NOT IN (SELECT doc_id FROM retrieval_queries WHERE doc_id IS NOT NULL))
UNION ALL SELECT 'tasks_without_report', doc_id FROM (SELECT DISTINCT doc_id FROM retrieval_queries WHERE doc_id NOT IN (SELECT doc_id FROM doc_records WHERE doc_id IS NOT NULL))
UNION ALL SELECT 'customer_without_orders', CAST(c_custkey AS VARCHAR) FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)"""
)
def keys_without_match(spark, d):
    docs, q = table(spark, d, "doc_records", "doc_id"), table(spark, d, "retrieval_queries", "doc_id")
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("k"))
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("k"))
    row = lambda df, code, k: df.where(F.col(k).isNotNull()).select(F.lit(code).alias("code"), F.col(k).cast("string").alias("key"))
    return row(audit.without_match(docs, q, "doc_id"), "report_without_tasks", "doc_id").unionByName(row(audit.without_match(q, docs, "doc_id"), "tasks_without_report", "doc_id")).unionByName(row(audit.without_match(c, o, "k"), "customer_without_orders", "k"))


@query(_with(_TASKS, S.DOCS) + "SELECT t.doc_id, t.pages, t.n_pages, CASE WHEN d.page_count IS NULL THEN 'unknown_document' WHEN coalesce(d.source_path, d.pdf_path) IS NULL THEN 'missing_source' WHEN NOT ends_with(lower(coalesce(d.source_path, d.pdf_path)), '.pdf') THEN 'not_a_pdf' WHEN t.lo < 0 OR t.hi >= d.page_count THEN 'page_out_of_range' END AS blocker FROM (SELECT doc_id, string_agg(CAST(p AS VARCHAR), ',' ORDER BY p) AS pages, CAST(count(*) AS INTEGER) AS n_pages, min(p) AS lo, max(p) AS hi FROM (SELECT DISTINCT doc_id, unnest(evidence_pages) AS p FROM tasks) WHERE p IS NOT NULL GROUP BY doc_id) t LEFT JOIN docs d USING (doc_id)")
def render_plan(spark, d):
    return audit.render_plan(_tasks(spark, d), _docs(spark, d))


@query(_with(_TASKS, S.PAGES) + "SELECT t.task_id, t.doc_id, CAST(count(*) AS INTEGER) AS n_pages, md5(string_agg(p.raw_text, chr(12) ORDER BY t.page_index)) AS packet_md5 FROM (SELECT DISTINCT task_id, doc_id, unnest(evidence_pages) AS page_index FROM tasks) t JOIN pages p USING (doc_id, page_index) GROUP BY ALL")
def evidence_packets(spark, d):
    """The texts of each question's evidence pages, in page order."""
    t = _tasks(spark, d).select("task_id", "doc_id", F.explode(F.array_distinct("evidence_pages")).alias("page_index"))
    p = t.join(_pages(spark, d), ["doc_id", "page_index"]).distinct()
    texts = F.transform(F.array_sort(F.collect_list(F.struct("page_index", "raw_text"))), lambda x: x["raw_text"])
    return p.groupBy("task_id", "doc_id").agg(F.count("*").cast("int").alias("n_pages"), F.md5(F.array_join(texts, "\x0c")).alias("packet_md5"))


# Planning. --------------------------------------------------------------------------------
_WINDOWS = _with(
    S.DOCS,
    "sized AS (SELECT doc_id, page_count, least(s, page_count) AS size FROM docs, (VALUES (1), (2), (5), (10), (20), (40)) v(s) WHERE page_count > 0)",
    "windows AS (SELECT DISTINCT doc_id, CAST(start_page AS INTEGER) AS start_page, CAST(start_page + size AS INTEGER) AS end_page FROM (SELECT doc_id, size, unnest([0, page_count - size, (page_count - size) // 2]) AS start_page FROM sized))",
)


@query(_WINDOWS + "SELECT * FROM windows")
def page_windows_plan(spark, d):
    return planning.page_windows(_docs(spark, d))


_MODELS = (("unlimited", True, ("one_shot", "page_by_page")), ("deep", None, ("page_by_page",)), ("off", False, ("native_text",)))


@query(_WINDOWS + "SELECT doc_id, model_id, strategy, start_page, end_page, end_page - start_page AS page_count FROM windows, (VALUES ('unlimited', 'one_shot'), ('unlimited', 'page_by_page'), ('deep', 'page_by_page')) m(model_id, strategy)")
def job_matrix(spark, d):
    docs = _docs(spark, d)
    models = spark.createDataFrame(_MODELS, "id string, enabled boolean, strategies array<string>")
    return planning.job_matrix(docs, models, planning.page_windows(docs))


@query(_with(S.DOCS) + "SELECT DISTINCT doc_id, CAST(unnest([0, page_count // 2, page_count - 1]) AS INTEGER) AS page_index FROM docs WHERE page_count > 0")
def sample_pages(spark, d):
    return planning.sample_pages(_docs(spark, d))


_INVENTORY = """inv AS (SELECT d.doc_id AS doc_name, coalesce(metadata['company'], '') AS company, nullif(metadata['sector'], '') AS sector, try_cast(split_part(d.doc_id, ':', 3) AS INTEGER) AS fiscal_year,
  CASE WHEN source_format = 'pdf' THEN '10k' ELSE '10k_annualreport' END AS doc_type, coalesce(q.n, 0) AS qa_cases, page_count > 0 AS pdf_valid
  FROM docs d LEFT JOIN (SELECT doc_id, count(DISTINCT task_id) AS n FROM retrieval_queries GROUP BY doc_id) q USING (doc_id))"""
_COMPANIES = """co AS (SELECT company, coalesce(min_by(sector, doc_name) FILTER (sector IS NOT NULL), 'Unknown') AS sector, count(DISTINCT fiscal_year) AS years, CAST(sum(qa_cases) AS BIGINT) AS qa_cases,
  count(*) FILTER (qa_cases > 0) AS annotated_documents, count(*) AS documents FROM inv WHERE pdf_valid GROUP BY company)"""
_PILOT = _with(
    S.DOCS,
    _INVENTORY,
    _COMPANIES,
    "r AS (SELECT *, row_number() OVER (PARTITION BY sector ORDER BY qa_cases DESC, annotated_documents DESC, years DESC, company) = 1 AS f FROM co WHERE years >= 3)",
    "ch AS (SELECT * FROM r ORDER BY f DESC, qa_cases DESC, annotated_documents DESC, years DESC, company LIMIT 4)",
    "y AS (SELECT i.*, ch.years AS ny, dense_rank() OVER (PARTITION BY i.company ORDER BY fiscal_year) - 1 AS yi FROM inv i JOIN ch USING (company) WHERE pdf_valid)",
    "b AS (SELECT *, row_number() OVER (PARTITION BY company, fiscal_year ORDER BY qa_cases DESC, doc_type <> '10k', doc_name) AS n FROM y WHERE yi IN (0, ny // 2, ny - 1))",
)


def _inventory(spark, d):
    n = table(spark, d, "retrieval_queries", "doc_id", "task_id").groupBy("doc_id").agg(F.countDistinct("task_id").alias("qa_cases"))
    meta = F.from_json("metadata_json", "map<string,string>")
    docs = _docs(spark, d).withColumn("m", meta).join(n, "doc_id", "left")
    return docs.select(
        F.col("doc_id").alias("doc_name"),
        F.coalesce(F.col("m")["company"], F.lit("")).alias("company"),
        F.nullif(F.col("m")["sector"], F.lit("")).alias("sector"),
        F.split_part("doc_id", F.lit(":"), F.lit(3)).try_cast("int").alias("fiscal_year"),
        F.when(F.col("source_format") == "pdf", "10k").otherwise("10k_annualreport").alias("doc_type"),
        F.coalesce("qa_cases", F.lit(0)).alias("qa_cases"),
        (F.col("page_count") > 0).alias("pdf_valid"),
        F.col("doc_id").alias("position"),
    )


@query(_with(S.DOCS, _INVENTORY, _COMPANIES) + "SELECT * FROM co")
def company_rollup(spark, d):
    return planning.company_rollup(_inventory(spark, d).where("pdf_valid"))


@query(_PILOT + "SELECT company, fiscal_year, doc_name FROM b WHERE n = 1")
def pilot_selection(spark, d):
    return planning.pilot_selection(_inventory(spark, d), companies=4, per_company=3, least_years=3, strict=False)


@query("SELECT DISTINCT doc_id FROM doc_records WHERE source_format = 'pdf' AND doc_id IN (SELECT doc_id FROM retrieval_queries)")
def selected_reports(spark, d):
    docs = table(spark, d, "doc_records", "doc_id", "source_format").where(F.col("source_format").isin("pdf"))
    return docs.join(table(spark, d, "retrieval_queries", "doc_id"), "doc_id", "left_semi").select("doc_id").distinct()


@query("SELECT task_id, CAST(row_number() OVER (ORDER BY NOT regexp_matches(task_id, '^[0-9]+$'), try_cast(task_id AS DECIMAL(38, 0)), task_id) AS INTEGER) AS position FROM (SELECT DISTINCT task_id FROM retrieval_queries WHERE task_id IS NOT NULL)")
def numeric_aware_order(spark, d):
    return planning.numeric_aware_order(table(spark, d, "retrieval_queries", "task_id").distinct().where("task_id is not null"), "task_id")


# Metrics and review. ------------------------------------------------------------------------
# What case folding does beyond lower case.
_FOLDS = {"ß": "ss", "ſ": "s", "ς": "σ", "ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st"}


def _plain(c: str) -> str:
    out = f"lower({c})"
    for a, b in _FOLDS.items():
        out = f"replace({out}, '{a}', '{b}')"
    return f"trim(regexp_replace({out}, '[{S.SPACE}]+', ' ', 'g'))"


# DuckDB's levenshtein counts bytes: each other character of a pair gets a byte of its own, none of which is left in a lower-case text.
_FREE = S.quote("".join(map(chr, [*range(1, 9), *range(14, 28), 127])) + "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_OTHER = "array_to_string(list_distinct(regexp_extract_all(a || b, '[^\\x00-\\x7f]')), '')"
_CODED = f"SELECT task_id, doc_id, translate(a, o, left({_FREE}, length(o))) AS a, translate(b, o, left({_FREE}, length(o))) AS b FROM (SELECT *, {_OTHER} AS o FROM (SELECT task_id, doc_id, {_plain('question')} AS a, {_plain('prior')} AS b FROM prior))"


def _neighbours(spark, d):
    """Each question with the one before it in its report, as ``prior``."""
    q = table(spark, d, "retrieval_queries", "task_id", "doc_id", "question").distinct().where("question is not null")
    return q.withColumn("prior", F.lag("question").over(Window.partitionBy("doc_id").orderBy("task_id", "question"))).where("prior is not null")


@query("WITH prior AS (SELECT * FROM (SELECT *, lag(question) OVER (PARTITION BY doc_id ORDER BY task_id, question) AS prior FROM (SELECT DISTINCT task_id, doc_id, question FROM retrieval_queries WHERE question IS NOT NULL)) WHERE prior IS NOT NULL) " + f"SELECT task_id, doc_id, round(1.0 - levenshtein(a, b) / greatest(length(a), length(b), 1), 6) AS similarity FROM ({_CODED})")
def edit_similarity(spark, d):
    """Each question, whole, against the one before it in its report."""
    q = _neighbours(spark, d)
    return q.select("task_id", "doc_id", F.round(metrics.edit_similarity(F.col("question"), F.col("prior")), 6).alias("similarity"))


@query(f"SELECT task_id, doc_id, coalesce(abs(x - y) <= greatest(0.01e0 * greatest(abs(x), abs(y)), 0.01e0), false) AS matches FROM (SELECT task_id, doc_id, {_number_sql('prior', _WIDE)} AS x, {_number_sql('question', _WIDE)} AS y FROM (SELECT *, lag(question) OVER (PARTITION BY doc_id ORDER BY task_id, question) AS prior FROM (SELECT DISTINCT task_id, doc_id, question FROM retrieval_queries WHERE question IS NOT NULL)) WHERE prior IS NOT NULL)")
def numeric_match(spark, d):
    """Whether each question and the one before it in its report name the same number."""
    return _neighbours(spark, d).select("task_id", "doc_id", metrics.numeric_match(F.col("prior"), F.col("question"), 0.01).alias("matches"))


_RISK_SQL = _with(
    "c AS (SELECT doc_id, page_index, 1 - avg(confidence) AS disagreement, count(*) FILTER (confidence IS NULL) > 0 AS malformed, count(*) FILTER (regexp_matches(text, '[0-9][A-Za-z]')) / count(*) AS numeric_share, 1 - count(DISTINCT text) / count(*) AS repetition FROM (SELECT DISTINCT doc_id, page_index, line_order, text, confidence FROM ocr_lines) GROUP BY ALL)",
    "k AS (SELECT doc_id, page_index, round(0.4e0 * least(1, greatest(0, coalesce(disagreement, 0))) + 0.25e0 * CAST(malformed AS INTEGER) + 0.25e0 * numeric_share + 0.1e0 * repetition, 9) AS risk FROM c)",
)


@query(_RISK_SQL + "SELECT doc_id, page_index, risk FROM k")
def page_risk(spark, d):
    """Review risk of every scanned page, from its lines' confidence, figures and repetition."""
    line = table(spark, d, "ocr_lines", "doc_id", "page_index", "line_order", "text", "confidence").distinct()
    c = line.groupBy("doc_id", "page_index").agg(
        (1 - F.avg("confidence")).alias("a"),
        (F.count_if(F.col("confidence").isNull()) > 0).alias("m"),
        (F.count_if(F.col("text").rlike("[0-9][A-Za-z]")) / F.count("*")).alias("n"),
        (1 - F.countDistinct("text") / F.count("*")).alias("r"),
    )
    return c.select("doc_id", "page_index", F.round(metrics.page_risk(F.coalesce("a", F.lit(0.0)), F.col("m"), F.col("n"), F.col("r")), 9).alias("risk"))


@query(_RISK_SQL + "SELECT doc_id, page_index, risk FROM k WHERE risk >= 0.2")
def review_pages(spark, d):
    return page_risk(spark, d).where("risk >= 0.2")


@query("SELECT doc_id, page_index, CAST(count(*) AS INTEGER) AS lines, md5(string_agg(text, chr(10) ORDER BY line_order)) AS text_md5 FROM (SELECT DISTINCT doc_id, page_index, line_order, text FROM ocr_lines) GROUP BY ALL")
def ocr_payload(spark, d):
    line = table(spark, d, "ocr_lines", "doc_id", "page_index", "line_order", "text", "confidence", "polygon")
    return readers.ocr_pages(line).select("doc_id", "page_index", F.size("lines").alias("lines"), F.md5("raw_text").alias("text_md5"))


@query("SELECT doc_id, page_index, CASE WHEN md5(raw_text) = text_md5 THEN 'same' ELSE 'differs' END AS joined FROM (SELECT doc_id, page_index, max(raw_text) AS raw_text FROM native_pages WHERE representation = 'ocr_text' AND raw_text IS NOT NULL GROUP BY ALL) JOIN (SELECT doc_id, page_index, md5(string_agg(text, chr(10) ORDER BY line_order)) AS text_md5 FROM (SELECT DISTINCT doc_id, page_index, line_order, text FROM ocr_lines) GROUP BY ALL) USING (doc_id, page_index)")
def ocr_payload_check(spark, d):
    p = table(spark, d, "native_pages").where("representation = 'ocr_text' and raw_text is not null").groupBy("doc_id", "page_index").agg(F.max("raw_text").alias("raw_text"))
    return p.join(ocr_payload(spark, d), ["doc_id", "page_index"]).select("doc_id", "page_index", F.when(F.md5("raw_text") == F.col("text_md5"), "same").otherwise("differs").alias("joined"))


@query("SELECT doc_id, left(regexp_replace(doc_id, '[^A-Za-z0-9_-]', '_', 'g'), 100) || '-' || substr(sha256(doc_id), 1, 12) AS file_name FROM (SELECT DISTINCT doc_id FROM doc_records)")
def safe_file_names(spark, d):
    return table(spark, d, "doc_records", "doc_id").distinct().select("doc_id", readers.safe_name(F.col("doc_id")).alias("file_name"))


# Marked text. -------------------------------------------------------------------------------
def _marked_reports(spark, d):
    """(doc_id, text): every report as one text of '# Page N' lines and pages; empty without pages.

    A page before the first is marked 0, which no report may count from.
    """
    number = F.greatest(F.col("page_index") + 1, F.lit(0))
    page = F.struct("page_index", F.concat(F.lit("# Page "), number, F.lit("\n"), "raw_text").alias("t"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(page)), lambda x: x["t"]), "\n").alias("text")
    joined = _pages(spark, d).groupBy("doc_id").agg(text)
    known = table(spark, d, "doc_records", "doc_id").where("doc_id is not null").distinct()
    return joined.join(known, "doc_id", "full").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))


_COUNTED = "counted AS (SELECT doc_id, min(page_index) = 0 AND max(page_index) = count(*) - 1 AS whole FROM pages GROUP BY doc_id)"


@query(_with(S.PAGES, _COUNTED) + f"SELECT doc_id, page_index, md5(regexp_replace(raw_text, '^[{S.SPACE}]+|[{S.SPACE}]+$', '', 'g')) AS text_md5 FROM pages JOIN counted USING (doc_id) WHERE whole")
def split_marked_pages(spark, d):
    p = readers.split_marked(_marked_reports(spark, d), "doc_id", "text")[0]
    return p.select("doc_id", "page_index", F.md5("page_text").alias("text_md5"))


@query(_with(S.PAGES, S.DOCS, _COUNTED) + "SELECT doc_id, CASE WHEN whole IS NULL THEN 'no_markers' ELSE 'not_contiguous' END AS code FROM (SELECT doc_id FROM docs UNION SELECT doc_id FROM pages) LEFT JOIN counted USING (doc_id) WHERE whole IS NOT TRUE")
def split_marked_issues(spark, d):
    return readers.split_marked(_marked_reports(spark, d), "doc_id", "text")[1]


# Annotated datasets. -----------------------------------------------------------------------
_ANNOTATIONS = f"""ann AS (SELECT task_id AS id, split_part(doc_id, ':', 2) AS company, split_part(doc_id, ':', 3) AS year, question, CASE WHEN len(evidence_pages) > 1 THEN 'mixed' WHEN regexp_matches(question, '[0-9]') THEN 'table' ELSE 'text' END AS type,
  list_transform(evidence_pages, lambda p: p + 1) AS page_numbers, {_number_sql('question', _WIDE)} AS answer FROM (SELECT DISTINCT q.task_id, q.doc_id, q.question, e.evidence_pages FROM retrieval_queries q JOIN evidence_labels e USING (task_id, doc_id) WHERE len(e.evidence_pages) > 0)),
rep AS (SELECT doc_id, split_part(doc_id, ':', 2) AS company, split_part(doc_id, ':', 3) AS year, page_count FROM docs)"""


def _annotations(spark, d):
    """Questions with evidence as annotations of a release: pages from one, the question's first number as the answer."""
    q = table(spark, d, "retrieval_queries", "task_id", "doc_id", "question")
    e = table(spark, d, "evidence_labels", "task_id", "doc_id", "evidence_pages").where("size(evidence_pages) > 0")
    part = lambda i: F.split_part("doc_id", F.lit(":"), F.lit(i))
    kind = F.when(F.size("evidence_pages") > 1, "mixed").when(F.col("question").rlike("[0-9]"), "table").otherwise("text")
    return q.join(e, ["task_id", "doc_id"]).distinct().select(
        F.col("task_id").alias("id"), part(2).alias("company"), part(3).alias("year"), "question", kind.alias("type"), F.transform("evidence_pages", lambda p: p + 1).alias("page_numbers"), metrics.parse_number(F.col("question")).alias("answer")
    )


def _reports(spark, d):
    part = lambda i: F.split_part("doc_id", F.lit(":"), F.lit(i))
    return _docs(spark, d).select("doc_id", part(2).alias("company"), part(3).alias("year"), "page_count")


@query(
    _with(
        S.DOCS,
        _ANNOTATIONS,
        "want AS (SELECT DISTINCT company, year FROM ann)",
        "miss AS (SELECT * FROM want WHERE (company, year) NOT IN (SELECT (company, year) FROM rep))",
        "bad AS (SELECT id, len(list_filter(page_numbers, lambda p: p > page_count)) AS n FROM ann JOIN rep USING (company, year))",
        "qs AS (SELECT page_count AS v, row_number() OVER (ORDER BY page_count) - 1 AS i, count(*) OVER () AS n FROM rep WHERE (company, year) IN (SELECT (company, year) FROM want) AND page_count IS NOT NULL)",
    )
    + """SELECT measure, value, CAST(count AS BIGINT) AS count FROM (SELECT 'question_type' AS measure, type AS value, count(*) AS count FROM ann GROUP BY ALL
UNION ALL SELECT 'year', year, count(*) FROM ann GROUP BY ALL
UNION ALL SELECT 'answer_type', CASE WHEN answer IS NULL THEN 'none' WHEN answer = floor(answer) THEN 'whole' ELSE 'fraction' END, count(*) FROM ann GROUP BY ALL
UNION ALL SELECT 'evidence_pages', CAST(len(page_numbers) AS VARCHAR), count(*) FROM ann GROUP BY ALL
UNION ALL SELECT 'annotations', '', count(*) FROM ann UNION ALL SELECT 'reports', '', count(*) FROM rep UNION ALL SELECT 'companies', '', count(DISTINCT company) FROM rep
UNION ALL SELECT 'evidence_page_min', '', min(list_min(page_numbers)) FROM ann UNION ALL SELECT 'evidence_page_max', '', max(list_max(page_numbers)) FROM ann
UNION ALL SELECT 'report_pages_min', '', min(page_count) FROM rep UNION ALL SELECT 'report_pages_max', '', max(page_count) FROM rep
UNION ALL SELECT 'task_documents', '', count(*) FROM want UNION ALL SELECT 'reports_without_tasks', '', count(*) FROM rep WHERE (company, year) NOT IN (SELECT (company, year) FROM want)
UNION ALL SELECT 'missing_report', company || '/' || year, 1 FROM miss UNION ALL SELECT 'invalid_evidence', id, n FROM bad WHERE n > 0
UNION ALL SELECT 'task_document_pages_' || q, '', v FROM qs, (VALUES ('min', 0), ('p25', 1), ('median', 2), ('p75', 3), ('max', 4)) w(q, k) WHERE i = CASE q WHEN 'min' THEN 0 WHEN 'max' THEN n - 1 WHEN 'p25' THEN n // 4 WHEN 'median' THEN n // 2 ELSE 3 * n // 4 END
UNION ALL SELECT 'structurally_valid', '', CAST((SELECT count(*) FROM miss) + (SELECT count(*) FROM bad WHERE n > 0) = 0 AS INTEGER))"""
)
def release_audit(spark, d):
    return datasets.release_audit(_annotations(spark, d), _reports(spark, d))


_CHOSEN = "sel AS (SELECT DISTINCT split_part(doc_id, ':', 2) AS company, split_part(doc_id, ':', 3) AS year FROM doc_records WHERE source_format = 'pdf')"


def _selected(spark, d):
    return table(spark, d, "doc_records", "doc_id", "source_format").where("source_format = 'pdf'").select(F.split_part("doc_id", F.lit(":"), F.lit(2)).alias("company"), F.split_part("doc_id", F.lit(":"), F.lit(3)).alias("year"))


@query(
    _with(S.DOCS, _ANNOTATIONS, _CHOSEN)
    + "SELECT 'longdoc:' || id AS task_id, doc_id, 'question_answering' AS task_type, question, type AS question_type, array_to_string(list_transform(page_numbers, lambda p: p - 1), ',') AS evidence, round(answer, 6) AS answer FROM ann JOIN sel USING (company, year) JOIN rep USING (company, year)"
)
def converted_annotations(spark, d):
    t = datasets.convert_annotations(_annotations(spark, d), _reports(spark, d), _selected(spark, d))[0]
    answer = F.round(F.get("answers", F.lit(0)).cast("double"), 6).alias("answer")  # JSON text, read back
    return t.select("task_id", "doc_id", "task_type", "question", "question_type", F.array_join(F.col("evidence_pages").cast("array<string>"), ",").alias("evidence"), answer)


@query(
    _with(S.DOCS, _ANNOTATIONS, _CHOSEN)
    + """SELECT 'report_without_annotations' AS code, company || '/' || year AS id FROM sel WHERE (company, year) NOT IN (SELECT (company, year) FROM ann)
UNION ALL SELECT 'report_missing', company || '/' || year FROM sel WHERE (company, year) NOT IN (SELECT (company, year) FROM rep)
UNION ALL SELECT 'evidence_beyond_report', id FROM ann JOIN sel USING (company, year) JOIN rep USING (company, year) WHERE list_max(page_numbers) > page_count"""
)
def conversion_issues(spark, d):
    return datasets.convert_annotations(_annotations(spark, d), _reports(spark, d), _selected(spark, d))[1]


_CHECKS = """checks AS (SELECT DISTINCT l.task_id, CASE WHEN l.evidence_pages IS NULL THEN 'fail' WHEN len(l.evidence_pages) = 0 THEN 'concern' ELSE 'pass' END AS status, coalesce(length(l.doc_id) % 2 = 0, false) AS signed, len(l.evidence_pages) <> len(list_distinct(l.evidence_pages)) AS twice FROM evidence_labels l)"""


def _checks(spark, d):
    """Manual checks, made of the labels: null evidence fails, repeated pages are a finding."""
    e, ev = table(spark, d, "evidence_labels", "task_id", "doc_id", "evidence_pages"), F.col("evidence_pages")
    twice = F.size(ev) != F.size(F.array_distinct(ev))
    none = F.array().cast("array<string>")
    return e.select(
        "task_id", F.when(ev.isNull(), "fail").when(F.size(ev) == 0, "concern").otherwise("pass").alias("status"), F.coalesce(F.length("doc_id") % 2 == 0, F.lit(False)).alias("human_signoff"), F.when(twice, F.array(F.lit("repeated_page"))).otherwise(none).alias("finding_codes")
    ).distinct()


@query(
    _MANIFEST.rstrip()
    + ",\n"
    + ",\n".join([S.DOCS, _CHECKS])
    + f""", errs AS (SELECT count(*) AS n FROM ({_MANIFEST_ISSUES}) WHERE code <> 'not_ocr_input_ready'),
facts AS (SELECT (SELECT count(*) FROM docs) AS n, (SELECT count(*) FROM docs WHERE source_format = 'pdf') AS ready, (SELECT min(page_count) FROM docs) AS lo, (SELECT max(page_count) FROM docs) AS hi, (SELECT count(*) FROM checks) AS checks,
  (SELECT count(*) FROM checks WHERE status = 'fail') AS fails, (SELECT count(*) FROM checks WHERE NOT signed) AS pending, (SELECT n FROM errs) AS errors, (SELECT count(DISTINCT task_id) FROM checks WHERE task_id NOT IN (SELECT task_id FROM tasks WHERE task_id IS NOT NULL)) AS stray),
blockers AS (SELECT 'blocker' AS measure, 'unknown_task' AS value, stray AS count FROM facts WHERE stray > 0 UNION ALL SELECT 'blocker', 'manifest_validation_failed', errors FROM facts WHERE errors > 0
  UNION ALL SELECT 'blocker', 'source_pdfs_unavailable', 0 UNION ALL SELECT 'blocker', 'pilot_not_ocr_ready', n - ready FROM facts WHERE ready < n
  UNION ALL SELECT 'blocker', 'manual_ground_truth_failures', fails FROM facts WHERE fails > 0 UNION ALL SELECT 'blocker', 'researcher_signoff_pending', pending FROM facts WHERE pending > 0)
SELECT measure, value, CAST(count AS BIGINT) AS count FROM (SELECT * FROM blockers UNION ALL SELECT 'documents', '', n FROM facts UNION ALL SELECT 'page_count_min', '', lo FROM facts UNION ALL SELECT 'page_count_max', '', hi FROM facts UNION ALL SELECT 'checks', '', checks FROM facts
UNION ALL SELECT 'status', CASE WHEN count(*) > 0 THEN 'blocked_before_ocr' ELSE 'ready_for_ocr_dry_run' END, count(*) FROM blockers
UNION ALL SELECT 'check_status', status, count(*) FROM checks GROUP BY ALL UNION ALL SELECT 'finding', 'repeated_page', count(*) FROM checks WHERE twice HAVING count(*) > 0
UNION ALL SELECT 'source_format', coalesce(source_format, 'unspecified'), count(*) FROM docs GROUP BY ALL)"""
)
def phase0_readiness(spark, d):
    return datasets.readiness(_issues(spark, d), _docs(spark, d), _tasks(spark, d), _checks(spark, d), released_pdfs=0)


@query(
    _with(_CHECKS, _TASKS)
    + "SELECT DISTINCT task_id FROM checks WHERE task_id IS NOT NULL AND task_id NOT IN (SELECT task_id FROM tasks WHERE evidence_pages IS NOT NULL AND task_id IS NOT NULL)"
)
def unknown_checks(spark, d):
    """Checks on tasks that have no evidence, as if only the others were in the pilot."""
    return datasets.unknown_checks(_checks(spark, d), _tasks(spark, d).where("evidence_pages is not null")).where("task_id is not null")


@query("SELECT task_id, CASE WHEN question IS NULL THEN 'question' ELSE '' END AS missing, CASE WHEN doc_id LIKE '%1' THEN 'page_hint' ELSE '' END AS extra FROM (SELECT DISTINCT task_id, doc_id, question FROM retrieval_queries WHERE task_id IS NOT NULL AND doc_id IS NOT NULL) WHERE question IS NULL OR doc_id LIKE '%1'")
def key_set_issues(spark, d):
    """Questions as JSON records, of which the reports ending in 1 carry a field too many; nulls are absent."""
    q = table(spark, d, "retrieval_queries", "task_id", "doc_id", "question").distinct().where("task_id is not null and doc_id is not null")
    record = F.to_json(F.struct("task_id", "doc_id", "question", F.when(F.col("doc_id").endswith("1"), F.lit(1)).alias("page_hint")))
    return datasets.key_set_issues(q.withColumn("record", record), "task_id", "record", ["doc_id", "question", "task_id"])


_RAW = """meta AS (SELECT doc_id AS doc_name, nullif(metadata['company'], '') AS company, try_cast(split_part(doc_id, ':', 3) AS INTEGER) AS fiscal_year FROM doc_records),
quest AS (SELECT DISTINCT q.task_id AS source_id, q.doc_id AS doc_name, q.question, e.evidence_pages FROM retrieval_queries q LEFT JOIN evidence_labels e USING (task_id, doc_id)),
files AS (SELECT DISTINCT doc_id || CASE WHEN page_count % 7 = 0 THEN 'x' ELSE '' END AS stem, coalesce(pdf_path, doc_id) AS path, page_count > 1 AS valid FROM doc_records WHERE doc_id IS NOT NULL),
indexed AS (SELECT *, row_number() OVER (PARTITION BY lower(stem) ORDER BY path, valid) AS n FROM files),
joined AS (SELECT m.doc_name, i.valid, i.n FROM meta m LEFT JOIN indexed i ON lower(i.stem) = lower(m.doc_name) AND i.n = 1)"""


@query(
    _with(_RAW)
    + f"""SELECT 'duplicate_pdf_stem' AS code, 'file' AS entity, path AS id FROM indexed WHERE n > 1
UNION ALL SELECT 'duplicate_metadata_doc_name', 'metadata', doc_name FROM meta GROUP BY doc_name HAVING count(*) > 1
UNION ALL SELECT 'empty_doc_name', 'metadata', doc_name FROM meta WHERE NOT {S.not_blank('doc_name')}
UNION ALL SELECT 'invalid_document_metadata', 'metadata', doc_name FROM meta WHERE company IS NULL OR NOT {S.not_blank('company')} OR fiscal_year IS NULL
UNION ALL SELECT 'missing_pdf', 'metadata', doc_name FROM joined WHERE n IS NULL UNION ALL SELECT 'invalid_pdf', 'metadata', doc_name FROM joined WHERE NOT valid
UNION ALL SELECT 'duplicate_source_question_id', 'question', source_id FROM quest WHERE source_id IS NOT NULL GROUP BY source_id HAVING count(*) > 1
UNION ALL SELECT 'question_unknown_document', 'question', source_id FROM quest WHERE doc_name NOT IN (SELECT doc_name FROM meta WHERE doc_name IS NOT NULL) OR doc_name IS NULL
UNION ALL SELECT DISTINCT 'cross_document_evidence', 'question', source_id FROM quest WHERE len(list_filter(evidence_pages, lambda p: p % 5 = 4)) > 0
UNION ALL SELECT 'invalid_question_schema', 'question', source_id FROM quest WHERE NOT {S.not_blank('source_id')} OR NOT {S.not_blank('doc_name')} OR NOT {S.not_blank('question')} OR evidence_pages IS NULL OR len(evidence_pages) = 0 OR len(list_filter(evidence_pages, lambda p: p IS NULL OR p < 0)) > 0
UNION ALL SELECT 'pdf_without_metadata', 'file', stem FROM indexed WHERE n = 1 AND lower(stem) NOT IN (SELECT lower(doc_name) FROM meta WHERE doc_name IS NOT NULL)"""
)
def dataset_issues(spark, d):
    """The stored records as a raw dataset: every seventh file is misnamed, one-page files are broken, and every fifth page is cited from another report."""
    docs = table(spark, d, "doc_records")
    meta = docs.select(F.col("doc_id").alias("doc_name"), F.nullif(F.col("metadata")["company"], F.lit("")).alias("company"), F.split_part("doc_id", F.lit(":"), F.lit(3)).try_cast("int").alias("fiscal_year"))
    stem = F.concat("doc_id", F.when(F.col("page_count") % 7 == 0, "x").otherwise(""))
    files = docs.where("doc_id is not null").select(stem.alias("stem"), F.coalesce("pdf_path", "doc_id").alias("path"), (F.col("page_count") > 1).alias("valid")).distinct()
    page = lambda p: F.struct(p.alias("evidence_page_num"), F.when(p % 5 == 4, F.concat("doc_id", F.lit("-other"))).otherwise(F.col("doc_id")).alias("evidence_doc_name"))
    quest = _tasks(spark, d).distinct().select(F.col("task_id").alias("source_id"), F.col("doc_id").alias("doc_name"), "question", F.transform("evidence_pages", page).alias("evidence"))
    return audit.dataset_issues(meta, quest, files)


@query(
    _PILOT.rstrip()
    + """, pick AS (SELECT company, doc_name FROM b WHERE n = 1), rows AS (SELECT p.*, i.sector, i.qa_cases FROM pick p JOIN inv i USING (doc_name)),
t AS (SELECT count(*) AS n, count(DISTINCT company) AS c, sum(qa_cases) AS q, count(DISTINCT coalesce(sector, 'Unknown')) AS s, count(*) FILTER (coalesce(sector, 'Unknown') = 'Unknown') AS u FROM rows)
SELECT 'pilot_selection_failed' AS code, 'pilot' AS entity, 'pilot' AS id FROM t WHERE c < 4 UNION ALL SELECT 'pilot_has_no_questions', 'pilot', 'pilot' FROM t WHERE n > 0 AND q = 0
UNION ALL SELECT 'limited_sector_coverage', 'pilot', 'pilot' FROM t WHERE n > 0 AND (u > 0 OR s < 4) UNION ALL SELECT 'pilot_reports_without_questions', 'document', doc_name FROM rows WHERE qa_cases = 0"""
)
def pilot_issues(spark, d):
    return audit.pilot_issues(pilot_selection(spark, d), _inventory(spark, d), companies=4)


@query(
    _with(S.PAGES, S.DOCS)
    + """, made AS (SELECT doc_id, count(*) AS n, min(page_index) AS lo, max(page_index) AS hi, count(*) FILTER (status IN ('page_failed', 'document_failed')) AS failed, sum(length(raw_text)) AS made FROM pages GROUP BY doc_id),
summ AS (SELECT doc_id, page_count AS expected_pages, 0 AS failed_pages, c AS characters FROM docs LEFT JOIN (SELECT doc_id, sum(m) AS c FROM (SELECT doc_id, page_index, max(raw_character_count) AS m FROM native_pages WHERE doc_id IS NOT NULL AND page_index IS NOT NULL GROUP BY ALL) GROUP BY doc_id) USING (doc_id)),
x AS (SELECT * FROM summ FULL JOIN made USING (doc_id))
SELECT 'report_without_pages' AS code, doc_id FROM x WHERE n IS NULL UNION ALL SELECT 'pages_without_report', doc_id FROM x WHERE expected_pages IS NULL
UNION ALL SELECT 'incomplete_pages', doc_id FROM x WHERE n <> expected_pages OR lo <> 0 OR hi <> expected_pages - 1 UNION ALL SELECT 'failed_count_differs', doc_id FROM x WHERE failed <> failed_pages
UNION ALL SELECT 'character_count_differs', doc_id FROM x WHERE made <> characters"""
)
def cached_report_issues(spark, d):
    """The pages against a summary of the stored counts, which claims that nothing failed."""
    stored = table(spark, d, "native_pages", "doc_id", "page_index", "raw_character_count").where("doc_id is not null and page_index is not null").groupBy("doc_id", "page_index").agg(F.max("raw_character_count").alias("m")).groupBy("doc_id").agg(F.sum("m").alias("characters"))
    summary = _docs(spark, d).select("doc_id", F.col("page_count").alias("expected_pages"), F.lit(0).alias("failed_pages")).join(stored, "doc_id", "left")
    return audit.cached_report_issues(_pages(spark, d), summary)
