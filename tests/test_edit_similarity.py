"""Question similarity against a Levenshtein distance written out, on whole texts."""

from pagewright.plans import auditing


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def similarity(a, b):
    a, b = (" ".join(t.casefold().split()) for t in (a, b))
    return 1.0 - distance(a, b) / max(len(a), len(b), 1)


def wanted(rows):
    docs, out = {}, {}
    for task, doc, question in sorted(set(rows)):
        docs.setdefault(doc, []).append((task, question))
    for doc, qs in docs.items():
        for (_, a), (task, b) in zip(qs, qs[1:]):
            out.setdefault((task, doc), []).append(round(similarity(b, a), 6))
    return {k: sorted(v) for k, v in out.items()}


def got(df):
    out = {}
    for r in df.collect():
        out.setdefault((r.task_id, r.doc_id), []).append(r.similarity)
    return {k: sorted(v) for k, v in out.items()}


def test_other_letters_differ(spark, tmp_path):
    pairs = [("Café", "Cafü"), ("сash flоw", "cash flow"), ("ﬁnal", "FINAL"), ("２０２４", "２０２５"), ("Straße", "STRASSE"), ("ΟΔΟΣ", "οδος"), ("a b", "a b"), ("é", "е")]
    rows = [(f"t{k}", f"d{i}", q) for i, p in enumerate(pairs) for k, q in enumerate(p)]
    spark.createDataFrame(rows, "task_id string, doc_id string, question string").write.parquet(str(tmp_path / "retrieval_queries.parquet"))
    assert got(auditing.edit_similarity(spark, str(tmp_path))) == wanted(rows)


def test_table(spark, folder):
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/retrieval_queries.parquet").where("question is not null").select("task_id", "doc_id", "question").collect()]
    assert got(auditing.edit_similarity(spark, folder)) == wanted(rows)
