import json
import struct
import zipfile
import zlib

import pytest

from pagewright.sources import readers, writers


def test_marked_pages(spark):
    df = spark.createDataFrame([("a", "# Page 1\nFirst.\n# Page 2\n Second page.\n---\n# Page 3\nx"), ("b", "# Page 2\nx"), ("c", None), ("d", "plain")], "id string, t string")
    pages, issues = readers.split_marked(df, "id", "t")
    assert [(r.page_index, r.page_text) for r in pages.orderBy("page_index").collect()] == [(0, "First."), (1, "Second page.\n---"), (2, "x")]
    assert {(r.id, r.code) for r in issues.collect()} == {("b", "not_contiguous"), ("c", "no_markers"), ("d", "no_markers")}


def test_markdown_folder_and_archive(spark, tmp_path):
    (tmp_path / "in" / "Acme Co").mkdir(parents=True)
    (tmp_path / "in" / "Acme Co" / "2020.md").write_text("﻿# Page 1\nx", encoding="utf-8")
    (tmp_path / "in" / "Acme Co" / "notes.md").write_text("no year")
    with zipfile.ZipFile(tmp_path / "r.zip", "w") as z:
        z.writestr("reports/Beta/2021.md", "﻿text")
        z.writestr("other/Beta/2021.md", "no")
    assert [tuple(r) for r in readers.markdown_reports(spark, str(tmp_path / "in")).collect()] == [("Acme Co", "2020", "# Page 1\nx")]
    assert [tuple(r) for r in readers.zipped_reports(spark, str(tmp_path / "r.zip")).collect()] == [("Beta", "2021", "text")]


def test_jsonl(spark, tmp_path):
    good = tmp_path / "d.jsonl"
    good.write_text('{"doc_id": "a", "pdf_path": "p.pdf", "page_count": 3}\n\n{"doc_id": "b", "page_count": 1}\n')
    docs = {r.doc_id: r for r in readers.load_documents(spark, str(good)).collect()}
    assert docs["a"].source_path == "p.pdf" and docs["b"].page_paths == [] and docs["b"].split == "unspecified"
    bad = tmp_path / "bad.jsonl"
    bad.write_text('{"doc_id": "a"}\n{oops\n[1]\n')
    assert readers.audit_jsonl(spark, str(bad)).count() == 2
    with pytest.raises(Exception):
        readers.load_documents(spark, str(bad)).collect()


def test_configuration(spark, tmp_path):
    (tmp_path / "m.toml").write_text('[[models]]\nid = "a"\nstrategies = ["x"]\n[[models]]\nid = "b"\nenabled = false\n')
    rows = readers.model_table(spark, readers.load_toml(str(tmp_path / "m.toml"))).collect()
    assert [tuple(r) for r in rows] == [("a", True, ["x"]), ("b", False, [])]
    (tmp_path / "s.json").write_text(json.dumps({"reports": [{"company": "A", "year": 2020}, {"company": "A", "year": "2020"}]}))
    with pytest.raises(ValueError):
        readers.selection(str(tmp_path / "s.json"))


def test_file_index_and_checksums(spark, tmp_path):
    for name in ("b/A.pdf", "a/a.pdf", "c.pdf"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(name.encode())
    first, again = readers.file_index(spark, str(tmp_path))
    assert first.count() == 2 and again.count() == 1 and again.first().path.endswith("b/A.pdf")
    assert readers.checksums(spark, str(tmp_path)).where("length(sha256) = 64 and size > 0").count() == 3
    failed = readers.pdf_pages(spark, str(tmp_path / "c.pdf")).first()
    assert failed.status == "document_failed" and failed.error


def png(body=b"\x08\x02\x00\x00\x00"):
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">II", 1, 1) + body) + chunk(b"IDAT", zlib.compress(b"\x00\x00\x00\x00")) + chunk(b"IEND", b"")


def test_png():
    assert readers.png_problem(png()) is None
    assert readers.png_problem(b"x") == "signature" and readers.png_problem(png()[:-3]) == "truncated"
    assert readers.png_problem(png(b"\x10\x02\x00\x00\x00")) == "header"
    assert readers.png_problem(png().replace(b"IDAT", b"IDAX")) == "checksum"


def test_ocr_payload(spark):
    good = (["Net sales", "−5"], [0.9, 1.0], [[[0.0, 0.0]] * 4] * 2)
    rows = [good, (["a"], [0.5, 0.5], [[[0.0, 0.0]] * 4]), (["a"], [1.5], [[[0.0, 0.0]] * 4]), (["a"], [0.5], [[[0.0, 0.0]] * 3])]
    df = spark.createDataFrame(rows, "rec_texts array<string>, rec_scores array<double>, rec_polys array<array<array<double>>>")
    got = readers.ocr_results(df).collect()
    assert [r.problem for r in got] == [None, "arrays_differ", "score_out_of_range", "polygon_shape"] and got[0].raw_text == "Net sales\n−5"


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.0)], "k string, v double")
    writers.write_jsonl(df, str(tmp_path / "out"))
    assert readers.read_jsonl(spark, str(tmp_path / "out"), "k string, v double").collect() == df.collect()
    with pytest.raises(Exception):
        writers.write_jsonl(df, str(tmp_path / "out"))
    with pytest.raises(ValueError):
        writers.write_jsonl(spark.createDataFrame([(float("nan"),)], "v double"), str(tmp_path / "nan"))
    writers.write_json({"b": 1, "a": 2}, str(tmp_path / "m.json"))
    assert (tmp_path / "m.json").read_text().index('"a"') < (tmp_path / "m.json").read_text().index('"b"')
    assert "| a | 1.0 |" in writers.markdown_table(df)
    assert len(writers.fingerprint({"x": 1})) == 64
