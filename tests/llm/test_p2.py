import pytest

from pagewright.llm import p2_lookalikes as p2


def canon(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "value string")
    return {r.value: r.canonical for r in p2.canonical_values(df).collect()}


PAIRS = [
    ("revenue", "rеvenue"),  # Cyrillic e
    ("2018", "２０１８"),
    ("profit", "proﬁt"),
    ("Réunion", "Réunion"),
    ("Trust", "Tr⁠ust"),
    ("in October", "in​ October"),
    ("in October", "in October"),
    ("expenses", "ｅｘｐｅｎｓｅѕ"),
    ("Café", "Cafе́"),
]


def test_look_alikes_fall_together(spark):
    got = canon(spark, [x for pair in PAIRS for x in pair])
    assert {b: got[b] for _, b in PAIRS} == {b: a for a, b in PAIRS}
    assert all(got[a] == a for a, _ in PAIRS)


def test_without_a_clean_member_the_mapped_form_is_canonical(spark):
    assert canon(spark, ["Tr⁠ust", "Trus​t"]) == {"Tr⁠ust": "Trust", "Trus​t": "Trust"}


@pytest.mark.parametrize("text", ["é", "Λιμένας", "Северный", "x²", "½", "Ferrolin™", "£5", "€5", "•", "“q”", "a–b", "a\tb", "a  b", "naïve", "straße", ""])
def test_not_disguised(spark, text):
    assert canon(spark, [text]) == {text: text}


def test_accents_and_case_are_kept_apart(spark):
    got = canon(spark, ["resume", "résumé", "Resume"])
    assert len(set(got.values())) == 3


def test_questions_and_pairs(spark):
    q = spark.createDataFrame([("t1", "d", "net sales?"), ("t2", "d", "nеt sales?"), ("t2", "d", "nеt sales?"), ("t3", "d", None), ("t4", "d", " "), ("t5", "e", "net sales?"), ("t6", "d", "net sales?")], "task_id string, doc_id string, question string")
    pages = spark.createDataFrame([("d", 0, "thе text of a page", "native_pdf_text"), ("d", 0, None, "native_pdf_text"), ("d", 1, "thе text", "ocr_text"), ("d", 2, "plain Λιμένας", "native_pdf_text")], "doc_id string, page_index int, raw_text string, representation string")
    heads = spark.createDataFrame([], "doc_id string, page_index int, heading_text string")
    common = spark.createDataFrame([("en", "the")], "lang string, word string")
    got = {tuple(r) for r in p2.found(pages, heads, common, q).collect()}
    assert got == {("page", "d", "0"), ("question", "t2", ""), ("pair", "t1", "t2"), ("pair", "t2", "t6")}


def test_canonical_member_is_the_commonest_clean_value(spark):
    """Not the map: it keeps the weightless character and leaves the accent apart."""
    df = spark.createDataFrame([("re\x01port", 1), ("report", 5), ("rерort", 2), ("cafe\u0301", 1), ("café", 3)], "value string, n int")
    got = {r.value: r.canonical for r in p2.canonical_values(df).collect()}
    assert got == {"re\x01port": "report", "report": "report", "rерort": "report", "cafe\u0301": "café", "café": "café"}
    mapped = {r[0]: r[1] for r in df.select("value", p2.look_alike_map(p2.F.col("value"))).collect()}
    assert mapped["re\x01port"] == "re\x01port" != got["re\x01port"] and mapped["cafe\u0301"] != got["cafe\u0301"]
    # Counts decide, and equal counts go by code point.
    flip = spark.createDataFrame([("re\x01port", 9), ("report", 5), ("a\x01b", 1), ("ab", 1)], "value string, n int")
    assert {r.value: r.canonical for r in p2.canonical_values(flip).collect()} == {"re\x01port": "re\x01port", "report": "re\x01port", "a\x01b": "a\x01b", "ab": "a\x01b"}


def test_zeros_inside_numbers(spark):
    assert canon(spark, ["2О24", "10о", "О", "5а"]) == {"2О24": "2024", "10о": "100", "О": "О", "5а": "5а"}


def test_question_classes(spark):
    q = spark.createDataFrame([("t1", "d", "net sales?"), ("t2", "d", "nеt sales?"), ("t3", "d", "net sales?"), ("t4", "d", "other?"), ("t5", "d", None)], "task_id string, doc_id string, question string")
    assert {(r.task_id, r.alike, r.spellings) for r in p2.question_classes(q).collect()} == {("t1", 3, 2), ("t2", 3, 2), ("t3", 3, 2), ("t4", 1, 1)}


def test_texts_are_rebuilt(spark):
    t = "nеt  sales\r\n２０１８\tplain  x"
    df = spark.createDataFrame([(1, t), (2, "plain"), (3, None), (4, "")], "i int, text string")
    got = {r.i: r.canonical for r in p2.canonical_texts(df, "i").collect()}
    assert got == {1: "net  sales\r\n2018\tplain  x", 2: "plain", 3: None, 4: ""}


def test_empty(spark):
    assert canon(spark, []) == {} and canon(spark, [None]) == {}
