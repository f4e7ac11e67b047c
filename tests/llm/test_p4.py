from collections import Counter

from pagewright.llm import p4_repair as p4
from pagewright.llm.perceptron import AveragedPerceptron

WORDS = "interest revenue customer management investment property material building agreement development group operating income covenants year ended annual report liabilities average".split()


def test_perceptron_learns():
    m = AveragedPerceptron()
    for _ in range(5):
        m.learn(["a"], ["x", "y"], "y")
        m.learn(["b"], ["x", "y"], "x")
    m.finish()
    b = m.scores(["b"], ["x", "y"])
    assert b["x"] > b["y"] and m.scores(["unseen"], ["x"]) == {"x": 0.0}


COUNTED = [(w, 400 - 10 * i) for i, w in enumerate(WORDS)]
PLAIN = [p4.Page(["Acme Annual Report", f"The {w} was reviewed by the board of the group,", "which found that it was in good order.", "Item 1. Business", f"More on {w} follows here.", f"Page {k + 1}"], [0.99, 0.9, None, 0.95, 0.9, 0.97], [(100, 30), None, None, None, None, (100, 30)], [False, False, False, True, False, False], k) for k, w in enumerate(WORDS)]
PLAIN += [p4.Page(["Acme Annual Report", "Item 1. Business", f"The {w} was reviewed by the board of the group,", "which was in good order.", "Prepared by the desk", f"{k + 1}"], [0.9] * 6, [(100, 30), (100, 30), None, None, (100, 30), None], [False, True, False, False, False, False], k) for k, w in enumerate(WORDS)]
NUMBERS = [(f"{n:,}", "sales" if n % 2 else "5", "in" if n % 3 else "7") for n in range(1000, 9000, 37)] + [(f"{n}.{n % 9}%", "by", "to") for n in range(10, 99, 3)] + [(f"${n}.5", "of", "and") for n in range(100, 999, 17)] + [("FY18", "in", "was"), ("2015", "in", "with")] * 20 + [(str(n), "4", "7") for n in range(1, 9)] * 4


def editor():
    return p4.train(COUNTED, [("one-time", 9), ("long-term", 8), ("short-term", 7), ("non-current", 6), ("year-long", 5)], PLAIN, NUMBERS)


def test_strokes_make_every_confusion_equal():
    assert all(p4.level(clean) == p4.level(noisy) for clean, noisy in p4.CONFUSIONS)
    for a, b in (("margin", "m@rgin"), ("margin", "rnarg!n"), ("these", "fhese"), ("Accounts", "Accoiints"), ("Page 12 of 30", "Page 1l of 3O"), ("Consolidated", "Consohdated")):
        assert p4.skeleton(a) == p4.skeleton(b)


def test_editor_on_held_out_spoiling():
    """Words that the editor was not trained on, some with three and more misreads; insertions where two letters became one."""
    model = editor()
    held = {"custorners": "customers", "agreernents": "agreements", "invesfments": "investments", "rnaterials": "materials", "reveniie": "revenue", "hmited": "limited", "0perations": "operations", "borrowlngs": "borrowings", "cornrnitrnents": "commitments", "rnan@gernenf": "management", "@clrninisfr@f!on": "administration"}
    for spoilt, printed in held.items():
        assert p4.repair(spoilt, 1, [(printed, 300), (spoilt, 1)], model)[0] == printed
        assert p4.repair(spoilt, 1, [(printed, 300), (spoilt, 1)], AveragedPerceptron()) is None
        assert p4.repair(printed, 300, [(printed, 300), (spoilt, 1)], model) is None
    assert p4.repair("tor", 90, [("for", 100), ("tor", 90)], model) is None  # hardly commoner
    assert p4.repair("ke5tona", 1, [("ke5tona", 1)], model) == ("kestona", 2)  # no candidate, but a digit among letters
    assert p4.operations("h", "li") == [("R:l", "I:i")] and p4.operations("rn", "m") == [("R:m", "N"), ("D", "N")]
    assert p4.align("cornrnitrnents", "commitments") is not None and p4.align("abc", "xyz") is None


def test_numbers():
    model = editor()
    wrong = {("l,128", "5", "5"): "1,128", ("2b.7%", "by", "to"): "26.7%", ("I6.2%", "by", "to"): "16.2%", ("20l5,", "in", "with"): "2015,", ("FYl8", "in", "was"): "FY18"}
    right = [("1,128", "", ""), ("FY18", "", ""), ("1B.", "Item", "Risk"), ("F-28", "", ""), ("404th", "the", "time"), ("|", "4", "5"), ("is", "4", "5"), ("—", "1", "2"), ("basis¹.", "", ""), ("½", "", ""), ("(b)", "", "Risk")]
    assert {t: p4.mend_number(*t, model) for t in wrong} == wrong and [t for t in right if p4.mend_number(*t, model)] == []
    assert all(p4.mend_number(*t, AveragedPerceptron()) is None for t in wrong)


def test_furniture_by_position():
    model = editor()
    lines = ["Head", "Item 1. Business", "The text.", "Head", "more text.", "Foot", "7"]
    strong = (90, 30)
    page = lambda support: p4.Page(lines, [0.9] * 7, support, [False, True] + [False] * 5, 6)
    assert p4.furniture(page([strong, strong, None, strong, None, strong, None]), 7, model) == [True, False, False, False, False, True, True]
    assert p4.furniture(page([strong, strong, None, strong, None, strong, None]), 7, AveragedPerceptron()) == [False] * 7
    assert p4.furniture(p4.Page([], [], [], [], 0), 0, model) == [] and p4.furniture(p4.Page(["", "x y z."], [None] * 2, [None] * 2, [False] * 2, 4), 2, model) == [False, False]


def test_joins():
    model = editor()
    joins = lambda *x: model.best(p4.join_features(*x), ["A", "J"])
    assert joins("invest", "ment", "-", 40, 0) == "J" and joins("year", "end", "-", 0, 9) == "A" and joins("xqu", "zzt", "¬", 0, 0) == "J"
    assert AveragedPerceptron().best(p4.join_features("invest", "ment", "-", 40, 0), ["A", "J"]) == "A"


def scanned(spark, pages):
    lines = [("d", p, i, t) for p, ts in pages.items() for i, t in enumerate(ts)]
    ocr = spark.createDataFrame(lines + lines[:2] + [("d", 0, None, "x"), (None, 0, 0, "x"), ("d", 0, 90, None)], "doc_id string, page_index int, line_order int, text string")
    native = spark.createDataFrame([("d", p, "\n".join(ts)) for p, ts in pages.items()], "doc_id string, page_index int, raw_text string")
    return ocr, native, spark.createDataFrame([], "doc_id string, page_index int, heading_text string")


NAMES = "oak elm ash fir yew box bay fig plum pear lime palm".split()


def test_found(spark):
    def body(w):
        return [f"The management of {w} reviewed the invest-", f"ment property of {w} in the year-", f"end report, and the {w} agreement was signed.", f"The investment and the year-end report of {w} management."]

    pages = {p: ["Acme Annual Report", *body(w), f"Page {p + 1}"] for p, w in enumerate(NAMES)}
    pages[3] = ["Acme Annua1 Report", "The managernent of fir reviewed the invesf-", *body("fir")[1:], "Page 4"]
    got = {tuple(r)[1:] for r in p4.found(*scanned(spark, pages)).collect()}
    kinds = Counter(k for _, _, k in got)
    assert {(p, 0, "furniture") for p in range(12)} <= got and {(p, 5, "furniture") for p in range(12)} <= got and kinds["furniture"] == 24
    assert {(p, 1, "hyphen_break") for p in range(12)} <= got and not any(k == "hyphen_break" and i == 2 for _, i, k in got)
    assert {(3, 0, "misread"), (3, 1, "misread")} == {x for x in got if x[2] == "misread"}


def test_the_editor_decides(spark):
    """What an untrained editor finds: nothing."""
    pages = {p: ["Acme Annual Report", f"The management of {w} reviewed the invest-", f"ment property and the managernent of {w}.", f"Page {p + 1}"] for p, w in enumerate(NAMES)}
    assert p4.found(*scanned(spark, pages), untrained=True).count() == 0 < p4.found(*scanned(spark, pages)).count()


def test_repaired_pages(spark):
    def body(w):
        return [f"The management of {w} reviewed the invest-", f"ment property and found {w}", "no weakness.", "", f"The investment agreement of {w} management was signed."]

    pages = {p: ["Acme Annual Report", *body(w), str(p + 1)] for p, w in enumerate(NAMES)}
    pages[2] = ["Acme Annual Report", "The managernent of ash reviewed the invest-", *body("ash")[1:], "3"]
    text = {r.page_index: r.text for r in p4.repaired(*scanned(spark, pages)).collect()}
    for p, w in ((1, "elm"), (2, "ash")):
        assert text[p] == f"The management of {w} reviewed the investment property and found {w} no weakness.\n\nThe investment agreement of {w} management was signed."


def test_empty(spark):
    assert p4.found(*scanned(spark, {})).where("doc_id = 'd' and line_order < 90").count() == 0
