from collections import Counter

import pytest

from pagewright.llm import p5_quality as p5

COMMON = frozenset("the of and a to in is at for which with by on that as are was".split())


def page(text):
    return dict(zip([c.split()[0] for c in p5.FIGURES.split(", ")], p5.page_figures(text, COMMON)))


@pytest.mark.parametrize(
    "line, kind",
    [
        ("", "-"), ("  ", "-"), ("• Head of treasury", "b"), ("(a) Glass works", "b"), ("Test results ........ 5", "d"), ("Goodwill 48.0 44 — 10", "n"),
        ("Goodwill | 5", "n"), ("Deferred tax held by the group 102", "m"), ("The year ended well.", "e"), ("well. The year 2010", "e"), ("Head of treasury", "t"),
    ],
)
def test_line_class(line, kind):
    assert p5.line_class(line.strip()) == kind


def test_figures():
    f = page("The cash of the year.\nThe cash of the year.\n\nno end")
    assert (f["word_count"], f["line_count"], f["duplicate_line_share"], f["classes"]) == (12, 3, 0.3333, "eE-t")
    assert f["end_punctuation_share"] == 0.6667 and f["characters"] == 51 and f["top_2gram_share"] > 0.2
    assert page("")["word_count"] == 0 and page("")["classes"] == "-"
    many = " ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}" for i in range(2000)) + " same words again same words again"
    words = p5.WORD.findall(many)
    total = sum(map(len, words))
    for n, share in zip((2, 3, 4), p5._top_shares(words, total)):
        grams = Counter(zip(*(words[i:] for i in range(n))))
        assert share == round(max(k * sum(map(len, g)) for g, k in grams.items() if k > 1) / total, 4) if max(grams.values()) > 1 else share == 0


PROSE = "The group operates in the north and the south of the country.\nSales were as high as in the year that went before, which\nis a good sign. The board is pleased with that."


def kinds(spark, texts, heads=()):
    pages = spark.createDataFrame([("d", i, t) for i, t in enumerate(texts)] + [("d", 0, texts[0] if texts else None), (None, 1, "x")], "doc_id string, page_index int, raw_text string")
    heads = spark.createDataFrame(list(heads), "doc_id string, page_index int, heading_text string")
    common = spark.createDataFrame([("en", w) for w in COMMON], "lang string, word string")
    return {r.page_index: r.kind for r in p5.kinds(pages, heads, common).collect()}


def test_kinds(spark):
    texts = [
        PROSE,
        "\n".join(["• Head of treasury", "• Glass works", "• Vendor list"]),
        "\n".join(f"{w} 5.1 {i}" for i, w in enumerate(["Goodwill", "Provisions", "Licences", "Coatings"])),
        "\n".join(["zzkt bxrw fghj kltn"] * 3),
        "\n".join(["The same sentence is here again."] * 8),
        "\n".join(["on is is moderate a to the that", "the of and a cash in in"] * 3),
        "\n".join(["Head of treasury", "Glass works", "Vendor list", "Chief engineer"]),
        PROSE + "\nGoodwill 5 6\nCoatings 7 8",
        None,
        "  ",
    ]
    assert kinds(spark, texts) == {0: "prose", 1: "list", 2: "table", 3: "junk", 4: "junk", 5: "junk", 6: "list", 7: "prose"}


def test_furniture_and_headings_do_not_count(spark):
    foot = "\nStrategy  Governance\nNotes 5 6\nImprint 7 8\nReport 2020 1"
    words = ["oak", "elm", "ash", "fir", "yew"]
    texts = ["\n".join(f"The {w} of {x}" for x in PROSE.split("\n")) + foot for w in words] + [foot.strip(), "Cash Flows\nShort prose is here."]
    got = kinds(spark, texts, [("d", 6, "Cash Flows")])
    assert [got[i] for i in range(5)] == ["prose"] * 5 and got[5] is None and got[6] == "prose"


OWN = "bring carry drive enjoy favor given haste ideal joker knife lemon money novel ocean paper quiet river stone table uncle vivid water young zebra amber berry cider delta eagle fable giant hotel".split()
# A page for each rule that only this rule calls junk.
ONLY = {
    "symbols": "§¶■□ wording ◊†‡= <>*^\n■□◊† phrase ‡=<>*^§¶\n□◊†‡=< letter >*^§¶■",
    "word length": "e r u t i d n e p x e\no u n i t s\nr a t e s u p",
    "vowels": "zzkt bxrw fghj kltn\nprsh mdfg wrtp\nhjkl vbnm qrst",
    "function words": "Goodwill provisions licences coatings. Vendors bonds rates.\nTreasury sites cover demand. Board plans apply.",
    "function words together": "moderate the of and is in cash to a the\nvendors in the of which goodwill\nto that the at sites",
    "long tokens": "\n".join("".join(f"{w}{i}" for w in OWN[i : i + 7]) for i in (1, 9, 17)),
    "lines": "\n".join([*(f"{OWN[i]} {OWN[i + 1]} {OWN[i + 2]} {OWN[i + 3]}" for i in (0, 4, 8, 12, 16)), *(f"{OWN[i]} {OWN[i + 1]} {OWN[i + 2]} {OWN[i + 3]}" for i in (0, 4, 8))]),
    "paragraphs": "\n\n".join([" ".join(OWN[:8])] * 6) + "\n\n" + "\n".join(" ".join(OWN[i % 20 + j * 3 % 11] for j in range(8)) + f" {OWN[-1 - i]}" for i in range(12)),
    "top_2gram_share": "\n".join(f"north sales {w}" for w in OWN[:6]),
    "top_3gram_share": "\n".join(f"north sales total {' '.join(OWN[4 * i : 4 * i + 4])}" for i in range(5)),
    "top_4gram_share": "\n".join(f"north sales total again {' '.join(OWN[5 * i : 5 * i + 5])}" for i in range(5)),
}


@pytest.mark.parametrize("rule", p5.JUNK_RULES)
def test_every_rule_decides(spark, rule):
    pages = spark.createDataFrame([("d", 0, ONLY[rule])], "doc_id string, page_index int, raw_text string")
    common = spark.createDataFrame([("en", w) for w in COMMON], "lang string, word string")
    features = p5.page_features(pages, common)
    heads = spark.createDataFrame([], "doc_id string, page_index int, heading_text string")
    assert p5.judged(features, heads).first().kind == "junk"
    assert p5.judged(features, heads, without=frozenset([rule])).first().kind != "junk"


def test_empty(spark):
    assert kinds(spark, []) == {}
