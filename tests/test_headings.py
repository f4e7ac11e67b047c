from pagewright.operators import headings as h


def obs(spark, pages):
    return h.observed(spark.createDataFrame([("d", i, t) for i, t in enumerate(pages)], "doc_id string, page_index int, raw_text string"))


def held(spark, pages):
    return h.entries(obs(spark, pages)).orderBy("page_index", "seq").collect()


def test_inherited_for_one_page_only(spark):
    rows = held(spark, ["Our Operations\nText that runs on.", "Table of Contents\nRegional Brands\nmore prose here.", "only prose on this page.", "and prose again."])
    got = [(r.page_index, r.mode, r.heading_text, r.source_page_index) for r in rows]
    assert got == [(0, "observed", "Our Operations", 0), (1, "inherited", "Our Operations", 0), (1, "observed", "Regional Brands", 1), (2, "inherited", "Regional Brands", 1)] or got == [
        (0, "observed", "Our Operations", 0),
        (1, "observed", "Regional Brands", 1),
        (2, "inherited", "Regional Brands", 1),
    ]


def test_offsets_are_code_points(spark):
    (r, *_) = held(spark, ["😀 x\nItem 7. Risk Factors\nbody"])
    assert (r.source_start, r.source_end, r.kind) == (4, 24, "item")


def one(spark, text):
    return obs(spark, [text]).first().o


def kinds(spark, text):
    return [x["kind"] for x in one(spark, text)["headings"]]


def test_kinds(spark):
    got = kinds(spark, "Item 1A. Risks\nConsolidated Balance Sheets\nNote 4 - Leases\nRisks Related to Our Debt\nWe depend on suppliers.\nIncome Taxes")
    assert got == ["item", "statement", "note", "risk_group", "risk_sentence", "title"]


def test_titles(spark):
    assert kinds(spark, "Cost of Sales\nof Sales Cost\nResearch & Development\nYear-end Results\nYear-To-Date Results\nWord\nSales (net)") == ["title"] * 3


def test_risk_sentence_goes_on_in_the_next_line(spark):
    (h1,) = one(spark, "We depend on our\r\n  suppliers abroad.\nmore prose.")["headings"]
    assert (h1["kind"], h1["heading_text"], h1["source_start"], h1["source_end"]) == ("risk_sentence", "We depend on our\r\n  suppliers abroad.", 0, 37)
    assert kinds(spark, "We depend on our\n\nsuppliers abroad.") == [] and kinds(spark, "We depend on our\n7\nsuppliers abroad.") == []


def test_contents_listing_and_resets(spark):
    listing = "\n".join(f"Chapter about things {i}" for i in range(6))
    assert one(spark, listing)["headings"] == [] and one(spark, listing)["resets"][0]["reason"] == "contents_listing"
    assert [r["reason"] for r in one(spark, "SIGNATURES\nExhibit 10.1\nx")["resets"]] == ["signatures", "exhibit_start"]
    assert [r["reason"] for r in one(spark, "United States\nthe\nSECURITIES AND EXCHANGE COMMISSION")["resets"]] == ["filing_cover"]
    assert one(spark, "\n \n")["resets"][0]["reason"] == "blank_or_navigation_only" == one(spark, "Contents\n12")["resets"][0]["reason"]


def test_candidates_of_contents_pages_and_long_items(spark):
    listing = "\n".join(f"Chapter about things {i}" for i in range(6)) + "\n1. Leases"
    (r,) = h.note_headings(obs(spark, [listing])).collect()
    assert (r.number, r.accepted, r.rejection_reason) == (1, False, "contents_listing")
    # An Item line beyond the limits is no heading and ends no notes region.
    pages = ["Notes to Consolidated Financial Statements\n1. Policies\nItem 8. " + "word " * 70 + "\n2. Leases"]
    assert [x.accepted for x in h.note_headings(obs(spark, pages)).orderBy("source_start").collect()] == [True, True]
    assert h.note_headings(obs(spark, ["Note 7 – " + "Word " * 70])).count() == 0


def test_budget_and_duplicates(spark):
    letters = "Alpha Beta Gamma Delta Epsilon Zeta Theta Kappa Lambda Sigma".split()
    titles = [f"{' '.join(letters)} {w}" for w in "One Two Three Four Five Six Seven Eight".split()]
    rows = held(spark, ["\n".join([*titles, titles[0]])])
    assert sum(len(r.tokens) for r in rows if r.included) <= h.MAX_TOKENS
    assert rows[-1].rejection_reason == "duplicate_heading" and any(r.rejection_reason == "heading_token_cap" for r in rows)


def test_future_pages_do_not_change_earlier_rows(spark):
    pages = ["Our Operations\nx", "prose here.", "Regional Brands\ny"]
    short, long = held(spark, pages[:2]), held(spark, pages)
    assert [tuple(r) for r in short] == [tuple(r) for r in long if r.page_index < 2]


def test_note_chain(spark):
    pages = ["Notes to Consolidated Financial Statements\n1. Accounting Policies\ntext", "3. Gaps\n2. Revenue\n2. Revenue", "Item 8. Other Matters\n3. Leases"]
    rows = h.note_headings(obs(spark, pages)).orderBy("page_index", "source_start").collect()
    assert [(r.number, r.accepted, r.rejection_reason) for r in rows] == [
        (1, True, None),
        (3, False, "nonsequential_note_number"),
        (2, True, None),
        (2, False, "nonsequential_note_number"),
        (3, False, "outside_notes_region"),
    ]


def test_en_dash_note(spark):
    rows = h.note_headings(obs(spark, ["Note 7 – Income Taxes"])).collect()
    assert [(r.kind, r.heading_text) for r in rows] == [("note_en_dash", "Note 7 – Income Taxes")]


def test_empty(spark):
    empty = spark.createDataFrame([], "doc_id string, page_index int, raw_text string")
    assert h.entries(h.observed(empty)).count() == 0 and h.note_headings(h.observed(empty)).count() == 0
