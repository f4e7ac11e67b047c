import pytest
from pyspark.sql import functions as F

from pagewright.llm import p8_residue as p8

CASES = {
    "slot": ["Sales of {{company_name}} rose.", "{{ report.segment }}", "at [[issuer]] end", "<<AUDITOR>> signed", "%%CEO_STATEMENT%%", "@@net_income@@", "${total_assets}", "#{fiscal_year}", "%(issuer)s", "__PERIOD_END__", "{1} note", "[●] legacy", "[INSERT FISCAL YEAR]", "[TO BE COMPLETED: date]", "[Total Assets here]", "[insérer la date]", "[Firmenname einfügen]", "<nom de la société>", "<your issuer>", "<Datum ergänzen>", "«Betrag»", "XX.X% of", "$X,XXX paid"],
    "dummy": ["Lorem ipsum dolor sit", "Laboris elitur lorema veniam.", "Headline goes here.", "Section body to follow.", "Text text text.", "This is sample text.", "Dies ist nur Blindtext zur Ansicht.", "Texte de remplissage en attente.", "Texto de ejemplo pendiente."],
    "message": ["HTTP 502", "Error 403", "Page not found", "Page introuvable", "Seite nicht gefunden", "No se encontró la página", "Access denied", "Session expired", "Too many requests - wait", "Too many requests", "Connection timed out", "Something went wrong", "503 Service Temporarily Unavailable", "El documento solicitado ya no está disponible."],
    "notice": ["Please turn on JavaScript in your browser.", "Veuillez activer JavaScript pour afficher.", "Bitte aktivieren Sie JavaScript.", "Cookies and scripts must be allowed.", "We are checking that you are a person."],
}
CLEAN = [
    "The set {2, 3, 5} was tested.", "footnote [3] gives details", 'The term [the "Issuer"] refers', "sign below: ________________", "Let X be the number; X% of it", "Part XX and Article XXI", "Too many requests for early repayment arrived.",
    "Access was denied by the regulator.", "Sessions expire after 3 minutes.", "pages not found by customers fell", "We hired 250 JavaScript developers.", "The service was unavailable for 66 minutes.", "Placeholder accounts were closed.", "Sample text messages were reviewed.",
    "its 404th outlet", "under Section 404", "Script volumes rose.", "Error rates in the portal declined", "« un mot »", "Use the tag `{{name}}` in letters.", "```\n{{name}}\n```", "In template syntax, write {{name}}.", "", None,
]


def test_kinds(spark):
    rows = [(i, t, k) for i, (k, t) in enumerate((k, t) for k, ts in CASES.items() for t in ts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, kind string")
    got = {r.doc_id: r.residue for r in p8.find(df).collect()}
    assert [(t, got.get(i)) for i, t, k in rows if k not in got.get(i, [])] == []


def test_clean(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(CLEAN)], "doc_id long, text string")
    assert [(CLEAN[r.doc_id], r.residue) for r in p8.find(df).collect()] == []
    assert p8.keep_clean(df).count() == len(CLEAN)


def test_long_text_columns_and_empty(spark):
    df = spark.createDataFrame([(1, "x " * 500_000 + "{{late_slot}}", "kept", 5)], "doc_id long, text string, residue string, _matched int")
    assert p8.find(df).count() == 1
    assert p8.keep_clean(df.withColumn("text", F.lit("clean"))).first().asDict() == {"doc_id": 1, "text": "clean", "residue": "kept", "_matched": 5}
    assert p8.find(df.limit(0)).count() == 0


# Wordings that the expressions were not made from.
HELD_OUT = {
    "slot": ["Dear [COMPANY NAME],", "Dear {name},", "Sales of <%= user.name %> rose", "{% block content %}", "{{ " + "a" * 90 + " }}", "[insert " + "a long account of " * 6 + "results]", "as of [DATE OF REPORT]"],
    "message": ["This content isn't available right now", "The requested URL was not found on this server.", "500 Server Error", "Sorry, the page you are looking for moved.", "The document could not be loaded. Please try again."],
    "notice": ["Checking your browser before accessing the site", "You need to enable JavaScript to run this app."],
}
SPOKEN_OF = [
    "```\nAccess denied\n```", "The server log shows `HTTP 404` on most days.", 'The error reads "Access denied" when a key is missing.', "Customers saw a page that says “Session expired” less often.",
    "[SIGNATURE PAGE FOLLOWS]", "[INTENTIONALLY OMITTED]", "the set {x} of goods", "The report was not available to shareholders until May.", "This snippet of template syntax, {{name}}, is filled in.",
]


def test_held_out_wordings(spark):
    rows = [(i, t, k) for i, (k, t) in enumerate((k, t) for k, ts in HELD_OUT.items() for t in ts)]
    got = {r.doc_id: r.residue for r in p8.find(spark.createDataFrame(rows, "doc_id long, text string, kind string")).collect()}
    assert [(t, got.get(i)) for i, t, k in rows if k not in got.get(i, [])] == []
    df = spark.createDataFrame(list(enumerate(SPOKEN_OF)), "doc_id long, text string")
    assert [(SPOKEN_OF[r.doc_id], r.residue) for r in p8.find(df).collect()] == []


def test_context_counts_where_it_stands(spark):
    """Code, quotation or a word on syntax elsewhere in a text excuses nothing."""
    texts = ["`a = 1` is code. Access denied", 'He said "yes". HTTP 404', "A tutorial was held.\n" + "Costs rose in every segment of the group. " * 200 + "{{a_b}} " * 9, "``` Access denied, and the fence stays open", "Template syntax is dull. Sales of {{issuer}} rose."]
    assert p8.find(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).count() == len(texts)


@pytest.mark.parametrize("text", ["A tutorial.\n" + "{{a_b}} \n" * 9])
def test_tutorial(spark, text):
    assert p8.find(spark.createDataFrame([(1, text)], "doc_id long, text string")).count() == 0
