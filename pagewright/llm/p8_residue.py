"""Problem 8: template residue and error-page text in documents.text.

Two detectors over the whole text:

* slots: one grammar per delimiter of an unfilled placeholder;
* phrases: dummy text, undelivered pages, and notices about scripts, cookies or
  checks. The expressions ask for the wording of a message, not of a report that
  speaks of such things.

What they find counts only in the text's own voice. Before it is looked at again, a text with
a finding loses its code (closed fences and inline code), quotations that the sentence
reports (an error reads "...", the page shows "..."), and sentences that speak of template
syntax. A text that speaks of it and has a slot to every DENSE characters is a tutorial, and
its slots are no residue; in a long report with few slots they are.

All grammars are joined into one expression per kind and matched by Arrow's automaton
on the column buffer (measured here: 4 ns a character for all of them, where the
JVM's backtracking engine took over 1,000). Only texts with a finding are looked at again.

No shuffle. Null or empty text: no residue. A phrase or slot counts once however
often it stands there. Slots may be of any length within a line.
"""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

# Grammars of unfilled slots, by delimiter. No look-around, so that RE2 takes them too.
SLOT_GRAMMARS = {
    "double brace": r"\{\{[^{}\n]+\}\}",
    "tag": r"<%[-=#@]?[^<>%\n]+%>|\{%-?[^{}%\n]+%\}",
    "brace": r"\{(?:[A-Za-z][A-Za-z]*(?:[_.][A-Za-z]+)+|[0-9]{1,2}|(?i:_FIELD_))\}",
    "dollar or hash brace": r"[$#]\{[A-Za-z_][A-Za-z0-9_. ]*\}",
    "double bracket": r"\[\[ ?[A-Za-z_][A-Za-z0-9_. -]*\]\]",
    "double angle": r"<<? ?[A-Za-z_]+(?:_[A-Za-z]+)+ ?>>?|<<[A-Za-z][A-Za-z0-9_ ]*>>",
    "percent": r"%%[A-Za-z_][A-Za-z0-9_]*%%|%\([a-z_][a-z0-9_]*\)[sdf]",
    "at": r"@@[A-Za-z_][A-Za-z0-9_]*@@",
    "underscores": r"__[A-Z][A-Z0-9_]*[A-Z0-9]__",
    "open bullet": r"\[ ?[●•◆■_.…]{1,8} ?\]",
    "bracketed order": r"\[(?i:[^\[\]\n]*\b(?:insert|enter|fill in|to be (?:completed|inserted|added|confirmed|supplied)|tbd|tbc|todo|your|placeholder|einf.gen|erg.nzen|eintragen|eingeben|ins.rer|indiquer|compl.ter|saisir|renseigner|insertar|introducir|indicar|completar|rellenar)\b[^\[\]\n]*| ?[a-z][a-z &-]+ here ?)\]",
    "bracketed field": r"\[ ?(?:[A-Z]+[ _/-])*(?:NAME|DATE|AMOUNT|YEAR|ADDRESS|TITLE|NUMBER|CURRENCY|CITY|COUNTRY|EMAIL|PHONE|COMPANY|FIRMENNAME|DATUM|BETRAG|NOM|MONTANT|NOMBRE|FECHA|IMPORTE)(?:[ _/-][A-Z]+)* ?\]",
    "angled words": r"<(?i:(?:your|insert|enter|nom|nombre|name|datum|date|fecha|montant|betrag|importe|company|firmenname|titre|title)\b[^<>=/\n]*|[^<>=/\n]+ (?:einf.gen|erg.nzen|eintragen|here))>",
    "merge field": r"«(?i:[a-z]+_[a-z_]+|_FIELD_)»",
    "letters for digits": r"[$€£][Xx]{1,3}(?:[,.][Xx]{1,3})+|[$€£]X{1,4}\b|\bX{1,3}(?:[,.]X{1,3})+\b|\bXX+%|\bXX[/.-]XX[/.-]XX(?:XX)?\b|\bX{4,}\b",
}
# What a single word in braces or guillemets must be, to be a field and not a variable.
FIELD = "betrag|montant|importe|datum|date|fecha|name|nom|nombre|firma|firmenname|soci.t.|empresa|titel|titre|t.tulo|title|jahr|ann.e|a.o|year|amount|company|address|email|city|country|currency|customer"
SLOT_GRAMMARS = {k: g.replace("_FIELD_", FIELD) for k, g in SLOT_GRAMMARS.items()}
SLOT = "|".join(SLOT_GRAMMARS.values())

# Fixed values: (kind, what the message looks like).
_LOREM = r"(?:lorem|ipsum|ipsar|dolor|sitam|amet|consect|adipis|elit|magna|tempor|incidun|labor[ie]|aliqu|veniam|nostrud|ullamco|commod|velit|fugiat|sint|nisi|eiusmod|euismod)[a-z]{0,6}"
PHRASES = (
    ("dummy", rf"(?i)\b{_LOREM}[,.]?\s+{_LOREM}[,.]?\s+{_LOREM}\b"),
    ("dummy", r"(?i)\b(?:headline|title|heading|text|copy|content|caption|paragraph|summary|name|body|subtitle|quote) goes here\b"),
    ("dummy", r"(?i)\b(?:section|page|chapter|body|text|copy|content|chart|figure)(?: body| text| copy)? to follow\s*(?:[.!\n]|$)"),
    ("dummy", r"(?i)\btext text text\b"),
    ("dummy", r"(?i)\b(?:dummy (?:text|copy|content|paragraph|line)|(?:line|piece|block|paragraph) of dummy)\b"),
    ("dummy", r"(?i)\b(?:this is (?:a |only |just )?sample text|sample text\s*(?:[.:!\n]|$|for (?:layout|review|the design)))"),
    ("dummy", r"(?i)\b(?:filler (?:text|copy|content|paragraph))\b"),
    ("dummy", r"(?i)\breplace this (?:paragraph|text|section|line|sentence|block)\b"),
    ("dummy", r"(?i)\b(?:put|place|add|enter|type|insert|write|paste)\b[^.\n]{0,30}\b(?:body )?copy here\b"),
    ("dummy", r"(?i)\b(?:put|place|add|enter|type|insert|write|paste|your)\b[^.\n]{0,30}\btext here\b"),
    ("dummy", r"(?i)\bplaceholder (?:paragraph|text|copy|sentence|content|headline|page)\b|\bthis (?:paragraph|text|page|section) is (?:only )?a placeholder\b"),
    ("dummy", r"(?i)\btexte de remplissage\b"),
    ("dummy", r"(?i)\bfaux texte\b"),
    ("dummy", r"(?i)\btexto de ejemplo\b"),
    ("dummy", r"(?i)\btexto de relleno\b"),
    ("dummy", r"(?i)\bblindtext\b"),
    ("dummy", r"(?i)\bplatzhaltertext\b"),
    ("dummy", r"(?i)\bhier (?:steht|folgt|erscheint) (?:sp.ter )?der eigentliche text\b"),
    ("message", r"\bHTTP(?:/[0-9.]+)? (?:[Ee]rror )?[45][0-9][0-9]\b"),
    ("message", r"\b[Ee]rror(?: code)?:? [45][0-9][0-9]\b|(?i)\binternal (?:server )?error\s*(?:[-:.!\n]|$)"),
    ("message", r"(?i)\b(?:page|file|document|report|resource|filing|404)(?: was)? not found\b|\b404:? (?:page )?not found\b"),
    ("message", r"(?i)\b403:? forbidden\b|\bforbidden\s*[-:]\s"),
    ("message", r"(?i)\bbad gateway\b"),
    ("message", r"(?i)\bgateway time-?d? ?out\b"),
    ("message", r"(?i)\b503:? (?:service )?(?:temporarily )?unavailable\b|\bservice (?:is )?(?:currently |temporarily )unavailable\b|\b(?:page|site|report|document|content|file) is (?:currently |temporarily )?unavailable\b"),
    ("message", r"(?i)\b(?:down|offline|closed|unavailable) for (?:planned |scheduled )?upkeep\b"),
    ("message", r"(?i)\b(?:down|offline|unavailable|closed) for (?:planned |scheduled |routine )?maintenance\b|\b(?:site|reader|service|portal|server|viewer) is under(?:going)? maintenance\b"),
    ("message", r"(?i)\b(?:page|fichier|document|rapport) introuvable\b"),
    ("message", r"(?i)\b(?:document|page|fichier|rapport) (?:demand.e? )?n.existe plus\b"),
    ("message", r"(?i)\b(?:seite|datei|dokument|bericht) (?:wurde )?nicht gefunden\b"),
    ("message", r"(?i)\bangeforderte (?:dokument|seite|datei|bericht)\b[^.\n]{0,30}\b(?:nicht|gel.scht|verschoben)\b"),
    ("message", r"(?i)\bno se encontr. (?:la|el) (?:p.gina|archivo|documento|informe)\b"),
    ("message", r"(?i)\b(?:p.gina|archivo|documento) no encontrad[oa]\b"),
    ("message", r"(?i)\b(?:documento|p.gina|archivo|informe) solicitad[oa] (?:ya )?no (?:est|existe)"),
    ("message", r"(?i)\b[45][0-9][0-9]:? (?:internal )?(?:server error|not found|forbidden|bad request|unauthori[sz]ed|service unavailable|gateway time-?out|too many requests)\b"),
    ("message", r"(?i)\b(?:content|page|url|file|document|video|resource|article|link) (?:isn.t|is not|was not|wasn.t|cannot be|could not be|can.t be|couldn.t be) (?:available|found|displayed|loaded|opened|delivered)(?: right now| at the moment| at this time| on this (?:server|site)|[.!,;:]? (?:please )?(?:try again|reload|refresh|go back))"),
    ("message", r"(?i)\bnot found on this server\b|\bpage you (?:requested|are looking for|were looking for)\b|\bplease try again (?:later|in a few)\b|\byou have been blocked\b"),
    ("message", r"(?i)\baccess denied\b"),
    ("message", r"(?i)\bacc.s refus.\s*(?:[-:.!)\n]|$)"),
    ("message", r"(?i)\bacceso denegado\s*(?:[-:.!)\n]|$)"),
    ("message", r"(?i)\bzugriff verweigert\b"),
    ("message", r"(?i)\byou (?:do not|don.t) have (?:the )?permission to\b"),
    ("message", r"(?i)\brequests from your (?:network|address|location) (?:were|have been|are) (?:blocked|refused|limited)\b"),
    ("message", r"(?i)\b(?:your )?session (?:has )?expired\b|\b(?:this|the|your) (?:link|page|token|download) (?:has )?expired\b"),
    ("message", r"(?i)\bsign in again\b"),
    ("message", r"(?i)\b(?:link|page|file|document|report) is no longer (?:active|available)\b"),
    ("message", r"(?i)\b(?:file|document|report|page) was (?:removed|deleted) by its owner\b"),
    ("message", r"(?i)\btoo many requests\s*(?:[-:.!)\n]|$)"),
    ("message", r"(?i)\byou (?:have )?opened too many (?:filings|pages|reports)\b"),
    ("message", r"(?i)\brate limit (?:exceeded|reached)\b"),
    ("message", r"(?i)\b(?:connection|request|download|server|session)(?: has)? timed out\b"),
    ("message", r"(?i)\btook too long to respond\b"),
    ("message", r"(?i)\bupstream [a-z]+ (?:gave|sent|returned) an? invalid (?:answer|response|reply)\b"),
    ("message", r"(?i)\bsomething went wrong\b"),
    ("message", r"(?i)\b(?:we )?could not load (?:this|the) (?:report|page|document|file|filing)\b"),
    ("message", r"(?i)\b(?:report|page|document|file|filing) could not be (?:loaded|delivered|opened|displayed)\b"),
    ("message", r"(?i)\buncaught (?:exception|error|typeerror)\b"),
    ("message", r"(?i)\bcannot read propert(?:y|ies)\b"),
    ("message", r"(?i)\bquery failed (?:near|at|with)\b"),
    ("message", r"(?i)\binternal fault\s*(?:[-:.!)\n]|$)"),
    ("message", r"(?i)\b(?:page|document|file|report|filing)\b[^.\n]{0,30}\bhas (?:been )?moved or was (?:taken down|removed|deleted)\b"),
    ("message", r"(?i)\bcheck the address (?:or|and)\b"),
    ("notice", r"(?i)\b(?:turn on|enable|switch on|activate|allow|activez?|activer|activar|habilite|aktivieren sie|requires?|needs?) (?:your )?javascript\b|\bjavascript (?:is|must be|needs to be|appears to be|seems to be) (?:off|disabled|required|enabled|turned|switched|blocked|needed)\b|\bwithout javascript\b"),
    ("notice", r"(?i)\bbrowser blocks scripts\b|\bneeds scripts to run\b|\bscripts must be (?:allowed|enabled|on)\b|\bnoscript mode is\b|\bkeep scripts (?:switched |turned )?on\b|\bscripts are (?:blocked|disabled|required|off)\b|\b(?:enable|allow|turn on) scripts\b[^.\n]{0,40}\b(?:to (?:view|read|see|open|continue)|in your browser|and reload)"),
    ("notice", r"(?i)\bcookies (?:and scripts )?(?:must be|need to be|are) (?:allowed|enabled|accepted|required|disabled|blocked)\b|\b(?:enable|allow|accept|turn on) (?:all )?cookies\b|\bthis (?:site|page|viewer|reader) (?:uses|needs|requires) cookies\b"),
    ("notice", r"(?i)\b(?:checking|verifying) your browser\b|\bverify(?:ing)? (?:that )?you.re (?:a )?human\b|\bneed to enable javascript\b"),
    ("notice", r"(?i)\b(?:enable|allow) them and reload the page\b"),
    ("notice", r"(?i)\b(?:checking|check|verify|verifying|confirm|prove|make sure) (?:that )?you are (?:a person|a human|human|not a robot|a real)\b"),
    ("notice", r"(?i)\b(?:checking|check|verify|verifying|confirm|prove) (?:that )?you are not a (?:robot|bot|machine)\b"),
    ("notice", r"(?i)\b(?:complete|solve|pass|fill in) the captcha\b"),
)

# What is cut out of a text before it is looked at again.
CODE = r"(?s)```.*?```|`[^`\n]+`"
REPORTED = r"(?i)\b(?:messages?|errors?|notices?|texts?|words?|wording|phrases?|status|codes?|pages?|reads?|sa(?:ys|id|ying)|show(?:s|n|ed|ing)?|display(?:s|ed|ing)?|return(?:s|ed|ing)?|called|titled|label(?:led|ed|s)?|marked|such as|like)\b[^.!?\n\"“”«»„]*[\"“«„][^\"“”«»\n]*[\"”»“]"
SYNTAX_SENTENCE = r"(?i)[^.!?\n]*\b(?:template syntax|placeholder syntax|template engine|code sample|snippet|tutorial)\b[^\n]*?(?:[.!?](?=\s|$)|$|(?=\n))"
SPOKEN = r"(?i)\b(?:tutorial|template syntax|placeholder syntax|template engine|code sample|snippet)\b"
DENSE = 100  # characters to a slot in a tutorial, at most


KINDS = ("slot", "dummy", "message", "notice")
GRAMMAR = {"slot": SLOT} | {k: "|".join(f"(?:{p})" for kind, p in PHRASES if kind == k) for k in KINDS[1:]}


@F.arrow_udf(IntegerType())
def _matched(text: pa.Array) -> pa.Array:
    """Bit i: the grammar of KINDS[i] matches. One automaton pass each over the Arrow buffer; no Python strings."""
    bits = [pc.if_else(pc.fill_null(pc.match_substring_regex(text, GRAMMAR[k]), False), pa.scalar(1 << i, pa.int32()), pa.scalar(0, pa.int32())) for i, k in enumerate(KINDS)]
    return reduce(pc.bit_wise_or, bits)


def own_voice(text: Column) -> Column:
    """``text`` without code, reported quotations and sentences on template syntax."""
    bare = F.when(text.contains("`"), F.regexp_replace(text, CODE, " ")).otherwise(text)
    bare = F.when(bare.rlike(r"[\"“«„]"), F.regexp_replace(bare, REPORTED, " ")).otherwise(bare)
    return F.when(text.rlike(SPOKEN), F.regexp_replace(bare, SYNTAX_SENTENCE, " ")).otherwise(bare)


def _with_kinds(documents: DataFrame, kinds: str) -> DataFrame:
    """``documents`` with a column ``kinds``: those found, in fixed order; empty for clean texts."""
    text, first, again = F.col("text"), f"{kinds}_first", f"{kinds}_again"
    df = documents.withColumn(first, _matched("text"))
    df = df.withColumn(again, _matched(F.when((F.col(first) > 0) & text.rlike(rf"[`\"“«„]|{SPOKEN}"), own_voice(text))))
    found = F.when((F.col(first) > 0) & text.rlike(rf"[`\"“«„]|{SPOKEN}"), F.col(again)).otherwise(F.col(first))
    slots = F.regexp_count(text, F.lit(SLOT))
    dense = (F.col(first) > 0) & text.rlike(SPOKEN) & (slots > 1) & (slots * DENSE > F.length(text))
    hit = [F.when((found.bitwiseAND(1) > 0) & ~dense, F.lit(KINDS[0]))]
    hit += [F.when(found.bitwiseAND(1 << i) > 0, F.lit(k)) for i, k in enumerate(KINDS) if i]
    return df.withColumn(kinds, F.array_compact(F.array(*hit))).drop(first, again)


def find(documents: DataFrame) -> DataFrame:
    """(doc_id, residue) of the documents with residue."""
    return _with_kinds(documents.select("doc_id", "text"), "residue").where(F.size("residue") > 0).select("doc_id", "residue")


def keep_clean(documents: DataFrame) -> DataFrame:
    """The documents without residue, all columns as they came."""
    own = "__residue"
    return _with_kinds(documents, own).where(F.size(own) == 0).drop(own)
