"""Problem 2: text that reads the same but is stored with other characters.

The values are the words of all page texts, with their counts, and the whole questions. A
look-alike map in SQL takes invisible characters out, makes spaces of any width the plain
one, full-width and styled characters and ligatures ordinary ones, and look-alike letters of
other scripts Latin, but only inside a word that also has Latin letters (or zeros inside a
number). Values whose maps are equal under the accent-sensitive Unicode collation form a
class: the collation, not the map, brings together composed and decomposed accents, and
what differs in characters that have no weight. The class's canonical member is its
commonest clean value, of equally common ones the least by code point, and is joined back to
every value. Only a class without a clean value gets a made form: the map, composed.

A value with a disguised spot is one that differs from its canonical member.

Scale. Words are counted on the map side, so that the exchange carries each task's
vocabulary; the map and the collation see each distinct word once. Pages meet the classes
only with words that have a suspicious character. Nothing is gathered on the driver.
Questions that read alike are found by class; only classes with different strings are
expanded to pairs, which TESTDATA.md asks for one by one (``question_classes`` has one row
per question instead).

Edge cases. Null and blank values have no class and stay as they are. Words wholly in
another script stay. Repeated rows count once for questions; a page's words once per row.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from pagewright.functions.text import has_non_ascii, is_blank
from pagewright.llm import p1_boilerplate as p1
from pagewright.llm import p5_quality as p5
from pagewright.llm.pages import with_text
from pagewright.session import cut

# Letters of other scripts, then the Latin letters that look the same.
LOOK_FROM = "аеорсухіјѕһԛԝӏкАВЕКМНОРСТУХІЈЅԚԜҮѴ" + "ονραικυχητωεγΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹϳ" + "օսհոցՕՍ" + "ɑɡſ" + "ёїӧӓЁЇάόίέϊύΆΌΊΈ"
LOOK_TO = "aeopcyxijshqwlkABEKMHOPCTYXIJSQWYV" + "ovpaikuxntweyABEZHIKMNOPTYXCj" + "ouhngOU" + "ags" + "ëïöäËÏáóíéïúÁÓÍÉ"
# Signs that look like an ASCII sign.
SIGN_FROM, SIGN_TO = "∕∶∣ǃ․", "/:|!."
LIGATURES = {chr(c): unicodedata.normalize("NFKC", chr(c)) for c in (*range(0xFB00, 0xFB07), 0x132, 0x133)}
# What is seen as nothing: format characters, fillers, variation selectors.
INVISIBLE = [c for c in range(0x80, 0x20000) if unicodedata.category(chr(c)) == "Cf" and not 0x600 <= c <= 0x8FF] + [0x34F, 0x115F, 0x1160, 0x17B4, 0x17B5, *range(0x180B, 0x180E), 0x3164, *range(0xFE00, 0xFE10), 0xFFA0]
SPACES = [c for c in range(0x80, 0x3001) if unicodedata.category(chr(c)) == "Zs"]


def _styled() -> dict[int, str]:
    """Full-width, half-width and styled characters with one ordinary character each, by Unicode's tables."""
    table = {}
    for c in range(0x80, 0x20000):
        tag, _, target = unicodedata.decomposition(chr(c)).partition(" ")
        if tag in ("<wide>", "<narrow>", "<font>") and " " not in target and c != 0x3000:
            table[c] = unicodedata.normalize("NFKC", chr(c))
    for c in range(0x2160, 0x2180):  # Roman numerals of one letter
        if len(unicodedata.normalize("NFKC", chr(c))) == 1:
            table[c] = unicodedata.normalize("NFKC", chr(c))
    return {c: t for c, t in table.items() if len(t) == 1}


STYLED = _styled()
SINGLETONS = [c for c in range(0x80, 0x20000) if unicodedata.normalize("NFC", chr(c)) != chr(c)]
MARKS = [c for c in range(0x300, 0x370)]
ZEROS = "ОоΟοՕօ"  # letters that stand for a zero inside a number
WORD_GAP = r"[ \t\r\n]+"
CONTROLS = r"[\x00-\x08\x0e-\x1b\x7f]"  # weightless under the collation, but ASCII


def char_class(points) -> str:
    """A class of code points as ranges, in the syntax that both engines read."""
    points, ranges = sorted(set(points)), []
    for c in points:
        if ranges and ranges[-1][1] == c - 1:
            ranges[-1][1] = c
        else:
            ranges.append([c, c])
    return "".join(f"\\x{{{a:x}}}" + (f"-\\x{{{b:x}}}" if b > a else "") for a, b in ranges)


INVISIBLE_CLASS = f"[{char_class(INVISIBLE)}]"
UNCOMPOSED = f"[{char_class([*SINGLETONS, *MARKS])}]"
LOOK_CLASS = f"[{char_class(map(ord, LOOK_FROM))}]"
SUSPICIOUS = f"[{char_class([*INVISIBLE, *SPACES, *STYLED, *SINGLETONS, *MARKS, *map(ord, LOOK_FROM), *map(ord, SIGN_FROM), *map(ord, LIGATURES)])}]"
_PLAIN_FROM = "".join(map(chr, [*SPACES, *STYLED])) + SIGN_FROM
_PLAIN_TO = " " * len(SPACES) + "".join(STYLED.values()) + SIGN_TO


@F.pandas_udf(StringType())
def _nfc(text: pd.Series) -> pd.Series:
    """Composed form, of the few values that get here (Arrow's own NFC kernel leaves accents apart)."""
    return text.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")


def look_alike_map(value: Column) -> Column:
    """``value`` in ordinary characters; accents stay as they are stored."""
    v = F.translate(F.regexp_replace(value, INVISIBLE_CLASS, ""), _PLAIN_FROM, _PLAIN_TO)
    for a, b in LIGATURES.items():
        v = F.replace(v, F.lit(a), F.lit(b))
    runs = F.regexp_extract_all(v, F.lit(r"[\p{L}\p{Nd}][\p{L}\p{M}\p{Nd}]*|[^\p{L}\p{Nd}]+"), F.lit(0))
    latin = lambda w: F.translate(w, LOOK_FROM, LOOK_TO)
    plain = lambda w: (
        F.when(~w.rlike(LOOK_CLASS), w)
        .when(w.rlike(r"\p{IsLatin}"), latin(w))
        .when(w.rlike(f"[0-9]") & w.rlike(f"^[0-9{ZEROS}]+$"), F.translate(w, ZEROS, "0" * len(ZEROS)))
        .otherwise(w)
    )
    return F.array_join(F.transform(runs, plain), "")


def vocabulary(texts: DataFrame) -> DataFrame:
    """(value, n): the words of ``texts.text``, split at plain white space, and how often each stands there."""
    return texts.select(F.explode(F.split("text", WORD_GAP)).alias("value")).where("value <> ''").groupBy("value").agg(F.count("*").alias("n"))


def canonical_values(values: DataFrame) -> DataFrame:
    """(value, canonical) for each distinct non-null ``value``; a column ``n`` tells how common it is (1 without)."""
    n = F.sum("n") if "n" in values.columns else F.lit(1)
    distinct = values.where("value is not null").groupBy("value").agg(n.cast("long").alias("n"))
    suspect = F.col("value").rlike(SUSPICIOUS) & has_non_ascii(F.col("value"))
    keyed = distinct.withColumn("key", F.when(suspect, look_alike_map(F.col("value"))).otherwise(F.col("value")))
    # Composed: needed to see which values are clean, and for classes that have none.
    keyed = keyed.withColumn("mapped", F.coalesce(_nfc(F.when(F.col("key").rlike(UNCOMPOSED), F.col("key"))), "key"))
    keyed = cut(keyed.withColumn("class", F.collate("key", "UNICODE")))
    order = F.struct((F.col("value") != F.col("mapped")).alias("spotted"), (-F.col("n")).alias("rarity"), F.col("mapped").alias("canonical"))
    members = keyed.groupBy("class").agg(F.min(order).alias("m"))
    return keyed.join(members.select("class", F.col("m.canonical").alias("canonical")), "class").select("value", "canonical")


def words_with_spots(texts: DataFrame, *keys: str) -> DataFrame:
    """(keys, value): the distinct words of ``texts.text`` that may differ from their canonical member."""
    words = F.array_distinct(F.filter(F.split("text", WORD_GAP), lambda w: (F.octet_length(w) != F.length(w)) | w.rlike(CONTROLS)))
    return texts.where(has_non_ascii(F.col("text")) | F.col("text").rlike(CONTROLS)).select(*keys, F.explode(words).alias("value"))


def changed_values(texts: DataFrame) -> DataFrame:
    """(value, canonical) of the words of ``texts`` that are not in canonical form."""
    return canonical_values(vocabulary(texts)).where("value <> canonical")


def disguised_pages(pages: DataFrame) -> DataFrame:
    """(doc_id, page_index) of the pages with text in which some word has a disguised spot."""
    texts = with_text(pages).select("doc_id", "page_index", F.col("raw_text").alias("text"))
    return words_with_spots(texts, "doc_id", "page_index").join(changed_values(texts), "value", "left_semi").select("doc_id", "page_index").distinct()


def canonical_texts(texts: DataFrame, *keys: str) -> DataFrame:
    """(keys, text, canonical): every text with each word replaced by its canonical member.

    Texts without a suspicious character stay in place; the map of a text has its own words only.
    """
    changed = words_with_spots(texts, *keys).distinct().join(changed_values(texts), "value")
    maps = changed.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("value", "canonical"))).alias("_map"))
    parts = F.regexp_extract_all("text", F.lit(r"[ \t\r\n]+|[^ \t\r\n]+"), F.lit(0))
    rebuilt = F.array_join(F.transform(parts, lambda w: F.coalesce(F.element_at("_map", w), w)), "")
    return texts.join(maps, list(keys), "left").select(*keys, "text", F.when(F.col("_map").isNull(), F.col("text")).otherwise(rebuilt).alias("canonical"))


def canonical_questions(queries: DataFrame) -> DataFrame:
    """(task_id, doc_id, question, value, canonical) of the distinct non-blank questions.

    A question is one value; runs of plain spaces and the ends don't count for its class.
    """
    q = cut(queries.select("task_id", "doc_id", "question").distinct().where(~is_blank(F.col("question"))))
    trimmed = F.trim(F.regexp_replace(F.col("question"), WORD_GAP, " "))
    q = q.withColumn("value", trimmed)
    return q.join(canonical_values(q.select("value", F.lit(1).alias("n"))), "value").select("task_id", "doc_id", "question", "value", "canonical")


def question_classes(queries: DataFrame) -> DataFrame:
    """(task_id, doc_id, canonical, alike, spellings): each question with its class in its report, the tasks that
    ask it and the strings that they ask it in."""
    q = canonical_questions(queries)
    size = q.groupBy("doc_id", "canonical").agg(F.countDistinct("task_id").alias("alike"), F.countDistinct("question").alias("spellings"))
    return q.select("task_id", "doc_id", "canonical").distinct().join(size, ["doc_id", "canonical"]).select("task_id", "doc_id", "canonical", "alike", "spellings")


def found(pages: DataFrame, headings: DataFrame, common_words: DataFrame, queries: DataFrame) -> DataFrame:
    """(record_kind, key_a, key_b) as TESTDATA.md defines it."""
    native = pages.where("representation = 'native_pdf_text'")
    hit = cut(disguised_pages(native))
    # Junk as in p5: furniture comes from all pages of the reports, figures only from the pages in question.
    keys = cut(p1.page_keys(pages.join(hit.select("doc_id").distinct(), "doc_id", "left_semi")))
    features = p5.page_features(native.join(hit, ["doc_id", "page_index"], "left_semi"), common_words)
    readable = p5.judged(features, headings, keys=keys).where("coalesce(kind <> 'junk', true)")
    q = cut(canonical_questions(queries))
    several = q.groupBy("doc_id", "canonical").agg(F.min("question").alias("least"), F.max("question").alias("most")).where("least <> most").select("doc_id", "canonical")
    mixed = q.join(several, ["doc_id", "canonical"], "left_semi")
    a = mixed.select("doc_id", "canonical", F.col("task_id").alias("key_a"), F.col("question").alias("qa"))
    b = mixed.select("doc_id", "canonical", F.col("task_id").alias("key_b"), F.col("question").alias("qb"))
    pairs = a.join(b, ["doc_id", "canonical"]).where("key_a < key_b and qa <> qb")
    row = lambda df, kind, x, y: df.select(F.lit(kind).alias("record_kind"), x.cast("string").alias("key_a"), y.cast("string").alias("key_b")).distinct()
    return (
        row(readable, "page", F.col("doc_id"), F.col("page_index"))
        .unionByName(row(q.where("value <> canonical"), "question", F.col("task_id"), F.lit("")))
        .unionByName(row(pairs, "pair", F.col("key_a"), F.col("key_b")))
    )
