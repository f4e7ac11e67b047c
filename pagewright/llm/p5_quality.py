"""Problem 5: figures on the quality of each page's text, and what kind of page it is.

One Arrow function reads every page once and returns its figures together with one
letter per line; from there on only numbers and letters move. Combined rules on the
figures tell what is readable: symbols, word length, words without vowels, the share of
function words and how they stand together, and repetition (lines, paragraphs, and the letters
that one repeated n-gram covers). What a readable page is made of is judged on its own
lines: furniture (lines that p1 finds repeated) and section headings are left out by
joining line keys; shares of entries, figures and sentences then tell lists, tables and prose.

Letters of lines: '-' blank, 'b' bullet or numbered entry, 'd' dot leaders, 'n' caption with
several figures, 'm' text that ends with one figure, 'e' text with a sentence end, 't' other
text; capitals for text that stood on the page before.

Scale. One pass over the text on the map side, spread over all cores before it starts where the
scan has few tasks; the exchange by page carries about 100 bytes a page. Joins are salted as in p1.

Edge cases. Rows without text are no page and have no kind (``page_stats`` gives them
zeros). Several rows of one page count once. A page with nothing but furniture has no
kind.
"""

from __future__ import annotations

import re
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.llm import p1_boilerplate as p1
from pagewright.llm.pages import line_keys, spread, with_text
from pagewright.session import cut

FIGURES = (
    "word_count int, mean_word_length double, symbol_ratio double, line_count int, end_punctuation_share double, "
    "common_word_share double, duplicate_line_share double, duplicate_paragraph_share double, "
    "top_2gram_share double, top_3gram_share double, top_4gram_share double, no_vowel_share double, senseless_share double, long_token_share double, characters int, classes string"
)

WORD = re.compile(r"[^\W\d_]+")
_LEADERS = re.compile(r"(?:\.\s?){4,}\s*[0-9]*\s*$")
_ENTRY = re.compile(r"(?:[•*▪◦‣·–-]|\(?[A-Za-z0-9]{1,3}[.)])\s+\S")
_FIGURE = r"(?:\(?[$€£]?[0-9lIOoSBb]*[0-9][0-9lIOoSBb.,]*%?\)?|—)"
_ENDS_FIGURE = re.compile(rf"(?:^|[\s|])({_FIGURE})\s*$")
_ENDS_FIGURES = re.compile(rf"(?:^|[\s|]){_FIGURE}[\s|]+{_FIGURE}\s*$")
_SENTENCE_END = re.compile(r"[.!?][”\"')\]¹²³†‡]*(?:\s|$)")
_END_PUNCTUATION = re.compile(r"[.!?:;][”\"')\]¹²³†‡]*\s*$")
_VOWELS = frozenset("aeiouyäöüéèáíóúàâêîôûëïœæãõåøαεηιουωέάаеиоуыэюя")
_FIGURE_ENDS = frozenset("0123456789%)—lIOoSBb")
_MIX = np.int64(6364136223846793005)  # spreads the codes of word sequences over 64 bits
_PARAGRAPHS = re.compile(r"\n\s*\n")

_CIDS = re.compile(r"\(cid:\d+\)")
_RUNS = re.compile(b"\x01{3,}")  # three function words or more in a row

MAJORITY = 0.5
SENTENCES = 0.15  # share of text lines with a sentence end, below which text is not prose
# Bounds of the combined rules; a page of fewer than FEW own lines cannot repeat itself.
FEW = 4
SYMBOLS = 0.3
SHORT_WORDS, LONG_WORDS = 2.5, 8.0
NO_VOWELS = 0.3
FUNCTION_WORDS = 0.11
SENSELESS, SENSELESS_PROSE = 0.12, 0.4  # without sentences, and with them
LONG_TOKEN, LONG_TOKENS = 30, 0.3
REPEATED_LINES, REPEATED_PARAGRAPHS = 0.35, 0.5
REPEATED_NGRAMS = {"top_2gram_share": 0.35, "top_3gram_share": 0.35, "top_4gram_share": 0.4}


def line_class(s: str) -> str:
    """The letter of a stripped line."""
    if not s:
        return "-"
    if (".." in s or ". ." in s) and _LEADERS.search(s):
        return "d"
    if (not s[0].isalpha() or not s[1:2].isalpha()) and _ENTRY.match(s):
        return "b"
    figure = s[-1] in _FIGURE_ENDS
    if figure and _ENDS_FIGURES.search(s):
        return "n"
    if ("." in s or "!" in s or "?" in s) and _SENTENCE_END.search(s):
        return "e"
    if figure and _ENDS_FIGURE.search(s):
        return "n" if "|" in s or "\t" in s else "m"
    return "t"


def _top_shares(words: list[str], total: int) -> tuple[float, float, float]:
    """For n = 2, 3, 4: the largest share of the page's letters that one repeated n-gram covers."""
    if len(words) < 5 or not total:
        return 0.0, 0.0, 0.0
    code = np.array(list(map(hash, words)), dtype=np.int64)
    size = np.array(list(map(len, words)), dtype=np.int64)
    gram, letters, shares = code, size, []
    for n in (2, 3, 4):
        gram, letters = gram[:-1] * _MIX + code[n - 1 :], letters[:-1] + size[n - 1 :]
        order = gram.argsort()
        placed = gram[order]
        starts = np.concatenate(([0], np.flatnonzero(placed[1:] != placed[:-1]) + 1))
        times = np.diff(starts, append=len(placed))
        covered = int((letters[order[starts]] * times)[times > 1].max(initial=0))
        shares.append(round(min(1.0, covered / total), 4))
    return tuple(shares)


def page_figures(text: str, common: frozenset) -> tuple:
    classes, seen, filled, ends = [], set(), 0, 0
    for line in text.split("\n"):
        s = line.strip()
        kind = line_class(s)
        if s:
            filled += 1
            ends += not s[-1].isalpha() and _END_PUNCTUATION.search(s) is not None
            # Text that stands on the page before, letter for letter, is told by a capital.
            if s in seen and kind in "et":
                kind = kind.upper()
            seen.add(s)
        classes.append(kind)
    # A glyph that has no character is a symbol, whatever its code looks like.
    words = WORD.findall((_CIDS.sub("#" * 8, text) if "(cid:" in text else text).lower())
    tokens = text.split()
    n, letters, solid = len(words), sum(map(len, words)), sum(map(len, tokens))
    known = bytes(map(common.__contains__, words))
    long = [w for w in set(words) if len(w) >= 3]
    odd = sum(map(len, _RUNS.findall(known))) + sum(map(str.__eq__, words, words[1:]))
    paragraphs = [p for p in map(str.strip, _PARAGRAPHS.split(text)) if p]
    return (
        n,
        round(letters / n, 4) if n else 0.0,
        round(1 - (letters + sum(map(text.count, "0123456789"))) / solid, 4) if solid else 0.0,
        filled,
        round(ends / filled, 4) if filled else 0.0,
        round(sum(known) / n, 4) if n else 0.0,
        round(1 - len(seen) / filled, 4) if filled else 0.0,
        round(1 - len(set(paragraphs)) / len(paragraphs), 4) if paragraphs else 0.0,
        *_top_shares(words, letters),
        round(sum(map(_VOWELS.isdisjoint, long)) / len(long), 4) if long else 0.0,
        round(min(1.0, odd / n), 4) if n else 0.0,
        round(sum(x for x in map(len, tokens) if x >= LONG_TOKEN) / solid, 4) if solid else 0.0,
        len(text),
        "".join(classes),
    )


def figures_udf(common_words: DataFrame):
    """The Arrow function with the list of function words (a small, fixed table) inside."""
    common = frozenset(r[0].lower() for r in common_words.select("word").distinct().collect() if r[0])
    names = [c.split()[0] for c in FIGURES.split(", ")]
    blank = page_figures("", common)

    @F.pandas_udf(FIGURES)
    def figures(text: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([page_figures(t, common) if t is not None else blank for t in text], columns=names)

    return figures


def page_features(pages: DataFrame, common_words: DataFrame) -> DataFrame:
    """(doc_id, page_index, line_keys, figures): one row for each page with text."""
    figures = figures_udf(common_words)
    return (
        spread(with_text(pages.select("doc_id", "page_index", "raw_text")))
        .select("doc_id", "page_index", F.struct(line_keys(F.col("raw_text")).alias("line_keys"), figures("raw_text").alias("figures")).alias("f"))
        .groupBy("doc_id", "page_index")
        .agg(F.max("f").alias("f"))
        .select("doc_id", "page_index", "f.line_keys", "f.figures")
    )


# The rules for pages that say nothing readable, in order: name and condition on the figures (f) and the shares of own lines (c).
def _junk_rules(f, c) -> dict[str, Column]:
    entries = (c["n"] + c["m"] > MAJORITY * c["all"]) | (c["bd"] > MAJORITY * c["all"])
    enough = c["all"] >= FEW
    repeated = [enough & (f[k] > bound) for k, bound in REPEATED_NGRAMS.items()]
    return {
        "symbols": (f["symbol_ratio"] > SYMBOLS) & ~entries,
        "word length": ((f["mean_word_length"] < SHORT_WORDS) | (f["mean_word_length"] > LONG_WORDS)) & ~entries,
        "vowels": (f["no_vowel_share"] > NO_VOWELS) & ~entries,
        "function words": (f["common_word_share"] < FUNCTION_WORDS) & (c["e"] > 0) & ~entries,
        "function words together": ((f["senseless_share"] > SENSELESS) & ~c["sentences"]) | (f["senseless_share"] > SENSELESS_PROSE),
        "long tokens": (f["long_token_share"] > LONG_TOKENS) & ~entries,
        "lines": enough & ((f["duplicate_line_share"] > REPEATED_LINES) | (c["again"] > MAJORITY * c["text"])) & ~entries,
        "paragraphs": enough & (f["duplicate_paragraph_share"] > REPEATED_PARAGRAPHS) & (f["duplicate_line_share"] > REPEATED_PARAGRAPHS / 2),
        **dict(zip(REPEATED_NGRAMS, repeated)),
    }


JUNK_RULES = ("symbols", "word length", "vowels", "function words", "function words together", "long tokens", "lines", "paragraphs", *REPEATED_NGRAMS)


def kind_of(classes: Column, figures: Column, without: frozenset = frozenset()) -> Column:
    """'prose', 'list', 'table', 'junk', or null without own lines. ``without``: names of rules to leave out."""

    def n(letters: str) -> Column:
        return F.length(classes) - F.length(F.translate(classes, letters, ""))

    def rules(c) -> Column:
        total, text = c["all"], c["text"]
        unreadable = reduce(lambda a, b: a | b, (r for name, r in _junk_rules(figures, c).items() if name not in without), F.lit(False))
        return (
            F.when(total == 0, F.lit(None).cast("string"))
            .when(unreadable, "junk")
            .when(c["n"] > MAJORITY * total, "table")
            .when(c["bd"] > MAJORITY * total, "list")
            .when((c["n"] + c["m"] > MAJORITY * total) & ((c["e"] == 0) | (c["e"] < SENTENCES * total)), "table")
            .when(c["sentences"], F.when(text >= F.greatest(c["n"], c["bd"]), "prose").when(c["n"] >= c["bd"], "table").otherwise("list"))
            .otherwise("list")
        )

    counts = {"all": "bdnmetET", "text": "emtET", "et": "etET", "again": "ET", "e": "eE", "n": "n", "m": "m", "bd": "bd"}
    # Bound once: the optimizer would otherwise repeat the counts in every rule.
    counted = F.transform(F.array(F.struct(*(n(v).alias(k) for k, v in counts.items()))), lambda c: F.struct(*(c[k].alias(k) for k in counts), ((c["e"] > 0) & (c["e"] >= SENTENCES * c["et"])).alias("sentences")))
    return F.transform(counted, rules)[0]


def judged(features: DataFrame, headings: DataFrame, keys: DataFrame | None = None, without: frozenset = frozenset()) -> DataFrame:
    """(doc_id, page_index, kind, figures) of every page in ``features``."""
    return own_classes(features, headings, keys=keys).select("doc_id", "page_index", kind_of(F.col("own"), F.col("figures"), without).alias("kind"), "figures")


def own_classes(features: DataFrame, headings: DataFrame, salts: int = p1.SALTS, keys: DataFrame | None = None) -> DataFrame:
    """``features`` with ``own``, the classes of the lines that are neither furniture nor headings.

    keys: the line keys of all pages of the reports, if ``features`` has only some of the pages.
    """
    keys = features.select("doc_id", "page_index", "line_keys") if keys is None else keys
    members = cut(p1.supported_nodes(keys).groupBy("doc_id").agg(F.collect_list("line_key").alias("kept")))
    # Merged, not broadcast: Spark's estimate of a report's list misses its copies.
    by_salt = members.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).hint("merge")
    df = features.withColumn("salt", F.pmod(F.col("page_index"), F.lit(salts))).join(by_salt, ["doc_id", "salt"], "left").drop("salt")
    titles = (
        headings.where("heading_text is not null")
        .select("doc_id", "page_index", F.explode(line_keys(F.col("heading_text"))).alias("k"))
        .where("k is not null")
        .groupBy("doc_id", "page_index")
        .agg(F.collect_set("k").alias("titles"))
    )
    none = F.array().cast("array<bigint>")
    df = df.join(titles, ["doc_id", "page_index"], "left").withColumn("_gone", F.concat(F.coalesce("kept", none), F.coalesce("titles", none)))
    mine = F.transform("line_keys", lambda k, i: F.when(k.isNotNull() & ~F.array_contains("_gone", k), F.substr(F.col("figures.classes"), i + 1, F.lit(1))))
    # Checkpointed, since every rule on a page's classes would make them again.
    return cut(df.withColumn("own", F.array_join(mine, "")).drop("_gone", "kept", "titles"))


def kinds(pages: DataFrame, headings: DataFrame, common_words: DataFrame) -> DataFrame:
    """(doc_id, page_index, kind, figures) of every page with text."""
    return judged(cut(page_features(pages, common_words)), headings)


def page_stats(pages: DataFrame, headings: DataFrame, common_words: DataFrame) -> DataFrame:
    """The figures of every page of every report, with its stored count and status.

    ``readable_rows`` of the page's ``rows`` have text; ``count_matches`` tells whether a
    stored raw_character_count agrees with the text.
    """
    stored = (
        pages.where("doc_id is not null and page_index is not null")
        .groupBy("doc_id", "page_index")
        .agg(F.count("*").alias("rows"), F.count_if(F.col("status") == "ok").alias("ok_rows"), F.max("raw_character_count").alias("stored_count"))
    )
    k = kinds(pages, headings, common_words)
    return stored.join(k, ["doc_id", "page_index"], "left").select(
        "doc_id", "page_index", "rows", "ok_rows", "stored_count", "kind", "figures.*"
    ).withColumn("count_matches", F.col("stored_count") == F.col("characters")).drop("classes")


def report_stats(stats: DataFrame) -> DataFrame:
    """Figures of each report over its pages."""
    weight = lambda c: F.round(F.sum(F.col(c) * F.col("word_count")) / F.sum("word_count"), 6)
    return stats.groupBy("doc_id").agg(
        F.count("*").alias("pages"),
        F.count("kind").alias("pages_with_text"),
        *(F.count_if(F.col("kind") == k).alias(f"{k}_pages") for k in ("prose", "list", "table", "junk")),
        F.sum("word_count").alias("words"),
        F.sum("characters").alias("characters"),
        weight("mean_word_length").alias("mean_word_length"),
        weight("common_word_share").alias("common_word_share"),
        F.round(F.avg("symbol_ratio"), 6).alias("symbol_ratio"),
        F.round(F.avg("end_punctuation_share"), 6).alias("end_punctuation_share"),
        F.round(F.avg("duplicate_line_share"), 6).alias("duplicate_line_share"),
        F.count_if(~F.col("count_matches")).alias("wrong_counts"),
    )
