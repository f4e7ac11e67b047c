"""Text normalisation and the financial tokenizer as column expressions.

JVM expressions wherever they exist. NFKC and case folding have no Spark
built-in; they run as one Arrow function that receives only the strings that
need it (the rest cross as nulls), so plain ASCII text never leaves the JVM.
Every function maps null to null and the empty string to its natural result
(empty string, empty array).
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# The characters that Python's str.isspace() accepts, as a Java class body.
PY_SPACE = r"\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"

# Fixed value: a number with sign, groups and percent, or a run of letters.
TOKEN_PATTERN = r"[+\-]?\p{Nd}+(?:[.,]\p{Nd}+)*%?|[\p{L}\p{Nl}\p{No}]+"

# English function words that the stop-word analyzer drops; negation stays.
STOPWORDS = tuple(
    """
    a an the and or but if as at by for from in into of on onto to with than
    that this these those is are was were be been being am do does did have has had
    i me my we us our ours you your yours he him his she her hers it its they them
    their theirs who whom whose which what when where why how
    """.split()
)


def _apply(fn):
    @F.pandas_udf(StringType())
    def run(s: pd.Series) -> pd.Series:
        return s.map(fn, na_action="ignore")

    return run


_nfkc = _apply(lambda t: unicodedata.normalize("NFKC", t))
_casefold = _apply(str.casefold)
_nfkc_fold = _apply(lambda t: " ".join(unicodedata.normalize("NFKC", t).replace("\u2212", "-").split()).casefold())


def only_where(condition: Column, text: Column, udf) -> Column:
    """``udf(text)`` where ``condition``, else ``text``; other rows cross as null."""
    return F.coalesce(udf(F.when(condition, text)), text)


def has_non_ascii(text: Column) -> Column:
    """More bytes than characters; no pattern has to look at each of them."""
    return F.octet_length(text) != F.length(text)


def nfkc(text: Column) -> Column:
    """Unicode NFKC."""
    return only_where(has_non_ascii(text), text, _nfkc)


def casefold(text: Column) -> Column:
    """Unicode case folding (as ``s.casefold()``), nothing else."""
    return F.coalesce(_casefold(F.when(has_non_ascii(text), text)), F.lower(text))


def collapse_space(text: Column) -> Column:
    """Runs of white space to one space, ends trimmed (as ``" ".join(s.split())``)."""
    return F.trim(F.regexp_replace(text, f"[{PY_SPACE}]+", " "))


def fold(text: Column) -> Column:
    """NFKC, minus sign to hyphen, white space collapsed, case folded."""
    return F.coalesce(_nfkc_fold(F.when(has_non_ascii(text), text)), F.lower(collapse_space(text)))


def normalize_search_text(text: Column) -> Column:
    """NFKC, minus sign to hyphen, white space collapsed; case kept."""
    return collapse_space(F.translate(nfkc(text), "\u2212", "-"))


def tokenize(text: Column) -> Column:
    """Array of tokens, in order, repeats kept; null for null."""
    return F.regexp_extract_all(fold(text), F.lit(TOKEN_PATTERN), F.lit(0))


def token_count(text: Column) -> Column:
    """Number of tokens without building the array."""
    return F.regexp_count(fold(text), F.lit(TOKEN_PATTERN))


def drop_stopwords(tokens: Column) -> Column:
    """Tokens without function words; order and repeats stay."""
    return F.filter(tokens, lambda t: ~t.isin(*STOPWORDS))


def tokenize_content(text: Column) -> Column:
    return drop_stopwords(tokenize(text))


def is_blank(text: Column) -> Column:
    """Null, empty or white space only."""
    return text.isNull() | ~text.rlike(f"[^{PY_SPACE}]")
