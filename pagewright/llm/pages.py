"""What the operators on native_pages share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.functions.text import PY_SPACE, is_blank, nfkc


def line_keys(text: Column) -> Column:
    """One 64-bit key per line of ``text`` (split at LF), null for lines without content.

    Lines have one key if they are equal after NFKC, lower-casing, removal of all
    white space and replacement of each digit run by one sign. The steps run on the
    whole page, since none of them can act across an LF.
    """
    t = F.lower(nfkc(text))
    t = F.regexp_replace(t, f"[{PY_SPACE}&&[^\\n]]+", "")
    t = F.regexp_replace(t, "[0-9]+", "#")
    return F.transform(F.split(t, "\n", -1), lambda x: F.when(x != "", F.xxhash64(x)))


def with_text(pages: DataFrame) -> DataFrame:
    """Rows that name a page and have non-blank raw_text."""
    return pages.where(F.col("doc_id").isNotNull() & F.col("page_index").isNotNull() & ~is_blank(F.col("raw_text")))


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores, if its scan has fewer tasks than the session has cores; large inputs stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.rdd().getNumPartitions() < cores else df
