"""Problem 1: lines repeated across the pages of one report.

Each page becomes its array of line keys. Nodes of a report's graph are its keys,
weighted by the number of distinct pages they stand on; edges join the keys of
consecutive lines, and the first and last line to the page's two ends, weighted the same
way. Nodes and edges of high support stay. A connected component of two or more lines is
a boilerplate block, and so is a single line that an edge holds to an end of the page.
A line that is frequent but stands among changing neighbours in the middle of pages (a
caption, a unit) is in no block.

``find`` returns every occurrence of a high-support node, with its block if it has one:
TESTDATA.md counts lines one by one, so all of them are cases. ``removable`` chooses what
is taken out of the pages: the occurrences of blocks, and of lines without a block only
where they stand on LONE_SHARE_PERCENT of the report's pages.

Scale. Text leaves the scan only as 8-byte keys. Supports are counted by
``groupBy`` with map-side partial sums. A report keeps at most
(lines per page) / min_share nodes, since each stands on that share of its pages, so
the kept graph of one report is small however many pages the report has; it is
the only thing ever gathered by report, one report at a time. The join back is on
(report, salt), so a report that holds a third of all pages is spread over ``SALTS`` tasks.

Edge cases: null doc_id or page_index, null or blank raw_text: the row is no page
with text and is neither counted nor searched (``remove_lines`` passes it through).
Several rows of one page count once. An empty table gives an empty result.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.functions.text import is_blank
from pagewright.llm.pages import line_keys, with_text
from pagewright.session import cut

MIN_PAGES = 4
MIN_SHARE_PERCENT = 15
LONE_SHARE_PERCENT = 50
SALTS = 16

BLOCKS = "doc_id string, line_key long, block_id long, block_lines int"
PAGE_END = 0  # the key of both ends of a page


def page_keys(pages: DataFrame, keys=line_keys) -> DataFrame:
    """(doc_id, page_index, line_keys): one row for each page with text; ``keys`` makes the array from raw_text."""
    return (
        with_text(pages.select("doc_id", "page_index", "raw_text"))
        .select("doc_id", "page_index", keys(F.col("raw_text")).alias("line_keys"))
        .groupBy("doc_id", "page_index")
        .agg(F.max("line_keys").alias("line_keys"))
    )


def supported_nodes(keys: DataFrame, min_pages: int = MIN_PAGES, min_share_percent: int = MIN_SHARE_PERCENT) -> DataFrame:
    """(doc_id, line_key, support, pages, needed): nodes on enough distinct pages of their report."""
    counts = keys.groupBy("doc_id").agg(F.count("*").alias("pages"))
    return (
        keys.select("doc_id", F.explode(F.array_distinct("line_keys")).alias("line_key"))
        .where("line_key is not null")
        .groupBy("doc_id", "line_key")
        .agg(F.count("*").alias("support"))
        .where(F.col("support") >= min_pages)
        .join(counts, "doc_id")
        .where(F.col("support") * 100 >= min_share_percent * F.col("pages"))
        .select("doc_id", "line_key", "support", "pages", F.greatest(F.lit(min_pages), F.ceil(F.col("pages") * min_share_percent / 100)).alias("needed"))
    )


def _salted(keys: DataFrame, per_report: DataFrame, salts: int) -> DataFrame:
    """Join pages to one row per report without gathering a report's pages in one task."""
    # Merged, not broadcast: Spark's estimate of a report's list misses its copies.
    spread = per_report.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).hint("merge")
    return keys.withColumn("salt", F.pmod(F.col("page_index"), F.lit(salts))).join(spread, ["doc_id", "salt"]).drop("salt")


def _report_blocks(doc, nodes: set, edges: list) -> list[tuple]:
    """(doc, key, block or null, lines of the block): union-find over one report's kept edges; a block's id is its least key."""
    parent = {k: k for k in nodes}

    def root(x):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    held = set()
    for a, b in edges:
        if PAGE_END in (a, b):
            held.add(a if b == PAGE_END else b)
        else:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    lines: dict = {}
    for k in nodes:
        lines.setdefault(root(k), []).append(k)
    return [(doc, k, r if len(ks) > 1 or k in held else None, len(ks)) for r, ks in lines.items() for k in ks]


def _components(batches):
    """``_report_blocks`` of each report in turn; rows come sorted by report, so that one graph is held at a time."""
    doc, nodes, edges, columns = None, set(), [], [c.split()[0] for c in BLOCKS.split(", ")]
    frame = lambda rows: pd.DataFrame(rows, columns=columns).astype({"line_key": "Int64", "block_id": "Int64"})
    for pdf in batches:
        out = []
        for d, a, b in zip(pdf.doc_id, pdf.a.tolist(), pdf.b.tolist()):
            if d != doc:
                out += _report_blocks(doc, nodes, edges)
                doc, nodes, edges = d, set(), []
            # A self-edge is the mark of a node, no edge of the graph.
            if a == b:
                nodes.add(a)
            else:
                edges.append((a, b))
        yield frame(out)
    yield frame(_report_blocks(doc, nodes, edges))


def blocks(keys: DataFrame, nodes: DataFrame, salts: int = SALTS) -> DataFrame:
    """(doc_id, line_key, block_id, block_lines): every node, with its block or null."""
    kept = nodes.groupBy("doc_id").agg(F.collect_list("line_key").alias("kept"), F.first("needed").alias("needed"))
    # The page's ends are neighbours too; of two lines in a row one key may repeat, which is no edge.
    chain = F.concat(F.array(F.lit(PAGE_END).cast("long")), F.filter("line_keys", lambda k: k.isNotNull()), F.array(F.lit(PAGE_END).cast("long")))
    known = lambda k: (k == PAGE_END) | F.array_contains("kept", k)
    pair = F.array_distinct(
        F.filter(
            F.zip_with(F.slice("chain", 1, F.size("chain") - 1), F.slice("chain", 2, F.size("chain")), lambda a, b: F.struct(a.alias("a"), b.alias("b"))),
            lambda e: (e["a"] != e["b"]) & known(e["a"]) & known(e["b"]),
        )
    )
    edges = (
        _salted(keys, kept, salts)
        .withColumn("chain", chain)
        .select("doc_id", "needed", F.explode(pair).alias("e"))
        .groupBy("doc_id", "needed", "e")
        .agg(F.count("*").alias("weight"))
        .where("weight >= needed")
        .select("doc_id", F.col("e.a").alias("a"), F.col("e.b").alias("b"))
    )
    graph = edges.unionByName(nodes.select("doc_id", F.col("line_key").alias("a"), F.col("line_key").alias("b")))
    return graph.repartition("doc_id").sortWithinPartitions("doc_id").mapInPandas(_components, BLOCKS)


def occurrences(keys: DataFrame, members: DataFrame, salts: int = SALTS) -> DataFrame:
    """(doc_id, page_index, line_no, block_id, block_lines, share_percent): every line of a page that is a node."""
    m = F.struct("line_key", "block_id", "block_lines", "share_percent")
    per_report = members.groupBy("doc_id").agg(F.collect_list("line_key").alias("kept"), F.collect_list(m).alias("members"))
    return (
        _salted(keys, per_report, salts)
        .select("doc_id", "page_index", "members", F.posexplode(F.transform("line_keys", lambda k: F.array_contains("kept", k))).alias("line_no", "hit"), "line_keys")
        .where("hit")
        .select("doc_id", "page_index", "line_no", F.expr("get(filter(members, m -> m.line_key = line_keys[line_no]), 0)").alias("m"))
        .select("doc_id", "page_index", "line_no", "m.block_id", "m.block_lines", "m.share_percent")
    )


def find(pages: DataFrame, min_pages: int = MIN_PAGES, min_share_percent: int = MIN_SHARE_PERCENT, salts: int = SALTS) -> DataFrame:
    """(doc_id, page_index, line_no, block_id, block_lines, share_percent) of every repeated line."""
    keys = cut(page_keys(pages))
    nodes = cut(supported_nodes(keys, min_pages, min_share_percent))
    share = nodes.select("doc_id", "line_key", (F.col("support") * 100 / F.col("pages")).alias("share_percent"))
    return occurrences(keys, blocks(keys, nodes, salts).join(share, ["doc_id", "line_key"]), salts)


def removable(found: DataFrame, lone_share_percent: int = LONE_SHARE_PERCENT) -> DataFrame:
    """The occurrences to take out: those of blocks, and single lines on very many pages."""
    return found.where(F.col("block_id").isNotNull() | (F.col("share_percent") >= lone_share_percent))


def remove_lines(pages: DataFrame, found: DataFrame) -> DataFrame:
    """``pages`` with ``clean_text``: raw_text without the lines in ``found`` (see ``removable``).

    Every input row comes out once; rows without text keep their raw_text.
    """
    lines = found.groupBy("doc_id", "page_index").agg(F.collect_set("line_no").alias("_gone"))
    split = F.split("raw_text", "\n", -1)
    kept = F.filter(split, lambda x, i: ~F.array_contains("_gone", i))
    clean = F.when(F.col("_gone").isNull() | is_blank(F.col("raw_text")), F.col("raw_text")).otherwise(F.array_join(kept, "\n"))
    return pages.join(lines, ["doc_id", "page_index"], "left").withColumn("clean_text", clean).drop("_gone")
