"""Problem 6: documents into containers of fixed capacity.

Documents are dealt by hash to partitions of bounded size; each partition is packed
by best-fit decreasing. Lower bounds from dual-feasible functions certify the count, of each
partition and of all documents together: a packing that reaches the bound is optimal. While
the total is above its bound, partitions exchange documents: every partition gives up its
loosest containers (as many as its own gap, and one more), these meet those of others in pools, are
packed again, and replace the old ones where they are fewer. Pools are mixed anew each round; a
round that saves nothing makes them larger, until they hold ``per_part`` documents.

Only a document larger than the capacity is split: into pieces of exactly the
capacity and one rest, so that its token spans are [start, end).

Scale. The text is read only to size documents without n_tokens; from then on a row
is three integers. A partition holds about ``per_part`` pieces whatever the corpus
size, hashing spreads any source, and nothing is gathered on the driver but
the number of rows.

Edge cases. Null text without n_tokens has size 0; size 0 takes no room and shares a
container. Capacities null or below 1 are ignored; duplicates of a capacity count once.
"""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.functions.text import token_count
from pagewright.session import cut

PER_PART = 4_000
POOL = 16  # containers that are packed together at first
LOOSE_FACTOR = 6  # room of the containers given up, in multiples of the gap and one more

PACKED = "capacity_tokens int, doc_id long, piece_no int, token_start long, token_end long, part long, bin long, bound long, used long"


def sizes(documents: DataFrame, *also: str) -> DataFrame:
    """(doc_id, size): n_tokens where known, else the tokenizer's count; ``also`` passes columns through."""
    unknown = F.when(F.col("n_tokens").isNull(), F.col("text"))
    return documents.select("doc_id", *also, F.coalesce(F.col("n_tokens"), token_count(unknown), F.lit(0)).cast("long").alias("size"))


def pieces(sized: DataFrame, specs: DataFrame) -> DataFrame:
    """One row for each piece of each document at each capacity."""
    caps = specs.where("capacity_tokens >= 1").select("capacity_tokens").distinct()
    # A handful of capacities: explode an array of them, which is no join.
    values = sorted(r[0] for r in caps.collect())
    if not values:
        return sized.select(F.lit(None).cast("int").alias("capacity_tokens"), "doc_id", F.lit(0).alias("piece_no"), F.lit(0).cast("long").alias("token_start"), F.lit(0).cast("long").alias("token_end")).limit(0)
    c = F.col("capacity_tokens")
    return (
        sized.withColumn("capacity_tokens", F.explode(F.array(*(F.lit(v) for v in values))))
        .withColumn("piece_no", F.explode(F.sequence(F.lit(0), F.greatest(F.floor((F.col("size") - 1) / c), F.lit(0)).cast("int"))))
        .select(
            "capacity_tokens",
            "doc_id",
            "piece_no",
            (F.col("piece_no").cast("long") * c).alias("token_start"),
            F.least("size", (F.col("piece_no").cast("long") + 1) * c).alias("token_end"),
        )
    )


def best_fit_decreasing(need: np.ndarray, capacity: int) -> np.ndarray:
    """Container number for each size; the fullest container that still takes it."""
    bins = np.empty(len(need), dtype=np.int64)
    open_at: dict[int, list[int]] = {}
    mask = 0  # bit r: a container with r tokens of room is open
    made = 0
    for i in np.argsort(-need, kind="stable"):
        size = int(need[i])
        fit = mask >> size
        if fit:
            room = (fit & -fit).bit_length() - 1 + size
            at = open_at[room].pop()
            if not open_at[room]:
                mask &= ~(1 << room)
        else:
            room, at, made = capacity, made, made + 1
        bins[i] = at
        left = room - size
        open_at.setdefault(left, []).append(at)
        mask |= 1 << left
    return bins


def lower_bound(need: np.ndarray, capacity: int) -> int:
    """Containers that any packing needs: the best of three families of dual-feasible functions."""
    if not len(need):
        return 0
    sizes_, counts = np.unique(need, return_counts=True)
    return histogram_bound(sizes_, counts, capacity)


def histogram_bound(at: np.ndarray, number_at: np.ndarray, capacity: int) -> int:
    """``lower_bound`` from sizes and how often each occurs."""
    count = np.zeros(capacity + 1, dtype=np.int64)
    count[at] = number_at
    x = np.arange(capacity + 1, dtype=np.int64)
    best = max(1, -(-int((count * x).sum()) // capacity))
    # f_e: 1 above capacity - e, 0 below e, x / capacity between.
    weight, number = np.cumsum(count * x), np.cumsum(count)
    e = np.arange(1, capacity // 2 + 1)
    middle = weight[capacity - e] - weight[e - 1]
    best = max(best, int((number[capacity] - number[capacity - e] - (-middle // capacity)).max(initial=0)))
    # u_k: rounding of (k + 1) x / capacity.
    for k in range(1, 21):
        whole = (k + 1) * x
        value = np.where(whole % capacity == 0, x * k, (whole // capacity) * capacity)
        best = max(best, -(-int((count * value).sum()) // (k * capacity)))
    return best


COLUMNS = [c.split()[0] for c in PACKED.split(", ")]


def _certified(pdf: pd.DataFrame) -> pd.DataFrame:
    """One partition with its bound and the number of containers it uses."""
    need = (pdf.token_end - pdf.token_start).to_numpy()
    return pdf.assign(bound=lower_bound(need, int(pdf.capacity_tokens.iloc[0])), used=pdf.bin.nunique())[COLUMNS]


def _pack_part(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values(["doc_id", "piece_no"], ignore_index=True)
    return _certified(pdf.assign(bin=best_fit_decreasing((pdf.token_end - pdf.token_start).to_numpy(), int(pdf.capacity_tokens.iloc[0]))))


def _loose(packed: DataFrame) -> DataFrame:
    """``packed`` with ``open``: whether the container takes part in the exchange.

    Of each partition the containers with the most room go, until their room is
    LOOSE_FACTOR times what would close its gap and save one container more.
    """
    bins = packed.groupBy("capacity_tokens", "part", "bin").agg(
        (F.first("capacity_tokens") - F.sum(F.col("token_end") - F.col("token_start"))).alias("room"), F.first(F.col("used") - F.col("bound")).alias("gap")
    )
    before = F.expr("sum(room) over (partition by capacity_tokens, part order by room desc, bin rows between unbounded preceding and 1 preceding)")
    loose = (
        bins.where("room > 0")
        .withColumn("before", F.coalesce(before, F.lit(0)))
        .where(F.col("before") < (F.col("gap") + 1) * F.col("capacity_tokens") * LOOSE_FACTOR)
        .select("capacity_tokens", "part", "bin", F.lit(True).alias("open"))
    )
    return packed.join(loose, ["capacity_tokens", "part", "bin"], "left").withColumn("open", F.coalesce("open", F.lit(False)))


def _repack(turn: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "piece_no"], ignore_index=True)
        fresh = best_fit_decreasing((pdf.token_end - pdf.token_start).to_numpy(), int(pdf.capacity_tokens.iloc[0]))
        if fresh.max() + 1 < len(pdf[["part", "bin"]].drop_duplicates()):
            pdf = pdf.assign(part=((turn + 1) << 40) + pdf.pool, bin=fresh)
        return pdf[COLUMNS]

    return run


def _bounds(pieces_: DataFrame) -> DataFrame:
    """(capacity_tokens, lower_bound): what any packing of all pieces needs, from the histogram of sizes."""

    def bound(pdf: pd.DataFrame) -> pd.DataFrame:
        c = int(pdf.capacity_tokens.iloc[0])
        return pd.DataFrame({"capacity_tokens": [c], "lower_bound": [histogram_bound(pdf.size_tokens.to_numpy(), pdf["n"].to_numpy(), c)]})

    histogram = pieces_.groupBy("capacity_tokens", (F.col("token_end") - F.col("token_start")).alias("size_tokens")).agg(F.count("*").alias("n"))
    return histogram.groupBy("capacity_tokens").applyInPandas(bound, "capacity_tokens int, lower_bound long")


def _used(packed: DataFrame) -> dict:
    """Containers of each capacity, and the pieces in them."""
    bins = packed.groupBy("capacity_tokens", "part", "bin").agg(F.count("*").alias("n")).groupBy("capacity_tokens").agg(F.count("*").alias("bins"), F.sum("n").alias("n"))
    return {r.capacity_tokens: (r.bins, r.n) for r in bins.collect()}


def pack(documents: DataFrame, specs: DataFrame, per_part: int = PER_PART, rounds: int | None = None) -> DataFrame:
    """Every piece of every document with its container (part, bin), at each capacity.

    ``bound`` and ``used`` tell how many containers the partition needs at least, and uses.
    ``rounds``: at most so many rounds of exchange; None for all that save a container.
    """
    todo = cut(pieces(sizes(documents), specs))
    most = todo.groupBy("capacity_tokens").count().agg(F.max("count")).first()[0] or 0
    parts = max(1, -(-most // per_part))
    part = F.pmod(F.xxhash64("doc_id", "piece_no"), F.lit(parts))
    dealt = todo.withColumn("part", part).withColumns({"bin": F.lit(0).cast("long"), "bound": F.lit(0).cast("long"), "used": F.lit(0).cast("long")})
    packed = cut(dealt.groupBy("capacity_tokens", "part").applyInPandas(_pack_part, PACKED))
    if parts == 1 or rounds == 0:
        return packed
    bound = {r.capacity_tokens: r.lower_bound for r in _bounds(todo).collect()}
    mixed = cut(_loose(packed))
    # Only the open containers move; those that stay are read again at the end.
    closed, exchanged = mixed.where("not open").select(*COLUMNS), mixed.where("open").select(*COLUMNS)
    fixed, now, pool = _used(closed), _used(exchanged), POOL
    for turn in itertools.count() if rounds is None else range(rounds):
        gaps = {c: fixed.get(c, (0, 0))[0] + bins - bound[c] for c, (bins, _) in now.items()}
        if not any(g > 0 for g in gaps.values()):
            break
        pools = max(1, -(-max(bins for bins, _ in now.values()) // pool))
        dealt = exchanged.withColumn("pool", F.pmod(F.xxhash64("part", "bin", F.lit(turn)), F.lit(pools)))
        exchanged = cut(dealt.groupBy("capacity_tokens", "pool").applyInPandas(_repack(turn), PACKED))
        after = _used(exchanged)
        if after == now:
            if pools == 1 or max(n for _, n in now.values()) / pools > per_part:
                break
            pool *= 4
        now = after
    return cut(closed.unionByName(exchanged).groupBy("capacity_tokens", "part").applyInPandas(_certified, PACKED))


def oversize(packed: DataFrame) -> DataFrame:
    """(capacity_tokens, doc_id) of the documents that had to be split."""
    return packed.where("piece_no = 1").select("capacity_tokens", "doc_id")


def containers(packed: DataFrame) -> DataFrame:
    """One row for each container: its pieces and the tokens in it."""
    return packed.groupBy("capacity_tokens", "part", "bin").agg(F.count("*").alias("pieces"), F.sum(F.col("token_end") - F.col("token_start")).alias("tokens"))


def certificates(packed: DataFrame) -> DataFrame:
    """Per capacity: containers used, what any packing of all documents needs, and how full they are."""
    used = containers(packed).groupBy("capacity_tokens").agg(F.count("*").alias("containers"), F.sum("tokens").alias("tokens"))
    fill = F.round(F.col("tokens") / (F.col("containers") * F.col("capacity_tokens")), 6)
    return used.join(_bounds(packed), "capacity_tokens").withColumn("fill", fill)
