"""Fixed-capacity containers: best-fit over a histogram of lengths, then documents take planned slots.

Only the number of items of each length (at most ``capacity`` numbers) reaches
the driver. The plan is made for counts; bins that are filled alike are kept as
one interval of bin numbers, so planning costs the same for a thousand
documents and for a trillion. The plan's intervals are unfolded into slots on
the executors, and the r-th item of a length takes the r-th slot of that length.
"""

from __future__ import annotations

import bisect

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vinolake.llm.tokens import VOCABULARY, token_count
from vinolake.operators.scale import running, written

CAPACITY = 2048
#: Slots that one row of the unfolded plan stands for at most.
CHUNK = 50_000


def plan(histogram: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Best-fit decreasing over counts. Rows (length, first rank, items, first bin, items per bin, start), and the number of bins.

    Items [rank, rank + n) of a length go to bins first, first + 1, ..., ``per``
    in each; ``start`` is the fill of these bins before the first of them.
    """
    space: dict[int, list[tuple[int, int]]] = {}  # free space -> intervals (first bin, bins)
    order: list[int] = []
    rows, bins = [], 0

    def put(free: int, first: int, n: int) -> None:
        if free <= 0 or n <= 0:
            return
        if free not in space:
            bisect.insort(order, free)
            space[free] = []
        space[free].append((first, n))

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            k = bisect.bisect_left(order, length)
            if k == len(order):
                per = capacity // length
                whole, rest = divmod(left, per)
                if whole:
                    rows.append((length, rank, whole * per, bins, per, 0))
                    put(capacity - per * length, bins, whole)
                if rest:
                    rows.append((length, rank + whole * per, rest, bins + whole, per, 0))
                    put(capacity - rest * length, bins + whole, 1)
                bins += whole + bool(rest)
                break
            free = order[k]
            first, n = space[free].pop()
            if not space[free]:
                del space[free]
                order.pop(k)
            per = free // length
            use = min(n, left // per) if left >= per else 0
            if use:
                rows.append((length, rank, use * per, first, per, capacity - free))
                put(free - per * length, first, use)
                put(free, first + use, n - use)
                rank, left = rank + use * per, left - use * per
            else:
                rows.append((length, rank, left, first, left, capacity - free))
                put(free - left * length, first, 1)
                put(free, first + 1, n - 1)
                left = 0
    return rows, bins


def pack(sized: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(container, doc_id, piece, start, tokens) for documents (doc_id, tokens); every token of every document once.

    A document longer than ``capacity`` fills whole containers first and its
    rest is an item like any other; every other document is piece 0 and whole.
    Documents without tokens and null ids give no row. Rows that repeat a doc_id
    are items of their own. An empty table gives no rows.
    """
    if capacity < 1:
        raise ValueError("capacity must be positive")
    docs = sized.select(F.col("doc_id").cast("long"), F.col("tokens").cast("long")).where("doc_id is not null and tokens > 0")
    items = docs.select("doc_id", F.floor(F.col("tokens") / capacity).cast("int").alias("full"), (F.col("tokens") % capacity).cast("int").alias("length"))
    rest = items.where("length > 0")
    histogram = {r.length: r["count"] for r in rest.groupBy("length").count().collect()}  # at most capacity - 1 rows
    rows, bins = plan(histogram, capacity)
    spark = sized.sparkSession
    intervals = spark.createDataFrame(rows, "length int, rank0 bigint, n bigint, bin0 bigint, per bigint, start int")
    # An interval is cut into pieces of at most CHUNK slots before it is unfolded, both on the executors.
    step = F.col("per") * F.greatest(F.lit(1), F.floor(F.lit(CHUNK) / F.col("per")))
    planned = intervals.withColumn("at", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, step.cast("long")))).select(
        "length", (F.col("rank0") + F.col("at")).alias("rank0"), F.least(step, F.col("n") - F.col("at")).cast("long").alias("n"), (F.col("bin0") + F.floor(F.col("at") / F.col("per"))).cast("long").alias("bin0"), "per", "start"
    )
    slots = (
        planned.repartition("length", "rank0")
        .select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("j"))
        .select("length", (F.col("rank0") + F.col("j")).alias("rank"), (F.col("bin0") + F.floor(F.col("j") / F.col("per"))).cast("long").alias("container"), (F.col("start") + F.col("length") * (F.col("j") % F.col("per"))).cast("int").alias("start"))
    )
    placed = running(rest, ["length"], [F.col("doc_id")], name="rank").join(slots, ["length", "rank"])
    ends = placed.select("container", "doc_id", F.col("full").alias("piece"), "start", F.col("length").alias("tokens"))
    long = running(items.where("full > 0").withColumn("_all", F.lit(0)), ["_all"], [F.col("doc_id")], F.col("full"), name="before")
    fulls = long.select("doc_id", "before", F.explode(F.sequence(F.lit(0), F.col("full") - 1)).alias("piece")).select((F.lit(bins) + F.col("before") + F.col("piece")).cast("long").alias("container"), "doc_id", "piece", F.lit(0).alias("start"), F.lit(capacity).alias("tokens"))
    return ends.unionByName(fulls)


def packed_documents(documents: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY) -> DataFrame:
    """``pack`` over documents (doc_id, text), sized in tokens of a public tokenizer; whole texts, tokenized once."""
    return pack(written(documents.select("doc_id", token_count(F.col("text"), vocabulary).alias("tokens")), "sizes"), capacity)


def fill_report(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: containers, pieces, tokens and the used share of all capacity."""
    total = packed.agg(F.count_distinct("container").alias("containers"), F.count("*").alias("pieces"), F.sum("tokens").alias("tokens"))
    return total.withColumn("used_share", F.round(F.col("tokens") / (F.col("containers") * capacity), 6))
