"""Mixing sources to target weights with a low-discrepancy schedule.

Every source's documents are shuffled by hash and laid on a line, one copy of the
source after the other; the line is cut into blocks of equal tokens, so a block
may hold the end of one repetition and the start of the next. Slot i of the
schedule belongs to the source whose interval of the cumulative weights holds
the i-th golden-ratio point, so any stretch of the schedule is close to the
targets. The k-th slot of a source takes the k-th block of its line: the
documents that begin in it, whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vinolake.llm.tokens import VOCABULARY, token_count
from vinolake.operators.scale import running, small_side, written

#: Tokens of a block at most; blocks are smaller where a mixture would have fewer slots than SLOTS.
BLOCK, SLOTS = 4096, 4096
#: Golden-ratio step in integers of 31 bits, so that products never overflow.
MODULUS = 1 << 31
STEP = round(MODULUS * 0.6180339887498949) | 1


def mix(sized: DataFrame, targets: DataFrame, block: int | None = None, total: int | None = None) -> DataFrame:
    """(slot, source, doc_id, repetition, tokens) for documents (doc_id, source, tokens) and targets (source, target_share, max_repeats).

    ``total`` is the size of the mixture in tokens; without it the largest total
    at which every source can give its share within its repetitions. ``block`` is
    the size of a block; the tokens of a source differ from its target by what the
    schedule's discrepancy (about a slot) and one document make out. Repetition 0 is the first use of a document; none reaches max_repeats. Documents of no
    source, of a source without target, without tokens or id are not used.
    Shares are scaled to sum to 1 over the sources that have tokens; a null or
    non-positive share or repeat limit counts as no target. Of several targets of a source the
    greatest share counts. Empty inputs give no rows.
    """
    docs = sized.select(F.col("doc_id").cast("long"), "source", F.col("tokens").cast("long")).where("doc_id is not null and source is not null and tokens > 0")
    goal = targets.where("target_share > 0 and max_repeats > 0 and source is not null").groupBy(F.col("source").alias("_source")).agg(F.max("target_share").alias("share"), F.max_by("max_repeats", "target_share").alias("repeats"))
    goal = small_side(goal)
    supply = docs.groupBy("source").agg(F.sum("tokens").alias("supply"))
    # One row per source that has a target: as many as the hand-written table of targets.
    have = [r.asDict() for r in supply.join(goal, F.col("source") == F.col("_source")).select("source", "supply", "share", "repeats").orderBy("source").collect()]
    spark = sized.sparkSession
    empty = "slot bigint, source string, doc_id bigint, repetition int, tokens bigint"
    if not have:
        return spark.createDataFrame([], empty)
    weight = sum(r["share"] for r in have)
    most = min(r["supply"] * r["repeats"] / (r["share"] / weight) for r in have)
    size = most if total is None else total
    block = block or int(max(1, min(BLOCK, size // SLOTS)))
    slots = max(1, int(size // block))
    edge, rows = 0.0, []
    for r in have:
        lo, edge = edge, edge + r["share"] / weight
        rows.append((r["source"], int(lo * MODULUS), int(edge * MODULUS), r["supply"], r["repeats"]))
    rows[-1] = (*rows[-1][:2], MODULUS, *rows[-1][3:])
    plan = F.broadcast(spark.createDataFrame(rows, "source string, lo bigint, hi bigint, supply bigint, repeats int"))
    point = F.pmod((F.col("id") % MODULUS) * STEP, F.lit(MODULUS))
    # Sources are few and named by hand: a chain of comparisons, no join.
    owner = F.lit(None).cast("string")
    for name, lo, hi, _, _ in reversed(rows):
        owner = F.when((F.col("point") >= lo) & (F.col("point") < hi), F.lit(name)).otherwise(owner)
    schedule = spark.range(slots).withColumn("point", point).select(F.col("id").alias("slot"), owner.alias("source"))
    ranked = running(schedule, ["source"], [F.col("slot")], name="k", bucket=F.floor(F.col("slot") / max(1, slots // 64 + 1)).cast("int"))
    turns = ranked.select("slot", "source", F.col("k").alias("block"))
    # How far along its line each source is used: one row per source.
    wanted = F.broadcast(plan.join(F.broadcast(turns.groupBy("source").agg(F.max("block").alias("last"))), "source").select("source", "supply", "repeats", ((F.col("last") + 1) * block).alias("wanted")))
    used = docs.join(F.broadcast(plan.select("source")), "source", "left_semi")
    shuffled = running(used, ["source"], [F.xxhash64("doc_id", F.lit(17)), F.col("doc_id")], F.col("tokens"), name="before")
    # Only the copies of a document that begin before the end of what is used.
    copies = F.least(F.col("repeats").cast("long"), F.ceil((F.col("wanted") - F.col("before")) / F.col("supply")))
    line = shuffled.join(wanted, "source").withColumn("copies", copies).where("copies > 0").withColumn("repetition", F.explode(F.sequence(F.lit(0), (F.col("copies") - 1).cast("int"))))
    blocks = line.select("source", "doc_id", "tokens", "repetition", F.floor((F.col("repetition") * F.col("supply") + F.col("before")) / block).cast("long").alias("block"))
    return turns.join(blocks, ["source", "block"]).select("slot", "source", "doc_id", "repetition", "tokens")


def mixed_documents(documents: DataFrame, targets: DataFrame, block: int | None = None, total: int | None = None, vocabulary: str = VOCABULARY) -> DataFrame:
    """``mix`` over documents (doc_id, source, text), sized in tokens of a public tokenizer."""
    return mix(written(documents.select("doc_id", "source", token_count(F.col("text"), vocabulary).alias("tokens")), "sizes"), targets, block, total)


def share_report(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, actual_share, tokens, documents, most_uses) of every source with a target, used or not."""
    by = mixed.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count_distinct("doc_id").alias("documents"), (F.max("repetition") + 1).alias("most_uses"))
    whole = mixed.agg(F.sum("tokens").alias("whole"))
    goal = targets.where("source is not null").groupBy("source").agg(F.max("target_share").alias("target_share"))
    return (
        goal.join(by, "source", "left").join(F.broadcast(whole))
        .select("source", "target_share", F.round(F.coalesce(F.col("tokens"), F.lit(0)) / F.col("whole"), 6).alias("actual_share"), F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("most_uses", F.lit(0)).alias("most_uses"))
    )
