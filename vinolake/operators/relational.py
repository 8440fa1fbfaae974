"""Keyed and ordered operators: latest and first per key, upsert, ladder aggregation, coverage, rotation, segmentation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vinolake.functions.text import jaccard
from vinolake.operators.matching import set_similarity_join


def latest_per_key(df: DataFrame, keys: list[str], version: list[str]) -> DataFrame:
    """The row of each key with the greatest ``version`` columns (nulls least); ties go to the greatest row.

    A partial aggregation before the shuffle: a key with a third of all rows is
    reduced on every executor first. Null keys form a key of their own.
    """
    rest = [c for c in df.columns if c not in keys and c not in version]
    best = df.groupBy(*keys).agg(F.max(F.struct(*version, *rest)).alias("_b"))
    return best.select(*keys, *[F.col(f"_b.{c}").alias(c) for c in [*version, *rest]])


def first_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row of each key with the least ``order`` columns (nulls first), by partial aggregation."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    best = df.groupBy(*keys).agg(F.min(F.struct(*order, *rest)).alias("_b"))
    return best.select(*keys, *[F.col(f"_b.{c}").alias(c) for c in [*order, *rest]])


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``old`` with the rows of ``new`` put over it: a column keeps its old value where the new one is null."""
    values = [c for c in old.columns if c not in keys]
    o = old.select(*keys, *[F.col(c).alias(f"_o_{c}") for c in values])
    n = new.select(*keys, *[F.col(c).alias(f"_n_{c}") for c in values])
    return o.join(n, keys, "full_outer").select(*keys, *[F.coalesce(f"_n_{c}", f"_o_{c}").alias(c) for c in values])


def reference_ladder(observation: DataFrame, threshold: float = 0.6) -> DataFrame:
    """Per (producer, bucket, cuvee, vintage, shop) what other shops' observations of the same wine say.

    Rungs: the same cuvee and vintage (same_*), and the same cuvee of any
    vintage (any_*): median of price750, number of shops, number of
    observations. Cuvees are token sets and the same at Jaccard >= ``threshold``.
    The similarity join runs on distinct sets within a producer; observations are
    joined to the few sets like their own, never all against all.
    """
    obs = observation.where("price750 > 0 and producer is not null").select(
        "obs_id", "producer", "bucket", F.array_sort(F.array_distinct("cuvee")).alias("cuvee"), F.coalesce("vintage", F.lit(-1)).alias("vintage"), "shop", "price750"
    ).where(F.size("cuvee") > 0)
    sets = obs.select("producer", "bucket", F.col("cuvee").alias("tokens")).distinct()
    pairs = set_similarity_join(sets, ["producer", "bucket"], threshold).select("producer", "bucket", "set_a", "set_b")
    like = pairs.union(pairs.select("producer", "bucket", "set_b", "set_a")).union(sets.select("producer", "bucket", "tokens", "tokens")).toDF("producer", "bucket", "cuvee", "other")
    hits = obs.select("producer", "bucket", "cuvee", "vintage", "shop").distinct()
    # The pool is reduced to distinct prices with their number before it is joined.
    pool = obs.groupBy("producer", "bucket", F.col("cuvee").alias("other"), F.col("vintage").alias("v"), F.col("shop").alias("s"), "price750").agg(F.count("*").alias("n"))
    seen = hits.join(like, ["producer", "bucket", "cuvee"]).join(pool, ["producer", "bucket", "other"]).where("s <> shop")
    same = (F.col("v") == F.col("vintage")) & (F.col("vintage") >= 0)
    same_n = F.when(same, F.col("n")).otherwise(F.lit(0))
    found = seen.groupBy("producer", "bucket", "cuvee", "vintage", "shop").agg(
        F.percentile(F.when(same, F.col("price750")), 0.5, same_n).alias("same_median"), F.count_distinct(F.when(same, F.col("s"))).alias("same_shops"), F.sum(same_n).alias("same_n"),
        F.percentile("price750", 0.5, F.col("n")).alias("any_median"), F.count_distinct("s").alias("any_shops"), F.sum("n").alias("any_n"),
    )
    full = hits.join(found, ["producer", "bucket", "cuvee", "vintage", "shop"], "left")
    return full.select(
        "producer", "bucket", F.array_join("cuvee", " ").alias("cuvee"), "vintage", "shop", F.round("same_median", 4).alias("same_median"), F.coalesce("same_shops", F.lit(0)).alias("same_shops"),
        F.coalesce("same_n", F.lit(0)).alias("same_n"), F.round("any_median", 4).alias("any_median"), F.coalesce("any_shops", F.lit(0)).alias("any_shops"), F.coalesce("any_n", F.lit(0)).alias("any_n"),
    )


def market_basis(observation: DataFrame, threshold: float = 0.6) -> DataFrame:
    """(producer, seg, bucket, cuvee, vintage, shop, basis, confidence, price): what other shops say a wine costs, by the strongest comparison that holds.

    The same wine (cuvee and vintage) at one shop or more, else the same cuvee of any
    vintage, else the maker's line with three observations at two shops. Observations
    are first reduced to (wine, shop, price, number), so a median is of distinct prices
    with their frequency and a maker with a third of all rows meets itself only by its distinct wines.
    """
    obs = observation.where("price750 > 0 and producer is not null").select(
        "producer", F.coalesce("seg", F.lit("")).alias("seg"), "bucket", F.array_sort(F.array_distinct("cuvee")).alias("cuvee"), F.coalesce("vintage", F.lit(-1)).alias("vintage"), "shop", "price750"
    ).where(F.size("cuvee") > 0)
    sets = obs.select("producer", "bucket", F.col("cuvee").alias("tokens")).distinct()
    pairs = set_similarity_join(sets, ["producer", "bucket"], threshold).select("producer", "bucket", "set_a", "set_b")
    like = pairs.union(pairs.select("producer", "bucket", "set_b", "set_a")).union(sets.select("producer", "bucket", "tokens", "tokens")).toDF("producer", "bucket", "cuvee", "other")
    hits = obs.select("producer", "seg", "bucket", "cuvee", "vintage", "shop").distinct()
    pool = obs.groupBy("producer", "bucket", F.col("cuvee").alias("other"), F.col("vintage").alias("v"), F.col("shop").alias("s"), "price750").agg(F.count("*").alias("n"))
    wine = ["producer", "bucket", "cuvee", "vintage", "shop"]
    seen = hits.select(*wine).distinct().join(like, ["producer", "bucket", "cuvee"]).join(pool, ["producer", "bucket", "other"]).where("s <> shop")
    same = (F.col("v") == F.col("vintage")) & (F.col("vintage") >= 0)
    found = seen.groupBy(*wine).agg(
        F.percentile(F.when(same, F.col("price750")), 0.5, F.when(same, F.col("n")).otherwise(F.lit(0))).alias("p1"), F.count_distinct(F.when(same, F.col("s"))).alias("s1"),
        F.percentile("price750", 0.5, F.col("n")).alias("p2"), F.count_distinct("s").alias("s2"),
    )
    lines = obs.groupBy("producer", "seg", "bucket", F.col("shop").alias("s"), "price750").agg(F.count("*").alias("n"))
    line = ["producer", "seg", "bucket", "shop"]
    rest = hits.select(*line).distinct().join(lines, ["producer", "seg", "bucket"]).where("s <> shop").groupBy(*line).agg(F.percentile("price750", 0.5, F.col("n")).alias("p3"), F.count_distinct("s").alias("s3"), F.sum("n").alias("n3"))
    every = hits.join(found, wine, "left").join(rest, line, "left")
    s1, s2 = F.coalesce("s1", F.lit(0)), F.coalesce("s2", F.lit(0))
    lined = (F.coalesce("n3", F.lit(0)) >= 3) & (F.coalesce("s3", F.lit(0)) >= 2)
    return every.select(
        "producer", "seg", "bucket", F.array_join("cuvee", " ").alias("cuvee"), "vintage", "shop",
        F.when(s1 >= 1, "same wine").when(s2 >= 1, "same cuvee").when(lined, "same line").alias("basis"),
        F.when(s1 >= 2, "high").when((s1 == 1) | (s2 >= 2), "medium").when((s2 == 1) | lined, "low").alias("confidence"),
        F.round(F.when(s1 >= 1, F.col("p1")).when(s2 >= 1, F.col("p2")).when(lined, F.col("p3")), 4).alias("price"),
    )


def rotate(df: DataFrame, order: str, offset: Column) -> DataFrame:
    """``df`` with column turn: its place when the list sorted by ``order`` starts at ``offset`` (round robin). For small control tables."""
    n = df.count()
    place = F.row_number().over(Window.orderBy(order)) - 1
    return df.withColumn("turn", F.pmod(place - offset, F.lit(max(n, 1))).cast("int"))


__all__ = ["first_per_key", "jaccard", "latest_per_key", "market_basis", "reference_ladder", "rotate", "upsert"]
