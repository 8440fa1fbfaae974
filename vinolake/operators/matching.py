"""Joins on text: alias containment, near misses at one edit, and a set similarity join with prefix filtering."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vinolake.functions.text import is_plural_of, jaccard, match_key
from vinolake.operators.scale import BROADCAST_ROWS, small_side

try:
    import ahocorasick
except ImportError:
    ahocorasick = None


#: Letters of an alias that texts are joined on where no automaton holds all aliases.
HEAD = 6


def alias_matches(texts: DataFrame, aliases: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    """(key, producer, alias): the longest alias of each producer contained in the folded text, shorter names inside longer ones suppressed.

    ``aliases`` is (producer, alias). Containment is of raw substrings, as the
    names are matched without word boundaries. A producer whose alias lies
    inside another matched producer's alias is dropped; two with equal aliases
    drop each other. Null and empty texts and aliases match nothing.

    With an alias list of bounded size every text is read once by an automaton
    of all aliases; a larger list, or no automaton library, is joined on the first HEAD letters of the aliases.
    """
    keys = texts.select(F.col(key), match_key(F.col(text)).alias("_k")).where("_k <> ''")
    names = aliases.select("producer", match_key(F.col("alias")).alias("a")).where("a <> ''").distinct()
    # the automaton needs the list itself; bounded by the check
    listed = names.limit(BROADCAST_ROWS + 1).collect() if ahocorasick else []
    if listed and len(listed) <= BROADCAST_ROWS:
        owners: dict[str, list[str]] = {}
        for r in listed:
            owners.setdefault(r.a, []).append(r.producer)
        shared = texts.sparkSession.sparkContext.broadcast(sorted(owners))

        def scan(batches):
            machine = ahocorasick.Automaton()
            for a in shared.value:
                machine.add_word(a, a)
            machine.make_automaton()
            for b in batches:
                ids, found = [], []
                for i, k in zip(b[key], b["_k"]):
                    for a in {w for _, w in machine.iter(k)}:
                        ids.append(i)
                        found.append(a)
                yield pd.DataFrame({key: pd.Series(ids, dtype=b[key].dtype), "a": pd.Series(found, dtype="object")})

        hits = keys.mapInPandas(scan, f"{key} {dict(keys.dtypes)[key]}, a string").join(F.broadcast(names), "a")
    else:
        # The head of an alias is a substring of every text that contains it: an equality, then the check.
        heads = names.withColumn("_g", F.substring("a", 1, HEAD))
        grams = F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), F.length("_k")), lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(HEAD), F.length("_k") - i + 1)), lambda n: F.substring(F.col("_k"), i, n)))))
        hits = keys.withColumn("_g", F.explode(grams)).join(heads, "_g").where(F.contains(F.col("_k"), F.col("a"))).drop("_k", "_g").distinct()
    best = hits.groupBy(key, "producer").agg(F.max(F.struct(F.length("a").alias("n"), F.col("a"))).alias("b")).select(key, "producer", F.col("b.a").alias("alias"))
    # Matches of one text are few (one per producer named in it), so an array per text is small.
    every = best.groupBy(key).agg(F.collect_list(F.struct("producer", "alias")).alias("_all"))
    kept = F.filter("_all", lambda x: ~F.exists("_all", lambda o: (o["producer"] != x["producer"]) & F.contains(o["alias"], x["alias"])))
    return every.select(key, F.explode(kept).alias("m")).select(key, "m.producer", "m.alias")


def near_misses(words: DataFrame, aliases: DataFrame, seen: DataFrame, min_length: int = 7) -> DataFrame:
    """(producer, shop, word): the first word of a shop at one edit from a rare alias token of a producer that was not seen.

    ``words`` is (shop, word), ``aliases`` (producer, alias), ``seen``
    (producer). Words and tokens used by more than one shop are vocabulary, and
    plurals are no typos. Blocked on first letter and length, compared on
    distinct words.
    """
    spread = words.where(F.length("word") >= min_length - 1).groupBy("word").agg(F.count_distinct("shop").alias("shops"), F.min("shop").alias("shop"))
    alone = spread.where("shops = 1")
    unseen = aliases.join(seen.select("producer").distinct(), "producer", "left_anti")
    target = unseen.select("producer", F.explode(F.split(match_key(F.col("alias")), " ")).alias("target")).where(F.length("target") >= min_length).distinct()
    target = target.join(spread.where("shops > 1").select(F.col("word").alias("target")), "target", "left_anti")
    blocked = target.withColumn("len", F.explode(F.array(*[F.length("target") + d for d in (-1, 0, 1)]))).withColumn("head", F.substring("target", 1, 1))
    near = alone.withColumn("len", F.length("word")).withColumn("head", F.substring("word", 1, 1)).join(small_side(blocked), ["len", "head"])
    hit = near.where((F.levenshtein("word", "target", 1) == 1) & ~is_plural_of(F.col("word"), F.col("target")))
    return hit.groupBy("producer", "shop").agg(F.min("word").alias("word"))


def set_similarity_join(sets: DataFrame, by: list[str], threshold: float = 0.6) -> DataFrame:
    """(by..., set_a, set_b, similarity) of the pairs of different token sets within a block at Jaccard >= ``threshold``.

    ``sets`` is (by..., tokens array of strings); duplicates and order are
    ignored, null and empty sets pair with nothing. Exact: two sets can only
    reach the threshold if they share a token among the rarest
    ``size - ceil(threshold * size) + 1`` of each, so only those are joined on;
    common words never become a join key of more than the sets they are rare in.
    """
    clean = sets.select(*by, F.array_sort(F.array_distinct(F.filter("tokens", lambda t: t.isNotNull()))).alias("tokens")).where(F.size("tokens") > 0).distinct()
    words = clean.select(*by, "tokens", F.explode("tokens").alias("token"))
    rarity = words.groupBy(*by, "token").agg(F.count("*").alias("df"))
    ordered = words.join(rarity, [*by, "token"]).groupBy(*by, "tokens").agg(F.array_sort(F.collect_list(F.struct("df", "token"))).alias("o"))
    keep = F.size("tokens") - F.ceil(F.lit(threshold) * F.size("tokens") - 1e-9) + 1
    prefix = ordered.select(*by, "tokens", F.explode(F.slice("o", F.lit(1), keep.cast("int"))).alias("p")).select(*by, "tokens", F.col("p.token").alias("token"))
    a, b = prefix.withColumnRenamed("tokens", "set_a"), prefix.withColumnRenamed("tokens", "set_b")
    sized = (F.size("set_b") >= math.floor(threshold * 1e6) / 1e6 * F.size("set_a")) & (F.size("set_a") >= math.floor(threshold * 1e6) / 1e6 * F.size("set_b"))
    pairs = a.join(b, [*by, "token"]).where((F.col("set_a") < F.col("set_b")) & sized).select(*by, "set_a", "set_b").distinct()
    return pairs.withColumn("similarity", jaccard(F.col("set_a"), F.col("set_b"))).where(F.col("similarity") >= threshold - 1e-12)
