"""Visually identical text with different characters: script-aware repair.

Styled, wide, invisible and spacing variants have one usual form and are always
replaced. Look-alike letters are replaced per token: its dominant script is
determined, and the token is read wholly in that script, else as Latin, but only
if the reading occurs in the corpus. So a Greek or Cyrillic name stays what it
is, and one with a stray Latin letter is not turned into Latin.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vinolake.functions.glyphs import SUSPECT, repair
from vinolake.operators.scale import BROADCAST_ROWS, small_side, written


def _long(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    fields = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(f"`{c}`").cast("string").alias("value")) for c in columns]))
    return df.select(F.col(f"`{key}`").alias("_key"), fields.alias("_f")).select("_key", "_f.field", "_f.value").where("value is not null")


def vocabulary_hits(values: DataFrame, readings: DataFrame) -> DataFrame:
    """Of the distinct ``readings`` (column word) those that occur in ``values`` as a word.

    Counts over all values; the readings are broadcast only if they are few,
    otherwise both sides meet in a shuffled join on the distinct words.
    """
    words = values.select(F.explode(F.split(F.lower("value"), r"[^\p{L}\p{M}]+")).alias("word")).where("word <> ''")
    return words.join(small_side(readings), "word", "left_semi").distinct()


def repair_columns(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, field, value, repaired) of every value that is not in the usual form, in the columns named.

    Null and empty values and values already in the usual form give no row; a
    repeated input row gives a repeated result row. Values that a JVM pattern
    finds free of suspects never reach Python. Columns of ``df`` other than the
    ones named are not read.
    """
    values = _long(df, key, columns)
    suspects = values.where(F.col("value").rlike(SUSPECT))

    @F.pandas_udf("repaired string, open array<string>")
    def first(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([repair(t) for t in texts.tolist()], columns=["repaired", "open"])

    # Altered or undecided values only, written once and read by every later step.
    once = written(suspects.withColumn("_r", first("value")).select("_key", "field", "value", "_r.repaired", "_r.open").where("repaired <> value or size(open) > 0"), "repaired")
    settled = once.where(F.size("open") == 0).drop("open")
    pending = once.where(F.size("open") > 0)
    readings = pending.select(F.explode("open").alias("word")).distinct()
    proven = written(vocabulary_hits(values, readings), "proven")
    n = proven.limit(BROADCAST_ROWS + 1).count()
    if n <= BROADCAST_ROWS:
        # A bounded list of words goes into the workers' closure.
        known = frozenset(r.word for r in proven.collect())

        @F.pandas_udf("string")
        def second(texts: pd.Series) -> pd.Series:
            return pd.Series([repair(t, known)[0] for t in texts.tolist()])

        finished = pending.withColumn("repaired", second("value")).drop("open")
    else:

        @F.pandas_udf("string")
        def third(texts: pd.Series, words: pd.Series) -> pd.Series:
            return pd.Series([repair(t, frozenset(w))[0] for t, w in zip(texts.tolist(), words.tolist())])

        per_value = (
            pending.withColumn("_h", F.xxhash64("_key", "field", "value")).select("_h", F.explode("open").alias("word")).distinct()
            .join(proven, "word").groupBy("_h").agg(F.collect_set("word").alias("_words"))
        )
        finished = pending.withColumn("_h", F.xxhash64("_key", "field", "value")).join(per_value, "_h", "left").withColumn("repaired", third("value", F.coalesce("_words", F.array().cast("array<string>")))).drop("open", "_h", "_words")
    return settled.unionByName(finished).where("repaired <> value").withColumnRenamed("_key", key)


def found_glyphs(listing: DataFrame) -> DataFrame:
    """Distinct (listing_id, field) of the titles and texts that repair alters."""
    return repair_columns(listing.select("listing_id", "title", "text"), "listing_id", ["title", "text"]).where("listing_id is not null").select("listing_id", "field").distinct()
