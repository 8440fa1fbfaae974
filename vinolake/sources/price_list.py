"""Price lists in lines: entries are the lines up to one that ends in a price or says sold."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Line kinds of such documents.
PRICE_AT_END = r"(?:^|[^\d.,/])(\d{1,4})[.,](\d{2})\s*[€*]?\s*$"
SOLD_AT_END = r"(sold|uitverkocht|op aanvraag|binnenkort)\s*$"
FURNITURE = r"^\s*(#|naam\s+streek|wijnlijst|deze lijst|www\.|\[redacted\]|pagina\b)"
PAGE_NUMBER = r"^\s*\d{1,3}\s*$"
# End of fixed values.


def price_list_entries(lines: DataFrame, max_lines: int = 4, lowest: float = 4.0, highest: float = 3000.0, min_letters: int = 6) -> DataFrame:
    """(doc, pos, text, title, price, in_stock) per entry of lines (doc, pos, line).

    A line that ends in a price within bounds, or in a word for sold, ends an
    entry; furniture forgets what came before; blank lines and page numbers are
    not part of anything. An entry keeps its last ``max_lines`` lines before the
    last one. Built on windows per document: gaps and islands, no state machine.
    """
    plain = lines.where("doc is not null and pos is not null and line is not null").where((F.trim("line") != "") & ~F.col("line").rlike(PAGE_NUMBER))
    stated = F.concat(F.regexp_extract("line", PRICE_AT_END, 1), F.lit("."), F.regexp_extract("line", PRICE_AT_END, 2)).try_cast("double")
    kinds = plain.select(
        "doc", "pos", "line", F.lower("line").rlike(FURNITURE).alias("reset"),
        F.when((stated >= lowest) & (stated <= highest), stated).alias("price"), F.lower("line").rlike(SOLD_AT_END).alias("sold"),
    ).withColumn("ends", ~F.col("reset") & (F.col("price").isNotNull() | F.col("sold")))
    before = Window.partitionBy("doc").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    islands = kinds.withColumn("island", F.coalesce(F.sum((F.col("ends") | F.col("reset")).cast("int")).over(before), F.lit(0))).where(~F.col("reset"))
    back = Window.partitionBy("doc", "island").orderBy(F.desc("pos"))
    # An island has one ending line, its last; only the last lines before it count.
    near = islands.withColumn("back", F.row_number().over(back)).where(F.col("back") <= max_lines + 1)
    block = near.groupBy("doc", "island").agg(
        F.array_sort(F.collect_list(F.struct("pos", F.trim("line").alias("line")))).alias("ls"), F.max(F.when(F.col("ends"), F.col("pos"))).alias("pos"),
        F.max(F.when(F.col("ends"), F.col("price"))).alias("price"), F.bool_or(F.col("ends") & F.col("sold")).alias("sold"),
    ).where("pos is not null")
    texts = F.transform("ls", lambda x: x["line"])
    body = F.trim(F.regexp_replace(F.array_join(texts, " "), r"\s{2,}", " "))
    title = F.trim(F.substring(F.regexp_replace(F.array_join(F.slice(F.filter(texts, lambda t: F.length(t) > 1), 1, 2), " "), r"\s{2,}", " "), 1, 120))
    entries = block.select("doc", "pos", body.alias("text"), title.alias("title"), "price", (~F.col("sold")).alias("in_stock"))
    return entries.where(F.length(F.regexp_replace("text", r"\P{L}", "")) >= min_letters)
