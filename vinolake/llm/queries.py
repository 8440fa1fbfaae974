"""Queries of the text problems and the SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vinolake.llm.boilerplate import found_content
from vinolake.llm.glyph_repair import found_glyphs
from vinolake.llm.items import found_items, item_members
from vinolake.llm.mixing import mixed_documents, share_report
from vinolake.llm.names import found_names
from vinolake.llm.packing import fill_report, packed_documents
from vinolake.llm.residue import found_residue
from vinolake.llm.subjects import found_subjects


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return found_names(table(spark, sf, "listing"), table(spark, sf, "shopify_product"), table(spark, sf, "producer_book"))


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return found_items(table(spark, sf, "listing"), table(spark, sf, "observation"), table(spark, sf, "producer_book"))


def p3_groups(spark: SparkSession, sf: str) -> DataFrame:
    return item_members(table(spark, sf, "listing"), table(spark, sf, "observation"), table(spark, sf, "producer_book"))


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return found_residue(table(spark, sf, "probe_attempt"), table(spark, sf, "coverage"))


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return found_content(table(spark, sf, "raw_pages"))


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    return found_glyphs(table(spark, sf, "listing"))


def p8_pack(spark: SparkSession, sf: str) -> DataFrame:
    return packed_documents(table(spark, sf, "documents"))


def p8_fill(spark: SparkSession, sf: str) -> DataFrame:
    return fill_report(p8_pack(spark, sf))


def p9_mix(spark: SparkSession, sf: str) -> DataFrame:
    return mixed_documents(table(spark, sf, "documents"), table(spark, sf, "mix_target"))


def p9_shares(spark: SparkSession, sf: str) -> DataFrame:
    targets = table(spark, sf, "mix_target")
    return share_report(mixed_documents(table(spark, sf, "documents"), targets), targets)


def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    return found_subjects(table(spark, sf, "documents"), table(spark, sf, "doc_label"))


QUERIES = {
    "p2_found": p2_found,
    "p3_found": p3_found,
    "p3_groups": p3_groups,
    "p5_found": p5_found,
    "p6_found": p6_found,
    "p7_found": p7_found,
    "p8_pack": p8_pack,
    "p8_fill": p8_fill,
    "p9_mix": p9_mix,
    "p9_shares": p9_shares,
    "p10_found": p10_found,
}
SQL: dict[str, str] = {}
