"""Queries of the general training-data problems (1 and 4)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vinolake.operators.snapshots import found_changes
from vinolake.operators.units import found_amounts


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return found_amounts(table(spark, sf, "listing"), table(spark, sf, "observation"), table(spark, sf, "shops"))


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return found_changes(table(spark, sf, "listing_snapshot"))


QUERIES = {"p1_found": p1_found, "p4_found": p4_found}

SQL = {
    "p4_found": r"""
with page as (
  select snap_no, shop, loaded_at, in_stock, cast(round(price * 100) as bigint) as cents,
         rtrim(lower(url_decode(replace(regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)', 1), '+', '%2B'))), '/') as page_path
  from listing_snapshot where snap_no is not null and shop is not null and url is not null),
last as (
  select * from (select *, row_number() over (partition by snap_no, shop, page_path order by loaded_at desc nulls last, cents desc nulls last, in_stock desc nulls last) rn from page) where rn = 1),
cal as (
  select shop, snap_no, lag(snap_no) over (partition by shop order by snap_no) prev from (select distinct shop, snap_no from page)),
old as (select c.snap_no, l.shop, l.page_path, l.cents, l.in_stock from last l join cal c on c.shop = l.shop and c.prev = l.snap_no),
new as (select l.snap_no, l.shop, l.page_path, l.cents, l.in_stock from last l join cal c on c.shop = l.shop and c.snap_no = l.snap_no where c.prev is not null)
select coalesce(n.snap_no, o.snap_no) snap_no, coalesce(n.shop, o.shop) shop, coalesce(n.page_path, o.page_path) page_path,
       case when o.shop is null then 'added' when n.shop is null then 'removed' else 'changed' end change_kind
from old o full outer join new n on n.snap_no = o.snap_no and n.shop = o.shop and n.page_path = o.page_path
where o.shop is null or n.shop is null or o.cents is distinct from n.cents or o.in_stock is distinct from n.in_stock
"""
}
