"""Shop APIs: JSON bodies to listing rows. Prices that are no numbers, and empty variants, give nulls, never errors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHOPIFY = "struct<products:array<struct<title:string,vendor:string,handle:string,body_html:string,variants:array<struct<title:string,price:string,available:boolean>>>>>"
WOO = "array<struct<name:string,permalink:string,short_description:string,description:string,is_in_stock:boolean,prices:struct<price:string,currency_minor_unit:int>>>"


def _positive(c: Column) -> Column:
    return F.when(c > 0, c)


def shopify_rows(products: DataFrame, base: Column) -> DataFrame:
    """Listing rows of products (title, vendor, handle, body_html, variants): price of the first variant if positive, stock known only if some variant says so."""
    variants = F.coalesce("variants", F.array().cast("array<struct<title:string,price:string,available:boolean>>"))
    says = F.exists(variants, lambda v: v["available"].isNotNull())
    return products.select(
        *[c for c in products.columns if c not in ("title", "vendor", "handle", "body_html", "variants")],
        F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("vendor", F.lit("")), F.coalesce("body_html", F.lit(""))).alias("text"), F.coalesce("title", F.lit("")).alias("title"),
        _positive(F.try_element_at(variants, F.lit(1))["price"].try_cast("double")).alias("price"),
        F.concat(F.rtrim(base, F.lit("/")), F.lit("/products/"), F.coalesce("handle", F.lit(""))).alias("url"), F.coalesce(F.try_element_at(variants, F.lit(1))["title"], F.lit("")).alias("variant_title"),
        F.when(says, F.exists(variants, lambda v: F.coalesce(v["available"], F.lit(False)))).alias("in_stock"),
    )


def read_shopify(pages: DataFrame) -> DataFrame:
    """Listing rows of saved bodies (shop, url, body); a body that is no JSON gives none."""
    parsed = pages.select("shop", F.col("url").alias("page_url"), F.explode(F.from_json("body", SHOPIFY)["products"]).alias("p")).select("shop", "page_url", "p.*")
    return shopify_rows(parsed, F.regexp_extract("page_url", r"^[a-z]+://[^/]+", 0))


def read_woo(pages: DataFrame) -> DataFrame:
    """Listing rows of saved bodies (shop, url, body); prices are integers in minor units, two decimals unless stated."""
    p = pages.select("shop", F.col("url").alias("page_url"), F.explode(F.from_json("body", WOO)).alias("p"))
    return woo_rows(p)


def woo_rows(p: DataFrame) -> DataFrame:
    """Listing rows of products (p struct, page_url and any other columns)."""
    minor = F.coalesce("p.prices.currency_minor_unit", F.lit(2))
    return p.select(
        *[c for c in p.columns if c not in ("p", "page_url")], F.concat_ws(" ", F.coalesce("p.name", F.lit("")), F.coalesce("p.short_description", F.lit("")), F.coalesce("p.description", F.lit(""))).alias("text"), F.coalesce("p.name", F.lit("")).alias("title"),
        _positive(F.col("p.prices.price").try_cast("bigint") / F.pow(F.lit(10.0), minor)).alias("price"), F.coalesce("p.permalink", "page_url").alias("url"), F.lit("").alias("variant_title"), F.col("p.is_in_stock").alias("in_stock"),
    )
