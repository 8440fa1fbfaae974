"""Queries of titles, price book, market basis, shop bodies and pages, each over its whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vinolake.functions import text as t
from vinolake.functions import titles as w
from vinolake.operators.relational import market_basis as basis_of
from vinolake.operators.scale import small_side
from vinolake.plans.catalogue_queries import _ALIAS_SQL, _quoted, _sql_fold, _table, alias_longest
from vinolake.sources.html_tree import page_rows
from vinolake.sources.links import catalogue_link_rank, outbound
from vinolake.sources.shop_json import SHOPIFY, WOO, shopify_rows, woo_rows
from vinolake.streaming.state import event_stream, run_available, windowed_counts

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _listed(words) -> str:
    return "[" + ", ".join(_quoted(x) for x in words) + "]"


# --- titles -------------------------------------------------------------------

_BOTH = "concat_ws(' ', title, variant_title)"
_FORMAT_SQL = f"case {' '.join(f'when regexp_matches(f, {_quoted(w.bounded(p))}) then {ml}' for ml, p in w.FORMATS)} end"
_MULT_SQL = f"case size_ml {' '.join(f'when {k} then {v}' for k, v in w.FORMAT_MULTIPLIERS.items())} else 1.0 end"


@query(
    f"""with a as (select distinct listing_id, price, {_sql_fold(_BOTH)} f from listing), b as (select *, {_FORMAT_SQL} stated, regexp_matches(f, {_quoted(t.BUNDLE)}) bundle from a),
c as (select *, coalesce(stated, 750) size_ml, case when stated is null or bundle then 'low' else 'high' end size_confidence from b)
select listing_id, size_ml, size_confidence, bundle, case when bundle then 'coffret' else 'bottle' end as bucket, case when bundle then 'coffret' else size_ml || 'ml' end as size_label, round(case when price > 0 then price / {_MULT_SQL} end, 4) as price750 from c"""
)
def listing_sizes(spark, sf):
    both = F.concat_ws(" ", "title", "variant_title")
    a = _table(spark, sf, "listing").select("listing_id", "price", w.stated_format(both).alias("stated"), t.is_bundle(both).alias("bundle")).distinct()
    size = F.coalesce("stated", F.lit(750))
    return a.select(
        "listing_id", size.alias("size_ml"), F.when(F.col("stated").isNull() | F.col("bundle"), "low").otherwise("high").alias("size_confidence"), "bundle", F.when(F.col("bundle"), "coffret").otherwise("bottle").alias("bucket"),
        F.when(F.col("bundle"), "coffret").otherwise(F.concat(size.cast("string"), F.lit("ml"))).alias("size_label"), F.round(w.to_750(F.when(F.col("price") > 0, F.col("price")), size), 4).alias("price750"),
    )


@query(
    f"select distinct listing_id, case {' '.join(f'when regexp_matches(f, {_quoted(p)}) then {_quoted(n)}' for n, p in w.TIERS)} when regexp_matches(f, {_quoted('|'.join(w.VILLAGES))}) then 'village' end as tier from (select listing_id, {_sql_fold('title')} f from listing)"
)
def listing_tiers(spark, sf):
    return _table(spark, sf, "listing").select("listing_id", w.tier(F.col("title")).alias("tier")).distinct()


_HITS = f"(select distinct h.listing_id, h.producer, l.title from ({_ALIAS_SQL}) h join listing l using (listing_id))"


def _hits(spark, sf) -> DataFrame:
    return alias_longest(spark, sf).select("listing_id", "producer").join(_table(spark, sf, "listing").select("listing_id", "title"), "listing_id").distinct()


_WORDS_SQL = "list_filter(string_split_regex(replace(coalesce({}, ''), '/', ' '), '\\s+'), lambda x: length(x) > 0)"
_LINES_SQL = f"""
with n as (select producer, list_transform(list_sort(list_distinct(list({{'o': alias_ord, 'a': alias}}))), lambda x: x.a) aliases from aliases where producer is not null and alias is not null group by 1),
h as (select listing_id, producer, title, aliases, {_sql_fold('title')} f, list_filter(list_transform(aliases, lambda x: {_sql_fold('x')}), lambda x: length(x) > 0) names from {_HITS} join n using (producer)),
p as (select *, list_sort(list_filter(list_transform(names, lambda x, i: {{'at': strpos(f, x), 'i': i, 'a': x}}), lambda x: x.at > 0))[1] first from h),
q as (select *, regexp_extract_all(regexp_extract(substr(f, 1, first.at - 1), '([a-z\\s''’-]*)$', 1), '[a-z]{{2,}}') before from p),
r as (select *, array_to_string(list_filter(list_concat(before[greatest(len(before) - {w.LINE_WORDS} + 1, 1):], regexp_extract_all(first.a, '[a-z]{{2,}}')), lambda x: not list_contains({_listed(w.NO_LINE_WORDS)}, x)), ' ') kept from q),
s as (select *, case when first is not null and kept <> '' then kept else {_sql_fold('producer')} end seg from r),
u as (select *, list_transform(list_sort(list_transform(list_distinct(list_filter(list_transform(list_concat(aliases, list_concat({_WORDS_SQL.format('producer')}, {_WORDS_SQL.format('seg')})), lambda x: {_sql_fold('x')}), lambda x: length(x) > 0)), lambda x: {{'n': -length(x), 'p': x}})), lambda x: x.p) phrases from s)
select listing_id, producer, seg, array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(list_reduce(phrases, lambda acc, x: replace(acc, x, ' '), f), '[a-z]{{2,}}'), lambda x: not list_contains({_listed(w.NO_CUVEE_WORDS)}, x)))), ' ') as cuvee from u"""


@query(_LINES_SQL)
def hit_lines(spark, sf):
    """The maker's line and the cuvee words of every listing that names a watched maker."""
    a = _table(spark, sf, "aliases").where("producer is not null and alias is not null")
    named = a.groupBy("producer").agg(F.transform(F.array_sort(F.collect_set(F.struct("alias_ord", "alias"))), lambda x: x["alias"]).alias("aliases"))
    # What belongs to the maker is folded once per maker, a title once per hit.
    own = F.transform(F.concat("aliases", w.name_words(F.col("producer"))), lambda p: t.fold(p))
    named = named.select("producer", w.names_of(F.col("producer"), F.col("aliases")).alias("names"), own.alias("own"), t.fold(F.col("producer")).alias("folded"))
    h = _hits(spark, sf).select("listing_id", "producer", t.fold(F.col("title")).alias("f")).distinct().join(small_side(named), "producer")
    h = h.withColumn("seg", w.maker_line_of(F.col("f"), F.col("names"), F.col("folded")))
    cuvee = w.cuvee_words_of(F.col("f"), F.concat("own", w.name_words(F.col("seg"))))
    return h.select("listing_id", "producer", "seg", F.array_join(cuvee, " ").alias("cuvee")).distinct()


@query(
    f"""with h as (select *, {_sql_fold('title')} f from {_HITS}), b as (select h.*, p.region, p.reference_750 base, list_filter(p.cuvees, lambda c: len(list_filter(c.match, lambda m: contains(h.f, {_sql_fold('m')}))) > 0)[1] c from h left join (select name, any_value(region) region, any_value(reference_750) reference_750, any_value(cuvees) cuvees from producer_book group by 1) p on p.name = h.producer)
select distinct listing_id, producer, region, coalesce(c.reference_750, base) as reference_750, c is not null as own_reference from b"""
)
def hit_book(spark, sf):
    """Every hit with its maker's book entry, or none, and the cuvee's own reference where the book has one."""
    book = _table(spark, sf, "producer_book").groupBy("name").agg(F.any_value("region").alias("region"), F.any_value("reference_750").alias("base"), F.any_value("cuvees").alias("cuvees"))
    h = _hits(spark, sf).join(small_side(book), F.col("producer") == F.col("name"), "left").withColumn("c", w.override(F.col("title"), F.col("cuvees")))
    return h.select("listing_id", "producer", "region", F.coalesce("c.reference_750", "base").alias("reference_750"), F.col("c").isNotNull().alias("own_reference")).distinct()


@query()
def hit_labels(spark, sf):
    return _hits(spark, sf).select("listing_id", "producer", w.label(F.col("title"), F.col("producer")).alias("label")).distinct()


# --- market -------------------------------------------------------------------


@query(
    """with o as (select distinct obs_id, producer, coalesce(seg, '') seg, bucket, list_sort(list_distinct(cuvee)) c, coalesce(vintage, -1) v, shop, price750 from observation where price750 > 0 and producer is not null and len(cuvee) > 0),
h as (select distinct producer, seg, bucket, c, v, shop from o),
j as (select h.*, o.v ov, o.shop os, o.price750 p from h join o on o.producer = h.producer and o.bucket = h.bucket and o.shop <> h.shop and len(list_intersect(h.c, o.c)) >= 0.6 * len(list_distinct(list_concat(h.c, o.c))) - 1e-9),
a as (select producer, seg, bucket, c, v, shop, median(p) filter (where ov = v and v >= 0) p1, count(distinct os) filter (where ov = v and v >= 0) s1, median(p) p2, count(distinct os) s2 from j group by all),
l as (select h.producer, h.seg, h.bucket, h.shop, median(o.price750) p3, count(distinct o.shop) s3, count(*) n3 from (select distinct producer, seg, bucket, shop from h) h join o on o.producer = h.producer and o.bucket = h.bucket and o.seg = h.seg and o.shop <> h.shop group by all),
m as (select h.*, coalesce(s1, 0) s1, coalesce(s2, 0) s2, coalesce(s3, 0) s3, coalesce(n3, 0) n3, p1, p2, p3 from h left join a using (producer, seg, bucket, c, v, shop) left join l using (producer, seg, bucket, shop))
select producer, seg, bucket, array_to_string(c, ' ') as cuvee, v as vintage, shop, case when s1 >= 1 then 'same wine' when s2 >= 1 then 'same cuvee' when n3 >= 3 and s3 >= 2 then 'same line' end as basis,
 case when s1 >= 2 then 'high' when s1 = 1 or s2 >= 2 then 'medium' when s2 = 1 or n3 >= 3 and s3 >= 2 then 'low' end as confidence, round(case when s1 >= 1 then p1 when s2 >= 1 then p2 when n3 >= 3 and s3 >= 2 then p3 end, 4) as price from m"""
)
def market_basis(spark, sf):
    """The strongest of three comparisons for every wine a shop was seen to offer: same wine, same cuvee of any vintage, same line."""
    return basis_of(_table(spark, sf, "observation").drop("loaded_at").distinct())


@query(
    """select b.name as producer, b.region, coalesce(a.aliases, 0) as aliases, coalesce(o.n, 0) as observations, coalesce(o.shops, 0) as shops from (select distinct name, region from producer_book) b
left join (select producer, count(distinct alias) aliases from aliases group by 1) a on a.producer = b.name left join (select producer, count(distinct obs_id) n, count(distinct shop) shops from observation group by 1) o on o.producer = b.name"""
)
def producer_overview(spark, sf):
    a = _table(spark, sf, "aliases").groupBy("producer").agg(F.count_distinct("alias").alias("aliases"))
    o = _table(spark, sf, "observation").select("obs_id", "producer", "shop").distinct().groupBy("producer").agg(F.count_distinct("obs_id").alias("observations"), F.count_distinct("shop").alias("shops"))
    b = _table(spark, sf, "producer_book").select(F.col("name").alias("producer"), "region").distinct()
    out = b.join(a, "producer", "left").join(o, "producer", "left")
    return out.select("producer", "region", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("aliases", "observations", "shops")])


@query("select (select count(*) from shops where coalesce(verified, false)) as live_shops, (select count(*) from shops) as shops, (select count(distinct obs_id) from observation) as pool, (select count(distinct name) from producer_book) as producers")
def status_cards(spark, sf):
    s = _table(spark, sf, "shops").agg(F.count_if(F.coalesce("verified", F.lit(False))).alias("live_shops"), F.count("*").alias("shops"))
    o = _table(spark, sf, "observation").agg(F.count_distinct("obs_id").alias("pool"))
    return s.join(F.broadcast(o)).join(F.broadcast(_table(spark, sf, "producer_book").agg(F.count_distinct("name").alias("producers"))))  # one row each


@query("select producer, count(*) as n, count(distinct shop) as shops from (select distinct obs_id, producer, shop from observation) group by grouping sets ((producer), ())")
def observations_with_total(spark, sf):
    o = _table(spark, sf, "observation").select("obs_id", "producer", "shop").distinct()
    return o.groupingSets([["producer"], []], "producer").agg(F.count("*").alias("n"), F.count_distinct("shop").alias("shops"))


# --- coverage and pages -------------------------------------------------------


@query("select coverage_id, shop, products, row_number() over (partition by run_at::date order by coalesce(products, 0) desc, coverage_id) as place from (select distinct coverage_id, shop, products, run_at from coverage)")
def coverage_ranked(spark, sf):
    c = _table(spark, sf, "coverage").select("coverage_id", "shop", "products", "run_at").distinct()
    order = Window.partitionBy(F.to_date("run_at")).orderBy(F.desc(F.coalesce("products", F.lit(0))), "coverage_id")
    return c.select("coverage_id", "shop", "products", F.row_number().over(order).alias("place"))


@query("select run_at::date as day, string_agg(distinct shop, ', ' order by shop) as truncated from coverage where lower(trim(status)) like 'truncated%' group by 1")
def truncated_shops(spark, sf):
    c = _table(spark, sf, "coverage").where(F.lower(F.trim("status")).startswith("truncated"))
    return c.groupBy(F.to_date("run_at").alias("day")).agg(F.array_join(F.array_sort(F.collect_set("shop")), ", ").alias("truncated"))


@query("select shop, url, page_id, fetched_at from (select *, row_number() over (partition by shop, url order by fetched_at desc, page_id desc) rn from (select distinct page_id, shop, url, fetched_at from raw_pages)) where rn = 1 and fetched_at > (select max(fetched_at) from raw_pages) - interval 720 hour")
def fresh_pages(spark, sf):
    """The newest page of every address, if it is fresh enough beside the newest of all (720 hours here)."""
    p = _table(spark, sf, "raw_pages").select("page_id", "shop", "url", "fetched_at")
    newest = F.broadcast(p.agg(F.max("fetched_at").alias("_newest")))
    last = p.groupBy("shop", "url").agg(F.max(F.struct("fetched_at", "page_id")).alias("b")).select("shop", "url", "b.page_id", "b.fetched_at")
    return last.join(newest).where("fetched_at > _newest - interval 720 hours").drop("_newest")


_SLUG = r"^(?:[a-z]+://[^/?#]*)?([^?#]*)"


@query(rf"select distinct url, trim(array_to_string(list_filter(string_split_regex(regexp_replace(regexp_extract(rtrim(regexp_extract(url, '{_SLUG}', 1), '/'), '([^/]*)$', 1), '\.(?:html?|php|aspx)$', '', 'i'), '[-_+\s]+'), lambda x: x <> ''), ' ')) as title from raw_pages where url is not null")
def url_titles(spark, sf):
    return _table(spark, sf, "raw_pages").where("url is not null").select("url", t.title_from_url(F.col("url")).alias("title")).distinct()


_PLAIN = "(select distinct page_id, replace(body, chr(13), '') body from raw_pages where body is not null and not regexp_matches(body, '<[a-zA-Z/!]'))"


def _plain(spark, sf) -> DataFrame:
    """Pages delivered as plain text: bodies without a tag."""
    return _table(spark, sf, "raw_pages").where("body is not null").where(~F.col("body").rlike("<[a-zA-Z/!]")).select("page_id", F.replace("body", F.lit("\r"), F.lit("")).alias("body")).distinct()


@query(
    rf"""with l as (select page_id, trim(unnest(string_split(body, chr(10)))) line from {_PLAIN})
select page_id, count(*) as lines, count(*) filter (where regexp_matches(line, '[€$£] ?\d{{1,4}}|\d ?(€|EUR|eur|\$|£)')) as marked, count(*) filter (where regexp_matches(line, '\d+[.,]\d{{2}}([^0-9]|$)')) as decimals from l where line <> '' group by 1"""
)
def price_column_stats(spark, sf):
    lines = _plain(spark, sf).select("page_id", F.explode(F.split("body", "\n")).alias("line")).select("page_id", F.trim("line").alias("line")).where("line <> ''")
    return lines.groupBy("page_id").agg(F.count("*").alias("lines"), F.count_if(F.col("line").rlike(r"[€$£] ?\d{1,4}|\d ?(€|EUR|eur|\$|£)")).alias("marked"), F.count_if(F.col("line").rlike(r"\d+[.,]\d{2}([^0-9]|$)")).alias("decimals"))


@query(rf"select page_id, trim(regexp_extract(body, '(?im)^\s*((?:wijnlijst|notre carte|nos vins|onze wijnen)[^\n(]*)', 1)) as edition from {_PLAIN}")
def list_editions(spark, sf):
    """The line that names a list, if a page has one."""
    return _plain(spark, sf).select("page_id", F.trim(F.regexp_extract("body", r"(?im)^\s*((?:wijnlijst|notre carte|nos vins|onze wijnen)[^\n(]*)", 1)).alias("edition"))


@query()
def listings_first_per_url(spark, sf):
    """Listings of the pages of each shop in reading order (start, page, place), the first of every address."""
    pages = _table(spark, sf, "raw_pages").select("page_id", "shop", "url", "body", "start_ord", "page_no")
    rows = page_rows(pages.select("page_id", "url", "body").distinct(), "listings").join(pages.select("page_id", "shop", "start_ord", "page_no").distinct(), "page_id")
    best = rows.groupBy("shop", "url").agg(F.min(F.struct("start_ord", "page_no", "pos", "page_id", "title", "price", "in_stock")).alias("b"))
    return best.select("shop", "url", "b.page_id", "b.pos", "b.title", "b.price", "b.in_stock")


@query()
def catalogue_links(spark, sf):
    pages = _table(spark, sf, "raw_pages").select("page_id", "url", "body").distinct()
    return catalogue_link_rank(page_rows(pages, "links"), pages.select("page_id", F.col("url").alias("page_url")))


@query()
def outbound_hosts(spark, sf):
    pages = _table(spark, sf, "raw_pages").select("page_id", "url", "body").distinct()
    return outbound(page_rows(pages, "links"), pages.select("page_id", F.col("url").alias("page_url")))


# --- shop bodies --------------------------------------------------------------

_PROBED = "(select distinct attempt_id, shop, url, body_snippet b from probe_attempt where json_valid(body_snippet))"


@query(
    f"""with p as (select attempt_id, unnest(from_json(json_extract(b, '$.products'), '[{{"title":"VARCHAR","vendor":"VARCHAR","handle":"VARCHAR","variants":[{{"title":"VARCHAR","price":"VARCHAR","available":"BOOLEAN"}}]}}]')) x from {_PROBED} where json_type(b) = 'OBJECT' and json_type(b, '$.products') = 'ARRAY')
select attempt_id, coalesce(x.title, '') as title, case when try_cast(x.variants[1].price as double) > 0 then try_cast(x.variants[1].price as double) end as price, coalesce(x.variants[1].title, '') as variant_title from p"""
)
def shopify_bodies(spark, sf):
    """Products of the bodies that are JSON of the first kind of shop."""
    b = _table(spark, sf, "probe_attempt").select("attempt_id", "shop", "url", "body_snippet").distinct().where("body_snippet is not null")
    p = b.select("attempt_id", F.explode(F.from_json("body_snippet", SHOPIFY)["products"]).alias("p")).select("attempt_id", "p.*")
    return shopify_rows(p, F.lit("")).select("attempt_id", "title", "price", "variant_title")


@query(
    f"""with p as (select attempt_id, unnest(from_json(b, '[{{"name":"VARCHAR","prices":{{"price":"VARCHAR","currency_minor_unit":"INTEGER"}},"is_in_stock":"BOOLEAN"}}]')) x from {_PROBED} where json_type(b) = 'ARRAY')
select attempt_id, coalesce(x.name, '') as title, case when try_cast(x.prices.price as bigint) > 0 then try_cast(x.prices.price as bigint) / pow(10, coalesce(x.prices.currency_minor_unit, 2)) end as price, x.is_in_stock as in_stock from p"""
)
def woo_bodies(spark, sf):
    """Products of the bodies that are JSON of the second kind of shop."""
    b = _table(spark, sf, "probe_attempt").select("attempt_id", "shop", "url", "body_snippet").distinct().where("body_snippet is not null").where(F.ltrim("body_snippet").startswith("["))
    p = b.select("attempt_id", F.col("url").alias("page_url"), F.explode(F.from_json("body_snippet", WOO)).alias("p"))
    return woo_rows(p).select("attempt_id", "title", "price", "in_stock")


# --- config tables and streams ------------------------------------------------


@query("select producer_id, name, region from producer_book b where not exists (select 1 from aliases a where a.producer = b.name)")
def book_without_watched(spark, sf):
    """The book after the makers of a list are deleted from it."""
    return _table(spark, sf, "producer_book").select("producer_id", "name", "region").join(small_side(_table(spark, sf, "aliases").select(F.col("producer").alias("name")).distinct()), "name", "left_anti")


@query("with wanted(shop) as (select distinct shop from coverage union select 'no such shop') select w.shop, s.platform, s.shop is not null as known from wanted w left join shops s using (shop)")
def selected_shops(spark, sf):
    """Shops chosen by name; unknown names are reported, not dropped."""
    wanted = _table(spark, sf, "coverage").select("shop").union(spark.createDataFrame([("no such shop",)], "shop string")).distinct()
    s = _table(spark, sf, "shops").select("shop", "platform", F.lit(True).alias("_k"))
    return wanted.join(small_side(s), "shop", "left").select("shop", "platform", F.col("_k").isNotNull().alias("known"))


@query("select date_trunc('hour', ts) as start, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2")
def stream_windows(spark, sf):
    """Tumbling windows over the event stream: the last state of each after all there is."""
    seen = run_available(windowed_counts(event_stream(spark, f"{sf}/events.parquet"), late="40 days"), "windows", "update")
    last = seen.groupBy("start", "event_type").agg(F.max_by(F.struct("n", "total"), "batch").alias("s"))
    return last.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "s.n", F.round("s.total", 4).alias("total"))
