"""Queries of the catalogue operators, each over its whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vinolake.functions import text as t
from vinolake.operators.matching import alias_matches, near_misses, set_similarity_join
from vinolake.operators.relational import first_per_key, latest_per_key, reference_ladder, rotate, upsert
from vinolake.operators.scale import small_side
from vinolake.sources.html_tree import page_rows
from vinolake.sources.price_list import price_list_entries
from vinolake.sources.shop_json import shopify_rows
from vinolake.streaming.state import latest_state

QUERIES: dict = {}
SQL: dict[str, str] = {}


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _sql_fold(c: str) -> str:
    """The fold in DuckDB: marks off, the same single replacements, the Latin ligatures."""
    wanted = [(a, b) for a, b in zip(t.FOLD_FROM, t.FOLD_TO) if ord(a) >= 0x2000 or ord(a) < 0xC0 or a in "ſ"]
    base = f"translate(strip_accents(coalesce({c}, '')), {_quoted(''.join(a for a, _ in wanted))}, {_quoted(''.join(b for _, b in wanted))})"
    for a, b in (("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬀ", "ff"), ("ﬃ", "ffi"), ("ﬄ", "ffl"), ("…", "..."), ("½", "1⁄2"), ("™", "TM"), ("№", "No")):
        base = f"replace({base}, {_quoted(a)}, {_quoted(b)})"
    return f"lower({base})"


def _sql_key(c: str) -> str:
    return f"trim(regexp_replace(replace({_sql_fold(c)}, '&', ' et '), '[^0-9a-z]+', ' ', 'g'))"


# --- text ---------------------------------------------------------------------


@query(f"select distinct producer_id, name, {_sql_key('name')} as name_key from producer_book")
def match_key_names(spark, sf):
    return _table(spark, sf, "producer_book").select("producer_id", "name", t.match_key(F.col("name")).alias("name_key")).distinct()


@query(f"select distinct listing_id, {_sql_key('title')} as title_key from listing")
def match_key_titles(spark, sf):
    return _table(spark, sf, "listing").select("listing_id", t.match_key(F.col("title")).alias("title_key")).distinct()


@query()
def stated_attributes(spark, sf):
    """Price, vintage, size, bundle and stock wording of every listing's text."""
    c = _table(spark, sf, "listing").select("listing_id", "title", "variant_title", "text")
    both = F.concat_ws(" ", "title", "variant_title")
    return c.select("listing_id", t.parse_price(F.col("text")).alias("price_stated"), t.parse_vintage(F.col("title")).alias("vintage"), t.parse_size(both).alias("size_ml"), t.is_bundle(both).alias("bundle"), t.says_sold_out(F.col("text")).alias("sold_out")).distinct()


@query("select distinct listing_id, sha256(coalesce(shop,'') || '|' || coalesce(url,'') || '|' || coalesce(variant_title,'')) as item_key from listing")
def item_keys(spark, sf):
    return _table(spark, sf, "listing").select("listing_id", t.item_key(F.col("shop"), F.col("url"), F.col("variant_title")).alias("item_key")).distinct()


@query(
    "select page_id, (r like '%sgcaptcha%' or r like '%captcha%' or r like '%/cdn-cgi/challenge%' or r like '%challenge-platform%' or ((length(b) - length(replace(b, '<a ', ''))) / 3 <= 2 and ("
    + " or ".join(f"contains(b, {_quoted(p)})" for p in t.CHALLENGE_PHRASES)
    + ")))::boolean as challenge from (select distinct page_id, lower(coalesce(body, '')) b, regexp_extract(lower(coalesce(body, '')), '<meta[^>]+http-equiv=[\"'']?refresh[\"'']?[^>]+content=[\"'']([^\"'']+)[\"'']', 1) r from raw_pages)"
)
def challenge_pages(spark, sf):
    return _table(spark, sf, "raw_pages").select("page_id", t.is_challenge(F.col("body")).alias("challenge")).distinct()


@query(r"select distinct page_id, md5(regexp_replace(regexp_replace(body, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}', '[redacted]', 'g'), '\+?\d[\d ./()-]{7,}\d', '[redacted]', 'g')) as redacted from raw_pages where body is not null")
def redacted_pages(spark, sf):
    return _table(spark, sf, "raw_pages").where("body is not null").select("page_id", F.md5(t.redact(F.col("body"))).alias("redacted")).distinct()


# --- matching -----------------------------------------------------------------

_ALIAS_SQL = f"""
with a as (select distinct producer, {_sql_key('alias')} a from aliases),
k as (select distinct listing_id, {_sql_key("coalesce(producer,'') || ' ' || coalesce(title,'')")} k from listing),
m as (select listing_id, producer, a, row_number() over (partition by listing_id, producer order by length(a) desc, a desc) rn from k join a on contains(k, a) where a <> ''),
b as (select listing_id, producer, a from m where rn = 1)
select listing_id, producer, a as alias from b where not exists (select 1 from b o where o.listing_id = b.listing_id and o.producer <> b.producer and contains(o.a, b.a))"""


@query(_ALIAS_SQL)
def alias_longest(spark, sf):
    rows = _table(spark, sf, "listing").select("listing_id", F.concat_ws(" ", F.coalesce("producer", F.lit("")), F.coalesce("title", F.lit(""))).alias("text")).distinct()
    return alias_matches(rows, _table(spark, sf, "aliases"), "listing_id", "text")


def _seen(spark, sf):
    return alias_longest(spark, sf).select("producer").distinct()


@query(f"with s as ({_ALIAS_SQL}) select name as producer from producer_book where name not in (select producer from s)")
def unseen_producers(spark, sf):
    return _table(spark, sf, "producer_book").select(F.col("name").alias("producer")).join(_seen(spark, sf), "producer", "left_anti")


@query(
    f"with s as ({_ALIAS_SQL}), j as (select s.producer, l.in_stock, l.shop from s join (select distinct listing_id, shop, in_stock from listing) l using (listing_id))"
    " select producer, string_agg(distinct shop, ', ' order by shop) as shops from j group by producer having bool_and(in_stock is not distinct from false)"
)
def sold_out_everywhere(spark, sf):
    rows = _table(spark, sf, "listing").select("listing_id", "shop", "in_stock").distinct()
    found = alias_longest(spark, sf).join(rows, "listing_id")
    return found.groupBy("producer").agg(F.bool_and(F.col("in_stock").eqNullSafe(False)).alias("out"), F.array_join(F.array_sort(F.collect_set("shop")), ", ").alias("shops")).where("out").select("producer", "shops")


@query(
    f"""with s as (select distinct producer from ({_ALIAS_SQL})),
w as (select distinct shop, unnest(string_split({_sql_key('title')}, ' ')) word from listing),
spread as (select word, count(distinct shop) shops, min(shop) shop from w where length(word) >= 6 group by 1),
t as (select distinct producer, target from (select producer, unnest(string_split({_sql_key('alias')}, ' ')) target from aliases where producer not in (select producer from s)) where length(target) >= 7 and target not in (select word from spread where shops > 1))
select producer, shop, min(word) as word from spread, t where shops = 1 and substr(word,1,1) = substr(target,1,1) and abs(length(word) - length(target)) <= 1 and levenshtein(word, target) = 1 and word <> target || 's' and target <> word || 's' group by 1, 2"""
)
def alias_near_misses(spark, sf):
    words = _table(spark, sf, "listing").select("shop", F.explode(F.split(t.match_key(F.col("title")), " ")).alias("word")).distinct()
    return near_misses(words, _table(spark, sf, "aliases"), _seen(spark, sf))


@query(
    """with s as (select distinct producer, list_sort(list_distinct(cuvee)) c from observation where producer is not null)
select a.producer, array_to_string(a.c, ' ') as set_a, array_to_string(b.c, ' ') as set_b, round(len(list_intersect(a.c, b.c)) / len(list_distinct(list_concat(a.c, b.c))), 6) as similarity
from s a join s b on a.producer = b.producer and a.c < b.c where len(a.c) > 0 and len(b.c) > 0 and len(list_intersect(a.c, b.c)) >= 0.6 * len(list_distinct(list_concat(a.c, b.c))) - 1e-9"""
)
def similar_cuvees(spark, sf):
    sets = _table(spark, sf, "observation").where("producer is not null").select("producer", F.col("cuvee").alias("tokens"))
    return set_similarity_join(sets, ["producer"]).select("producer", F.array_join("set_a", " ").alias("set_a"), F.array_join("set_b", " ").alias("set_b"), F.round("similarity", 6).alias("similarity"))


@query(
    """with o as (select distinct obs_id, producer, bucket, list_sort(list_distinct(cuvee)) c, coalesce(vintage, -1) v, shop, price750 from observation where price750 > 0 and producer is not null and len(cuvee) > 0),
h as (select distinct producer, bucket, c, v, shop from o),
j as (select h.producer, h.bucket, h.c, h.v, h.shop, o.v ov, o.shop os, o.price750 p from h left join o on o.producer = h.producer and o.bucket = h.bucket and o.shop <> h.shop
      and len(list_intersect(h.c, o.c)) >= 0.6 * len(list_distinct(list_concat(h.c, o.c))) - 1e-9)
select producer, bucket, array_to_string(c, ' ') as cuvee, v as vintage, shop,
 round(median(p) filter (where ov = v and v >= 0), 4) as same_median, count(distinct os) filter (where ov = v and v >= 0) as same_shops, count(p) filter (where ov = v and v >= 0) as same_n,
 round(median(p), 4) as any_median, count(distinct os) as any_shops, count(p) as any_n from j group by producer, bucket, c, v, shop"""
)
def market_reference(spark, sf):
    return reference_ladder(_table(spark, sf, "observation").drop("loaded_at").distinct())


# --- keyed rows ---------------------------------------------------------------


@query(
    """select producer, coalesce(seg,'') as seg, bucket, coalesce(vintage,-1) as vintage, shop, cuvee, obs_id, price750, seen from (
select *, array_to_string(list_sort(o.cuvee), ' ') as cuvee_key, row_number() over (partition by producer, coalesce(seg,''), bucket, coalesce(vintage,-1), shop, array_to_string(list_sort(o.cuvee), ' ') order by seen desc, loaded_at desc, obs_id desc) rn
from observation o) x, lateral (select cuvee_key as cuvee) c where rn = 1 and seen >= (select max(seen) from observation) - interval 180 day""".replace("select producer, coalesce(seg,'') as seg, bucket, coalesce(vintage,-1) as vintage, shop, cuvee,", "select producer, coalesce(seg,'') as seg, bucket, coalesce(vintage,-1) as vintage, shop, c.cuvee,")
)
def observation_latest(spark, sf):
    o = _table(spark, sf, "observation")
    keyed = o.select("producer", F.coalesce("seg", F.lit("")).alias("seg"), "bucket", F.coalesce("vintage", F.lit(-1)).alias("vintage"), "shop", F.array_join(F.array_sort("cuvee"), " ").alias("cuvee"), "seen", "loaded_at", "obs_id", "price750")
    keys = ["producer", "seg", "bucket", "vintage", "shop", "cuvee"]
    newest = F.broadcast(o.agg(F.max("seen").alias("newest")))
    return latest_per_key(keyed, keys, ["seen", "loaded_at", "obs_id"]).join(newest).where("seen >= date_sub(newest, 180)").select(*keys, "obs_id", "price750", "seen")


@query("select shop, url, listing_id, title from (select *, row_number() over (partition by shop, url order by fetched_at, listing_id, title) rn from listing) where rn = 1")
def listing_first(spark, sf):
    return first_per_key(_table(spark, sf, "listing").select("shop", "url", "fetched_at", "listing_id", "title"), ["shop", "url"], ["fetched_at", "listing_id", "title"]).select("shop", "url", "listing_id", "title")


@query(
    """with a as (select producer, min(alias) as alias, count(*) as n from aliases where alias_ord = 0 group by 1), b as (select producer, min(alias) as alias, count(*) as n from aliases where alias_ord > 0 group by 1)
select coalesce(a.producer, b.producer) as producer, coalesce(b.alias, a.alias) as alias, coalesce(b.n, a.n) as n from a full outer join b on a.producer = b.producer"""
)
def alias_upsert(spark, sf):
    a = _table(spark, sf, "aliases")
    part = lambda k: a.where(F.signum("alias_ord") == k).groupBy("producer").agg(F.min("alias").alias("alias"), F.count("*").alias("n"))
    return upsert(part(0), part(1), ["producer"])


@query(
    """select product_id, coalesce(title,'') || ' ' || coalesce(vendor,'') || ' ' || coalesce(body_html,'') as text, coalesce(title,'') as title, case when try_cast(variants[1].price as double) > 0 then try_cast(variants[1].price as double) end as price,
rtrim(coalesce(s.url, ''), '/') || '/products/' || coalesce(handle,'') as url, coalesce(variants[1].title, '') as variant_title,
case when len(list_filter(variants, lambda v: v.available is not null)) > 0 then len(list_filter(variants, lambda v: v.available)) > 0 end as in_stock
from (select distinct product_id, p.shop, title, vendor, handle, body_html, variants from shopify_product p) p left join shops s on s.shop = p.shop"""
)
def shopify_listings(spark, sf):
    shops = _table(spark, sf, "shops").select("shop", F.col("url").alias("base"))
    rows = _table(spark, sf, "shopify_product").distinct().join(small_side(shops), "shop", "left")
    return shopify_rows(rows, F.coalesce("base", F.lit(""))).drop("shop", "base")


# --- coverage -----------------------------------------------------------------


@query(
    """with c as (select distinct on (coverage_id) coverage_id, shop, platform, status, products, in_stock, sold_out, hits, producers from coverage)
select c.shop, count(*) as runs, sum(products) as products, sum(sold_out) as sold_out, sum(hits) as hits, count(*) filter (where lower(trim(status)) like 'ok%') as ok_runs, any_value(p.producers) as producers
from c left join (select shop, string_agg(distinct p, ', ' order by p) as producers from (select shop, unnest(producers) p from c) group by 1) p on p.shop is not distinct from c.shop group by c.shop"""
)
def coverage_by_shop(spark, sf):
    c = _table(spark, sf, "coverage").drop("loaded_at").distinct()
    named = c.select("shop", F.explode("producers").alias("p")).groupBy("shop").agg(F.array_join(F.array_sort(F.collect_set("p")), ", ").alias("producers"))
    sums = c.groupBy("shop").agg(F.count("*").alias("runs"), F.sum("products").alias("products"), F.sum("sold_out").alias("sold_out"), F.sum("hits").alias("hits"), F.count_if(F.lower(F.trim("status")).startswith("ok")).alias("ok_runs"))
    return sums.join(named.withColumnRenamed("shop", "_s"), F.col("shop").eqNullSafe(F.col("_s")), "left").drop("_s")


@query("select platform, cast(date_trunc('day', run_at) as date) as day, count(*) as runs, sum(products) as products, sum(hits) as hits, grouping(platform) + 2 * grouping(cast(date_trunc('day', run_at) as date)) as level from (select distinct coverage_id, platform, run_at, products, hits from coverage) group by grouping sets ((platform, cast(date_trunc('day', run_at) as date)), (platform), ())")
def coverage_totals(spark, sf):
    c = _table(spark, sf, "coverage").select("coverage_id", "platform", F.to_date("run_at").alias("day"), "products", "hits").distinct()
    return c.groupingSets([["platform", "day"], ["platform"], []], "platform", "day").agg(F.count("*").alias("runs"), F.sum("products").alias("products"), F.sum("hits").alias("hits"), (F.grouping("platform") + 2 * F.grouping("day")).cast("long").alias("level"))


@query("select distinct coverage_id, try_cast(split_part(pages, '/', 1) as int) as pages_read, try_cast(split_part(pages, '/', 2) as int) as pages_total from coverage where pages is not null")
def coverage_pages(spark, sf):
    p = F.split("pages", "/")
    return _table(spark, sf, "coverage").where("pages is not null").select("coverage_id", F.try_element_at(p, F.lit(1)).try_cast("int").alias("pages_read"), F.try_element_at(p, F.lit(2)).try_cast("int").alias("pages_total")).distinct()


@query("select shop from shops where coalesce(verified, true) and shop not in (select shop from coverage where shop is not null)")
def shops_not_reached(spark, sf):
    return _table(spark, sf, "shops").where("coalesce(verified, true)").select("shop").join(_table(spark, sf, "coverage").select("shop"), "shop", "left_anti")


@query("select name, region, last_verified from producer_book where not coalesce(verified, false) or last_verified is null or last_verified < date '2025-12-31' - interval 180 day")
def stale_book(spark, sf):
    return _table(spark, sf, "producer_book").where("not coalesce(verified, false) or last_verified is null or last_verified < date_sub(date'2025-12-31', 180)").select("name", "region", "last_verified")


# --- order --------------------------------------------------------------------


@query("select shop, cast((row_number() over (order by shop) - 1 - 7 + 700 * count(*) over ()) % count(*) over () as int) as turn from shops")
def shop_rotation(spark, sf):
    return rotate(_table(spark, sf, "shops").select("shop"), "shop", F.lit(7))


@query("select shop, url, n, ok from (select shop, url, count(*) n, count(*) filter (where http_status = 200) ok, row_number() over (partition by shop order by count(*) filter (where http_status = 200) desc, count(*) desc, url) rn from (select distinct attempt_id, shop, url, http_status from probe_attempt) group by 1, 2) where rn = 1")
def best_endpoint(spark, sf):
    a = _table(spark, sf, "probe_attempt").select("attempt_id", "shop", "url", "http_status").distinct()
    per = a.groupBy("shop", "url").agg(F.count("*").alias("n"), F.count_if(F.col("http_status") == 200).alias("ok"))
    w = Window.partitionBy("shop").orderBy(F.desc("ok"), F.desc("n"), "url")
    return per.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


@query("select o_orderkey, o_orderpriority, o_totalprice from orders order by o_orderpriority, o_totalprice desc, o_orderkey limit 40")
def digest_top(spark, sf):
    return _table(spark, sf, "orders").orderBy("o_orderpriority", F.desc("o_totalprice"), "o_orderkey").limit(40).select("o_orderkey", "o_orderpriority", "o_totalprice")


@query("select lower(tag) as tag, count(*) as n from (select unnest(regexp_extract_all(body, '<([A-Za-z][A-Za-z0-9]*)', 1)) tag from (select distinct page_id, body from raw_pages)) group by 1 order by n desc, tag limit 6")
def element_histogram(spark, sf):
    tags = _table(spark, sf, "raw_pages").select("page_id", "body").distinct().select(F.explode(F.regexp_extract_all("body", F.lit("<([A-Za-z][A-Za-z0-9]*)"), F.lit(1))).alias("tag"))
    return tags.groupBy(F.lower("tag").alias("tag")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "tag").limit(6)


# --- sets ---------------------------------------------------------------------


@query("select producer, 'both' as side from ((select distinct producer from observation where producer is not null) intersect (select name from producer_book)) union all select producer, 'book only' from (select name as producer from producer_book except select producer from observation)")
def producer_sets(spark, sf):
    o, b = _table(spark, sf, "observation").where("producer is not null").select("producer"), _table(spark, sf, "producer_book").select(F.col("name").alias("producer"))
    return o.intersect(b).withColumn("side", F.lit("both")).union(b.subtract(o).withColumn("side", F.lit("book only")))


@query("select producer, count(*) as n, count(distinct shop) as shops, min(seen) as first_seen, max(seen) as last_seen from (select distinct obs_id, producer, shop, seen from observation) group by 1")
def observations_by_producer(spark, sf):
    o = _table(spark, sf, "observation").select("obs_id", "producer", "shop", "seen").distinct()
    return o.groupBy("producer").agg(F.count("*").alias("n"), F.count_distinct("shop").alias("shops"), F.min("seen").alias("first_seen"), F.max("seen").alias("last_seen"))


# --- sources ------------------------------------------------------------------


@query()
def html_listings(spark, sf):
    return page_rows(_table(spark, sf, "raw_pages").select("page_id", "url", "body").distinct(), "listings")


@query()
def html_links(spark, sf):
    return page_rows(_table(spark, sf, "raw_pages").select("page_id", "url", "body").distinct(), "links")


@query()
def html_facts(spark, sf):
    return page_rows(_table(spark, sf, "raw_pages").select("page_id", "url", "body").distinct(), "facts")


_LINES = "(select page_id as doc, unnest(string_split(replace(body, chr(13), ''), chr(10))) as line, generate_subscripts(string_split(replace(body, chr(13), ''), chr(10)), 1) as pos from (select distinct page_id, body from raw_pages where body not like '%<%'))"


@query(
    rf"""with k as (select doc, pos, line, regexp_matches(lower(line), '^\s*(#|naam\s+streek|wijnlijst|deze lijst|www\.|\[redacted\]|pagina\b)') as reset,
 try_cast(regexp_extract(line, '(?:^|[^\d.,/])(\d{{1,4}})[.,](\d{{2}})\s*[€*]?\s*$', 1) || '.' || regexp_extract(line, '(?:^|[^\d.,/])(\d{{1,4}})[.,](\d{{2}})\s*[€*]?\s*$', 2) as double) as p,
 regexp_matches(lower(line), '(sold|uitverkocht|op aanvraag|binnenkort)\s*$') as sold from {_LINES} where trim(line) <> '' and not regexp_matches(line, '^\s*\d{{1,3}}\s*$')),
e as (select *, case when p between 4 and 3000 then p end as price, not reset and (coalesce(p between 4 and 3000, false) or sold) as ends from k),
i as (select *, coalesce(sum((ends or reset)::int) over (partition by doc order by pos rows between unbounded preceding and 1 preceding), 0) as island from e),
n as (select *, row_number() over (partition by doc, island order by pos desc) as back from i where not reset),
b as (select doc, island, list(trim(line) order by pos) as ls, max(case when ends then pos end) as pos, max(case when ends then price end) as price, bool_or(ends and sold) as sold from n where back <= 5 group by 1, 2)
select doc, cast(pos as int) as pos, text, title, price, not sold as in_stock from (select *, trim(regexp_replace(array_to_string(ls, ' '), '\s{{2,}}', ' ', 'g')) as text,
 trim(substr(regexp_replace(array_to_string(list_filter(ls, lambda x: length(x) > 1)[1:2], ' '), '\s{{2,}}', ' ', 'g'), 1, 120)) as title from b where pos is not null) where length(regexp_replace(text, '\P{{L}}', '', 'g')) >= 6"""
)
def price_list_rows(spark, sf):
    lines = _table(spark, sf, "raw_pages").select("page_id", "body").distinct().where("body not like '%<%'").select(F.col("page_id").alias("doc"), F.posexplode(F.split(F.regexp_replace("body", "\r", ""), "\n")).alias("pos", "line")).withColumn("pos", F.col("pos") + 1)
    return price_list_entries(lines)


# --- events -------------------------------------------------------------------


@query("select event_id, json_extract_string(props, '$.k') as k, try_cast(json_extract_string(props, '$.n') as bigint) as n from events")
def event_props(spark, sf):
    return _table(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"), F.get_json_object("props", "$.n").try_cast("bigint").alias("n"))


@query("select date_trunc('hour', ts) as start, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2")
def event_windows(spark, sf):
    return _table(spark, sf, "events").groupBy(F.date_trunc("hour", "ts").alias("start"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query(
    "select user_id, session, count(*) as n, min(ts) as started, max(ts) as ended from (select *, sum(fresh) over (partition by user_id order by ts, event_id) as session from (select *, case when ts - lag(ts) over (partition by user_id order by ts, event_id) <= interval 30 minute then 0 else 1 end as fresh from events)) group by 1, 2"
)
def event_sessions(spark, sf):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = _table(spark, sf, "events").select("user_id", "ts", "event_id").withColumn("fresh", F.when(F.col("ts") - F.lag("ts").over(w) <= F.expr("interval 30 minutes"), 0).otherwise(1))
    return e.withColumn("session", F.sum("fresh").over(w)).groupBy("user_id", "session").agg(F.count("*").alias("n"), F.min("ts").alias("started"), F.max("ts").alias("ended"))


@query("select event_id, user_id, round(value - lag(value) over (partition by user_id, event_type order by ts, event_id), 6) as change from events")
def event_changes(spark, sf):
    w = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    return _table(spark, sf, "events").select("event_id", "user_id", F.round(F.col("value") - F.lag("value").over(w), 6).alias("change"))


@query("select user_id, count(*) as n, max(ts) as last_ts, arg_max(value, struct_pack(a := ts, b := event_id)) as last_value, max(value) as top_value from events group by 1")
def stream_user_state(spark, sf):
    return latest_state(spark, f"{sf}/events.parquet")
