import unicodedata

import pytest
from pyspark.sql import functions as F

from vinolake.functions import text as t
from vinolake.sources import html_tree as h
from vinolake.sources.price_list import price_list_entries
from vinolake.sources.shop_json import read_shopify, read_woo


def one(spark, f, value):
    return spark.createDataFrame([(value,)], "c string").select(f(F.col("c"))).first()[0]


def folded(s):
    return "".join(c for c in unicodedata.normalize("NFKD", s or "") if not unicodedata.combining(c)).lower()


@pytest.mark.parametrize("s", ["Bruyère–Houillon", "ﬁne ½ ™ №", "Ｄｏｍａｉｎｅ 𝐂ô𝐭𝐞", "Allanté ＆ Boulanger", "été", "Œuvre ß", None, ""])
def test_fold(spark, s):
    assert one(spark, t.fold, s) == folded(s)


@pytest.mark.parametrize("s,k", [("Bruyère–Houillon", "bruyere houillon"), ("Allanté ＆ Boulanger", "allante et boulanger"), ("  A, B/C ", "a b c")])
def test_match_key(spark, s, k):
    assert one(spark, t.match_key, s) == k


@pytest.mark.parametrize("s,p", [("12,50 €", 12.5), ("€45,00", 45.0), ("Poulprix 2022 €45,00", 45.0), ("2018,50 €", 2018.5), ("12,00 €", 12.0), ("2018", None), ("0,00 EUR", None), (None, None)])
def test_price(spark, s, p):
    assert one(spark, t.parse_price, s) == p


@pytest.mark.parametrize("s,v", [("2012, mis en 2020", 2012), ("2015 €", None), ("NV", None), ("x 1949 y 2049", 2049), ("", None)])
def test_vintage(spark, s, v):
    assert one(spark, t.parse_vintage, s) == v


@pytest.mark.parametrize("s,ml", [("half bottle", 375), ("MAGNUM", 1500), ("double magnum", 1500), ("jeroboam", 3000), ("vin jaune 75cl", 750), ("vin jaune", 620), ("x", 750), (None, 750)])
def test_size(spark, s, ml):
    assert one(spark, t.parse_size, s) == ml


def test_flags(spark):
    assert one(spark, t.is_bundle, "COFFRET anniversaire") and not one(spark, t.is_bundle, "bouteille")
    assert one(spark, t.says_sold_out, "Produit épuisé") and not one(spark, t.says_sold_out, "en stock")
    assert one(spark, t.is_challenge, "<p>Just a moment</p>") and not one(spark, t.is_challenge, "<a x><a y><a z> just a moment")
    assert one(spark, t.redact, "a@b.example or +33 1 23 45 67 89") == "[redacted] or [redacted]"
    assert one(spark, t.title_from_url, "https://x.example/a/blanc_2024-x.html?y") == "blanc 2024 x"


GRID = """<div class="grid"><div class="card"><a href="/w/1">Clos A</a><span class="p"><b>12.50</b><i>€</i></span></div>
<div class="card outofstock"><a href="/w/2">Clos B</a><span>13,00&nbsp;&euro;</span></div>
<div class="card"><a href="/w/3"><h3>Clos C</h3></a><span>14,00 €</span><em>Produit épuisé</em></div></div>
<a href="/panier">Panier <b>0,00 €</b></a><a class="next page-numbers" href="?page=2"><span></span></a><p>Affichage 1-3 de 10 article(s)</p><a href="/docs/liste.PDF">Notre liste</a><a href="/livraison">Livraison</a>"""


def test_html(spark):
    rows = h.listings(GRID, "https://s.example/boutique")
    assert [(r[1], r[2], r[3], r[4]) for r in rows] == [("Clos A", 12.5, "https://s.example/w/1", True), ("Clos B", 13.0, "https://s.example/w/2", False), ("Clos C", 14.0, "https://s.example/w/3", False)]
    assert h.listings("<p>10 €</p>", "https://s.example") == [] and h.listings("", "") == []
    assert h.next_page(GRID, "https://s.example/boutique") == "https://s.example/boutique?page=2"
    assert h.next_page('<a href="/x">suivant</a>', "https://s.example/x/") is None
    assert h.catalogue_size(GRID) == (10, 3, 4)
    assert h.labelled_link(GRID, "https://s.example/", h.PDF_WORDS, ".pdf") == "https://s.example/docs/liste.PDF"
    pages = spark.createDataFrame([(1, "https://s.example/b", GRID), (2, "https://s.example/c", None), (3, "u", "<<<>&" * 1000)], "page_id bigint, url string, body string")
    assert h.page_rows(pages, "listings").count() == 3
    assert {r.page_id for r in h.page_rows(pages, "facts").collect()} == {1, 2, 3}
    assert ("https://s.example/w/3", "Clos C", "Clos C") in [(r.url, r.label, r.identity) for r in h.page_rows(pages, "links").collect()]


def test_price_list(spark):
    text = ["Wijnlijst 2025", "Domaine A", "Blanc 2020", "", "26.90", "12", "Domaine B rouge SOLD", "02/123.45.67", "deze lijst", "Domaine C", "2023", "Grand Vin 9,50 *", "x 7.00"]
    lines = spark.createDataFrame([("d", k, x) for k, x in enumerate(text)] + [("e", 0, None)], "doc string, pos int, line string")
    got = [(r.text, r.price, r.in_stock) for r in price_list_entries(lines).orderBy("pos").collect()]
    assert got == [("Domaine A Blanc 2020 26.90", 26.9, True), ("Domaine B rouge SOLD", None, False), ("Domaine C 2023 Grand Vin 9,50 *", 9.5, True)]


def test_shop_json(spark):
    bodies = spark.createDataFrame(
        [("s", "https://s.example/products.json", '{"products":[{"title":"A","handle":"a","variants":[{"price":"68.00","title":"75cl"}]},{"title":"B","variants":[{"price":"0","available":false},{"price":"9","available":true}]},{"title":"C","variants":[]},{"title":"D","variants":[{"price":"x","available":false}]}]}'), ("s", "u", "no json"), ("s", "u", None)],
        "shop string, url string, body string",
    )
    assert [(r.title, r.price, r.in_stock, r.url) for r in read_shopify(bodies).collect()] == [("A", 68.0, None, "https://s.example/products/a"), ("B", None, True, "https://s.example/products/"), ("C", None, None, "https://s.example/products/"), ("D", None, False, "https://s.example/products/")]
    woo = spark.createDataFrame([("s", "https://s.example", '[{"name":"A","prices":{"price":"3900","currency_minor_unit":2}},{"name":"B","permalink":"p","is_in_stock":false,"prices":{"price":"0"}}]')], "shop string, url string, body string")
    assert [(r.title, r.price, r.url, r.in_stock) for r in read_woo(woo).collect()] == [("A", 39.0, "https://s.example", None), ("B", None, "p", False)]
