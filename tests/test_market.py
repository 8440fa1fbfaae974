"""Titles, links, market basis and the alias join without an automaton, on small fixtures."""

import re

import pytest
from pyspark.sql import functions as F

from vinolake.functions import text, titles as w
from vinolake.operators import matching
from vinolake.operators.relational import market_basis
from vinolake.sources.links import catalogue_link_rank, outbound


def one(spark, f, *values):
    row = spark.createDataFrame([values], ", ".join(f"c{k} {'array<string>' if isinstance(v, list) else 'string'}" for k, v in enumerate(values)))
    return row.select(f(*[F.col(c) for c in row.columns])).first()[0]


@pytest.mark.parametrize("s,want", [("Gevrey-Chambertin Grand Cru", "grand_cru"), ("Meursault 1er 2015", "premier_cru"), ("Bourgogne rouge", "bourgogne"), ("Vosne-Romanée 2014", "village"), ("Poulsard", None), (None, None)])
def test_tier(spark, s, want):
    assert one(spark, w.tier, s) == want


@pytest.mark.parametrize("s,want", [("half bottle", 375), ("MAGNUM", 1500), ("double magnum", 1500), ("3,0 l", 3000), ("vin jaune", 620), ("x75 cly", None), ("", None), (None, None)])
def test_format(spark, s, want):
    assert one(spark, w.stated_format, s) == want


@pytest.mark.parametrize(
    "title,producer,aliases,line,words",
    [
        ("Anne et Jean Vorlat Sul Q 2014", "Domaine Vorlat", ["vorlat"], "anne et jean vorlat", ["sul"]),
        ("2014, Les Grands Teppes - Vorlat", "Domaine Vorlat", ["vorlat"], "teppes grands vorlat", []),
        ("Clos | Anne Vorlat Poulprix", "Domaine Vorlat", ["domaine vorlat", "vorlat"], "anne vorlat", ["poulprix"]),
        ("nothing", "Domaine Vorlat", ["vorlat"], "domaine vorlat", ["nothing"]),
        (None, "Domaine Vorlat", [], "domaine vorlat", []),
    ],
)
def test_lines_and_cuvees(spark, title, producer, aliases, line, words):
    got = one(spark, w.maker_line, title, producer, aliases)
    assert sorted(got.split()) == sorted(line.split())
    assert one(spark, lambda t, p, a: w.cuvee_words(t, p, a, F.lit(got)), title, producer, aliases) == words


@pytest.mark.parametrize("title,producer,want", [("VORLAT Sul - 2014", "Domaine Vorlat", "Sul - 2014"), ("Vorlat", "Vorlat", "Vorlat"), ("a (b) c", "(b)", "a c"), (None, "x", "")])
def test_label(spark, title, producer, want):
    assert one(spark, w.label, title, producer) == want


def test_market_basis(spark):
    rows = [("P", "p", "bottle", ["sul"], 2014, s, p) for s, p in (("a", 10.0), ("b", 20.0), ("c", 40.0))] + [("P", "p", "bottle", ["sul"], 2015, "a", 50.0), ("P", "p", "bottle", ["other"], None, "d", 5.0), ("P", "q", "bottle", ["third"], 2014, "a", 7.0), ("P", "p", "bottle", ["x"], 1, "z", 0.0), (None, "p", "bottle", ["x"], 1, "z", 1.0)]
    o = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "obs_id int, producer string, seg string, bucket string, cuvee array<string>, vintage int, shop string, price750 double")
    got = {(r.cuvee, r.vintage, r.shop): (r.basis, r.confidence, r.price) for r in market_basis(o).collect()}
    assert got[("sul", 2014, "a")] == ("same wine", "high", 30.0) and got[("sul", 2014, "b")] == ("same wine", "high", 25.0)
    assert got[("sul", 2015, "a")] == ("same cuvee", "medium", 30.0)
    assert got[("other", -1, "d")] == ("same line", "low", 30.0) and got[("third", 2014, "a")] == (None, None, None)
    assert market_basis(o.limit(0)).count() == 0


def test_links(spark):
    base = "https://s.example/"
    urls = ["/vins", "/12-jura", "/wijnkaart", "/promotions/vins", "/panier/vins", "https://other.example/vins", "/", "/a/b/vins.html", "https://third.example/x", "/12-jura", "mailto:x"]
    links = spark.createDataFrame([(1, k, u if ":" in u else base.rstrip("/") + u, "l") for k, u in enumerate(urls)], "page_id int, pos int, url string, label string")
    pages = spark.createDataFrame([(1, base), (2, None)], "page_id int, page_url string")
    got = [r.url.removeprefix(base) for r in catalogue_link_rank(links, pages).orderBy("place").collect()]
    assert got == ["wijnkaart", "12-jura", "vins", "a/b/vins.html", "promotions/vins"]
    assert [r.url.removeprefix(base) for r in catalogue_link_rank(links, pages, 2).orderBy("place").collect()] == ["wijnkaart", "promotions/vins"]
    assert sorted((r.host, r.pos) for r in outbound(links, pages).collect()) == [("other.example", 5), ("third.example", 8)]


@pytest.mark.parametrize("automaton", [True, False])
def test_alias_join(spark, monkeypatch, automaton):
    if not automaton:
        monkeypatch.setattr(matching, "ahocorasick", None)
    texts = spark.createDataFrame([(1, "Clos Vorlat-Ney 2014"), (2, "NEY"), (3, None), (4, ""), (5, "x" * 3000 + " vorlat ney"), (6, "Zo")], "id int, text string")
    aliases = spark.createDataFrame([("A", "Vorlat"), ("B", "Vorlat Ney"), ("C", "Ney"), ("D", ""), ("E", None), ("F", "Zo")], "producer string, alias string")
    got = sorted((r.id, r.producer) for r in matching.alias_matches(texts, aliases).collect())
    assert got == [(1, "B"), (2, "C"), (5, "B"), (6, "F")]


def test_long_folds_lie_in_the_ranges_that_are_asked_first():
    assert [a for a, _ in text.FOLD_LONG if not re.search(text._MAY_BE_LONG, a)] == []
