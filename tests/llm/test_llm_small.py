import itertools
import random

import pytest
from pyspark.sql import functions as F

from vinolake.llm import boilerplate as bp
from vinolake.llm import items, mixing, names, packing, residue, subjects
from vinolake.llm.glyph_repair import repair_columns


# --- names ---------------------------------------------------------------------


def osa(a, b):
    d = [[max(i, j) if not i or not j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i, j in itertools.product(range(1, len(a) + 1), range(1, len(b) + 1)):
        d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
        if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
            d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


def edited(w, rng):
    k = rng.randrange(len(w) - 1)
    return rng.choice([w[:k] + w[k + 1 :], w[:k] + rng.choice("abc") + w[k:], w[:k] + "b" + w[k + 1 :], w[:k] + w[k + 1] + w[k] + w[k + 2 :], w])


@pytest.mark.parametrize("k", [1, 2])
def test_segment_join_is_exact(spark, k):
    rng = random.Random(k)
    lex = ["".join(rng.choice("abc") for _ in range(rng.randint(2, 9))) for _ in range(40)]
    words = [edited(rng.choice(lex), rng) for _ in range(120)] + [edited(edited(x, rng), rng) for x in lex if len(x) > 3]
    got = {(r.word, r.entry): r.distance for r in names.segment_join(spark.createDataFrame([(w,) for w in words] + [(None,), ("",)], "word string"), spark.createDataFrame([(w,) for w in lex] + [(None,)], "word string"), k).collect()}
    want = {(w, x): osa(w, x) for w, x in itertools.product({w for w in words if w}, set(lex)) if osa(w, x) <= k}
    assert got == want


BOOK = [(1, "Domaine Laurent Tribarfalard"), (2, "Mas Raphaël Tribarfalard"), (3, "Château Mércasonne-Pelvaurec"), (4, "Cave Hélène Corhaurois"), (5, "Karel Corbarez"), (6, "Maison Laurent Corbarez"), (7, "Mas Laurent Velfonserois"), (8, "Cave Karel Rimhaurez"), (9, "Karel Zelmoraud"), (10, "Raphaël Ostlaurez"), (11, "Domaine Hélène Fonjolinet"), (12, "Raphaël Naidouraud"), (13, "Hélène Gosmorieux")]


@pytest.mark.parametrize(
    "name,title,want",
    [
        ("Tribarfalard, L.", None, 1), ("mas raph tribarfalard", "x", 2), ("Tribarfalard", None, None), ("Dom. Pelvaurec & Mércasonne", None, 3), ("Mércasonne", None, None), (None, "Cuvée X rouge Helene Corhaurois 2020 75cl", 4), ("Corhauorois", "Y", 4),
        ("Dominique Corhaurois", None, None), ("K. Corbarez", None, 5), ("CORBAREZ LAUR.", None, 6), ("theshop", "Ｃｏｒｈａｕｒｏｉｓ H. | Z", 4), (None, None, None), ("", "", None), ("Corhaurois " * 3000, None, 4), ("nobody here", "nothing", None),
    ],
)
def test_names(spark, name, title, want):
    rec = spark.createDataFrame([("s", 7, "theshop", name, title, "x")] * 2, "source string, record_id bigint, shop string, name string, title string, producer_id string")
    got = [r.producer_id for r in names.link_names(rec, spark.createDataFrame(BOOK, "producer_id bigint, name string")).collect()]
    assert got == ([] if want is None else [want])


# --- items ---------------------------------------------------------------------


@pytest.mark.parametrize("code,ok", [("4006381333931", True), ("4006381333932", False), ("73513537", True), ("036000291452", True), ("00000000", False), ("123", False)])
def test_gtin(code, ok):
    assert items.valid_gtin(code) is ok
    assert (items.gtin(f"ref {code} x") is not None) is ok


@pytest.mark.parametrize("s,v,p", [("clos 2014 mis en 2016 6x75cl", 2014, 6), ("x '13 coffret de trois", 2013, 3), ("nv carton de 6 75cl", 0, 6), ("doos 6 fl. 25.4 fl. oz.", 0, 6), ("tirage 1500 ex. 2000 ml", 0, 1), ("", 0, 1)])
def test_title_parts(s, v, p):
    assert (items.vintage(s), items.pack_size(s)) == (v, p)


def test_items(spark):
    book = spark.createDataFrame(BOOK, "producer_id bigint, name string")
    rows = [
        (1, "s", "Mas Laurent Velfonserois", "Cuvée Le Tufute rouge 2014 75cl", None), (2, "t", None, "Velfonserois L. TUFUTE rood '14", "750 ml"), (3, "u", "Velfonserois", "2014 Tufute vieilles vignes red top!", ""),
        (4, "u", "Velfonserois", "Tufute red 2015", ""), (5, "u", "Velfonserois", "Tufute blanc 2014", ""), (6, "u", "Velfonserois", "Tufute red 2014", "magnum"), (7, "u", "Velfonserois", "Tufute red 2014 6x75cl", None), (8, "u", None, None, None), (1, "s", "Mas Laurent Velfonserois", "Cuvée Le Tufute rouge 2014 75cl", None),
        (9, "v", "Velfonserois", "Tufutte red 2014", None), (20, "w", None, "4006381333931 no words", None), (21, "w", None, "EAN 4006381333931", None),
    ]
    listing = spark.createDataFrame(rows, "listing_id bigint, shop string, producer string, title string, variant_title string")
    obs = spark.createDataFrame([(1, "A", ["le", "tufute", "red"], 14, "bottle"), (2, "A", ["rood", "tufute"], 2014, "bottle"), (3, "A", ["tufute", "red"], None, "bottle"), (4, "A", None, 2014, "bottle"), (5, None, ["x"], 1, "b")], "obs_id bigint, producer string, cuvee array<string>, vintage int, bucket string")
    got = {tuple(r) for r in items.found_items(listing, obs, book).collect()}
    assert got == {("listing", *p) for p in itertools.combinations((1, 2, 3, 9), 2)} | {("listing", 20, 21), ("observation", 1, 2)}
    assert items.found_items(listing.limit(0), obs.limit(0), book).count() == 0


# --- residue -------------------------------------------------------------------


def test_residue(spark):
    content = [f"Il reste {k} bouteilles de ce rouge. Domaine {k} explique son travail." for k in range(60)]
    rows = [("probe_attempt", k, x) for k, x in enumerate(content)] + [
        ("probe_attempt", 100, "<h1>{{ product.title }}</h1> 12,00 €"), ("probe_attempt", 101, "Service unavailable: maintenance until tonight."), ("probe_attempt", 102, '{"a": "{{75cl}}"}'), ("probe_attempt", 103, "<noscript>JavaScript off?</noscript> Il reste 3 bouteilles de ce rouge."),
        ("probe_attempt", 104, None), ("probe_attempt", 105, "  "), ("probe_attempt", 106, "Please enable JavaScript. Il reste 4 bouteilles de ce rouge."), ("coverage", 1, "ok"), ("coverage", 2, "parse error: x"), ("coverage", 3, "ok {{ state }}"), ("coverage", 4, "{status}"), ("coverage", 5, "Page not found"), ("coverage", 5, "Page not found"), ("coverage", 6, "blocked after 3 pages"),
    ]
    got = {(r.source, r.record_id) for r in residue.residue_records(spark.createDataFrame(rows, "source string, record_id bigint, text string")).collect()}
    assert got == {("probe_attempt", 100), ("probe_attempt", 101), ("coverage", 3), ("coverage", 4), ("coverage", 5)}
    assert residue.residue_records(spark.createDataFrame([], "source string, record_id bigint, text string")).count() == 0


# --- main content --------------------------------------------------------------


def page(k, html):
    rng = random.Random(k)
    word = lambda: "".join(rng.choice("bcdfglmnprstv") + rng.choice("aeiou") for _ in range(3)).capitalize()
    own = [f"Grower {word()} {word()}", f"{k + 10},00 €", f"The wine {word()} of {word()} is bright and needs {k} years of patience in the cellar."]
    menu, foot = ["Home", "Wines", "Basket (0)"], ["Terms of sale", "Privacy", f"© {2020 + k % 4} shop"]
    side = ["Best sellers", f"{word()} Sons 2015 71,00 €", f"{word()} Sons 2016 72,00 €"]
    if not html:
        lines = [*menu, f"Home > Grower {k}", *own, "You may also like", f"{word()} Daughters 2012", "99,00 €", *side, *foot]
    else:
        lines = ["<html><head><title>t</title></head><body>", *[f'<li><a href="/x">{m}</a></li>' for m in menu], f"<h1>{own[0]}</h1>", f"<span>{own[1]}</span>", f"<p>{own[2]}</p>", "<script>var x = 1;</script>", *[f"<li><a href='/y'>{s}</a></li>" for s in side], *[f"<p>{f}</p>" for f in foot], "</body></html>"]
    return "\n".join(lines), {n for n, x in enumerate(lines) if any(o in x for o in own) and ">" not in x.replace("<h1>", "").replace("</h1>", "").replace("<span>", "").replace("</span>", "").replace("<p>", "").replace("</p>", "")}


@pytest.mark.parametrize("html", [False, True])
def test_main_content(spark, html):
    made = [page(k, html) for k in range(12)]
    rows = [(k, "s", b) for k, (b, _) in enumerate(made)] + [(50, "s", None), (51, "s", ""), (52, None, "Lonely page\nwith one text line"), (53, "s", "x" * 300_000)]
    got = {}
    for r in bp.main_content(spark.createDataFrame(rows, "page_id bigint, shop string, body string")).collect():
        got.setdefault(r.page_id, set()).add(r.line_no)
    for k, (_, want) in enumerate(made):
        assert got[k] == want
    assert 50 not in got and 51 not in got and got[52] == {0, 1} and got[53] == {0}


def test_smoothing_and_clusters():
    assert bp.smoothed([1.0] * 9) == pytest.approx([1.0] * 9)
    lo, hi = bp.two_means([0.0, 0.1, 5.0, 5.2])
    assert (lo, hi) == (pytest.approx(0.05), pytest.approx(5.1))
    assert bp.content_flags([], [], [], []) == []


# --- glyphs --------------------------------------------------------------------


@pytest.mark.parametrize(
    "value,fixed",
    [("Ｃｌｏｓ", "Clos"), ("𝐂ô𝐭𝐞", "Côte"), ("été", "été"), ("a b", "a b"), ("ro​se", "rose"), ("ﬁn", "fin"), ("Blаnc", "Blanc"), ("Маѕ", "Mas"), ("Мускат", None), ("Ξινόμαυρο", None), ("рoса", "роса"), ("Рoса", "Роса"), ("вoда", None), ("нoга nogа", None), ("wĳn", "wijn"), ("Вlanс", "Blanc"), ("Сlоs", "Clos"), ("Clɑs", None), ("Clօs", "Clos"), ("“Côte” – 🍷 œuvre", None), ("plain", None), ("", None), (None, None), ("x" * 100_000 + "​", "x" * 100_000)],
)
def test_glyphs(spark, value, fixed):
    df = spark.createDataFrame([(1, value, "k"), (2, "Mas Clos Blanc", "k"), (3, "роса", "k")], "listing_id bigint, title string, field string")
    got = [r.repaired for r in repair_columns(df, "listing_id", ["title"]).collect()]
    assert got == ([] if fixed is None else [fixed])


# --- packing and mixing --------------------------------------------------------


def test_packing(spark):
    rng = random.Random(4)
    rows = [(k, rng.choice([3, 3, 3, 7, 30, 64, rng.randint(1, 250)])) for k in range(600)] + [(None, 5), (1000, 0), (1001, None), (1002, 128), (1003, 130)]
    packed = packing.pack(spark.createDataFrame(rows, "doc_id bigint, tokens int"), 64).collect()
    fill, pieces = {}, {}
    for r in packed:
        fill.setdefault(r.container, []).append((r.start, r.start + r.tokens))
        pieces.setdefault(r.doc_id, []).append((r.piece, r.tokens))
    for spans in fill.values():
        spans.sort()
        assert spans[-1][1] <= 64 and all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))
    want = {k: n for k, n in rows if k is not None and n}
    assert {k: sum(n for _, n in v) for k, v in pieces.items()} == want
    assert all(len(v) == 1 for k, v in pieces.items() if want[k] <= 64)
    assert len(fill) <= 1.05 * sum(want.values()) / 64 + 1
    assert packing.pack(spark.createDataFrame([], "doc_id bigint, tokens int"), 64).count() == 0


def test_plan_counts():
    rows, bins = packing.plan({60: 10_000_000, 4: 9_000_000, 1: 5}, 64)
    assert bins == 10_000_000 and sum(r[2] for r in rows) == 19_000_005


def test_mixing(spark):
    docs = [(k, "big" if k % 3 else "small", 10 + k % 7) for k in range(900)] + [(5000, None, 9), (5001, "other", 9), (5002, "big", 0)]
    targets = spark.createDataFrame([("big", 0.5, 1), ("small", 0.5, 2), ("absent", 0.2, 1), (None, 0.1, 1), ("other", 0.0, 3)], "source string, target_share double, max_repeats int")
    df = spark.createDataFrame(docs, "doc_id bigint, source string, tokens int")
    got = mixing.mix(df, targets, block=100).collect()
    total = sum(r.tokens for r in got)
    for s in ("big", "small"):
        assert sum(r.tokens for r in got if r.source == s) / total == pytest.approx(0.5, abs=0.005)
    assert {r.source for r in got} == {"big", "small"}
    assert max(r.repetition for r in got if r.source == "big") == 0 and max(r.repetition for r in got if r.source == "small") <= 1
    assert len({(r.doc_id, r.repetition) for r in got}) == len(got)
    report = {r.source: r for r in mixing.share_report(mixing.mix(df, targets, block=100), targets).collect()}
    assert report["absent"].tokens == 0 and report["small"].most_uses == 2
    assert mixing.mix(df.limit(0), targets).count() == 0


# --- subjects ------------------------------------------------------------------

NOUNS = {"law": ["appeal", "statute", "notary", "permit"], "sport": ["goalkeeper", "sprint", "referee", "league"]}


def document(rng, subjects_of):
    filler = ["the red is bright and round", "drink it now or keep it for years", "our shelf was rearranged this week", "ask us before ordering more bottles"]
    out = [rng.choice(filler) for _ in range(4)]
    for s in subjects_of:
        a, b = rng.sample(NOUNS[s], 2)
        out[2:2] = [f"most readers wrote about the {a} and a few about the {b}", f"first the {b} then the {a} took up the visit"]
    return ". ".join(x.capitalize() for x in out) + "."


def test_subjects(spark):
    rng = random.Random(5)
    choices = [["law"], ["sport"], ["law", "sport"], []]
    docs = [(k, document(rng, choices[k % 4]), "en", choices[k % 4]) for k in range(240)]
    table = spark.createDataFrame([(a, b, c) for a, b, c, _ in docs] + [(900, None, "en"), (901, "", "en"), (902, document(rng, ["law"]).upper(), None), (902, document(rng, ["law"]).upper(), None)], "doc_id bigint, text string, lang string")
    labels = spark.createDataFrame([(k, s) for k, _, _, ss in docs if k < 120 for s in ss] + [(None, "law"), (1, None)], "doc_id bigint, subject string")
    got = {}
    for r in subjects.found_subjects(table, labels).collect():
        got.setdefault(r.doc_id, set()).add(r.subject)
    held = [(got.get(k, set()), set(ss)) for k, _, _, ss in docs if k >= 120]
    assert sum(a == b for a, b in held) / len(held) > 0.9
    assert 900 not in got and 901 not in got and got[902] == {"law"}
    assert subjects.found_subjects(table, labels.limit(0)).count() == 0
    assert subjects.found_subjects(table.limit(0), labels).count() == 0
    assert F


# --- the ways beyond the bounds of broadcasts ------------------------------------


def test_names_and_items_beyond_bounds(spark, monkeypatch):
    monkeypatch.setattr(names, "MAP_ROWS", 0)
    monkeypatch.setattr(names, "small_side", lambda df, *a: df)
    monkeypatch.setattr(items, "small_side", lambda df, *a: df)
    test_names(spark, "Tribarfalard, L.", None, 1)
    test_names(spark, "Corhauorois", "Y", 4)
    test_items(spark)


def test_glyphs_beyond_bounds(spark, monkeypatch):
    from vinolake.llm import glyph_repair

    monkeypatch.setattr(glyph_repair, "BROADCAST_ROWS", 0)
    test_glyphs(spark, "Маѕ", "Mas")
    test_glyphs(spark, "Мускат", None)
