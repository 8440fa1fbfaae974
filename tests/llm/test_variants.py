"""Names two edits away or of a book that is not sent whole; items by sets of cuvee words and by numbers with guards."""

import itertools

import pytest

from vinolake.llm import items, names

BOOK = [(1, "Mas Jean-François Pelnairard"), (2, "Cave Nicolas Bréfonelle"), (3, "Château Tolmaricaud"), (4, "Cave Hélène Corhaurois"), (5, "Cave Nicolas Ostlaurez"), (6, "Mas Hélène Rimhaurez"), (7, "Domaine Nicolas Fonjolinet"), (8, "Mas Hélène Gosmorieux"), (9, "Cave Karel Labet"), (10, "Karel Zelmoraud"), (11, "Karel Velfonserois")]
RECORDS = "source string, record_id bigint, shop string, name string, title string"


def linked(spark, rows):
    rec = spark.createDataFrame([("s", i, "theshop", n, t) for i, n, t in rows], RECORDS)
    return {(r.record_id, r.producer_id) for r in names.link_names(rec, spark.createDataFrame(BOOK, "producer_id bigint, name string")).collect()}


ROWS = [
    (1, "Hélène Corahurios", "x"), (2, "Cohraurios", "x"), (3, "Nicolas Corahurios", "x"), (4, "Karel Labet", "x"), (5, "K. Labett", "x"), (6, "Labett", "x"), (7, None, "Karel Labet Sul 2014"), (8, "Nicolas Brefonele", "x"),
    # another maker, often seen, two edits from an entry, and its own misspelling
    *[(20 + k, "Hélène Corhaudoix", f"y{k}") for k in range(5)], (30, "Hélène Corhaudox", "z"),
]


@pytest.mark.parametrize("rows_of_book", [200_000, 0])
def test_two_edits_and_short_names(spark, monkeypatch, rows_of_book):
    monkeypatch.setattr(names, "BOOK_ROWS", rows_of_book)
    assert linked(spark, ROWS) == {(1, 4), (4, 9), (5, 9), (6, 9), (7, 9), (8, 2)}  # (6) follows the spelling that (5) proves


LISTING = "listing_id bigint, shop string, producer string, title string, variant_title string"
OBSERVED = "obs_id bigint, producer string, cuvee array<string>, vintage int, bucket string"


def pairs(spark, rows):
    listing = spark.createDataFrame([(i, "theshop", n, t, None) for i, n, t in rows], LISTING)
    book = spark.createDataFrame(BOOK, "producer_id bigint, name string")
    return {(r.id_a, r.id_b) for r in items.found_items(listing, spark.createDataFrame([], OBSERVED), book).collect()}


def test_cuvees_are_sets_of_words(spark):
    rows = [
        (1, "Karel Velfonserois", "Grand Tufute rouge 2014"), (2, "Velfonserois", "Tufute Grand red '14"), (3, "Velfonserois K.", "Petit Tufute rouge 2014"), (4, "Velfonserois", "petit tufutte 2014 red"),
        (5, "Karel Labet", "Sul rouge 2014"), (6, "Labet", "sul red 2014"), (7, "Karel Labet", "Ox rouge 2014"), (8, None, "Domaine Labet Sul red 2014"), (9, "Velfonserois", "Sul rouge 2014"),
    ]
    assert pairs(spark, rows) == {(1, 2), (3, 4), (5, 6), (5, 8), (6, 8)}


EAN = "4006381333931"


def test_numbers_join_only_what_agrees(spark):
    rows = [
        # without colour and vintage between a red 2014 and a white 2015: joined to neither
        (1, "Velfonserois", f"Tufute {EAN}"), (2, "Velfonserois", f"Clos Nouvage rouge 2014 {EAN}"), (3, "Velfonserois", f"Merlusot blanc 2015 {EAN}"), (4, "Velfonserois", f"Nouvage du haut red 2014 {EAN}"),
    ]
    assert pairs(spark, rows) == {(2, 4)}
    # only one class fits what states less; a row without maker and words is joined by its number
    rows = [(1, "Velfonserois", f"Tufute 2014 {EAN}"), (2, "Velfonserois", f"Nouvage rouge 2014 {EAN}"), (3, None, f"{EAN}")]
    assert pairs(spark, rows) == set(itertools.combinations((1, 2, 3), 2))
    # part numbers are a maker's own
    rows = [(1, "Velfonserois", "Tufute rouge ref. AB-1207"), (2, "Velfonserois", "Nouvage rouge Ref: ab1207"), (3, "Labet", "Merlusot rouge ref. AB-1207"), (4, "Velfonserois", "Pelvage blanc ref AB-1207")]
    assert pairs(spark, rows) == {(1, 2)}


def test_dates_are_no_article_numbers():
    assert items.valid_gtin("20191221") is False or items.gtin("mis 20191221") is None
    assert [d for d in ("20200210", "11032018", "20231005", "20150711") if items.gtin(f"x {d}")] == []
    assert items.gtin("73513537") == "00000073513537"
    assert items.part_number("art. no. 77-120/b") == "77120b" and items.part_number("article du jour 2014") is None and items.part_number("ref. a12b ref. c34d") is None


def test_large_item(spark, monkeypatch):
    monkeypatch.setattr(items, "ITEM_ROWS", 10)
    groups = spark.createDataFrame([(k, k % 50 // 49) for k in range(200)], "record_id bigint, item bigint")
    got = sorted(map(tuple, items.item_pairs(groups).collect()))
    assert got == sorted((a, b) for a, b in itertools.combinations(range(200), 2) if (a % 50 == 49) == (b % 50 == 49))
