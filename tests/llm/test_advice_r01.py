
import pytest

from vinolake.llm import boilerplate as bp
from vinolake.llm import names, residue

RECORDS = "source string, record_id bigint, shop string, name string, title string"


def linked(spark, rows, book):
    rec = spark.createDataFrame([("s", i, "theshop", n, t) for i, n, t in rows], RECORDS)
    return {(r.record_id, r.producer_id) for r in names.link_names(rec, spark.createDataFrame(book, "producer_id bigint, name string")).collect()}


def test_frequent_misspelling_is_decided_by_evidence(spark):
    book = [(1, "Mas Jean-François Pelnairard"), (2, "Weingut Benoît Pelnairard"), (3, "Cave Nicolas Bréfonelle"), (4, "Château Tolmaricaud"), (5, "Cave Hélène Corhaurois")]
    hot = [(k, "Wgt. Benoit Pelnairerd", "Trelaris") for k in range(5)] * 2 + [(5, None, "mas j.f. pelnairerd rosé 2019"), (6, "Dominique Pelnairerd", "x"), (7, "Ch. Tolmaricaut", "x"), (8, "Chat. Tolmaricaut", "y"), (9, "Château Tolmaricaut", "z"), (10, None, "Tolmaricaut rouge")]
    exact = [(20, "Benoît Pelnairard", "x"), (21, "Tolmaricaud", "x")]
    # a cuvee one edit from a surname, hardly rarer than it, names no maker
    cuvee = [(30 + k, "Hélène Corhaurois", "Les Brenonelle blanc") for k in range(4)] + [(40, None, "Brenonelle 2019"), (41, "Nicolas Bréfonelle", "x")]
    want = {(k, 2) for k in range(5)} | {(5, 1), (7, 4), (8, 4), (9, 4), (10, 4), (20, 2), (21, 4), (41, 3)} | {(30 + k, 5) for k in range(4)}
    assert linked(spark, hot + exact + cuvee, book) == want


@pytest.mark.parametrize(
    "text,want",
    [
        ("ok __status__", True), ("__status__", True), ("__row.status__", True), ("ok __STATUS__", True), ("ok [status here]", True), ("ok @model.status", True), ("ok @MODEL.status", True), ("ok", False), ("ok [click here]", False), ("ok, mail info@model.com", False), ("parse error: snake_case__name", False),
    ],
)
def test_slots_in_either_case(text, want):
    assert bool(residue.PLACEHOLDER.search(text)) is want


def test_slot_before_crawler_status(spark):
    rows = [("coverage", k, x) for k, x in enumerate(["ok __status__", "__state__", "ok", "blocked __outcome__", "truncated"])] + [("probe_attempt", 9, "Il reste 4 bouteilles de ce rouge. __title__")]
    got = {(r.source, r.record_id) for r in residue.residue_records(spark.createDataFrame(rows, "source string, record_id bigint, text string")).collect()}
    assert got == {("coverage", 0), ("coverage", 1), ("coverage", 3), ("probe_attempt", 9)}


def test_short_surnames(spark):
    book = [(1, "Domaine Karel Roux"), (2, "Château Blanc"), (3, "Mas Hélène Ney"), (4, "Cave Ney-Corhaurois"), (5, "Raphaël Ostlaurez"), (6, "Karel Zelmoraud"), (7, "Karel Rimhaurez"), (8, "Hélène Fonjolinet"), (9, "Hélène Gosmorieux")]
    rows = [
        (1, "K. Roux", "x"), (2, "Roux", "x"), (3, "Dominique Roux", "x"), (4, None, "Karel Roux rouge 2019"), (5, None, "Les Terres roux 2019"), (6, None, "Chat. Blanc 2020"), (7, None, "Sancerre blanc 2020"), (8, "Ney Hélène", None), (9, None, "Corhaurois et Ney rosé"), (10, "Raphaël Ostlaurez", "Sancerre blanc"), (11, None, "Ostlaurez Raphaël Blanc"),
    ]
    assert linked(spark, rows, book) == {(1, 1), (2, 1), (4, 1), (6, 2), (8, 3), (9, 4), (10, 5), (11, 5)}


def test_repeated_facts_are_content(spark):
    letters = "abcdefghijkl"
    rows = []
    for k, c in enumerate(letters):  # a shop of one grape and one size
        rows.append((k, "s", "\n".join(["Home", "Wines", f"Cuvee {c * 6} of grower {c * 4}", "Gamay", "75 cl", "Bio", f"The wine {c * 5} is bright and needs patience in the cellar of {c * 7}.", "Share this page", "Terms of sale", "Privacy"])))
    got = {}
    for r in bp.main_content(spark.createDataFrame(rows, "page_id bigint, shop string, body string")).collect():
        got.setdefault(r.page_id, set()).add(r.line_no)
    assert got == {k: {2, 3, 4, 5, 6} for k in range(len(letters))}
