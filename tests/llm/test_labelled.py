"""Subject models are fitted and calibrated on every labelled document."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from vinolake.llm import subjects

LABELLED = 8_100  # above the 8,000 that an earlier version fitted on


@pytest.fixture(scope="module")
def tables(spark):
    """One subject on every document but the fifty with the largest hashes of their ids, which have the other."""
    ids = spark.range(LABELLED).orderBy(F.xxhash64("id")).select("id").collect()
    rng = random.Random(4)
    words = {"law": ["appeal", "statute", "notary", "permit"], "sport": ["goalkeeper", "sprint", "referee", "league"]}
    filler = ["the red is bright and round", "drink it now or keep it for years"]

    def document(s):
        a, b = rng.sample(words[s], 2)
        return f"{rng.choice(filler)}. Most wrote about the {a} and the {b}. First the {b} then the {a} took up the visit. {rng.choice(filler)}."

    kinds = {r.id: "law" if k < LABELLED - 50 else "sport" for k, r in enumerate(ids)}
    docs = [(k, document(s), "en") for k, s in kinds.items()] + [(10_000, document("sport"), "en"), (10_001, document("law"), "en")]
    return spark.createDataFrame(docs, "doc_id bigint, text string, lang string"), spark.createDataFrame(list(kinds.items()), "doc_id bigint, subject string")


@pytest.mark.parametrize("broadcast", [True, False])
def test_all_labelled_documents(tables, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(subjects, "small_side", lambda df, *a: df)
    docs, labels = tables
    assert subjects.labelled_documents(docs, labels).count() == LABELLED


def test_subject_of_few_documents_among_many(tables):
    docs, labels = tables
    found = {(r.doc_id, r.subject) for r in subjects.found_subjects(docs, labels).where("doc_id >= 10000").collect()}
    assert found == {(10_000, "sport"), (10_001, "law")}


def test_pairs_sent_on_early(spark, monkeypatch):
    rng = random.Random(6)
    rows = [(k, ". ".join(" ".join(rng.choices("abcdefgh", k=5)) for _ in range(3)) + ".", "en", [["law"], ["sport"], ["law", "sport"]][k % 3]) for k in range(60)]
    labelled = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, subjects array<string>")
    whole = subjects.train(labelled)
    monkeypatch.setattr(subjects, "MANY_PAIRS", 3)
    early = subjects.train(labelled)
    assert whole.thresholds == pytest.approx(early.thresholds) and (whole.lexicon.pairs == early.lexicon.pairs).all()


def test_pieces():
    frames = [pd.DataFrame({"a": range(k)}) for k in (0, 1, subjects.PART + 1)]
    assert [len(x) for x in subjects._parts(frames)] == [1, subjects.PART, 1]


def best_cut(points):
    """The best threshold by trying every score."""
    want, scores = sum(b for _, b in points) or 1, sorted({v for v, _ in points if v is not None}, reverse=True)
    if not scores:
        return subjects.DEFAULT_CUT

    def f1(cut):
        over = [b for v, b in points if v is not None and v >= cut]
        return 2 * sum(over) / (len(over) + want)

    at = max(range(len(scores)), key=lambda k: (f1(scores[k]), -k))
    below = scores[at + 1] if at + 1 < len(scores) else 0.0
    return (scores[at] + max(below, 0.0)) / 2


@pytest.mark.parametrize("here", [True, False])
def test_calibration_against_brute_force(spark, monkeypatch, here):
    monkeypatch.setattr(subjects, "fits", lambda df: here)
    rng = random.Random(3)
    points = [(rng.randrange(4), rng.choice([None, round(rng.uniform(0, 0.6), 2), rng.uniform(-0.01, 2)]), rng.random() < 0.4) for _ in range(400)]
    points = [(s, v, b and s != 2) for s, v, b in points] + [(4, None, True), (5, 0.3, True)]  # none true; no passage; one point
    many, pull = sum(b for *_, b in points), subjects.DEFAULT_WEIGHT
    pooled = (many * best_cut([p[1:] for p in points]) + 2 * pull * subjects.DEFAULT_CUT) / (many + 2 * pull)
    names = [f"s{k}" for k in range(7)]  # s6 has no point
    own = {s: [p[1:] for p in points if p[0] == k] for k, s in enumerate(names)}
    want = {s: (sum(b for _, b in v) * best_cut(v) + pull * pooled) / (sum(b for _, b in v) + pull) for s, v in own.items()}
    table = spark.createDataFrame(points, "subject int, score double, is boolean")
    assert subjects.calibrate(table, names) == pytest.approx(want)
    assert set(subjects.calibrate(table.limit(0), names)) == set(names)
