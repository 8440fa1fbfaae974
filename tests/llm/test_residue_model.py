"""The residue model: what it finds without patterns, and from half of the trusted records."""

import random

from vinolake.llm import residue

ERRORS = [
    "Uncaught failure in module {}", "The upstream host gave no reply", "Ce service est en pause", "Deze dienst is even weg", "Bitte schalten Sie Skripte ein", "Access to this area was refused", "Your session has ended",
    "This address leads nowhere any more", "Votre navigateur est en cours de controle", "Type your introduction text here",
]
ASIDE = ["Oh dear.", "Sorry.", "Try again later.", "Terug naar de winkel", "Ref. {}"]
WORDS = "bright round juicy cellar grower harvest barrel label shelf bottle vintage red white patience winter slope".split()


def made(rng, k):
    content = ". ".join(" ".join(rng.sample(WORDS, 6)) for _ in range(rng.randint(1, 3))) + "."
    if k % 8:
        return ("the page says: " if k % 40 == 1 else "") + content, False
    return " ".join([rng.choice(ASIDE), rng.choice(ERRORS) + ".", rng.choice(ASIDE)]).format(k, k, k), True


def test_held_out_trusted_records(spark):
    rng = random.Random(3)
    rows, want = [], set()
    for k in range(1600):
        text, bad = made(rng, k)
        # one error in four came with an error status, and so did some real content
        rows.append(("probe_attempt", k, text, bad and k % 32 == 0 or k % 100 == 1))
        if bad:
            want.add(k)
    table = spark.createDataFrame(rows, "source string, record_id bigint, text string, trusted boolean")
    parsed = residue.parsed_records(table)
    found = residue.judged(parsed, residue.train(residue.training_records(parsed))).collect()
    got = {r.record_id for r in found}
    assert {r.by for r in found} == {"model"}
    untrusted = {k for k in want if k % 32}
    assert len(got & untrusted) >= 0.97 * len(untrusted)
    assert len(got - want) <= 0.01 * len(want)


def test_columns_and_nulls(spark):
    rows = [(1, "s", "p", "u", "x", 500, "Internal Server Error"), (2, "s", "p", "u", "x", None, None), (3, "s", "p", "u", "x", 500, '{"products": []}'), (None, "s", "p", "u", "x", 500, "Internal Server Error"), (4, "s", "p", "u", "x", 200, " "), (5, "s", "p", "u", "x", 200, "{{ x }} " + "Red and round. " * 20_000)]
    rows += [(100 + k, "s", "p", "u", "x", 200, f"The {WORDS[k % 16]} needs patience. Drink the {WORDS[(k * 7) % 16]} now.") for k in range(60)]
    probe = spark.createDataFrame(rows, "attempt_id bigint, source string, slot string, trusted string, said string, http_status int, body_snippet string")
    coverage = spark.createDataFrame([(1, "ok"), (2, "Service Unavailable"), (2, "Service Unavailable"), (3, "TRUNCATED at page 5"), (4, "blocked"), (5, None)], "coverage_id bigint, status string")
    assert sorted(map(tuple, residue.found_residue(probe, coverage).collect())) == [("coverage", 2), ("probe_attempt", 1), ("probe_attempt", 5)]
