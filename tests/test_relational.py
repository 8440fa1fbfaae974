import itertools
import random

from pyspark.sql import functions as F

from vinolake.operators.components import components
from vinolake.operators.matching import alias_matches, near_misses, set_similarity_join
from vinolake.operators.relational import first_per_key, latest_per_key, rotate, upsert
from vinolake.operators.scale import running


def test_latest_first_upsert_rotate(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("a", 2, "z"), (None, 1, "n"), ("b", None, "q")], "k string, v int, w string")
    assert {tuple(r) for r in latest_per_key(df, ["k"], ["v"]).select("k", "v", "w").collect()} == {("a", 2, "z"), (None, 1, "n"), ("b", None, "q")}
    assert {tuple(r) for r in first_per_key(df, ["k"], ["v"]).select("k", "v", "w").collect()} == {("a", 1, "x"), (None, 1, "n"), ("b", None, "q")}
    old, new = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), spark.createDataFrame([(2, None), (3, "c")], "k int, v string")
    assert {tuple(r) for r in upsert(old, new, ["k"]).collect()} == {(1, "a"), (2, "b"), (3, "c")}
    assert [r.k for r in rotate(old, "k", F.lit(1)).orderBy("turn").collect()] == [2, 1]
    assert latest_per_key(df.limit(0), ["k"], ["v"]).count() == 0


def test_running(spark):
    rows = [(g, i, (i * 7) % 5) for g in ("a", None) for i in range(200)]
    got = running(spark.createDataFrame(rows, "g string, i int, n int"), ["g"], [F.col("i")], F.col("n"), name="before", buckets=8).collect()
    for g in ("a", None):
        own = sorted((r.before, r.n, r.i) for r in got if r.g == g)
        assert len(own) == 200
        total = 0
        by_start = {}
        for b, n, _ in own:
            by_start.setdefault(b, []).append(n)
        for b, ns in sorted(by_start.items()):
            assert b == total
            total += sum(ns)


def test_components(spark):
    random.seed(1)
    edges = [(random.randrange(60), random.randrange(60)) for _ in range(45)] + [(100 + k, 101 + k) for k in range(30)] + [(5, 5), (None, 3)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a int, b int")).collect()}
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    assert got == {n: find(n) for n in parent}
    assert components(spark.createDataFrame([], "a int, b int")).count() == 0


def test_set_similarity_is_exact(spark):
    random.seed(3)
    words = [f"w{k}" for k in range(12)]
    rows = [(random.choice("pq"), random.sample(words, random.randint(0, 6))) for _ in range(150)] + [("p", None), ("p", ["w1", "w1"]), ("q", ["w1", None])]
    got = {(r.g, tuple(r.set_a), tuple(r.set_b)) for r in set_similarity_join(spark.createDataFrame(rows, "g string, tokens array<string>"), ["g"], 0.6).collect()}
    sets = {(g, tuple(sorted({x for x in t if x is not None}))) for g, t in rows if t}
    want = {(g, a, b) for (g, a), (h, b) in itertools.product(sets, sets) if g == h and a < b and a and b and len(set(a) & set(b)) >= 0.6 * len(set(a) | set(b)) - 1e-9}
    assert got == want


def test_alias_and_near_misses(spark):
    al = spark.createDataFrame([("Overnay", "houillon"), ("Bruyère", "bruyere houillon"), ("A", "same"), ("B", "same"), ("C", "")], "producer string, alias string")
    tx = spark.createDataFrame([(1, "Bruyère–Houillon Arbois"), (2, "HOUILLON rouge"), (3, "same"), (4, None), (5, "")], "id int, text string")
    assert {tuple(r) for r in alias_matches(tx, al).collect()} == {(1, "Bruyère", "bruyere houillon"), (2, "Overnay", "houillon")}
    words = spark.createDataFrame([("s", "ganevar"), ("t", "ganevats"), ("s", "houilon"), ("t", "houilon"), ("s", "labetts")], "shop string, word string")
    names = spark.createDataFrame([("G", "Ganevat"), ("H", "Houillon"), ("L", "Labettz")], "producer string, alias string")
    seen = spark.createDataFrame([("L",)], "producer string")
    assert {tuple(r) for r in near_misses(words, names, seen).collect()} == {("G", "s", "ganevar")}
