import datetime as dt

from pyspark.sql import functions as F

from vinolake.operators.snapshots import SnapshotStore, found_changes, page_path

T = [dt.datetime(2025, 1, k) for k in range(1, 10)]
SCHEMA = "snap_no int, shop string, url string, price double, in_stock boolean, loaded_at timestamp, page_path string"


def test_page_path(spark):
    urls = ["https://WWW.A.example/P/X-1/?v=1#t", "http://a.example/p/caf%C3%A9-2", "https://a.example/p/a+b", "https://a.example/p/%zz/", "https://a.example", None, "//a.example/q/"]
    rows = spark.createDataFrame([(u,) for u in urls], "u string").select(page_path(F.col("u"))).collect()
    assert [r[0] for r in rows] == ["/p/x-1", "/p/café-2", "/p/a+b", "/p/%zz", "", None, "/q"]


def test_changes(spark):
    rows = [
        (1, "s", "https://s/a", 10.0, True, T[1], "z"), (1, "s", "https://s/b", 5.0, None, T[1], "z"), (1, "s", "https://s/c", None, True, T[1], "z"), (1, "s", "https://s/d", 3.0, True, T[1], "z"),
        # snapshot 2 was not delivered for s
        (3, "s", "https://S/A/", 10.0000001, True, T[3], "z"), (3, "s", "https://s/b", 5.0, False, T[3], "z"), (3, "s", "https://s/c?x", 1.0, True, T[3], "z"), (3, "s", "https://s/e", 1.0, True, T[3], "z"),
        # a correction that loads later counts, repeated rows do not
        (4, "s", "https://s/a", 99.0, True, T[4], "z"), (4, "s", "https://s/a", 10.0, True, T[8], "z"), (4, "s", "https://s/a", 10.0, True, T[8], "z"), (4, "s", "https://s/b", 5.0, False, T[4], "z"), (4, "s", "https://s/c", 1.0, True, T[4], "z"), (4, "s", "https://s/e", 1.0, True, T[4], "z"),
        (2, "t", "https://t/a", 1.0, True, T[2], "z"), (None, "t", "https://t/b", 1.0, True, T[2], "z"), (3, None, "https://t/b", 1.0, True, T[2], "z"), (3, "t", None, 1.0, True, T[2], "z"),
    ]
    got = {tuple(r) for r in found_changes(spark.createDataFrame(rows, SCHEMA)).select("snap_no", "shop", "page_path", "change_kind").collect()}
    assert got == {(3, "s", "/b", "changed"), (3, "s", "/c", "changed"), (3, "s", "/d", "removed"), (3, "s", "/e", "added")}
    assert found_changes(spark.createDataFrame([], SCHEMA)).count() == 0


def test_store(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path / "index"), ["k"], ["v"], 8)
    one = spark.createDataFrame([(1, "a"), (2, None), (3, "c"), (3, "c")], "k int, v string")
    two = spark.createDataFrame([(1, "a"), (2, "b"), (4, "d")], "k int, v string")
    assert store.apply(one) is None
    changes = store.apply(two)
    assert {tuple(r) for r in changes.collect()} == {(2, "changed"), (3, "removed"), (4, "added")}
    assert {tuple(r) for r in SnapshotStore.old_values(changes, one, ["k"]).distinct().collect()} == {(2, None), (3, "c")}
    assert store.apply(two).count() == 0
