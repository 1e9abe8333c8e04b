"""Every catalogue query against its SQL, and the reference behaviours by hand."""

import duckdb
import pytest

from tidelog.functions.crc import crc32c
from tidelog.operators import catalog
from tidelog.operators import versions as V
from tidelog.plans import every

SF = "/root/testdata/sf0.01"


def rows(x, cols):
    return sorted(repr([None if v is None else v for v in (r[c] for c in cols)]) for r in x)


@pytest.mark.parametrize("name", sorted(every.QUERIES))
def test_equals_sql(spark, name):
    df = every.QUERIES[name](spark, SF)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{SF}/events.parquet'")
    cur = con.execute(every.SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    want = [dict(zip(names, r)) for r in cur.fetchall()]
    assert rows(df.collect(), sorted(names)) == rows(want, sorted(names))


def log(spark, data):
    return spark.createDataFrame(data, "k string, seq long, kind int, v string")


def test_versions(spark):
    x = log(spark, [("a", 1, 1, "v1"), ("a", 5, 0, None), ("a", 10, 1, "v2"), ("b", 2, 1, ""), ("ab", 3, 1, "x"), ("c", 4, 1, "y"), ("c", 6, 0, None)])
    got = lambda df: sorted((r.k, r.v) for r in df.collect())
    assert got(V.live(x)) == [("a", "v2"), ("ab", "x"), ("b", "")]
    assert got(V.as_of(x, 7)) == [("ab", "x"), ("b", "")]
    assert got(V.as_of(x, 4)) == [("a", "v1"), ("ab", "x"), ("b", ""), ("c", "y")]
    assert got(V.prefix_scan(x, "a")) == [("a", "v2"), ("ab", "x")]
    assert got(V.live(log(spark, []))) == []
    assert V.successor("a\U0010ffff") == "b" and V.successor("\U0010ffff") is None


def test_hot_key(spark, monkeypatch):
    """A history cut into stretches gives what one window gives, ties included."""
    import random

    r = random.Random(1)
    data = [(r.choice("aaab"), seq, kind, None if kind == 0 else f"v{seq}") for seq in range(1, 400) for kind in ((0, 1) if r.random() < 0.1 else (int(r.random() < 0.7),)) if r.random() < 0.8]
    x = log(spark, data)
    asks = spark.createDataFrame([(r.choice("abc"), r.randrange(420), i) for i in range(80)], "k string, at long, n int")
    plans = (V.validity, V.expected_seq, V.incarnations, lambda y: V.change_feed(y, 200), lambda y: V.as_of_join(asks, y))
    whole = [sorted(map(repr, f(x).collect())) for f in plans]
    monkeypatch.setattr(V, "STRETCH", 3)
    assert [sorted(map(repr, f(x).collect())) for f in plans] == whole
    by_key = {k: sorted((s, kind, v) for kk, s, kind, v in data if kk == k) for k in "ab"}
    for row in V.as_of_join(asks, x).collect():
        seen = [y for y in by_key.get(row.k, []) if y[0] <= row["at"]]
        want = seen[-1] if seen and seen[-1][1] else (None, None, None)
        assert (row.found_seq, row.found_v) == (want[0], want[2])
    for row in V.incarnations(x).collect():
        start = None
        last = 0
        for s, kind, _ in by_key[row.k]:
            start = s if kind and not last else start
            last = kind
            if (s, kind) == (row.seq, 1):
                break
        assert row.create_seq == start


def test_admit(spark):
    x = log(spark, [("a", 1, 1, "v")])
    w = spark.createDataFrame([("a", 0), ("a", 1), ("n", 0)], "k string, expect long")
    assert sorted((r.k, r.expect, r.admitted) for r in V.admit(x, w).collect()) == [("a", 0, False), ("a", 1, True), ("n", 0, True)]


def test_registry():
    r = catalog.Registry()
    r.register("events", "id", ["user_id"])
    with pytest.raises(catalog.TypeExists):
        r.register("events", "id")
    r.add_index("events", "region")
    with pytest.raises(catalog.IndexExists):
        r.add_index("events", "region")
    with pytest.raises(catalog.InvalidSchema):
        r.add_index("events", "a.*.b.*")
    r.remove_index("events", "user_id")
    with pytest.raises(catalog.IndexNotFound):
        r.remove_index("events", "user_id")
    with pytest.raises(catalog.TypeNotFound):
        r.get("users")
    again = catalog.Registry(r.events)
    assert again.get("events") == ("id", ["region"]) and again.list_types() == ["events"]
    again.close()
    with pytest.raises(catalog.Closed):
        again.get("events")


def test_crc32c():
    assert crc32c(b"123456789") == 3808858755
    assert crc32c(b"world", crc32c(b"hello")) == crc32c(b"helloworld")
