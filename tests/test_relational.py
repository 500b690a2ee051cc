from datetime import datetime, timedelta

from strataql.operators.relational import as_of_join, interval_join

T = datetime(2024, 1, 1)


def test_as_of(spark):
    left = [(i, u, None if i == 7 else T + timedelta(hours=h)) for i, (u, h) in enumerate([("a", 0), ("a", 5), ("a", 60), ("b", 1), (None, 3), ("a", 5), ("c", 9), ("a", 1)])]
    right = [("a", T + timedelta(hours=1), 10), ("a", T + timedelta(hours=5), 20), ("a", T + timedelta(hours=5), 21), ("b", T + timedelta(hours=2), 30), (None, T, 40), ("a", None, 50)]
    l = spark.createDataFrame(left, "id int, u string, ts timestamp").selectExpr("*", "'clash' AS v", "'clash' AS bucket")
    r = spark.createDataFrame(right, "ru string, rts timestamp, val int").withColumnRenamed("ru", "u")
    want = {}
    for i, u, ts in left:
        seen = [(t, v) for ru, t, v in right if ru == u and t is not None and ts is not None and t <= ts]
        want[i] = max(seen)[1] if seen else None
    for seconds in (3600, 86_400, 10**9):
        assert {x.id: x.val for x in as_of_join(l, r, ["u"], "ts", "rts", ["val"], seconds).collect()} == want
    assert as_of_join(l.limit(0), r, ["u"], "ts", "rts", ["val"]).collect() == []


def test_interval(spark):
    points = spark.createDataFrame([(p,) for p in (0, 5, 9, 10, 99, 100, None)], "p int")
    ranges = spark.createDataFrame([("x", 0, 10), ("y", 5, 100), ("z", 7, 7), ("n", None, 9)], "name string, lo int, hi int")
    got = {(r.p, r.name) for r in interval_join(points, ranges, "p", "lo", "hi", 10).collect()}
    assert got == {(0, "x"), (5, "x"), (9, "x"), (5, "y"), (9, "y"), (10, "y"), (99, "y")}
