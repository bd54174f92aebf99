from itertools import product

from pyspark.sql import functions as F

from skein.operators import changes as C

PAIRS = {("Added", "Modified"): "Added", ("Added", "Removed"): "Removed", ("Modified", "Added"): "Modified", ("Modified", "Removed"): "Removed", ("Removed", "Added"): "Modified", ("Removed", "Modified"): "Modified"}


def fold(kinds):
    now = kinds[0]
    for k in kinds[1:]:
        now = PAIRS.get((now, k), now)
    return now


def test_coalescing_equals_the_fold_of_all_short_histories(spark):
    kinds = ("Added", "Modified", "Removed")
    histories = [h for n in (1, 2, 3, 4) for h in product(kinds, repeat=n)]
    rows = [(f"p{i}", k, s) for i, h in enumerate(histories) for s, k in enumerate(h)]
    df = spark.createDataFrame(rows, "path string, kind string, seq long")
    got = {r["path"]: r["change"] for r in C.coalesce_changes(df, "path", "kind", ["seq"]).collect()}
    assert got == {f"p{i}": fold(h) for i, h in enumerate(histories)}


def test_barrier(spark):
    rows = [(0, False, [], "Fresh"), (5, False, [], "Fresh"), (0, False, ["src/lib.rs"], "Repair"), (0, True, [], "Degrade"), (6, False, [], "Repair"), (0, False, [f"f{n}" for n in range(65)], "Degrade"), (0, False, ["a"] * 100, "Repair")]
    df = spark.createDataFrame(rows, "age int, bad boolean, suspects array<string>, want string")
    assert all(r["got"] == r["want"] for r in df.withColumn("got", C.barrier(F.col("age"), F.col("bad"), F.col("suspects"))).collect())


def test_blocked_calls_are_not_recorded(spark):
    us = [0, 1, 2, 3, 4, 600_000_000, 600_000_001]
    df = spark.createDataFrame([(1, t) for t in us], "k int, us long")
    got = [(r["us"], r["prior"], r["blocked"]) for r in C.repeat_guard(df, ["k"], "us").orderBy("us").collect()]
    assert got == [(0, 0, False), (1, 1, False), (2, 2, False), (3, 3, True), (4, 3, True), (600_000_000, 2, False), (600_000_001, 2, False)]


def test_rate_counts_across_buckets(spark):
    us = [0, 5, 9, 10, 14, 15, 30]
    df = spark.createDataFrame([(n, t) for n, t in enumerate(us)], "id long, us long")
    got = {r["us"]: r["prior"] for r in C.rate_guard(df, "us", "id", most=2, window_us=10).collect()}
    assert got == {t: sum(0 < t - x < 10 for x in us) for t in us}


def test_snapshot_diff(spark):
    a = spark.createDataFrame([("x", 1), ("y", 1), ("z", None)], "path string, m int")
    b = spark.createDataFrame([("y", 2), ("z", None), ("w", 1)], "path string, m int")
    assert {tuple(r) for r in C.snapshot_diff(a, b, "path", ["m"]).collect()} == {("x", "Removed"), ("y", "Modified"), ("w", "Added")}


def test_denial_resets_and_silences(spark):
    calls = [(1, t, n, k) for n, (t, k) in enumerate([(0, "grep"), (1, "grep"), (2, "grep"), (3, "grep"), (20, "grep"), (21, "tool"), (22, "grep"), (23, "other")])]
    df = spark.createDataFrame(calls, "s int, us long, id long, kind string")
    got = [r["decision"] for r in C.burst_guard(df, "s", "us", "kind", {"grep": 100}, {"grep": 3}, "tool", silence_us=15).orderBy("id").collect()]
    assert got == ["allow", "allow", "deny", "silenced", "allow", "reset", "allow", "neutral"]


def test_bootstrap_interval_holds_the_mean(spark):
    from skein.operators.reports import bootstrap

    df = spark.createDataFrame([(n, float(n)) for n in range(50)] + [(99, None)], "id long, d double")
    a, b = (bootstrap(p, "d", "id", resamples=2_000).first() for p in (df, df.repartition(7)))
    assert abs(a["low"] - b["low"]) < 1e-9 and a["n"] == 50 and a["mean"] == 24.5
    assert 19 < a["low"] < 22 < 27 < a["high"] < 30  # 24.5 and two standard errors of 2.06
    none = bootstrap(df.limit(0), "d", "id", resamples=10).first()
    assert none["n"] == 0 and none["low"] is None


def test_folds_of_long_histories_and_several_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 100)
    try:
        df = spark.range(20_000).selectExpr("cast(id % 10 = 3 as int) as k", "id * 10 as us")
        d = {(r["k"], r["started"]): r["n"] for r in C.debounced(df, "k", "us", 100, 1_000).collect()}
        assert sum(d.values()) == 20_000 and sum(n for (k, _), n in d.items() if k) == 2_000
        assert C.throttled(df, "k", "us", 1_000).filter("k = 0").count() == len(range(0, 20_000, 100))
        blocked = C.repeat_guard(df.filter("k = 1"), ["k"], "us", most=3, window_us=1_000)
        assert blocked.count() == 2_000 and blocked.filter("blocked").count() == 2_000 - 600
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
