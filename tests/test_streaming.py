from datetime import datetime, timedelta

from skein.operators import changes as C
from skein.streaming import guards as G


def run(spark, tmp_path, rows, schema, make, mode, files=2):
    source = str(tmp_path / "in")
    for n in range(files):
        part = rows[n * len(rows) // files : (n + 1) * len(rows) // files]
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
    stream = make(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source))
    q = stream.writeStream.format("memory").queryName(f"t{abs(hash(str(tmp_path)))}").outputMode(mode).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    done = q.awaitTermination(60)
    q.stop()
    assert done
    return spark.table(q.name).collect()


def test_repeat_guard_equals_the_batch_form(spark, tmp_path):
    rows = [(1, t) for t in (0, 1, 2, 3, 600_000_000)] + [(2, 5)]
    got = run(spark, tmp_path, rows, "k long, us long", lambda s: G.repeat_guard(s, "k", "us"), "append", files=1)
    batch = C.repeat_guard(spark.createDataFrame(rows, "k long, us long"), ["k"], "us").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, batch))


def test_changes_coalesce_over_batches(spark, tmp_path):
    rows = [("a", "Added", 1), ("b", "Removed", 2), ("a", "Removed", 3), ("b", "Added", 4)]
    got = run(spark, tmp_path, rows, "path string, kind string, seq long", G.coalesce_changes, "update")
    last = {}
    for r in sorted(got, key=lambda r: r["seq"]):
        last[r["path"]] = r["change"]
    assert last == {"a": "Removed", "b": "Modified"}


def test_debounce(spark, tmp_path):
    t0 = datetime(2024, 1, 1)
    at = [0, 0.2, 0.4, 3, 60, 120]
    rows = [("k", t0 + timedelta(seconds=x)) for x in at]
    got = run(spark, tmp_path, rows, "key string, ts timestamp", lambda s: G.debounce(s, "key", "ts"), "append")
    assert [r["n"] for r in sorted(got, key=lambda r: r["started"])][:2] == [3, 1]


def test_send_once(spark, tmp_path):
    t0 = datetime(2024, 1, 1)
    rows = [("k", t0), ("k", t0 + timedelta(seconds=1)), ("j", t0)]
    got = run(spark, tmp_path, rows, "key string, ts timestamp", lambda s: G.send_once(s, ["key"], "ts"), "append", files=1)
    assert sorted(r["key"] for r in got) == ["j", "k"]
