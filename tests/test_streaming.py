"""Streams over small folders of Parquet."""

from ferrule.streaming import keyed


def test_state_machine_and_running_min(spark, tmp_path):
    path = str(tmp_path / "in")
    schema = "node long, t int, kind string"
    for k, part in enumerate([[(0, 1, "a"), (1, 1, "x")], [(0, 3, "c"), (0, 2, "b")], [(1, 2, "y")]]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{path}/{k}")
    folder = f"{path}/*"
    out = keyed.drain(keyed.state_machine(keyed.facts_from(spark, folder, schema, 10), "node", "kind", "t"), "machine")
    got = sorted(tuple(r) for r in out.collect())
    assert got == [(0, 1, "start", "a"), (0, 2, "a", "b"), (0, 3, "b", "c"), (1, 1, "start", "x"), (1, 2, "x", "y")]
    low = keyed.drain(keyed.running_min(keyed.facts_from(spark, folder, schema, 10), "node", "t"), "low", "complete")
    assert sorted(tuple(r) for r in low.collect()) == [(0, 1), (1, 1)]


def test_windows(spark, tmp_path):
    path = str(tmp_path / "in")
    spark.sql("select timestamp'2024-01-01 00:00:00' as ts, 1 as k union all select timestamp'2024-01-01 00:04:00', 1 union all select timestamp'2024-01-01 00:06:00', 1").coalesce(1).write.parquet(path)
    stream = keyed.facts_from(spark, path, "ts timestamp, k int")
    out = keyed.drain(keyed.windowed(stream, "ts", "5 minutes", "1 hour", "k"), "windows", "complete")
    assert sorted(r.n for r in out.collect()) == [1, 2]
