import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tidepanel.operators import explog, quality as dq
from tidepanel.sources import segments as seg
from tidepanel.streaming import bars as sb, runs
from tidepanel.streaming.stateful import control_chart


def test_merge_sink_replays_and_compacts(spark, tmp_path):
    path, schema = str(tmp_path / "t"), "v double, symbol string, at int"
    write = sb.merge_sink(path, ["symbol"], "at", buckets=3)
    read = lambda: {tuple(r) for r in sb.read_merged(spark, path).select("v", "symbol", "at").collect()}
    first = spark.createDataFrame([(9.0, "A", 1), (2.0, "A", 2), (4.0, "B", 7), (5.0, "C", None)], schema)
    write(first, 0)
    assert read() == {(2.0, "A", 2), (4.0, "B", 7), (5.0, "C", None)}
    second = spark.createDataFrame([(3.0, "A", 3), (8.0, "B", 6), (1.0, "C", 0), (7.0, None, 1)], schema)
    write(second, 1)
    want = {(3.0, "A", 3), (4.0, "B", 7), (1.0, "C", 0), (7.0, None, 1)}
    assert read() == want
    write(second, 1)                                                    # a replayed batch starts from the pointer before it
    assert read() == want
    at = sb.pointer(spark, path)
    write(spark.createDataFrame([(0.5, "A", 3)], schema), 2)            # equal order: the later batch wins; other buckets are not rewritten
    after = sb.pointer(spark, path)
    assert read() == want - {(3.0, "A", 3)} | {(0.5, "A", 3)} and sum(after[b] != at.get(b) for b in after) == 1
    files = spark.read.parquet(*[f"{path}/data/version={v}/bucket={b}" for b, v in after.items()]).inputFiles()
    assert len(files) == len(after)                                     # one file a bucket, whatever the number of batches
    write(spark.createDataFrame([], schema), 3)
    assert sb.pointer(spark, path) == after


def test_segments_keep_the_newest_whole(spark, tmp_path):
    path = str(tmp_path / "log")
    rows = lambda a, b: spark.range(a, b).withColumn("v", F.col("id") * 2)
    seg.append(rows(0, 5), path, keep=8)
    early = seg.read(spark, path)
    seg.append(rows(5, 10), path, keep=8)
    assert seg.manifest(spark, path) == [(1, 5), (0, 5)]
    seg.append(rows(10, 14), path, keep=8)
    assert seg.manifest(spark, path) == [(2, 4), (1, 5)] and early.count() == 5      # a reader from before an append goes on
    assert sorted(r["id"] for r in seg.newest(spark, path, "id", 7).collect()) == list(range(7, 14))
    assert sorted(r["id"] for r in seg.newest(spark, path, "id", 9).collect()) == list(range(5, 14))
    assert sorted(r["id"] for r in seg.newest(spark, path, "id", 4).collect()) == list(range(10, 14))
    assert sorted(r["id"] for r in seg.newest(spark, path, "id", 2).collect()) == [12, 13]
    rows(90, 99).write.parquet(f"{path}/data/segment=3")                # a writer that died before its manifest
    assert seg.read(spark, path).where("id >= 90").isEmpty()
    seg.append(rows(14, 15), path, keep=8)
    assert sorted(r["id"] for r in seg.newest(spark, path, "id", 3).collect()) == [12, 13, 14]
    seg.append(rows(0, 0), path, keep=8)
    assert seg.manifest(spark, path)[0] == (3, 1)


def events(n=300, seed=4):
    rng = np.random.default_rng(seed)
    ts = pd.Timestamp("2024-01-01") + pd.to_timedelta(np.sort(rng.integers(0, 3 * 86_400, n)), unit="s")
    return pd.DataFrame({"seq": range(n), "ts": ts, "user_id": rng.choice([1, 1, 2, 3], n), "value": rng.normal(0.2, 1, n)})


def test_control_chart_is_the_same_however_rows_arrive(spark, tmp_path):
    pdf = events()
    rows = spark.createDataFrame(pdf)
    chart = lambda s: control_chart(s, "user_id", 0.0, 1.0, late="2 hours")
    one = runs.streamed(rows.withColumn("arrival", F.lit(0)), str(tmp_path / "one"), chart, 1).toPandas()
    # rows of every third arrival change places with their neighbours within the watermark's delay
    mixed = runs.arrivals(rows.withColumn("real", F.col("ts")).withColumn("ts", F.col("ts") + F.expr("make_dt_interval(0, 0, seq % 7 * 10)")), 3).withColumn("ts", F.col("real")).drop("real")
    many = runs.streamed(mixed, str(tmp_path / "many"), chart, 3).toPandas()
    key = ["key", "seq"]
    assert one.sort_values(key).reset_index(drop=True).equals(many.sort_values(key).reset_index(drop=True))
    end = pdf["ts"].max() - pd.Timedelta("2h")
    assert len(one) == (pdf["ts"] <= end).sum() and one["cusum_alarm"].sum() > 0
    for user, g in pdf[pdf["ts"] <= end].groupby("user_id"):
        hi = lo = ew = 0.0
        want = []
        for v in g.sort_values(["ts", "seq"])["value"]:
            hi, lo, ew = max(0.0, hi + v), max(0.0, lo - v), 0.8 * ew + 0.2 * v
            hit = hi > 4 or lo > 4
            hi, lo = (0.0, 0.0) if hit else (hi, lo)
            want.append((int(hit), int(abs(ew) > 1.0)))
        got = one[one["key"] == str(user)].sort_values(["ts", "seq"])
        assert list(zip(got["cusum_alarm"], got["ewma_alarm"])) == want


def test_control_charts_of_one_bucket_stay_apart(spark, tmp_path):
    """Keys share the calls to the state store, not their charts: one bucket gives what a bucket a key gives, over several arrivals."""
    rows = runs.arrivals(spark.createDataFrame(events(120, 9)), 2)
    got = [runs.streamed(rows, str(tmp_path / str(n)), lambda s: control_chart(s, "user_id", 0.0, 1.0, buckets=n), 2).toPandas().sort_values(["key", "seq"]).reset_index(drop=True) for n in (1, 997)]
    assert set(got[0]["key"]) == {"1", "2", "3"} and got[0]["cusum_alarm"].sum() > 0
    assert got[0].equals(got[1])


def test_rows_without_a_key_chart_apart(spark, tmp_path):
    """Rows without a key are one chart of their own and leave the charts of the others alone."""
    pdf = events(120, 9)
    rows = runs.arrivals(spark.createDataFrame(pdf).withColumn("user_id", F.when(F.col("user_id") != 2, F.col("user_id"))), 2)
    got = runs.streamed(rows.coalesce(1), str(tmp_path / "all"), lambda s: control_chart(s, "user_id", 0.0, 1.0), 2).toPandas()
    whole = runs.streamed(runs.arrivals(spark.createDataFrame(pdf), 2), str(tmp_path / "named"), lambda s: control_chart(s, "user_id", 0.0, 1.0), 2).toPandas()
    flat = lambda d: d.sort_values("seq").reset_index(drop=True)
    assert set(got["key"]) == {"1", "3", "None"}
    assert flat(got).equals(flat(whole.assign(key=whole["key"].replace("2", "None"))))


def test_state_setting_of_the_session_comes_back(spark):
    name = runs.PROVIDER[0]
    before = spark.conf.get(name)
    with runs.keyed_state(spark):
        assert "RocksDB" in spark.conf.get(name)
    assert spark.conf.get(name) == before


def test_index_names_orphans_and_columns_are_compared(spark):
    index = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "id string, n int")
    bodies = spark.createDataFrame([("a", "x"), ("c", "y"), ("a", "z")], "id string, body string")
    got = sorted((r["id"] or "", r["state"]) for r in explog.indexed(index, bodies).collect())
    assert got == [("", "no_body"), ("a", "both"), ("a", "both"), ("b", "no_body"), ("c", "no_entry")]
    got = {(r["name"], r["verdict"], r["n"]) for r in dq.column_differences(index, ["id", "open"]).collect()}
    assert got == {("id", "present", 2), ("n", "extra", 3), ("open", "missing", 0)}
