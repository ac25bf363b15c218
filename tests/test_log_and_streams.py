import math
import re
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tidepanel.operators import explog, sequential as sq
from tidepanel.sources import panel as pn
from tidepanel.streaming import bars as sb, stateful


def brute(queries, log, top=3):
    def terms(t):
        w = re.findall(r"\w\w+", t.lower())
        return Counter(w + [f"{a} {b}" for a, b in zip(w, w[1:])])
    log_tf = [terms(e[1]) for e in log]
    out = []
    for qid, title, qt in queries:
        tf = [terms(title), *log_tf]        # the corpus of one query: itself and the log
        df = Counter(t for d in tf for t in d)
        vec = []
        for d in tf:
            v = {t: (1 + math.log(c)) * (math.log((1 + len(tf)) / (1 + df[t])) + 1) for t, c in d.items()}
            n = math.sqrt(sum(x * x for x in v.values())) or 1.0
            vec.append({t: x / n for t, x in v.items()})
        scored = []
        for j, (eid, _, et) in enumerate(log):
            a, b = set(qt), set(et)
            jac = len(a & b) / len(a | b) if a and b else 0.0
            cos = sum(x * vec[1 + j].get(t, 0.0) for t, x in vec[0].items())
            s = 0.6 * jac + 0.4 * cos if title.strip() else jac
            if s > 0.30:
                scored.append((-round(s, 12), eid))
        out += [(qid, e, k + 1) for k, (_, e) in enumerate(sorted(scored)[:top])]
    return sorted(out)


def test_similarity_join_equals_brute_force_with_many_copies(spark):
    rng = np.random.default_rng(11)
    words = [f"w{i}" for i in range(14)]

    def entry(i):
        return (i, " ".join(rng.choice(words, 7)), [str(x) for x in set(rng.choice(words, 6))])
    log = [entry(i) for i in range(120)]
    log += [(200 + i, log[0][1], log[0][2]) for i in range(60)]          # a third of the log is one entry
    queries = [(i, *log[i][1:]) for i in (0, 3)] + [entry(1000 + i) for i in range(15)] + [(3000, " ", log[5][2]), (3001, "größe wérk " + log[7][1], log[7][2])] + [(2000, log[0][1], log[0][2])]
    q = spark.createDataFrame(queries, "qid bigint, q_title string, q_tags array<string>")
    e = spark.createDataFrame(log, "id bigint, title string, tags array<string>")
    got = sorted((r["qid"], r["id"], r["rank"]) for r in explog.similar(q, e).collect())
    assert got == brute(queries, log) and len(got) > 20


def test_a_pair_of_blocks_hands_on_few_entries_a_query(spark, monkeypatch):
    """Pairs and their terms stay inside the tasks; what leaves a pair of blocks are the best entries of a query."""
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(12)]
    log = [(i, " ".join(rng.choice(words, 9)), sorted({str(x) for x in rng.choice(words, 5)})) for i in range(90)] + [(500, "", []), (501, "w1", None)]
    queries = [(1000 + i, *log[i][1:]) for i in range(20)] + [(2000, " ", log[3][2]), (2001, "nothing here", []), (2002, None, None)]
    q = spark.createDataFrame(queries, "qid bigint, q_title string, q_tags array<string>")
    e = spark.createDataFrame(log, "id bigint, title string, tags array<string>")
    _, _, vq, ve, _, _ = explog.similarity_index(q, e)
    a, b, score = explog.scored_block(vq.toArrow(), ve.toArrow(), 3, 0.3, explog.LEAST_COSINE, explog.SHARED_TAGS)
    sent = Counter(a.tolist())
    assert len(sent) > 15 and sorted(sent.values())[-2] == 3 and (score > 0.3).all() and (b < 92).all()
    monkeypatch.setattr(explog, "BLOCK", 200)           # several blocks a side
    got = sorted((r["qid"], r["id"], r["rank"]) for r in explog.similar(q, e).collect())
    assert got == brute([(i, t or "", g or []) for i, t, g in queries], [(i, t, g or []) for i, t, g in log])
    assert "FlatMapCoGroupsInArrow" in explog.similar(q, e)._jdf.queryExecution().executedPlan().toString()


def test_log_round_trip_with_nested_schema(spark, tmp_path):
    d = spark.createDataFrame([("a", "experiment", ["x"])], "id string, type string, tags array<string>").withColumn("metrics", F.struct(F.lit(0.5).alias("sharpe")))
    explog.append_log(d, str(tmp_path))
    assert explog.read_log(spark, str(tmp_path), multi_line=False).select("metrics.sharpe").first()[0] == 0.5


def test_panel_round_trip_prunes_folders(spark, panel, tmp_path):
    root = str(tmp_path / "panel")
    pn.write_panel(panel, root)
    df = pn.read_panel(spark, root, "LONG", as_of="2020-06-30")
    assert df.count() == 182
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "bucket" in plan.split("PartitionFilters:")[1].split("]")[0]
    assert "LessThanOrEqual(ts" in plan


def stream_rows(n=400):
    rng = np.random.default_rng(2)
    return pd.DataFrame({"event_id": range(n), "ts": pd.Timestamp("2024-01-01") + pd.to_timedelta(np.sort(rng.integers(0, 86_400, n)), unit="s"),
                         "event_type": rng.choice(["a", "b"], n), "value": rng.normal(10, 1, n)})


def run_stream(df, path, name):
    q = df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(path)).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name).toPandas()


def test_streamed_bars_equal_batch_bars(spark, tmp_path):
    rows = spark.createDataFrame(stream_rows())
    rows.repartition(3).write.parquet(str(tmp_path / "in"))
    batch = sb.window_bars(rows).toPandas()
    got = run_stream(sb.window_bars(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))), tmp_path / "ck", "bars_out")
    closed = batch[batch["end"] <= batch["end"].max() - pd.Timedelta("1h")]
    m = got.merge(batch, on=["start", "event_type"], suffixes=("", "_b"))
    assert len(got) >= len(closed) - 2 and np.allclose(m["close"], m["close_b"]) and (m["n"] == m["n_b"]).all()


def test_streamed_tiers_equal_batch_tiers(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rng = np.random.default_rng(8)
    pdf = pd.DataFrame({"account": "A", "ts": pd.date_range("2024-01-01", periods=120), "nav": 100 * np.cumprod(1 + rng.normal(0, 0.03, 120))})
    src = str(tmp_path / "in")
    for k in range(3):                                                    # three files, one micro-batch each
        part = spark.createDataFrame(pdf[k * 40:(k + 1) * 40])
        part.coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(part.schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(src)
    got = run_stream(stateful.drawdown_tiers_stream(stream), tmp_path / "ck", "tiers_out").sort_values("ts")
    b = spark.createDataFrame(pdf.rename(columns={"account": "symbol"})).select("symbol", F.col("ts").cast("timestamp_ntz").alias("ts"), "nav")
    want = sq.drawdown_tiers(b, nav="nav").toPandas().sort_values("ts")
    assert got["tier"].tolist() == want["tier"].tolist()


def test_duplicates_are_dropped_in_a_stream(spark, tmp_path):
    rows = spark.createDataFrame(stream_rows(50)).select(F.col("event_type").alias("symbol"), "ts", "value")
    rows.unionByName(rows).write.parquet(str(tmp_path / "in"))
    got = run_stream(sb.drop_duplicate_bars(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))), tmp_path / "ck", "dedup_out")
    assert len(got) == len(rows.distinct().select("symbol", "ts").distinct().collect())


def test_upsert_sink_is_replayable(spark, tmp_path):
    schema = "v double, symbol string, at int"
    write = sb.upsert_parquet(str(tmp_path), ["symbol"], "at")
    first = spark.createDataFrame([(9.0, "A", 1), (2.0, "A", 2), (4.0, "B", 7), (5.0, "C", None)], schema)
    write(first, 0)
    write(first, 0)
    read = lambda: {tuple(r) for r in sb.read_upserted(spark, str(tmp_path), ["symbol"], "at").collect()}
    assert read() == {(2.0, "A", 2), (4.0, "B", 7), (5.0, "C", None)}
    # a later batch: newer A, late B, equal time for C after a missing one
    write(spark.createDataFrame([(3.0, "A", 3), (8.0, "B", 6), (1.0, "C", 0)], schema), 1)
    assert read() == {(3.0, "A", 3), (4.0, "B", 7), (1.0, "C", 0)}
    write(spark.createDataFrame([(0.5, "A", 3)], schema), 2)
    assert (0.5, "A", 3) in read()


def test_cache_tells_families_apart(spark, tmp_path):
    from tidepanel.sources.panel import cached_features
    panel, calls = spark.createDataFrame([("A", 1.0)], "symbol string, close double"), []

    def make(name):
        return lambda d: calls.append(name) or d.withColumn(name, d["close"] * 2)
    for name in ("x", "y", "x"):
        assert name in cached_features(panel, make(name), str(tmp_path), [name]).columns
    cached_features(panel, make("x"), str(tmp_path), ["x"], macro=panel)
    assert calls == ["x", "y", "x"]

