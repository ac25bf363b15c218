"""Stream operators as finished streams: rows come in four arrivals, some of them late, and the SQL answers leave out what comes too late."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..sources.tables import bars, events
from ..streaming import bars as sb, runs
from ..streaming.stateful import control_chart
from .common import scratch
from .registry import query, rd, rounded
from .sql import BARS, with_

C = F.col
LATE_MS = 600_000       # the watermark's delay, ten minutes

# arrival as in runs.arrivals: events of the eighth minute of every hour come one delivery late; mark is the watermark that meets a row
PARTS = ["lim AS (SELECT min(epoch_us(ts)) AS lo, max(epoch_us(ts)) AS hi FROM events)",
         f"prt AS (SELECT events.*, ((epoch_us(ts) - lo) * 4) // (hi - lo + 1) AS p, ((epoch_us(ts) + {runs.DAY} - lo) * 4) // (hi - lo + 1) AS p2 FROM events, lim)",
         "arr AS (SELECT *, CASE WHEN minute(ts) = 7 AND p < 3 AND p = p2 THEN p + 1 ELSE p END AS arrival FROM prt)",
         f"mks AS (SELECT arrival, max(max(epoch_ms(ts))) OVER (ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - {LATE_MS} AS mark FROM arr GROUP BY arrival)",
         f"met AS (SELECT arr.*, coalesce(mark, -1) AS mark, (SELECT max(epoch_ms(ts)) - {LATE_MS} FROM arr) AS final FROM arr JOIN mks USING (arrival))"]


def delivered(spark, sf):
    e = events(spark, sf).withColumn("ts", C("ts").cast("timestamp"))
    return runs.arrivals(e, 4, F.minute("ts") == 7)


def plain_times(d):
    return d.withColumns({c: C(c).cast("timestamp_ntz") for c in ("start", "end")})


@query("STF-7c", with_([*PARTS, "bar AS (SELECT date_trunc('hour', ts) AS s, * FROM met WHERE epoch_ms(date_trunc('hour', ts) + INTERVAL 1 HOUR) > mark)"],
  """SELECT s AS "start", s + INTERVAL 1 HOUR AS "end", event_type, arg_min(value, row(ts, event_id)) AS open, max(value) AS high, min(value) AS low, arg_max(value, row(ts, event_id)) AS close,
  round(sum(value) + 1.7e-9, 6) + 0.0 AS volume, count(*) AS n FROM bar GROUP BY s, event_type, final HAVING epoch_ms(s + INTERVAL 1 HOUR) <= final"""))
def stf7c(spark, sf):
    """Hourly bars of the stream: closed windows only, without the rows that came behind the watermark."""
    return rounded(plain_times(runs.streamed(delivered(spark, sf), scratch(spark), sb.window_bars)))


@query("STF-8b", with_([*PARTS, "ok AS (SELECT * FROM met WHERE epoch_ms(ts) + 1800000 > mark)",
  "g AS (SELECT *, CASE WHEN ts > lag(ts) OVER w + INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS nw FROM ok WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))",
  "s AS (SELECT *, sum(nw) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k FROM g)"],
  """SELECT user_id, min(ts) AS "start", max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS n, round(sum(value) + 1.7e-9, 6) + 0.0 AS value FROM s GROUP BY user_id, k, final
  HAVING epoch_us(max(ts)) + 1800000000 <= final * 1000"""))
def stf8b(spark, sf):
    """Sessions of the stream, merged across arrivals; a session is written once the watermark has passed its end."""
    return rounded(plain_times(runs.streamed(delivered(spark, sf), scratch(spark), sb.sessions)))


@query("STF-9b", """WITH m AS (SELECT event_type, avg(value) AS usual FROM events GROUP BY 1),
l AS (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1)
SELECT user_id, event_id, ts, event_type, round(value / usual + 1.7e-9, 6) + 0.0 AS ratio FROM l JOIN m USING (event_type)""")
def stf9b(spark, sf):
    """The newest event of every user, enriched with the usual value of its type and merged arrival by arrival into a keyed table."""
    e, work = events(spark, sf), scratch(spark)
    usual = e.groupBy("event_type").agg(F.avg("value").alias("usual"))
    write = sb.merge_sink(f"{work}/latest", ["user_id"], "ts")

    def start(stream):
        d = sb.enrich(stream, usual, "event_type")
        return d.select("user_id", "ts", "event_id", "event_type", (C("value") / C("usual")).alias("ratio")).writeStream.foreachBatch(write)

    runs.deliver(delivered(spark, sf), work, start)
    return rounded(sb.read_merged(spark, f"{work}/latest").withColumn("ts", C("ts").cast("timestamp_ntz")))


@query("STF-10b", f"WITH {BARS} SELECT symbol, ts, close FROM bars")
def stf10b(spark, sf):
    """Every bar once, though a part of them comes twice in one arrival and again in the next."""
    b = runs.arrivals(bars(spark, sf).select("symbol", C("ts").cast("timestamp").alias("ts"), "close"))
    twice = b.where(F.day("ts") < 15)
    again = twice.withColumn("arrival", F.least(C("arrival") + 1, F.lit(3)))
    out = runs.streamed(b.unionByName(twice).unionByName(again), scratch(spark), sb.drop_duplicate_bars)
    return out.withColumn("ts", C("ts").cast("timestamp_ntz"))


@query("STF-4", "WITH RECURSIVE " + ",\n".join([*PARTS, "ref AS (SELECT avg(value) AS mu, greatest(stddev_pop(value), 1e-9) AS sd FROM prt WHERE p = 0)",
  "z AS (SELECT user_id, ts, event_id, (value - mu) / sd AS z, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM met, ref WHERE epoch_us(ts) > mark * 1000 AND epoch_ms(ts) <= final)",
  """w AS (SELECT user_id, 0::BIGINT AS rn, 0.0::DOUBLE AS h, 0.0::DOUBLE AS l, 0.0::DOUBLE AS e, 0 AS a, NULL::TIMESTAMP AS ts, NULL::BIGINT AS event_id FROM z WHERE rn = 1 UNION ALL
  SELECT user_id, rn, CASE WHEN h1 > 4 OR l1 > 4 THEN 0 ELSE h1 END, CASE WHEN h1 > 4 OR l1 > 4 THEN 0 ELSE l1 END, e1, CASE WHEN h1 > 4 OR l1 > 4 THEN 1 ELSE 0 END, ts, event_id
  FROM (SELECT z.user_id, z.rn, z.ts, z.event_id, greatest(0, h + z.z) AS h1, greatest(0, l - z.z) AS l1, 0.8 * e + 0.2 * z.z AS e1 FROM w JOIN z ON z.user_id = w.user_id AND z.rn = w.rn + 1))"""])
  + " SELECT CAST(user_id AS VARCHAR) AS key, ts, event_id AS seq, a AS cusum_alarm, CAST(abs(e) > 1.0 AS INTEGER) AS ewma_alarm FROM w WHERE rn > 0")
def stf4(spark, sf):
    """The control chart of every user's values as a stream, against mean and deviation of the first quarter of the time range."""
    d = delivered(spark, sf)
    first = runs.arrivals(events(spark, sf)).where("arrival = 0").agg(F.avg("value").alias("mu"), F.stddev_pop("value").alias("sd")).first()
    rows = d.select("user_id", "ts", C("event_id").alias("seq"), "value", "arrival")
    out = runs.streamed(rows, scratch(spark), lambda s: control_chart(s, "user_id", first["mu"], first["sd"]))
    return out.withColumn("ts", C("ts").cast("timestamp_ntz"))
