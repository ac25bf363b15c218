"""Calendar features: functions of the bar date and of event tables."""
from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, functions as F

from ...functions.windows import flag
from .base import family

C = F.col

# Scheduled central-bank decision days, 2018-2023.
FOMC_DATES = """
2018-01-31 2018-03-21 2018-05-02 2018-06-13 2018-08-01 2018-09-26 2018-11-08 2018-12-19
2019-01-30 2019-03-20 2019-05-01 2019-06-19 2019-07-31 2019-09-18 2019-10-30 2019-12-11
2020-01-29 2020-03-03 2020-03-15 2020-04-29 2020-06-10 2020-07-29 2020-09-16 2020-11-05 2020-12-16
2021-01-27 2021-03-17 2021-04-28 2021-06-16 2021-07-28 2021-09-22 2021-11-03 2021-12-15
2022-01-26 2022-03-16 2022-05-04 2022-06-15 2022-07-27 2022-09-21 2022-11-02 2022-12-14
2023-02-01 2023-03-22 2023-05-03 2023-06-14 2023-07-26 2023-09-20 2023-11-01 2023-12-13
""".split()


@family("FEA-33", "month_sin month_cos dow_sin dow_cos", 0)
def cyclical(p):
    m = 2.0 * math.pi * F.month("ts") / 12.0
    d = 2.0 * math.pi * F.weekday("ts") / 5.0
    return [{"month_sin": F.sin(m), "month_cos": F.cos(m), "dow_sin": F.sin(d), "dow_cos": F.cos(d)}]


@family("FEA-34", "favorable_season quarter_end month_end january december month_start payday week_of_month", 0)
def flags(p):
    m, d = F.month("ts"), F.day("ts")
    return [{"favorable_season": flag(m.isin(11, 12, 1, 2, 3, 4)),
             "quarter_end": flag((d >= 28) & m.isin(3, 6, 9, 12)), "month_end": flag(d >= 28),
             "january": flag(m == 1), "december": flag(m == 12), "month_start": flag(d <= 3),
             "payday": flag(d == 15), "week_of_month": (F.floor((d - 1) / 7) + 1).cast("int")}]


@family("FEA-35", "opex_week", 0)
def opex(p):
    day = C("ts").cast("date")
    third = F.date_add(F.next_day(F.date_sub(F.trunc(day, "month"), 1), "Fri"), 14)
    return [{"opex_week": flag((C("ts") >= F.date_sub(third, 4)) & (C("ts") <= third))}]


@family("FEA-57", "month_last_day tom_zone", 0)
def turn_of_month(p):
    last = flag(C("ts").cast("date") == F.last_day("ts"))
    return [{"month_last_day": last}, {"tom_zone": flag((F.day("ts") <= 3) | (C("month_last_day") == 1))}]


def fomc_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(d,) for d in FOMC_DATES], "d string").select(F.to_date("d").alias("event"))


def us_federal_holidays(first_year: int, last_year: int) -> list[str]:
    """Observed federal holidays by rule (fixed days move to the nearest weekday)."""
    from datetime import date, timedelta

    def nth(y, m, wd, k):
        d = date(y, m, 1)
        d += timedelta(days=(wd - d.weekday()) % 7)
        return d + timedelta(weeks=k - 1)

    def last(y, m, wd):
        d = date(y + (m == 12), m % 12 + 1, 1) - timedelta(days=1)
        return d - timedelta(days=(d.weekday() - wd) % 7)

    def observed(d):
        return d + timedelta(days={5: -1, 6: 1}.get(d.weekday(), 0))

    days = []
    for y in range(first_year, last_year + 1):
        fixed = [date(y, 1, 1), date(y, 7, 4), date(y, 11, 11), date(y, 12, 25)]
        if y >= 2021:
            fixed.append(date(y, 6, 19))
        days += [observed(d) for d in fixed]
        if y >= 1986:
            days.append(nth(y, 1, 0, 3))
        days += [nth(y, 2, 0, 3), last(y, 5, 0), nth(y, 9, 0, 1), nth(y, 10, 0, 2), nth(y, 11, 3, 4)]
    return sorted(d.isoformat() for d in days)


def event_proximity(panel: DataFrame, events: DataFrame, weights: dict[int, float], out: str,
                    combine=F.max) -> DataFrame:
    """Attach the weight of the nearest relevant event day: ``weights`` maps days after the event to a weight.

    The event table is expanded to the days it touches, so the bars meet it in an equi-join on the day.
    """
    w = F.map_from_arrays(F.array(*[F.lit(k) for k in weights]), F.array(*[F.lit(float(v)) for v in weights.values()]))
    days = (events.select("event", F.explode(w).alias("off", "wt"))
            .groupBy(F.date_add("event", C("off")).alias("_day")).agg(combine("wt").alias(out)))
    return (panel.withColumn("_day", C("ts").cast("date")).join(days, "_day", "left")
            .withColumn(out, F.coalesce(out, F.lit(0.0))).drop("_day"))


# days after the meeting -> weight; a meeting day beats the day after, which beats the two days before
FOMC_WEIGHTS = {0: 3.0, 1: 2.0, -1: -1.0, -2: -1.0}
# days before a holiday -> closeness
HOLIDAY_WEIGHTS = {-1: 4.0, -2: 3.0, -3: 2.0, -4: 1.0}


def fomc_features(panel: DataFrame, events: DataFrame | None = None) -> DataFrame:
    """FEA-45: fomc_proximity, fomc_day, fomc_post. Later meetings overwrite earlier ones on a shared day."""
    ev = events if events is not None else fomc_table(panel.sparkSession)
    df = event_proximity(panel, ev, FOMC_WEIGHTS, "fomc_proximity", F.max)
    return df.withColumns({"fomc_day": flag(C("fomc_proximity") == 3.0), "fomc_post": flag(C("fomc_proximity") == 2.0)})


def pre_holiday_features(panel: DataFrame, first_year: int = 1971, last_year: int = 2035) -> DataFrame:
    """FEA-50: pre_holiday (5 minus days to the next holiday, up to 4 days ahead) and its flag."""
    days = us_federal_holidays(first_year, last_year)
    ev = panel.sparkSession.createDataFrame([(d,) for d in days], "d string").select(F.to_date("d").alias("event"))
    df = event_proximity(panel, ev, HOLIDAY_WEIGHTS, "pre_holiday", F.max)
    return df.withColumns({"pre_holiday": C("pre_holiday").cast("int"), "pre_holiday_flag": flag(C("pre_holiday") >= 1)})
