"""Panels derived from the star-schema tables: bars, macro series, universe, intraday bars."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

# Cross-asset tickers the feature catalogue knows, each fed here by one customer nation
# (nation key in order), and the short column name it gets once pivoted.
MACRO_TICKERS = {
    "^VIX": "vix", "^VVIX": "vvix", "^TNX": "tnx", "^IRX": "irx", "^FVX": "fvx",
    "^VIX9D": "vix9d", "^VIX3M": "vix3m", "DX-Y.NYB": "dxy", "HYG": "hyg", "TLT": "tlt",
    "GLD": "gld", "QQQ": "qqq", "^SKEW": "skew", "LQD": "lqd", "EEM": "eem", "IEF": "ief",
    "XLF": "xlf", "XLK": "xlk", "XLV": "xlv", "XLE": "xle", "IWM": "iwm",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily OHLCV bars, one symbol per supplier: trades are line items priced at a base of 100
    plus their scaled unit price, which keeps bar returns in a realistic range.

    The aggregation is partial before the shuffle and leaves at most one row per symbol and day, so a
    supplier holding a third of all line items still ends as one calendar-bounded series.
    """
    seq = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    trades = table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("symbol"),
        F.col("l_shipdate").alias("ts"),
        (100.0 + F.col("l_extendedprice") / F.col("l_quantity") / 5000.0).alias("price"),
        "l_quantity", seq.alias("seq"),
    )
    return trades.groupBy("symbol", "ts").agg(
        F.min_by("price", "seq").alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max_by("price", "seq").alias("close"),
        F.sum("l_quantity").alias("volume"),
    )


def macro(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long table (ticker, ts, close): largest order per customer nation (modulo the tickers) and day, in thousands."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_totalprice")
    cust = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    names = F.array(*[F.lit(t) for t in MACRO_TICKERS])
    return (
        orders.join(cust, orders.o_custkey == cust.c_custkey)
        .select(F.element_at(names, (F.col("c_nationkey") % len(MACRO_TICKERS) + 1).cast("int")).alias("ticker"),
                F.col("o_orderdate").alias("ts"), "o_totalprice")
        .groupBy("ticker", "ts").agg((F.max("o_totalprice") / 1000.0).alias("close"))
    )


def universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dimension (symbol, name, sector, universe): supplier with its region as sector."""
    sup, nat, reg = (table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    return (
        sup.join(nat, sup.s_nationkey == nat.n_nationkey)
        .join(reg, nat.n_regionkey == reg.r_regionkey)
        .select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("symbol"),
                F.col("s_name").alias("name"), F.col("r_name").alias("sector"),
                F.col("n_name").alias("universe"))
    )


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


def experiments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Experiment log derived from documents: one entry per document, its title is the whole text, its tags are the text's distinct
    words of four or more letters or digits of any script.

    Columns: id, type, title, tags, ts, sharpe, oos_sharpe, max_dd, ann_return (all derived from the row).
    """
    d = table(spark, sf_dir, "documents")
    clean = F.regexp_replace(F.lower("text"), r"[^\p{L}\p{N} ]", " ")
    words = F.filter(F.split(clean, " "), lambda w: F.length(w) >= 4)
    kinds = F.array(*[F.lit(k) for k in ("experiment", "finding", "heuristic", "failure", "promotion")])
    # most entries are experiments, as in a real log
    kind = F.when(F.col("doc_id") % 10 < 6, F.lit("experiment")).otherwise(
        F.element_at(kinds, (F.col("doc_id") % 5 + 1).cast("int")))
    return d.select(
        F.col("doc_id").alias("id"), kind.alias("type"),
        F.col("text").alias("title"),
        F.array_distinct(words).alias("tags"),
        F.col("source").alias("session"),
        ((F.col("n_chars") % 400 - 150) / 100.0).alias("sharpe"),
        ((F.col("n_chars") % 370 - 140) / 100.0).alias("oos_sharpe"),
        (-(F.col("n_chars") % 45)).cast("double").alias("max_dd"),
        (F.col("n_chars") % 30).cast("double").alias("ann_return"),
    )
