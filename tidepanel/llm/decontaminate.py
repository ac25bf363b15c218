"""Benchmark decontamination on templates: numbers, names and units become typed placeholders, windows of template words are joined by
hash, and the values that stand in the placeholders must agree. DataFrame and SQL functions only."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import keep, table

NUMBER, UNIT, NAME = "", "", ""     # letters for private use: no text holds them as words
#: Units that may follow a number.
UNITS = ["mm", "cm", "m", "km", "mg", "g", "kg", "t", "ml", "l", "s", "min", "h", "ms", "hz", "khz", "mhz", "w", "kw", "v", "a", "j", "kj", "pa", "k", "c", "f",
         "inch", "inches", "feet", "foot", "yards", "miles", "mile", "meters", "metres", "liters", "litres", "grams", "kilograms", "pounds", "ounces",
         "seconds", "minutes", "hours", "days", "weeks", "months", "years", "percent", "dollars", "euros", "cents", "degrees"]
WINDOW = 8
SPACE = r"\x20\x09-\x0D"
#: benchmark windows are broadcast up to this many; a larger set is joined by shuffles
BROADCAST_ROWS = 500_000


def bare(text: Column) -> Column:
    """The text without punctuation and signs; words keep their places, as only what stands beside letters or digits goes.
    A word of nothing but signs goes from the text and from the template alike."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\p{P}\p{S}]+", "")


def template(text: Column) -> Column:
    """Template words. A capitalised word inside a sentence is a name; digits are a number; a unit after a number is a unit."""
    # what a match begins with is asked before what stands to its left, which would be looked at for every character
    t = F.regexp_replace(F.coalesce(text, F.lit("")), rf"(?=\p{{Lu}})(?<=[^.!?:{SPACE}][{SPACE}])\p{{Lu}}\p{{Ll}}[\p{{L}}\p{{M}}]*", NAME)
    t = F.lower(F.regexp_replace(t, r"[\p{P}\p{S}]+", ""))
    units = "|".join(UNITS)
    digits = F.regexp_replace(F.regexp_replace(t, rf"(?=\p{{Nd}})(?<![^{SPACE}])\p{{Nd}}+(?=({units})?(?:[{SPACE}]|$))", NUMBER),
                              rf"{NUMBER}([{SPACE}]*)(?:{units})(?=[{SPACE}]|$)", f"{NUMBER}$1{UNIT}")
    return F.when(t.rlike(r"\p{Nd}"), digits).otherwise(t)


def split(text: Column) -> Column:
    return F.array_remove(F.split(text, f"[{SPACE}]+"), "")


def window_hashes(words: Column, n: int = WINDOW) -> Column:
    """One hash for every n neighbouring words, from hashes of the words; of the whole sequence if it is shorter; none without words."""
    h = F.transform(words, lambda w: F.xxhash64(w))
    many = lambda a: F.transform(F.sequence(F.lit(0), F.size(a) - n), lambda i: F.xxhash64(*[F.get(a, i + k) for k in range(n)]))
    few = F.when(F.size(words) > 0, F.array(F.xxhash64(F.lit("short"), F.array_join(words, " ")))).otherwise(F.array().cast("array<bigint>"))
    # the array of word hashes is bound to a name, or it would be computed anew for every window
    return F.when(F.size(words) >= n, F.flatten(F.transform(F.array(h), many))).otherwise(few)


def benchmark_windows(benchmark: DataFrame, n: int = WINDOW) -> DataFrame:
    """win, item_id, item_pos, n_windows and, for windows with placeholders, their template words and bare words."""
    b = benchmark.where("item_id is not null").select("item_id", split(template(F.col("text"))).alias("tw"), split(bare(F.col("text"))).alias("bw"))
    b = b.withColumn("w", window_hashes(F.col("tw"), n)).withColumn("n_windows", F.size("w"))
    b = b.select("item_id", "n_windows", "tw", "bw", F.posexplode("w").alias("item_pos", "win"))
    slots = F.exists(F.slice("tw", F.col("item_pos") + 1, n), lambda w: w.rlike(f"[{NUMBER}{UNIT}{NAME}]"))
    own = lambda c: F.when(slots, F.slice(c, F.col("item_pos") + 1, n))
    return b.select("win", "item_id", "item_pos", "n_windows", own("tw").alias("tw"), own("bw").alias("bw")).distinct()


def contaminated(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, coverage: float = 0.5) -> DataFrame:
    """mark (hash of the text), item_id, windows, coverage, changed: texts that hold at least ``coverage`` of an item's template windows
    with consistent values.

    Matches are grouped by alignment (position in the text less position in the item); an alignment in which one value of the item
    meets two values in the text is dropped, so a re-parameterised question counts and a chance match of placeholders does not.
    ``changed``: how many values differ from the item's. Items of fewer than n words match a text of the same whole template.
    Null, empty and signs-only texts match nothing. Equal texts are one mark. Rows are joined on the hash of a window; no pair of a text
    and an item without a shared window is formed. Null items are ignored; repeated items count once each.
    """
    bench = keep(benchmark_windows(benchmark, n))
    probe = bench.select("win", "item_id", "item_pos", "n_windows", F.col("tw").isNotNull().alias("slots"))
    few = bench.count() <= BROADCAST_ROWS
    # words in a projection of their own: compiled, and computed once; inside the array functions they would be computed per use
    words = docs.select(F.xxhash64("text").alias("mark"), split(template(F.col("text"))).alias("tw")).select("mark", window_hashes(F.col("tw"), n).alias("w"))
    hits = words.select("mark", F.posexplode("w").alias("pos", "win")).join(F.broadcast(probe) if few else probe, "win")
    hits = keep(hits.select("mark", "item_id", "item_pos", "n_windows", "slots", "pos").distinct())
    # values in the text, looked up only for texts with a matched window that has placeholders
    need = hits.where("slots").groupBy("mark").agg(F.collect_list(F.struct("item_id", "item_pos", "pos")).alias("at"))
    need = keep(need)
    texts = docs.select(F.xxhash64("text").alias("mark"), "text").join(need, "mark").select("mark", "at", split(bare(F.col("text"))).alias("dw"))
    cut = F.transform("at", lambda a: F.struct(a["item_id"].alias("item_id"), a["item_pos"].alias("item_pos"), a["pos"].alias("pos"), F.slice("dw", a["pos"] + 1, n).alias("dw")))
    seen = texts.select("mark", F.explode(cut).alias("a")).select("mark", "a.*")
    items = bench.where("tw is not null").select("item_id", "item_pos", "tw", "bw")
    slot = seen.join(F.broadcast(items) if few else items, ["item_id", "item_pos"]).select(
        "mark", "item_id", (F.col("pos") - F.col("item_pos")).alias("shift"), F.explode(F.arrays_zip("tw", "bw", "dw")).alias("s"))
    slot = slot.where(F.col("s.tw").rlike(f"[{NUMBER}{UNIT}{NAME}]")).select("mark", "item_id", "shift", "s.*").distinct()
    kind = slot.groupBy("mark", "item_id", "shift", "tw", "bw").agg(F.count_distinct("dw").alias("n"), F.max((F.col("dw") != F.col("bw")).cast("int")).alias("other"))
    state = kind.groupBy("mark", "item_id", "shift").agg(F.max("n").alias("n"), F.sum("other").alias("changed"))
    fit = hits.withColumn("shift", F.col("pos") - F.col("item_pos")).join(state, ["mark", "item_id", "shift"], "left").where("n is null or n = 1")
    out = fit.groupBy("mark", "item_id").agg(F.count_distinct("item_pos").alias("windows"), F.max("n_windows").alias("of"), F.coalesce(F.max("changed"), F.lit(0)).alias("changed"))
    return out.withColumn("coverage", F.col("windows") / F.col("of")).where(F.col("coverage") >= coverage).drop("of")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, item_id, windows, coverage, changed: one row for every document and benchmark item that it contains."""
    docs = table(spark, sf_dir, "documents")
    found = keep(contaminated(docs, table(spark, sf_dir, "benchmark")))
    return docs.select("doc_id", F.xxhash64("text").alias("mark")).join(found, "mark").drop("mark")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that hold no benchmark item, columns unchanged."""
    found = keep(contaminated(docs, benchmark).select(F.col("mark").alias("__mark")).distinct())
    return docs.join(found, F.xxhash64(docs["text"]) == F.col("__mark"), "left_anti")
