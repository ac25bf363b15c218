"""Document fingerprints: the k least hashes of a text's distinct word shingles. DataFrame and SQL functions only."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .common import keep, table, words

SHINGLE = 5
K = 128
#: hashes are taken as numbers from 0 to this
TOP = float(1 << 63)


def shingles(text: Column, n: int = SHINGLE) -> Column:
    """Distinct hashes, from 0 up to 2**63, of all runs of n lower-cased words; of the whole sequence if it is shorter; none without words."""
    w = words(F.lower(text))
    unsigned = lambda h: F.shiftrightunsigned(h, 1)
    many = lambda a: F.transform(F.sequence(F.lit(0), F.size(a) - n), lambda i: unsigned(F.xxhash64(*[F.get(a, i + k) for k in range(n)])))
    # the array of word hashes is bound to a name, or it would be computed anew for every shingle
    some = lambda a: F.when(F.size(a) >= n, many(a)).when(F.size(a) > 0, F.array(unsigned(F.xxhash64(a)))).otherwise(F.array().cast("array<bigint>"))
    return F.array_distinct(F.flatten(F.transform(F.array(F.transform(w, lambda x: F.xxhash64(x))), some)))


def sketch(text: Column, k: int = K, n: int = SHINGLE) -> Column:
    """The k least shingle hashes, ascending."""
    return F.slice(F.sort_array(shingles(text, n)), 1, k)


def merge(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of a union of parts, from the parts' sketches."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def merged(parts: DataFrame, keys: list[str], col: str = "sketch", k: int = K) -> DataFrame:
    """One sketch for each key from any number of parts: distinct hashes are ranked in (key, range of hashes) groups first, so no group is gathered whole."""
    h = parts.select(*keys, F.explode(col).alias("h")).distinct().withColumn("part", F.pmod("h", F.lit(64)))
    few = h.withColumn("r", F.row_number().over(Window.partitionBy(*keys, "part").orderBy("h"))).where(F.col("r") <= k)
    return few.groupBy(*keys).agg(F.slice(F.sort_array(F.collect_list("h")), 1, k).alias(col))


def distinct_count(s: Column, k: int = K) -> Column:
    """How many distinct shingles the text has: exact for fewer than k, else from the k-th least hash."""
    return F.when(F.size(s) < k, F.size(s).cast("double")).otherwise((k - 1) * TOP / F.element_at(s, -1))


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of common shingles among all of both: among the k least of the union, those in both sketches. Two empty ones: 1."""
    both = F.flatten(F.transform(F.array(merge(a, b, k)), lambda u: F.when(F.size(u) == 0, F.array(F.lit(1.0))).otherwise(
        F.array(F.size(F.array_intersect(u, F.array_intersect(a, b))) / F.size(u)))))
    return F.element_at(both, 1)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b has too; of an empty a: 1."""
    r = resemblance(a, b, k)
    return F.when(F.size(a) == 0, 1.0).otherwise(F.least(F.lit(1.0), r / (1 + r) * (distinct_count(a, k) + distinct_count(b, k)) / distinct_count(a, k)))


def digest(s: Column) -> Column:
    """The sketch as text: eight hexadecimal digits, the upper half, of every hash; empty for an empty sketch."""
    return F.array_join(F.transform(s, lambda h: F.lpad(F.lower(F.hex(F.shiftright(h, 31))), 8, "0")), "")


def neighbours(ids: DataFrame) -> DataFrame:
    """(key, doc_id, n_chars), unique by key -> key, doc_id, n_chars, next_key: every row's successor in descending doc_id, the last one's
    being the first. Rows without an id come last; repeated ids follow each other in order of length, then key.

    Ids are cut into ranges by Spark's range partitioning, which is written down; only the first rows of ranges are looked at across.
    """
    order = [F.desc_nulls_last("doc_id"), F.asc("n_chars"), F.asc("key")]
    rows = keep(ids.repartitionByRange(*order).withColumn("block", F.spark_partition_id()))
    inside = Window.partitionBy("block").orderBy(*order)
    rows = keep(rows.withColumn("next", F.lead("key").over(inside)).withColumn("r", F.row_number().over(inside)))
    chain = Window.orderBy("b")      # one row a range
    firsts = rows.where("r = 1").select(F.col("block").alias("b"), F.col("key").alias("first"))
    after = F.coalesce(F.lead("first").over(chain), F.first("first").over(chain.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    firsts = keep(firsts.select("b", after.alias("after")))
    return rows.join(firsts, F.col("block") == F.col("b")).select("key", "doc_id", "n_chars", F.coalesce("next", "after").alias("next_key"))


def fingerprints(docs: DataFrame, k: int = K, n: int = SHINGLE) -> DataFrame:
    """doc_id, sketch, shingles (estimated count) of every row; null, empty and blank texts have an empty sketch."""
    return docs.select("doc_id", sketch(F.col("text"), k, n).alias("sketch")).withColumn("shingles", distinct_count(F.col("sketch"), k))


def edited(docs: DataFrame, k: int = K, n: int = SHINGLE) -> DataFrame:
    """doc_id, n_chars, sketch, edited, edited_sketch, next_sketch of every row: in the edited text the last half of the characters
    (rounded down) are replaced by the first as many of the next row's text in descending doc_id.

    Rows stand for themselves by a hash of doc_id and text, so rows repeated in both get equal results. Texts are shuffled once by that
    key, for both joins; a neighbour is sent only the part it needs, and the sketch. Null texts count as empty; a single row is its
    own neighbour. Other columns are ignored.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.xxhash64("doc_id", text).alias("key"), "doc_id", text.alias("text"))
    pairs = keep(neighbours(rows.select("key", "doc_id", F.char_length("text").cast("bigint").alias("n_chars")).distinct()))
    texts = rows.select("key", "text")
    need = pairs.select(F.col("next_key").alias("key"), F.col("key").alias("to"), F.floor(F.col("n_chars") / 2).cast("int").alias("half"))
    sent = texts.join(need, "key").select("to", F.substring("text", F.lit(1), F.col("half")).alias("head"), sketch(F.col("text"), k, n).alias("next_sketch"))
    sent = sent.dropDuplicates(["to"]).withColumnRenamed("to", "key")
    both = texts.join(pairs.drop("next_key"), "key").join(sent, "key")
    stays = F.substring("text", F.lit(1), (F.col("n_chars") - F.floor(F.col("n_chars") / 2)).cast("int"))
    both = both.select("doc_id", "n_chars", sketch(F.col("text"), k, n).alias("sketch"), F.concat(stays, "head").alias("edited"), "next_sketch")
    return both.withColumn("edited_sketch", sketch(F.col("edited"), k, n))


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = edited(table(spark, sf_dir, "documents"))
    a, b, c = (F.col(x) for x in ("sketch", "edited_sketch", "next_sketch"))
    return out.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), digest(a).alias("fingerprint"), digest(b).alias("edited_fingerprint"),
                      resemblance(a, b).alias("near_edited"), resemblance(a, c).alias("near_next"), containment(a, b).alias("held_by_edited"), distinct_count(a).alias("shingles"))
