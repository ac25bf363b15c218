"""Spelling variants by a reduced alphabet: letters become a few symbols, the full one-edit neighbourhoods of reduced words meet the reduced
vocabulary, and the words themselves decide."""
from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import cut, keep, table

#: symbols that letters are hashed to. Fewer give smaller neighbourhoods and more words a reduced word
SYMBOLS = 6
#: a form occurs at least so many times as often as its word
DOMINANCE = 5
#: a run of letters; only A-Z change case
RUN = r"[A-Za-zÀ-ÿ]"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: neighbours that are held at a time
AT_ONCE = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_SYMBOL = np.array([zlib.crc32(chr(c).encode()) % SYMBOLS for c in range(0x100)], np.uint64)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _named(h: np.ndarray, length: int) -> np.ndarray:
    return _mix(h + np.uint64(length * 0xD6E8FEB86659FD93 % (1 << 64))).view(np.int64)


def reduced(words: list[str]) -> np.ndarray:
    """Words of one length -> a row of symbols (1 .. SYMBOLS) for each."""
    code = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(words), -1)
    return np.where(code < 0x100, _SYMBOL[np.minimum(code, 0xFF)], code % SYMBOLS).astype(np.uint64) + np.uint64(1)


def _powers(n: int) -> np.ndarray:
    return np.cumprod(np.r_[np.uint64(1), np.full(n, _BASE, np.uint64)])


def names(sym: np.ndarray) -> np.ndarray:
    """One 64-bit name for each row of symbols: a sum of symbol times power of the place, mixed with the length."""
    return _named((sym * _powers(sym.shape[1])[:-1]).sum(1, dtype=np.uint64), sym.shape[1])


def neighbours(sym: np.ndarray, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
    """Names of the reduced words one edit away whose edit stands at a place in [lo, hi), and the row each belongs to.

    Of equal results of one row only one is given: a run of equal symbols loses its first, and a symbol is not put before its equal.
    Prefix sums give every name from the sums left and right of the place."""
    m, n = sym.shape
    power = _powers(n)
    left = np.concatenate([np.zeros((m, 1), np.uint64), np.cumsum(sym * power[:-1], 1, dtype=np.uint64)], 1)
    right = left[:, -1:] - left
    out, rows = [], []

    def add(h: np.ndarray, length: int, where: np.ndarray) -> None:
        r, c = np.nonzero(where)
        out.append(_named(h[r, c], length))
        rows.append(r)

    at = slice(lo, min(hi, n))
    places = np.arange(n + 1)
    if at.start < at.stop:
        first = np.ones((m, n), bool)
        first[:, 1:] = sym[:, 1:] != sym[:, :-1]
        add((left[:, :-1] + right[:, 1:] * np.uint64(_INVERSE))[:, at], n - 1, first[:, at])
    for s in range(1, SYMBOLS + 1):
        if at.start < at.stop:
            add((left[:, -1:] + (np.uint64(s) - sym) * power[:-1])[:, at], n, (sym != s)[:, at])
        put = slice(lo, min(hi, n + 1))
        free = np.ones((m, n + 1), bool)
        free[:, :-1] = sym != s
        add((left + np.uint64(s) * power + right * np.uint64(_BASE))[:, places[put]], n + 1, free[:, put])
    return np.concatenate(out), np.concatenate(rows)


def _by_length(words: list[str]) -> Iterator[list[int]]:
    size = np.fromiter(map(len, words), np.int64, len(words))
    for n in np.unique(size).tolist():
        rows = np.flatnonzero(size == n).tolist()
        step = max(1, AT_ONCE // (2 * SYMBOLS * max(n, 1)))
        yield from (rows[i:i + step] for i in range(0, len(rows), step))


def _classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """word, n -> word, n, class (name of the reduced word)."""
    for b in batches:
        ws = b.column(0).to_pylist()
        got = np.zeros(len(ws), np.int64)
        for rows in _by_length(ws):
            got[rows] = names(reduced([ws[i] for i in rows]))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(got)], names=["word", "n", "class"])


def _neighbourhoods(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """word, class -> key (name of a reduced word within one edit, its own included), class."""
    for b in batches:
        ws, own = b.column(0).to_pylist(), b.column(1).to_numpy()
        yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(own)], names=["key", "class"])
        for rows in _by_length(ws):
            sym, mine = reduced([ws[i] for i in rows]), own[rows]
            step = max(1, AT_ONCE // (2 * SYMBOLS))
            for lo in range(0, sym.shape[1] + 1, step):
                key, row = neighbours(sym, lo, lo + step)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(mine[row])], names=["key", "class"])


def near_words(vocabulary: DataFrame) -> DataFrame:
    """word, n (each word once) -> word, n, other, other_n for every two words that differ by exactly one inserted, deleted or replaced
    code point, in both directions.

    Words within one edit have reduced words within one edit, so no pair is lost. Neighbourhoods are made once a reduced word; classes
    that meet are joined to their words, each unordered pair once, and verified on the words. No class is gathered.
    """
    words = keep(vocabulary.mapInArrow(_classes, "word string, n bigint, class bigint"))
    one = words.groupBy("class").agg(F.min("word").alias("word")).select("word", "class")
    met = one.mapInArrow(_neighbourhoods, "key bigint, class bigint").join(one.select(F.col("class").alias("key")), "key")
    met = met.where(F.col("class") <= F.col("key")).distinct()
    a = words.select(F.col("word").alias("a"), F.col("n").alias("a_n"), "class")
    b = words.select(F.col("word").alias("b"), F.col("n").alias("b_n"), F.col("class").alias("key"))
    pairs = met.join(a, "class").join(b, "key").where((F.col("class") < F.col("key")) | (F.col("a") < F.col("b")))
    pairs = keep(pairs.where(F.levenshtein("a", "b", 1) == 1).select("a", "a_n", "b", "b_n"))
    back = pairs.select(F.col("b").alias("a"), F.col("b_n").alias("a_n"), F.col("a").alias("b"), F.col("a_n").alias("b_n"))
    return pairs.union(back).toDF("word", "n", "other", "other_n")


def variant_groups(vocabulary: DataFrame, dominance: int = DOMINANCE) -> DataFrame:
    """word, form, root, n, n_near, form_n for every row of a vocabulary (word, n).

    ``form``: the near word of largest n (ties: smallest by code points) if that n is at least ``dominance`` times the word's; else null.
    ``root``: the last word reached by following forms, the word itself without one. n grows by that factor at every step, so paths are
    short; they are halved until none is left. Words that repeat in the vocabulary count as one, their n added; null words are left out.
    """
    if dominance < 2:
        raise ValueError("a form must occur more often than its word, else paths may not end")
    vocabulary = keep(vocabulary.where("word IS NOT NULL").groupBy("word").agg(F.sum("n").cast("bigint").alias("n")))
    best = F.min(F.struct((-F.col("other_n")).alias("m"), F.col("other").alias("w")))
    near = near_words(vocabulary).groupBy("word", "n").agg(F.count("*").alias("n_near"), best.alias("best"))
    strong = -F.col("best.m") >= F.col("n") * dominance
    near = keep(near.select("word", "n_near", F.when(strong, F.col("best.w")).alias("form"), F.when(strong, -F.col("best.m")).alias("form_n")))
    up = cut(near.where("form IS NOT NULL").select("word", F.col("form").alias("root")))
    while True:
        far = up.select(F.col("word").alias("root"), F.col("root").alias("next"))
        up = cut(up.join(far, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        if up.where("moved").isEmpty():
            break
        up = up.drop("moved")
    out = vocabulary.join(near, "word", "left").join(up.select("word", "root"), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), "form_n")


def vocabulary(docs: DataFrame, word: Column | None = None, shortest: int = 6, least: int = 5) -> DataFrame:
    """word, n: lower-cased runs of letters of at least ``shortest`` code points that occur at least ``least`` times in all texts.

    Counts are summed before the shuffle. Texts that are null, empty or without letters add nothing; repeated rows count each time.
    ``word`` changes a run (column ``run``, next to ``doc_id``) before it is counted.
    """
    runs = docs.select("doc_id", F.explode(F.regexp_extract_all(F.translate(F.col("text").cast("string"), _UPPER, _LOWER), F.lit(f"({RUN}{{{shortest},}})"), 1)).alias("run"))
    words = runs.select((F.col("run") if word is None else word).alias("word")).where(F.char_length("word") >= shortest)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def misspelt() -> Column:
    """A run as it stands, or, where 199 divides the crc32 of ``<doc_id>:<run>``, without its code point at crc32 modulo length. A null
    doc_id is written as nothing."""
    h = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("run")).cast("binary"))
    at = F.pmod(h, F.char_length("run")).cast("int")
    less = F.concat(F.substr("run", F.lit(1), at), F.substr("run", at + 2))
    return F.when(F.pmod(h, F.lit(199)) == 0, less).otherwise(F.col("run"))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """word, form, root, n, n_near, form_n over the words of whole texts, one in 199 of them misspelt by its hash."""
    return variant_groups(vocabulary(table(spark, sf_dir, "documents"), misspelt()))
