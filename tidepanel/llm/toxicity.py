"""Toxicity by a weighted lexicon: texts are folded (look-alike letters, digits for letters), matched with Aho-Corasick, exception
phrases are taken out, and the weight is normalised by length."""
from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import crc_mod, table

#: Letters of other scripts that look like Latin ones.
LOOKALIKE = {
    "а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x",
    "і": "i", "ї": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "ԛ": "q", "ԝ": "w", "һ": "h", "ӏ": "l",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x",
    "ı": "i", "ɑ": "a", "ɡ": "g", "ɩ": "i", "ʟ": "l",
}
#: Digits and signs written for letters.
STANDIN = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "|": "l", "€": "e"}
FOLD = str.maketrans(LOOKALIKE | STANDIN | {c: None for c in "­​‌‍⁠﻿"})
SPLIT = re.compile(r"[\W_]+")
#: Signs between letters are stand-ins ("lo$er"); at the edge of a word they are punctuation ("no!").
EDGE = re.compile(r"(?<!\w)[@$!|€]+|[@$!|€]+(?!\w)")


def fold(text: str | None) -> str:
    """Words in one case and script, one blank before, between and after; a single blank for null or wordless texts."""
    t = text or ""
    if not t.isascii():
        t = unicodedata.normalize("NFKC", t)
    t = EDGE.sub(" ", t.lower()).translate(FOLD)
    return f" {SPLIT.sub(' ', t).strip()} ".replace("  ", " ")


def stems(word: str) -> list[str]:
    """What the lexicon may hold of a word: its beginnings of four to eight letters, and the word itself closed by a blank."""
    return [" " + word[:k] for k in range(4, min(8, len(word)) + 1)] + [f" {word} "]


@dataclass
class Lexicon:
    weight: dict[str, float] = field(default_factory=dict)      # " stem" or " word " -> weight
    exceptions: tuple[str, ...] = ()                            # folded phrases in which hits do not count
    coef: tuple[float, float, float] = (0.0, 0.0, 0.0)          # base, by weight, by weight per hundred words
    base: float = 0.0

    def automaton(self):
        import ahocorasick
        a = ahocorasick.Automaton()
        for t, w in self.weight.items():
            a.add_word(t, (len(t), w))
        for p in self.exceptions:
            p = fold(p)
            if p.strip():
                a.add_word(p, (len(p), None))
        if len(a):
            a.make_automaton()
        return a

    def mass(self, a, folded: str) -> float:
        """Weights of the heaviest hit at every place, without those inside an exception phrase."""
        if not len(a):
            return 0.0
        best, spared = {}, []
        for end, (n, w) in a.iter(folded):
            at = end - n + 1
            if w is None:
                spared.append((at, end))
            else:
                best[at] = max(best.get(at, 0.0), w)
        if spared:
            best = {p: w for p, w in best.items() if not any(s <= p < e for s, e in spared)}
        return sum(best.values())

    def score(self, mass: float, n_words: int) -> float:
        if not self.weight:
            return self.base
        x = features(mass, n_words)
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, float(np.dot(self.coef, x))))))


def features(mass: float, n_words: int) -> tuple[float, float, float]:
    return 1.0, math.log1p(mass), math.log1p(100 * mass / (n_words + 20))


def labelled_sample(docs: DataFrame, labels: DataFrame, per_class: int) -> tuple[DataFrame, float]:
    """At most ``per_class`` learning rows of either class, first by a hash of the id; and the share of toxic rows of all learning labels."""
    rows = labels.where(F.col("toxic").isNotNull() & (crc_mod(F.col("doc_id"), 4) != 2)).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    share = rows.agg(F.avg((F.col("toxic") > 0).cast("double"))).first()[0] or 0.0
    pick = lambda c: rows.where(c).orderBy(F.xxhash64(F.lit("toxicity"), "doc_id"), "doc_id").limit(per_class)
    some = pick("toxic > 0").union(pick("toxic = 0")).select(F.col("doc_id").alias("__id"), F.col("toxic").alias("__toxic"))
    # at most 2 * per_class ids: bounded by the parameter, so they may be broadcast
    return docs.select("doc_id", "text").join(F.broadcast(some), F.col("doc_id") == F.col("__id")).select("text", F.col("__toxic").alias("toxic")), share


def learn(docs: DataFrame, labels: DataFrame, per_class: int = 4000, max_terms: int = 5000, exceptions: tuple[str, ...] = ()) -> Lexicon:
    """Weights from a sample of labelled rows bounded by ``per_class`` rows a class; term counts are summed in Spark.

    A term's weight is its smoothed log ratio between the classes; it needs at least five toxic texts, weight 3 and a difference of
    six standard errors between the shares of texts that hold it, or weight 1.5 and fifteen. A beginning that says as much as the words that start with it replaces them. Phrases of a hit and a neighbour that
    occur only in clean texts (five or more) become exceptions. Without labels the lexicon is empty and all scores are zero.
    """
    sample, share = labelled_sample(docs, labels, per_class)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen: dict[int, Counter] = {0: Counter(), 1: Counter()}
            for t, y in zip(b.column(0), b.column(1).to_pylist()):
                seen[int(y > 0)].update({s for w in set(fold(t.as_py()).split()) for s in stems(w)} | {""})
            terms = list(seen[0].keys() | seen[1].keys())
            yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), *(pa.array([seen[y][t] for t in terms], pa.int64()) for y in (0, 1))], names=["term", "clean", "toxic"])

    total = sample.mapInArrow(count, "term string, clean bigint, toxic bigint").groupBy("term").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    from .common import keep
    total = keep(total)
    n = total.where("term = ''").first()
    if n is None or not n["toxic"]:
        return Lexicon(base=0.0)
    a, b = F.col("toxic") + 0.5, F.col("clean") + 0.5
    weight = F.log(a / F.lit(n["toxic"] + 1.0)) - F.log(b / F.lit(n["clean"] + 1.0))
    both = (F.col("toxic") + F.col("clean")) / F.lit(float(n["toxic"] + n["clean"]))
    error = F.sqrt(both * (1 - both) * F.lit(1 / n["toxic"] + 1 / max(n["clean"], 1)))
    apart = (F.col("toxic") / F.lit(n["toxic"]) - F.col("clean") / F.lit(max(n["clean"], 1))) / F.greatest(error, F.lit(1e-12))
    picked = total.where("term <> '' and toxic >= 5").withColumn("w", weight).withColumn("z", apart).where("(w >= 3 and z >= 6) or (w >= 1.5 and z >= 15)")
    found = {r["term"]: r["w"] for r in picked.orderBy(F.desc("z"), "term").limit(max_terms).collect()}
    lex = Lexicon({t: w for t, w in found.items() if not any(found.get(t[:k], -9.0) >= w - 0.7 for k in range(5, len(t)))}, tuple(exceptions))

    def phrases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = lex.automaton()
        for batch in batches:
            seen: dict[int, Counter] = {0: Counter(), 1: Counter()}
            for t, y in zip(batch.column(0), batch.column(1).to_pylist()):
                f = fold(t.as_py())
                here = set()
                for end, (k, w) in (auto.iter(f) if len(auto) else ()):
                    if w is not None:
                        at = end - k + 1
                        stop = f.index(" ", at + 1)
                        before, after = f.rfind(" ", 0, at), f.find(" ", stop + 1)
                        here |= {f[before:stop + 1]} if before >= 0 else set()
                        here |= {f[at:after + 1]} if after > 0 else set()
                seen[int(y > 0)].update(here)
            terms = list(seen[0].keys() | seen[1].keys())
            yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), *(pa.array([seen[y][t] for t in terms], pa.int64()) for y in (0, 1))], names=["term", "clean", "toxic"])

    spared = sample.mapInArrow(phrases, "term string, clean bigint, toxic bigint").groupBy("term").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    lex.exceptions += tuple(sorted(r["term"].strip() for r in spared.where("clean >= 5 and toxic = 0").orderBy(F.desc("clean"), "term").limit(max_terms).collect()))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = lex.automaton()
        for batch in batches:
            folded = [fold(t.as_py()) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array([lex.mass(auto, f) for f in folded], pa.float64()), pa.array([f.count(" ") - 1 for f in folded], pa.int64()), batch.column(1).cast(pa.int32())], names=["mass", "n", "y"])

    rows = sample.mapInArrow(measure, "mass double, n bigint, y int").collect()      # 2 * per_class rows of three numbers
    x = np.array([features(r["mass"], r["n"]) for r in rows])
    y = np.array([float(r["y"] > 0) for r in rows])
    # both classes count as in all learning labels
    w = np.where(y > 0, share / max(y.mean(), 1e-9), (1 - share) / max(1 - y.mean(), 1e-9))
    lex.coef, lex.base = tuple(logistic(x, y, w)), share
    return lex


def logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float = 0.5, rounds: int = 40) -> list[float]:
    """Weighted ridge logistic regression by Newton's method; the base is not shrunk."""
    c = np.zeros(x.shape[1])
    pen = np.diag([0.0] + [ridge] * (x.shape[1] - 1))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ c, -30, 30)))
        step = np.linalg.solve((x * (w * p * (1 - p))[:, None]).T @ x + pen + 1e-6 * np.eye(len(c)), x.T @ (w * (y - p)) - pen @ c)
        c = c + np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-8:
            break
    return c.tolist()


def score(docs: DataFrame, lexicon: Lexicon, threshold: float = 0.3) -> DataFrame:
    """doc_id, score, predicted, mass (weight matched) and n_words of every row, in one pass without a shuffle.

    Null, empty and wordless texts match nothing and get the score of such texts. Repeated rows and rows without doc_id are scored
    like any other; other columns are ignored.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = lexicon.automaton()
        for b in batches:
            folded = [fold(t.as_py()) for t in b.column(1)]
            mass = [lexicon.mass(auto, f) for f in folded]
            n = [f.count(" ") - 1 if f != " " else 0 for f in folded]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([lexicon.score(m, k) for m, k in zip(mass, n)], pa.float64()), pa.array(mass, pa.float64()), pa.array(n, pa.int64())], names=["doc_id", "score", "mass", "n_words"])

    out = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(run, "doc_id bigint, score double, mass double, n_words bigint")
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = score(docs, learn(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", F.coalesce(crc_mod(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out"), "score", "predicted", "mass", "n_words")


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The rows of docs whose text scores below the threshold, columns unchanged. The score is computed beside the row, so nothing is shuffled."""
    lexicon = learn(docs, labels)

    def passes(batches):
        auto = lexicon.automaton()
        for b in batches:
            at = b.schema.names.index("text")
            folded = [fold(t.as_py()) for t in b.column(at)]
            yield b.filter(pa.array([lexicon.score(lexicon.mass(auto, f), max(f.count(" ") - 1, 0)) < threshold for f in folded], pa.bool_()))

    return docs.mapInArrow(passes, docs.schema)
