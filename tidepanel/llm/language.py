"""Language identification: averaged embeddings of hashed subwords and a linear softmax, trained by stochastic gradient descent."""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import crc_mod, table

BUCKETS = 1 << 14
SIZES = (1, 2, 3, 4)
#: code points hashed at a time
CHUNK = 1 << 16
_letter = np.zeros(0, bool)


def _letters() -> np.ndarray:
    global _letter
    if not len(_letter):
        _letter = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _letter


def subwords(text: str | None) -> tuple[np.ndarray, int]:
    """Counts of hashed subwords of one to four characters, over the whole text, and their number. Runs of anything but letters
    become one mark; an empty count where there is no letter. Only hashing is cut into pieces, with the overlap they need."""
    counts = np.zeros(BUCKETS, np.int64)
    c = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    alpha = _letters()[c] if len(c) else np.zeros(0, bool)
    if not alpha.any():
        return counts, 0
    c = np.where(alpha, c, 0)
    c = np.concatenate([[0], c[np.r_[True, (c[1:] != 0) | (c[:-1] != 0)]], [0]]).astype(np.uint32)
    c = c[1:] if c[1] == 0 else c
    c = c[:-1] if c[-2] == 0 else c
    for at in range(0, len(c), CHUNK):
        h = np.full(min(CHUNK, len(c) - at), 2166136261, np.uint32)
        for k in range(SIZES[-1]):
            part = c[at + k:at + k + CHUNK]
            h = (h[:len(part)] ^ part) * np.uint32(16777619)
            h ^= h >> np.uint32(15)
            if k + 1 in SIZES:
                counts += np.bincount((h * np.uint32(2654435769)) >> np.uint32(18), minlength=BUCKETS)
    return counts, int(counts.sum())


@dataclass
class Model:
    langs: list[str]
    table: np.ndarray            # embedding times output weights, by bucket: the average of rows is the logit
    bias: np.ndarray
    temperature: float = 1.0
    reject_below: float = 0.0

    def predict(self, text: str | None) -> tuple[str, float]:
        counts, n = subwords(text)
        if n == 0 or not self.langs:
            return "und", 0.0
        z = (counts @ self.table / n + self.bias) / self.temperature
        p = np.exp(z - z.max())
        k = int(p.argmax())
        return self.langs[k], float(p[k] / p.sum())


def sample(docs: DataFrame, per_lang: int) -> DataFrame:
    """At most ``per_lang`` learning rows of each language, first by a hash of the id."""
    rows = docs.where(F.col("lang").isNotNull() & (crc_mod(F.col("doc_id"), 3) != 1)).select("doc_id", "lang")
    order = Window.partitionBy("lang").orderBy(F.xxhash64(F.lit("language"), "doc_id"), "doc_id")
    some = rows.withColumn("k", F.row_number().over(order)).where(F.col("k") <= per_lang).select(F.col("doc_id").alias("__id")).distinct()
    return docs.where(F.col("lang").isNotNull()).join(F.broadcast(some), F.col("doc_id") == F.col("__id")).select("doc_id", "lang", "text")


def learn(docs: DataFrame, per_lang: int = 400, dim: int = 16, epochs: int = 6, seed: int = 7) -> Model:
    """Fit on at most ``per_lang`` rows a language (a documented bound). Each row gives its whole text and two short pieces, so short
    texts are known too. A fifth of the rows sets the temperature and the confidence below which one answer in a hundred would be
    accepted wrongly. No learning rows: a model that answers und."""
    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, langs, at, n = [], [], [], []
            for i, lang, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                t = t.as_py() or ""
                w = t.split()
                k = np.random.default_rng(i % (1 << 32)).integers(0, max(1, len(w)), 2)
                for part in (t, " ".join(w[k[0]:k[0] + 3]), " ".join(w[k[1]:k[1] + 12])):
                    c, total = subwords(part)
                    if total:
                        nz = np.flatnonzero(c)
                        ids.append(i), langs.append(lang), at.append(nz.astype(np.int32)), n.append((c[nz] / total).astype(np.float32))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(langs, pa.string()), pa.array(at, pa.list_(pa.int32())), pa.array(n, pa.list_(pa.float32()))], names=["doc_id", "lang", "at", "n"])

    got = sample(docs, per_lang).mapInArrow(pieces, "doc_id bigint, lang string, at array<int>, n array<float>").toArrow()
    langs = sorted(set(got["lang"].to_pylist()))
    if not langs:
        return Model([], np.zeros((BUCKETS, 0)), np.zeros(0))
    ids = got["doc_id"].to_numpy()
    order = np.lexsort((np.arange(len(ids)), ids))
    y = np.array([langs.index(x) for x in got["lang"].to_pylist()])[order]
    at = [got["at"][int(i)].values.to_numpy() for i in order]
    val = [got["n"][int(i)].values.to_numpy().astype(np.float64) for i in order]
    held = np.array([hash((int(i) * 2654435761) % 1000003) % 5 == 0 for i in ids[order]])
    rng = np.random.default_rng(seed)
    emb, out, bias = rng.normal(0, 0.1, (BUCKETS, dim)), rng.normal(0, 0.1, (dim, len(langs))), np.zeros(len(langs))
    fit = np.flatnonzero(~held) if (~held).any() else np.arange(len(y))
    for e in range(epochs):
        rate = 4.0 * (1 - e / epochs)
        for batch in np.array_split(rng.permutation(fit), max(1, len(fit) // 16)):
            size = np.array([len(at[i]) for i in batch])
            idx, v = np.concatenate([at[i] for i in batch]), np.concatenate([val[i] for i in batch])
            start = np.r_[0, np.cumsum(size)[:-1]]
            x = np.add.reduceat(emb[idx] * v[:, None], start)
            z = x @ out + bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(batch)), y[batch]] -= 1
            g = p / len(batch)
            gx = g @ out.T
            np.subtract.at(out, slice(None), rate * x.T @ g)
            bias -= rate * 0.1 * g.sum(0)
            np.subtract.at(emb, idx, rate * 16 * v[:, None] * np.repeat(gx, size, 0))
    model = Model(langs, emb @ out, bias)
    check = np.flatnonzero(held) if held.any() else fit
    z = np.array([val[i] @ model.table[at[i]] + bias for i in check])
    t = y[check]

    def loss(temp):
        q = z / temp
        q = q - q.max(1, keepdims=True)
        return float(np.mean(np.log(np.exp(q).sum(1)) - q[np.arange(len(t)), t]))

    model.temperature = min((0.25 * 1.15 ** k for k in range(25)), key=loss)
    p = np.exp((z - z.max(1, keepdims=True)) / model.temperature)
    conf, right = p.max(1) / p.sum(1), z.argmax(1) == t
    o = np.argsort(-conf)
    wrong = np.cumsum(~right[o]) / (np.arange(len(o)) + 1)
    good = np.flatnonzero(wrong <= 0.01)
    model.reject_below = float(conf[o[good[-1]]]) if len(good) else 1.0
    return model


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score, accepted of every row, in one pass. Texts that are null or have no letter: und, score 0, not
    accepted. ``accepted`` is false where the score is below the calibrated bound. Repeated rows stay, other columns are ignored."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [model.predict(t.as_py()) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64()), pa.array([g[0] != "und" and g[1] >= model.reject_below for g in got], pa.bool_())], names=["doc_id", "lang_pred", "score", "accepted"])

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(run, "doc_id bigint, lang_pred string, score double, accepted boolean")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = identify(docs, learn(docs))
    return out.select("doc_id", F.coalesce(crc_mod(F.col("doc_id"), 3) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score", "accepted")
