"""Near duplicates by SimHash: an inverted index over byte positions, a tally of shared bytes, and a check of the differing bits."""
from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import keep, shared_dir, table
from .components import connected_components

#: rows of one index entry that one task compares; longer entries are split into pairs of blocks
TILE = 20_000
#: bytes by which a wide fingerprint is indexed, and how many equal ones make a candidate
STEADY, STEADY_MATCHES = 12, 2
#: shingles whose bits are counted at a time
CHUNK = 1 << 15


def shingle_hashes(text: str | None, n: int) -> np.ndarray:
    """XXH64 (seed 42) of every run of n words, repeats included; of the whole sequence if it is shorter; none without a word."""
    from xxhash import xxh64_intdigest as h

    ws = (text or "").encode("utf-8", "surrogatepass").lower().split()   # bytes: only A-Z change case, only ASCII white space splits
    if len(ws) <= n:
        return np.array([h(b" ".join(ws), 42)] if ws else [], np.uint64)
    size = np.fromiter(map(len, ws), np.int64, len(ws))
    end = np.cumsum(size + 1) - 1
    begin, line = end - size, b" ".join(ws)
    return np.fromiter((h(line[a:b], 42) for a, b in zip(begin[:len(ws) - n + 1].tolist(), end[n - 1:].tolist())), np.uint64, len(ws) - n + 1)


def _spread(h: np.ndarray, word: int) -> np.ndarray:
    """Further 64 independent bits of each hash; word 0 is the hash itself."""
    if word == 0:
        return h
    h = h + np.uint64(word * 0x9E3779B97F4A7C15 % (1 << 64))
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _ones(h: np.ndarray) -> np.ndarray:
    """How often each of the 64 bits, highest first, is set. Blocks of 128 rows keep their counts in one byte."""
    total = np.zeros(64, np.int64)
    for i in range(0, len(h), CHUNK):
        bits = np.unpackbits(h[i:i + CHUNK].astype(">u8").view(np.uint8)).reshape(-1, 64)
        full = len(bits) // 128 * 128
        total += bits[:full].reshape(-1, 128, 64).sum(1, dtype=np.uint8).sum(0, dtype=np.int64) + bits[full:].sum(0, dtype=np.int64)
    return total


def fingerprint(text: str | None, n: int, parts: int) -> tuple[list[int], np.ndarray]:
    """``parts`` signed 64-bit words, a bit set if it is in over half of the shingle hashes; and the margin of every bit."""
    h = shingle_hashes(text, n)
    ones = np.concatenate([_ones(_spread(h, k)) for k in range(parts)])
    return np.packbits(ones * 2 > len(h)).view(">u8").astype(np.int64).tolist(), np.abs(ones * 2 - len(h))


def _steady(margin: np.ndarray) -> int:
    """The twelve bytes whose two weakest bits are surest, ascending, five bits for each position: edits hardly flip these."""
    weakest = np.sort(margin.reshape(-1, 8), 1)[:, :2].sum(1)
    top = np.sort(np.argsort(-weakest, kind="stable")[:STEADY])
    return sum(int(p) << 5 * (STEADY - 1 - i) for i, p in enumerate(top))


def fingerprints(docs: DataFrame, n: int = 4, parts: int = 1) -> DataFrame:
    """doc_id, f0 .. f{parts-1} and, for several parts, ``steady``. Null and empty texts get zero. Other columns are ignored."""
    names = [f"f{k}" for k in range(parts)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [fingerprint(t.as_py(), n, parts) for t in b.column(1)]
            cols = [b.column(0), *(pa.array([r[0][k] for r in rows], pa.int64()) for k in range(parts))]
            if parts > 1:
                cols.append(pa.array([_steady(r[1]) for r in rows], pa.int64()))
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", *names] + ["steady"] * (parts > 1))

    schema = "doc_id bigint, " + ", ".join(f"{c} bigint" for c in names) + (", steady bigint" if parts > 1 else "")
    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(run, schema)


def covering_triples(min_matches: int) -> list[tuple[int, int, int]]:
    """Triples of the 8 byte positions of which any ``min_matches`` equal positions contain one.

    For four or more matches 20 triples do: with the positions cut into three circular parts, those inside a part and those with
    two positions in one part and one in the next. For three matches all 56 are needed; fewer cannot be served by triples.
    """
    if min_matches < 3:
        raise ValueError("fewer than three guaranteed equal bytes: index wider fingerprints instead")
    part = [0, 0, 0, 1, 1, 1, 2, 2]
    every = list(combinations(range(8), 3))
    if min_matches == 3:
        return every
    kinds = {tuple(sorted(x)) for p in range(3) for x in ((p, p, p), (p, p, (p + 1) % 3))}
    return [t for t in every if tuple(sorted(part[i] for i in t)) in kinds]


def index_rows(prints: DataFrame, parts: int, min_matches: int) -> DataFrame:
    """Index entries (key, fingerprint): one per set of byte positions, the key holding positions and byte values.

    A fingerprint of one word is entered under triples of all its bytes, a wider one under pairs of its steadiest bytes."""
    names = [f"f{k}" for k in range(parts)]
    sets = np.array(covering_triples(min_matches) if parts == 1 else list(combinations(range(STEADY), min_matches)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in (whole.slice(i, 2000) for i in range(0, len(whole), 2000)):
                f = np.stack([b.column(k).to_numpy() for k in range(parts)], 1)
                byte = f.astype(">i8").view(np.uint8).reshape(len(f), -1).astype(np.int64)
                at = np.broadcast_to(np.arange(8), (len(f), 8)) if parts == 1 else (b.column(parts).to_numpy()[:, None] >> np.arange(5 * STEADY - 5, -1, -5)) & 31
                key = np.zeros((len(f), len(sets)), np.int64)
                for col in sets.T:
                    pos = at[:, col]
                    key = (key << 16) | (pos << 8) | np.take_along_axis(byte, pos, 1)
                yield pa.RecordBatch.from_arrays([pa.array(key.ravel()), *(pa.array(np.repeat(f[:, k], len(sets))) for k in range(parts))], names=["key", *names])

    return prints.mapInArrow(run, "key bigint, " + ", ".join(f"{c} bigint" for c in names))


def linked(f: np.ndarray, max_bits: int, min_matches: int) -> tuple[list[int], list[int]]:
    """A spanning forest of the links among rows of f. Rows once reached are not compared again, so a dense group costs little
    more than one comparison a row and gives one link a row, while no connection is lost."""
    rest, a, b = np.arange(len(f)), [], []
    while len(rest) > 1:
        todo, rest = [int(rest[0])], rest[1:]
        while todo and len(rest):
            i = todo.pop()
            x = f[rest] ^ f[i]
            hit = (x.view(np.uint8).reshape(len(x), -1) == 0).sum(1) >= min_matches       # tally of equal positional bytes
            hit[hit] = np.bitwise_count(x[hit]).sum(1, dtype=np.int64) <= max_bits        # verify
            if hit.any():
                new = rest[hit].tolist()
                a += [i] * len(new)
                b += new
                todo += new
                rest = rest[~hit]
    return a, b


def _link_runs(parts: int, max_bits: int, min_matches: int, limit: int | None):
    """Function for mapInArrow over rows sorted by their leading columns: links inside each run of equal keys, and the rows of runs
    longer than ``limit`` unchanged for a second pass."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(a, b, key, f):
            n = len(a) + len(f)
            cols = [np.concatenate([a, np.zeros(len(f), np.int64)]), np.concatenate([b, np.zeros(len(f), np.int64)]),
                    np.concatenate([np.zeros(len(a), np.int64), np.full(len(f), key or 0, np.int64)])]
            cols += [np.concatenate([np.zeros(len(a), np.int64), f[:, k].view(np.int64)]) for k in range(parts)]
            mask = np.arange(n) >= len(a)
            return pa.RecordBatch.from_arrays([pa.array(c) for c in cols] + [pa.array(mask)], names=["a", "b", "key", *(f"f{k}" for k in range(parts)), "long"])

        def node(f):
            return f[:, 0].view(np.int64) if parts == 1 else _fold(f)

        none = np.zeros(0, np.int64)
        nof = np.zeros((0, parts), np.uint64)
        held, held_key, passing = [], None, False

        def close():
            nonlocal held
            f = np.concatenate(held) if held else nof
            held = []
            if len(f) < 2:
                return none, none
            i, j = linked(f, max_bits, min_matches)
            v = node(f)
            return v[i], v[j]

        for b in batches:
            k = b.column(0).to_numpy()
            if len(k) == 0:
                continue
            f = np.stack([b.column(1 + c).to_numpy() for c in range(parts)], 1).view(np.uint64)
            start = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
            stop = np.r_[start[1:], len(k)]
            ea, eb = [], []
            # whole runs inside the batch: single rows need nothing, pairs are compared at once
            inner = slice(1, -1)
            two = start[inner][(stop - start)[inner] == 2]
            if len(two):
                x = f[two] ^ f[two + 1]
                hit = (x.view(np.uint8).reshape(len(x), -1) == 0).sum(1) >= min_matches
                hit &= np.bitwise_count(x).sum(1, dtype=np.int64) <= max_bits
                v = node(f)
                ea.append(v[two[hit]])
                eb.append(v[two[hit] + 1])
            size = stop - start
            edge = np.zeros(len(size), bool)
            edge[0] = edge[-1] = True
            for r in np.flatnonzero(edge | (size > 2)):
                s, e = int(start[r]), int(stop[r])
                if held_key is None or k[s] != held_key:
                    x, y = close()
                    ea.append(x)
                    eb.append(y)
                    held_key, passing = int(k[s]), False
                held.append(f[s:e])
                if limit and (passing or sum(map(len, held)) > limit):
                    passing = True
                    yield out(none, none, held_key, np.concatenate(held))
                    held = []
                elif not edge[r]:
                    x, y = close()
                    ea.append(x)
                    eb.append(y)
            if ea:
                yield out(np.concatenate(ea), np.concatenate(eb), None, nof)
        x, y = close()
        yield out(x, y, None, nof)

    return run, "a bigint, b bigint, key bigint, " + ", ".join(f"f{k} bigint" for k in range(parts)) + ", long boolean"


def _fold(f: np.ndarray) -> np.ndarray:
    """One 64-bit name for a fingerprint of several words."""
    x = np.zeros(len(f), np.uint64)
    for k in range(f.shape[1]):
        x = _spread(x ^ f[:, k], k + 1)
    return x.view(np.int64)


def links(prints: DataFrame, parts: int, max_bits: int) -> DataFrame:
    """Edges (a, b) between names of distinct fingerprints that differ in at most ``max_bits`` bits, enough of them to connect
    every group: candidates are fingerprints that share an index entry, links are decided by tally and bit count."""
    names = [f"f{k}" for k in range(parts)]
    least = 8 - max_bits if parts == 1 else STEADY_MATCHES
    shared_dir(prints.sparkSession)
    run, schema = _link_runs(parts, max_bits, least, TILE)
    first = keep(index_rows(prints, parts, least).repartition("key").sortWithinPartitions("key").mapInArrow(run, schema))
    edges = first.where("not long and a <> b").select("a", "b")
    over = first.where("long").select("key", *names)
    count = over.groupBy("key").agg(F.ceil(F.count("*") * 2 / F.lit(TILE)).cast("int").alias("blocks"))
    mine = F.pmod(F.xxhash64(*names), F.col("blocks")).cast("int")
    tiles = over.join(count, "key").withColumn("mine", mine).select(
        "*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")).select(
        F.xxhash64("key", F.least("mine", "other"), F.greatest("mine", "other")).alias("tile"), *names)
    run, schema = _link_runs(parts, max_bits, least, None)
    more = tiles.repartition("tile").sortWithinPartitions("tile").mapInArrow(run, schema).where("a <> b").select("a", "b")
    return edges.union(more)


def near_duplicates(docs: DataFrame, n: int = 4, parts: int = 1, max_bits: int = 4) -> DataFrame:
    """One row per row of docs: doc_id, f0 .. , component_id (the smallest doc_id reachable over links, the document included).

    Links join fingerprints of ``64 * parts`` bits that differ in at most ``max_bits``. With one part any such pair shares at least
    ``8 - max_bits`` positional bytes, so the index misses none. Wider fingerprints link similar texts further apart; they are
    indexed by pairs of their twelve steadiest bytes, which finds nearly all (README has the recall).
    Null, empty and blank texts have fingerprint zero and link like any other. Rows with a null doc_id get their group's
    component_id, null if no row of the group has an id. Repeated rows stay.
    """
    names = [f"f{k}" for k in range(parts)]
    all_ = keep(fingerprints(docs, n, parts))
    distinct = all_.groupBy(*names).agg(F.min("doc_id").alias("first_id"), *([F.min("steady").alias("steady")] if parts > 1 else []))
    distinct = keep(distinct)
    roots = connected_components(links(distinct.select(*names, *(["steady"] if parts > 1 else [])), parts, max_bits))
    if parts == 1:
        named = distinct.withColumn("node", F.col("f0"))
    else:
        def fold(batches):
            for b in batches:
                f = np.stack([b.column(k).to_numpy() for k in range(parts)], 1).view(np.uint64)
                yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(parts)), b.column(parts), pa.array(_fold(f))], names=[*names, "first_id", "node"])
        named = distinct.select(*names, "first_id").mapInArrow(fold, ", ".join(f"{c} bigint" for c in names) + ", first_id bigint, node bigint")
    member = named.join(roots, "node").select(*names, "first_id", "root")
    group = member.groupBy("root").agg(F.min("first_id").alias("group_id"))
    member = member.join(group, "root").select(*names, "group_id")
    ids = distinct.join(member, names, "left").select(*names, F.coalesce("group_id", "first_id").alias("component_id"))
    return all_.join(ids, names).select("doc_id", *names, "component_id")


def op1_simhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id over the whole table: four-word shingles, links at four bits or fewer."""
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("f0")), 16, "0").alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, n: int = 5, least: float = 0.8) -> DataFrame:
    """The rows of docs without those that have an earlier near copy: one row of every group stays, the one with the least doc_id (and of
    several texts under that id, the one with the least hash).

    Near copies have ``least`` or more of their n-word shingles in common, which is counted on the shingles of every candidate pair.
    Different texts under one doc_id are decided apart. Of rows equal in doc_id and text one stays; rows without doc_id stay, as nothing
    can name them. Columns and their names are not changed.
    """
    from .jaccard import similar_groups

    found = keep(similar_groups(docs, n, least).where("doc_id IS NOT NULL"))
    best = found.groupBy("group").agg(F.min(F.struct("doc_id", "mark")).alias("best")).select("best.*")
    stay = found.groupBy("doc_id", "mark").agg((F.count("*") > 1).alias("__again")).join(best, ["doc_id", "mark"])
    stay = stay.select(F.col("doc_id").alias("__id"), F.col("mark").alias("__mark"), "__again")
    # only rows that repeat meet once more
    kept = docs.join(stay, (docs["doc_id"].cast("bigint") == stay["__id"]) & (F.xxhash64(docs["text"].cast("string")) == stay["__mark"]))
    once, again = kept.where("NOT __again"), kept.where("__again").dropDuplicates(["__id", "__mark"])
    return once.union(again).drop("__id", "__mark", "__again").union(docs.where(F.col("doc_id").isNull()))
