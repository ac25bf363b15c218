"""Near duplicates among vectors: spherical k-means assigns them to cells, blocked cosine products compare within cells, one vector of each
group is kept."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import keep, table
from .components import connected_components

#: vectors that a cell should hold, cells at most, bytes of all centres at most, passes of k-means
CELL, MOST_CELLS, CENTRE_BYTES, PASSES = 1024, 65_536, 64 << 20, 6
#: the model is fitted on so many vectors a cell, all in all no more than this times MOST_CELLS
FIT = 64
#: centres closer than this cosine become one: a crowd of near copies is one cell, cut into blocks, not many cells
MERGE = 0.8
#: a vector also visits every cell that it misses by no more than this times the distance of the two centres
SLACK = 0.1
#: vectors of a block; one task compares two blocks
BLOCK = 2048


def unit(column: pa.Array) -> np.ndarray:
    """Rows of directions in double precision, scaled by the largest component first, so that neither huge nor tiny vectors overflow."""
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def apart(centres: np.ndarray) -> np.ndarray:
    """The centres, first to last, less those within MERGE of one already taken."""
    taken = np.zeros((0, centres.shape[1]))
    for c in centres:
        if not len(taken) or (taken @ c).max() < MERGE:
            taken = np.vstack([taken, c])
    return taken


def fit_centres(vectors: DataFrame, dim: int, n: int, cell: int = CELL, passes: int = PASSES) -> np.ndarray:
    """Spherical k-means over the vectors (column v) of length ``dim``: about n / cell centres.

    Fitted on a sample that a hash of the vector picks: FIT for each centre, so bounded by FIT x MOST_CELLS. The sums of a pass are made in
    Spark; the driver holds the centres only, CENTRE_BYTES at most."""
    k = int(max(1, min(-(-n // cell), MOST_CELLS, CENTRE_BYTES // (8 * dim))))
    part = min(1.0, FIT * k / max(n, 1))
    sample = keep(vectors.where((F.size("v") == dim) & (F.pmod(F.xxhash64("v", F.lit("fit")), F.lit(1 << 20)) < int(part * (1 << 20)) + 1)).select("v"))
    first = sample.orderBy(F.xxhash64("v", F.lit("first")), "v").limit(4 * k).toArrow()["v"].combine_chunks()
    if not len(first):
        return np.zeros((0, dim))
    centres = apart(unit(first))[:k]

    for _ in range(passes):
        def sums(batches: Iterator[pa.RecordBatch], centres=centres) -> Iterator[pa.RecordBatch]:
            total = np.zeros_like(centres)
            for b in batches:
                for i in range(0, len(b), BLOCK):
                    x = unit(b.column(0).slice(i, BLOCK))
                    np.add.at(total, (x @ centres.T).argmax(1), x)
            cell, at = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(at), pa.array(total[cell, at])], names=["cell", "at", "x"])

        got = sample.mapInArrow(sums, "cell bigint, at bigint, x double").groupBy("cell", "at").agg(F.sum("x").alias("x")).toArrow()
        total = np.zeros_like(centres)
        total[got["cell"].to_numpy(), got["at"].to_numpy()] = got["x"].to_numpy()
        norm = np.sqrt((total * total).sum(1))
        centres = apart(total[norm > 0] / norm[norm > 0, None])
    return centres


def visits(x: np.ndarray, centres: np.ndarray, gaps: np.ndarray, slack: float) -> tuple[np.ndarray, np.ndarray]:
    """Which cells each row visits (rows x cells), and its own cell."""
    s = x @ centres.T
    home, rows = s.argmax(1), np.arange(len(x))
    near = s >= s[rows, home][:, None] - slack * gaps[home]
    near[rows, home] = True
    return near, home


def assign(vectors: DataFrame, centres: np.ndarray, dim: int, slack: float) -> DataFrame:
    """node, copies, v -> node, copies, v, home, near (all cells that the vector visits), cell, dim: a row for each cell visited.

    Vectors of another length than ``dim`` lie in the one cell of their length."""
    gaps = np.sqrt(np.maximum(0, 2 - 2 * centres @ centres.T))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in (whole.slice(i, BLOCK) for i in range(0, len(whole), BLOCK)):
                near, home = visits(unit(b.column(2)), centres, gaps, slack)
                row, cell = np.nonzero(near)
                at, ends = pa.array(row), np.r_[0, np.cumsum(near.sum(1))]
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(cell, pa.int32()))
                yield pa.RecordBatch.from_arrays([*(c.take(at) for c in b.columns), pa.array(home[row], pa.int32()), lists.take(at), pa.array(cell, pa.int32())], names=["node", "copies", "v", "home", "near", "cell"])

    kind = vectors.schema["v"].dataType.simpleString()
    fits = vectors.where(F.size("v") == dim).mapInArrow(run, f"node bigint, copies bigint, v {kind}, home int, near array<int>, cell int")
    others = vectors.where(F.size("v") != dim).select("node", "copies", "v", F.lit(0).alias("home"), F.array(F.lit(0)).alias("near"), F.lit(0).alias("cell"))
    return fits.union(others).withColumn("dim", F.size("v"))


def forest(hit: np.ndarray, row: np.ndarray, col: np.ndarray) -> tuple[list[int], list[int]]:
    """A spanning forest of the links hit[i, j] between row[i] and col[j]; a dense block gives one link a vector, not all its pairs."""
    ids, place = np.unique(np.concatenate([row, col]), return_inverse=True)
    at, to = place[:len(row)], place[len(row):]
    group, a, b = np.arange(len(ids)), [], []
    for i in range(len(row)):
        reach = to[hit[i]]
        other = np.unique(group[reach])
        other = other[other != group[at[i]]]
        for g in other.tolist():
            a.append(int(row[i]))
            b.append(int(ids[reach[group[reach] == g][0]]))
        if len(other):
            group[np.isin(group, other)] = group[at[i]]
    return a, b


def _compare(least: float):
    """Function for applyInArrow over one tile: vectors at home in a cell (``left``) against vectors that visit it -> links (a, b) and counts
    (a, n). Each end of a link counts it at home; where the one at home here does not visit the other's home, the other counts it here."""
    def run(t: pa.Table) -> pa.Table:
        left = t["left"].combine_chunks()
        rows, cols = t.filter(left), t.filter(pc.invert(left))
        if not len(rows) or not len(cols):
            return pa.table({c: pa.array([], pa.int64()) for c in ("a", "b", "n")})
        node, other, of_row, of_col = rows["node"].to_numpy(), cols["node"].to_numpy(), rows["copies"].to_numpy(), cols["copies"].to_numpy()
        hit = unit(rows["v"].combine_chunks()) @ unit(cols["v"].combine_chunks()).T >= least
        hit &= node[:, None] != other[None, :]
        homes, at = np.unique(cols["home"].to_numpy(), return_inverse=True)
        near = rows["near"].combine_chunks()
        flat, of = near.flatten().to_numpy(), np.repeat(np.arange(len(node)), pc.list_value_length(near).to_numpy())
        place = np.minimum(np.searchsorted(homes, flat), len(homes) - 1)
        goes = np.zeros((len(node), len(homes)), bool)
        goes[of[homes[place] == flat], place[homes[place] == flat]] = True
        counts = np.concatenate([hit @ of_col, (hit & ~goes[:, at]).T @ of_row])
        whose = np.concatenate([node, other])
        a, b = forest(hit, node, other)
        some = np.flatnonzero(counts)
        return pa.table({"a": pa.array([*a, *whose[some].tolist()], pa.int64()), "b": pa.array([*b, *([None] * len(some))], pa.int64()),
                         "n": pa.array([*([None] * len(a)), *counts[some].tolist()], pa.int64())})

    return run


def links(vectors: DataFrame, least: float, slack: float, cell: int = CELL, block: int = BLOCK) -> DataFrame:
    """Distinct vectors (node, copies, v) -> rows (a, b, null), enough links of cosine ``least`` or more to connect every group, and
    (a, null, n), parts of the number of other vectors that a links with, copies counted.

    Vectors at home in a cell are compared with all that visit it; a link is found if either end visits the other's cell. Cells are cut into blocks by a hash; each pair of blocks
    is a tile of bounded size for one task, so no cell, however full, is gathered."""
    sizes = vectors.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").first()
    if sizes is None:
        return vectors.select(F.col("node").alias("a"), F.col("node").alias("b"), F.col("copies").alias("n")).limit(0)
    centres = fit_centres(vectors, sizes["dim"], sizes["n"], cell)
    rows = keep(assign(vectors, centres, sizes["dim"], slack))
    cells = rows.groupBy("dim", "cell").agg(F.ceil(F.count_if(F.col("home") == F.col("cell")) / F.lit(block)).cast("int").alias("lefts"), F.ceil(F.count("*") / F.lit(block)).cast("int").alias("rights"))
    cells = cells.where("lefts > 0")
    to = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    at = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    both = rows.join(cells, ["dim", "cell"])
    left = both.where("home = cell").withColumns({"l": at("lefts"), "left": F.lit(True)}).withColumn("r", F.explode(to("rights")))
    right = both.withColumns({"r": at("rights"), "left": F.lit(False)}).withColumn("l", F.explode(to("lefts")))
    cols = ["dim", "cell", "l", "r", "left", "node", "copies", "v", "home", "near"]
    return left.select(*cols).union(right.select(*cols)).groupBy("dim", "cell", "l", "r").applyInArrow(_compare(least), "a bigint, b bigint, n bigint")


def near_vectors(vectors: DataFrame, ident: str = "vec_id", vector: str = "embedding", least: float = 0.9, slack: float = SLACK, cell: int = CELL) -> DataFrame:
    """One row per row of vectors: ``ident``, n_links (other rows linked directly), component_id (the smallest id reachable over links, the
    row included), kept (the id is the component's).

    A link is a cosine of ``least`` or more in double precision; no lower one links. Equal vectors are compared once and link with each
    other. ``slack`` decides how many cells a vector visits. With sqrt(2 - 2 * least) or more no link can be missed, whatever the data: two
    vectors that link lie no further apart. Smaller values trade recall for work (README has the recall of the default).

    Vectors that are null, empty, zero, or hold null or non-finite components link with nothing and stand for themselves; vectors of
    different length do not link. Rows that repeat are vectors of their own. Rows without id count as vectors; they get their group's
    component_id, null if no row of the group has an id, and are not kept. An empty table gives none.
    """
    x = F.col(vector)
    good = x.isNotNull() & F.coalesce(F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))), F.lit(False)) & F.coalesce(F.exists(x, lambda c: c != 0), F.lit(False))
    rows = vectors.select(F.col(ident).cast("bigint").alias("__id"), F.when(good, x).alias("v"))
    name = [F.xxhash64("v").alias("h1"), F.xxhash64(F.lit("second"), "v").alias("h2")]
    some = rows.where("v IS NOT NULL")
    distinct = some.groupBy("v").agg(F.count("*").alias("copies"), F.min("__id").alias("first_id"))
    distinct = keep(distinct.select(F.monotonically_increasing_id().alias("node"), "copies", "first_id", "v", *name))
    found = keep(links(distinct.select("node", "copies", "v"), least, slack, cell))
    counts = found.where("n IS NOT NULL").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
    roots = connected_components(found.where("b IS NOT NULL").select("a", "b"))
    member = distinct.select("node", "h1", "h2", "copies", "first_id").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    group = member.groupBy("root").agg(F.min("first_id").alias("component_id"))
    known = member.join(group, "root").join(counts, "node", "left").select("h1", "h2", "component_id", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    linked = some.select("__id", *name).join(known, ["h1", "h2"]).select("__id", "n_links", "component_id")
    alone = rows.where("v IS NULL").select("__id", F.lit(0).cast("bigint").alias("n_links"), F.col("__id").alias("component_id"))
    out = linked.union(alone)
    return out.select(F.col("__id").alias(ident), "n_links", "component_id", F.coalesce(F.col("__id") == F.col("component_id"), F.lit(False)).alias("kept"))


def drop_near_vectors(vectors: DataFrame, ident: str = "vec_id", vector: str = "embedding", least: float = 0.9, slack: float = SLACK) -> DataFrame:
    """The rows of vectors that stand for their groups, all columns as they are. Rows that repeat in id stay or go together; rows without id
    stay, as nothing can name them."""
    found = near_vectors(vectors, ident, vector, least, slack)
    gone = found.where(~F.col("kept")).select(F.col(ident).alias("__gone")).where("__gone IS NOT NULL").distinct()
    return vectors.join(gone, vectors[ident] == gone["__gone"], "left_anti")


def op11_embedding_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, n_links, component_id, kept over the whole table, links at a cosine of 0.9 or more."""
    return near_vectors(table(spark, sf_dir, "embeddings"))
