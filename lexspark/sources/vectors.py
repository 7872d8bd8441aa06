"""A vector index in cells: stored as Parquet, searched in few cells or exactly.

Centroids are fitted on a bounded sample of vectors (the rows whose ids have the least
hashes); every row is stored with its vector, in the folder of its nearest centroid. A
search multiplies a query only with the cells it asks for, so the folder names prune what
is read. Which cells: the nearest few, or, for exact results, those few and then all cells
that a bound can't rule out. A vector of cell c is no farther from its centroid than the
cell's radius, so no inner product in it passes q.c + |q| * radius.

Few queries go out with the tasks and vectors stay where they are. More meet their cells in
a cogroup, where a cell with many vectors or many queries is dealt over several groups; the
size of a group is bounded on both sides.

Defined results: a row without a vector is stored in cell -1 and never found; equal scores
rank by id; an empty table makes an index that answers nothing; a query without a vector
has no hits; all columns are kept.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from lexspark.operators.retrieval import DIGITS, SLICE_SCORES, top_k
from lexspark.tables import stored

#: Vectors that the centroids are fitted on, at most; and cells, at most.
SAMPLE, MOST_CELLS = 16384, 4096
FIT_ROUNDS = 8
#: Queries up to which they go out with the tasks; beyond, rows of a group in a cogroup.
FEW_QUERIES, GROUP_VECTORS, GROUP_QUERIES = 1000, 20_000, 5000
#: What rounding may do to a bound.
SLACK = 1e-5
NO_CELL = -1


@dataclass(frozen=True)
class VectorIndex:
    """An open index. centroids and radius have a row for each cell; counts are what cells hold."""

    rows: DataFrame
    id: str
    vector: str
    model: str
    query_prefix: str
    centroids: np.ndarray
    radius: np.ndarray
    counts: np.ndarray

    @property
    def cells(self) -> int:
        return len(self.centroids)


def _matrix(col: pa.Array) -> np.ndarray:
    """The vectors of an Arrow array, which has no nulls."""
    n = len(col)
    flat = np.asarray(col.flatten(), np.float64)
    if n and len(flat) % n:
        raise ValueError("vectors differ in length")
    return flat.reshape(n, len(flat) // n) if n else np.empty((0, 0))


def _parts(n: int, each: int):
    """Bounds of parts of n rows, so that a part with `each` numbers a row is bounded."""
    step = max(1, SLICE_SCORES // max(1, each))
    for a in range(0, n, step):
        yield a, min(n, a + step)


def cell_count(n: int) -> int:
    """Half the root of the number of vectors, so that centroids and a cell's vectors grow alike."""
    return int(min(MOST_CELLS, max(1, np.ceil(np.sqrt(n) / 2))))


def fit_cells(sample: np.ndarray, cells: int, rounds: int = FIT_ROUNDS) -> np.ndarray:
    """k-means over a sample, from rows spread evenly over it. A centroid that loses all its rows takes the row that is farthest from its own."""
    cells = min(cells, len(sample))
    if not cells:
        return np.empty((0, 0))
    centres = sample[np.linspace(0, len(sample) - 1, cells).astype(int)].copy()
    for _ in range(rounds):
        at, far = nearest_cells(sample, centres)
        count = np.bincount(at, minlength=cells)
        sums = np.zeros_like(centres)
        np.add.at(sums, at, sample)
        centres = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], centres)
        lost = np.flatnonzero(count == 0)
        centres[lost] = sample[np.argsort(-far, kind="stable")[: len(lost)]]
    return centres


def nearest_cells(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each row and the distance from it."""
    at = np.empty(len(x), np.int64)
    far = np.empty(len(x))
    own = (centres * centres).sum(1)[None, :]
    for a, b in _parts(len(x), len(centres)):
        at[a:b] = (own - 2 * (x[a:b] @ centres.T)).argmin(1)
        far[a:b] = np.sqrt(np.square(x[a:b] - centres[at[a:b]]).sum(1))
    return at, far


def write(rows: DataFrame, path: str, name: str, model: str, query_prefix: str = "", id: str = "vec_id", vector: str = "embedding", cells: int | None = None, sample: int = SAMPLE) -> None:
    """Store all rows in cells under path/name; an index of that name is replaced. A cell with many rows becomes several files."""
    spark, there = rows.sparkSession, rows.where(F.col(vector).isNotNull())
    n = there.count()
    drawn = there.select(F.xxhash64(id).alias("h"), F.col(id).alias("i"), F.col(vector).alias("v")).orderBy("h", "i").limit(sample).select("v").toArrow()["v"].combine_chunks()
    centres = fit_cells(_matrix(drawn), cells or cell_count(n))
    sent = spark.sparkContext.broadcast(centres)

    @F.arrow_udf("struct<cell: int, far: double>")
    def placed(col: pa.Array) -> pa.Array:
        at, far = np.full(len(col), NO_CELL), np.zeros(len(col))
        held = np.asarray(col.is_valid())
        if held.any() and len(sent.value):
            at[held], far[held] = nearest_cells(_matrix(col.filter(pa.array(held))), sent.value)
        return pa.StructArray.from_arrays([pa.array(at, pa.int32()), pa.array(far)], names=["cell", "far"])

    home = f"{path.rstrip('/')}/{name}"
    out = rows.select("*", placed(F.col(vector)).alias("_p")).select("*", "_p.cell", F.col("_p.far").alias("_far")).drop("_p")
    out.hint("rebalance", "cell").write.mode("overwrite").partitionBy("cell").parquet(f"{home}/vectors")
    sent.unpersist()
    size = spark.read.parquet(f"{home}/vectors").groupBy("cell").agg(F.count("*").alias("n"), F.max("_far").alias("radius")) if n else spark.createDataFrame([], "cell int, n bigint, radius double")
    known = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "cell int, centroid array<double>")
    known.join(size, "cell", "left").select("cell", "centroid", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("radius", F.lit(0.0)).alias("radius")).write.mode("overwrite").parquet(f"{home}/cells")
    meta = [(name, model, query_prefix, id, vector, n, len(centres), sample, out.schema.json())]
    spark.createDataFrame(meta, "name string, model string, query_prefix string, id string, vector string, vectors bigint, cells int, sample int, schema string").write.mode("overwrite").json(f"{home}/meta")


def read(spark: SparkSession, path: str, name: str) -> VectorIndex:
    """Open an index. Its centroids, a bounded number, come to the driver; vectors stay where they are."""
    home = f"{path.rstrip('/')}/{name}"
    meta = spark.read.json(f"{home}/meta").head()
    cells = spark.read.parquet(f"{home}/cells").orderBy("cell").collect()
    rows = spark.read.schema(StructType.fromJson(json.loads(meta.schema))).parquet(f"{home}/vectors").drop("_far")
    dim = len(cells[0].centroid) if cells else 0
    return VectorIndex(rows, meta.id, meta.vector, meta.model, meta.query_prefix, np.array([c.centroid for c in cells], float).reshape(len(cells), dim), np.array([c.radius for c in cells]), np.array([c.n for c in cells], int))


def _reached(index: VectorIndex, vector: Column, probes: int, least: Column | None = None) -> Column:
    """The cells that a query asks for: the `probes` nearest ones, or with `least` those beyond them whose bound reaches it."""
    sent = index.rows.sparkSession.sparkContext.broadcast((index.centroids, index.radius))

    def cells(q: np.ndarray, floor: np.ndarray | None) -> pa.Array:
        centres, radius = sent.value
        size, found = np.zeros(len(q), np.int64), []
        for a, b in _parts(len(q), len(centres)):
            dot = q[a:b] @ centres.T
            order = np.argsort(-dot, axis=1, kind="stable")[:, :probes]
            if floor is None:
                size[a:b] = order.shape[1]
                found.append(order.ravel().astype(np.int32))
                continue
            bound = dot + np.sqrt((q[a:b] * q[a:b]).sum(1))[:, None] * radius[None, :]
            open_ = bound * (1 + SLACK * np.sign(bound)) + SLACK >= floor[a:b, None]
            np.put_along_axis(open_, order, False, axis=1)
            size[a:b] = open_.sum(1)
            found.append(np.nonzero(open_)[1].astype(np.int32))
        return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(size)), pa.int32()), pa.array(np.concatenate([np.empty(0, np.int32), *found])))

    if least is None:

        @F.arrow_udf("array<int>")
        def run(q: pa.Array) -> pa.Array:
            return cells(_matrix(q), None)

        return run(vector)

    @F.arrow_udf("array<int>")
    def run_least(q: pa.Array, floor: pa.Array) -> pa.Array:
        return cells(_matrix(q), np.asarray(floor, float))

    return run_least(vector, least)


def _best(q: np.ndarray, known: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each query's k best of some vectors, by (score, id): query ids, ids, scores. A bounded number of scores is held at a time."""
    place = np.unique(ids, return_inverse=True)[1]
    out = [(known[:0], ids[:0], np.empty(0))]
    for a, b in _parts(len(q), len(x)):
        s = np.round(q[a:b] @ x.T, DIGITS)
        least = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k] if k < s.shape[1] else np.full(len(s), -np.inf)
        i, j = np.nonzero(s >= least[:, None])
        if len(i) > k * len(s):  # of what ties with the k-th, the least ids
            order = np.lexsort((place[j], -s[i, j], i))
            i, j = i[order], j[order]
            top = np.arange(len(i)) - np.searchsorted(i, i, "left") < k
            i, j = i[top], j[top]
        out.append((known[a:b][i], ids[j], s[i, j]))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def _kind(df: DataFrame, name: str) -> str:
    return df.schema[name].dataType.simpleString()


def _matched(index: VectorIndex, asks: DataFrame, k: int, few: int) -> DataFrame:
    """(query_id, id, score): the best k of each group of vectors for the queries that ask for its cell. asks: query_id, q, cells."""
    out = f"query_id {_kind(asks, 'query_id')}, id {_kind(index.rows, index.id)}, score double"
    schema = pa.schema([("query_id", to_arrow_type(asks.schema["query_id"].dataType)), ("id", to_arrow_type(index.rows.schema[index.id].dataType)), ("score", pa.float64())])

    def table(found) -> pa.Table:
        return pa.Table.from_arrays([pa.array(np.concatenate([f[i] for f in found]) if found else [], t) for i, t in enumerate(schema.types)], schema=schema)

    vectors = index.rows.select("cell", F.col(index.id).alias("id"), F.col(index.vector).alias("v"))
    held = asks.limit(few + 1).collect()
    if len(held) <= few:
        wanted = sorted({c for r in held for c in r.cells})
        if not wanted:
            return index.rows.sparkSession.createDataFrame([], out)
        q, known = np.array([r.q for r in held], float), np.asarray([r.query_id for r in held])
        asking: dict[int, list[int]] = {}
        for i, r in enumerate(held):
            for c in r.cells:
                asking.setdefault(c, []).append(i)
        sent = index.rows.sparkSession.sparkContext.broadcast((q, known, asking))

        def scan(batches):
            q, known, asking = sent.value
            for b in batches:
                cell, ids = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)
                x = _matrix(b.column(2))
                for c in np.unique(cell).tolist():
                    own, at = asking.get(c), np.flatnonzero(cell == c)
                    if own:
                        yield from table([_best(q[own], known[own], x[at], ids[at], k)]).to_batches()

        return vectors.where(F.col("cell").isin(wanted)).mapInArrow(scan, out)

    pairs = asks.select("query_id", "q", F.explode("cells").alias("cell"))
    spark = index.rows.sparkSession
    loads = pairs.groupBy("cell").count().collect()  # a row a cell
    dealt = F.broadcast(spark.createDataFrame([(r.cell, int(-(-max(1, index.counts[r.cell]) // GROUP_VECTORS)), -(-r["count"] // GROUP_QUERIES)) for r in loads], "cell int, vs int, qs int"))
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    mine = lambda key, n: F.pmod(F.xxhash64(key), n).cast("int")
    left = pairs.join(dealt, "cell").select("cell", every(F.col("vs")).alias("a"), mine("query_id", F.col("qs")).alias("b"), "query_id", "q")
    right = vectors.join(dealt, "cell").select("cell", mine("id", F.col("vs")).alias("a"), every(F.col("qs")).alias("b"), "id", "v")

    def multiplied(one: pa.Table, two: pa.Table) -> pa.Table:
        if not one.num_rows or not two.num_rows:
            return table([])
        q, x = _matrix(one["q"].combine_chunks()), _matrix(two["v"].combine_chunks())
        known, ids = one["query_id"].to_numpy(), two["id"].to_numpy()
        return table([_best(q, known, x, ids, k)])

    keys = ["cell", "a", "b"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(multiplied, out)


def search(index: VectorIndex, queries: DataFrame, k: int, probes: int, exact: bool = False, query_id: str = "query_id", vector: str = "embedding", few: int = FEW_QUERIES) -> DataFrame:
    """The k rows of the index with the largest inner products for each query: query_id, id, score, rank. Of the `probes` nearest cells; with `exact`, also of every cell that may still hold one of the best."""
    asks = queries.where(F.col(vector).isNotNull()).select(F.col(query_id).alias("query_id"), F.col(vector).alias("q"))
    order = [F.desc("score"), F.asc("id")]
    if not index.cells:
        found = _matched(replace(index, rows=index.rows.withColumn("cell", F.lit(NO_CELL))), asks.limit(0).withColumn("cells", F.array().cast("array<int>")), k, few)
    else:
        found = _matched(index, asks.withColumn("cells", _reached(index, F.col("q"), probes)), k, few)
        if exact and probes < index.cells:
            first = stored(top_k(found, k, ["query_id"], order).drop("rank"))
            least = first.groupBy("query_id").agg(F.when(F.count("*") == k, F.min("score")).alias("least"))
            floor = F.coalesce("least", F.lit(float("-inf")))
            more = asks.join(least, "query_id", "left").withColumn("cells", _reached(index, F.col("q"), probes, floor)).where(F.size("cells") > 0)
            found = first.unionByName(_matched(index, more.select("query_id", "q", "cells"), k, few))
    return top_k(found, k, ["query_id"], order).withColumnsRenamed({"query_id": query_id, "id": index.id})


def probes_for(index: VectorIndex, k: int, target: float = 0.95, sample: int = 256) -> int:
    """How many cells to probe so that the share `target` of the true best k are found, measured: stored vectors (those whose ids have the least hashes, `sample` at most) are searched exactly, and each true hit's cell has a place in its query's order of cells."""
    if not index.cells:
        return 1
    own = index.rows.where(F.col("cell") != NO_CELL).select(F.col(index.id).alias("query_id"), F.col(index.vector).alias("q")).orderBy(F.xxhash64(index.id), index.id).limit(sample)
    drawn = own.select("query_id", F.col("q").alias(index.vector))
    hits = search(index, drawn, k + 1, index.cells, vector=index.vector).where(F.col("query_id") != F.col(index.id))
    order = own.select("query_id", _reached(index, F.col("q"), index.cells).alias("order"))
    place = hits.join(index.rows.select(index.id, "cell"), index.id).join(order, "query_id").select(F.array_position("order", F.col("cell")).alias("place"))
    need = place.groupBy("place").count().collect()  # a row a place, as many as cells at most
    total, have = sum(r["count"] for r in need), 0
    for r in sorted(need, key=lambda r: r.place):
        have += r["count"]
        if have >= target * total:
            return int(r.place)
    return index.cells


def recall(found: DataFrame, true: DataFrame, query_id: str = "query_id", id: str = "vec_id") -> DataFrame:
    """(query_id, recall): the share of the true hits that were found."""
    hit = true.select(query_id, id).join(found.select(query_id, id).withColumn("_hit", F.lit(1)), [query_id, id], "left")
    return hit.groupBy(query_id).agg((F.count("_hit") / F.count("*")).alias("recall"))
