"""Compressing vectors to codes: product quantisation in whole numbers.

Components become integers, vectors are cut into equal parts, and each part position has a
codebook. A round assigns every part to the nearest entry of its position's codebook and
puts each entry where the mean of its parts is, rounded down. Distances come from norms and
one matrix product a part (|x|^2 - 2xc + |c|^2), in 64-bit integers, so they are exact and
the same on every machine; of equal distances the first entry wins.

The codebooks are the only thing that travels: entries x components x 8 bytes, whatever
the table's size. They go out as a broadcast; each Arrow batch sends back a count and sums
for the entries that it used, which a grouped shuffle merges to one row an entry.

Defined results: rows whose vector is null or holds a null or non-finite component are left
out; the first codebooks are the vectors of the smallest ids, ascending, of equal ids in
order of their components, null ids last, and fewer if there are fewer rows; rows that
repeat are coded each; an entry without parts stays; labels are grouped as they are, nulls
together; other columns are kept, and of those that have the name of a new one the new one
is kept; an empty table gives an empty result. Vectors of another length than the others',
of a length that the parts don't divide, or so large that a distance might pass 63 bits
are an error, as rounding them would not be exact.
"""

from __future__ import annotations

import hashlib
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexspark.llm.common import with_struct

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
FIELDS = ["code", "error"]


@dataclass(frozen=True)
class Codebooks:
    """entries: int64, part x entry x component of the part; shape (parts, 0, 0) if there were no vectors."""

    entries: np.ndarray
    scale: int = SCALE

    def digest(self) -> str:
        """SHA-256 of all components in decimal, by part, entry and place, with commas between."""
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def usable(vector: Column) -> Column:
    """Whether a vector is there and has only finite components."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return vector.isNotNull() & ~F.exists(vector, bad)


def integers(col: pa.Array, dim: int, parts: int, scale: int) -> np.ndarray:
    """The vectors of an Arrow array as floor(scale * x), row x part x component."""
    size = np.diff(np.asarray(col.offsets)) if len(col) else np.empty(0, int)
    if (size != dim).any():
        raise ValueError(f"a vector has {int(size[size != dim][0])} components, others have {dim}")
    scaled = np.floor(np.asarray(col.flatten(), float) * scale)
    if len(scaled) and np.abs(scaled).max() ** 2 * 4 * (dim // parts) >= 2.0**62:
        raise ValueError("a component is too large for exact distances")
    return scaled.astype(np.int64).reshape(len(col), parts, dim // parts)


def distances(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances of the rows of x from the entries, exact."""
    return (x * x).sum(1)[:, None] - 2 * (x @ entries.T) + (entries * entries).sum(1)[None, :]


def assigned(x: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of each row's parts, and its distance: both row x part."""
    at, far = (np.empty(x.shape[:2], np.int64) for _ in range(2))
    for p, entries in enumerate(books):
        d = distances(x[:, p], entries)
        at[:, p] = d.argmin(1)
        far[:, p] = d[np.arange(len(x)), at[:, p]]
    return at, far


def first_books(vectors: DataFrame, vec_id: str, vector: str, parts: int, entries: int, scale: int) -> Codebooks:
    """The parts of the first `entries` vectors by id."""
    ints = F.transform(vector, lambda v: F.floor(v.cast("double") * scale))
    rows = vectors.select(F.col(vec_id).alias("i"), F.col(vector).alias("v"), ints.alias("k")).orderBy(F.asc_nulls_last("i"), "k").limit(entries).select("v").collect()
    if not rows:
        return Codebooks(np.empty((parts, 0, 0), np.int64), scale)
    dim = len(rows[0].v)
    if dim % parts:
        raise ValueError(f"{parts} parts don't divide {dim} components")
    held = integers(pa.array([r.v for r in rows], pa.list_(pa.float64())), dim, parts, scale)
    return Codebooks(np.ascontiguousarray(held.transpose(1, 0, 2)), scale)


def moved(vectors: DataFrame, vector: str, books: Codebooks) -> Codebooks:
    """The codebooks after one round over all vectors."""
    parts, n, width = books.entries.shape
    sent = vectors.sparkSession.sparkContext.broadcast(books.entries)
    scale = books.scale
    names = ["part", "entry", "n", *(f"s{i}" for i in range(width))]

    def run(batches):
        for b in batches:
            x = integers(b.column(0), parts * width, parts, scale)
            at, _ = assigned(x, sent.value)
            for p in range(parts):
                used, place, count = np.unique(at[:, p], return_inverse=True, return_counts=True)
                sums = np.zeros((len(used), width), np.int64)
                np.add.at(sums, place, x[:, p])
                yield pa.record_batch([pa.array(np.full(len(used), p)), pa.array(used), pa.array(count), *map(pa.array, sums.T)], names=names)

    partial = vectors.select(vector).mapInArrow(run, ", ".join(f"{c} bigint" for c in names))
    merged = partial.groupBy("part", "entry").agg(*[F.sum(c).alias(c) for c in names[2:]]).collect()
    sent.unpersist()
    out = books.entries.copy()
    for r in merged:
        out[r.part, r.entry] = [s // r.n for s in r[3:]]
    return Codebooks(out, scale)


def fit(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> Codebooks:
    vectors = rows.where(usable(F.col(vector))).select(vec_id, vector)
    books = first_books(vectors, vec_id, vector, parts, entries, scale)
    for _ in range(rounds if books.entries.size else 0):
        books = moved(vectors, vector, books)
    return books


def encode(rows: DataFrame, books: Codebooks, vector: str = "embedding") -> DataFrame:
    """Append code (two hex digits a part) and error (squared distance from what the code stands for); rows without a usable vector go."""
    parts, n, width = books.entries.shape
    if n > 256:
        raise ValueError("two hex digits tell 256 entries apart")
    sent = rows.sparkSession.sparkContext.broadcast(books.entries)
    scale = books.scale

    @F.arrow_udf("struct<code: string, error: bigint>")
    def run(col: pa.Array) -> pa.Array:
        at, far = assigned(integers(col, parts * width, parts, scale), sent.value) if n else (np.empty((0, parts), int), np.empty((0, parts), int))
        return pa.StructArray.from_arrays([pa.array([x.hex() for x in map(bytes, at.astype(np.uint8))], pa.string()), pa.array(far.sum(1))], names=FIELDS)

    return with_struct(rows.where(usable(F.col(vector))), "code", run(F.col(vector)), FIELDS)


def with_label_error(coded: DataFrame, label: str = "label", error: str = "error") -> DataFrame:
    """Append label_error, the errors of equal labels summed; sums are made ahead of the shuffle, and adaptive execution splits a label that many rows have."""
    mine = f"_{uuid.uuid4().hex}"
    total = coded.groupBy(F.col(label).alias(mine)).agg(F.sum(error).alias("label_error"))
    return coded.drop("label_error").join(total, coded[label].eqNullSafe(F.col(mine)), "left").drop(mine)
