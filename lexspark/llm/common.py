"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
_MUL = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a temporary one only where none is named and Spark runs on this machine alone (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("name a folder that all machines share in spark.checkpoint.dir")
        named = tempfile.mkdtemp(prefix="lexspark-")
        atexit.register(shutil.rmtree, named, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(named)
    elif not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(named)
    return named


def pinned(df: DataFrame) -> DataFrame:
    """`df` cut from its lineage in the shared folder; for small tables (removed with the driver's reference)."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """`df` as a Parquet table in the shared folder, for tables that are read more than once."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/{uuid.uuid4().hex}.parquet"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


@contextmanager
def borrowed(df: DataFrame) -> Iterator[DataFrame]:
    """`df` as a Parquet table in the shared folder that goes when the block ends, for tables that no result reads."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{uuid.uuid4().hex}.parquet"
    try:
        df.write.parquet(path)
        yield spark.read.schema(df.schema).parquet(path)
    finally:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def held_out(doc_id: Column) -> Column:
    """Rows kept back from every fit: crc32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def hashed_share(key: Column, share: Column | float) -> Column:
    """True for about `share` of the keys, the same ones on every run."""
    return F.pmod(F.xxhash64(key), F.lit(1 << 30)) < F.lit(1 << 30) * share


def with_struct(df: DataFrame, name: str, value: Column, fields: list[str]) -> DataFrame:
    """Append the fields of a struct; a column of `df` with the same name is replaced."""
    kept = [c for c in df.columns if c not in fields]
    tmp = f"_{name}_{uuid.uuid4().hex[:6]}"
    out = df.select(*[df[f"`{c}`"] for c in kept], value.alias(tmp))
    return out.select(*[f"`{c}`" for c in kept], *[F.col(f"{tmp}.{f}").alias(f) for f in fields])


def _inverse(a: int) -> int:
    """Inverse of an odd number modulo 2**64 (Newton's steps)."""
    x = a
    for _ in range(6):
        x = x * (2 - a * x) & _MASK
    return x


class _Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown as needed."""

    def __init__(self, base: int):
        self.base, self.inv = base, _inverse(base)
        self.p = self.q = np.ones(1, U64)

    def upto(self, n: int):
        while len(self.p) < n:
            k = len(self.p)
            self.p = np.concatenate([self.p, self.p * U64(pow(self.base, k, 1 << 64))])
            self.q = np.concatenate([self.q, self.q * U64(pow(self.inv, k, 1 << 64))])
        return self.p[:n], self.q[:n]


_POWERS = _Powers(0x100000001B3)
#: Bytes that belong to a word: ASCII letters and digits, and every byte of a non-ASCII character.
_WORD = np.array([48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128 for b in range(256)])


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of the SplitMix64 generator: spreads the bits of 64-bit words."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes and byte starts of the words of a UTF-8 text, without a loop over words.

    Prefix sums of byte * base**position give each word's polynomial hash; the inverse power makes it independent of the word's place.
    """
    raw = np.frombuffer(data, np.uint8)
    if not len(raw):
        return np.empty(0, U64), np.empty(0, np.int64)
    inside = _WORD[raw]
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if inside[0]:
        edge = np.concatenate([[0], edge])
    if inside[-1]:
        edge = np.concatenate([edge, [len(raw)]])
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return np.empty(0, U64), np.empty(0, np.int64)
    p, q = _POWERS.upto(len(raw))
    sums = np.zeros(len(raw) + 1, U64)
    np.cumsum((raw.astype(U64) + U64(1)) * p, out=sums[1:])
    return mix((sums[ends] - sums[starts]) * q[starts] + (ends - starts).astype(U64) * U64(_MUL)), starts


def shingle_hashes(text: str | None, width: int = 5) -> np.ndarray:
    """Hashes of each run of `width` words (one hash of all words if there are fewer; none without words)."""
    if not text:
        return np.empty(0, U64)
    h, _ = word_hashes(text.lower().encode("utf-8", "surrogatepass"))
    n = len(h)
    if n == 0:
        return h
    k = min(n, width)
    out = np.zeros(n - k + 1, U64)
    for j in range(k):
        out = out * U64(_MUL) + h[j : n - k + 1 + j]
    return mix(out)
