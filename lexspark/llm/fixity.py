"""WARC records and a Merkle audit of their replicas.

A manifest has a leaf for each record: its shard, its ordinal there, its offset range and
its SHA-256. `FANOUT` consecutive leaves make a node, `FANOUT` nodes the next one, up to a
root for each shard; the shards' roots make one more tree in order of shard. Two replicas
are compared from the top; only the children of nodes that differ are looked at, so an
audit of equal replicas reads two roots. Levels are small tables, and each step is a join
on the node's key; where few shards differ, the leaves' scan is told which, and as leaves
are written in order of shard, other row groups aren't read. `audited` gives a replica's records the places of the reference's
records with their ids (`placed`), so a record lost or added shifts no other.

Defined results: a null payload is an empty record; a record lost from a replica is
`missing`, one that only the replica has `extra`, one with other bytes `corrupt`, one with
the same bytes at another offset `moved`; records with equal payloads are told apart by
their place; a null id sorts first; two empty replicas agree. Of other columns a manifest
keeps those named in `keep`.
"""

from __future__ import annotations

import gzip
import io
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexspark.llm.common import pinned, written

FANOUT = 16
SHARD_RECORDS = 4096
#: Shards up to which the scan of the leaves is told their numbers.
FEW_SHARDS = 1000


# --- the format ---------------------------------------------------------------------


def record(uri: Column, payload: Column, record_id: Column) -> Column:
    """A WARC/1.0 resource record as text; its bytes are the text's UTF-8."""
    body = F.coalesce(payload, F.lit(""))
    return F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:record:"),
        F.coalesce(record_id.cast("string"), F.lit("")),
        F.lit(">\r\nWARC-Target-URI: "),
        F.coalesce(uri, F.lit("")),
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "),
        F.octet_length(body).cast("string"),
        F.lit("\r\n\r\n"),
        body,
        F.lit("\r\n\r\n"),
    )


def read_records(data: bytes) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """(offset, length, headers in lower case, payload) of each record of a WARC file, gzipped or not; offsets are of the uncompressed file. What isn't a record ends the reading."""
    if data[:2] == b"\x1f\x8b":
        data = gzip.GzipFile(fileobj=io.BytesIO(data)).read()
    at = 0
    while data[at : at + 5] == b"WARC/":
        end = data.find(b"\r\n\r\n", at)
        if end < 0:
            return
        head = data[at:end].decode("utf-8", "replace").split("\r\n")[1:]
        headers = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in head)}
        size = headers.get("content-length", "")
        if not size.isdigit():
            return
        stop = end + 4 + int(size)
        yield at, min(stop + 4, len(data)) - at, headers, data[end + 4 : stop]
        at = stop + 4


def read_warc(spark, path: str) -> DataFrame:
    """Records of WARC files: file, ordinal, offset, length, uri, record_id, payload (binary). A file is read by one task, as gzip allows no other."""
    import pandas as pd

    def run(frames):
        for f in frames:
            for name, data in zip(f["path"], f["content"], strict=True):
                rows = [(name, i, o, n, h.get("warc-target-uri"), h.get("warc-record-id"), p) for i, (o, n, h, p) in enumerate(read_records(bytes(data)))]
                for a in range(0, len(rows), 1000):
                    yield pd.DataFrame(rows[a : a + 1000], columns=["file", "ordinal", "offset", "length", "uri", "record_id", "payload"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(run, "file string, ordinal bigint, offset bigint, length bigint, uri string, record_id string, payload binary")


# --- manifests and trees ------------------------------------------------------------


def manifest(records: DataFrame, key: str, uri: str, payload: str, shards: int, keep: list[str] | None = None) -> DataFrame:
    """Leaves: the columns of `keep`, shard, ordinal, offset, length, digest. Only digests and lengths are moved, never payloads."""
    rec = record(F.col(uri), F.col(payload), F.col(key))
    own = records.select(*(keep or []), F.pmod(F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(0)), F.lit(shards)).alias("shard"), F.col(key).alias("_k"), F.octet_length(rec).cast("bigint").alias("length"), F.sha2(rec, 256).alias("digest"))
    order = Window.partitionBy("shard").orderBy(F.col("_k").asc_nulls_first(), "digest")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    return own.select("*", (F.row_number().over(order) - 1).cast("bigint").alias("ordinal"), F.coalesce(F.sum("length").over(before), F.lit(0)).alias("offset")).drop("_k")


def shard_count(records: DataFrame) -> int:
    return max(1, records.count() // SHARD_RECORDS)


def _parents(nodes: DataFrame) -> DataFrame:
    """Nodes one level up: the hash over the children's places and hashes in order."""
    child = F.struct("idx", "hash")
    body = F.transform(F.sort_array(F.collect_list(child)), lambda c: F.concat_ws(":", c["idx"].cast("string"), c["hash"]))
    return nodes.groupBy("replica", "shard", F.floor(F.col("idx") / FANOUT).alias("up")).agg(F.sha2(F.concat_ws("|", body), 256).alias("hash")).select("replica", "shard", F.col("up").alias("idx"), "hash")


def trees(a: DataFrame, b: DataFrame, most: int, shards: int) -> list[DataFrame]:
    """The levels of both replicas' trees, leaves first: (replica, shard, idx, hash). Within shards up to a node each, then over the shards (shard -1) up to the root. `most` is the largest number of records in a shard."""
    leaf = F.sha2(F.concat_ws(":", F.col("offset").cast("string"), F.col("length").cast("string"), "digest"), 256)
    rows = lambda m, k: m.select(F.lit(k).alias("replica"), "shard", F.col("ordinal").alias("idx"), leaf.alias("hash"))
    levels = [rows(a, "a").unionByName(rows(b, "b"))]
    while most > 1:
        levels.append(pinned(_parents(levels[-1])))
        most = -(-most // FANOUT)
    levels.append(levels[-1].select("replica", F.lit(-1).cast("bigint").alias("shard"), F.col("shard").alias("idx"), "hash"))
    while shards > 1:
        levels.append(pinned(_parents(levels[-1])))
        shards = -(-shards // FANOUT)
    return levels


def audit(a: DataFrame, b: DataFrame, most: int, shards: int) -> tuple[DataFrame, list[int]]:
    """Leaves on which replica b differs from a: (shard, ordinal, status), and the number of nodes compared on each level from the root down."""
    levels = trees(a, b, most, shards)
    compared: list[int] = []
    wanted: DataFrame | None = None
    over = 0  # levels of the tree of shards, the root included
    n = shards
    while n > 1:
        n, over = -(-n // FANOUT), over + 1
    for depth, level in enumerate(reversed(levels)):
        if wanted is not None:
            if depth == over + 1:  # from the tree of shards into the shards: the node's index was the shard, its children's parent is 0
                level = level.join(wanted.select(F.col("idx").alias("shard")), "shard", "left_semi")
            else:
                up = wanted.select("shard", F.col("idx").alias("up"))
                if depth == len(levels) - 1:
                    few = [r[0] for r in up.select("shard").distinct().limit(FEW_SHARDS + 1).collect()]
                    if len(few) <= FEW_SHARDS:
                        level = level.where(F.col("shard").isin(few))
                level = level.withColumn("up", F.floor(F.col("idx") / FANOUT)).join(up, ["shard", "up"], "left_semi").drop("up")
        both = level.groupBy("shard", "idx").agg(F.max(F.when(F.col("replica") == "a", F.col("hash"))).alias("ha"), F.max(F.when(F.col("replica") == "b", F.col("hash"))).alias("hb"))
        both = pinned(both)
        compared.append(both.count())
        wanted = both.where(~F.col("ha").eqNullSafe(F.col("hb")))
    ends = wanted.select("shard", F.col("idx").alias("ordinal"))
    col = lambda m, s: m.join(ends, ["shard", "ordinal"], "left_semi").select("shard", "ordinal", F.col("digest").alias(f"d_{s}"))
    met = col(a, "a").join(col(b, "b"), ["shard", "ordinal"], "full_outer")
    status = F.when(F.col("d_b").isNull(), "missing").when(F.col("d_a").isNull(), "extra").when(F.col("d_a") == F.col("d_b"), "moved").otherwise("corrupt")
    return met.select("shard", "ordinal", status.alias("status")), compared


def placed(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Manifest b with each record at the ordinal and offset of manifest a's record with its id; those that only b has follow their shard's last. Of records that share an id, those with equal digests go together first."""
    both = a.select(F.lit("a").alias("replica"), key, "shard", "ordinal", "offset", "length", "digest").unionByName(b.select(F.lit("b").alias("replica"), key, "shard", "ordinal", "offset", "length", "digest"))
    row = lambda *by, order: F.row_number().over(Window.partitionBy("shard", *by).orderBy(*order))
    both = both.withColumn("_copy", row("replica", key, "digest", order=["ordinal"]))
    both = both.withColumn("_same", F.count("*").over(Window.partitionBy("shard", key, "digest", "_copy")) == 2)
    both = both.withColumn("_nth", row("replica", key, "_same", order=["digest", "ordinal"]))
    place = Window.partitionBy("shard", key, "_same", "_nth")
    of_a = lambda c: F.max(F.when(F.col("replica") == "a", F.col(c))).over(place)
    both = both.select("*", of_a("ordinal").alias("_ordinal"), of_a("offset").alias("_offset"), F.count(F.when(F.col("replica") == "a", 1)).over(Window.partitionBy("shard")).alias("_n"))
    new = F.col("_n") + row("replica", F.col("_ordinal").isNull(), order=["ordinal"]) - 1
    both = both.select(key, "shard", F.coalesce("_ordinal", new).cast("bigint").alias("ordinal"), F.coalesce("_offset", "offset").alias("offset"), "length", "digest", "replica")
    return both.where("replica = 'b'").drop("replica")


def _in_order(m: DataFrame) -> DataFrame:
    """A manifest written in order of shard and place."""
    return written(m.repartitionByRange("shard", "ordinal").sortWithinPartitions("shard", "ordinal"))


def audited(a: DataFrame, b: DataFrame, shards: int, key: str) -> DataFrame:
    """Replica a's manifest with the status of each record (`ok` where the replicas agree), and b's `extra` records; both manifests have the column `key`, the record's id."""
    a = _in_order(a)
    b = _in_order(placed(a, b, key))
    most = max((m.agg(F.max("ordinal")).first()[0] or 0) + 1 for m in (a, b))
    found, _ = audit(a, b, most, shards)
    found = pinned(found)
    own = a.join(found.where("status <> 'extra'"), ["shard", "ordinal"], "left").withColumn("status", F.coalesce("status", F.lit("ok")))
    return own.unionByName(b.join(found.where("status = 'extra'"), ["shard", "ordinal"]), allowMissingColumns=True)
