"""A REST search as a Spark data source: one partition a query, pages read until a short one.

The transport is a callable (endpoint, params) -> (status, body), so tests and offline
runs bring their own; retries back off exponentially and an error body under status 200 is
an error too.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from urllib.parse import urlencode
from urllib.request import urlopen

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

PAGE = 100
#: Body text by which the service says that it did not know the caller.
REJECTED = "사용자 정보 검증에 실패"


class RestError(RuntimeError):
    pass


def http(base: str) -> Callable[[str, dict], tuple[int, bytes]]:
    def get(endpoint: str, params: dict) -> tuple[int, bytes]:
        with urlopen(f"{base.rstrip('/')}/{endpoint}?{urlencode(params)}", timeout=30) as r:
            return r.status, r.read()

    return get


def fetched(get: Callable[[str, dict], tuple[int, bytes]], endpoint: str, params: dict, tries: int = 3, wait: float = 1.0) -> bytes:
    """The body of a request that succeeded within `tries`; waits double."""
    for n in range(tries):
        try:
            status, body = get(endpoint, params)
        except OSError as e:
            status, body = 0, str(e).encode()
        if 200 <= status < 300:
            if REJECTED in body[:2000].decode("utf-8", "replace"):
                raise RestError("the service rejected the caller")
            return body
        if n + 1 < tries:
            time.sleep(wait * 2**n)
    raise RestError(f"{endpoint} failed {tries} times, last with status {status}")


def rows_of(body: bytes, target: str) -> list[dict]:
    """Result rows of a search; one row alone comes as an object."""
    root = next(iter(json.loads(body).values()), {})
    rows = root.get(target, [])
    return rows if isinstance(rows, list) else [rows]


def pages(get, endpoint: str, target: str, params: dict, wait: float = 1.0) -> Iterator[dict]:
    page = 1
    while True:
        rows = rows_of(fetched(get, endpoint, params | {"page": page, "display": PAGE}, wait=wait), target)
        yield from rows
        if len(rows) < PAGE:
            return
        page += 1


class _Query(InputPartition):
    def __init__(self, query: str):
        self.query = query


class SearchReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict, transport: Callable[[dict], Callable]):
        self.schema, self.options, self.transport = schema, options, transport

    def partitions(self):
        return [_Query(q) for q in json.loads(self.options.get("queries", "[]"))]

    def read(self, partition):
        get = self.transport(dict(self.options))
        extra = json.loads(self.options.get("params", "{}"))
        target = self.options.get("target", "law")
        for row in pages(get, self.options.get("endpoint", "search"), target, {"target": target, "query": partition.query, **extra}, float(self.options.get("wait", "1"))):
            yield tuple(partition.query if f.name == "query" else None if row.get(f.name) is None else str(row[f.name]) for f in self.schema.fields)


def register(spark: SparkSession, transport: Callable[[dict], Callable] | None = None, name: str = "rest_search") -> None:
    """Register the source; `transport` makes the request function from the options (by default HTTP to option `base`)."""
    made = transport or (lambda options: http(options["base"]))

    class RestSearch(DataSource):
        @classmethod
        def name(cls):
            return name

        def schema(self):
            return "query string, id string"

        def reader(self, schema):
            return SearchReader(schema, self.options, made)

    spark.dataSource.register(RestSearch)


# --- what is done with search results -----------------------------------------------


def versions(rows: DataFrame, name: str, in_force: str = "현행", kept: tuple[str, ...] = ("현행", "시행예정")) -> DataFrame:
    """Versions of one statute by its exact name (name, mst, status, effective, pos): in force or to come, each (mst, effective) once (the first by pos), in order of effect. It is an error if none is in force."""
    own = rows.where((F.col("name") == name) & F.col("status").isin(*kept))
    first = Window.partitionBy("mst", "effective").orderBy("pos")
    own = own.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    checked = own.agg(F.assert_true(F.count_if(F.col("status") == in_force) > 0, F.lit(f"no version of {name} is in force")).alias("_ok"))
    return own.join(checked, F.lit(True)).where("_ok is null").drop("_ok").orderBy("effective", "mst")


def newest(rows: DataFrame, court: str, since: str, n: int | None = None) -> DataFrame:
    """Cases (id, court, decided) of one court from a date on, newest first."""
    day = F.replace("decided", F.lit("."), F.lit(""))
    out = rows.where((F.col("court") == court) & (day >= since)).orderBy(day.desc(), "id")
    return out if n is None else out.limit(n)


def bulk_order(rows: DataFrame, held: DataFrame, cap: int, group: str = "query", key: str = "id", newest_by: str = "decided") -> DataFrame:
    """What a capped bulk load takes: groups with fewest results first, in a group the newest first, a key once, nothing that is held, at most `cap` rows with what is held."""
    sized = rows.join(rows.groupBy(group).agg(F.count("*").alias("_size")), group)
    once = sized.groupBy(key).agg(F.min(F.struct("_size", group)).alias("_g"), F.max(newest_by).alias(newest_by)).select(key, "_g.*", newest_by)
    fresh = once.join(held.select(key), key, "left_anti")
    return fresh.orderBy("_size", group, F.desc(newest_by), key).limit(max(0, cap - held.count())).drop("_size")
