"""Appends that count whole or not at all, and calls that stop in all tasks."""

import json
import os
import time

import pytest
from pyspark.sql import functions as F

from lexspark.functions import external
from lexspark.sources import ledger

SCHEMA = "run string, id bigint, verdict string"


def rows(spark, run, ids, verdict="ok"):
    return spark.createDataFrame([(run, i, verdict) for i in ids], SCHEMA).repartition(4)


def test_appends_are_whole_and_keyed(spark, tmp_path):
    path = str(tmp_path / "t")
    assert ledger.read(spark, path, SCHEMA).collect() == []
    ledger.append(rows(spark, "a", [*range(20), 3, 3, None]), path, ["run", "id"])
    ledger.append(rows(spark, "a", [*range(10, 30), None], "late"), path, ["run", "id"])
    ledger.append(rows(spark, "b", range(5)), path, ["run", "id"])
    ledger.append(rows(spark, "b", range(5)), path, ["run", "id"])
    got = [tuple(r) for r in ledger.read(spark, path).collect()]
    want = [("a", i, "ok") for i in range(20)] + [("a", None, "ok")] + [("a", i, "late") for i in range(20, 30)] + [("b", i, "ok") for i in range(5)]
    assert sorted(map(str, got)) == sorted(map(str, want))
    assert len(os.listdir(tmp_path / "t" / ledger.RECORDS)) == 3  # a job without new rows leaves none


def test_a_task_that_fails_after_writing_leaves_no_rows(spark, tmp_path):
    path = str(tmp_path / "t")
    ledger.append(rows(spark, "a", range(8)), path, ["run", "id"])

    def breaks(batches):
        for b in batches:
            yield b
        if any(x is not None and x >= 100 for x in b.column(1).to_pylist()):
            raise RuntimeError("lost after its rows were written")

    bad = rows(spark, "a", [*range(200), *range(100)]).mapInArrow(breaks, SCHEMA)
    spark.dataSource.register(ledger.Ledger)
    with pytest.raises(Exception, match="lost after"):
        bad.write.format("ledger").mode("append").save(path)
    assert ledger.read(spark, path).count() == 8
    # what an attempt left that was never committed, and a record that is not whole
    left = next(p for p in (tmp_path / "t" / ledger.FILES).iterdir() if p.suffix == ".parquet")
    (tmp_path / "t" / ledger.FILES / "other.parquet").write_bytes(left.read_bytes())
    (tmp_path / "t" / ledger.RECORDS / "_half").write_text(json.dumps({"job": "x", "file": "other.parquet", "rows": 1}))
    assert ledger.read(spark, path).count() == 8
    ledger.append(rows(spark, "a", range(200)), path, ["run", "id"])
    assert ledger.read(spark, path).count() == 200 == ledger.read(spark, path).select("id").distinct().count()


def counting(path, bad):
    def factory():
        def call(prompt):
            with open(f"{path}/{time.time_ns()}-{os.getpid()}-{prompt}", "w"):
                pass
            time.sleep(0.02)
            if prompt == bad:
                raise ValueError("limit")
            return prompt

        return call

    return factory


def test_the_first_failure_stops_all_tasks(spark, tmp_path):
    jobs = spark.createDataFrame([(i, f"p{i}") for i in range(400)], "id bigint, prompt string").repartition(4, "id")
    seen = tmp_path / "calls"
    seen.mkdir()
    got = external.called_once(jobs, counting(str(seen), "p77"), ["id"], stop_at_failure=True)
    calls = sorted(os.listdir(seen))
    at = next(i for i, c in enumerate(calls) if c.endswith("-p77"))
    tasks = spark.sparkContext.defaultParallelism
    assert len(calls) - 1 - at <= 2 * tasks  # calls that ran meanwhile, and one more a task
    r = got.groupBy(F.when(F.col("error") == external.NOT_CALLED, "no").when(F.col("error").isNull(), "yes").otherwise("failed").alias("k")).count().collect()
    n = {x.k: x["count"] for x in r}
    assert n["failed"] == 1 and n["yes"] == len(calls) - 1 and sum(n.values()) == 400


def test_the_cap_on_calls_is_exact(spark, tmp_path):
    jobs = spark.createDataFrame([(i, f"p{i}") for i in range(50)], "id bigint, prompt string").repartition(4)
    for cap in (0, 7, 50, 99):
        seen = tmp_path / str(cap)
        seen.mkdir()
        got = external.called_once(jobs, counting(str(seen), None), ["id"], max_calls=cap)
        assert got.count() == 50 and got.where(F.col("error") == external.CAPPED).count() == max(0, 50 - cap)
        assert len(os.listdir(seen)) == min(cap, 50) == got.where("response is not null").count()
