import datetime

from fixture_statutes import NOW

from lexspark.streaming import ingest


def test_incremental_articles(spark, tmp_path):
    (tmp_path / "in/근로법").mkdir(parents=True)
    (tmp_path / "in/근로법/m1.xml").write_text(NOW, encoding="utf-8")
    files = ingest.watch_statutes(spark, str(tmp_path / "in/*"))
    for _ in range(2):
        ingest.append_articles(files, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert len(got) == 5 and {r.law for r in got} == {"근로법"}


def test_windowed_counts(spark, tmp_path):
    day = lambda d, h: datetime.datetime(2024, 1, d, h)
    spark.createDataFrame([(day(1, 1), "a"), (day(1, 5), "a"), (day(3, 1), "b")], "ts timestamp, event_type string").write.parquet(str(tmp_path / "e"))
    s = spark.readStream.schema("ts timestamp, event_type string").parquet(str(tmp_path / "e"))
    q = ingest.windowed_counts(s).writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {(r.start.day, r.event_type): r.n for r in spark.table("w").collect()} == {(1, "a"): 2, (3, "b"): 1}
