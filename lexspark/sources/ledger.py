"""A table that grows by whole jobs, and holds each key once.

Tasks write files that nobody reads yet. When all have succeeded, the driver writes one
record that names the files of the attempts that count; a job that fails, and attempts that
were repeated, leave files that no record names. A reader takes only named files. Rows whose
key the table holds aren't written again, so a job that is run twice adds nothing.

    ledger.append(rows, path, ["run", "id"])
    ledger.read(spark, path)
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

FILES, RECORDS = "files", "records"


def _system(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if ":/" in path.split("/", 1)[0] + "/" else (fs.LocalFileSystem(), path)


@dataclass
class Written(WriterCommitMessage):
    name: str | None
    rows: int


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str, schema: StructType):
        self.path, self.schema, self.job = path.rstrip("/"), to_arrow_schema(schema), uuid.uuid4().hex

    def write(self, iterator) -> Written:
        import pyarrow.parquet as pq

        system, home = _system(self.path)
        name, rows, out = f"{self.job}-{uuid.uuid4().hex}.parquet", 0, None
        try:
            for batch in iterator:
                if not batch.num_rows:
                    continue
                if out is None:
                    system.create_dir(f"{home}/{FILES}")
                    out = pq.ParquetWriter(f"{home}/{FILES}/{name}", self.schema, filesystem=system)
                out.write_batch(batch.cast(self.schema) if batch.schema != self.schema else batch)
                rows += batch.num_rows
        finally:
            if out is not None:
                out.close()
        return Written(name if rows else None, rows)

    def commit(self, messages) -> None:
        """One record, under its own name only when it is whole."""
        files = [m.name for m in messages if m is not None and m.name]
        if not files:
            return
        system, home = _system(self.path)
        system.create_dir(f"{home}/{RECORDS}")
        made = f"{home}/{RECORDS}/_{self.job}"
        with system.open_output_stream(made) as f:
            for m in messages:
                if m is not None and m.name:
                    f.write((json.dumps({"job": self.job, "file": m.name, "rows": m.rows}) + "\n").encode())
        system.move(made, f"{home}/{RECORDS}/{self.job}.json")

    def abort(self, messages) -> None:
        from pyarrow import fs

        system, home = _system(self.path)
        found = system.get_file_info(fs.FileSelector(f"{home}/{FILES}", allow_not_found=True))
        for f in found:
            if f.base_name.startswith(self.job):
                system.delete_file(f.path)


class Ledger(DataSource):
    """format("ledger").mode("append").save(path)."""

    @classmethod
    def name(cls) -> str:
        return "ledger"

    def writer(self, schema: StructType, overwrite: bool):
        if overwrite:
            raise ValueError("a ledger is only appended to")
        return _Writer(self.options["path"], schema)


def read(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """The rows of all jobs that were committed. Files are matched with records by name, as a join; the list doesn't pass the driver."""
    home = path.rstrip("/")
    system, at = _system(home)
    from pyarrow import fs

    if system.get_file_info(f"{at}/{RECORDS}").type == fs.FileType.NotFound:
        if schema is None:
            raise ValueError("nothing is committed, and no schema given")
        return spark.createDataFrame([], schema)
    named = spark.read.schema("job string, file string, rows bigint").json(f"{home}/{RECORDS}").select(F.col("file").alias("_file")).distinct()
    files = spark.read if schema is None else spark.read.schema(schema)
    rows = files.parquet(f"{home}/{FILES}").withColumn("_file", F.col("_metadata.file_name"))
    return rows.join(named, "_file", "left_semi").drop("_file")


def append(rows: DataFrame, path: str, keys: list[str]) -> None:
    """Add the rows whose key (nulls are values) the table lacks, of rows with one key any one, as one job that counts whole or not at all."""
    spark = rows.sparkSession
    spark.dataSource.register(Ledger)
    held = read(spark, path, rows.schema).select(*[F.col(k).alias(f"_held_{i}") for i, k in enumerate(keys)])
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_held_{i}"))
    rows.dropDuplicates(keys).join(held, same, "left_anti").write.format("ledger").mode("append").save(path)
