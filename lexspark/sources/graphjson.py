"""The provision graph as one JSON object with free keys: {"built_at", "nodes": {id: {...}}, "precedents": {id: {...}}}.

The sink sorts members by range and writes parts, a member a line, which joined in order of
name are the object; no task holds more than its part. What it wrote is read back in
parallel, as a line's indent tells its section.

An object from elsewhere, perhaps one line of any length, can't be cut without reading what
comes before. One task reads each such file as a stream, and holds one member at a time.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

CHUNK = 1 << 16
SECTIONS = ("nodes", "precedents")
#: A member's line: an indent of one blank a section, a comma but for a section's first, the key, and the value.
LINE = r'^( +),?("(?:[^"\\]|\\.)*"): (.*)$'


def write(path: str, built_at: str, nodes: DataFrame, precedents: DataFrame, node_id: str = "article_id", case_id: str = "id") -> None:
    """Store a graph. Null fields are written, as readers of such objects look them up; keys are distinct."""
    spark = nodes.sparkSession
    marks = [(0, f'{{"built_at": {json.dumps(built_at)}, "nodes": {{'), (2, '}, "precedents": {'), (4, "}}")]
    rows = spark.createDataFrame([(place, "", line) for place, line in marks], "place int, key string, line string")
    for i, (part, id) in enumerate(((nodes, node_id), (precedents, case_id))):
        body = F.to_json(F.struct(*[c for c in part.columns if c != id]), {"ignoreNullFields": "false"})
        key = F.to_json(F.array(F.col(id)))  # in brackets
        first = part.agg(F.min(id)).scalar()
        comma = F.when(F.col(id) == first, "").otherwise(",")
        line = F.concat(F.lit(" " * (i + 1)), comma, F.substring(key, F.lit(2), F.length(key) - 2), F.lit(": "), body)
        rows = rows.unionByName(part.select(F.lit(2 * i + 1).alias("place"), F.col(id).alias("key"), line.alias("line")))
    rows.orderBy("place", "key").select("line").write.mode("overwrite").text(path)


def read(spark: SparkSession, path: str, section: str, value: str, id: str = "article_id") -> DataFrame:
    """A section of what `write` stored: the key and the fields of `value` (DDL)."""
    part = lambda k: F.regexp_extract("value", LINE, k)
    rows = spark.read.text(path).where(F.length(part(1)) == SECTIONS.index(section) + 1)
    return rows.select(_key(part(2)).alias(id), F.from_json(part(3), value).alias("_v")).select(id, "_v.*")


def _key(c):
    return F.get(F.from_json(F.concat(F.lit("["), c, F.lit("]")), "array<string>"), F.lit(0))


class Feed:
    """A JSON text that is read as it is needed; what has been taken is let go."""

    def __init__(self, more: Callable[[int], str]):
        self.more, self.text, self.at, self.ended, self.decoder = more, "", 0, False, json.JSONDecoder()

    def _fill(self, size: int = CHUNK) -> None:
        got = self.more(size)
        self.ended = not got
        self.text, self.at = self.text[self.at :] + got, 0

    def peek(self) -> str:
        """The next character that is no white space."""
        while True:
            while self.at < len(self.text) and self.text[self.at] in " \t\r\n":
                self.at += 1
            if self.at < len(self.text):
                return self.text[self.at]
            if self.ended:
                raise ValueError("the text ends within an object")
            self._fill()

    def take(self, mark: str) -> None:
        if self.peek() != mark:
            raise ValueError(f"{mark!r} expected, {self.peek()!r} found")
        self.at += 1

    def value(self) -> tuple[object, str]:
        """The next value and its text. One that isn't complete yet is tried again with twice as much, so the work is linear."""
        self.peek()
        size = CHUNK
        while True:
            try:
                found, end = self.decoder.raw_decode(self.text, self.at)
                if end < len(self.text) or self.ended:  # else a number might go on
                    said, self.at = self.text[self.at : end], end
                    return found, said
            except json.JSONDecodeError:
                if self.ended:
                    raise
            self._fill(size)
            size *= 2

    def members(self) -> Iterator[str]:
        """The keys of the next value, an object; the caller takes each value."""
        self.take("{")
        while self.peek() != "}":
            key, _ = self.value()
            self.take(":")
            yield key
            if self.peek() == ",":
                self.take(",")
        self.take("}")


def members(more: Callable[[int], str], section: str) -> Iterator[tuple[str, str]]:
    """(key, text of the value) of one section of an object."""
    feed = Feed(more)
    for name in feed.members():
        if name == section:
            for key in feed.members():
                yield key, feed.value()[1]
        elif feed.peek() == "{":
            for _ in feed.members():
                feed.value()
        else:
            feed.value()


class _File(InputPartition):
    def __init__(self, path: str):
        super().__init__(path)
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, path: str, section: str):
        self.path, self.section = path, section

    def _system(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("file:") else (fs.LocalFileSystem(), self.path)

    def partitions(self):
        from pyarrow import fs

        system, path = self._system()
        if system.get_file_info(path).type == fs.FileType.Directory:
            return [_File(f.path) for f in sorted(system.get_file_info(fs.FileSelector(path)), key=lambda f: f.path) if f.is_file and f.base_name[0] not in "._"]
        return [_File(path)]

    def read(self, partition):
        import codecs

        decoder = codecs.getincrementaldecoder("utf-8")()
        with self._system()[0].open_input_stream(partition.path) as f:

            def more(size: int) -> str:
                while got := f.read(size):
                    if text := decoder.decode(got):
                        return text
                return decoder.decode(b"", True)

            yield from members(more, self.section)


class JsonMembers(DataSource):
    """format("json_members").option("section", name).load(path): key, value (JSON text) of each member of a section, for each file of a folder."""

    @classmethod
    def name(cls) -> str:
        return "json_members"

    def schema(self) -> str:
        return "key string, value string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], self.options.get("section", SECTIONS[0]))


def read_object(spark: SparkSession, path: str, section: str, value: str, id: str = "article_id") -> DataFrame:
    """A section of any such objects, one task a file."""
    spark.dataSource.register(JsonMembers)
    rows = spark.read.format("json_members").option("section", section).load(path)
    return rows.select(F.col("key").alias(id), F.from_json("value", value).alias("_v")).select(id, "_v.*")
