"""Statute and case XML as DataFrames.

A document is read whole, because headings carry their chapter to the articles after
them and rows of a row-tag scan have no order.
"""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexspark.functions import text as X


def _quoted(ddl: str) -> str:
    """Names outside ASCII in back quotes."""
    return re.sub(r"([가-힣]\w*)(?=:)", r"`\1`", ddl)


_ITEM = _quoted("struct<호내용: string, 목: array<struct<목내용: string>>>")
_PARA = f"struct<`항번호`: string, `항내용`: string, `호`: array<{_ITEM}>>"
_UNIT = f"struct<`조문여부`: string, `조문번호`: string, `조문가지번호`: string, `조문제목`: string, `조문내용`: string, `조문시행일자`: string, `조문참고자료`: string, `항`: array<{_PARA}>>"
#: Units stand under the root or under one element more.
_STATUTE = f"struct<`기본정보`: struct<`법령ID`: string, `시행일자`: string>, `조문단위`: array<{_UNIT}>, `조문`: struct<`조문단위`: array<{_UNIT}>>>"
_CASE_FIELDS = ("사건번호", "사건명", "선고일자", "참조조문", "판시사항", "판결요지", "판례내용")
_CASE = f"struct<{', '.join(f'`{f}`: string' for f in _CASE_FIELDS)}>"
HEADING_UNIT = "전문"
IN_FORCE, SCHEDULED = "현행", "시행예정"


def file_text(path: Column) -> Column:
    """The text of a file, by a path or an address that Arrow's file systems know (file, hdfs, s3, gs). Being a column, it is read only for rows that filters on other columns leave, and by as many tasks as the rows are in."""

    @F.arrow_udf("string")
    def run(col: pa.Array) -> pa.Array:
        from pyarrow import fs

        out = []
        for p in col.to_pylist():
            system, at = fs.FileSystem.from_uri(p) if re.match(r"[a-z0-9]+:/", p) else (fs.LocalFileSystem(), p)
            with system.open_input_stream(at) as f:
                out.append(f.read().decode("utf-8"))
        return pa.array(out, pa.string())

    return run(path)


def documents(spark: SparkSession, manifest: DataFrame, root: str) -> DataFrame:
    """The manifest's files with their content, one row each: manifest columns, content. Filters on the manifest's columns, before or after, keep files from being opened; no list of files goes through the driver."""
    at = F.concat(F.lit(f"{root.rstrip('/')}/"), F.col("path"))
    return manifest.repartition("path").withColumn("content", file_text(at))


def carried(values: Column) -> Column:
    """An array of strings in which each null is what stood before it, at first empty."""

    @F.arrow_udf("array<string>")
    def run(col: pa.Array) -> pa.Array:
        out = []
        for xs in col.to_pylist():
            last, own = "", []
            for x in xs or []:
                last = last if x is None else x
                own.append(last)
            out.append(own)
        return pa.array(out, pa.list_(pa.string()))

    return run(values)


def articles(docs: DataFrame, content: str = "content", name: str = "name") -> DataFrame:
    """Article rows with label and text, and the position in the document (`pos`); other columns stay."""
    own = [c for c in docs.columns if c != content]
    doc = docs.withColumn("_d", F.from_xml(F.col(content), _STATUTE))
    units = F.concat(F.coalesce(F.col("_d.조문단위"), F.array().cast(f"array<{_UNIT}>")), F.coalesce(F.col("_d.조문.조문단위"), F.array().cast(f"array<{_UNIT}>")))
    heading = lambda u: X.strip(u["조문여부"]) == HEADING_UNIT
    # a heading's text holds from its place on, within its own document
    chapters = carried(F.transform(units, lambda u: F.when(heading(u), X.strip(u["조문내용"]))))
    both = F.arrays_zip(units.alias("u"), chapters.alias("chapter"))
    rows = doc.select(*own, X.strip("_d.기본정보.법령ID").alias("law_id_xml"), X.strip("_d.기본정보.시행일자").alias("version_effective"), F.posexplode(both).alias("pos", "_b"))
    rows = rows.select(*own, "law_id_xml", "version_effective", "pos", F.col("_b.u").alias("u"), F.col("_b.chapter").alias("chapter"))
    rows = rows.where(~heading(F.col("u")))
    items = lambda h: F.filter(
        F.flatten(
            F.transform(
                F.coalesce(h["호"], F.array().cast(f"array<{_ITEM}>")),
                lambda x: F.concat(F.array(X.strip(x["호내용"])), F.transform(F.coalesce(x["목"], F.array().cast("array<struct<`목내용`: string>>")), lambda m: F.concat(F.lit("  "), X.strip(m["목내용"])))),
            )
        ),
        lambda i: X.strip(i) != "",
    )
    paras = F.transform(F.coalesce("u.항", F.array().cast(f"array<{_PARA}>")), lambda h: F.struct(X.strip(h["항번호"]).alias("no"), X.strip(h["항내용"]).alias("text"), items(h).alias("items")))
    head = X.strip("u.조문내용")
    rows = rows.withColumn("_p", paras)
    alone = lambda its: F.array(F.struct(F.lit("").alias("no"), X.without_heading(head).alias("text"), its.alias("items")))
    fixed = (
        F.when(F.size("_p") == 0, alone(F.array().cast("array<string>")))
        .when(F.forall("_p", lambda p: p["text"] == ""), alone(F.flatten(F.transform("_p", lambda p: p["items"]))))
        .otherwise(F.col("_p"))
    )
    branch = X.strip("u.조문가지번호")
    rows = rows.withColumn("paragraphs", fixed)
    every = F.concat_ws(" ", head, X.strip("u.조문참고자료"), F.array_join(F.transform("paragraphs", lambda p: F.concat(p["text"], F.lit(" "), F.array_join(p["items"], " "))), " "))
    out = rows.select(
        *[c for c in own if c not in ("law_id",)],
        F.col(name).alias("law"),
        F.col("law_id_xml").alias("law_id"),
        X.level(name).alias("level"),
        "version_effective",
        F.concat(X.strip("u.조문번호"), F.when(branch != "", F.concat(F.lit("의"), branch)).otherwise("")).alias("article_key"),
        X.strip("u.조문제목").alias("title"),
        "chapter",
        X.strip("u.조문시행일자").alias("article_effective"),
        "paragraphs",
        X.amendment_dates(every).alias("amended"),
        "pos",
    )
    return out.withColumn("label", X.label("article_key", "title")).withColumn("text", X.rendered(F.concat_ws(" ", "law", "label"), "paragraphs")).withColumn("article_id", X.article_id("law", "article_key"))


def _clauses(c):
    @F.arrow_udf("array<struct<promulgated: string, text: string>>")
    def run(col: pa.Array) -> pa.Array:
        out = []
        for x in col:
            units = ET.fromstring(x.as_py()).iter("부칙단위") if x.is_valid else ()
            out.append([{"promulgated": u.findtext("부칙공포일자") or "", "text": re.sub(r"\s+", " ", "".join(u.itertext()))} for u in units])
        return pa.array(out, pa.list_(pa.struct([("promulgated", pa.string()), ("text", pa.string())])))

    return run(c)


def supplementary(docs: DataFrame, content: str = "content") -> DataFrame:
    """A row for each supplementary provision: the document's columns, promulgated (ISO) and its whole text."""
    own = [c for c in docs.columns if c != content]
    own = [c for c in own if c != "promulgated"]
    return docs.select(*own, F.explode(_clauses(F.col(content))).alias("c")).select(*own, X.iso_date("c.promulgated").alias("promulgated"), F.col("c.text").alias("clause_text"))


def case_id(case_no):
    return F.concat(F.lit("판례#"), X.strip(F.element_at(F.split(case_no, ","), 1)))


def cases(files: DataFrame, content: str = "content", path: str = "path", reasons: int = 1500) -> DataFrame:
    """Case rows; among files with the same first case number the first by path stays."""
    d = files.select(F.col(path).alias("_path"), F.from_xml(F.col(content), _CASE).alias("d"))
    field = lambda f: X.clean_markup(F.col(f"d.{f}"))
    body = field("판례내용")
    at = F.instr(body, "이유")
    rows = d.select(
        "_path",
        field("사건번호").alias("case_no"),
        X.iso_date(field("선고일자")).alias("decided"),
        field("사건명").alias("title"),
        field("참조조문").alias("ref_articles"),
        field("판시사항").alias("issues"),
        field("판결요지").alias("_h"),
        F.substring(body, F.greatest(at, F.lit(1)), F.lit(reasons)).alias("_r"),
    )
    rows = rows.select("_path", case_id(F.col("case_no")).alias("id"), "case_no", "decided", "title", "ref_articles", "issues", F.when(F.col("_h") != "", F.col("_h")).otherwise(F.col("_r")).alias("holding"), (F.col("_h") == "").alias("holding_from_reasons"))
    first = Window.partitionBy("id").orderBy("_path")
    return rows.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n", "_path")


def case_text():
    """A case as one text: header, issues, holding."""
    return F.concat(F.lit("[판례] 대법원 "), F.col("decided"), F.lit(" 선고 "), F.col("case_no"), F.lit(" 판결 ("), F.col("title"), F.lit(")\n[판시사항]\n"), F.col("issues"), F.lit("\n[판결요지]\n"), F.col("holding"))
