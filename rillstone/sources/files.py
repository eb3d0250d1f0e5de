"""Readers and writers: Markdown, JSON lines, spreadsheets, databases, indexes with a manifest."""

from __future__ import annotations

import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from rillstone.functions import text as X


def markdown(spark: SparkSession, folder: str, recursive: bool = False) -> DataFrame:
    """(source, text) of every Markdown file; an empty folder is an error."""
    rows = spark.read.option("recursiveFileLookup", str(recursive).lower()).option("pathGlobFilter", "*.md").text(folder, wholetext=True)
    found = rows.select(F.element_at(F.split("_metadata.file_path", "/"), -1).alias("source"), F.col("value").alias("text"))
    if found.isEmpty():
        raise FileNotFoundError(f"no Markdown in {folder}")
    return found


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def chunk_files(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Chunks of several folders, with the folder's name as document and a global id."""
    rows = spark.read.schema(schema).option("recursiveFileLookup", "true").json(path).withColumn("document", F.element_at(F.split("_metadata.file_path", "/"), -2))
    return rows.withColumn("global_chunk_id", F.concat_ws("::chunk_", "document", F.col("chunk_index").cast("string")))


def review_fields(text_rows: DataFrame, heading: str = r"(?m)(?=^## )", text_col: str = "text") -> DataFrame:
    """(key, fields) of review files: a section per heading, "- **name:** value" pairs as a map."""
    parts = text_rows.select(F.explode(F.split(text_col, heading)).alias("part")).where(F.col("part").rlike("^## "))
    pattern = F.lit(r"(?m)^- \*\*([^:*]+):?\*\*:?[ \t]*(.*)$")
    names = F.transform(F.regexp_extract_all("part", pattern, F.lit(1)), X.stripped)
    values = F.transform(F.regexp_extract_all("part", pattern, F.lit(2)), X.without_ticks)
    return parts.select(X.stripped(F.regexp_extract("part", r"^## (.*)", 1)).alias("key"), F.map_from_arrays(names, values).alias("fields"))


def database(spark: SparkSession, url: str, table: str, **options: str) -> DataFrame:
    return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()


def append_missing(fresh: DataFrame, path: str, keys: list[str]) -> int:
    """Append the rows whose keys the file does not have yet; how many there were."""
    spark = fresh.sparkSession
    try:
        have = spark.read.schema(fresh.schema).json(path).select(*keys)
        new = fresh.join(have, keys, "left_anti")
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        new = fresh
    new = new.cache()
    n = new.count()
    new.write.mode("append").json(path)
    new.unpersist()
    return n


def write_index(chunks: DataFrame, path: str, manifest: dict[str, str]) -> None:
    """Replace an index and its one-row manifest (fingerprint, model and the like)."""
    spark = chunks.sparkSession
    chunks.write.mode("overwrite").parquet(f"{path}/chunks")
    spark.createDataFrame([tuple(manifest.values())], ", ".join(f"{k} string" for k in manifest)).write.mode("overwrite").json(f"{path}/manifest")


def read_index(spark: SparkSession, path: str, manifest: dict[str, str]) -> DataFrame | None:
    """The index if its manifest is the expected one, else none."""
    try:
        rows = spark.read.json(f"{path}/manifest").collect()
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
            return None
        raise
    return spark.read.parquet(f"{path}/chunks") if rows and rows[0].asDict() == manifest else None


# -- spreadsheets ------------------------------------------------------------------------------

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def _cells(path: str) -> Iterator[tuple[str, int, int, str]]:
    """(sheet, row, column, text) of a workbook, from its XML."""
    with zipfile.ZipFile(path) as z:
        names = set(z.namelist())
        shared: list[str] = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in si.iter(f"{_MAIN}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{_MAIN}si")]
        for name in sorted(n for n in names if re.fullmatch(r"xl/worksheets/[^/]+\.xml", n)):
            for cell in ElementTree.fromstring(z.read(name)).iter(f"{_MAIN}c"):
                place = re.fullmatch(r"([A-Z]+)(\d+)", cell.get("r", ""))
                value = cell.find(f"{_MAIN}v")
                text = "".join(t.text or "" for t in cell.iter(f"{_MAIN}t")) if cell.get("t") == "inlineStr" else value.text or "" if value is not None else ""
                if cell.get("t") == "s" and text:
                    text = shared[int(text)]
                if place and text:
                    column = 0
                    for c in place[1]:
                        column = column * 26 + ord(c) - 64
                    yield name.rsplit("/", 1)[-1][:-4], int(place[2]), column, text


class _Book(InputPartition):
    def __init__(self, path: str) -> None:
        super().__init__(path)


class SpreadsheetReader(DataSourceReader):
    def __init__(self, paths: list[str]) -> None:
        self.paths = paths

    def partitions(self) -> list[_Book]:
        return [_Book(p) for p in self.paths]

    def read(self, partition: _Book) -> Iterator[tuple]:
        for sheet, row, column, text in _cells(partition.value):
            yield partition.value, sheet, row, column, text


class SpreadsheetSource(DataSource):
    """Cells of .xlsx workbooks, one partition a workbook; option path may list several, comma-separated."""

    @classmethod
    def name(cls) -> str:
        return "spreadsheet"

    def schema(self) -> str:
        return "path string, sheet string, row_no int, column_no int, value string"

    def reader(self, schema: T.StructType) -> SpreadsheetReader:
        return SpreadsheetReader([p for p in self.options["path"].split(",") if p])


def spreadsheet_rows(cells: DataFrame, headers: list[str], first_rows: int = 20) -> DataFrame:
    """Rows below the header row as maps from header to value: the header row is the first of a sheet that holds all headers."""
    top = cells.where(F.col("row_no") <= first_rows).groupBy("path", "sheet", "row_no").agg(F.collect_set(F.trim("value")).alias("have"))
    head = top.where(F.forall(F.array(*map(F.lit, headers)), lambda h: F.array_contains("have", h))).groupBy("path", "sheet").agg(F.min("row_no").alias("head_row"))
    names = cells.join(head, ["path", "sheet"]).where("row_no = head_row").select("path", "sheet", "column_no", F.trim("value").alias("name"))
    body = cells.join(head, ["path", "sheet"]).where("row_no > head_row").join(names, ["path", "sheet", "column_no"])
    return body.groupBy("path", "sheet", "row_no").agg(F.map_from_entries(F.collect_list(F.struct("name", F.trim("value")))).alias("fields"))
