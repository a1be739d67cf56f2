"""Readers for CSV files and workbooks, and writers for ordered CSV and JSON."""

from __future__ import annotations

import uuid

import re
import zipfile
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from partwright.functions import identifiers
from partwright.operators.profile import unique_headers

BOM = "﻿"


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file with quoted fields and line breaks in them: all texts, headers made usable, ``row_hash`` over the cells.

    Short rows are filled with nulls, cells beyond the header dropped; an empty file gives no columns
    but the hash; the byte order mark is no part of the first header.
    """
    options = {"multiLine": True, "quote": '"', "escape": '"', "mode": "PERMISSIVE", "encoding": "UTF-8", "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    head = spark.read.options(header=False, **options).csv(path).limit(1).collect()
    if not head:
        return spark.createDataFrame([], "row_hash string")
    names = unique_headers([(c or "").replace(BOM, "") if c is not None else None for c in head[0]])
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    df = spark.read.options(header=True, enforceSchema=True, **options).schema(schema).csv(path)
    return df.withColumn("row_hash", identifiers.row_hash(*[F.col(f"`{n}`") for n in names]))


_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def sheet_rows(path: str):
    """(sheet, row number, cells) of a workbook, cached values only, read from its XML."""
    with zipfile.ZipFile(path) as z:
        names = set(z.namelist())
        shared = []
        if "xl/sharedStrings.xml" in names:
            for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).findall("m:si", _NS):
                shared.append("".join(t.text or "" for t in si.iter(f"{{{_NS['m']}}}t")))
        rels = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        for sheet in ElementTree.fromstring(z.read("xl/workbook.xml")).find("m:sheets", _NS):
            target = rels[sheet.get(_REL)].lstrip("/")
            tree = ElementTree.fromstring(z.read(target if target.startswith("xl/") else f"xl/{target}"))
            for row in tree.iter(f"{{{_NS['m']}}}row"):
                cells: dict[int, str | None] = {}
                for c in row.findall("m:c", _NS):
                    column = 0
                    for ch in re.match("[A-Z]+", c.get("r") or "A").group():
                        column = column * 26 + ord(ch) - 64
                    value, kind = c.find("m:v", _NS), c.get("t")
                    if kind == "inlineStr":
                        cells[column] = "".join(t.text or "" for t in c.iter(f"{{{_NS['m']}}}t"))
                    elif value is not None and value.text is not None:
                        cells[column] = shared[int(value.text)] if kind == "s" else {"1": "true", "0": "false"}.get(value.text, value.text) if kind == "b" else value.text
                yield sheet.get("name"), int(row.get("r")), [cells.get(i) for i in range(1, max(cells, default=0) + 1)]


class _Workbook(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _WorkbookReader(DataSourceReader):
    def __init__(self, options):
        self.paths = [p for p in options.get("path", "").split(",") if p]

    def partitions(self):
        return [_Workbook(p) for p in self.paths]

    def read(self, partition):
        for sheet, no, cells in sheet_rows(partition.path):
            yield partition.path, sheet, no, cells


class WorkbookSource(DataSource):
    """``spark.read.format("workbook").load(paths)``: one row per sheet row, one task per file."""

    @classmethod
    def name(cls):
        return "workbook"

    def schema(self):
        return "path string, sheet string, row_number int, cells array<string>"

    def reader(self, schema):
        return _WorkbookReader(self.options)


def read_workbook(spark: SparkSession, *paths: str) -> DataFrame:
    """The rows of all sheets of the workbooks: ``path``, ``sheet``, ``row_number``, ``cells``."""
    spark.dataSource.register(WorkbookSource)
    return spark.read.format("workbook").load(",".join(paths))


# Fixed value: the rows of a sheet among which its header is looked for.
HEADER_ROWS = 10


def header_row(rows: DataFrame) -> DataFrame:
    """The header of each sheet: among its first HEADER_ROWS rows the one with most filled cells, the earliest on a tie."""
    n = F.size(F.filter("cells", lambda c: F.trim(c) != ""))
    first = rows.filter(F.col("row_number") <= HEADER_ROWS).select("path", "sheet", F.struct(n.alias("n"), (-F.col("row_number")).alias("r"), F.col("cells").alias("cells")).alias("h"))
    return first.groupBy("path", "sheet").agg(F.max_by("h", F.struct("h.n", "h.r")).alias("h")).filter("h.n > 0").select("path", "sheet", (-F.col("h.r")).alias("header_row"), F.col("h.cells").alias("headers"))


def file_facts(spark: SparkSession, *paths: str) -> DataFrame:
    """Size and SHA-256 of whole files: ``path``, ``length``, ``sha256``."""
    return spark.read.format("binaryFile").load(list(paths)).select("path", "length", F.sha2("content", 256).alias("sha256"))


def sitemap_links(df: DataFrame, key: str, body: str) -> DataFrame:
    """The locations a sitemap lists: key, ``kind`` (url or sitemap), ``place``, ``loc``; malformed bodies give none."""
    clean = F.regexp_replace(F.col(body), r"<!--.*?-->", "")
    kind = F.when(clean.rlike(r"<(\w+:)?urlset[\s>]"), "url").when(clean.rlike(r"<(\w+:)?sitemapindex[\s>]"), "sitemap")
    whole = clean.rlike(r"</(\w+:)?(urlset|sitemapindex)>\s*$")
    locs = F.regexp_extract_all(clean, F.lit(r"<(?:\w+:)?loc>\s*([^<\s]+)\s*</(?:\w+:)?loc>"), F.lit(1))
    return df.filter(whole & kind.isNotNull()).select(key, kind.alias("kind"), F.posexplode(locs).alias("_p", "loc")).select(key, "kind", (F.col("_p") + 1).alias("place"), F.replace("loc", F.lit("&amp;"), F.lit("&")).alias("loc"))


def write_ordered_csv(df: DataFrame, path: str, order: str) -> None:
    """CSV parts in the order of a column, each part a range of it; joined by name they are the ordered whole."""
    df.repartitionByRange(order).sortWithinPartitions(order).write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def upsert_parquet(df: DataFrame, path: str, keys: list[str], order: str) -> None:
    """Add a batch to a table: of each key the last version by ``order``, over what the table holds and the batch.

    The new state is written beside the table and then takes its place by renaming, so that readers of the
    old files and a run that fails halfway lose nothing.  A table that is not there yet is made.
    """
    from partwright.operators.timeline import latest

    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    every = spark.read.parquet(path).unionByName(df, allowMissingColumns=True) if fs.exists(at) else df
    new, old = (jvm.org.apache.hadoop.fs.Path(f"{path}.{kind}-{uuid.uuid4().hex}") for kind in ("new", "old"))
    latest(every, keys, [order]).write.parquet(new.toString())
    if fs.exists(at) and not fs.rename(at, old):
        raise OSError(f"{path} could not be moved")
    if not fs.rename(new, at):
        fs.rename(old, at)
        raise OSError(f"{path} could not be replaced")
    fs.delete(old, True)
