"""Input files by extension and magic bytes, and exports."""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Extensions of each kind of input.
EXTENSIONS = {"pdf": ["pdf"], "cad": ["dwg", "dxf"], "image": ["jpg", "jpeg", "png", "bmp", "tiff"]}
LARGEST = 100 << 20
FORMS = ("json", "csv", "parquet", "text")
#: A byte-order mark, by which spreadsheet programs know UTF-8.
MARK = "﻿"


def kind_of(path: Column) -> Column:
    extension = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    found = F.lit("unsupported")
    for kind, values in EXTENSIONS.items():
        found = F.when(extension.isin(values), kind).otherwise(found)
    return found


def _plain(path: Column) -> Column:
    return F.regexp_replace(path, "^file:/+", "file:/")


def scan(spark: SparkSession, folder: str) -> DataFrame:
    """path, length, kind and errors of each file, empty ones too. First bytes are read of PDF files alone, up to LARGEST bytes long."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    listed = files.load(folder)
    names = spark.createDataFrame([(unquote(p),) for p in listed.inputFiles()], "path string").select(_plain(F.col("path")).alias("path"))  # Spark's reader skips empty files
    lengths = listed.select(_plain(F.col("path")).alias("path"), "length")
    heads = files.option("pathGlobFilter", "*.[pP][dD][fF]").load(folder).where(F.col("length") <= LARGEST).select(_plain(F.col("path")).alias("path"), F.substring("content", 1, 4).alias("head"))
    rows = names.join(lengths, "path", "left").join(heads, "path", "left").select("path", F.coalesce("length", F.lit(0).cast("long")).alias("length"), kind_of(F.col("path")).alias("kind"), "head")
    tests = {
        "empty file": F.col("length") == 0,
        "file too large": F.col("length") > LARGEST,
        "unsupported type": F.col("kind") == "unsupported",
        "not a PDF": (F.col("kind") == "pdf") & F.col("length").between(1, LARGEST) & ~F.col("head").eqNullSafe(F.lit(b"%PDF")),
    }
    errors = F.array_compact(F.array(*[F.when(bad, F.lit(name)) for name, bad in tests.items()]))
    return rows.select("path", "length", "kind", errors.alias("errors"))


def export(rows: DataFrame, folder: str, form: str = "json", by: str | None = None, mark: bool = False) -> None:
    """Writes rows as json, csv, parquet or lines of text, in a folder for each value of ``by``. mark: csv files begin with a byte-order mark."""
    if form not in FORMS:
        raise ValueError(f"unknown form: {form}")
    if form == "csv" and mark:
        first = next(c for c in rows.columns if c != by)
        rows = rows.select(F.col(first).alias(MARK + first), *[c for c in rows.columns if c != first])
    writer = rows.write.mode("errorifexists").format(form)
    if form == "csv":
        writer = writer.option("header", "true")
    (writer.partitionBy(by) if by else writer).save(folder)


def export_all(rows: DataFrame, folder: str, forms: list[str]) -> list[dict]:
    """Exports to a folder for each form; a record of each, with the error of one that isn't known."""
    out = []
    for form in forms:
        try:
            export(rows, f"{folder}/{form}", form)
            out.append({"form": form, "path": f"{folder}/{form}", "error": None})
        except ValueError as e:
            out.append({"form": form, "path": None, "error": str(e)})
    return out


def export_sheets(rows: DataFrame, folder: str, books: str) -> None:
    """Writes rows of workbooks (``books``, sheet, place, cells) as lines of cells, a folder for each sheet's name.

    Rows are range-partitioned by book, sheet and place, so a sheet of any length is spread; its lines are in order
    in a file, and its files in the order of their names.
    """
    order = [books, "sheet", "place"]
    rows.repartitionByRange(*order).sortWithinPartitions("sheet", books, "place").select(books, "sheet", "place", "cells").write.mode("errorifexists").partitionBy("sheet").csv(folder)


def report_lines(rows: DataFrame, title: str) -> DataFrame:
    """Rows as lines of a report, ``column: value`` joined by semicolons, under a title: a column value, in two partitions at least."""
    line = F.concat_ws("; ", *[F.concat(F.lit(f"{c}: "), F.coalesce(F.col(c).cast("string"), F.lit("-"))) for c in rows.columns])
    head = rows.sparkSession.createDataFrame([(f"# {title}",)], "value string")
    return head.union(rows.select(line.alias("value")))
