"""Records of delimited text files, in the order of the files, read by any number of tasks.

A file is read as lines, in splits. A quoted cell may hold line ends, so whether a line begins a record depends on the quotes before it in the file: each split counts its quotes, lines and bytes in
one pass, a small table with a row per split adds these up along each file, and with the sums of the splits before it every line knows whether it begins a record, its number and its byte offset. Lines that
make up a record alone, nearly all, are records as they are; only the others are grouped, by the offset of their record. No file goes through one task.

Each record has a key that orders the rows of all files: the file's name, and the byte offset at which it begins. A quote that is never closed makes the rest of its file one record, as it does for any
reader of such files. Line ends are \\n or \\r\\n; one \\r before a line's end is dropped outside quotes only at a record's end.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LINES = "file string, split long, nth long, quotes long, before long, bytes long, text string"


def _lines(spark: SparkSession, path: str, quote: str) -> DataFrame:
    """Every line with its split: nth line of the split, quotes in it, quotes and bytes of the split before it."""
    read = spark.read.text(path, lineSep="\n").select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"))

    def run(batches):
        here, lines, quotes, size = None, 0, 0, 0
        for batch in batches:
            names, starts = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            texts = batch.column(0)
            each = pc.count_substring(texts, quote).to_numpy().astype(np.int64)
            length = pc.binary_length(texts).to_numpy().astype(np.int64) + 1
            place = list(zip(names, starts, strict=True))
            ends = [k for k in range(1, len(place)) if place[k] != place[k - 1]]
            for a, b in zip([0, *ends], [*ends, len(place)], strict=True):
                if a == b:
                    continue
                if place[a] != here:
                    here, lines, quotes, size = place[a], 0, 0, 0
                before = quotes + np.cumsum(each[a:b]) - each[a:b]
                bytes_ = size + np.cumsum(length[a:b]) - length[a:b]
                columns = [batch.column(1).slice(a, b - a), batch.column(2).slice(a, b - a), pa.array(np.arange(lines, lines + b - a)), pa.array(each[a:b]), pa.array(before), pa.array(bytes_), texts.slice(a, b - a)]
                yield pa.RecordBatch.from_arrays(columns, ["file", "split", "nth", "quotes", "before", "bytes", "text"])
                lines, quotes, size = lines + b - a, quotes + int(each[a:b].sum()), size + int(length[a:b].sum())

    return read.select("value", "file", "split").mapInArrow(run, LINES)


def read_records(spark: SparkSession, path: str, quote: str = '"') -> DataFrame:
    """file, offset (byte of the file at which the record begins), line (its number in the file, from 1), record (its text, line ends in quotes included). Empty lines outside quotes are no records."""
    lines = _lines(spark, path, quote)
    splits = lines.groupBy("file", "split").agg(F.count("*").alias("lines"), F.sum("quotes").alias("in_split"), F.sum(F.octet_length("text") + 1).alias("size"))
    earlier = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)  # a row per split of the file
    so_far = lambda c: F.coalesce(F.sum(c).over(earlier), F.lit(0))
    begins = splits.select("file", "split", so_far("lines").alias("lines_before"), so_far("in_split").alias("quotes_before"), so_far("size").alias("bytes_before"))
    placed = lines.join(begins, ["file", "split"]).select(
        "file",
        "split",
        (F.col("lines_before") + F.col("nth") + 1).alias("line"),
        (F.col("bytes_before") + F.col("bytes")).alias("offset"),
        (F.pmod(F.col("quotes_before") + F.col("before"), F.lit(2)) == 0).alias("first"),
        (F.pmod(F.col("quotes_before") + F.col("before") + F.col("quotes"), F.lit(2)) == 0).alias("last"),
        "text",
    )
    alone = placed.filter("first AND last").select("file", "offset", "line", "text")
    return alone.unionByName(_grouped(placed.filter("NOT (first AND last)"))).select("file", "offset", "line", F.regexp_replace("text", "\r$", "").alias("record")).filter("record <> ''")


def _grouped(parts: DataFrame) -> DataFrame:
    """Lines of records of several lines, put together. The n-th line that begins such a record and the n-th that ends one belong together, so records are numbered by the beginnings up to a line."""
    per_split = parts.groupBy("file", "split").agg(F.count_if("first").alias("n"))
    earlier = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)  # a row per split of the file
    numbered = per_split.select("file", "split", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("records_before"))
    inside = Window.partitionBy("file", "split").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    own = parts.join(numbered, ["file", "split"]).withColumn("record_no", F.col("records_before") + F.sum(F.col("first").cast("int")).over(inside))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda x: x["text"]), "\n")
    return own.groupBy("file", "record_no").agg(F.min("offset").alias("offset"), F.min("line").alias("line"), joined.alias("text")).select("file", "offset", "line", "text")


def read_ordered(spark: SparkSession, path: str, width: int, separator: str = ",", header: bool = True, quote: str = '"') -> DataFrame:
    """As `ingest.read_delimited`, with line ends in quoted cells, and file, offset and line of every row: cells c0 ... as texts, their number in _cells where it isn't `width`."""
    separator = "\t" if separator == "tab" else separator
    found = read_records(spark, path, quote)
    if header:
        found = found.filter("offset > 0")  # a file's first record
    # One cell more than asked for takes what a long row has next.
    schema = ", ".join(f"c{k} string" for k in range(width))
    parsed = found.withColumn("_row", F.from_csv("record", schema, {"sep": separator, "quote": quote, "escape": quote, "mode": "PERMISSIVE"}))
    cells = F.size(F.split(F.regexp_replace("record", f'{quote}(?:[^{quote}]|{quote}{quote})*{quote}', ""), rf"\Q{separator}\E"))
    return parsed.select("file", "offset", "line", *[F.col("_row")[f"c{k}"].alias(f"c{k}") for k in range(width)], F.when(cells != width, cells).alias("_cells"))
