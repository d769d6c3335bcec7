"""Records of files with quoted line ends, in splits of any size."""

import csv
import io
import random

import pytest
from pyspark.sql import functions as F

from txnrules.sources import records


def content(seed, rows=400):
    rng = random.Random(seed)
    cells = ["plain", "two words", 'a "quoted" one', "line\nend", "a,b", "", "é", "x" * 70, "three\nline\n\nends", '"', "\r\n in it"]
    out = io.StringIO()
    writer = csv.writer(out, lineterminator="\n")
    data = [[str(k), rng.choice(cells), rng.choice(cells)] for k in range(rows)]
    for row in data:
        writer.writerow(row)
    return data, out.getvalue()


@pytest.mark.parametrize("size", ["64", "517", "1000000"])
def test_files_of_many_splits(spark, tmp_path, size):
    want = {}
    for name in ("a", "b"):
        want[name], text = content(name)
        (tmp_path / f"{name}.csv").write_bytes(("n,x,y\n" + text).encode())
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        read = records.read_ordered(spark, str(tmp_path), 3)
        parts = spark.read.text(str(tmp_path)).rdd.getNumPartitions()
        rows = read.orderBy("file", "offset").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])
    assert parts > {"64": 100, "517": 20, "1000000": 0}[size]
    for name in ("a", "b"):
        mine = [r for r in rows if r.file.endswith(f"{name}.csv")]
        assert [[r.c0, r.c1 or "", r.c2 or ""] for r in mine] == want[name]
        whole = (tmp_path / f"{name}.csv").read_bytes()
        assert all(whole[r.offset :].startswith(f"{r.c0},".encode()) and whole[: r.offset].count(b"\n") + 1 == r.line for r in mine) and {r._cells for r in mine} == {None}


def test_odd_files(spark, tmp_path):
    (tmp_path / "x.csv").write_bytes(b'h\r\n1,"a\r\nb",c\r\n\r\n2,short\r\n3,d,e,f\n4,"never closed\nto the end,\n')
    rows = records.read_ordered(spark, f"{tmp_path}/x.csv", 3).orderBy("offset").collect()
    assert [(r.c0, r.line, r._cells) for r in rows[:3]] == [("1", 2, None), ("2", 5, 2), ("3", 6, 4)] and rows[0].c1 == "a\r\nb" and rows[3].line == 7 and len(rows) == 4
    (tmp_path / "empty.csv").write_bytes(b"")
    assert records.read_records(spark, f"{tmp_path}/empty.csv").count() == 0
    firsts = records.read_records(spark, str(tmp_path)).groupBy("file").agg(F.min_by("record", "offset").alias("r")).collect()
    assert [r.r for r in firsts] == ["h"]
