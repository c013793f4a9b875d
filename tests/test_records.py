"""Exports read in pieces: quoted line breaks across them, and records that are no rows."""

import csv
import io
import random

import pytest
from test_donors import HEADER

from civictally.sources import files
from civictally.sources.records import read_csv, read_lines

GOOD = '01/05/2024,"Lokmedil, Tariq",Baker,Oven Co,Friends of Nobody 2024,31,01/01/2024,06/30/2024,10.00,Monetary,11/05/2024'


def test_malformed_records_are_rejected(spark, tmp_path):
    wide, short = GOOD + ",twelfth", '02/01/2024,"Lokmedil, Tariq,Baker,Oven Co,Friends'
    (tmp_path / "c.csv").write_bytes(("﻿" + "\r\n".join([HEADER, short, wide, GOOD, "", 'x"y' + GOOD, GOOD.replace("Baker", '"Baker ""Bob""\r\nand sons"')]) + "\r\n").encode())
    rows = files.read_contributions(spark, str(tmp_path / "c.csv")).orderBy("seq").collect()
    assert [(r.contributor, r.contrib_occupation, r.election_date) for r in rows] == [
        ("Lokmedil, Tariq", "Baker", "11/05/2024"), ("Lokmedil, Tariq", 'Baker "Bob"\r\nand sons', "11/05/2024"),
    ]
    bad = files.rejected_contributions(spark, str(tmp_path / "c.csv")).orderBy("seq").collect()
    assert [r.reason for r in bad] == ["quoting", "column_count", "quoting"] and bad[1].line.rstrip("\r") == wide


@pytest.mark.parametrize("size", [30, 97, 1 << 20])
def test_pieces_of_any_size_give_the_same_rows(spark, tmp_path, size):
    rng = random.Random(3)
    words = ["a", "b,c", 'say "no"', "two\nlines", "\n\n", "", "é,\n\"x\"\n", "plain"]
    tables = [[[rng.choice(words) + str(rng.randrange(99)) for _ in range(3)] for _ in range(60)] for _ in range(2)]
    for i, t in enumerate(tables):
        out = io.StringIO()
        csv.writer(out, lineterminator="\n").writerows([["x", "y", "z"], *t])
        (tmp_path / f"{i}.csv").write_text(out.getvalue())
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        rows, bad = read_csv(spark, str(tmp_path), ("x", "y", "z"), "seq")
        got = [[r.x, r.y, r.z] for r in rows.orderBy("seq").collect()]
        assert got == tables[0] + tables[1] and bad.count() == 0
        assert read_lines(spark, str(tmp_path), 3).rdd.getNumPartitions() > (4 if size < 100 else 0)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_empty_files(spark, tmp_path):
    (tmp_path / "e.csv").write_text("")
    (tmp_path / "h.csv").write_text(HEADER)
    assert files.read_contributions(spark, str(tmp_path)).count() == 0
