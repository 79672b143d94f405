"""Sources, contracts and the entry's guards."""

import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from textloom.functions import scalars as S
from textloom.operators import contracts, rows
from textloom.sources import tables


def test_csv_goes_by_its_header(spark, tmp_path):
    (tmp_path / "a.csv").write_text('﻿b,extra,a\n1,x,"two\nlines"\n,y,"q ""z"""\n', encoding="utf-8")
    got = tables.string_csv(spark, str(tmp_path / "a.csv"), ["a", "b", "missing"]).collect()
    assert [tuple(r) for r in got] == [("two\nlines", "1", ""), ('q "z"', "", "")]


def test_split_values_keeps_every_character(spark):
    assert spark.range(1).select(S.split_values(F.lit("0x; 1y ;;2z2")).alias("v")).first().v == ["0x", "1y", "2z2"]


def test_broken_contracts_raise(spark):
    left, right = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(1,), (1,)], "k int")
    with pytest.raises(ValueError, match="repeated_right.*unmapped_left"):
        contracts.holding(left, contracts.contract_of_many_to_one(left, right, ["k"]))
    assert contracts.holding(left, contracts.contract_of_one_to_one(left, left, ["k"])).count() == 2


def test_row_ids_and_flags(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, None), (4, " "), (5, "b")], "n int, given string")
    assert [r.row_id for r in rows.row_ids(df, "given", "n").orderBy("n").collect()] == ["a__row_1", "a__row_2", "row_3", "row_4", "b"]
    flags = spark.createDataFrame([("1",), ("1.0",), ("x",), (None,), ("2",)], "v string").select(rows.numeric_flag(F.col("v")).alias("f")).collect()
    assert [r.f for r in flags] == [True, True, False, False, False]


def test_the_entry_imports_without_the_subpackage(tmp_path):
    root = Path(__file__).resolve().parent.parent
    (tmp_path / "__spark_entry__.py").write_text((root / "__spark_entry__.py").read_text())
    (tmp_path / "textloom").mkdir()
    for part in ("__init__.py", "functions", "operators", "plans", "sources", "streaming"):
        (tmp_path / "textloom" / part).symlink_to(root / "textloom" / part)
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert 'q02_keyness_1gram' in q and not any(k.startswith('op') or k == 'pipeline' for k in q) and set(o) <= set(q)"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": f"{tmp_path}"} | {k: v for k, v in __import__("os").environ.items() if k in ("JAVA_HOME", "HOME")}, check=True)
