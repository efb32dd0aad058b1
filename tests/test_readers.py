"""CSV files whose types show late, against a plain reader."""

from __future__ import annotations

import math

import pandas as pd
import pytest

from fathomlake.sources import readers

KINDS = {"int64": "bigint", "float64": "double", "bool": "boolean", "object": "string", "str": "string", "string": "string"}


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    return value


def same_as_pandas(spark, path, text):
    path.write_text(text)
    theirs = pd.read_csv(path)
    ours = readers.csv(spark, str(path))
    kinds = dict(ours.dtypes)
    for c in theirs.columns:
        assert kinds[c] == KINDS[str(theirs[c].dtype)], c
    rows = [tuple(plain(v) for v in r) for r in theirs.astype(object).itertuples(index=False)]
    assert [tuple(r) for r in ours.collect()] == rows


def test_types_equal_those_of_pandas(spark, tmp_path):
    rows = [f"{i},{i},{i}.5,{i},True,{'true' if i % 2 else 'FALSE'},x{i},{i}e3,,-{i},\"a, \"\"{i}\"\"\"" for i in range(3000)]
    rows += ["3000,late,1,,False,TRUE,,NaN,,+7,b", "3001,2,inf,NA,True,true,null,1,,9223372036854775807,c"]
    same_as_pandas(spark, tmp_path / "a.csv", "whole,late_text,real,late_null,truth,truth2,text,power,empty,signed,quoted\n" + "\n".join(rows) + "\n")


def test_mixed_columns_are_text(spark, tmp_path):
    path = tmp_path / "b.csv"
    path.write_text("a,b,c,d\nTrue,1,99999999999999999999,1.5\n2,True,1, 7\n")
    df = readers.csv(spark, str(path))
    assert dict(df.dtypes) == {"a": "string", "b": "string", "c": "double", "d": "double"}
    assert [tuple(r) for r in df.collect()] == [("True", "1", 1e20, 1.5), ("2", "True", 1.0, 7.0)]


def test_truth_values_with_missing_ones_stay_truth_values(spark, tmp_path):
    path = tmp_path / "c.csv"
    path.write_text("a,b\nTrue,1\n,2\nfalse,3\n")
    df = readers.csv(spark, str(path))
    assert dict(df.dtypes) == {"a": "boolean", "b": "bigint"}
    assert [r["a"] for r in df.collect()] == [True, None, False]


def test_an_exported_index_can_be_dropped_and_a_header_alone_is_empty(spark, tmp_path):
    (tmp_path / "d.csv").write_text(",v\n0,1.5\n1,2\n")
    assert readers.csv(spark, str(tmp_path / "d.csv"), drop_index=True).columns == ["v"]
    assert readers.csv(spark, str(tmp_path / "d.csv"), "i int, v double", drop_index=False).count() == 2
    (tmp_path / "e.csv").write_text("v,w\n")
    df = readers.csv(spark, str(tmp_path / "e.csv"))
    assert df.collect() == [] and dict(df.dtypes) == {"v": "double", "w": "double"}


@pytest.mark.parametrize(("field", "kind"), [("0x10", "string"), ("1_000", "string"), ("1.", "double"), (".5", "double"), ("-Infinity", "double"), ("1e", "string"), ("#N/A", "double"), ("yes", "string")])
def test_single_fields(spark, tmp_path, field, kind):
    (tmp_path / "f.csv").write_text(f"v,w\n{field},1\n")
    assert dict(readers.csv(spark, str(tmp_path / "f.csv")).dtypes)["v"] == kind
