"""Every query with SQL gives DuckDB's rows on the smallest tables."""

import math
from pathlib import Path

import duckdb
import numpy as np
import pandas as pd
import pytest

from pageframe.plans import ORACLES, QUERIES

SF = Path("/root/testdata/sf0.001")


def plain(v):
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, (list, tuple, np.ndarray)):
        return tuple(map(plain, v))
    if isinstance(v, (bool, np.bool_)):
        return bool(v)
    if isinstance(v, (int, float, np.integer, np.floating)):
        return round(float(v), 6)
    return str(v)


def rows(df):
    return sorted((tuple(map(plain, r)) for r in df[sorted(df.columns)].itertuples(index=False, name=None)), key=repr)


@pytest.fixture(scope="module")
def duck():
    if not SF.exists():
        pytest.skip("no test tables here")
    con = duckdb.connect()
    for p in SF.glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, str(SF)).toPandas()
    if name in ORACLES:
        assert rows(got) == rows(duck.sql(ORACLES[name]).df())
    else:
        assert len(got)


@pytest.mark.parametrize("name", ["b1_merge_docs", "b9_select_parity", "b10_duplicate_pages", "b17_organize", "b17_add_source", "b18_assemble"])
def test_outputs_of_one_document_and_without_text(spark, tmp_path, name):
    texts = ["a\nb", None, "c", "", "d\ne\nf\ng", "h", None, "i\nj", "k\nl\nm"]  # the last output has one document
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert rows(QUERIES[name](spark, str(tmp_path)).toPandas()) == rows(con.sql(ORACLES[name]).df())


@pytest.mark.parametrize("name", ["f2_invert", "f3_ink_ratio", "f4_crop", "f7_search_variant"])
def test_images_reach_python_few_at_a_time(spark, name):
    made = QUERIES[name](spark, str(SF))
    assert int(made.sparkSession.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 64
