"""The driver contract at the smallest scale."""

import duckdb
import pytest
from pathlib import Path

from __spark_entry__ import entry, oracle_sql, queries
from folioscore.queries import load

# One or two queries of each kind; the whole set is compared by check.py.
SAMPLE = ["a17_slice_metrics", "w4_writer_split", "w11_transitions", "p13_contract_rules", "w14_blur_variance", "st5_request_counts"]


def test_every_query_has_an_oracle():
    own, sql = load()
    assert set(sql) == set(own)
    assert set(own) <= set(queries()) and set(sql) <= set(oracle_sql())


def test_entry(spark, small):
    df = entry(spark)
    assert df.count() > 0 and "cer" in df.columns


@pytest.mark.parametrize("name", SAMPLE)
def test_against_the_oracle(spark, small, name):
    con = duckdb.connect()
    for path in Path(small).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    want = con.execute(oracle_sql()[name]).df()
    got = queries()[name](spark, small).toPandas()
    columns = sorted(want.columns)
    assert columns == sorted(got.columns)
    as_rows = lambda df: sorted(map(repr, df[columns].astype(object).values.tolist()))
    assert as_rows(got) == as_rows(want)
