"""Every query equals its SQL on the smallest tables, and the others give rows."""

from __future__ import annotations

import itertools

import pytest
from pyspark.sql import functions as F

from quillmill.functions import text as T
from quillmill.queries import ORACLES, QUERIES

from .oracle import SF, duckdb, rows, sql_rows


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    df = QUERIES[name](spark, SF)
    if name in ORACLES:
        assert rows(df) == sql_rows(ORACLES[name])
    else:
        assert df.count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 200
    assert set(e.oracle_sql()) <= set(e.queries())


def test_quote_block_of_odd_texts(spark, tmp_path):
    """Empty texts, and lines of any white space alone, are quoted as in SQL; nothing that was said stays nothing."""
    texts = [None, *("".join(p) for n in range(4) for p in itertools.product("a\n\r\t\v\f \x1c\x85\xa0\u2028", repeat=n))]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    found = rows(QUERIES["quote_block"](spark, str(tmp_path)))
    assert len(found) == len(texts) and found == sql_rows(ORACLES["quote_block"], con=con)
    assert spark.range(1).select(T.quote_block(F.lit(""))).first()[0] == ""
