"""Sizes and times in words, against Python's own formats and the query's SQL."""

import duckdb
import pytest
from pyspark.sql import functions as F

from winnow.functions import text as t
from winnow.plans import queries

SIZES = [None, 0, 59, 60, 1023, 1024, 1535, 1536, 2559, 2560, 2561, 3584, 131_584, (1 << 20) - 1, 1 << 20, (1 << 20) + (1 << 18), (1 << 20) + 3 * (1 << 18), (1 << 30) - 1, 1 << 30, (1 << 30) + (1 << 27), (1 << 30) + 3 * (1 << 27)]


def plain(n):
    if n is None:
        return None
    return f"{n} B" if n < 1 << 10 else f"{n / (1 << 10):.0f} KB" if n < 1 << 20 else f"{n / (1 << 20):.1f} MB" if n < 1 << 30 else f"{n / (1 << 30):.2f} GB"


def test_halves_of_a_size_go_to_the_even_digit(spark):
    df = spark.createDataFrame([(n,) for n in SIZES], "n bigint")
    assert [(r.n, r.s) for r in df.select("n", t.byte_text(F.col("n")).alias("s")).collect()] == [(n, plain(n)) for n in SIZES]
    assert df.where("n is null").select(t.duration_text(F.col("n"))).first()[0] is None


@pytest.mark.parametrize("largest", ["KB", "MB"])
def test_no_unit_above_the_largest(spark, largest):
    got = spark.createDataFrame([(n,) for n in SIZES], "n bigint").select("n", t.byte_text(F.col("n"), largest).alias("s")).collect()
    for n, s in got:
        high = n is not None and n >= (1 << 20 if largest == "KB" else 1 << 30)
        assert s == (f"{n / (1 << 10):.0f} KB" if largest == "KB" else f"{n / (1 << 20):.1f} MB") if high else s == plain(n)


def test_size_text_equals_its_sql(spark, tmp_path):
    spark.createDataFrame([(i, n) for i, n in enumerate(SIZES)], "doc_id bigint, n_chars bigint").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.sql(queries.SQL["size_text"]).fetchall()
    assert sorted(map(tuple, queries.size_text(spark, str(tmp_path)).collect())) == sorted(want)
