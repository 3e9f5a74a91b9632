"""Queries on larger tables than the given ones."""

import duckdb

import __spark_entry__ as entry


def test_uploads_above_the_range_of_an_int(spark, tmp_path):
    """A page of 60,000 characters counts as a file of 2.4 GB."""
    pages = [(i, f"u{i}", "x" * n) for i, n in enumerate([60_000, 100, 60_000, 0, 1_310, 1_311])]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = sorted(tuple(r) for r in entry.queries()["screen_upload"](spark, str(tmp_path)).select("page_id", "ok", "reason").collect())
    with duckdb.connect() as con:
        con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
        expected = con.execute(f"SELECT page_id, ok, reason FROM ({entry.oracle_sql()['screen_upload']})").fetchall()
    assert got == sorted(expected) and [r[1] for r in got] == [False, True, False, False, True, False]
