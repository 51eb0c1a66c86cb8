"""Every query of the page operators against its SQL, over whole tables."""

import duckdb
import oracle
import pytest

from pagewright.plans import registry

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    return oracle.connect(sf_dir)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, sf_dir, con, name):
    oracle.assert_same(QUERIES[name](spark, sf_dir), con, SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_gives_rows(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


@pytest.mark.parametrize("part, whole", [(57, 800), (743, 800), (69, 800), (251, 800), (1, 32), (3, 160)])
def test_probe_garbled_rounds_near_ties_like_its_sql(spark, tmp_path, part, whole):
    """57 / 800 is, as a double, a little less than 0.07125."""
    pages = [(c, 0, "user", "." * (whole - part) + "b" * part) for c in (1, 2, 3)]
    spark.createDataFrame(pages, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    assert oracle.assert_same(QUERIES["probe_garbled"](spark, str(tmp_path)), con, SQL["probe_garbled"]) == 3


def test_font_coverage_rounds_near_ties_like_sql(spark):
    from pyspark.sql import functions as F

    from pagewright.operators import probe

    got = spark.range(801).select(F.col("id").cast("int").alias("bare"), probe.decide(F.lit(False), F.lit(99), F.lit(800), F.col("id").cast("int"), F.lit(0), F.lit(None).cast("struct<letter_digit_ratio:double,word_score:double,replacement_ratio:double>")).alias("d"))
    oracle.assert_same(got.select("bare", "d.font_unicode_coverage"), duckdb.connect(), "SELECT i::INT AS bare, round((800 - i) / 800, 4) AS font_unicode_coverage FROM range(801) t(i)")
