"""Learners read tables that come out of a join."""

import pytest

import __spark_entry__ as entry


@pytest.fixture
def merge_joins(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_all_learners_fit_on_a_merge_join(spark, merge_joins, tmp_path):
    """K-means zips its input with itself: a sort-merge join run twice in one task loses its sorter."""
    orders = spark.range(200).selectExpr("id AS o_orderkey", "CAST(id AS DOUBLE) AS o_totalprice")
    lines = spark.range(200).selectExpr(
        "id AS l_orderkey", "explode(sequence(0, id % 5)) AS l_linenumber", "CAST(id * 7 % 60 AS DOUBLE) AS l_quantity",
        "CAST(id * 1009 % 70000 AS DOUBLE) AS l_extendedprice", "CAST(id % 11 AS DOUBLE) / 100 AS l_discount",
    )
    orders.write.parquet(f"{tmp_path}/orders.parquet")
    lines.write.parquet(f"{tmp_path}/lineitem.parquet")
    found = {r["model"]: r["value"] for r in entry.queries()["p10_svm_bayes_perceptron_kmeans"](spark, str(tmp_path)).collect()}
    assert set(found) == {"svm", "bayes", "perceptron", "svm_many", "kmeans"}
    assert found["kmeans"] > 0 and all(0 < found[k] <= 1 for k in ("svm", "bayes", "perceptron", "svm_many"))
