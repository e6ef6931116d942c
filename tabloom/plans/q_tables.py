"""Scans and sinks, projections and filters, set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import impute, relational as rel
from ..operators.stages import load_fitted
from ..sources import tables as src
from ..sources.tables import table
from .registry import fixture, hash_sql, query, rnd

CUSTOMER = "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer"


@query("a01_csv_scan", CUSTOMER)
def _(spark, sf):
    path = src.write_delimited(table(spark, sf, "customer"), src.scratch_path(spark, "a01"))
    return src.delimited(spark, path).withColumn("c_custkey", F.col("c_custkey").cast("long"))


@query("a02_pruned_scan", "SELECT o_orderkey, o_totalprice FROM orders")
def _(spark, sf):
    return table(spark, sf, "orders", ["o_orderkey", "o_totalprice"])


@query("a03_first_rows", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 1000")
def _(spark, sf):
    return src.first_rows(table(spark, sf, "orders", ["o_orderkey", "o_custkey", "o_totalprice"]), 1000, ["o_orderkey"])


@query("a04_declared_schema", "SELECT o_orderkey, o_totalprice, o_orderpriority FROM orders")
def _(spark, sf):
    schema = "o_orderkey long, o_totalprice double, o_orderpriority string"
    rows = table(spark, sf, "orders", ["o_orderkey", "o_totalprice", "o_orderpriority"])
    return src.delimited(spark, src.write_delimited(rows, src.scratch_path(spark, "a04")), schema=schema)


@query("a05_tab_separated", "SELECT p_partkey, p_name, p_retailprice FROM part")
def _(spark, sf):
    rows = table(spark, sf, "part", ["p_partkey", "p_name", "p_retailprice"])
    path = src.write_delimited(rows, src.scratch_path(spark, "a05"), sep="\t")
    return src.delimited(spark, path, sep="\t", schema="p_partkey long, p_name string, p_retailprice double")


@query(
    "a06_inline_table",
    """WITH names(status, meaning) AS (VALUES ('F', 'finished'), ('O', 'open'), ('P', 'partial'))
       SELECT o_orderkey, meaning FROM orders LEFT JOIN names ON o_orderstatus = status""",
)
def _(spark, sf):
    names = src.inline(spark, [("F", "finished"), ("O", "open"), ("P", "partial")], "o_orderstatus string, meaning string")
    return table(spark, sf, "orders").join(names, "o_orderstatus", "left").select("o_orderkey", "meaning")


@query("a07_drop_unnamed", CUSTOMER)
def _(spark, sf):
    rows = table(spark, sf, "customer")
    written = rows.select(F.col("c_custkey").alias("Unnamed: 0"), *rows.columns)
    path = src.write_delimited(written, src.scratch_path(spark, "a07"))
    schema = "`Unnamed: 0` long, c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"
    return src.drop_unnamed(src.delimited(spark, path, schema=schema))


@query("a08_csv_sink", "SELECT o_orderkey AS id, CASE WHEN o_totalprice > 250000 THEN 1 ELSE 0 END AS prediction FROM orders")
def _(spark, sf):
    scored = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"), F.when(F.col("o_totalprice") > 250000, 1).otherwise(0).alias("prediction")
    )
    path = src.write_delimited(scored, src.scratch_path(spark, "a08"))
    return src.delimited(spark, path, schema="id long, prediction int")


@query("a09_table_sink", "SELECT id, q, n, RND(d) AS d FROM fx_num")
def _(spark, sf):
    built = fixture(spark, sf, "fx_num").select("id", "q", "n", rnd("d").alias("d"))
    return spark.read.parquet(src.write_table(built, src.scratch_path(spark, "a09")))


@query(
    "a10_state_round_trip",
    "SELECT id, RND(coalesce(x, (SELECT avg(x) FROM fx_miss WHERE split = 'train'))) AS x FROM fx_miss",
)
def _(spark, sf):
    df = fixture(spark, sf, "fx_miss")
    fitted = impute.MeanMedian("mean", ["x"]).fit(df.where("split = 'train'"))
    back = load_fitted(spark, fitted.save(src.scratch_path(spark, "a10")))
    return back.transform(df).select("id", rnd("x").alias("x"))


@query("a11_feature_list", "SELECT id, n, q FROM fx_num")
def _(spark, sf):
    path = src.save_features(spark, ["id", "q", "n"], src.scratch_path(spark, "a11"))
    return fixture(spark, sf, "fx_num").select(*src.load_features(spark, path))


@query(
    "a12_table_profile",
    """SELECT 0 AS position, 'id' AS variable, 'bigint' AS dtype, count(*) AS n_rows, count(*) - count(id) AS n_null FROM fx_miss
       UNION ALL SELECT 1, 'x', 'double', count(*), count(*) - count(x) FROM fx_miss
       UNION ALL SELECT 2, 'c', 'string', count(*), count(*) - count(c) FROM fx_miss""",
)
def _(spark, sf):
    return src.profile(fixture(spark, sf, "fx_miss").select("id", "x", "c"))


# ---------------------------------------------------------------- projections and filters


@query("b01_filter", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 400000")
def _(spark, sf):
    return table(spark, sf, "orders").where(F.col("o_totalprice") > 400000).select("o_orderkey", "o_totalprice")


@query(
    "b02_range_filter",
    "SELECT id, lat, lon FROM fx_geo WHERE lat > 13.2 AND lat < 13.7 AND lon > 100.1 AND lon < 100.9",
)
def _(spark, sf):
    return fixture(spark, sf, "fx_geo").where("lat > 13.2 and lat < 13.7 and lon > 100.1 and lon < 100.9")


@query("b03_null_filter", "SELECT id, c, x IS NULL AS x_missing FROM fx_miss WHERE x IS NULL OR c IS NOT NULL")
def _(spark, sf):
    df = fixture(spark, sf, "fx_miss")
    return df.where(F.col("x").isNull() | F.col("c").isNotNull()).select("id", "c", F.col("x").isNull().alias("x_missing"))


@query("b04_membership", "SELECT o_orderkey FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')")
def _(spark, sf):
    return table(spark, sf, "orders").where(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")).select("o_orderkey")


@query("b05_two_branches", "SELECT o_orderkey, CASE WHEN o_orderstatus IN ('F', 'P') THEN 1 ELSE 0 END AS shipped FROM orders")
def _(spark, sf):
    flag = F.when(F.col("o_orderstatus").isin("F", "P"), 1).otherwise(0)
    return table(spark, sf, "orders").select("o_orderkey", flag.alias("shipped"))


QUANTITY_TEXT = "CASE WHEN l_quantity < 10 THEN 'small lot' WHEN l_quantity < 40 THEN 'usual lot' ELSE 'bulk' END"


@query("b06_case_text", f"SELECT l_orderkey, l_linenumber, l_quantity, {QUANTITY_TEXT} AS quantity_text FROM lineitem")
def _(spark, sf):
    return spark.sql(
        f"SELECT l_orderkey, l_linenumber, l_quantity, {QUANTITY_TEXT} AS quantity_text FROM {{lines}}",
        lines=table(spark, sf, "lineitem"),
    )


@query(
    "b07_merge_labels",
    "SELECT o_orderkey, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'FAST' ELSE o_orderpriority END AS priority FROM orders",
)
def _(spark, sf):
    merged = rel.merge_labels(F.col("o_orderpriority"), ["1-URGENT", "2-HIGH"], "FAST")
    return table(spark, sf, "orders").select("o_orderkey", merged.alias("priority"))


@query("b08_ratio", "SELECT id, RND(p / nullif(q, 0)) AS price_per_unit, RND2(q / nullif(d, 0)) AS q_per_d FROM fx_num")
def _(spark, sf):
    return fixture(spark, sf, "fx_num").select(
        "id",
        rnd(rel.ratio(F.col("p"), F.col("q"))).alias("price_per_unit"),
        rnd(rel.ratio(F.col("q"), F.col("d")), 2).alias("q_per_d"),
    )


@query(
    "b09_positive_difference",
    """SELECT l_orderkey, l_linenumber, l_shipdate,
              CAST(greatest(date_diff('day', o_orderdate, l_shipdate), 0) AS INTEGER) AS days_late,
              CAST(greatest(date_diff('day', l_shipdate, o_orderdate), 0) AS INTEGER) AS days_early
       FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
)
def _(spark, sf):
    joined = table(spark, sf, "lineitem").join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.select(
        "l_orderkey",
        "l_linenumber",
        "l_shipdate",
        rel.positive_part(F.datediff("l_shipdate", "o_orderdate")).alias("days_late"),
        rel.positive_part(F.datediff("o_orderdate", "l_shipdate")).alias("days_early"),
    )


@query("b10_sentinel_to_null", "SELECT p_partkey, nullif(p_size, 50) AS size FROM part")
def _(spark, sf):
    return table(spark, sf, "part").select("p_partkey", rel.sentinel_to_null(F.col("p_size"), 50).alias("size"))


@query("b11_range_to_null", "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN NULL ELSE c_acctbal END AS balance FROM customer")
def _(spark, sf):
    return table(spark, sf, "customer").select(
        "c_custkey", rel.out_of_range_to_null(F.col("c_acctbal"), low=0).alias("balance")
    )


@query("b12_drop_columns", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def _(spark, sf):
    return table(spark, sf, "orders").drop("o_orderstatus", "o_orderdate", "o_orderpriority")


@query("b13_columns_by_type", "SELECT p_partkey, p_size, p_retailprice FROM part")
def _(spark, sf):
    df = table(spark, sf, "part")
    return df.select(*rel.columns_of_type(df, "number"))


@query(
    "b14_flat_names",
    """SELECT o_custkey, min(o_totalprice) AS ORD_o_totalprice_min, max(o_totalprice) AS ORD_o_totalprice_max,
              RND(avg(o_totalprice)) AS ORD_o_totalprice_mean FROM orders GROUP BY o_custkey""",
)
def _(spark, sf):
    from ..operators.profile import stat_exprs

    out = table(spark, sf, "orders").groupBy("o_custkey").agg(*stat_exprs({"o_totalprice": ["min", "max", "mean"]}, "ORD_"))
    return out.withColumn("ORD_o_totalprice_mean", rnd("ORD_o_totalprice_mean"))


@query("b15_cast", "SELECT p_partkey, CAST(p_size AS VARCHAR) AS size_text, CAST(p_size AS DOUBLE) AS size_number FROM part")
def _(spark, sf):
    return table(spark, sf, "part").select(
        "p_partkey", F.col("p_size").cast("string").alias("size_text"), F.col("p_size").cast("double").alias("size_number")
    )


@query("b16_lenient_cast", "SELECT id, TRY_CAST(ticket AS DOUBLE) AS ticket_number FROM fx_mixed")
def _(spark, sf):
    return fixture(spark, sf, "fx_mixed").select("id", rel.lenient_number(F.col("ticket")).alias("ticket_number"))


@query(
    "b17_replace_values",
    "SELECT p_partkey, CASE p_type WHEN 'SMALL' THEN '0' WHEN 'MEDIUM' THEN '1' WHEN 'LARGE' THEN '2' ELSE p_type END AS p_type FROM part",
)
def _(spark, sf):
    return table(spark, sf, "part", ["p_partkey", "p_type"]).replace(["SMALL", "MEDIUM", "LARGE"], ["0", "1", "2"], "p_type")


@query(
    "b18_recode",
    "SELECT p_partkey, CASE p_type WHEN 'SMALL' THEN 'low' WHEN 'MEDIUM' THEN 'mid' WHEN 'LARGE' THEN 'high' END AS size_class FROM part",
)
def _(spark, sf):
    classes = {"SMALL": "low", "MEDIUM": "mid", "LARGE": "high"}
    return table(spark, sf, "part").select("p_partkey", rel.recode(F.col("p_type"), classes).alias("size_class"))


@query("b19_dedupe", "SELECT DISTINCT l_returnflag, l_linestatus, l_discount FROM lineitem")
def _(spark, sf):
    return table(spark, sf, "lineitem", ["l_returnflag", "l_linestatus", "l_discount"]).dropDuplicates()


@query("b20_drop_null_rows", "SELECT id, x, c, y, w, split FROM fx_miss WHERE x IS NOT NULL AND c IS NOT NULL")
def _(spark, sf):
    return fixture(spark, sf, "fx_miss").dropna(subset=["x", "c"])


@query("b21_drop_sparse_columns", "SELECT id, c, y, w, split FROM fx_miss")
def _(spark, sf):
    return rel.drop_sparse_columns(fixture(spark, sf, "fx_miss"), 0.18)


@query(
    "b22_seeded_sample",
    f"SELECT o_orderkey, o_totalprice FROM orders ORDER BY {hash_sql(42, 'o_orderkey')}, o_orderkey LIMIT 500",
)
def _(spark, sf):
    return rel.sample_rows(table(spark, sf, "orders", ["o_orderkey", "o_totalprice"]), 500, ["o_orderkey"], seed=42)


@query("b23_sorted_columns", "SELECT c_acctbal, c_custkey, c_mktsegment, c_name, c_nationkey FROM customer")
def _(spark, sf):
    return rel.sorted_columns(table(spark, sf, "customer"))


DERIVED = """SELECT priority, count(*) AS total FROM (
    SELECT CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'FAST' ELSE o_orderpriority END AS priority
    FROM {orders}) d GROUP BY priority"""


@query("b24_derived_table", DERIVED.replace("{orders}", "orders"))
def _(spark, sf):
    return spark.sql(DERIVED, orders=table(spark, sf, "orders"))


@query(
    "b25_domain_flag",
    "SELECT p_partkey, CASE WHEN p_type = 'PROMO' AND p_size >= 10 AND p_retailprice > 1000 THEN 1 ELSE 0 END AS big_promo FROM part",
)
def _(spark, sf):
    hit = (F.col("p_type") == "PROMO") & (F.col("p_size") >= 10) & (F.col("p_retailprice") > 1000)
    return table(spark, sf, "part").select("p_partkey", F.when(hit, 1).otherwise(0).alias("big_promo"))


@query("b26_sum_of_columns", "SELECT id, q + n + 1 AS load FROM fx_num")
def _(spark, sf):
    return fixture(spark, sf, "fx_num").select("id", (F.col("q") + F.col("n") + 1).alias("load"))


@query("b27_threshold_target", "SELECT o_orderkey, CASE WHEN o_totalprice > 250000 THEN 1 ELSE 0 END AS high FROM orders")
def _(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_totalprice") > 250000, 1).otherwise(0).alias("high"))


# ---------------------------------------------------------------- set operations


@query(
    "f01_union_by_name",
    "SELECT id, price, priority FROM fx_even UNION ALL SELECT id, price, NULL FROM fx_odd",
)
def _(spark, sf):
    return rel.stack_tables(fixture(spark, sf, "fx_even"), fixture(spark, sf, "fx_odd"))


@query(
    "f02_new_columns",
    "SELECT 'label_missing' AS feature, count(*) AS n_rows FROM fx_miss UNION ALL SELECT 'x_missing', count(*) FROM fx_miss",
)
def _(spark, sf):
    df = fixture(spark, sf, "fx_miss")
    wide = df.withColumns({"x_missing": F.col("x").isNull(), "label_missing": F.col("c").isNull()})
    names = rel.new_columns(wide, df.columns)
    return wide.agg(F.count(F.lit(1)).alias("n_rows")).select(
        F.explode(F.array(*[F.lit(n) for n in names])).alias("feature"), "n_rows"
    )


@query(
    "f03_tagged_union",
    "SELECT id, price, priority, 1 AS is_train FROM fx_even UNION ALL SELECT id, price, NULL, 0 FROM fx_odd",
)
def _(spark, sf):
    return rel.tagged_union(fixture(spark, sf, "fx_even"), fixture(spark, sf, "fx_odd"))


@query("f04_align_columns", "SELECT o_orderkey, o_totalprice, 0 AS o_orderstatus_X FROM orders")
def _(spark, sf):
    return rel.align_columns(table(spark, sf, "orders"), ["o_orderkey", "o_totalprice", "o_orderstatus_X"])


# ---------------------------------------------------------------- text functions


@query("g01_first_number", "SELECT id, CAST(nullif(regexp_extract(cabin, '(\\d+)', 1), '') AS DOUBLE) AS cabin_number, CAST(nullif(regexp_extract(ticket, '(\\d+)', 1), '') AS DOUBLE) AS ticket_number FROM fx_mixed")
def _(spark, sf):
    return fixture(spark, sf, "fx_mixed").select(
        "id",
        text.first_number(F.col("cabin")).alias("cabin_number"),
        text.first_number(F.col("ticket")).alias("ticket_number"),
    )


@query("g02_first_char", "SELECT id, substr(cabin, 1, 1) AS deck, substr(segment, 1, 1) AS initial FROM fx_mixed")
def _(spark, sf):
    return fixture(spark, sf, "fx_mixed").select(
        "id", text.first_char(F.col("cabin")).alias("deck"), text.first_char(F.col("segment")).alias("initial")
    )


@query(
    "g03_tokens",
    "SELECT id, split_part(ticket, ' ', 1) AS first_token, split_part(ticket, ' ', -1) AS last_token FROM fx_mixed",
)
def _(spark, sf):
    return fixture(spark, sf, "fx_mixed").select(
        "id", text.first_token(F.col("ticket")).alias("first_token"), text.last_token(F.col("ticket")).alias("last_token")
    )


@query(
    "g04_split_mixed",
    """SELECT id, CASE WHEN regexp_full_match(ticket, '[0-9]+') THEN CAST(ticket AS DOUBLE) END AS number_part,
              CASE WHEN regexp_full_match(ticket, '[0-9]+') THEN NULL ELSE ticket END AS label_part FROM fx_mixed""",
)
def _(spark, sf):
    return fixture(spark, sf, "fx_mixed").select(
        "id", text.numeric_part(F.col("ticket")).alias("number_part"), text.label_part(F.col("ticket")).alias("label_part")
    )


@query("g05_letters_only", "SELECT id, regexp_replace(ticket, '[^a-zA-Z]', '', 'g') AS letters FROM fx_mixed")
def _(spark, sf):
    return fixture(spark, sf, "fx_mixed").select("id", text.letters_only(F.col("ticket")).alias("letters"))


@query("g06_upper", "SELECT p_partkey, upper(p_name) AS name FROM part")
def _(spark, sf):
    return table(spark, sf, "part").select("p_partkey", text.upper(F.col("p_name")).alias("name"))


@query(
    "g07_tag_first_match",
    """SELECT p_partkey, CASE WHEN p_name LIKE '%ring%' THEN 'Ring' WHEN p_name LIKE '%widget%' THEN 'Widget'
              WHEN p_name LIKE '%red%' THEN 'Red' ELSE 'Other' END AS tag FROM part""",
)
def _(spark, sf):
    tags = [("ring", "Ring"), ("widget", "Widget"), ("red", "Red")]
    return table(spark, sf, "part").select("p_partkey", text.tag_first_match(F.col("p_name"), tags, "Other").alias("tag"))


@query("g08_replace_text", "SELECT id, replace(cabin, '0', '-') AS cabin FROM fx_mixed")
def _(spark, sf):
    return fixture(spark, sf, "fx_mixed").select("id", text.replace_text(F.col("cabin"), "0", "-").alias("cabin"))


@query(
    "g09_cross_labels",
    "SELECT id, c || '_' || CAST(y AS VARCHAR) AS crossed FROM fx_miss",
)
def _(spark, sf):
    return fixture(spark, sf, "fx_miss").select("id", text.cross(F.col("c"), F.col("y").cast("string")).alias("crossed"))
