"""Joins, aggregations, windows, date and number functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates, maths
from ..operators import discretise, joins, neighbours, profile as prof, windows as win
from ..operators.core import settle, share
from ..operators.ordered import group_quantiles, join_on
from ..sources.tables import table
from .registry import fixture, query, rnd

AS_OF = "2001-09-01"


def star(spark, sf):
    lines = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("o_orderkey"), "l_quantity", "l_extendedprice", "l_discount", "l_returnflag", "l_linestatus"
    )
    return table(spark, sf, "customer"), table(spark, sf, "orders"), lines


# ---------------------------------------------------------------- joins


@query(
    "c01_group_stat_back",
    """SELECT o_orderkey, o.o_custkey, n_orders, n_priorities, RND(n_orders / n_priorities) AS per_priority
       FROM orders o LEFT JOIN (SELECT o_custkey, count(o_orderdate) AS n_orders, count(DISTINCT o_orderpriority) AS n_priorities
                                FROM orders GROUP BY o_custkey) s ON o.o_custkey = s.o_custkey""",
)
def _(spark, sf):
    out = joins.group_stat_back(
        table(spark, sf, "orders"),
        ["o_custkey"],
        {"n_orders": F.count("o_orderdate"), "n_priorities": F.count_distinct("o_orderpriority")},
    )
    return out.select(
        "o_orderkey", "o_custkey", "n_orders", "n_priorities", rnd(F.col("n_orders") / F.col("n_priorities")).alias("per_priority")
    )


@query(
    "c02_attach_children",
    """SELECT c_custkey, n_orders, RND2(spend) AS spend, n_lines, RND(discount) AS discount
       FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n_orders, sum(o_totalprice) AS spend FROM orders GROUP BY o_custkey) a
            ON c_custkey = a.o_custkey
       LEFT JOIN (SELECT o_custkey, count(*) AS n_lines, avg(l_discount) AS discount
                  FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_custkey) b ON c_custkey = b.o_custkey""",
)
def _(spark, sf):
    customer, orders, lines = star(spark, sf)
    orders = orders.withColumnRenamed("o_custkey", "c_custkey")
    by_order = orders.groupBy("c_custkey").agg(F.count(F.lit(1)).alias("n_orders"), F.sum("o_totalprice").alias("spend"))
    by_line = (
        lines.join(orders.select("o_orderkey", "c_custkey"), "o_orderkey")
        .groupBy("c_custkey")
        .agg(F.count(F.lit(1)).alias("n_lines"), F.avg("l_discount").alias("discount"))
    )
    out = joins.attach_children(customer, "c_custkey", [by_order, by_line])
    return out.select("c_custkey", "n_orders", rnd("spend", 2).alias("spend"), "n_lines", rnd("discount").alias("discount"))


@query(
    "c03_two_level_rollup",
    """SELECT c_custkey, min(lines_n) AS lines_n_min, max(lines_n) AS lines_n_max, RND(avg(lines_n)) AS lines_n_mean,
              CAST(sum(lines_n) AS BIGINT) AS lines_n_sum, RND(avg(returned)) AS returned_mean
       FROM customer LEFT JOIN orders ON c_custkey = o_custkey
       LEFT JOIN (SELECT l_orderkey, count(*) AS lines_n, avg(CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END) AS returned
                  FROM lineitem GROUP BY l_orderkey) l ON o_orderkey = l_orderkey
       GROUP BY c_custkey""",
)
def _(spark, sf):
    customer, orders, lines = star(spark, sf)
    by_order = lines.groupBy("o_orderkey").agg(
        F.count(F.lit(1)).alias("lines_n"), share(F.col("l_returnflag") == "R").alias("returned")
    )
    by_customer = (
        orders.join(by_order, "o_orderkey", "left")
        .groupBy(F.col("o_custkey").alias("c_custkey"))
        .agg(*prof.stat_exprs({"lines_n": ["min", "max", "mean", "sum"], "returned": ["mean"]}))
    )
    out = joins.attach_children(customer.select("c_custkey"), "c_custkey", [by_customer])
    return out.withColumns({c: rnd(c) for c in ("lines_n_mean", "returned_mean")})


@query(
    "c03_merged_variance",
    """SELECT c_nationkey, count(*) AS n_lines, RND(avg(l_quantity)) AS mean, RND(var_samp(l_quantity)) AS var,
              RND(var_samp(l_quantity)) AS var_far
       FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey GROUP BY c_nationkey""",
)
def _(spark, sf):
    """Lines to orders to customers to nations; `far` lies 10^8 off zero, where sums of squares would cancel."""
    customer, orders, lines = star(spark, sf)
    lines = lines.join(orders.select("o_orderkey", "o_custkey"), "o_orderkey").select("o_orderkey", "o_custkey", "l_quantity", (F.col("l_quantity") + 1e8).alias("far"))
    cols = ["l_quantity", "far"]
    by_order = lines.groupBy("o_orderkey", "o_custkey").agg(*prof.moment_parts(cols))
    by_customer = prof.merged_moments(by_order, "o_custkey", cols)
    nations = customer.select("c_custkey", "c_nationkey")
    by_nation = prof.merged_moments(by_customer.join(nations, F.col("o_custkey") == F.col("c_custkey")), "c_nationkey", cols)
    return by_nation.select(
        "c_nationkey", F.col("l_quantity__n").alias("n_lines"), rnd("l_quantity__mean").alias("mean"),
        rnd(prof.sample_variance("l_quantity")).alias("var"), rnd(prof.sample_variance("far")).alias("var_far"),
    )


@query(
    "c04_lookup",
    """SELECT id, p.label, n AS label_count FROM fx_label p
       LEFT JOIN (SELECT label, count(*) AS n FROM fx_label WHERE split = 'train' GROUP BY label) s ON p.label = s.label""",
)
def _(spark, sf):
    df = fixture(spark, sf, "fx_label")
    counts = df.where("split = 'train'").groupBy("label").agg(F.count(F.lit(1)).alias("value"))
    return joins.lookup(df, "label", settle(counts), "label_count").select("id", "label", "label_count")


@query(
    "c05_label_profile",
    """SELECT label, count(*) AS n, RND(count(*) / (SELECT count(*) FROM fx_label)) AS share, RND(avg(y)) AS target_mean
       FROM fx_label GROUP BY label""",
)
def _(spark, sf):
    out = joins.label_profile(fixture(spark, sf, "fx_label"), "label", "y")
    return out.withColumns({c: rnd(c) for c in ("share", "target_mean")})


@query(
    "c06_labels_only_in",
    """SELECT DISTINCT label, 'test' AS only_in FROM fx_label WHERE split = 'test' AND label NOT IN (SELECT label FROM fx_label WHERE split = 'train')
       UNION ALL SELECT DISTINCT label, 'train' FROM fx_label WHERE split = 'train' AND label NOT IN (SELECT label FROM fx_label WHERE split = 'test')""",
)
def _(spark, sf):
    df = fixture(spark, sf, "fx_label")
    train, test = df.where("split = 'train'"), df.where("split = 'test'")
    return joins.labels_only_in(test, train, "label").withColumn("only_in", F.lit("test")).unionByName(
        joins.labels_only_in(train, test, "label").withColumn("only_in", F.lit("train"))
    )


@query(
    "c07_keep_listed",
    "SELECT id, label FROM fx_label WHERE label IN (SELECT label FROM fx_label GROUP BY label ORDER BY count(*) DESC, label LIMIT 5)",
)
def _(spark, sf):
    df = fixture(spark, sf, "fx_label").select("id", "label")
    return joins.keep_listed(df, "label", win.top_labels(df, "label", 5)).select("id", "label")


@query(
    "c08_aligned_columns",
    """SELECT coalesce(a.label, b.label) AS label, RND(train_mean) AS train_mean, RND(test_mean) AS test_mean
       FROM (SELECT label, avg(y) AS train_mean FROM fx_label WHERE split = 'train' GROUP BY label) a
       FULL JOIN (SELECT label, avg(y) AS test_mean FROM fx_label WHERE split = 'test' GROUP BY label) b ON a.label = b.label""",
)
def _(spark, sf):
    df = fixture(spark, sf, "fx_label")
    a = df.where("split = 'train'").groupBy("label").agg(rnd(F.avg("y")).alias("train_mean"))
    b = df.where("split = 'test'").groupBy("label").agg(rnd(F.avg("y")).alias("test_mean"))
    return a.join(b, "label", "full")


HAVERSINE = """12756.0 * asin(least(1.0, sqrt(pow(sin(radians(latitude - lat) / 2), 2)
    + cos(radians(lat)) * cos(radians(latitude)) * pow(sin(radians(longitude - lon) / 2), 2))))"""


@query(
    "c09_nearest_place",
    f"""SELECT id, nearest, RND(km) AS km FROM (
          SELECT id, place AS nearest, {HAVERSINE} AS km, row_number() OVER (PARTITION BY id ORDER BY {HAVERSINE}, place) AS r
          FROM fx_geo, fx_poi) t WHERE r = 1""",
)
def _(spark, sf):
    near = joins.nearest_place(fixture(spark, sf, "fx_geo"), "lat", "lon", fixture(spark, sf, "fx_poi"), "id")
    return near.select("id", "nearest", rnd("km").alias("km"))


@query(
    "c10_interval_lookup",
    """WITH e AS (SELECT quantile_cont(w, [0.0, 0.25, 0.5, 0.75, 1.0]) AS q FROM fx_miss WHERE split = 'train')
       SELECT id, CASE WHEN w < q[1] OR w > q[5] THEN NULL WHEN w <= q[2] THEN 0 WHEN w <= q[3] THEN 1 WHEN w <= q[4] THEN 2 ELSE 3 END AS w_bin
       FROM fx_miss, e""",
)
def _(spark, sf):
    df = fixture(spark, sf, "fx_miss")
    fitted = discretise.EqualFrequency(4, ["w"]).fit(df.where("split = 'train'"))
    return fitted.transform(df).select("id", "w_bin")


def knn_sides(spark, sf):
    df = table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), "label"
    )
    is_score = F.col("id") % 5 == 0
    return df.where(is_score), df.where(~is_score)


KNN = """near AS (SELECT s.vec_id AS score_id, t.vec_id AS train_id, t.label AS label,
             sqrt(list_sum(list_transform(list_zip(CAST(s.embedding AS DOUBLE[]), CAST(t.embedding AS DOUBLE[])),
                  lambda z: (z[1] - z[2]) * (z[1] - z[2])))) AS distance
      FROM embeddings s, embeddings t WHERE s.vec_id % 5 = 0 AND t.vec_id % 5 <> 0),
    best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY score_id ORDER BY distance, train_id) AS r FROM near) x WHERE r <= 5)"""


@query(
    "c11_knn_classify",
    f"""WITH {KNN}, votes AS (SELECT score_id, label, count(*) AS n FROM best GROUP BY score_id, label)
        SELECT score_id, label AS predicted FROM (
          SELECT *, row_number() OVER (PARTITION BY score_id ORDER BY n DESC, label) AS r FROM votes) y WHERE r = 1""",
)
def _(spark, sf):
    score, train = knn_sides(spark, sf)
    return neighbours.vote(neighbours.nearest(score, train, 5), train)


@query(
    "c12_knn_regress",
    f"WITH {KNN} SELECT score_id, RND(avg(label)) AS predicted FROM best GROUP BY score_id",
)
def _(spark, sf):
    score, train = knn_sides(spark, sf)
    found = neighbours.nearest(score, train, 5)
    mean = neighbours.neighbour_mean(found, train.select("id", F.col("label").cast("double").alias("target")))
    return mean.select("score_id", rnd("predicted").alias("predicted"))


@query(
    "c13_knn_weighted",
    f"""WITH {KNN}, w AS (SELECT score_id, label, CASE WHEN min(distance) OVER (PARTITION BY score_id) = 0
             THEN CASE WHEN distance = 0 THEN 1.0 ELSE 0.0 END ELSE 1.0 / distance END AS w FROM best),
        votes AS (SELECT score_id, label, sum(w) AS n FROM w GROUP BY score_id, label)
        SELECT score_id, label AS predicted FROM (
          SELECT *, row_number() OVER (PARTITION BY score_id ORDER BY n DESC, label) AS r FROM votes) y WHERE r = 1""",
)
def _(spark, sf):
    score, train = knn_sides(spark, sf)
    return neighbours.vote(neighbours.nearest(score, train, 5), train, weighted=True)


# ---------------------------------------------------------------- aggregations


@query(
    "d01_group_mean",
    "SELECT o_orderpriority, RND(avg(o_totalprice)) AS mean_price, count(*) AS n, RND2(sum(o_totalprice)) AS total FROM orders GROUP BY o_orderpriority",
)
def _(spark, sf):
    return table(spark, sf, "orders").groupBy("o_orderpriority").agg(
        rnd(F.avg("o_totalprice")).alias("mean_price"),
        F.count(F.lit(1)).alias("n"),
        rnd(F.sum("o_totalprice"), 2).alias("total"),
    )


@query("d02_group_median", "SELECT o_custkey, RND(median(o_totalprice)) AS median_price FROM orders GROUP BY o_custkey")
def _(spark, sf):
    out = group_quantiles(table(spark, sf, "orders", ["o_custkey", "o_totalprice"]), ["o_custkey"], "o_totalprice", {"m": 0.5})
    return out.select("o_custkey", rnd("m").alias("median_price"))


RFM = f"""SELECT customer_id, min(amount) AS amount_min, RND(median(amount)) AS amount_median, max(amount) AS amount_max,
              RND2(sum(amount)) AS amount_sum, RND2(stddev_samp(amount)) AS amount_std,
              count(DISTINCT CAST(txn_dt AS DATE)) AS txn_days, count(txn_dt) AS txn_count,
              CAST(date_diff('day', max(txn_dt), TIMESTAMP '{AS_OF}') AS INTEGER) AS recency_days
       FROM fx_txn GROUP BY customer_id"""


@query("d03_rfm", RFM)
def _(spark, sf):
    txn = fixture(spark, sf, "fx_txn").withColumn("txn_day", F.to_date("txn_dt"))
    # the distinct count runs in two steps, which would carry the quantile state along twice
    stats = txn.groupBy("customer_id").agg(
        *prof.stat_exprs({"amount": ["min", "max", "sum", "std"]}),
        F.count_distinct("txn_day").alias("txn_days"),
        F.count("txn_dt").alias("txn_count"),
        F.max("txn_dt").alias("last"),
    )
    medians = group_quantiles(txn.select("customer_id", "amount"), ["customer_id"], "amount", {"m": 0.5})
    return join_on(stats, medians, ["customer_id"]).select(
        "customer_id",
        "amount_min",
        rnd("m").alias("amount_median"),
        "amount_max",
        rnd("amount_sum", 2).alias("amount_sum"),
        rnd("amount_std", 2).alias("amount_std"),
        "txn_days",
        "txn_count",
        F.datediff(F.lit(AS_OF).cast("date"), F.col("last")).alias("recency_days"),
    )


def agg_sql(col: str, stats: str, prefix: str = "", where: str = "", digits: str = "2") -> str:
    src = f"CASE WHEN {where} THEN {col} END" if where else col
    fn = {"min": "min", "max": "max", "mean": "avg", "sum": "sum", "var": "var_samp", "std": "stddev_samp"}
    return ", ".join(f"RND{digits}({fn[s]}({src})) AS {prefix}{col}_{s}" for s in stats.split())


@query(
    "d04_wide_aggregates",
    f"SELECT l_suppkey, {agg_sql('l_quantity', 'min max mean var sum')}, {agg_sql('l_extendedprice', 'min max mean sum')}, "
    f"{agg_sql('l_discount', 'min max mean var sum')} FROM lineitem GROUP BY l_suppkey",
)
def _(spark, sf):
    spec = {
        "l_quantity": ["min", "max", "mean", "var", "sum"],
        "l_extendedprice": ["min", "max", "mean", "sum"],
        "l_discount": ["min", "max", "mean", "var", "sum"],
    }
    out = table(spark, sf, "lineitem").groupBy("l_suppkey").agg(*prof.stat_exprs(spec))
    return out.select("l_suppkey", *[rnd(c, 2).alias(c) for c in out.columns[1:]])


@query(
    "d05_all_columns",
    f"SELECT c_nationkey, {agg_sql('c_custkey', 'min max mean sum', 'CC_')}, {agg_sql('c_acctbal', 'min max mean sum', 'CC_')}, "
    "RND(var_samp(c_custkey) / 1e6) AS CC_c_custkey_var, RND(var_samp(c_acctbal) / 1e6) AS CC_c_acctbal_var, count(*) AS CC_count FROM customer GROUP BY c_nationkey",
)
def _(spark, sf):
    df = table(spark, sf, "customer")
    from ..operators.core import numeric_columns

    spec = {c: ["min", "max", "mean", "sum", "var"] for c in numeric_columns(df, ["c_nationkey"])}
    out = df.groupBy("c_nationkey").agg(*prof.stat_exprs(spec, "CC_"), F.count(F.lit(1)).alias("CC_count"))
    names = [c for c in out.columns if c not in ("c_nationkey", "CC_count")]
    shown = [rnd(F.col(c) / 1e6).alias(c) if c.endswith("_var") else rnd(F.col(c).cast("double"), 2).alias(c) for c in names]
    return out.select("c_nationkey", "CC_count", *shown)


@query("d06_group_count", "SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY l_partkey")
def _(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_partkey").agg(F.count(F.lit(1)).alias("n"))


@query("d07_distinct_count", "SELECT l_suppkey, count(DISTINCT l_partkey) AS n_parts, count(DISTINCT l_orderkey) AS n_orders FROM lineitem GROUP BY l_suppkey")
def _(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_suppkey").agg(
        F.count_distinct("l_partkey").alias("n_parts"), F.count_distinct("l_orderkey").alias("n_orders")
    )


@query(
    "d08_category_shares",
    """SELECT o_custkey, RND(avg(CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END)) AS o_orderstatus_F_mean,
              RND(avg(CASE WHEN o_orderstatus = 'O' THEN 1.0 ELSE 0.0 END)) AS o_orderstatus_O_mean,
              RND(avg(CASE WHEN o_orderstatus = 'P' THEN 1.0 ELSE 0.0 END)) AS o_orderstatus_P_mean FROM orders GROUP BY o_custkey""",
)
def _(spark, sf):
    df = table(spark, sf, "orders")
    from ..operators.core import label_counts

    labels = [r["label"] for r in label_counts(df, ["o_orderstatus"]).orderBy("label").collect()]
    out = df.groupBy("o_custkey").agg(*prof.share_exprs("o_orderstatus", labels))
    return out.select("o_custkey", *[rnd(c).alias(c) for c in out.columns[1:]])


@query(
    "d09_subset_aggregates",
    f"""SELECT o_custkey, {agg_sql('o_totalprice', 'min max mean sum')},
           {agg_sql('o_totalprice', 'min max mean sum', 'ACTIVE_', "o_orderstatus = 'O'")},
           {agg_sql('o_totalprice', 'min max mean sum', 'CLOSED_', "o_orderstatus = 'F'")} FROM orders GROUP BY o_custkey""",
)
def _(spark, sf):
    spec = {"o_totalprice": ["min", "max", "mean", "sum"]}
    out = table(spark, sf, "orders").groupBy("o_custkey").agg(
        *prof.stat_exprs(spec),
        *prof.stat_exprs(spec, "ACTIVE_", F.col("o_orderstatus") == "O"),
        *prof.stat_exprs(spec, "CLOSED_", F.col("o_orderstatus") == "F"),
    )
    return out.select("o_custkey", *[rnd(c, 2).alias(c) for c in out.columns[1:]])


@query("d10_value_counts", "SELECT p_brand, count(*) AS n FROM part GROUP BY p_brand ORDER BY n DESC, p_brand")
def _(spark, sf):
    return prof.value_counts(table(spark, sf, "part"), "p_brand").select("p_brand", "n").orderBy(F.desc("n"), "p_brand")


@query("d11_value_shares", "SELECT c, count(*) AS n, RND(count(*) / (SELECT count(*) FROM fx_miss)) AS share FROM fx_miss GROUP BY c")
def _(spark, sf):
    return prof.value_counts(fixture(spark, sf, "fx_miss"), "c", dropna=False).withColumn("share", rnd("share"))


NULLS = """SELECT 'x' AS variable, count(*) - count(x) AS n_null, RND(1 - count(x) / count(*)) AS null_share FROM fx_miss
    UNION ALL SELECT 'c', count(*) - count(c), RND(1 - count(c) / count(*)) FROM fx_miss
    UNION ALL SELECT 'w', count(*) - count(w), RND(1 - count(w) / count(*)) FROM fx_miss"""


@query("d12_null_table", NULLS)
def _(spark, sf):
    return prof.null_table(fixture(spark, sf, "fx_miss"), ["x", "c", "w"]).withColumn("null_share", rnd("null_share"))


@query("d13_null_report", f"SELECT * FROM ({NULLS}) t WHERE n_null > 0 ORDER BY null_share DESC")
def _(spark, sf):
    return prof.null_report(fixture(spark, sf, "fx_miss"), ["x", "c", "w"]).withColumn("null_share", rnd("null_share"))


@query(
    "d14_missing_vs_target",
    "SELECT y, RND(avg(CASE WHEN x IS NULL THEN 1.0 ELSE 0.0 END)) AS x_null, RND(avg(CASE WHEN c IS NULL THEN 1.0 ELSE 0.0 END)) AS c_null FROM fx_miss GROUP BY y",
)
def _(spark, sf):
    out = prof.missing_vs_target(fixture(spark, sf, "fx_miss"), ["x", "c"], "y")
    return out.select("y", rnd("x_null").alias("x_null"), rnd("c_null").alias("c_null"))


@query("d15_target_median_by_missing", "SELECT CAST(c IS NULL AS INTEGER) AS missing, RND(median(w)) AS target_median FROM fx_miss GROUP BY 1")
def _(spark, sf):
    return prof.target_median_by_missing(fixture(spark, sf, "fx_miss"), "c", "w").withColumn("target_median", rnd("target_median"))


@query(
    "d16_missing_dependency",
    """SELECT c, RND(count(*) FILTER (x IS NULL) / (SELECT count(*) FROM fx_miss WHERE x IS NULL)) AS share_if_missing,
              RND(count(*) FILTER (x IS NOT NULL) / (SELECT count(*) FROM fx_miss WHERE x IS NOT NULL)) AS share_if_present
       FROM fx_miss GROUP BY c""",
)
def _(spark, sf):
    out = prof.missing_dependency(fixture(spark, sf, "fx_miss"), "x", "c")
    return out.withColumns({k: rnd(k) for k in ("share_if_missing", "share_if_present")})


@query("d17_complete_share", "SELECT RND(avg(CASE WHEN x IS NOT NULL AND c IS NOT NULL THEN 1.0 ELSE 0.0 END)) AS complete_share FROM fx_miss")
def _(spark, sf):
    return prof.complete_share(fixture(spark, sf, "fx_miss"), ["x", "c"]).select(rnd("complete_share").alias("complete_share"))


def describe_sql(col: str, src: str) -> str:
    return f"""SELECT '{col}' AS variable, count({col}) AS n, RND(avg({col})) AS mean, RND(stddev_samp({col})) AS std, RND(min({col})) AS min,
        RND(quantile_cont({col}, 0.25)) AS q25, RND(quantile_cont({col}, 0.5)) AS q50, RND(quantile_cont({col}, 0.75)) AS q75, RND(max({col})) AS max FROM {src}"""


@query("d18_describe", describe_sql("x", "fx_miss") + " UNION ALL " + describe_sql("w", "fx_miss"))
def _(spark, sf):
    out = prof.describe(fixture(spark, sf, "fx_miss"), ["x", "w"])
    return out.select("variable", "n", *[rnd(c).alias(c) for c in out.columns[2:]])


@query(
    "d19_quantiles",
    " UNION ALL ".join(
        f"SELECT '{c}' AS variable, CAST({p} AS DOUBLE) AS prob, RND(quantile_cont({c}, {p})) AS value FROM lineitem"
        for c in ("l_extendedprice", "l_quantity")
        for p in (0.05, 0.25, 0.5, 0.75, 0.95)
    ),
)
def _(spark, sf):
    out = prof.quantile_table(table(spark, sf, "lineitem"), ["l_extendedprice", "l_quantity"], [0.05, 0.25, 0.5, 0.75, 0.95])
    return out.withColumn("value", rnd("value"))


@query(
    "d20_mode",
    " UNION ALL ".join(
        f"SELECT * FROM (SELECT '{c}' AS variable, {c} AS mode, count(*) AS n FROM part GROUP BY {c} ORDER BY n DESC, {c} LIMIT 1) m{i}"
        for i, c in enumerate(("p_brand", "p_type", "p_name"))
    ),
)
def _(spark, sf):
    return prof.modes(table(spark, sf, "part"), ["p_brand", "p_type", "p_name"])


@query(
    "d21_range",
    " UNION ALL ".join(f"SELECT '{c}' AS variable, RND(max({c}) - min({c})) AS range FROM part" for c in ("p_size", "p_retailprice")),
)
def _(spark, sf):
    return prof.ranges(table(spark, sf, "part"), ["p_size", "p_retailprice"]).withColumn("range", rnd("range"))


@query(
    "d22_pivot",
    """SELECT date_trunc('month', o_orderdate) AS month, RND2(sum(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END)) AS F,
              RND2(sum(CASE WHEN o_orderstatus = 'O' THEN o_totalprice END)) AS O, RND2(sum(CASE WHEN o_orderstatus = 'P' THEN o_totalprice END)) AS P
       FROM orders GROUP BY 1""",
)
def _(spark, sf):
    months = table(spark, sf, "orders").withColumn("month", dates.truncate(F.col("o_orderdate"), "month"))
    return months.groupBy("month").pivot("o_orderstatus", prof.label_list(months, "o_orderstatus")).agg(rnd(F.sum("o_totalprice"), 2))


@query(
    "d23_unpivot",
    """SELECT id, 'q' AS variable, q AS value FROM fx_num UNION ALL SELECT id, 'n', n FROM fx_num""",
)
def _(spark, sf):
    return fixture(spark, sf, "fx_num").unpivot(["id"], ["q", "n"], "variable", "value")


CORR_COLS = ("q", "p", "n", "d")


@query(
    "d24_correlations",
    " UNION ALL ".join(
        f"SELECT '{a}' AS a, '{b}' AS b, RND(corr({a}, {b})) AS r FROM fx_num"
        for i, a in enumerate(CORR_COLS)
        for b in CORR_COLS[i + 1 :]
    ),
)
def _(spark, sf):
    return prof.correlations(fixture(spark, sf, "fx_num"), list(CORR_COLS)).withColumn("r", rnd("r"))


@query(
    "d24_correlations_constant",
    """SELECT 'q' AS a, 'const' AS b, CAST(NULL AS DOUBLE) AS r UNION ALL SELECT 'q', 'n', RND(corr(q, n)) FROM fx_sel
       UNION ALL SELECT 'const', 'n', NULL""",
)
def _(spark, sf):
    return prof.correlations(fixture(spark, sf, "fx_sel"), ["q", "const", "n"]).withColumn("r", rnd("r"))


@query(
    "d25_cluster_report",
    "SELECT o_orderpriority, count(*) AS size, RND(median(o_totalprice)) AS o_totalprice_median, RND(median(o_custkey)) AS o_custkey_median FROM orders GROUP BY o_orderpriority",
)
def _(spark, sf):
    out = prof.cluster_report(table(spark, sf, "orders"), "o_orderpriority", ["o_totalprice", "o_custkey"])
    return out.withColumns({c: rnd(c) for c in ("o_totalprice_median", "o_custkey_median")})


@query(
    "d26_cardinality",
    """SELECT 'c' AS variable, count(DISTINCT c) + max(CASE WHEN c IS NULL THEN 1 ELSE 0 END) AS n_labels, max(CASE WHEN c IS NULL THEN 1 ELSE 0 END) AS has_null FROM fx_miss
       UNION ALL SELECT 'split', count(DISTINCT split), 0 FROM fx_miss UNION ALL SELECT 'y', count(DISTINCT y), 0 FROM fx_miss""",
)
def _(spark, sf):
    return prof.cardinality(fixture(spark, sf, "fx_miss"), ["c", "split", "y"])


@query(
    "d27_label_target",
    "SELECT label, count(*) AS n, RND(avg(y)) AS target_mean, RND(median(y)) AS target_median FROM fx_label GROUP BY label",
)
def _(spark, sf):
    out = prof.label_target_profile(fixture(spark, sf, "fx_label"), "label", "y")
    return out.withColumns({c: rnd(c) for c in ("target_mean", "target_median")})


CASE_GROUP = "CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'FAST' ELSE o_orderpriority END"


@query("d28_group_by_case", f"SELECT {CASE_GROUP} AS priority, count(*) AS total FROM orders GROUP BY {CASE_GROUP}")
def _(spark, sf):
    return spark.sql(
        f"SELECT {CASE_GROUP} AS priority, count(*) AS total FROM {{orders}} GROUP BY {CASE_GROUP}",
        orders=table(spark, sf, "orders"),
    )


@query(
    "d29_group_min_max",
    "SELECT o_orderstatus, min(o_totalprice) AS lo, max(o_totalprice) AS hi, count(*) AS n, RND(avg(o_totalprice)) AS mean FROM orders GROUP BY o_orderstatus",
)
def _(spark, sf):
    return table(spark, sf, "orders").groupBy("o_orderstatus").agg(
        F.min("o_totalprice").alias("lo"), F.max("o_totalprice").alias("hi"), F.count(F.lit(1)).alias("n"),
        rnd(F.avg("o_totalprice")).alias("mean"),
    )


@query("d30_class_balance", "SELECT y, count(*) AS n FROM fx_num GROUP BY y")
def _(spark, sf):
    return fixture(spark, sf, "fx_num").groupBy("y").agg(F.count(F.lit(1)).alias("n"))


@query(
    "d31_histogram",
    """WITH e AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi, (max(o_totalprice) - min(o_totalprice)) / 20 AS w FROM orders),
            c AS (SELECT CAST(least(floor((o_totalprice - lo) / w), 19) AS INTEGER) AS bin, count(*) AS n FROM orders, e GROUP BY 1)
       SELECT CAST(range AS INTEGER) AS bin, RND(lo + range * w) AS lo, RND(lo + (range + 1) * w) AS hi, coalesce(n, 0) AS n
       FROM range(20) CROSS JOIN e LEFT JOIN c ON bin = range""",
)
def _(spark, sf):
    return prof.histogram(table(spark, sf, "orders"), "o_totalprice", 20).withColumns({"lo": rnd("lo"), "hi": rnd("hi")})


BOX = """q AS (SELECT *, q25 - 1.5 * (q75 - q25) AS f_lo, q75 + 1.5 * (q75 - q25) AS f_hi FROM cuts)"""


@query(
    "d32_box_stats",
    f"""WITH cuts AS (SELECT quantile_cont(p, 0.25) AS q25, quantile_cont(p, 0.5) AS q50, quantile_cont(p, 0.75) AS q75 FROM fx_num), {BOX}
        SELECT 'p' AS variable, RND(q25) AS q25, RND(q50) AS q50, RND(q75) AS q75, RND(min(p) FILTER (p BETWEEN f_lo AND f_hi)) AS whisker_low,
               RND(max(p) FILTER (p BETWEEN f_lo AND f_hi)) AS whisker_high, count(*) FILTER (p < f_lo OR p > f_hi) AS n_outlier
        FROM fx_num, q GROUP BY q25, q50, q75""",
)
def _(spark, sf):
    out = prof.box_stats(fixture(spark, sf, "fx_num"), ["p"])
    return out.withColumns({c: rnd(c) for c in ("q25", "q50", "q75", "whisker_low", "whisker_high")})


@query(
    "d33_spread_after_fill",
    """SELECT RND2(stddev_samp(x)) AS std_before, RND2(stddev_samp(coalesce(x, (SELECT median(x) FROM fx_miss)))) AS std_after FROM fx_miss""",
)
def _(spark, sf):
    from ..operators.impute import MeanMedian

    df = fixture(spark, sf, "fx_miss").select("x")
    filled = MeanMedian("median", ["x"]).fit(df.withColumn("x", F.col("x"))).transform(df.withColumn("raw", F.col("x")))
    return filled.agg(rnd(F.stddev_samp("raw"), 2).alias("std_before"), rnd(F.stddev_samp("x"), 2).alias("std_after"))


@query(
    "d34_split_shares",
    """SELECT label2, RND(count(*) FILTER (split = 'train') / (SELECT count(*) FROM fx_label WHERE split = 'train')) AS train_share,
              RND(count(*) FILTER (split <> 'train') / (SELECT count(*) FROM fx_label WHERE split <> 'train')) AS test_share FROM fx_label GROUP BY label2""",
)
def _(spark, sf):
    out = prof.split_shares(fixture(spark, sf, "fx_label"), "label2")
    return out.withColumns({c: rnd(c) for c in ("train_share", "test_share")})


@query(
    "d35_calendar_profile",
    """SELECT customer_id, count(DISTINCT day(txn_dt)) AS n_days, count(DISTINCT isodow(txn_dt)) AS n_weekdays,
              RND(avg(CASE WHEN day(txn_dt) = 1 THEN 1.0 ELSE 0.0 END)) AS month_start_share FROM fx_txn GROUP BY customer_id""",
)
def _(spark, sf):
    ts = F.col("txn_dt")
    return fixture(spark, sf, "fx_txn").groupBy("customer_id").agg(
        F.count_distinct(dates.day(ts)).alias("n_days"),
        F.count_distinct(dates.weekday(ts)).alias("n_weekdays"),
        rnd(F.avg(dates.is_month_start(ts))).alias("month_start_share"),
    )


@query(
    "d36_group_sizes",
    "SELECT group_size, count(*) AS n_groups FROM (SELECT o_custkey, count(*) AS group_size FROM orders GROUP BY o_custkey) s GROUP BY group_size",
)
def _(spark, sf):
    return prof.group_sizes(table(spark, sf, "orders"), "o_custkey")


# ---------------------------------------------------------------- windows


def running_sql(period: str) -> str:
    w = f"(PARTITION BY customer_id ORDER BY date_trunc('{period}', txn_dt))"
    return f"""SELECT id, customer_id, date_trunc('{period}', txn_dt) AS {period}, CAST(dense_rank() OVER {w} AS INTEGER) AS dense_rank,
        RND2(sum(amount) OVER {w}) AS running_sum, count(amount) OVER {w} AS running_count, RND2(avg(amount) OVER {w}) AS running_avg,
        min(amount) OVER {w} AS running_min, max(amount) OVER {w} AS running_max FROM fx_txn"""


def running(spark, sf, period):
    out = win.running_by_period(fixture(spark, sf, "fx_txn"), "customer_id", "txn_dt", "amount", period)
    return out.drop("amount", "txn_dt").withColumns({c: rnd(c, 2) for c in ("running_sum", "running_avg")})


@query(
    "e01_dense_rank",
    "SELECT id, CAST(dense_rank() OVER (PARTITION BY customer_id ORDER BY date_trunc('month', txn_dt)) AS INTEGER) AS dense_rank FROM fx_txn",
)
def _(spark, sf):
    return running(spark, sf, "month").select("id", "dense_rank")


@query("e02_running_by_month", running_sql("month"))
def _(spark, sf):
    return running(spark, sf, "month")


@query("e03_running_by_year", running_sql("year"))
def _(spark, sf):
    return running(spark, sf, "year")


@query(
    "e04_rolling",
    """SELECT series, day, CASE WHEN count(v) OVER w = 10 THEN RND(avg(v) OVER w) END AS rolling_mean,
              CASE WHEN count(v) OVER w = 10 THEN RND(stddev_samp(v) OVER w) END AS rolling_std
       FROM fx_series WINDOW w AS (PARTITION BY series ORDER BY day ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)""",
)
def _(spark, sf):
    out = win.rolling(fixture(spark, sf, "fx_series"), ["series"], "day", "v", 10)
    return out.select("series", "day", rnd("rolling_mean").alias("rolling_mean"), rnd("rolling_std").alias("rolling_std"))


@query("e05_lag_pairs", "SELECT series, day, RND(v) AS v, RND(lag(v) OVER (PARTITION BY series ORDER BY day)) AS lagged FROM fx_series")
def _(spark, sf):
    out = win.lag_pairs(fixture(spark, sf, "fx_series"), ["series"], "day", "v")
    return out.select("series", "day", rnd("v").alias("v"), rnd("lagged").alias("lagged"))


@query(
    "e06_cumulative_share",
    """SELECT p_brand, revenue, RND(revenue / sum(revenue) OVER ()) AS share,
              RND(sum(revenue) OVER (ORDER BY revenue DESC, p_brand ROWS UNBOUNDED PRECEDING) / sum(revenue) OVER ()) AS cum_share
       FROM (SELECT p_brand, RND0(sum(p_retailprice)) AS revenue FROM part GROUP BY p_brand) t""",
)
def _(spark, sf):
    revenue = table(spark, sf, "part").groupBy("p_brand").agg(rnd(F.sum("p_retailprice"), 0).alias("revenue"))
    out = win.cumulative_share(revenue, "revenue", "p_brand")
    return out.withColumns({c: rnd(c) for c in ("share", "cum_share")})


@query(
    "e07_rows_to_reach",
    """SELECT min(r) AS n_needed FROM (SELECT row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS r,
              sum(o_totalprice) OVER (ORDER BY o_totalprice DESC, o_orderkey ROWS UNBOUNDED PRECEDING) / sum(o_totalprice) OVER () AS c FROM orders) t WHERE c > 0.8""",
)
def _(spark, sf):
    return win.rows_to_reach(table(spark, sf, "orders", ["o_orderkey", "o_totalprice"]), "o_totalprice", "o_orderkey", 0.8)


@query(
    "e08_resample",
    "SELECT event_type, date_trunc('hour', ts) AS period, RND(avg(value)) AS mean_value, count(*) AS n, max(value) AS peak FROM events GROUP BY 1, 2",
)
def _(spark, sf):
    aggs = {"mean_value": rnd(F.avg("value")), "n": F.count(F.lit(1)), "peak": F.max("value")}
    return win.resample(table(spark, sf, "events"), "ts", "hour", aggs, ["event_type"])


@query(
    "e09_box_by_period",
    f"""WITH base AS (SELECT date_trunc('day', ts) AS period, value FROM events),
             cuts AS (SELECT period, quantile_cont(value, 0.25) AS q25, quantile_cont(value, 0.5) AS q50, quantile_cont(value, 0.75) AS q75 FROM base GROUP BY period), {BOX}
        SELECT base.period, RND(q25) AS q25, RND(q50) AS q50, RND(q75) AS q75, min(value) FILTER (value BETWEEN f_lo AND f_hi) AS whisker_low,
               max(value) FILTER (value BETWEEN f_lo AND f_hi) AS whisker_high, count(*) FILTER (value < f_lo OR value > f_hi) AS n_outlier
        FROM base JOIN q ON base.period = q.period GROUP BY base.period, q25, q50, q75""",
)
def _(spark, sf):
    df = table(spark, sf, "events").select(F.date_trunc("day", "ts").alias("period"), "value")
    return prof.group_box_stats(df, ["period"], "value").withColumns({c: rnd(c) for c in ("q25", "q50", "q75")})


@query(
    "e10_recency",
    f"SELECT customer_id, max(txn_dt) AS last_seen, CAST(date_diff('day', max(txn_dt), TIMESTAMP '{AS_OF}') AS INTEGER) AS recency_days FROM fx_txn GROUP BY customer_id",
)
def _(spark, sf):
    return win.recency(fixture(spark, sf, "fx_txn"), "customer_id", "txn_dt", F.lit(AS_OF).cast("date"))


@query("e11_full_sort", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey")
def _(spark, sf):
    return table(spark, sf, "orders", ["o_orderkey", "o_totalprice"]).orderBy(F.desc("o_totalprice"), "o_orderkey")


@query("e12_top_rows", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def _(spark, sf):
    return table(spark, sf, "orders", ["o_orderkey", "o_totalprice"]).orderBy(F.desc("o_totalprice"), "o_orderkey").limit(10)


@query("e13_top_labels", "SELECT p_brand, count(*) AS n FROM part GROUP BY p_brand ORDER BY n DESC, p_brand LIMIT 10")
def _(spark, sf):
    return win.top_labels(table(spark, sf, "part"), "p_brand", 10)


@query(
    "e14_top_mean_importance",
    """SELECT p_brand AS feature, RND(avg(importance)) AS importance FROM (
         SELECT p_type, p_brand, sum(p_retailprice) AS importance FROM part GROUP BY p_type, p_brand) f
       GROUP BY p_brand ORDER BY avg(importance) DESC, p_brand LIMIT 10""",
)
def _(spark, sf):
    folds = table(spark, sf, "part").groupBy("p_type", F.col("p_brand").alias("feature")).agg(F.sum("p_retailprice").alias("importance"))
    mean = folds.groupBy("feature").agg(F.avg("importance").alias("importance"))
    return mean.orderBy(F.desc("importance"), "feature").limit(10).withColumn("importance", rnd("importance"))


# ---------------------------------------------------------------- dates and numbers


@query(
    "g10_parse_date",
    "SELECT o_orderkey, o_orderdate FROM orders",
)
def _(spark, sf):
    written = table(spark, sf, "orders").withColumn("text", F.date_format("o_orderdate", "MMM-yyyy-dd"))
    return written.select(
        "o_orderkey", dates.parse_date(F.col("text"), "MMM-yyyy-dd").cast("timestamp_ntz").alias("o_orderdate")
    )


def date_query(name: str, **exprs):
    """Register one per-order date query from alias=(function of the date, SQL)."""
    sql = "SELECT o_orderkey, " + ", ".join(f"{s} AS {a}" for a, (_, s) in exprs.items()) + " FROM orders"

    def run(spark, sf):
        ts = F.col("o_orderdate")
        return table(spark, sf, "orders").select("o_orderkey", *[fn(ts).alias(a) for a, (fn, _) in exprs.items()])

    query(name, sql)(run)


def as_of():
    return F.lit(AS_OF).cast("date")


date_query(
    "g11_day_month_year",
    day=(dates.day, "CAST(day(o_orderdate) AS INTEGER)"),
    month=(dates.month, "CAST(month(o_orderdate) AS INTEGER)"),
    year=(dates.year, "CAST(year(o_orderdate) AS INTEGER)"),
)
date_query(
    "g12_quarter_semester",
    quarter=(dates.quarter, "CAST(quarter(o_orderdate) AS INTEGER)"),
    semester=(dates.semester, "CASE WHEN quarter(o_orderdate) <= 2 THEN 1 ELSE 2 END"),
)
date_query("g13_weekday", weekday=(dates.weekday, "CAST(isodow(o_orderdate) - 1 AS INTEGER)"))
date_query("g14_weekday_name", weekday_name=(dates.weekday_name, "dayname(o_orderdate)"))
date_query("g15_weekend", weekend=(dates.is_weekend, "CAST(isodow(o_orderdate) >= 6 AS INTEGER)"))
date_query("g16_month_start", month_start=(dates.is_month_start, "CAST(day(o_orderdate) = 1 AS INTEGER)"))
date_query(
    "g17_truncate",
    month=(lambda c: dates.truncate(c, "month"), "CAST(date_trunc('month', o_orderdate) AS TIMESTAMP)"),
    year=(lambda c: dates.truncate(c, "year"), "CAST(date_trunc('year', o_orderdate) AS TIMESTAMP)"),
)
date_query(
    "g18_day_difference",
    age_days=(
        lambda c: dates.days_between(as_of(), c),
        f"CAST(date_diff('day', o_orderdate, TIMESTAMP '{AS_OF}') AS INTEGER)",
    ),
)
date_query(
    "g19_months_on_book",
    months=(
        lambda c: rnd(dates.months_on_book(as_of(), c)),
        f"RND(date_diff('day', o_orderdate, TIMESTAMP '{AS_OF}') / 30.436875)",
    ),
)
date_query(
    "g21_years_since",
    years=(lambda c: dates.years_since(2018, dates.year(c)), "CAST(2018 - year(o_orderdate) AS INTEGER)"),
)


@query(
    "g20_elapsed_years",
    "SELECT l_orderkey, l_linenumber, l_shipdate, CAST(year(l_shipdate) - year(o_orderdate) AS INTEGER) AS years FROM lineitem JOIN orders ON l_orderkey = o_orderkey",
)
def _(spark, sf):
    both = table(spark, sf, "lineitem").join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    years = dates.elapsed_years(F.year("l_shipdate"), F.year("o_orderdate"))
    return both.select("l_orderkey", "l_linenumber", "l_shipdate", years.alias("years"))


@query(
    "g22_date_spine",
    "SELECT CAST(unnest(generate_series(min(o_orderdate), max(o_orderdate), INTERVAL 1 DAY)) AS DATE) AS day FROM orders",
)
def _(spark, sf):
    return dates.date_spine(table(spark, sf, "orders"), "o_orderdate")


def number_query(name: str, source: str = "fx_num", **exprs):
    """Register one per-row number query from alias=(function of F.col, SQL)."""
    sql = "SELECT id, " + ", ".join(f"RND({s}) AS {a}" for a, (_, s) in exprs.items()) + f" FROM {source}"

    def run(spark, sf):
        return fixture(spark, sf, source).select("id", *[rnd(fn(F.col)).alias(a) for a, (fn, _) in exprs.items()])

    query(name, sql)(run)


number_query(
    "g23_ln",
    ln_p=(lambda c: maths.ln_or_null(c("p")), "ln(p)"),
    ln_d=(lambda c: maths.ln_or_null(c("d")), "CASE WHEN d > 0 THEN ln(d) END"),
)
number_query("g24_log1p_rounded", v=(lambda c: maths.log1p_rounded(c("q")), "coalesce(round(ln(1 + q), 1), 0)"))
number_query(
    "g25_reciprocal",
    inv=(lambda c: maths.reciprocal(c("q")), "1 / nullif(q, 0)"),
    inv_shift=(lambda c: maths.reciprocal(c("n"), 1.0), "1 / nullif(n + 1, 0)"),
)
number_query("g26_square_root", root=(lambda c: maths.square_root(c("p")), "sqrt(p)"))
number_query(
    "g27_power",
    p_12=(lambda c: maths.power(c("n"), 1 / 1.2), "pow(n, 1 / 1.2)"),
    p_5=(lambda c: maths.power(c("p"), 1 / 5), "pow(p, 0.2)"),
    p_4=(lambda c: maths.power(c("p"), 1 / 4), "pow(p, 0.25)"),
)
number_query("g29_exponential", back=(lambda c: maths.exponential(F.ln(c("q"))), "exp(ln(q))"))
number_query(
    "g30_displacement",
    "fx_geo",
    dx=(lambda c: maths.abs_difference(c("lat"), F.lit(13.5)), "abs(lat - 13.5)"),
    dist=(
        lambda c: maths.displacement(c("lat") - 13.5, c("lon") - 100.5),
        "sqrt(pow(lat - 13.5, 2) + pow(lon - 100.5, 2))",
    ),
)
number_query(
    "g31_haversine",
    "fx_geo",
    km=(
        lambda c: maths.haversine(c("lat"), c("lon"), F.lit(13.717674), F.lit(100.526077)),
        HAVERSINE.replace("latitude", "13.717674").replace("longitude", "100.526077"),
    ),
)
number_query("g33_sigmoid", s=(lambda c: maths.sigmoid(c("n") - 4), "1 / (1 + exp(-(n - 4)))"))


@query(
    "g28_box_cox",
    # of centred logs the likelihood is greatest where the variance is least; it has a single peak, so a bracket closes in
    """WITH RECURSIVE z AS (SELECT ln(p) - (SELECT avg(ln(p)) FROM fx_num) AS z FROM fx_num),
            b AS (SELECT CAST(-5 AS DOUBLE) AS lo, CAST(5 AS DOUBLE) AS hi, 0 AS i
                  UNION ALL
                  SELECT CASE WHEN v1 > v2 THEN m1 ELSE lo END, CASE WHEN v1 > v2 THEN hi ELSE m2 END, i + 1
                  FROM (SELECT lo, hi, i, m1, m2, var_pop((exp(m1 * z) - 1) / m1) AS v1, var_pop((exp(m2 * z) - 1) / m2) AS v2
                        FROM (SELECT lo, hi, i, lo + (hi - lo) * 0.382 AS m1, lo + (hi - lo) * 0.618 AS m2 FROM b WHERE i < 40) c, z GROUP BY ALL) s),
            best AS (SELECT round((lo + hi) / 2, 3) AS lam FROM b WHERE i = 40)
       SELECT id, lam AS lambda, RND(CASE WHEN lam = 0 THEN ln(p) ELSE (pow(p, lam) - 1) / lam END) AS transformed FROM fx_num, best""",
)
def _(spark, sf):
    from ..operators.scale import box_cox_lambda

    # the likelihood is flat at its peak: two searches agree in three digits
    df = fixture(spark, sf, "fx_num").select("id", "p")
    lam = round(box_cox_lambda(df, "p"), 3)
    return df.select("id", F.lit(lam).alias("lambda"), rnd(maths.box_cox(F.col("p"), lam)).alias("transformed"))


@query(
    "g32_rounding",
    "SELECT o_orderkey, CAST(floor(o_totalprice) AS BIGINT) AS down, CAST(ceil(o_totalprice) AS BIGINT) AS up, round_even(o_totalprice, 0) AS even FROM orders",
)
def _(spark, sf):
    x = F.col("o_totalprice")
    return table(spark, sf, "orders").select(
        "o_orderkey", F.floor(x).alias("down"), F.ceil(x).alias("up"), maths.round_half_even(x).alias("even")
    )
