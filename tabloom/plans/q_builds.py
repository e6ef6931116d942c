"""Whole builds: customer features and model, price model."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import boosting as bst, discretise as disc, encode as enc, impute, metrics as mt, models as m, rare, scale
from ..operators.profile import null_table, variable_types
from ..operators.stages import Chain
from ..sources.tables import table
from . import customer_model as cm
from .registry import fixture, query, rnd

AS_OF = "2000-09-01"


def customer_table(spark, sf):
    customer, orders = table(spark, sf, "customer"), table(spark, sf, "orders")
    target = cm.targets(orders, AS_OF, 300000.0)
    is_train = F.col("c_custkey") % 5 != 0
    train = customer.where(is_train).join(target, "c_custkey", "left").withColumn("target", F.coalesce("target", F.lit(0)))
    base = cm.base_table(train, customer.where(~is_train))
    return cm.customer_features(base, orders, table(spark, sf, "lineitem"), AS_OF)


SHOWN = [
    "ORD_price_min", "ORD_price_max", "ORD_price_mean", "ORD_price_sum", "ORD_age_days_min", "ORD_age_days_mean",
    "ORD_lines_n_mean", "ORD_late_share_mean", "ORD_o_orderstatus_F_mean", "OPEN_price_mean", "OPEN_price_sum",
    "DONE_price_sum", "DONE_age_days_min", "LINE_unit_price_mean", "LINE_discounted_sum", "LINE_days_late_mean",
    "LINE_days_early_sum", "LINE_l_returnflag_R_mean", "balance_to_spend", "lines_per_order",
]


@query(
    "w01_customer_features",
    f"""WITH past AS (SELECT * FROM orders WHERE o_orderdate < TIMESTAMP '{AS_OF}'),
        li AS (SELECT o_custkey, o_orderkey, l_returnflag, l_extendedprice / nullif(l_quantity, 0) AS unit_price, l_extendedprice * l_discount AS discounted,
                      greatest(date_diff('day', o_orderdate, l_shipdate), 0) AS late, greatest(date_diff('day', l_shipdate, o_orderdate), 0) AS early
               FROM lineitem JOIN past ON l_orderkey = o_orderkey),
        bo AS (SELECT o_orderkey, count(*) AS n, avg(CASE WHEN late > 0 THEN 1.0 ELSE 0.0 END) AS late_share FROM li GROUP BY o_orderkey),
        o AS (SELECT p.o_custkey, o_orderstatus AS st, o_totalprice AS price, date_diff('day', o_orderdate, TIMESTAMP '{AS_OF}') AS age, n, late_share
              FROM past p LEFT JOIN bo ON p.o_orderkey = bo.o_orderkey),
        a AS (SELECT o_custkey AS k, min(price) AS ORD_price_min, max(price) AS ORD_price_max, avg(price) AS ORD_price_mean, sum(price) AS ORD_price_sum,
                     min(age) AS ORD_age_days_min, avg(age) AS ORD_age_days_mean, avg(n) AS ORD_lines_n_mean, avg(late_share) AS ORD_late_share_mean,
                     avg(CASE WHEN st = 'F' THEN 1.0 ELSE 0.0 END) AS ORD_o_orderstatus_F_mean, avg(price) FILTER (st = 'O') AS OPEN_price_mean,
                     sum(price) FILTER (st = 'O') AS OPEN_price_sum, sum(price) FILTER (st = 'F') AS DONE_price_sum,
                     min(age) FILTER (st = 'F') AS DONE_age_days_min, count(*) AS n_orders FROM o GROUP BY o_custkey),
        b AS (SELECT o_custkey AS k, avg(unit_price) AS LINE_unit_price_mean, sum(discounted) AS LINE_discounted_sum, avg(late) AS LINE_days_late_mean,
                     sum(early) AS LINE_days_early_sum, avg(CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END) AS LINE_l_returnflag_R_mean, count(*) AS n_lines
              FROM li GROUP BY o_custkey),
        t AS (SELECT o_custkey AS k, sum(o_totalprice) > 300000 AS hit FROM orders WHERE o_orderdate >= TIMESTAMP '{AS_OF}' GROUP BY o_custkey),
        j AS (SELECT c_custkey, CASE WHEN c_custkey % 5 <> 0 THEN CAST(coalesce(hit, false) AS INTEGER) END AS target, a.*, b.*,
                     CASE WHEN c_acctbal < 0 THEN NULL ELSE c_acctbal END / nullif(ORD_price_sum, 0) AS balance_to_spend, n_lines / nullif(n_orders, 0) AS lines_per_order
              FROM customer LEFT JOIN a ON c_custkey = a.k LEFT JOIN b ON c_custkey = b.k LEFT JOIN t ON c_custkey = t.k)
        SELECT c_custkey, target, """
    + ", ".join(f"RND2({c}) AS {c}" for c in SHOWN)
    + " FROM j",
)
def _(spark, sf):
    out = customer_table(spark, sf)
    return out.select("c_custkey", "target", *[rnd(F.col(c).cast("double"), 2).alias(c) for c in SHOWN])


@query("w02_customer_model")
def _(spark, sf):
    oof, mean, importance = cm.cross_validated(customer_table(spark, sf), "c_custkey")
    per_fold = mt.roc_auc(oof, "target", "score", ["fold"]).select(F.concat(F.lit("auc fold "), "fold").alias("item"), F.col("auc").alias("value"))
    whole = mt.roc_auc(oof, "target", "score").select(F.lit("auc").alias("item"), F.col("auc").alias("value"))
    scored = mean.agg(F.lit("mean score of unlabelled").alias("item"), F.avg("score").alias("value"))
    top = importance.groupBy("feature").agg(F.avg("importance").alias("value")).orderBy(F.desc("value"), "feature").limit(10)
    return per_fold.unionByName(whole).unionByName(scored).unionByName(top.withColumnRenamed("feature", "item"))


def price_table(spark, sf):
    """Parts with gaps in a number and in a label."""
    df = fixture(spark, sf, "fx_label")
    return df.select(
        "id",
        F.when(F.col("id") % 5 != 0, F.col("size")).cast("double").alias("size"),
        F.when(F.col("id") % 7 != 0, F.col("label")).alias("label"),
        "label2",
        F.length(F.col("label")).alias("label_length"),
        "y",
        "split",
    )


@query("w03_price_model")
def _(spark, sf):
    df = price_table(spark, sf)
    train = df.where("split = 'train'")
    kinds = variable_types(train.drop("split"), "y", "id")
    numbers = kinds["continuous"] + kinds["discrete"]
    chain = Chain(
        [
            impute.MissingFlag(["size"]),
            impute.MeanMedian("median", ["size"]),
            impute.MissingLabel(kinds["categorical"]),
            impute.MeanMedian("median", numbers),
            disc.TreeBins("y", numbers, depths=(1, 2, 3), suffix="", key=["id"]),
            rare.RareLabels(0.03, 1, kinds["categorical"]),
            enc.LabelNumbers("mean", kinds["categorical"], "y", fallback=0.0),
            scale.Scale("minmax", [*kinds["categorical"], *numbers]),
        ]
    )
    fitted = chain.fit(train)
    features = [*kinds["categorical"], *numbers, "size_na"]
    test = df.where("split <> 'train'")
    with m.held(*[fitted.transform(d).select("y", *features) for d in (train, test)]) as (a, b):
        rows = a.select(F.ln("y").alias("log_y"), (F.pmod(F.xxhash64("y", *features), F.lit(10)) == 0).alias("valid"), *features)
        (model,) = bst.boost(rows, features, "log_y", bst.Settings("squared", rounds=200, rate=0.5, patience=3), valid="valid")
        out = model.scored(b).withColumn("prediction", F.exp("prediction"))
        values = mt.regression_scores(out, "y", "prediction").first().asDict()
        gaps = sum(r["n_null"] for r in null_table(b, features).collect())
    rows = [(k, float(v)) for k, v in values.items()] + [("nulls_left", float(gaps))]
    return m.rows_table(df, rows, "item string, value double")


@query(
    "w04_variable_types",
    """SELECT 'label' AS variable, 'categorical' AS kind, count(DISTINCT label) AS n_labels FROM fx_label
       UNION ALL SELECT 'label2', 'categorical', count(DISTINCT label2) FROM fx_label
       UNION ALL SELECT 'size', CASE WHEN count(DISTINCT size) < 20 THEN 'discrete' ELSE 'continuous' END, count(DISTINCT size) FROM fx_label
       UNION ALL SELECT 'yb', CASE WHEN count(DISTINCT yb) < 20 THEN 'discrete' ELSE 'continuous' END, count(DISTINCT yb) FROM fx_label""",
)
def _(spark, sf):
    from ..operators.profile import cardinality

    df = fixture(spark, sf, "fx_label").drop("split")
    kinds = variable_types(df, "y", "id")
    rows = [(v, kind) for kind, cols in kinds.items() for v in cols]
    kind_table = spark.createDataFrame(rows, "variable string, kind string")
    return cardinality(df, [v for v, _ in rows]).join(kind_table, "variable").select("variable", "kind", "n_labels")


@query(
    "u05_custom_metric",
    "SELECT RND(2.0 * count(*) FILTER (y = 1 AND q > 120) / (count(*) FILTER (y = 1) + count(*) FILTER (q > 120))) AS f1 FROM fx_num",
)
def _(spark, sf):
    df = fixture(spark, sf, "fx_num").withColumn("prediction", F.when(F.col("q") > 120, 1).otherwise(0))
    value = mt.AggregateEvaluator("f1", "y").evaluate(df)
    return df.agg(rnd(F.first(F.lit(value))).alias("f1"))
