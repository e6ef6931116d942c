"""Multi-table feature build and its cross-validated model.

Child tables are rolled up once each, subsets and label shares ride in the same
pass as conditional aggregates, and the one-row-per-customer rollups are joined on
the same key. Features come from before ``as_of``, the target from after it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..operators import models as m
from ..operators.boosting import Settings, out_of_fold
from ..operators.core import checkpointed
from ..operators.joins import attach_children
from ..operators.profile import label_list, merged_moments, moment_parts, sample_variance, share_exprs, stat_exprs
from ..operators.relational import out_of_range_to_null, positive_part, ratio, stack_tables

ORDER_STATS = {
    "price": ["min", "max", "mean", "var", "sum"],
    "age_days": ["min", "max", "mean"],
    "lines_n": ["mean", "sum"],
    "late_share": ["mean"],
}
LINE_STATS = {
    "unit_price": ["min", "max", "mean", "var"],
    "discounted": ["max", "mean", "sum"],
    "days_late": ["max", "mean", "sum"],
    "days_early": ["max", "mean", "sum"],
}


def base_table(train: DataFrame, score: DataFrame) -> DataFrame:
    """Training and scoring customers together; the target of the latter is null."""
    both = stack_tables(train, score)
    cleaned = both.withColumn("c_nationkey", F.col("c_nationkey").cast("double"))
    return cleaned.withColumn("balance", out_of_range_to_null(F.col("c_acctbal"), low=0))


def line_side(lines: DataFrame, orders: DataFrame) -> DataFrame:
    """Line items with their order's customer and date, and per-line features."""
    joined = lines.join(orders.select("o_orderkey", "o_custkey", "o_orderdate"), lines["l_orderkey"] == orders["o_orderkey"])
    delay = F.datediff("l_shipdate", "o_orderdate")
    return joined.select(
        "o_custkey",
        "o_orderkey",
        "l_returnflag",
        ratio(F.col("l_extendedprice"), F.col("l_quantity")).alias("unit_price"),
        (F.col("l_extendedprice") * F.col("l_discount")).alias("discounted"),
        positive_part(delay).alias("days_late"),
        positive_part(-delay).alias("days_early"),
    )


PARTS = {"n": F.count, "sum": F.sum, "min": F.min, "max": F.max}


SPREAD = [c for c, stats in LINE_STATS.items() if "var" in stats]


def order_parts(lines: DataFrame, flags: list[str]) -> DataFrame:
    """One row per order: its own features, and the parts from which statistics of its customer's lines add up."""
    parts = [f(c).alias(f"{c}__{name}") for c in LINE_STATS for name, f in PARTS.items() if not (c in SPREAD and name == "n")]
    return lines.groupBy("o_orderkey").agg(
        F.count(F.lit(1)).alias("lines_n"),
        F.avg((F.col("days_late") > 0).cast("int")).alias("late_share"),
        *parts,
        *moment_parts(SPREAD),
        *[F.count_if(F.col("l_returnflag") == v).alias(f"flag__{v}") for v in flags],
    )


def line_exprs(flags: list[str]) -> list[Column]:
    """Statistics of a customer's lines from the parts of the orders."""
    out = []
    for c, stats in LINE_STATS.items():
        n, total = F.sum(f"{c}__n"), F.sum(f"{c}__sum")
        made = {
            "min": lambda c=c: F.min(f"{c}__min"),
            "max": lambda c=c: F.max(f"{c}__max"),
            "sum": lambda total=total: total,
            "mean": lambda n=n, total=total: F.try_divide(total, n),
        }
        out += [made[s]().alias(f"LINE_{c}_{s}") for s in stats if s != "var"]
    shares = [F.try_divide(F.sum(f"flag__{v}").cast("double"), F.sum("lines_n")).alias(f"LINE_l_returnflag_{v}_mean") for v in flags]
    return [*out, *shares, F.sum("lines_n").alias("LINE_count")]


def order_rollup(orders: DataFrame, lines: DataFrame, as_of: str) -> DataFrame:
    """Lines to orders to customers in one chain, with open and finished subsets in the same pass. The rows of the
    orders are written once, as variances need their customers' means first."""
    flags, statuses = label_list(lines, "l_returnflag"), label_list(orders, "o_orderstatus")
    by_order = order_parts(lines, flags)
    rows = orders.join(by_order, "o_orderkey", "left").select(
        "o_custkey",
        "o_orderstatus",
        F.col("o_totalprice").alias("price"),
        F.datediff(F.lit(as_of).cast("date"), F.col("o_orderdate")).alias("age_days"),
        *[c for c in by_order.columns if c != "o_orderkey"],
    )
    rows = checkpointed(rows)
    spread = merged_moments(rows, "o_custkey", SPREAD)
    spread = spread.select(F.col("o_custkey").alias("c_custkey"), *[sample_variance(c).alias(f"LINE_{c}_var") for c in SPREAD])
    out = rows.groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        *stat_exprs(ORDER_STATS, "ORD_"),
        *share_exprs("o_orderstatus", statuses, "ORD_"),
        *stat_exprs({"price": ["mean", "sum"], "age_days": ["min"]}, "OPEN_", F.col("o_orderstatus") == "O"),
        *stat_exprs({"price": ["mean", "sum"], "age_days": ["min"]}, "DONE_", F.col("o_orderstatus") == "F"),
        F.count(F.lit(1)).alias("ORD_count"),
        *line_exprs(flags),
    )
    return out.join(spread, "c_custkey")


def customer_features(customer: DataFrame, orders: DataFrame, lineitem: DataFrame, as_of: str) -> DataFrame:
    """One row per customer: base columns, order and line rollups, ratios."""
    past = orders.where(F.col("o_orderdate") < F.lit(as_of).cast("timestamp_ntz"))
    lines = line_side(lineitem, past)
    out = attach_children(customer, "c_custkey", [order_rollup(past, lines, as_of)])
    return out.withColumns(
        {
            "balance_to_spend": ratio(F.col("balance"), F.col("ORD_price_sum")),
            "lines_per_order": ratio(F.col("LINE_count"), F.col("ORD_count")),
        }
    )


def targets(orders: DataFrame, as_of: str, spend: float) -> DataFrame:
    later = orders.where(F.col("o_orderdate") >= F.lit(as_of).cast("timestamp_ntz"))
    return later.groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        (F.sum("o_totalprice") > spend).cast("int").alias("target")
    )


def feature_names(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c.startswith(("ORD_", "OPEN_", "DONE_", "LINE_"))] + [
        "c_nationkey",
        "balance",
        "balance_to_spend",
        "lines_per_order",
    ]


def cross_validated(features: DataFrame, key: str, folds: int = 3, settings: Settings = Settings(rounds=200, rate=0.5, patience=3)):
    """Out-of-fold scores, mean scores of the unlabelled rows, fold importances. Nulls are learnt from; every fold's
    model stops on its own fold, and all of them grow in the same passes."""
    cols = feature_names(features)
    rows = checkpointed(features.select(key, "target", *cols))
    labelled = m.add_folds(rows.where("target is not null"), [key], folds, seed=1, strata=["target"])
    return out_of_fold(labelled, rows.where("target is null"), cols, "target", key, settings)
