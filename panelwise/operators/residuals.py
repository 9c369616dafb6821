"""Where the rule is wrong: group means, category shares, importances and actionable signals."""

from pyspark.sql import Column, DataFrame, functions as F

from panelwise import fixed
from panelwise.frames import null_safe_join, unpivot
from panelwise.functions.risk import baseline_predict, residual_type, signal_direction
from panelwise.functions.text import category
from panelwise.operators.ranking import top_n_per_group

TYPES = ("correct", "false_negative", "false_positive")


def with_residuals(df: DataFrame, level: str, target: str) -> DataFrame:
    ruled = df.withColumn("baseline_pred", baseline_predict(level))
    return ruled.withColumn("error_type", residual_type("baseline_pred", target))


def error_counts(df: DataFrame, by: list[str] = ()) -> DataFrame:
    """Counts of the three residual types; a type without rows counts zero."""
    return df.groupBy(*by).agg(*[F.count_if(F.col("error_type") == t).alias(t) for t in TYPES])


def numeric_summary(df: DataFrame, columns: list[str]) -> DataFrame:
    """Mean per feature and residual type, and the differences to the correct rows.

    In a difference an absent group counts as 0; a group whose values are all missing gives null.
    """
    numbers = [c for c in columns if c in df.columns]
    in_type = lambda c, t: F.avg(F.when(F.col("error_type") == t, F.col(c).cast("double")))
    # One wide pass without grouping keys, then one row per feature.
    wide = df.agg(
        *[in_type(c, t).alias(f"{c}|{t}") for c in numbers for t in TYPES],
        *[F.coalesce(F.max(F.col("error_type") == t), F.lit(False)).alias(f"has_{t}") for t in TYPES],
    )
    rows = [
        F.struct(
            F.lit(c).alias("feature"),
            *[F.col(f"{c}|{t}").alias(f"{t}_mean") for t in TYPES],
            *[F.col(f"has_{t}") for t in TYPES],
        )
        for c in numbers
    ]
    means = wide.select(F.inline(F.array(*rows)))
    in_difference = lambda t: F.when(F.col(f"has_{t}"), F.col(f"{t}_mean")).otherwise(0.0)
    return means.select(
        "feature",
        *[f"{t}_mean" for t in TYPES],
        *[(in_difference(t) - in_difference("correct")).alias(f"{t}_minus_correct") for t in TYPES[1:]],
    )


def categorical_breakdown(df: DataFrame, columns: list[str], n: int = 5) -> DataFrame:
    """Most frequent categories of each column within the two kinds of error, with their share."""
    wrong = df.where(F.col("error_type") != "correct")
    present = [c for c in columns if c in df.columns]
    long = unpivot(wrong, ["error_type"], present, "string").withColumn("category", category("value"))
    groups = ["error_type", "feature"]
    counts = long.groupBy(*groups, "category").agg(F.count("*").alias("n"))
    # Every row has one category per column, so the total is the same for all columns: two numbers.
    totals = wrong.groupBy("error_type").agg(F.count("*").alias("total"))
    top = top_n_per_group(counts, groups, [F.col("n").desc(), F.col("category")], n, "rank")
    return top.join(F.broadcast(totals), "error_type").select(
        *groups, "rank", "category", (F.col("n") / F.col("total")).alias("share")
    )


def base_feature(name: Column, features: list[str]) -> Column:
    """Encoded feature name to its feature: exact, else the longest ``feature_`` prefix, else itself."""
    chain = F.when(name.isin(*features), name)
    for feature in sorted(features, key=len, reverse=True):
        chain = chain.when(name.startswith(feature + "_"), F.lit(feature))
    return chain.otherwise(name)


def grouped_importances(encoded: DataFrame, features: list[str], n: int | None = 10) -> DataFrame:
    """Sum of the encoded columns' importances per feature, the largest first."""
    summed = encoded.groupBy(base_feature(F.col("name"), features).alias("feature")).agg(
        F.sum("importance").alias("importance")
    )
    ordered = summed.orderBy(F.col("importance").desc(), "feature")
    return ordered if n is None else ordered.limit(n)


def action_frame(spark, actionable=fixed.ACTIONABLE) -> DataFrame:
    """The fixed table of actionable features; more is better for all of them."""
    rows = [(name, label, True, hint) for name, label, hint in actionable]
    return spark.createDataFrame(rows, "feature string, label string, higher_is_better boolean, action_hint string")


def actionable(importances: DataFrame, summary: DataFrame, scenario: str, actions: DataFrame | None = None) -> DataFrame:
    """Important features one can act on, with the direction of their association.

    ``scenario`` is ``entry`` (compared on missed cases) or ``recovery`` (compared on false alarms).
    """
    actions = action_frame(importances.sparkSession) if actions is None else actions
    delta = "false_negative_minus_correct" if scenario == "entry" else "false_positive_minus_correct"
    deltas = summary.select("feature", F.col(delta).alias("comparison_delta"))
    # All three have one row per feature.
    known = null_safe_join(importances, F.broadcast(actions), ["feature"])
    rows = null_safe_join(known, F.broadcast(deltas), ["feature"], "left")
    direction, interpretation = signal_direction("comparison_delta", F.col("higher_is_better"), scenario)
    return rows.select(
        F.lit(scenario).alias("scenario"), "feature", "label", "importance",
        direction.alias("direction"), interpretation.alias("interpretation"), "action_hint", "comparison_delta",
    )
