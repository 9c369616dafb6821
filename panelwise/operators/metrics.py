"""Decision and ranking metrics of binary scores, for any number of groups at once."""

from pyspark.sql import Column, DataFrame, functions as F

from panelwise.functions.text import col
from panelwise.operators.running import running_totals

FULL = ["f2", "recall", "precision", "pr_auc", "roc_auc", "brier"]


def ratio(part: Column, whole: Column) -> Column:
    """Zero when there is nothing to divide by."""
    return F.when(whole == 0, 0.0).otherwise(part / whole)


def decision_metrics(tp: Column, fp: Column, fn: Column) -> dict[str, Column]:
    """Precision, recall and F2 from a confusion table; F2 = 5 tp / (5 tp + 4 fn + fp)."""
    return {
        "precision": ratio(tp, tp + fp),
        "recall": ratio(tp, tp + fn),
        "f2": ratio(5 * tp, 5 * tp + 4 * fn + fp),
    }


def confusion(y: Column | str, pred: Column | str, weight: Column | int = 1) -> dict[str, Column]:
    y, pred = col(y), col(pred)
    weight = weight if isinstance(weight, Column) else F.lit(weight)

    def total(condition: Column) -> Column:
        return F.sum(F.when(condition, weight).otherwise(0)).cast("long")

    return {
        "tp": total((y == 1) & (pred == 1)),
        "fp": total((y == 0) & (pred == 1)),
        "fn": total((y == 1) & (pred == 0)),
        "tn": total((y == 0) & (pred == 0)),
    }


def binary_metrics(df: DataFrame, y: str, pred: str, by: list[str] = (), probability: str | None = None) -> DataFrame:
    """One pass: confusion table, precision, recall, F2 and, with a probability, the Brier score."""
    columns = [v.alias(k) for k, v in confusion(y, pred).items()]
    if probability:
        error = F.col(probability) - F.col(y)
        columns.append(F.avg(error * error).alias("brier"))
    table = df.groupBy(*by).agg(*columns)
    for name, value in decision_metrics(F.col("tp"), F.col("fp"), F.col("fn")).items():
        table = table.withColumn(name, value)
    return table


def score_counts(df: DataFrame, by: list[str], y: str, score: str, pred: str | None = None, weight: str | None = None):
    """One row per group and distinct score: positives, negatives, and those decided positive."""
    one = F.col(weight) if weight else F.lit(1)
    positive = F.when(F.col(y) == 1, one).otherwise(0)
    negative = F.when(F.col(y) == 0, one).otherwise(0)
    columns = [F.sum(positive).cast("long").alias("pos"), F.sum(negative).cast("long").alias("neg")]
    if pred:
        chosen = F.col(pred) == 1
        columns.append(F.sum(F.when(chosen, positive).otherwise(0)).cast("long").alias("tp"))
        columns.append(F.sum(F.when(chosen, negative).otherwise(0)).cast("long").alias("fp"))
    usable = F.col(y).isNotNull() & F.col(score).isNotNull()
    return df.where(usable).groupBy(*by, F.col(score).cast("double").alias("score")).agg(*columns)


def cumulative_counts(
    counts: DataFrame, by: list[str], score: str = "score", slices: int | None = None, groups: int | None = None
) -> DataFrame:
    """Positives and negatives above each score, and at or above it, from the highest score down."""
    counted = [c for c in ("pos", "neg", "tp", "fp") if c in counts.columns]
    running = running_totals(counts, by, score, ["pos", "neg"], ascending=False, slices=slices, counted=counted, groups=groups)
    return running.withColumns(
        {"cum_pos": F.col("pos_before") + F.col("pos"), "cum_neg": F.col("neg_before") + F.col("neg")}
    )


def ranking_columns() -> dict[str, Column]:
    """Average precision and ROC-AUC over a cumulative table; null when only one class is there."""
    pos, neg = F.sum("pos"), F.sum("neg")
    precision_at = F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg"))
    # A pair counts when the positive is ranked above the negative, and half at the same score.
    wins = F.col("neg") * (F.col("pos_before") + F.col("pos") / 2)
    both = (pos > 0) & (neg > 0)
    return {
        "pr_auc": F.when(both, F.sum(F.col("pos") * precision_at) / pos),
        "roc_auc": F.when(both, F.sum(wins) / (pos.cast("double") * neg)),
    }


def average_precision(df: DataFrame, y: str, score: str, by: list[str] = (), slices: int | None = None) -> DataFrame:
    table = cumulative_counts(score_counts(df, list(by), y, score), list(by), slices=slices)
    return table.groupBy(*by).agg(ranking_columns()["pr_auc"].alias("pr_auc"))


def roc_auc(df: DataFrame, y: str, score: str, by: list[str] = (), slices: int | None = None) -> DataFrame:
    table = cumulative_counts(score_counts(df, list(by), y, score), list(by), slices=slices)
    return table.groupBy(*by).agg(ranking_columns()["roc_auc"].alias("roc_auc"))


def full_metrics(
    df: DataFrame, y: str, score: str, pred: str, by: list[str] = (), weight: str | None = None, slices: int | None = None,
    groups: int | None = None,
) -> DataFrame:
    """All six metrics per group, plus the confusion table, from one table of distinct scores."""
    counts = score_counts(df, list(by), y, score, pred, weight)
    table = cumulative_counts(counts, list(by), slices=slices, groups=groups)
    squares = F.col("pos") * F.pow(1 - F.col("score"), 2) + F.col("neg") * F.pow("score", 2)
    rows = F.sum(F.col("pos") + F.col("neg"))
    metrics = table.groupBy(*by).agg(
        rows.alias("rows"),
        F.sum("tp").alias("tp"),
        F.sum("fp").alias("fp"),
        (F.sum("pos") - F.sum("tp")).alias("fn"),
        (F.sum("neg") - F.sum("fp")).alias("tn"),
        *[value.alias(name) for name, value in ranking_columns().items()],
        (F.sum(squares) / rows).alias("brier"),
    )
    for name, value in decision_metrics(F.col("tp"), F.col("fp"), F.col("fn")).items():
        metrics = metrics.withColumn(name, value)
    return metrics.select(*by, "rows", "tp", "fp", "fn", "tn", *FULL)


def n_classes(df: DataFrame, label: str, by: list[str] = ()) -> DataFrame:
    """Number of classes and whether ranking metrics and fits are possible."""
    # Labels are few; counting them in two steps keeps a frequent one from being sent around row by row.
    classes = df.where(F.col(label).isNotNull()).groupBy(*by, label).agg(F.count("*").alias("n"))
    return classes.groupBy(*by).agg(
        F.count("*").alias("classes"), F.sum("n").alias("rows"), (F.count("*") >= 2).alias("usable")
    )
