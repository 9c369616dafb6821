"""Panel operators: next period, outcome, temporal split, segments."""

from pyspark.sql import DataFrame, Window as W, functions as F

from panelwise.functions.risk import is_low


def with_next_period(df: DataFrame, entity: str, period: str, level: str, name: str = "next_level") -> DataFrame:
    """Rows that have a level in the very next period, with that level.

    A join, so an entity that repeats within a period matches as often as it occurs.
    """
    following = df.select(
        F.col(entity).alias("_entity"), (F.col(period) - 1).alias("_period"), F.col(level).alias(name)
    ).where(F.col(name).isNotNull())
    same = (F.col(entity) == F.col("_entity")) & (F.col(period) == F.col("_period"))
    return df.join(following, same).drop("_entity", "_period")


def next_value(df: DataFrame, entity: str, period: str, value: str, name: str = "next_level") -> DataFrame:
    """The value one period later, null over a gap. For panels with one row per entity and period."""
    later = W.partitionBy(entity).orderBy(period)
    follows = F.lead(period).over(later) == F.col(period) + 1
    return df.withColumn(name, F.when(follows, F.lead(value).over(later)))


def labelled_panel(
    df: DataFrame, entity: str, period: str, level: str, target: str = "target", next_name: str = "next_level"
) -> DataFrame:
    """Panel rows with a known next level and the outcome. One shuffle: keys are unique, so no self-join."""
    labelled = next_value(df, entity, period, level, next_name).where(F.col(next_name).isNotNull())
    return labelled.withColumn(target, is_low(next_name))


def temporal_split(df: DataFrame, period: str, train_on: str = "first") -> tuple[DataFrame, DataFrame]:
    """Train on the first period, or on all earlier ones, and validate on the last.

    The bounds are scalar subqueries, so they reach the scan as filters.
    """
    last = df.agg(F.max(period)).scalar()
    if train_on == "earlier":
        return df.where(F.col(period) < last), df.where(F.col(period) == last)
    first = df.agg(F.min(period)).scalar()
    return df.where(F.col(period) == first), df.where(F.col(period) == last)


def segments(df: DataFrame, level: str, target: str) -> tuple[DataFrame, DataFrame]:
    """Entry segment (well now, enters risk) and recovery segment (low now, recovers); unknown levels in neither."""
    entry = df.where(F.col(level) >= 0).withColumn("entered", F.col(target))
    recovery = df.where(F.col(level) < 0).withColumn("recovered", 1 - F.col(target))
    return entry, recovery
