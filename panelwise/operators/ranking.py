"""Orders, limits, top-n, first rows, shares and modes."""

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from panelwise.frames import null_safe_join, per_group
from panelwise.functions.risk import score_bin
from panelwise.functions.text import natural_key, parse_number, sort_kind
from panelwise.operators.running import Key, positions


def top_n_per_group(df: DataFrame, by: list[str], order: list, n: int, name: str = "rank") -> DataFrame:
    """First ``n`` rows per group. The limit applies before the shuffle too, so a large group stays small."""
    return df.withColumn(name, F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col(name) <= n)


def first_per_key(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """One row per key, the first in order."""
    return top_n_per_group(df, keys, order, 1, "_first").drop("_first")


def share_within(df: DataFrame, by: list[str], n: str | list[str], name: str | list[str] = "share", groups: int | None = None) -> DataFrame:
    """Part of the group's total, of one column or of several at once.

    The totals are aggregated and joined back, so a large group is not one task; ``groups`` is a known
    bound on the number of groups, with which they are broadcast.
    """
    columns, names = ([x] if isinstance(x, str) else x for x in (n, name))
    totals = df.groupBy(*by).agg(*[F.sum(c).alias(f"_total_{i}") for i, c in enumerate(columns)])
    joined = null_safe_join(df, per_group(totals, groups), by)
    shares = {name: F.col(c) / F.col(f"_total_{i}") for i, (c, name) in enumerate(zip(columns, names, strict=True))}
    return joined.withColumns(shares).drop(*[f"_total_{i}" for i in range(len(columns))])


def mode_per_group(df: DataFrame, by: list[str], column: str) -> DataFrame:
    """Most frequent value, the smallest among equals; missing values do not count.

    Values are counted first, so neither a large group nor many values meet in one task's memory.
    """
    counts = df.where(F.col(column).isNotNull()).groupBy(*by, column).agg(F.count("*").alias("_n"))
    best = F.min(F.struct((-F.col("_n")).alias("n"), F.col(column).alias("v")))["v"]
    return counts.groupBy(*by).agg(best.alias(column))


def order_panel(df: DataFrame, period: str, entity: str) -> DataFrame:
    return df.orderBy(period, entity)


def number_panel(df: DataFrame, period: str, entity: str, name: str = "position") -> DataFrame:
    """Each row's place in the order of the panel, as a column that later steps can rely on."""
    return positions(df, [Key(period), Key(entity)], name=name)


def preview(df: DataFrame, n: int, *order) -> DataFrame:
    """First rows of an explicit order."""
    return df.orderBy(*order).limit(n)


def mixed_keys(column: str) -> dict[str, Column]:
    """The parts of the order of mixed cells: kind, number, text."""
    kind = sort_kind(column)
    return {
        "_kind": kind, "_number": F.when(kind == 0, parse_number(F.trim(F.col(column)), "heuristic")),
        "_text": F.when(kind == 1, natural_key(column)),
    }


def sort_mixed(df: DataFrame, column: str, position: str, ascending: bool = True) -> DataFrame:
    """Order of a column of mixed cells: numbers, then text, then empty; descending turns all of it round.

    Equal cells keep the order of ``position``.
    """
    keys = mixed_keys(column)
    turn = (lambda c: F.col(c).asc()) if ascending else (lambda c: F.col(c).desc())
    return df.withColumns(keys).orderBy(*[turn(k) for k in keys], F.col(position).asc()).drop(*keys)


def number_mixed(df: DataFrame, column: str, position: str, ascending: bool = True, name: str = "rank") -> DataFrame:
    """Each row's place in that order."""
    parts = [Key(value, ascending, nulls_last=not ascending) for value in mixed_keys(column).values()]
    return positions(df, [*parts, Key(position)], name=name)


def priority_list(df: DataFrame, group: str, value: str, score: str, entity: str) -> DataFrame:
    """Rows of one group, the highest score first, unknown scores last."""
    return df.where(F.col(group) == value).orderBy(F.col(score).desc_nulls_last(), entity)


def number_priorities(df: DataFrame, group: str, score: str, *ties: str, name: str = "rank", groups: int | None = None) -> DataFrame:
    """Each row's place in the priority list of its group. With a known bound on the ``groups`` no group is shuffled as one key."""
    return positions(df, [Key(score, ascending=False, nulls_last=True), *[Key(t) for t in ties]], [group], name, groups=groups)


def score_bins(df: DataFrame, score: str, by: list[str] = ()) -> DataFrame:
    """Rows per fifth of the score range."""
    return df.where(score_bin(score).isNotNull()).groupBy(*by, score_bin(score).alias("bin")).agg(F.count("*").alias("n"))


def batch_summary(df: DataFrame, probability: str, group: str, groups: list[str], high: float) -> DataFrame:
    """Mean probability, unknown as zero, number of high ones, rows per group."""
    known: Column = F.coalesce(F.col(probability), F.lit(0.0))
    return df.agg(
        F.count("*").alias("rows"),
        F.coalesce(F.avg(known), F.lit(0.0)).alias("mean_probability"),
        F.count_if(known >= high).alias("high_priority"),
        *[F.count_if(F.col(group) == value).alias(f"rows_{value}") for value in groups],
    )
