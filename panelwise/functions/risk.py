"""Outcome, rule, state and segment columns."""

from pyspark.sql import Column, functions as F

from panelwise import fixed
from panelwise.functions.text import col


def missing_flag(c: Column | str) -> Column:
    return col(c).isNull().cast("int")


def is_low(level: Column | str) -> Column:
    """Target: the level is below zero; null stays null."""
    return (col(level) < 0).cast("int")


def baseline_predict(level: Column | str) -> Column:
    """Persistence rule: low now, low next. An unknown level counts as not low."""
    return F.coalesce(col(level) < 0, F.lit(False)).cast("int")


def state_now(level: Column | str) -> Column:
    return col(level) < 0


def state_group(level: Column | str, low: str = fixed.GROUP_LOW, ok: str = fixed.GROUP_OK) -> Column:
    level = col(level)
    return F.when(level < 0, low).when(level >= 0, ok)


def decide(probability: Column | str, threshold: float = fixed.DECISION_THRESHOLD) -> Column:
    """Positive at or above the threshold."""
    return (col(probability) >= F.lit(threshold)).cast("int")


def hit(actual: Column | str, predicted: Column | str) -> Column:
    return col(actual) == col(predicted)


def residual_type(predicted: Column | str, actual: Column | str) -> Column:
    predicted, actual = col(predicted), col(actual)
    return (
        F.when((predicted == 0) & (actual == 1), "false_negative")
        .when((predicted == 1) & (actual == 0), "false_positive")
        .otherwise("correct")
    )


def transition_columns(group: Column | str, entry: Column | str, recovery: Column | str) -> dict[str, Column]:
    """Segment scores, each only within its group: entry for those well now, recovery for those low now."""
    group, entry, recovery = col(group), col(entry), col(recovery)
    in_entry = (group == fixed.GROUP_OK) & entry.isNotNull()
    in_recovery = (group == fixed.GROUP_LOW) & recovery.isNotNull()
    return {
        fixed.ENTRY_SCORE: F.when(in_entry, entry),
        fixed.RECOVERY_SCORE: F.when(in_recovery, recovery),
        fixed.PERSISTENCE_SCORE: F.when(in_recovery, 1 - recovery),
        fixed.RELEVANT_SCORE: F.when(in_entry, entry).when(in_recovery, recovery),
        fixed.RELEVANT_TYPE: F.when(in_entry, fixed.ENTRY_LABEL).when(in_recovery, fixed.RECOVERY_LABEL),
    }


def low_side(delta: Column | str, higher_is_better: Column | bool, scenario: str) -> Column:
    """Whether low values of a feature go with the effect of the scenario, ``entry`` or ``recovery``.

    A feature where more is better is expected to point to worsening with low values and to
    recovery with high ones. Zero falls to the side that does not match the expectation.
    """
    delta = col(delta)
    better = higher_is_better if isinstance(higher_is_better, Column) else F.lit(higher_is_better)
    expects_low = better if scenario == "entry" else ~better
    return F.when(expects_low, delta < 0).otherwise(delta > 0) == expects_low


def signal_direction(delta: Column | str, higher_is_better: Column | bool, scenario: str) -> tuple[Column, Column]:
    """Direction code and sentence for a group difference."""
    low, known, worse = low_side(delta, higher_is_better, scenario), col(delta).isNotNull(), F.lit(scenario == "entry")
    direction = (
        F.when(~known, fixed.DIRECTION_UNAVAILABLE)
        .when(low & worse, fixed.DIRECTION_LOW_WORSE).when(worse, fixed.DIRECTION_HIGH_WORSE)
        .when(low, fixed.DIRECTION_LOW_BETTER).otherwise(fixed.DIRECTION_HIGH_BETTER)
    )
    interpretation = (
        F.when(~known, fixed.INTERPRETATION_UNAVAILABLE)
        .when(low & worse, fixed.INTERPRETATION_LOW_WORSE).when(worse, fixed.INTERPRETATION_HIGH_WORSE)
        .when(low, fixed.INTERPRETATION_LOW_BETTER).otherwise(fixed.INTERPRETATION_HIGH_BETTER)
    )
    return direction, interpretation


def score_bin(score: Column | str, edges=fixed.SCORE_BIN_EDGES) -> Column:
    """Index of the score's bin; a score on an edge belongs to the bin above it."""
    score = col(score)
    chain = F.when(score.isNull() | F.isnan(score), F.lit(None).cast("int"))
    for index, edge in enumerate(edges):
        chain = chain.when(score < edge, index)
    return chain.otherwise(len(edges))
