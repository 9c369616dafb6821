"""Run tables: latest run, candidates, events, evaluation summary."""

from pyspark.sql import DataFrame, functions as F

from panelwise import fixed
from panelwise.functions.text import model_id, split_model_id
from panelwise.operators.running import Key, positions


def latest(df: DataFrame, run_id: str = "id") -> DataFrame:
    """The row with the largest id; a top-1 per task, then one row overall."""
    return df.orderBy(F.col(run_id).desc()).limit(1)


def latest_per(df: DataFrame, by: list[str], run_id: str = "id") -> DataFrame:
    others = [c for c in df.columns if c not in by]
    return df.groupBy(*by).agg(F.max_by(F.struct(*others), run_id).alias("_run")).select(*by, "_run.*")


def rows_of(rows: DataFrame, runs: DataFrame, foreign: str, run_id: str = "id") -> DataFrame:
    """Child rows with a recorded run; children of a run that never finished are not seen."""
    return rows.join(runs.select(F.col(run_id).alias(foreign)), foreign, "left_semi")


def recent_events(df: DataFrame, n: int = 200, order: str = "id") -> DataFrame:
    """The last ``n`` events, oldest first."""
    if not 1 <= n <= 1000:
        raise ValueError("between 1 and 1000 events")
    return df.orderBy(F.col(order).desc()).limit(n).orderBy(order)


def event_counts(df: DataFrame, n: int = 200, order: str = "id", level: str = "level") -> DataFrame:
    return recent_events(df, n, order).groupBy(level).agg(F.count("*").alias("n"))


def explode_candidates(runs: DataFrame, candidates: str = "candidates", keep: list[str] = ("id",)) -> DataFrame:
    """One row per candidate of each run, with its position and the number of candidates."""
    listed = runs.select(*keep, F.size(candidates).alias("candidate_count"), F.posexplode(candidates).alias("position", "c"))
    return listed.select(*keep, "candidate_count", "position", "c.*")


def rank_candidates(df: DataFrame, f2: str = "f2", position: str = "position", include_baseline: bool = True,
                    name: str = "model_name") -> DataFrame:
    """Highest F2 first, unknown as zero, earlier ones first on ties."""
    kept = df if include_baseline else df.where(F.col(name) != fixed.BASELINE_MODEL)
    return kept.orderBy(F.coalesce(F.col(f2), F.lit(0.0)).desc(), position)


def number_candidates(df: DataFrame, by: list[str], f2: str = "f2", position: str = "position", include_baseline: bool = True,
                      name: str = "model_name", rank: str = "rank") -> DataFrame:
    """Each candidate's place in its run."""
    kept = df if include_baseline else df.where(F.col(name) != fixed.BASELINE_MODEL)
    return positions(kept, [Key(F.coalesce(F.col(f2), F.lit(0.0)), ascending=False), Key(position)], by, rank)


def best_candidate(df: DataFrame, by: list[str], f2: str = "f2", position: str = "position",
                   include_baseline: bool = True, name: str = "model_name") -> DataFrame:
    """The best candidate per group; the rule is only eligible when asked for."""
    kept = df if include_baseline else df.where(F.col(name) != fixed.BASELINE_MODEL)
    others = [c for c in df.columns if c not in by]
    key = F.struct(F.coalesce(F.col(f2), F.lit(0.0)), -F.col(position))
    return kept.groupBy(*by).agg(F.max_by(F.struct(*others), key).alias("_best")).select(*by, "_best.*")


def pick_winner(df: DataFrame, by: list[str] = (), **columns) -> DataFrame:
    return best_candidate(df, list(by), include_baseline=False, **columns)


def flag_best(df: DataFrame, by: list[str], f2: str = "f2", position: str = "position") -> DataFrame:
    """Candidates with their id and whether they are the best of their run, the rule included."""
    best = best_candidate(df, by, f2, position).select(*by, F.col(position).alias("_best"))
    flagged = df.join(best, by)
    return flagged.withColumns({
        "model_id": model_id("model_name", "strategy"), "is_best_overall": F.col(position) == F.col("_best"),
    }).drop("_best")


def evaluation_summary(
    rows: DataFrame, selected: str | None, actual: str = fixed.ACTUAL, predicted: str = fixed.PREDICTION,
    name: str = fixed.MODEL_USED, strategy: str = fixed.STRATEGY_USED,
) -> DataFrame:
    """Rows, accuracy, predicted and actual positives of the selected model, or of all rows when it has none."""
    if selected:
        wanted = split_model_id(F.lit(selected))
        matches = F.coalesce((F.col(name) == wanted[0]) & (F.col(strategy) == wanted[1]), F.lit(False))
    else:
        matches = F.lit(True)
    # Both answers in one pass, the fallback chosen at the end.
    right = (F.col(predicted) == F.col(actual)).cast("double")

    def facts(condition):
        pick = lambda c: F.when(condition, c)
        return F.struct(
            F.count(pick(F.lit(1))).alias("rows"),
            F.avg(pick(F.coalesce(right, F.lit(0.0)))).alias("accuracy"),
            F.sum(pick(F.col(predicted))).cast("long").alias("predicted_positive"),
            F.sum(pick(F.col(actual))).cast("long").alias("actual_positive"),
        )

    both = rows.agg(facts(matches).alias("selected"), facts(F.lit(True)).alias("every"))
    chosen = F.when(F.col("selected.rows") > 0, F.col("selected")).otherwise(F.col("every"))
    return both.select(chosen.alias("s")).select("s.*")


def overview(status: DataFrame, training: DataFrame, drift: DataFrame, evaluation: DataFrame,
             baseline: DataFrame, transition: DataFrame) -> DataFrame:
    """One row over the latest runs; every argument holds at most one row."""
    def one(df: DataFrame, **columns):
        return {name: df.select(value).scalar() for name, value in columns.items()}

    facts = {
        **one(training, selected_model=F.col("selected_model"), selected_strategy=F.col("selected_strategy"),
              training_metrics=F.col("metrics"), training_run_id=F.col("id"), _training_version=F.col("data_version"),
              _candidates=F.size("candidates")),
        **one(drift, drift_run_id=F.col("id"), _alerts=F.col("alert_count"), _drift_version=F.col("data_version")),
        **one(evaluation, latest_evaluation=F.struct(*evaluation.columns), _evaluation_version=F.col("data_version")),
        **one(baseline, baseline_analysis=F.struct(*baseline.columns)),
        **one(transition, transition_scores=F.struct(*transition.columns)),
    }
    return status.withColumns(facts).withColumns({
        "data_version": F.coalesce("_training_version", "_drift_version", "_evaluation_version"),
        "candidate_count": F.coalesce("_candidates", F.lit(0)),
        "drift_alert_count": F.coalesce("_alerts", F.lit(0)),
    }).drop("_training_version", "_drift_version", "_evaluation_version", "_candidates", "_alerts")
