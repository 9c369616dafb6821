"""Train, compare, select and refit; residual study and segment models."""

from dataclasses import dataclass
from functools import cached_property

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, functions as F

from panelwise import fixed
from panelwise.frames import materialize
from panelwise.functions.risk import baseline_predict
from panelwise.operators.metrics import FULL, full_metrics
from panelwise.operators.models import (
    Bundle, Later, baseline_bundle, bounded, candidates, class_counts, coerce_features, encode, fit, fit_all,
    fit_encoder, fit_on, forest, probability_of, score_all, spread, studied_importances, with_missing_flag,
)
from panelwise.operators.panel import labelled_panel, segments
from panelwise.operators.residuals import (
    categorical_breakdown, error_counts, grouped_importances, numeric_summary, with_residuals,
)
from panelwise.plans.settings import PanelSettings


class ModelingError(ValueError):
    """Training, scoring or evaluation is not possible with what there is."""


def labelled_frame(panel: DataFrame, s: PanelSettings) -> DataFrame:
    """Labelled rows with only the columns models and studies read."""
    rows = with_missing_flag(panel, s.flag_source) if s.flag_source else panel
    rows = rows.withColumn(s.level, F.col(s.level).cast("double"))
    labelled = labelled_panel(rows, s.entity, s.period, s.level, s.target)
    return labelled.select(*[F.col(c) if c in labelled.columns else F.lit(None).cast("double").alias(c) for c in s.model_columns])


def metrics_of(scored: DataFrame, target: str, by: list[str], groups: int = 1) -> dict:
    """Six metrics per model in one aggregate: a handful of numbers."""
    rows = full_metrics(scored, target, fixed.PROBABILITY, fixed.PREDICTION, by, groups=groups).collect()
    return {tuple(row[b] for b in by): {name: row[name] for name in FULL} for row in rows}


def select_winner(rows: list[dict]) -> dict:
    """Highest F2, the earlier one on ties; the rule is not eligible."""
    return max((r for r in rows if r["model_name"] != fixed.BASELINE_MODEL), key=lambda r: r["metrics"]["f2"])


def fit_candidates(df: DataFrame, counts: dict[int, int], s: PanelSettings, validation_period: int | None = None) -> list[Bundle]:
    """Every strategy with every model, each fitted when it is first used. Models of one strategy share the encoded rows."""
    if len(counts) < 2:
        raise ModelingError("the training rows hold only one class")
    rows = bounded(df, sum(counts.values()), s.sizes.fit_rows)
    used = Later(lambda: class_counts(rows, s.target)) if rows is not df else lambda: counts

    def prepared(strategy: str) -> Later:
        features = s.strategies[strategy]
        encoder = Later(lambda: fit_encoder(rows, features))
        return Later(lambda: (spread(encode(rows, features, encoder(), s.target, used()), sum(used().values())), encoder()))

    def model(strategy: str, name: str, ready: Later) -> Later:
        estimator = lambda: candidates(s.sizes, s.target, sum(used().values()))[name]
        return Later(lambda: fit_on(*ready(), estimator()))

    bundles = []
    for strategy in s.strategies:
        ready = prepared(strategy)
        bundles += [
            Bundle(name, strategy, s.strategies[strategy], model(strategy, name, ready), validation_period=validation_period)
            for name in s.models
        ]
    return bundles


class Training:
    """The rows of a training and its models. What is not asked for is not fitted: the frozen candidates are fitted
    when they are compared, and of those refitted on all rows only the ones that are used or saved."""

    def __init__(self, labelled: DataFrame, counts: dict[tuple[int, int], int], s: PanelSettings):
        self.settings, self.labelled = s, labelled
        periods = sorted({p for p, _ in counts})
        if not periods:
            raise ModelingError("no two consecutive periods to label")
        first, last = periods[0], periods[-1]
        if first == last:
            raise ModelingError("two labelled periods are needed for training and validation")
        trained_on = [p for p in periods if (p < last if s.train_on == "earlier" else p == first)]
        of = lambda wanted: {c: sum(n for (p, y), n in counts.items() if p in wanted and y == c) for c in {y for p, y in counts if p in wanted}}
        self.validation_period = int(last)
        self.train = labelled.where(F.col(s.period).isin(trained_on))
        self.validation = labelled.where(F.col(s.period) == last)
        self.training_rows, self.validation_rows = sum(of(trained_on).values()), sum(of([last]).values())
        rule = baseline_bundle(s.level, int(last))
        self.frozen = [rule, *fit_candidates(self.train, of(trained_on), s, int(last))]
        self.operational = [baseline_bundle(s.level), *fit_candidates(labelled, of(periods), s)]

    def measure(self, bundles: list[Bundle]) -> list[dict]:
        """Names and metrics on the validation rows."""
        s = self.settings
        fit_all(bundles, s.parallelism)
        scored = score_all(bundles, self.validation, [s.target], s.level).withColumn(s.target, F.col(s.target).cast("int"))
        measured = metrics_of(scored, s.target, ["model_id"], len(bundles))
        return [{"model_name": b.model_name, "strategy": b.strategy, "metrics": measured[(b.model_id,)]} for b in bundles]

    @cached_property
    def candidates(self) -> list[dict]:
        return self.measure(self.frozen)

    @cached_property
    def winner(self) -> Bundle:
        """The best candidate, refitted on all labelled rows."""
        best = select_winner(self.candidates)
        return self.model(f"{best['model_name']}{fixed.MODEL_ID_SEPARATOR}{best['strategy']}")

    def model(self, model_id: str) -> Bundle:
        """The rule or a refitted candidate, whichever has won."""
        return next(b for b in self.operational if b.model_id == model_id)

    def reference_of(self, bundle: Bundle) -> DataFrame:
        """The rows a model was refitted on, as it saw them."""
        return coerce_features(self.labelled, bundle.features)

    @property
    def reference(self) -> DataFrame:
        return self.reference_of(self.winner)


def train_and_select(panel: DataFrame, s: PanelSettings = PanelSettings()) -> Training:
    """Fit on the first labelled period, compare on the last, refit on everything; models are fitted when they are needed."""
    labelled = materialize(labelled_frame(panel, s), s.period)
    counted = labelled.groupBy(s.period, s.target).agg(F.count("*")).collect()  # a few numbers
    return Training(labelled, {(r[0], int(r[1])): r[2] for r in counted}, s)


# --- segment models ----------------------------------------------------------
class Segment:
    """One segment: a trial measured on the validation rows, and a refit on both; or why there is no model."""

    def __init__(self, train: DataFrame, validation: DataFrame, target: str, label_name: str, s: PanelSettings):
        in_train, in_validation = class_counts(train, target), class_counts(validation, target)
        self.reason = None
        if not in_train or not in_validation:
            self.reason = f"segment {label_name} has no rows"
        elif len(in_train) < 2 or len(in_validation) < 2:
            self.reason = f"segment {label_name} has one class only"
        self.status = "unavailable" if self.reason else "available"
        features, estimator = s.segment_features, forest(s.sizes, target)
        self.bundle = None
        if not self.reason:
            both = {c: in_train.get(c, 0) + in_validation.get(c, 0) for c in {*in_train, *in_validation}}
            model = Later(lambda: fit(train.unionByName(validation), features, estimator, target, both))
            self.bundle = Bundle("random_forest", fixed.SEGMENT_STRATEGY, features, model, kind="segment", label_name=label_name)

        def measure() -> dict:
            trial = fit(train, features, estimator, target, in_train)
            scored = probability_of(trial, validation, features, [target], fixed.PROBABILITY).withColumn(
                fixed.PREDICTION, (F.col(fixed.PROBABILITY) >= fixed.DECISION_THRESHOLD).cast("int")
            )
            return metrics_of(scored, target, [])[()]

        self._metrics = Later(measure)

    @property
    def metrics(self) -> dict | None:
        return None if self.reason else self._metrics()


def fit_segments(train: DataFrame, validation: DataFrame, s: PanelSettings = PanelSettings()) -> dict[str, Segment]:
    entry_train, recovery_train = segments(train, s.level, s.target)
    entry_valid, recovery_valid = segments(validation, s.level, s.target)
    return {
        fixed.ENTRY_LABEL: Segment(entry_train, entry_valid, "entered", fixed.ENTRY_LABEL, s),
        fixed.RECOVERY_LABEL: Segment(recovery_train, recovery_valid, "recovered", fixed.RECOVERY_LABEL, s),
    }


# --- residual study of the rule ----------------------------------------------
def importance_study(df: DataFrame, target: str, s: PanelSettings, n: int = 10) -> DataFrame:
    """Features a forest needs to explain the target; no rows when there is only one class."""
    counts = class_counts(df, target)
    if len(counts) < 2:
        return df.sparkSession.createDataFrame([], "feature string, importance double")
    encoded = studied_importances(df, s.segment_features, forest(s.sizes, target), target, counts)
    return grouped_importances(encoded, list(s.segment_features.columns), n)


def importance_model(df: DataFrame, target: str, s: PanelSettings) -> PipelineModel | None:
    """The forest of the study."""
    counts = class_counts(df, target)
    return fit(df, s.segment_features, forest(s.sizes, target), target, counts) if len(counts) > 1 else None


@dataclass(frozen=True)
class ResidualStudy:
    metrics: DataFrame
    errors: DataFrame
    numeric: DataFrame
    categorical: DataFrame
    entry_importances: DataFrame
    recovery_importances: DataFrame


def residual_analysis(validation: DataFrame, s: PanelSettings = PanelSettings()) -> ResidualStudy:
    """Where the persistence rule is wrong, on the validation rows."""
    rows = with_residuals(validation, s.level, s.target)
    scored = rows.withColumn("_score", F.col("baseline_pred").cast("double"))
    missed = rows.where("baseline_pred = 0").withColumn("entered", F.col(s.target))
    alarmed = rows.where("baseline_pred = 1").withColumn("recovered", 1 - F.col(s.target))
    return ResidualStudy(
        metrics=full_metrics(scored, s.target, "_score", "baseline_pred"),
        errors=error_counts(rows),
        numeric=numeric_summary(rows, list(s.numeric_summary)),
        categorical=categorical_breakdown(rows, list(s.categorical_summary)),
        entry_importances=importance_study(missed, "entered", s),
        recovery_importances=importance_study(alarmed, "recovered", s),
    )


def baseline_metrics(df: DataFrame, level: str, target: str, by: list[str]) -> DataFrame:
    """How well the current state predicts the next one, per group."""
    ruled = df.withColumn("_pred", baseline_predict(level)).withColumn("_score", F.col("_pred").cast("double"))
    return full_metrics(ruled, target, "_score", "_pred", by)


