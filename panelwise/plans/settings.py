"""Which columns and models a panel uses; the defaults are the student panel's."""

from dataclasses import dataclass, field

from panelwise import fixed
from panelwise.operators.models import STRATEGIES, Features, TreeSizes


@dataclass(frozen=True)
class PanelSettings:
    entity: str = "ra"
    period: str = "ano_referencia"
    level: str = "defasagem"
    target: str = "target_future_risk"
    flag_source: str | None = "ipp"
    strategies: dict[str, Features] = field(default_factory=lambda: dict(STRATEGIES))
    segment_strategy: str = "strategy_b"
    provenance: tuple[str, ...] = ("source_schema", "source_file")
    numeric_summary: tuple[str, ...] = fixed.NUMERIC_SUMMARY_COLUMNS
    categorical_summary: tuple[str, ...] = fixed.CATEGORICAL_SUMMARY_COLUMNS
    sizes: TreeSizes = TreeSizes()
    models: tuple[str, ...] = ("logistic_regression", "random_forest", "hist_gradient_boosting")
    train_on: str = "first"
    parallelism: int = 6

    @property
    def segment_features(self) -> Features:
        return self.strategies[self.segment_strategy]

    @property
    def model_columns(self) -> list[str]:
        """Every column some step of training reads, once."""
        wanted = [self.entity, self.period, self.level, self.target]
        for features in self.strategies.values():
            wanted += features.columns
        wanted += [*self.numeric_summary, *self.categorical_summary]
        return list(dict.fromkeys(wanted))
