"""The consolidated table and the run tables, as Parquet folders under one root."""

import time
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from panelwise import fixed
from panelwise.functions.payload import iso_timestamp
from panelwise.operators.consolidate import data_version, sanitize
from panelwise.operators.normalize import conform
from panelwise.operators.runs import latest, recent_events

METRICS = "STRUCT<f2: DOUBLE, recall: DOUBLE, precision: DOUBLE, pr_auc: DOUBLE, roc_auc: DOUBLE, brier: DOUBLE>"
SEGMENT_METRICS = METRICS[:-1] + ", status: STRING, reason: STRING>"
CANDIDATE = f"STRUCT<model_name: STRING, strategy: STRING, metrics: {METRICS}>"
IMPORTANCES = "ARRAY<STRUCT<feature: STRING, importance: DOUBLE>>"
NUMERIC_ROWS = (
    "ARRAY<STRUCT<feature: STRING, correct_mean: DOUBLE, false_negative_mean: DOUBLE, false_positive_mean: DOUBLE, "
    "false_negative_minus_correct: DOUBLE, false_positive_minus_correct: DOUBLE>>"
)
CATEGORY_ROWS = "ARRAY<STRUCT<error_type: STRING, feature: STRING, rank: INT, category: STRING, share: DOUBLE>>"
DRIFT_ROWS = (
    "ARRAY<STRUCT<feature: STRING, type: STRING, reference_mean: DOUBLE, current_mean: DOUBLE, psi: DOUBLE, "
    "reference_top: STRING, current_top: STRING, distribution_shift: DOUBLE, new_category_rate: DOUBLE, alert: BOOLEAN>>"
)
SUMMARY = (
    "STRUCT<model_id: STRING, model_name: STRING, strategy: STRING, compared_rows: BIGINT, f2: DOUBLE, recall: DOUBLE, "
    "precision: DOUBLE, pr_auc: DOUBLE, roc_auc: DOUBLE, brier: DOUBLE, output_file: STRING>"
)
FILE_COLUMNS = "source_file STRING, detected_schema STRING, reference_year INT"

# Run tables: columns beyond the shared id and created_at.
RUN_TABLES = {
    "ingestion_runs": f"{FILE_COLUMNS}, input_rows BIGINT, inserted_rows BIGINT, duplicate_rows BIGINT, "
                      "unknown_columns ARRAY<STRING>, data_version STRING, stream_batch STRING, "
                      "total_rows BIGINT, rows_by_period MAP<INT, BIGINT>",
    "training_runs": f"selected_model STRING, selected_strategy STRING, metrics {METRICS}, candidates ARRAY<{CANDIDATE}>, "
                     "selected_feature_columns ARRAY<STRING>, training_rows BIGINT, validation_rows BIGINT, data_version STRING",
    "baseline_analysis_runs": f"training_run_id BIGINT, validation_reference_year INT, baseline_metrics {METRICS}, "
                              "error_counts MAP<STRING, BIGINT>, "
                              f"numeric_summary {NUMERIC_ROWS}, categorical_summary {CATEGORY_ROWS}, "
                              f"false_negative_importances {IMPORTANCES}, recovery_importances {IMPORTANCES}, data_version STRING",
    "transition_score_runs": "training_run_id BIGINT, validation_reference_year INT, entry_model_name STRING, "
                             "recovery_model_name STRING, strategy_name STRING, "
                             f"entry_metrics {SEGMENT_METRICS}, recovery_metrics {SEGMENT_METRICS}, data_version STRING",
    "prediction_runs": f"{FILE_COLUMNS}, selected_model STRING, selected_strategy STRING, row_count BIGINT, data_version STRING",
    "evaluation_runs": f"{FILE_COLUMNS}, current_year INT, next_year INT, evaluation_mode STRING, selected_model_id STRING, "
                       f"metrics {METRICS}, summaries ARRAY<{SUMMARY}>, compared_rows BIGINT, data_version STRING",
    "drift_runs": f"{FILE_COLUMNS}, feature_rows BIGINT, alert_count BIGINT, details {DRIFT_ROWS}, data_version STRING",
    "app_events": "level STRING, logger STRING, message STRING, context MAP<STRING, STRING>",
}


def run_schema(table: str) -> T.StructType:
    return T.StructType.fromDDL(f"id BIGINT, {RUN_TABLES[table]}, created_at TIMESTAMP")


@dataclass(frozen=True)
class Store:
    """One root folder; every table is append-only. One writer at a time is assumed for new run ids."""

    spark: SparkSession
    root: str
    schema: T.StructType = fixed.CANONICAL
    entity: str = "ra"
    period: str = "ano_referencia"

    def path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def _scan(self, table: str, schema: T.StructType) -> DataFrame:
        """The table, or no rows of its schema while it does not exist."""
        try:
            return self.spark.read.schema(schema).parquet(self.path(table))
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    # --- consolidated records ---
    def records(self) -> DataFrame:
        fields = [f for f in self.schema if f.name != self.period]
        run = T.StructField("ingestion_run_id", T.LongType())
        return self._scan("records", T.StructType([*fields, run, self.schema[self.period]]))

    def append_records(self, df: DataFrame, run_id=None) -> None:
        """Append canonical rows with their ingestion id, one folder per period."""
        stamped = conform(sanitize(df), self.schema)
        if run_id is not None:
            stamped = stamped.withColumn("ingestion_run_id", F.lit(run_id).cast("long"))
        else:
            stamped = stamped.withColumn("ingestion_run_id", F.lit(None).cast("long"))
        self.write_records(stamped)

    def write_records(self, stamped: DataFrame) -> None:
        """Files of even size per period: a large period is split, small pieces are put together."""
        even = stamped.hint("rebalance", self.period)
        even.write.mode("append").partitionBy(self.period).parquet(self.path("records"))

    def load_consolidated(self) -> DataFrame:
        """Canonical columns in order, by period and entity."""
        return conform(self.records(), self.schema).orderBy(self.period, self.entity)

    def data_version(self) -> str:
        """From the last ingestion's run row; the rows are counted only where that row holds no total."""
        last = self.latest_run("ingestion_runs").select("id", "total_rows").first()
        if last is not None and last.total_rows is not None:
            return f"v{last.id}-r{last.total_rows}"
        return data_version(self.runs("ingestion_runs"), self.records()).first()[0]

    def total_rows(self) -> int:
        """Rows stored by the ingestions so far, kept in the last one's run row."""
        last = self.latest_run("ingestion_runs").select("total_rows").first()
        if last is not None and last.total_rows is not None:
            return last.total_rows
        return self.records().count()

    # --- run rows ---
    def runs(self, table: str) -> DataFrame:
        return self._scan(table, run_schema(table))

    def next_id(self, table: str) -> int:
        return (self.runs(table).agg(F.max("id")).first()[0] or 0) + 1

    def append_runs(self, table: str, rows: list[dict]) -> None:
        """Append run rows; run after the children are written, so that a run row means a finished run."""
        schema = run_schema(table)
        complete = [{f.name: row.get(f.name) for f in schema} for row in rows]
        frame = self.spark.createDataFrame(complete, schema).withColumn(
            "created_at", F.coalesce("created_at", F.current_timestamp())
        )
        frame.coalesce(1).write.mode("append").parquet(self.path(table))

    def append_run(self, table: str, row: dict) -> None:
        self.append_runs(table, [row])

    def latest_run(self, table: str) -> DataFrame:
        return latest(self.runs(table))

    # --- child rows, partitioned by their run ---
    def append_children(self, table: str, df: DataFrame, run_id: int, extra: list[str] = ()) -> None:
        sanitize(df).withColumn("run_id", F.lit(run_id).cast("long")).write.mode("append").partitionBy(
            "run_id", *extra
        ).parquet(self.path(table))

    def children(self, table: str, run_id: int) -> DataFrame:
        """Rows of one run; only that run's folder is listed and read."""
        return self.spark.read.parquet(f"{self.path(table)}/run_id={int(run_id)}")

    def save_reference(self, run_id: int, df: DataFrame) -> None:
        """The rows of one training; what an unfinished training of the same number has left is replaced."""
        sanitize(df).write.mode("overwrite").parquet(f"{self.path('training_reference_rows')}/run_id={int(run_id)}")

    def save_profile(self, run_id: int, profile: DataFrame) -> None:
        """What drift needs of a training's rows, a few numbers and sketches per feature."""
        profile.coalesce(1).write.mode("overwrite").parquet(f"{self.path('training_reference_profiles')}/run_id={int(run_id)}")

    def load_profile(self, run_id: int) -> DataFrame:
        return self.children("training_reference_profiles", run_id)

    def load_reference(self) -> tuple[DataFrame, list[str], int]:
        """Reference rows of the latest training, its features and its id."""
        run = self.latest_run("training_runs").select("id", "selected_feature_columns").first()
        if run is None:
            raise LookupError("no training run is recorded")
        return self.children("training_reference_rows", run.id), list(run.selected_feature_columns), run.id

    def load_evaluation(self, run_id: int, model_id: str | None = None) -> DataFrame:
        rows = self.children("evaluation_rows", run_id)
        return rows if model_id is None else rows.where(F.col("model_id") == model_id)

    # --- events ---
    def record_event(self, level: str, logger: str, message: str, context: dict | None = None) -> None:
        """Log an event; a failure to log never stops the work that is logged.

        Event ids are microseconds, so that writing one does not read the log.
        """
        try:
            text = {k: None if v is None else str(v) for k, v in (context or {}).items()}
            self.append_run("app_events", {
                "id": time.time_ns() // 1000, "level": level, "logger": logger, "message": message, "context": text,
            })
        except Exception:
            pass

    def recent_events(self, n: int = 200) -> DataFrame:
        events = recent_events(self.runs("app_events"), n)
        return events.select(iso_timestamp("created_at").alias("timestamp"), "level", "logger", "message")
