"""Runs end to end against a store: train, predict, evaluate, drift, and their reports."""

from pyspark.sql import DataFrame, functions as F

from panelwise import fixed
from panelwise.operators.drift import drift_from_profile, drift_report, profile
from panelwise.operators.models import Bundle, coerce_features, fit_all, with_missing_flag
from panelwise.operators.residuals import actionable
from panelwise.operators.runs import evaluation_summary, explode_candidates, flag_best, overview
from panelwise.operators.consolidate import data_status
from panelwise.plans.evaluate import CandidateEvaluation, PairEvaluation, batch_period, evaluate_candidates, evaluate_pair
from panelwise.plans.predict import predict
from panelwise.plans.settings import PanelSettings
from panelwise.plans.train import Training, fit_segments, residual_analysis, train_and_select
from panelwise.functions.text import normalized_file_name
from panelwise.sources.exports import export_csv, export_json, export_per_model
from panelwise.sources.layout_csv import LayoutFile
from panelwise.sources.model_store import current_version, load_model, load_models, resolve_model, save_models
from panelwise.sources.store import Store


def as_dicts(df: DataFrame) -> list[dict]:
    """A report of a few rows as plain records."""
    return [row.asDict(recursive=True) for row in df.collect()]


def train(store: Store, s: PanelSettings = PanelSettings()) -> Training:
    """Train on the consolidated table and record everything the later steps read.

    The training's own run row is written last: until then all readers use the training before it.
    """
    version = store.data_version()
    result = train_and_select(store.records(), s)
    run_id = store.next_id("training_runs")
    best = next(c for c in result.candidates if c["model_name"] == result.winner.model_name and c["strategy"] == result.winner.strategy)
    study = residual_analysis(result.validation, s)
    found = fit_segments(result.train, result.validation, s)

    fit_all([*result.operational, *[x.bundle for x in found.values() if x.bundle]], s.parallelism)
    save_models(store, run_id, {
        "candidates": result.operational, "frozen": result.frozen, "winner": [result.winner],
        "segments": [x.bundle for x in found.values() if x.bundle],
    })
    store.save_reference(run_id, result.reference)
    saved, columns = store.children("training_reference_rows", run_id), list(result.winner.features.columns)
    store.save_profile(run_id, profile(saved, columns, result.winner.features.categorical))

    shared = {"training_run_id": run_id, "validation_reference_year": result.validation_period, "data_version": version}
    metrics = study.metrics.first().asDict()
    store.append_run("baseline_analysis_runs", {
        **shared, "id": store.next_id("baseline_analysis_runs"), "baseline_metrics": {k: metrics[k] for k in best["metrics"]},
        "error_counts": study.errors.first().asDict(), "numeric_summary": as_dicts(study.numeric),
        "categorical_summary": as_dicts(study.categorical),
        "false_negative_importances": as_dicts(study.entry_importances),
        "recovery_importances": as_dicts(study.recovery_importances),
    })
    described = {
        name: {**(x.metrics or {}), "status": x.status, "reason": x.reason} for name, x in found.items()
    }
    store.append_run("transition_score_runs", {
        **shared, "id": store.next_id("transition_score_runs"), "entry_model_name": "random_forest",
        "recovery_model_name": "random_forest", "strategy_name": fixed.SEGMENT_STRATEGY,
        "entry_metrics": described[fixed.ENTRY_LABEL], "recovery_metrics": described[fixed.RECOVERY_LABEL],
    })
    store.append_run("training_runs", {
        "id": run_id, "selected_model": result.winner.model_name, "selected_strategy": result.winner.strategy,
        "metrics": best["metrics"], "candidates": result.candidates,
        "selected_feature_columns": list(result.winner.features.columns), "training_rows": result.training_rows,
        "validation_rows": result.validation_rows, "data_version": version,
    })
    store.record_event("INFO", "train", "training finished", {
        "training_run_id": run_id, "selected_model": result.winner.model_name, "f2": best["metrics"]["f2"],
    })
    return result


def segment_bundles(store: Store, version: int) -> dict[str, Bundle]:
    """The segment models of a training, whatever model is chosen."""
    return {b.label_name: b for b in load_models(store, "segments", version=version)}


def predict_batch(store: Store, batch: DataFrame, about: dict, model_id: str | None = None,
                  s: PanelSettings = PanelSettings()) -> tuple[int, DataFrame]:
    """Score a batch, append its rows and then its run."""
    version = current_version(store)
    bundle = resolve_model(store, model_id, version)
    scored = predict(batch, bundle, segment_bundles(store, version), s)
    run_id = store.next_id("prediction_runs")
    store.append_children("prediction_rows", scored, run_id)
    written = store.children("prediction_rows", run_id)
    store.append_run("prediction_runs", {
        "id": run_id, "source_file": about.get("source_file", "file.csv"),
        "detected_schema": about.get("detected_schema", "unknown"),
        "reference_year": about.get("reference_year") or batch_period(batch, s.period),
        "selected_model": bundle.model_name, "selected_strategy": bundle.strategy, "row_count": written.count(),
        "data_version": store.data_version(),
    })
    store.record_event("INFO", "predict", "batch scored", {"prediction_run_id": run_id, "model": bundle.model_id})
    return run_id, written


def _save_evaluation(store: Store, rows: DataFrame, run: dict, summaries=None) -> int:
    run_id = store.next_id("evaluation_runs")
    store.append_children("evaluation_rows", rows, run_id, ["model_id"])
    export = f"{store.root}/exports/evaluation_{run_id}"
    export_per_model(store.load_evaluation(run_id), export)
    if summaries is not None:
        run["summaries"] = [{**x, "output_file": f"{export}/_model={x['model_id']}"} for x in summaries]
    store.append_run("evaluation_runs", {**run, "id": run_id, "data_version": store.data_version()})
    store.record_event("INFO", "evaluate", "evaluation finished", {"evaluation_run_id": run_id})
    return run_id


def evaluate_files(store: Store, current: DataFrame, following: DataFrame, about: dict,
                   s: PanelSettings = PanelSettings()) -> tuple[int, PairEvaluation]:
    """The winner's predictions for one file against the outcomes in the next."""
    version = current_version(store)
    found = evaluate_pair(current, following, load_model(store, version=version), segment_bundles(store, version), s)
    run_id = _save_evaluation(store, found.rows.withColumn("model_id", F.lit(found.model_id)), {
        "source_file": about.get("source_file", "pair.csv"), "detected_schema": about.get("detected_schema", "uploaded_pair"),
        "current_year": found.current_period, "next_year": found.next_period, "evaluation_mode": "uploaded_pair",
        "selected_model_id": found.model_id, "metrics": found.metrics, "compared_rows": found.compared_rows,
    })
    return run_id, found


def evaluate_frozen(store: Store, batch: DataFrame, about: dict, model_id: str | None = None,
                    s: PanelSettings = PanelSettings()) -> tuple[int, CandidateEvaluation]:
    """All frozen candidates against the stored next period."""
    version = current_version(store)
    selected = model_id or load_model(store, version=version).model_id
    found = evaluate_candidates(batch, store.records(), load_models(store, "frozen", version=version), s)
    run_id = _save_evaluation(store, found.rows, {
        "source_file": about.get("source_file", "file.csv"), "detected_schema": about.get("detected_schema", "unknown"),
        "current_year": found.current_period, "next_year": found.next_period,
        "evaluation_mode": "validation_frozen_candidates", "selected_model_id": selected,
        "compared_rows": sum(x["compared_rows"] for x in found.summaries),
    }, found.summaries)
    return run_id, found


def monitor_drift(store: Store, batch: DataFrame, about: dict, s: PanelSettings = PanelSettings(), **options) -> tuple[int, DataFrame]:
    """Drift of a batch against the rows the winner was trained on; ``approx=True`` reads their kept profile only."""
    reference, features, version = store.load_reference()
    flagged = with_missing_flag(batch, s.flag_source) if s.flag_source else batch
    categorical = s.strategies[s.segment_strategy].categorical
    bundle = load_model(store, version=version)
    current = coerce_features(flagged, bundle.features)
    if options.pop("approx", False):
        report = drift_from_profile(store.load_profile(version), current, features, categorical, **options)
    else:
        report = drift_report(reference, current, features, categorical, **options)
    details = as_dicts(report.drop("position"))
    run_id = store.next_id("drift_runs")
    year = about.get("reference_year") or (batch_period(batch, s.period) if s.period in batch.columns else 0)
    store.append_run("drift_runs", {
        "id": run_id, "source_file": about.get("source_file", "file.csv"),
        "detected_schema": about.get("detected_schema", "unknown"), "reference_year": year,
        "feature_rows": len(details), "alert_count": sum(d["alert"] for d in details), "details": details,
        "data_version": store.data_version(),
    })
    store.record_event("INFO", "drift", "drift measured", {"drift_run_id": run_id})
    return run_id, store.latest_run("drift_runs")


# --- exports ---
REPORT_TABLES = ("training_runs", "baseline_analysis_runs", "transition_score_runs", "drift_runs")


def export_reports(store: Store, folder: str) -> list[str]:
    """The latest report of each kind as JSON, and the rows of the latest evaluation as CSV."""
    paths = [export_json(store.latest_run(table), f"{folder}/{table}") for table in REPORT_TABLES]
    run = store.latest_run("evaluation_runs").first()
    if run is not None:
        paths.append(export_csv(store.load_evaluation(run.id, run.selected_model_id), f"{folder}/latest_evaluation"))
    return paths


def export_normalized(file: LayoutFile, folder: str) -> str:
    """The canonical rows of a file as CSV, named after the file and its period."""
    return export_csv(file.rows, f"{folder}/{normalized_file_name(file.name, file.period)}")


# --- reports -----------------------------------------------------------------
def candidate_comparison(store: Store) -> DataFrame:
    """Candidates of the last training with id and best flag."""
    exploded = explode_candidates(store.latest_run("training_runs"), keep=["id", "selected_model", "selected_strategy"])
    flat = exploded.select("*", "metrics.*").drop("metrics")
    return flag_best(flat, ["id"]).orderBy("position")


def actionable_insights(store: Store, actions: DataFrame | None = None) -> DataFrame:
    """Signals of the last residual study that one can act on, for both scenarios, with the study's run,
    validation year and data version and the notes on how to read them."""
    run = store.latest_run("baseline_analysis_runs")
    summary = run.select(F.inline("numeric_summary"))
    parts = [
        actionable(run.select(F.inline(column)), summary, scenario, actions)
        for scenario, column in (("entry", "false_negative_importances"), ("recovery", "recovery_importances"))
    ]
    context = {"run_id": "id", "validation_year": "validation_reference_year", "data_version": "data_version"}
    return parts[0].unionByName(parts[1]).select(
        *[run.select(c).scalar().alias(name) for name, c in context.items()], "*",
        F.array(*[F.lit(note) for note in fixed.INSIGHT_NOTES]).alias("notes"),
    )


def latest_evaluation(store: Store) -> DataFrame:
    """Summary of the last evaluation for its selected model; no row without evaluations."""
    run = store.latest_run("evaluation_runs").first()
    if run is None:
        return store.spark.createDataFrame([], "id long, rows long, accuracy double, data_version string")
    summary = evaluation_summary(store.load_evaluation(run.id), run.selected_model_id)
    facts = ("id", "evaluation_mode", "current_year", "next_year", "data_version")
    return summary.select(*[F.lit(run[f]).alias(f) for f in facts], "*")


def overview_report(store: Store) -> DataFrame:
    status = data_status(store.records(), store.entity, store.period)
    return overview(
        status, store.latest_run("training_runs"), store.latest_run("drift_runs"), latest_evaluation(store),
        store.latest_run("baseline_analysis_runs"), store.latest_run("transition_score_runs"),
    )
