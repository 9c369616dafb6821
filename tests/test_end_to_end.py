import dataclasses
import math

import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

import fixtures
from panelwise import fixed
from panelwise.operators.certificates import forest_facts, importances_agree, node_table, ridge_gradient
from panelwise.operators.models import (
    WEIGHT, Features, TreeSizes, balanced_weight, baseline_bundle, bounded, candidates, class_counts, coerce_features, encode,
    encoded_importances, fit, fit_encoder, fit_on, forest, probability_of,
)
from panelwise.plans import monitor
from panelwise.plans.evaluate import batch_period, evaluate_candidates, evaluate_pair
from panelwise.plans.settings import PanelSettings
from panelwise.plans.train import ModelingError, fit_segments, labelled_frame, residual_analysis, train_and_select
from panelwise.sources.model_store import load_model, load_models, resolve_model, save_models
from panelwise.sources.store import Store

SMALL = PanelSettings(sizes=TreeSizes(forest_trees=5, forest_depth=3, boosting_rounds=2, boosting_depth=2))


@pytest.fixture(scope="module")
def trained(spark, tmp_path_factory):
    store = Store(spark, str(tmp_path_factory.mktemp("trained")))
    store.append_records(fixtures.panel(spark), 1)
    store.append_run("ingestion_runs", {"id": 1, "source_file": "panel.csv"})
    return store, monitor.train(store, SMALL)


def test_labels_of_the_panel(spark):
    rows = labelled_frame(fixtures.panel(spark), SMALL).orderBy("ano_referencia", "ra").collect()
    assert [r.target_future_risk for r in rows] == [0, 1, 0, 1, 0] * 2
    assert [r.flag_ipp_ausente for r in rows] == [1] * 5 + [0] * 5


def test_training(trained):
    store, result = trained
    assert (result.training_rows, result.validation_rows, result.validation_period) == (5, 5, 2022)
    assert len(result.candidates) == 7 and result.candidates[0]["model_name"] == fixed.BASELINE_MODEL
    assert result.candidates[0]["metrics"]["f2"] == 1.0 and result.candidates[0]["metrics"]["brier"] == 0.0
    assert result.winner.model_name != fixed.BASELINE_MODEL
    run = store.latest_run("training_runs").first()
    assert (run.training_rows, run.validation_rows, len(run.candidates), run.data_version) == (5, 5, 7, "v1-r15")
    reference, features, _ = store.load_reference()
    assert reference.count() == 10 and features == list(result.winner.features.columns)
    segments = store.latest_run("transition_score_runs").first()
    assert segments.entry_metrics.status == segments.recovery_metrics.status == "unavailable"
    study = store.latest_run("baseline_analysis_runs").first()
    assert study.error_counts == {"correct": 5, "false_negative": 0, "false_positive": 0} and study.false_negative_importances == []


def test_models_load_and_score_the_same(spark, trained):
    store, result = trained
    batch = fixtures.panel(spark).where("ano_referencia = 2023")
    from panelwise.operators.models import score_frame

    for kind, bundles in (("frozen", result.frozen), ("candidates", result.operational)):
        loaded = {b.model_id: b for b in load_models(store, kind)}
        assert set(loaded) == {b.model_id for b in bundles}
        for b in bundles:
            assert loaded[b.model_id].validation_period == b.validation_period
            ours, theirs = (sorted(score_frame(x, batch, ["ra"]).collect()) for x in (b, loaded[b.model_id]))
            assert ours == theirs
    assert load_model(store).model_id == result.winner.model_id
    assert resolve_model(store, "random_forest__strategy_a").strategy == "strategy_a"
    with pytest.raises(LookupError):
        resolve_model(store, "none__x")
    with pytest.raises(LookupError):
        load_model(Store(spark, store.root + "/nowhere"))


def test_forests_grow_in_parts(spark, monkeypatch):
    """Parts of few trees on few partitions make one model; its importances need no whole model; scoring is dealt over the cores."""
    from panelwise.operators import models

    assert [models.trees_of_part(n) for n in (500, 9_000, 55_000, 540_000, 5_000_000)] == [500, 27, 12, 1, 1]
    monkeypatch.setattr(models, "BAGGED_ROWS_OF_PART", 1)
    rows = spark.range(400).select(
        (F.col("id") % 2).cast("int").alias("y"), (F.col("id") % 3 + F.pmod(F.xxhash64("id"), F.lit(50)) / 20.0).alias("a"),
        (F.col("id") % 2 * F.rand(3)).alias("b"), F.when(F.col("id") % 5 > 0, "x").otherwise("z").alias("kind"))
    features, sizes = Features(("a", "b", "kind"), ("kind",)), TreeSizes(forest_trees=30, forest_depth=6)
    counts = class_counts(rows, "y")
    encoder = fit_encoder(rows, features)
    encoded = encode(rows, features, encoder, "y", counts).repartition(9)
    parts = list(models.forest_parts(encoded, forest(sizes, "y")))
    assert [p.getNumTrees for p in parts] == [12, 12, 6]
    model = fit_on(encoded, encoder, forest(sizes, "y"))
    whole = model.stages[-1]
    assert forest_facts(node_table(whole)).first().trees == 30
    assert importances_agree(whole, node_table(whole)).first().agree
    alone = models.forest_importances(encoded, forest(sizes, "y"))
    assert max(abs(x - y) for x, y in zip(alone, whole.featureImportances.toArray(), strict=True)) < 1e-9
    scored = probability_of(model, rows.coalesce(1), features, ["y"], "p")
    assert scored.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    shares = [p.transform(encoded).agg(F.sum(vector_to_array("probability")[1])).first()[0] * p.getNumTrees for p in parts]
    assert abs(scored.agg(F.sum("p")).first()[0] - sum(shares) / 30) < 1e-6


def test_a_training_that_stops_leaves_the_version_before_it(spark, tmp_path):
    """Models count when their training's run is written: a stop between two saves shows nothing of the new set."""
    store = Store(spark, str(tmp_path / "versions"))
    rule = lambda strategy: dataclasses.replace(baseline_bundle("level"), strategy=strategy)
    save_models(store, 1, {"winner": [rule("old")], "candidates": [rule("old"), rule("older")]})
    with pytest.raises(LookupError):
        load_model(store)
    store.append_run("training_runs", {"id": 1})
    save_models(store, 2, {"winner": [rule("new")]})  # stops here
    assert load_model(store).strategy == "old" and {b.strategy for b in load_models(store, "candidates")} == {"old", "older"}
    save_models(store, 2, {"winner": [rule("newer")], "candidates": [rule("newer")]})  # the training that follows takes its number
    store.append_run("training_runs", {"id": 2})
    assert load_model(store).strategy == "newer" and [b.strategy for b in load_models(store, "candidates")] == ["newer"]
    assert load_model(store, version=1).strategy == "old"
    with pytest.raises(ValueError, match="finished"):
        save_models(store, 1, {"winner": [rule("late")]})


def test_models_are_fitted_when_they_are_needed(spark):
    """Nothing is fitted for the rule; a chosen model is fitted once, and alone."""
    result = train_and_select(fixtures.panel(spark), SMALL)
    made = lambda: [b.model_id for b in result.frozen + result.operational if b.fitted is not None and b.fitted.made]
    assert result.measure([b for b in result.frozen if b.fitted is None])[0]["metrics"]["f2"] == 1.0 and made() == []
    chosen = result.model("logistic_regression__strategy_b")
    assert chosen.model is chosen.model and made() == ["logistic_regression__strategy_b"]
    assert result.reference_of(chosen).count() == 10 and made() == ["logistic_regression__strategy_b"]


def test_rows_of_a_fit_can_be_bounded(spark):
    rows = spark.range(20_000).select("id", (F.col("id") % 4 == 0).cast("int").alias("y"))
    some = bounded(rows, 20_000, 2_000)
    counts = {r.y: r["count"] for r in some.groupBy("y").count().collect()}
    assert 1_300 < counts[0] < 1_700 and 400 < counts[1] < 600 and sorted(some.collect()) == sorted(bounded(rows, 20_000, 2_000).collect())
    assert bounded(rows, 20_000, None) is rows and bounded(rows, 20_000, 20_000) is rows
    bound = dataclasses.replace(SMALL, sizes=dataclasses.replace(SMALL.sizes, fit_rows=8))
    assert train_and_select(fixtures.panel(spark), bound).model("random_forest__strategy_a").fitted is not None


def test_prediction(spark, trained):
    store, _ = trained
    batch = fixtures.panel(spark).where("ano_referencia = 2023")
    run_id, rows = monitor.predict_batch(store, batch, {}, s=SMALL)
    found = {r.ra: r for r in rows.collect()}
    assert len(found) == 5 and found["E-2"][fixed.GROUP_NOW] == "ja_defasado" and found["E-1"][fixed.STATE_NOW] is False
    assert all(r[fixed.RELEVANT_SCORE] is None for r in found.values())
    run = store.latest_run("prediction_runs").first()
    assert (run.id, run.row_count, run.reference_year) == (run_id, 5, 2023)
    rule = f"{fixed.BASELINE_MODEL}__{fixed.BASELINE_STRATEGY}"
    _, rows = monitor.predict_batch(store, batch, {"reference_year": 2023}, rule, SMALL)
    assert {r.ra: r[fixed.PREDICTION] for r in rows.collect()} == {"E-1": 0, "E-2": 1, "E-3": 0, "E-4": 1, "E-5": 0}


def test_batch_without_level_or_features(spark, trained):
    store, _ = trained
    bare = spark.createDataFrame([("x", 2023, "s", "f")], "ra string, ano_referencia int, source_schema string, source_file string")
    _, rows = monitor.predict_batch(store, bare, {}, s=SMALL)
    row = rows.first()
    assert row[fixed.GROUP_NOW] is None and row[fixed.PROBABILITY] is not None


def test_evaluations(spark, trained):
    store, result = trained
    rows = fixtures.panel(spark)
    run_id, pair = monitor.evaluate_files(store, rows.where("ano_referencia = 2022"), rows.where("ano_referencia = 2023"), {}, SMALL)
    assert (pair.compared_rows, pair.current_period, pair.next_period) == (5, 2022, 2023)
    assert store.load_evaluation(run_id, pair.model_id).count() == 5
    summary = monitor.latest_evaluation(store).first()
    assert (summary.rows, summary.actual_positive) == (5, 2)
    run_id, found = monitor.evaluate_frozen(store, rows.where("ano_referencia = 2022"), {}, s=SMALL)
    assert len(found.summaries) == 7 and found.summaries[0]["f2"] == max(x["f2"] for x in found.summaries)
    assert next(x for x in found.summaries if x["model_name"] == fixed.BASELINE_MODEL)["f2"] == 1.0
    stored = store.load_evaluation(run_id, f"{fixed.BASELINE_MODEL}__{fixed.BASELINE_STRATEGY}")
    # the level is the next period's: what the rule saw in 2022 was 1, -2, 0, -1, 3
    assert {r.ra: r.defasagem for r in stored.collect()} == {"E-1": 0, "E-2": -1, "E-3": 1, "E-4": -2, "E-5": 0}
    run = store.latest_run("evaluation_runs").first()
    assert run.compared_rows == 35 and len(run.summaries) == 7
    path = run.summaries[0].output_file
    assert spark.read.csv(path, header=True).count() == 5
    with pytest.raises(ModelingError, match="no frozen candidate"):
        evaluate_candidates(rows.where("ano_referencia = 2021"), rows, result.frozen, SMALL)
    with pytest.raises(ModelingError, match="no period 2023"):
        evaluate_candidates(rows.where("ano_referencia = 2022"), rows.where("ano_referencia < 2023"), result.frozen, SMALL)
    stranger = rows.where("ano_referencia = 2023").withColumn("ra", F.lit("other"))
    with pytest.raises(ModelingError):
        evaluate_pair(rows.where("ano_referencia = 2022"), stranger, result.winner, {}, SMALL)


def test_drift_run_and_reports(spark, trained):
    store, result = trained
    batch = fixtures.panel(spark).where("ano_referencia = 2023")
    _, run = monitor.monitor_drift(store, batch, {}, SMALL)
    row = run.first()
    assert row.feature_rows == len(result.winner.features.columns) and row.alert_count == sum(d.alert for d in row.details)
    assert [d.feature for d in row.details] == list(result.winner.features.columns)
    compared = monitor.candidate_comparison(store).collect()
    assert [c.is_best_overall for c in compared].count(True) == 1 and compared[0].model_name == fixed.BASELINE_MODEL
    report = monitor.overview_report(store).first()
    assert (report.rows, report.entities, report.periods, report.candidate_count) == (15, 5, [2021, 2022, 2023], 7)
    assert report.drift_alert_count == row.alert_count and report.selected_model == result.winner.model_name
    assert monitor.actionable_insights(store).count() == 0


def test_report_exports(spark, trained, tmp_path):
    store, result = trained
    paths = monitor.export_reports(store, str(tmp_path))
    found = spark.read.json(paths[0]).first()
    assert found.selected_model == result.winner.model_name and len(found.candidates) == 7
    assert spark.read.json(paths[1]).first().error_counts.correct == 5


def test_empty_store_reports(spark, tmp_path):
    report = monitor.overview_report(Store(spark, str(tmp_path / "none"))).first()
    assert (report.rows, report.candidate_count, report.drift_alert_count, report.selected_model) == (0, 0, 0, None)


def test_one_labelled_period_is_not_enough(spark):
    with pytest.raises(ModelingError, match="two labelled periods"):
        train_and_select(fixtures.panel(spark).where("ano_referencia > 2021"), SMALL)
    with pytest.raises(ModelingError, match="consecutive"):
        train_and_select(fixtures.panel(spark).where("ano_referencia = 2021"), SMALL)


def larger_panel(spark):
    """400 entities over 3 years; the level depends on x and on the kind, so both segments have both classes."""
    base = spark.range(1200).select(
        (F.col("id") % 400).cast("string").alias("e"), (2020 + F.floor(F.col("id") / 400)).cast("int").alias("p"),
        F.pmod(F.xxhash64("id"), F.lit(1000)).alias("noise"), F.pmod(F.xxhash64(F.col("id") % 400), F.lit(100)).alias("x"),
    )
    return base.select(
        "e", "p", F.col("x").cast("double").alias("x"), F.when(F.col("x") % 3 == 0, "k_a").otherwise("k").alias("kind"),
        (F.col("x") / 100 + F.col("noise") / 1000 - 1).alias("level"),
    )


def test_segments_importances_and_predictions_on_a_larger_panel(spark):
    features = Features(("x", "kind", "level"), ("kind",))
    s = PanelSettings(
        entity="e", period="p", level="level", target="y", flag_source=None, strategies={"strategy_b": features},
        provenance=(), numeric_summary=("x",), categorical_summary=("kind",), models=("random_forest",),
        sizes=TreeSizes(forest_trees=10, forest_depth=4),
    )
    rows = larger_panel(spark)
    result = train_and_select(rows, s)
    assert result.winner.model_name == "random_forest" and result.candidates[1]["metrics"]["roc_auc"] > 0.7
    found = fit_segments(result.train, result.validation, s)
    assert {x.status for x in found.values()} == {"available"}
    study = residual_analysis(result.validation, s)
    importances = {r.feature: r.importance for r in study.entry_importances.collect()}
    assert set(importances) == {"x", "kind", "level"} and math.isclose(sum(importances.values()), 1.0, abs_tol=1e-9)
    from panelwise.plans.predict import predict

    bundles = {n: x.bundle for n, x in found.items()}
    batch = rows.where("p = 2022").withColumn("level", F.when(F.col("x") > 2, F.col("level")))
    scored = predict(batch, result.winner, bundles, s)
    assert scored.count() == batch.count()
    bad = scored.where(
        (F.col(fixed.GROUP_NOW) == "ja_defasado") & (F.col(fixed.ENTRY_SCORE).isNotNull() | F.col(fixed.RECOVERY_SCORE).isNull())
        | (F.col(fixed.GROUP_NOW) == "nao_defasado") & (F.col(fixed.RECOVERY_SCORE).isNotNull() | F.col(fixed.ENTRY_SCORE).isNull())
        | F.col(fixed.GROUP_NOW).isNull() & F.col(fixed.RELEVANT_SCORE).isNotNull()
    )
    assert bad.count() == 0
    persisted = scored.where(F.abs(F.col(fixed.RECOVERY_SCORE) + F.col(fixed.PERSISTENCE_SCORE) - 1) > 1e-9)
    assert persisted.count() == 0


def test_unseen_category_and_coercion(spark):
    features = Features(("x", "kind"), ("kind",))
    rows = larger_panel(spark).withColumn("y", (F.col("level") < 0).cast("int"))
    model = fit(rows, features, forest(TreeSizes(forest_trees=3, forest_depth=3), "y"), "y", {0: 1, 1: 1})
    strange = spark.createDataFrame([(None, "never seen"), (1.0, None)], "x double, kind string")
    assert probability_of(model, strange, features, ["kind"], "p").count() == 2
    named = {r.name for r in encoded_importances(model, features, rows).collect()}
    assert named == {"kind_k", "kind_k_a", "x"}
    assert [tuple(r) for r in coerce_features(strange, Features(("x", "kind", "z"), ("kind",))).collect()] == [
        (None, "never seen", None), (1.0, "<NA>", None)]


def test_batch_period_is_the_smallest_most_frequent(spark):
    frame = spark.createDataFrame([("2021",), ("2020",), ("x",), ("2020",), ("2021",)], "p string")
    assert batch_period(frame, "p") == 2020
    with pytest.raises(ModelingError):
        batch_period(frame.limit(0), "p")


def test_certificates(spark):
    """They hold for fitted models and fail for spoilt ones."""
    features = Features(("x", "kind"), ("kind",))
    rows = larger_panel(spark).withColumn("y", (F.col("level") < -0.2).cast("int"))
    counts = class_counts(rows, "y")
    encoder = fit_encoder(rows, features)
    encoded = encode(rows, features, encoder, "y", counts)
    n = sum(counts.values())
    regression = fit_on(encoded, encoder, candidates(TreeSizes(), "y", n)["logistic_regression"]).stages[-1]
    steepest = lambda strength, weight: ridge_gradient(regression, encoded.withColumn(WEIGHT, weight), "y", WEIGHT, strength).agg(F.max(F.abs("gradient"))).first()[0]
    assert steepest(1 / n, balanced_weight("y", counts)) < 1e-3 < steepest(1 / n, F.lit(1.0))
    model = fit_on(encoded, encoder, forest(TreeSizes(forest_trees=7, forest_depth=6), "y")).stages[-1]
    nodes = node_table(model)
    assert tuple(forest_facts(nodes).first())[0] == 7 and forest_facts(nodes).first()[1] >= 2
    assert importances_agree(model, nodes).first().agree and importances_agree(model, nodes).first().whole
    assert not importances_agree(model, nodes.withColumn("gain", F.col("gain") * F.col("tree") + F.col("feature"))).first().agree


def test_forests_score_by_their_stored_nodes(spark, tmp_path):
    """The bulk scoring gives Spark ML's probabilities, also of odd values, and after loading; tasks get arrays, no forest objects."""
    import random

    from pyspark.ml import PipelineModel
    from panelwise.operators import forests, models

    rng = random.Random(5)
    made = [(rng.choice([None, float("nan"), rng.random()]), rng.random() * 3, rng.choice(["a", "b", "c", None]), rng.randrange(2)) for _ in range(400)]
    rows = spark.createDataFrame(made, "a double, b double, kind string, y int")
    features = Features(("a", "b", "kind"), ("kind",))
    model = fit(rows, features, forest(TreeSizes(forest_trees=30, forest_depth=12), "y"), "y", models.class_counts(rows, "y"))
    odd = rows.union(spark.createDataFrame([(float("inf"), float("-inf"), "new", 1), (None, None, None, 0)], rows.schema))
    model.write().save(str(tmp_path / "model"))
    loaded = forests.remember_loaded(PipelineModel.load(str(tmp_path / "model")), str(tmp_path / "model"))
    ids = odd.coalesce(1).withColumn("i", F.monotonically_increasing_id())
    own = model.transform(models.prepared(ids, features, ["i"])).select("i", vector_to_array("probability")[1].alias("own"))
    for m in (model, loaded):
        scored = probability_of(m, ids, features, ["i"], "p")
        assert "ArrowEvalPython" in scored._jdf.queryExecution().toString()
        both = scored.join(own, "i").collect()
        assert len(both) == 402 and all(abs(r.p - r.own) < 1e-12 for r in both)
    assert probability_of(model, ids.limit(0), features, ["i"], "p").count() == 0
