"""Models on the customer panel, with the operators' default sizes.

A fitted forest is not something SQL can restate. SQL checks what does not depend on the fit (keys, rows,
decisions, states, what belongs to the rule), and certificates what defines a fit: the gradient at a
solution, importances recomputed from stored nodes, limits kept, losses below those of the prior.
"""

from concurrent.futures import ThreadPoolExecutor
from functools import lru_cache

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, functions as F

from panelwise import fixed
from panelwise.catalog.base import FULL_PANEL, LABELLED_FULL, RULED, full_panel, labelled_full, query, rounded, table
from panelwise.catalog.drifts import BINNED, CATEGORICAL, EDGES, NUMERIC, PSI
from panelwise.catalog.stores import canonical_orders, new_store
from panelwise.frames import materialize
from panelwise.operators import certificates, models, ranking, residuals, vocabulary
from panelwise.operators.drift import drift_report, drift_summary
from panelwise.operators.models import Features
from panelwise.operators.normalize import union_all
from panelwise.plans import evaluate, monitor, predict, train
from panelwise.plans.ingest import ingest
from panelwise.plans.settings import PanelSettings
from panelwise.sources.model_store import resolve_model, save_models

TEXTS = ("segment", "nation", "priority")
FEATURES_A = Features(("segment", "priority", "n_orders", "avg_price"), TEXTS)
FEATURES_B = Features(FEATURES_A.columns + ("nation", "min_price", "max_price", "flag_min_missing"), TEXTS)
SETTINGS = PanelSettings(
    entity="entity", period="period", level="level", target="target", flag_source=None,
    strategies={"strategy_a": FEATURES_A, "strategy_b": FEATURES_B}, provenance=(),
    numeric_summary=("n_orders", "avg_price", "min_price", "max_price"), categorical_summary=TEXTS,
)
METRICS = ("f2", "recall", "precision", "pr_auc", "roc_auc", "brier")


def panel(spark, folder):
    return full_panel(spark, folder).withColumn("flag_min_missing", (F.col("n_orders") < 2).cast("int"))


def last_pair(spark, folder):
    """The panel's rows of the last labelled period and of the one after it, and all of them."""
    rows = panel(spark, folder)
    last = labelled_full(spark, folder).agg(F.max("period")).first()[0]
    return rows.where(F.col("period") == last), rows.where(F.col("period") == last + 1), rows


@lru_cache(maxsize=4)
def _trained(app: str, folder: str):
    from pyspark.sql import SparkSession

    return train.train_and_select(panel(SparkSession.active(), folder), SETTINGS)


@lru_cache(maxsize=4)
def _segments(app: str, folder: str):
    result = _trained(app, folder)
    return train.fit_segments(result.train, result.validation, SETTINGS)


def trained(spark, folder):
    """One training per session and folder, shared by the queries that apply its models."""
    return _trained(spark.sparkContext.applicationId, folder)


def forget() -> None:
    """Drop the trainings kept for the session."""
    _trained.cache_clear()
    _segments.cache_clear()


def segment_models(spark, folder):
    found = _segments(spark.sparkContext.applicationId, folder)
    return {name: s.bundle for name, s in found.items() if s.bundle is not None}


def metric_rows(spark, rows):
    return rounded(spark.createDataFrame(
        [(r["model_name"], r["strategy"], *[r["metrics"][m] for m in METRICS]) for r in rows],
        "model_name string, strategy string, " + ", ".join(f"{m} double" for m in METRICS),
    ), *METRICS)


@query("m1_feature_frame", f"""
WITH {LABELLED_FULL} SELECT entity, period, segment, priority, n_orders, round(avg_price, 6) AS avg_price FROM labelled
""")
def m1(spark, folder):
    rows = models.coerce_features(labelled_full(spark, folder), FEATURES_A, ["entity", "period"])
    return rounded(rows, "avg_price")


@query("m4_one_hot_unseen", """
SELECT c_custkey, CAST(CASE WHEN c_mktsegment = 'BUILDING' THEN 0 ELSE 1 END AS DOUBLE) AS ones,
  CAST((SELECT count(DISTINCT c_mktsegment) FROM customer WHERE c_mktsegment <> 'BUILDING') AS INTEGER) AS width FROM customer
""")
def m4(spark, folder):
    """Levels are learned without one segment, which is then unseen: all its columns are zero."""
    from pyspark.ml import Pipeline

    features = Features(("segment",), ("segment",))
    rows = table(spark, folder, "customer").select("c_custkey", F.col("c_mktsegment").alias("segment"))
    stages = Pipeline(stages=models.feature_stages(features)).fit(models.prepared(rows.where("segment <> 'BUILDING'"), features))
    encoded = stages.transform(models.prepared(rows, features, ["c_custkey"])).select("c_custkey", vector_to_array("features").alias("v"))
    return encoded.select("c_custkey", F.aggregate("v", F.lit(0.0), lambda a, b: a + b).alias("ones"), F.size("v").alias("width"))


@query("m4_vocabulary", f"""
WITH {FULL_PANEL}, levels AS (
  SELECT 0 AS place, segment AS level FROM full_panel UNION SELECT 1, priority FROM full_panel UNION SELECT 2, CASE WHEN nation LIKE 'A%' THEN '<NA>' ELSE nation END FROM full_panel),
numbered AS (SELECT *, row_number() OVER (ORDER BY place, level) - 1 AS i FROM levels)
SELECT entity, period, (SELECT count(*) FROM levels) + 5 AS width, CAST(s.i AS VARCHAR) || ',' || CAST(p.i AS VARCHAR) || coalesce(',' || CAST(n.i AS VARCHAR), '') AS ones, n_orders
FROM full_panel f JOIN numbered s ON s.place = 0 AND s.level = f.segment JOIN numbered p ON p.place = 1 AND p.level = f.priority
LEFT JOIN numbered n ON n.place = 2 AND n.level = f.nation
""")
def m4_vocabulary(spark, folder):
    """Indices from a table of levels; nations with an A are missing where it is learnt, and give no entry."""
    rows, keys = panel(spark, folder), ["entity", "period"]
    learnt = rows.withColumn("nation", F.when(~F.col("nation").startswith("A"), F.col("nation")))
    levels = materialize(vocabulary.vocabulary(learnt, FEATURES_B))
    encoded = vocabulary.encode_sparse(rows, FEATURES_B, levels, keys)
    cells = vector_to_array("features")
    width = F.size(cells) - 5
    ones = F.array_compact(F.transform(F.slice(cells, 1, width), lambda x, i: F.when(x == 1, i)))
    return encoded.select(*keys, F.size(cells).cast("long").alias("width"), F.array_join(ones, ",").alias("ones"), F.element_at(cells, width + 1).alias("n_orders"))


RULE = f"{fixed.BASELINE_MODEL}__{fixed.BASELINE_STRATEGY}"
LAST = LABELLED_FULL + ", last AS (SELECT * FROM labelled WHERE period = (SELECT max(period) FROM labelled))"
TRAIN = "train AS (SELECT * FROM labelled WHERE period = (SELECT min(period) FROM labelled))"


def frozen(spark, folder, name):
    """A candidate of strategy B, fitted on the first labelled period."""
    return next(b for b in trained(spark, folder).frozen if b.model_id == f"{name}__strategy_b")


def encoded_training(spark, folder, bundle):
    """The rows a frozen candidate was fitted on, as it saw them, and their number."""
    rows = trained(spark, folder).train
    counts = models.class_counts(rows, "target")
    encoder = models.PipelineModel(bundle.model.stages[:-1])
    return models.encode(rows, bundle.features, encoder, "target", counts), sum(counts.values())


def held_out(spark, folder, bundle):
    """rows, probabilities: the last period's rows, and how many of them got a probability."""
    scored = models.probability_of(bundle.model, trained(spark, folder).validation, bundle.features, ["entity"], "p")
    return scored.agg(F.count("*").alias("rows"), F.count_if(F.col("p").between(0, 1)).alias("probabilities"))


def losses(spark, folder, bundle, weight=None):
    """Whether the model loses less on its training rows than the prior."""
    scored = models.probability_of(bundle.model, trained(spark, folder).train, bundle.features, ["target"], "p")
    counts = models.class_counts(scored, "target")
    w = models.balanced_weight("target", counts) if weight else None
    return scored.agg((certificates.log_loss("target", "p", w) < certificates.prior_loss("target", w)).alias("better_than_prior"))


@query("m5_fit_and_transform", f"""
WITH {LAST}, {TRAIN},
levels AS (SELECT count(DISTINCT segment) + count(DISTINCT nation) + count(DISTINCT priority) AS n FROM train)
SELECT target, count(*) AS rows, count(*) AS probabilities, (SELECT n FROM levels) + 5 AS encoded_columns FROM last GROUP BY target
""")
def m5(spark, folder):
    bundle = frozen(spark, folder, "logistic_regression")
    scored = models.probability_of(bundle.model, trained(spark, folder).validation, bundle.features, ["target"], "probability")
    return scored.groupBy("target").agg(
        F.count("*").alias("rows"), F.count_if(F.col("probability").between(0, 1)).alias("probabilities")
    ).withColumn("encoded_columns", F.lit(bundle.model.stages[-1].numFeatures).cast("long"))


@query("m6_logistic_regression", f"""
WITH {LAST}, {TRAIN}
SELECT (SELECT count(DISTINCT segment) + count(DISTINCT nation) + count(DISTINCT priority) + 6 FROM train) AS parameters, true AS stationary,
  true AS better_than_prior, (SELECT count(*) FROM last) AS rows, (SELECT count(*) FROM last) AS probabilities
""")
def m6(spark, folder):
    """At the solution the slope of the weighted, penalised loss is zero for every parameter."""
    bundle = frozen(spark, folder, "logistic_regression")
    encoded, n = encoded_training(spark, folder, bundle)
    gradient = certificates.ridge_gradient(bundle.model.stages[-1], encoded, "target", models.WEIGHT, 1.0 / n)
    slopes = gradient.agg(F.count("*").alias("parameters"), (F.max(F.abs("gradient")) < 1e-3).alias("stationary"))
    return slopes.join(losses(spark, folder, bundle, weight=True)).join(held_out(spark, folder, bundle))


TREES = f"""
WITH {LAST} SELECT true AS all_trees, true AS leaves_of_two, true AS agree, true AS whole, true AS better_than_prior,
  (SELECT count(*) FROM last) AS rows, (SELECT count(*) FROM last) AS probabilities
"""


@query("m7_random_forest", TREES)
def m7(spark, folder):
    """Number of trees and least rows of a leaf as asked for, importances as they follow from the stored nodes."""
    bundle = frozen(spark, folder, "random_forest")
    nodes = certificates.node_table(bundle.model.stages[-1])
    facts = certificates.forest_facts(nodes).select(
        (F.col("trees") == SETTINGS.sizes.forest_trees).alias("all_trees"), (F.col("least_rows") >= 2).alias("leaves_of_two"))
    agree = certificates.importances_agree(bundle.model.stages[-1], nodes).drop("features")
    return facts.join(agree).join(losses(spark, folder, bundle, weight=True)).join(held_out(spark, folder, bundle))


@query("m8_gradient_boosting", f"""
WITH {LAST} SELECT true AS all_rounds, true AS steps_equal, true AS better_than_prior,
  (SELECT count(*) FROM last) AS rows, (SELECT count(*) FROM last) AS probabilities
""")
def m8(spark, folder):
    bundle = frozen(spark, folder, "hist_gradient_boosting")
    weights = bundle.model.stages[-1].treeWeights
    facts = spark.createDataFrame(
        [(len(weights) == SETTINGS.sizes.boosting_rounds, weights[0] == 1.0 and set(weights[1:]) == {0.1})], "all_rounds boolean, steps_equal boolean"
    )
    return facts.join(losses(spark, folder, bundle)).join(held_out(spark, folder, bundle))


@query("m9_train_and_select", f"""
WITH {LAST}, n AS (SELECT count(*) FILTER (level < 0 AND target = 1) AS tp, count(*) FILTER (level < 0 AND target = 0) AS fp, count(*) FILTER (level >= 0 AND target = 1) AS fn, count(*) AS rows FROM last),
c(model_name, strategy) AS (SELECT * FROM (VALUES ('logistic_regression'), ('random_forest'), ('hist_gradient_boosting')) m, (VALUES ('strategy_a'), ('strategy_b')) s)
SELECT model_name, strategy, true AS measured, NULL AS rule_f2, CAST(1 AS BIGINT) AS winners FROM c
UNION ALL SELECT '{fixed.BASELINE_MODEL}', '{fixed.BASELINE_STRATEGY}', true, round(5.0 * tp / (5 * tp + 4 * fn + fp), 6), 1 FROM n
""")
def m9(spark, folder):
    """All candidates with their metrics, one winner among them that has the best F2 without the rule."""
    rows = metric_rows(spark, trained(spark, folder).candidates)
    best = train.select_winner(trained(spark, folder).candidates)
    is_rule = F.col("model_name") == fixed.BASELINE_MODEL
    won = rows.where(~is_rule).agg(F.max("f2").alias("most")).scalar()
    chosen = (F.col("model_name") == best["model_name"]) & (F.col("strategy") == best["strategy"]) & (F.col("f2") == won)
    measured = [F.col(m).between(0, 1) for m in METRICS]
    return rows.select(
        "model_name", "strategy", F.array_min(F.array(*measured)).alias("measured"), F.when(is_rule, F.col("f2")).alias("rule_f2"),
        rows.agg(F.count_if(chosen)).scalar().alias("winners"),
    )


@query("m9_baseline_candidate", f"""
WITH {LAST}, n AS (SELECT count(*) FILTER (level < 0 AND target = 1) AS tp, count(*) FILTER (level < 0 AND target = 0) AS fp, count(*) FILTER (level >= 0 AND target = 1) AS fn, count(*) AS rows FROM last)
SELECT 'baseline_persistencia' AS model_name, round(5.0 * tp / (5 * tp + 4 * fn + fp), 6) AS f2, round(tp / CAST(tp + fn AS DOUBLE), 6) AS recall,
  round(tp / CAST(tp + fp AS DOUBLE), 6) AS precision, round((fp + fn) / CAST(rows AS DOUBLE), 6) AS brier FROM n
""")
def m9_baseline(spark, folder):
    """The rule among the candidates: measured like them, and nothing is fitted for it."""
    result = trained(spark, folder)
    rule = [b for b in result.frozen if b.model_id == RULE]
    return metric_rows(spark, result.measure(rule)).select("model_name", "f2", "recall", "precision", "brier")


SEGMENTS = f"""
WITH {LABELLED_FULL}, ends AS (SELECT min(period) AS first, max(period) AS last FROM labelled),
sides AS (SELECT CASE WHEN level >= 0 THEN '{fixed.ENTRY_LABEL}' WHEN level < 0 THEN '{fixed.RECOVERY_LABEL}' END AS segment,
  period = last AS held, target FROM labelled, ends WHERE period IN (first, last))
"""


@query("m10_segment_models", SEGMENTS + """
SELECT segment, CASE WHEN count(DISTINCT target) FILTER (held) > 1 AND count(DISTINCT target) FILTER (NOT held) > 1 THEN 'available' ELSE 'unavailable' END AS status,
  count(DISTINCT target) FILTER (held) > 1 AND count(DISTINCT target) FILTER (NOT held) > 1 AS measured FROM sides WHERE segment IS NOT NULL GROUP BY segment
""")
def m10(spark, folder):
    found = _segments(spark.sparkContext.applicationId, folder)
    with ThreadPoolExecutor(SETTINGS.parallelism) as pool:
        measured = dict(zip(found, pool.map(lambda s: s.metrics, found.values()), strict=True))
    rows = [(name, s.status, measured[name] is not None and all(0 <= measured[name][m] <= 1 for m in METRICS)) for name, s in found.items()]
    return spark.createDataFrame(rows, "segment string, status string, measured boolean")


def study(spark, folder, predicted, label, outcome):
    """The forest of one side of the rule's mistakes on the last period, and the names of its encoded columns."""
    rows = residuals.with_residuals(trained(spark, folder).validation, "level", "target")
    side = rows.where(F.col("baseline_pred") == predicted).withColumn(label, outcome)
    model = train.importance_model(side, label, SETTINGS)
    return model, models.encoded_names(model, FEATURES_B, side)


def stated(spark, model, names, n=None):
    """The study's importances by feature."""
    encoded = spark.createDataFrame(list(zip(names, model.stages[-1].featureImportances.toArray().tolist(), strict=True)), "name string, importance double")
    return residuals.grouped_importances(encoded, list(FEATURES_B.columns), n)


def recomputed(spark, model, names):
    """Importances by feature from the stored nodes of the study's forest, without the library's own."""
    own = certificates.node_importances(certificates.node_table(model.stages[-1]))
    named = own.join(spark.createDataFrame(list(enumerate(names)), "feature int, name string"), "feature").select("name", "importance")
    return residuals.grouped_importances(named, list(FEATURES_B.columns), None)


FEATURE_ROWS = ", ".join(f"('{c}')" for c in FEATURES_B.columns)


@query("m11_importance_study", f"SELECT feature, true AS agrees, true AS whole FROM (VALUES {FEATURE_ROWS}) f(feature)")
def m11(spark, folder):
    """What the study says about each feature is what the forest's nodes say, and makes 1 in all."""
    model, names = study(spark, folder, 0, "entered", F.col("target"))
    found = stated(spark, model, names)
    other = recomputed(spark, model, names).withColumnRenamed("importance", "other")
    whole = (F.abs(found.agg(F.sum("importance")).scalar() - 1) < 1e-9).alias("whole")
    return found.join(other, "feature", "left").select(
        "feature", (F.abs(F.col("importance") - F.coalesce("other", F.lit(0.0))) < 1e-9).alias("agrees"), whole)


@query("o6_top_importances", "SELECT CAST(r AS INTEGER) AS rank, true AS agrees FROM range(1, 4) t(r)")
def o6(spark, folder):
    """The three first features in order, against an order made from the forest's nodes."""
    model, names = study(spark, folder, 1, "recovered", 1 - F.col("target"))
    ranked = lambda rows, name: ranking.top_n_per_group(rows.withColumn("all", F.lit(1)), ["all"], [F.col("importance").desc(), F.col("feature")], 3).select("rank", F.col("feature").alias(name))
    top = ranked(stated(spark, model, names, 3), "mine")
    return top.join(ranked(recomputed(spark, model, names), "other"), "rank").select("rank", (F.col("mine") == F.col("other")).alias("agrees"))


@query("m12_residual_analysis", f"""
WITH {RULED}, last AS (SELECT * FROM ruled WHERE period = (SELECT max(period) FROM ruled)),
n AS (SELECT count(*) FILTER (error_type = 'correct') AS correct, count(*) FILTER (error_type = 'false_negative') AS fn, count(*) FILTER (error_type = 'false_positive') AS fp,
  count(*) FILTER (baseline_pred = 1 AND target = 1) AS tp, count(*) AS rows FROM last),
means AS (SELECT feature, avg(value) FILTER (error_type = 'correct') AS c, avg(value) FILTER (error_type = 'false_negative') AS f, avg(value) FILTER (error_type = 'false_positive') AS p
  FROM (SELECT error_type, n_orders, avg_price, min_price, max_price FROM last) UNPIVOT (value FOR feature IN (n_orders, avg_price, min_price, max_price)) GROUP BY feature),
cats AS (SELECT error_type, feature, category, count(*) AS n FROM (SELECT error_type, segment, nation, priority FROM last) UNPIVOT (category FOR feature IN (segment, nation, priority)) WHERE error_type <> 'correct' GROUP BY 1, 2, 3),
ranked AS (SELECT *, row_number() OVER (PARTITION BY error_type, feature ORDER BY n DESC, category) AS rank, n / CAST(sum(n) OVER (PARTITION BY error_type, feature) AS DOUBLE) AS share FROM cats)
SELECT 'metrics' AS part, 'f2' AS name, round(5.0 * tp / (5 * tp + 4 * fn + fp), 4) AS value FROM n
UNION ALL SELECT 'metrics', 'recall', round(tp / CAST(tp + fn AS DOUBLE), 4) FROM n
UNION ALL SELECT 'metrics', 'precision', round(tp / CAST(tp + fp AS DOUBLE), 4) FROM n
UNION ALL SELECT 'metrics', 'brier', round((fn + fp) / CAST(rows AS DOUBLE), 4) FROM n
UNION ALL SELECT 'errors', 'correct', correct FROM n UNION ALL SELECT 'errors', 'false_negative', fn FROM n UNION ALL SELECT 'errors', 'false_positive', fp FROM n
UNION ALL SELECT 'means', feature || ' correct', round(c, 4) FROM means UNION ALL SELECT 'means', feature || ' false_negative', round(f, 4) FROM means
UNION ALL SELECT 'means', feature || ' false_positive', round(p, 4) FROM means
UNION ALL SELECT 'differences', feature || ' false_negative', round(f - c, 4) FROM means UNION ALL SELECT 'differences', feature || ' false_positive', round(p - c, 4) FROM means
UNION ALL SELECT 'shares', error_type || ' ' || feature || ' ' || rank || ' ' || category, round(share, 4) FROM ranked WHERE rank <= 5
UNION ALL SELECT 'importances', 'entry', 1.0 UNION ALL SELECT 'importances', 'recovery', 1.0
""")
def m12(spark, folder):
    """The whole study of the rule; of the importances that they make 1 in all."""
    found = train.residual_analysis(trained(spark, folder).validation, SETTINGS)
    part = lambda rows, name, key, value: rows.select(
        F.lit(name).alias("part"), (key if isinstance(key, Column) else F.lit(key)).alias("name"), F.round(value, 4).alias("value"))
    wide = lambda rows, name, columns: rows.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot([], columns, "name", "value").select(
        F.lit(name).alias("part"), "name", F.round("value", 4).alias("value"))
    numeric = []
    for name, suffix, kinds in (("means", "_mean", ("correct", "false_negative", "false_positive")), ("differences", "_minus_correct", ("false_negative", "false_positive"))):
        numeric += [part(found.numeric, name, F.concat("feature", F.lit(f" {kind}")), F.col(f"{kind}{suffix}")) for kind in kinds]
    shares = part(found.categorical, "shares", F.concat_ws(" ", "error_type", "feature", F.col("rank").cast("string"), "category"), F.col("share"))
    whole = lambda rows, name: rows.agg(F.round(F.sum("importance"), 4).alias("value")).select(F.lit("importances").alias("part"), F.lit(name).alias("name"), "value")
    return union_all([
        wide(found.metrics, "metrics", ["f2", "recall", "precision", "brier"]),
        wide(found.errors, "errors", ["correct", "false_negative", "false_positive"]), *numeric, shares,
        whole(found.entry_importances, "entry"), whole(found.recovery_importances, "recovery"),
    ])


def batch(spark, folder):
    return panel(spark, folder)


BATCH = f"WITH {FULL_PANEL} SELECT entity, period, true AS chosen, 0.5 AS threshold, true AS decided, true AS is_probability FROM full_panel"


@query("m13_score_batch", BATCH)
def m13(spark, folder):
    """Every row of the batch once, scored by the best of all candidates, refitted on all labelled rows; a decision that
    follows from a probability computed a second time."""
    bundle, keys = trained(spark, folder).winner, ["entity", "period"]
    best = train.select_winner(trained(spark, folder).candidates)
    chosen = (F.col(fixed.MODEL_USED) == best["model_name"]) & (F.col(fixed.STRATEGY_USED) == best["strategy"])
    again = models.probability_of(bundle.model, batch(spark, folder), bundle.features, keys, "again")
    scored = models.score_frame(bundle, batch(spark, folder), keys, "level").join(again, keys)
    return scored.select(
        *keys, chosen.alias("chosen"), F.col("threshold").cast("decimal(2,1)").alias("threshold"),
        (F.col(fixed.PREDICTION) == F.when(F.col("again") >= 0.5, 1).otherwise(0)).alias("decided"), F.col(fixed.PROBABILITY).between(0, 1).alias("is_probability"),
    )


@query("m14_resolve_model", f"""
WITH {FULL_PANEL} SELECT entity, period, CASE WHEN level < 0 THEN 1 ELSE 0 END AS decision FROM full_panel
""")
def m14(spark, folder):
    """The rule as it comes back from the model store by its id, applied to the panel. Nothing is fitted."""
    store = new_store(spark)
    save_models(store, 1, {"candidates": [models.baseline_bundle("level")]})
    store.append_run("training_runs", {"id": 1})
    scored = models.score_frame(resolve_model(store, RULE), batch(spark, folder), ["entity", "period"], "level")
    return scored.select("entity", "period", F.col(fixed.PREDICTION).alias("decision"))


@query("s6_load_model", f"""
WITH {FULL_PANEL} SELECT entity, period, kind, true AS same FROM full_panel, (VALUES ('random_forest__strategy_b'), ('logistic_regression__strategy_b')) k(kind)
""")
def s6(spark, folder):
    """Fitted models score after loading as they did before they were saved; a later, unfinished version is not seen."""
    store, bundles = new_store(spark), [frozen(spark, folder, name) for name in ("random_forest", "logistic_regression")]
    models.fit_all(bundles, SETTINGS.parallelism)
    save_models(store, 1, {"candidates": bundles})
    store.append_run("training_runs", {"id": 1})
    save_models(store, 2, {"candidates": [models.baseline_bundle("level")]})  # never finished
    keys, rows = ["entity", "period"], batch(spark, folder)

    def compared(bundle):
        score = lambda b, name: models.score_frame(b, rows, keys, "level").select(*keys, F.col(fixed.PROBABILITY).alias(name))
        both = score(resolve_model(store, bundle.model_id), "after").join(score(bundle, "before"), keys)
        return both.select(*keys, F.lit(bundle.model_id).alias("kind"), (F.col("after") == F.col("before")).alias("same"))

    return union_all([compared(b) for b in bundles])


@query("m15_predict", f"""
WITH {FULL_PANEL} SELECT entity, period, level < 0 AS state, CASE WHEN level < 0 THEN '{fixed.GROUP_LOW}' WHEN level >= 0 THEN '{fixed.GROUP_OK}' END AS in_group,
  level >= 0 AS has_entry, level < 0 AS has_recovery, level < 0 AS has_persistence, true AS adds_up, true AS relevant, 'logistic_regression' AS model FROM full_panel
""")
def m15(spark, folder):
    """Keys, state, group, which segment's score is there, and that recovery and persistence make 1."""
    segments = segment_models(spark, folder)
    bundle = trained(spark, folder).model("logistic_regression__strategy_b")
    models.fit_all([bundle, *segments.values()], SETTINGS.parallelism)
    rows = predict.predict(batch(spark, folder), bundle, segments, SETTINGS)
    entry, recovery, persistence = (F.col(c) for c in (fixed.ENTRY_SCORE, fixed.RECOVERY_SCORE, fixed.PERSISTENCE_SCORE))
    return rows.select(
        "entity", "period", F.col(fixed.STATE_NOW).alias("state"), F.col(fixed.GROUP_NOW).alias("in_group"), entry.isNotNull().alias("has_entry"),
        recovery.isNotNull().alias("has_recovery"), persistence.isNotNull().alias("has_persistence"),
        F.coalesce(F.abs(recovery + persistence - 1) < 1e-9, F.lit(True)).alias("adds_up"),
        F.col(fixed.RELEVANT_SCORE).eqNullSafe(F.coalesce(entry, recovery)).alias("relevant"), F.col(fixed.MODEL_USED).alias("model"),
    )


@query("m16_evaluate_pair", f"""
WITH {LABELLED_FULL} SELECT count(*) AS compared_rows, max(period) + 0 AS current_period, max(period) + 1 AS next_period, true AS measured,
  count(*) FILTER (target = 1) AS actual_positives, count(*) FILTER (level >= 0) AS entry_scores, count(*) FILTER (level < 0) AS recovery_scores
FROM labelled WHERE period = (SELECT max(period) FROM labelled)
""")
def m16(spark, folder):
    """The refitted winner and the segment models on the last pair of periods; outcomes counted anew."""
    current, following, _ = last_pair(spark, folder)
    bundle, segments = trained(spark, folder).winner, segment_models(spark, folder)
    models.fit_all([bundle, *segments.values()], SETTINGS.parallelism)
    found = evaluate.evaluate_pair(current, following, bundle, segments, SETTINGS)
    measured = all(0 <= found.metrics[m] <= 1 for m in METRICS)
    counted = found.rows.agg(
        F.count_if(F.col(fixed.ACTUAL) == 1).alias("actual_positives"), F.count(fixed.ENTRY_SCORE).alias("entry_scores"),
        F.count(fixed.RECOVERY_SCORE).alias("recovery_scores"))
    return spark.createDataFrame(
        [(found.compared_rows, found.current_period, found.next_period, measured)],
        "compared_rows long, current_period int, next_period int, measured boolean",
    ).join(counted)


COMPARED = tuple(f"{name}__{strategy}" for strategy in SETTINGS.strategies for name in SETTINGS.models)


def compared(spark, folder):
    """The rule and all six candidates, fitted at the same time."""
    bundles = trained(spark, folder).frozen
    models.fit_all(bundles, len(bundles))
    return bundles


@query("m17_evaluate_candidates", f"""
WITH {LABELLED_FULL} SELECT entity, period, round(next_level, 4) AS level, target AS actual, CASE WHEN level < 0 THEN 1 ELSE 0 END AS decision,
  CAST({len(COMPARED) + 1} AS BIGINT) AS candidates, CAST({len(COMPARED) + 1} AS BIGINT) AS hits_agree FROM labelled WHERE period = (SELECT max(period) FROM labelled)
""")
def m17(spark, folder):
    """The stored rows of all candidates by batch row: the next period's level, what happened, what the rule said."""
    current, _, rows = last_pair(spark, folder)
    found = evaluate.evaluate_candidates(current, rows, compared(spark, folder), SETTINGS).rows
    of_rule = F.when(F.col("model_id") == RULE, F.col(fixed.PREDICTION))
    hit = F.col(fixed.HIT).cast("boolean") == (F.col(fixed.ACTUAL) == (F.col(fixed.PROBABILITY) >= 0.5).cast("int"))
    return found.groupBy("entity", "period", F.round("level", 4).alias("level"), F.col(fixed.ACTUAL).alias("actual")).agg(
        F.max(of_rule).alias("decision"), F.countDistinct("model_id").alias("candidates"), F.count_if(hit).alias("hits_agree"))


@query("u5_score_all_models", f"""
WITH {LAST} SELECT entity, CAST(7 AS BIGINT) AS models, CAST(7 AS BIGINT) AS same, CASE WHEN level < 0 THEN 1 ELSE 0 END AS rule FROM last
""")
def u5(spark, folder):
    """One pass for the rule and all six candidates gives what each model gives by itself."""
    bundles, rows = trained(spark, folder).frozen, trained(spark, folder).validation
    models.fit_all(bundles, SETTINGS.parallelism)
    scored = models.score_all(bundles, rows, ["entity"], "level")
    single = union_all([
        models.score_frame(b, rows, ["entity"], "level").select("entity", F.lit(b.model_id).alias("model_id"), F.col(fixed.PROBABILITY).alias("by_itself"))
        for b in bundles
    ])
    rule = F.when(F.col("model_id") == RULE, F.col(fixed.PREDICTION))
    return scored.join(single, ["entity", "model_id"]).groupBy("entity").agg(
        F.countDistinct("model_id").alias("models"), F.count_if(F.abs(F.col(fixed.PROBABILITY) - F.col("by_itself")) < 1e-12).alias("same"), F.max(rule).alias("rule"),
    )


SIGNALS = [("n_orders", "Orders", True, "sell more often"), ("avg_price", "Mean price", True, "offer larger baskets")]


@query("m18_actionable_insights", f"""
WITH {RULED}, last AS (SELECT * FROM ruled WHERE period = (SELECT max(period) FROM ruled)),
means AS (SELECT feature, avg(value) FILTER (error_type = 'correct') AS c, avg(value) FILTER (error_type = 'false_negative') AS f, avg(value) FILTER (error_type = 'false_positive') AS p
  FROM (SELECT error_type, n_orders, avg_price FROM last) UNPIVOT (value FOR feature IN (n_orders, avg_price)) GROUP BY feature),
deltas AS (SELECT 'entry' AS scenario, feature, f - c AS delta FROM means UNION ALL SELECT 'recovery', feature, p - c FROM means)
SELECT CAST(4 AS BIGINT) AS run_id, CAST((SELECT max(period) FROM ruled) AS INTEGER) AS validation_year, 'v1-r7' AS data_version, scenario, feature,
  CASE feature WHEN 'n_orders' THEN 'Orders' ELSE 'Mean price' END AS label, round(delta, 4) AS comparison_delta, true AS is_share FROM deltas
""")
def m18(spark, folder):
    """Signals of a stored residual study with the run, year and data version they belong to."""
    result, store = trained(spark, folder), new_store(spark)
    found = train.residual_analysis(result.validation, SETTINGS)
    store.append_run("baseline_analysis_runs", {
        "id": 4, "training_run_id": 1, "validation_reference_year": result.validation_period, "data_version": "v1-r7",
        "numeric_summary": monitor.as_dicts(found.numeric), "false_negative_importances": monitor.as_dicts(found.entry_importances),
        "recovery_importances": monitor.as_dicts(found.recovery_importances),
    })
    actions = spark.createDataFrame(SIGNALS, "feature string, label string, higher_is_better boolean, action_hint string")
    rows = monitor.actionable_insights(store, actions)
    return rows.select(
        "run_id", "validation_year", "data_version", "scenario", "feature", "label", F.round("comparison_delta", 4).alias("comparison_delta"),
        F.col("importance").between(0, 1).alias("is_share"))


@query("s4_reference_scan", f"""
WITH {LABELLED_FULL} SELECT segment, priority, n_orders, round(avg_price, 4) AS avg_price, round(min_price, 4) AS min_price, CASE WHEN n_orders < 2 THEN 1.0 ELSE 0.0 END AS flag_min_missing FROM labelled
""")
def s4(spark, folder):
    """The rows that a model of strategy B is refitted on, as they come back from the store; nothing is fitted."""
    store, result = new_store(spark), trained(spark, folder)
    bundle = result.model("random_forest__strategy_b")
    store.save_reference(3, result.reference_of(bundle))
    store.append_run("training_runs", {"id": 3, "selected_feature_columns": list(bundle.features.columns)})
    reference, _, _ = store.load_reference()
    return rounded(reference.select("segment", "priority", "n_orders", "avg_price", "min_price", "flag_min_missing"), "avg_price", "min_price", digits=4)


TRAINED_LONG = f"""
long AS (
  SELECT feature, value, side FROM (
    SELECT *, 'earlier' AS side FROM (SELECT n_orders, avg_price, min_price, max_price, CASE WHEN n_orders < 2 THEN 1.0 ELSE 0.0 END AS flag_min_missing FROM labelled)
    UNION ALL SELECT *, 'later' FROM (SELECT n_orders, avg_price, min_price, max_price, CASE WHEN n_orders < 2 THEN 1.0 ELSE 0.0 END FROM full_panel))
  UNPIVOT (value FOR feature IN (n_orders, avg_price, min_price, max_price, flag_min_missing)))
"""
TRAINED_NUMERIC = NUMERIC.replace("JOIN psi", "LEFT JOIN psi").replace("round(psi, 6)", "round(coalesce(psi, 0), 6)").replace("psi >= 0.2", "coalesce(psi, 0) >= 0.2")
TRAINED_TEXTS = """
kinds AS (SELECT feature, category, count(*) FILTER (side = 'earlier') AS r, count(*) FILTER (side = 'later') AS c FROM (
    SELECT segment, nation, priority, 'earlier' AS side FROM labelled UNION ALL SELECT segment, nation, priority, 'later' FROM full_panel)
  UNPIVOT (category FOR feature IN (segment, nation, priority)) GROUP BY 1, 2)
"""


@query("a18_drift_against_training", f"""
WITH {LABELLED_FULL}, {TRAINED_LONG}, {EDGES}, {BINNED}, {PSI}, {TRAINED_NUMERIC}, {TRAINED_TEXTS}, {CATEGORICAL.split(" AS c FROM texts GROUP BY 1, 2),", 1)[1]}
SELECT feature, type, reference_mean, current_mean, psi, NULL AS reference_top, NULL AS current_top, NULL AS distribution_shift, NULL AS new_category_rate, alert FROM numeric_rows
UNION ALL SELECT feature, type, NULL, NULL, NULL, reference_top, current_top, distribution_shift, new_category_rate, alert FROM categorical_rows
""")
def a18_training(spark, folder):
    """All rows against the rows a model of strategy B is refitted on; nothing is fitted."""
    result = trained(spark, folder)
    bundle = result.model("random_forest__strategy_b")
    current = models.coerce_features(batch(spark, folder), bundle.features)
    report = drift_report(result.reference_of(bundle), current, list(bundle.features.columns), TEXTS).drop("position")
    return rounded(rounded(report, "psi", "distribution_shift", "new_category_rate"), "reference_mean", "current_mean", digits=4)


@query("a24_overview", f"""
WITH {LABELLED_FULL}, {TRAINED_LONG}, {EDGES}, {BINNED}, {PSI}, {TRAINED_NUMERIC}, {TRAINED_TEXTS}, {CATEGORICAL.split(" AS c FROM texts GROUP BY 1, 2),", 1)[1]},
p AS (SELECT DISTINCT o_custkey AS ra, year(o_orderdate) AS y FROM orders), last AS (SELECT * FROM labelled WHERE period = (SELECT max(period) FROM labelled)),
e AS (SELECT count(*) AS rows, round(avg(CASE WHEN (level < 0) = (target = 1) THEN 1.0 ELSE 0.0 END), 6) AS accuracy, count(*) FILTER (level < 0) AS predicted, max(period) AS year FROM last)
SELECT (SELECT count(*) FROM p) AS rows, (SELECT count(DISTINCT ra) FROM p) AS entities, CAST(1 AS INTEGER) AS candidate_count, '{fixed.BASELINE_MODEL}' AS selected_model,
  (SELECT count(*) FROM (SELECT alert FROM numeric_rows UNION ALL SELECT alert FROM categorical_rows) WHERE alert) AS drift_alert_count,
  e.rows AS evaluation_rows, e.accuracy AS evaluation_accuracy, e.predicted AS predicted_positive, CAST(e.year AS INTEGER) AS study_year, CAST(5 AS BIGINT) AS transition_run_id,
  'v1-r' || CAST((SELECT count(*) FROM p) AS VARCHAR) AS data_version FROM e
""")
def a24(spark, folder):
    """The store's state with the last run of every kind; the rule is the only candidate, so nothing is fitted."""
    store, result = new_store(spark), trained(spark, folder)
    ingest(store, canonical_orders(spark, folder), {"source_file": "orders"})
    rule = [b for b in result.frozen if b.model_id == RULE]
    measured = result.measure(rule)
    scored = models.score_frame(rule[0], result.validation, ["entity", "target"], "level").withColumnRenamed("target", fixed.ACTUAL)
    store.append_children("evaluation_rows", scored.withColumn("model_id", F.lit(RULE)), 1, ["model_id"])
    features = FEATURES_B
    summary = drift_summary(drift_report(
        models.coerce_features(result.labelled, features), models.coerce_features(batch(spark, folder), features), list(features.columns), TEXTS)).first()
    store.append_run("drift_runs", {"id": 1, "feature_rows": summary.feature_rows, "alert_count": summary.alert_count})
    shared = {"training_run_id": 1, "validation_reference_year": result.validation_period}
    store.append_run("baseline_analysis_runs", {**shared, "id": 4, "baseline_metrics": measured[0]["metrics"]})
    store.append_run("transition_score_runs", {**shared, "id": 5, "entry_metrics": {**measured[0]["metrics"], "status": "unavailable"}})
    store.append_run("evaluation_runs", {"id": 1, "selected_model_id": RULE, "current_year": result.validation_period, "next_year": result.validation_period + 1})
    store.append_run("training_runs", {
        "id": 1, "selected_model": fixed.BASELINE_MODEL, "selected_strategy": fixed.BASELINE_STRATEGY, "candidates": measured, "data_version": store.data_version(),
    })
    evaluation = F.col("latest_evaluation")
    return monitor.overview_report(store).select(
        "rows", "entities", "candidate_count", "selected_model", "drift_alert_count", evaluation["rows"].alias("evaluation_rows"),
        F.round(evaluation["accuracy"], 6).alias("evaluation_accuracy"), evaluation["predicted_positive"].alias("predicted_positive"),
        F.col("baseline_analysis.validation_reference_year").alias("study_year"), F.col("transition_scores.id").alias("transition_run_id"), "data_version",
    )


COMPARED_ROWS = f"""
WITH {LAST} SELECT entity, period, CASE WHEN level < 0 THEN 1 ELSE 0 END AS decision, target AS actual, (level < 0) = (target = 1) AS hit FROM last
"""


@query("o8_evaluation_detail", f"SELECT * FROM ({COMPARED_ROWS}) ORDER BY entity, period LIMIT 250")
def o8_detail(spark, folder):
    """What is shown of an evaluation of all candidates: the first 250 rows of the chosen one, here the rule."""
    current, _, rows = last_pair(spark, folder)
    rule = [b for b in trained(spark, folder).frozen if b.model_id == RULE]
    return shown(evaluate.evaluate_candidates(current, rows, rule, SETTINGS).detail(RULE))


@query("o8_pair_preview", f"SELECT * FROM ({COMPARED_ROWS}) ORDER BY entity, period LIMIT 10")
def o8_pair(spark, folder):
    """What is shown of a compared pair of batches: its first ten rows."""
    current, following, _ = last_pair(spark, folder)
    return shown(evaluate.evaluate_pair(current, following, models.baseline_bundle("level"), {}, SETTINGS).preview)


def shown(rows):
    return rows.select("entity", "period", F.col(fixed.PREDICTION).alias("decision"), F.col(fixed.ACTUAL).alias("actual"), F.col(fixed.HIT).cast("boolean").alias("hit"))
