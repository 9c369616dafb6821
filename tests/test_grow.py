"""Trees grown in tasks against brute force and against Spark ML's."""

import math
import random

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from panelwise.operators import forests, grow, models
from panelwise.operators.certificates import forest_facts, importances_agree, node_table
from panelwise.operators.models import Features, TreeSizes

FEATURES = Features(("a", "b", "c", "kind"), ("kind",))
SIZES = TreeSizes(forest_trees=30, forest_depth=8, boosting_rounds=12, boosting_depth=4, max_bins=64)


@pytest.fixture(scope="module")
def made(spark):
    rng = random.Random(3)
    rows = []
    for _ in range(700):
        a, kind = rng.choice([None, rng.randrange(9)]), rng.choice(["x", "y", "z", None])
        b = rng.randrange(20) / 4
        rows.append((None if a is None else float(a), b, float(rng.randrange(2)), kind, int(rng.random() < 1 / (1 + math.exp(b - 2.5 - (kind == "x"))))))
    frame = spark.createDataFrame(rows, "a double, b double, c double, kind string, y int").repartition(3)
    counts = models.class_counts(frame, "y")
    encoder = models.fit_encoder(frame, FEATURES)
    return frame, counts, encoder, models.spread(models.encode(frame, FEATURES, encoder, "y", counts), 700)


def codes_and_rows(encoded):
    codes = models.codes_of(encoded, models.forest(SIZES, "y"))
    got = grow.blocks(encoded, "y", codes).withColumn("bundle", F.lit(0)).toArrow().to_batches()
    return codes, *grow.gathered(iter(got), codes)[1:]


def test_a_split_is_the_best_of_all(spark, made):
    """Every split of every column tried row by row; left rows are those of the split."""
    encoded = made[3]
    codes, label, cell = codes_and_rows(encoded)
    splits, weights = grow.Splits(codes), np.array(codes.class_weights)
    cells = np.array([r.x for r in encoded.select(vector_to_array("features").alias("x")).collect()])
    y = np.array([r.y for r in encoded.select("y").collect()])
    assert (label == y).all()
    gini = lambda side: 1 - sum((weights[c] * (side == c).sum() / max(1e-300, weights[side].sum())) ** 2 for c in (0, 1))
    whole, best = weights[y].sum(), -1.0
    for i in range(len(splits.feature)):
        left = cells[:, splits.feature[i]] <= splits.threshold[i]
        assert (splits.goes_left(cell, np.arange(len(y)), np.full(len(y), i)) == left).all()
        if min(left.sum(), (~left).sum()) >= 40:
            best = max(best, gini(y) - sum(weights[y[s]].sum() / whole * gini(y[s]) for s in (left, ~left)))
    totals = np.array([[(y == 0).sum(), (y == 1).sum()]], float)
    held = grow.summed(np.arange(len(y)), np.zeros(len(y), int), cell, splits, 1, y.astype(int), 2, None)
    _, gain = grow.best_splits(splits, held, totals, weights, 40, codes.width, np.random.default_rng(0))
    assert abs(gain[0] - best) < 1e-9 and best > 0


def test_forests_need_no_job_a_level(spark, made, monkeypatch):
    """Spark ML's fit is not asked; sizes, limits and importances are those of a forest, and a second fit gives the same."""
    frame, counts, encoder, encoded = made
    monkeypatch.setattr(RandomForestClassifier, "_fit", lambda *_: pytest.fail("fitted level by level"))
    model = models.fit_on(encoded, encoder, models.forest(SIZES, "y"))
    last = model.stages[-1]
    assert tuple(forest_facts(node_table(last)).first())[0] == 30 and forest_facts(node_table(last)).first()[1] >= 2
    assert importances_agree(last, node_table(last)).first().agree
    again = models.fit_forest(encoded, models.forest(SIZES, "y"))
    nodes = lambda m: sorted(map(str, m.rows.select("treeID", "nodeData").collect()))
    assert nodes(last) == nodes(again)
    alone = models.forest_importances(encoded, models.forest(SIZES, "y"))
    assert np.abs(np.array(alone) - last.featureImportances.toArray()).max() < 1e-12


def test_forests_learn_as_spark_mls(spark, made):
    """About the same probabilities as a forest of Spark ML on the same rows, whose own scoring the bulk scoring repeats."""
    frame, counts, encoder, encoded = made
    sizes = TreeSizes(forest_trees=200, forest_depth=6)
    own = models.fit_forest(encoded, models.forest(sizes, "y"))
    theirs = models.level_forest(encoded, models.forest(sizes, "y"))
    p = lambda m, name: m.transform(encoded.withColumn("i", F.monotonically_increasing_id())).select("i", vector_to_array("probability")[1].alias(name))
    row = p(own, "o").join(p(theirs, "t"), "i").agg(F.corr("o", "t"), F.avg(F.abs(F.col("o") - F.col("t")))).first()
    assert row[0] > 0.97 and row[1] < 0.04
    bulk = encoded.select(forests.forest_probability(theirs, "features").alias("p")).agg(F.sum("p")).first()[0]
    assert abs(bulk - p(theirs, "t").agg(F.sum("t")).first()[0]) < 1e-6


def test_boosting_is_spark_mls(spark, made, tmp_path, monkeypatch):
    """The same trees as Spark ML's, which has no random part here, without a job a level; saved and loaded as Spark ML's."""
    frame, counts, encoder, encoded = made
    estimator = models.candidates(SIZES, "y", 700)["hist_gradient_boosting"]
    theirs = estimator.fit(encoded)
    monkeypatch.setattr(GBTClassifier, "_fit", lambda *_: pytest.fail("fitted level by level"))
    model = models.fit_on(encoded, encoder, estimator)
    own = model.stages[-1]
    assert list(own.treeWeights) == list(theirs.treeWeights) and own.numFeatures == theirs.numFeatures
    p = lambda m: [r[0] for r in m.transform(encoded).select(vector_to_array("probability")[1]).collect()]
    assert np.abs(np.array(p(own)) - p(theirs)).max() < 1e-6
    model.write().save(str(tmp_path / "model"))
    assert p(PipelineModel.load(str(tmp_path / "model")).stages[-1]) == p(own)


def test_more_rows_than_a_task_holds_are_spark_mls(spark, made, monkeypatch):
    frame, counts, encoder, encoded = made
    monkeypatch.setattr(grow, "TASK_BYTES", 1_000)
    few = TreeSizes(forest_trees=2, forest_depth=2, boosting_rounds=2, boosting_depth=2)
    forest = models.fit_forest(encoded, models.forest(few, "y"))
    assert not isinstance(forest, forests.GrownForest) and forests.trees_of(forest) == 2
    assert models.fit_boosting(encoded, models.candidates(few, "y", 700)["hist_gradient_boosting"]).getNumTrees == 2


def test_odd_rows_of_a_fit(spark, made):
    """No column splits, one class only, missing numbers: a forest of leaves, or of what can be split."""
    for rows in ([(1.0, 1), (1.0, 0)] * 20, [(float(i), 1) for i in range(9)], [(None, 0), (float("nan"), 1), (7.0, 1)] * 9, [(0.5, 1)]):
        frame = spark.createDataFrame(rows, "a double, y int")
        features, counts = Features(("a",), ()), {0: 1, 1: 1}
        model = models.fit(frame, features, models.forest(TreeSizes(forest_trees=3, forest_depth=3), "y"), "y", counts)
        scored = models.probability_of(model, frame, features, ["y"], "p").collect()
        assert len(scored) == len(rows) and all(0 <= r.p <= 1 for r in scored)
