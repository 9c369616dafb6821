"""Evidence that a fitted model is what it should be, computed without the fitting code.

A fit cannot be restated in SQL, but what defines it can be checked: the gradient of the penalised loss is
zero at a logistic regression's solution, and a forest's importances, sizes and limits follow from its
stored nodes.
"""

from pyspark.ml import Model, PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from panelwise.operators.forests import stored_nodes

TINY = 1e-15


def log_loss(label: str, probability: str, weight: Column | None = None) -> Column:
    """Mean logistic loss as an aggregate; certain and wrong answers cost a finite amount."""
    p = F.least(F.greatest(F.col(probability), F.lit(TINY)), F.lit(1 - TINY))
    loss = -F.when(F.col(label) == 1, F.log(p)).otherwise(F.log1p(-p))
    return F.avg(loss) if weight is None else F.sum(weight * loss) / F.sum(weight)


def prior_loss(label: str, weight: Column | None = None) -> Column:
    """The loss of always giving the (weighted) share of the classes."""
    y = F.col(label).cast("double")
    p = F.avg(y) if weight is None else F.sum(weight * y) / F.sum(weight)
    return -(p * F.log(p) + (1 - p) * F.log(1 - p))


def ridge_gradient(model: Model, encoded: DataFrame, label: str, weight: str, strength: float) -> DataFrame:
    """position, gradient: the slope of the weighted, penalised loss at the solution, per encoded column in units
    of its standard deviation; position -1 is the intercept, which is not penalised. One aggregate."""
    scored = model.transform(encoded).select(
        F.col(weight).alias("w"), (F.col(weight) * (vector_to_array("probability")[1] - F.col(label))).alias("r"),
        F.concat(F.array(F.lit(1.0)), vector_to_array("features")).alias("x"),
    )
    long = scored.select("w", "r", F.posexplode("x").alias("at", "x"))
    sums = long.groupBy("at").agg(F.sum("w").alias("w"), F.sum(F.col("r") * F.col("x")).alias("slope"), F.stddev("x").alias("spread"))
    coefficients = encoded.sparkSession.createDataFrame(
        [(0, 0.0), *((i + 1, float(b)) for i, b in enumerate(model.coefficients))], "at int, b double"
    )
    slope = F.col("slope") / F.col("w") + strength * F.col("b")
    spread = F.when((F.col("at") == 0) | (F.col("spread") == 0), F.lit(1.0)).otherwise(F.col("spread"))
    return sums.join(coefficients, "at").select((F.col("at") - 1).alias("position"), (slope / spread).alias("gradient"))


def node_table(model: Model) -> DataFrame:
    """The nodes of a tree ensemble as it is stored: tree, id, count (weighted rows), rows, gain, feature (null in
    leaves), left, right, prediction."""
    nodes = stored_nodes(model)
    inner = F.col("leftChild") >= 0
    return nodes.select(
        "tree", "id", F.aggregate("impurityStats", F.lit(0.0), lambda a, b: a + b).alias("count"), F.col("rawCount").alias("rows"),
        F.when(inner, F.col("gain")).alias("gain"), F.when(inner, F.col("split.featureIndex")).alias("feature"),
        F.when(inner, F.col("leftChild")).alias("left"), F.when(inner, F.col("rightChild")).alias("right"), "prediction",
    )


def _session():
    from pyspark.sql import SparkSession

    return SparkSession.active()


def node_importances(nodes: DataFrame) -> DataFrame:
    """feature, importance: gains weighted by rows, each tree's made to sum to 1, averaged, made to sum to 1."""
    gains = nodes.where(F.col("feature").isNotNull()).groupBy("tree", "feature").agg(F.sum(F.col("gain") * F.col("count")).alias("gain"))
    whole = gains.groupBy("tree").agg(F.sum("gain").alias("whole")).where("whole > 0")
    shares = gains.join(whole, "tree").groupBy("feature").agg(F.sum(F.col("gain") / F.col("whole")).alias("share"))
    return shares.select("feature", (F.col("share") / shares.agg(F.sum("share")).scalar()).alias("importance"))


def importances_agree(model: Model, nodes: DataFrame, within: float = 1e-9) -> DataFrame:
    """features, agree, whole: whether the model's importances are those of its nodes, and sum to 1."""
    own = enumerate(model.featureImportances.toArray().tolist())
    mine = _session().createDataFrame([(i, v) for i, v in own], "feature int, mine double")
    both = mine.join(node_importances(nodes), "feature", "full")
    difference = F.abs(F.coalesce("mine", F.lit(0.0)) - F.coalesce("importance", F.lit(0.0)))
    return both.agg(
        F.count("*").alias("features"), (F.max(difference) <= within).alias("agree"), (F.abs(F.sum("mine") - 1) <= within).alias("whole"),
    )


def forest_facts(nodes: DataFrame) -> DataFrame:
    """trees, least_rows: the number of trees and the fewest rows in a leaf."""
    return nodes.agg(F.countDistinct("tree").alias("trees"), F.min(F.when(F.col("feature").isNull(), F.col("rows"))).alias("least_rows"))


def last_stage(model: PipelineModel) -> Model:
    return model.stages[-1]
