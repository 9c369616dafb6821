"""Feature preparation, candidates and fits with Spark ML."""

import json
import time
from collections import deque
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from threading import Lock

import numpy as np
from pyspark.ml import Estimator, Model, Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier, LogisticRegression, RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from panelwise import fixed
from panelwise.frames import materialize, new_folder, shared_folder
from panelwise.functions.risk import baseline_predict, decide, missing_flag
from panelwise.functions.text import category
from panelwise.operators import grow
from panelwise.operators.forests import DENSE_FEATURES, TINY_SUM, GrownForest, forest_probability, mean_importances, packs, remember, trees_of

MISSING_NUMBER = -1.0
WEIGHT = "_weight"


@dataclass(frozen=True)
class Features:
    """The columns a model sees, in order, and which of them are categories."""

    columns: tuple[str, ...]
    categorical: tuple[str, ...] = fixed.CATEGORICAL_FEATURES

    @property
    def text(self) -> list[str]:
        return [c for c in self.columns if c in self.categorical]

    @property
    def numbers(self) -> list[str]:
        return [c for c in self.columns if c not in self.categorical]


STRATEGIES = {"strategy_a": Features(fixed.STRATEGY_A), "strategy_b": Features(fixed.STRATEGY_B)}


@dataclass(frozen=True)
class TreeSizes:
    """Sizes of the ensembles. The defaults are the real ones; small trials pass smaller ones.

    ``fit_rows`` bounds the rows of one fit: of more, those whose hash is small enough are taken, the same
    share of each class. By default there is no bound.
    """

    forest_trees: int = 300
    forest_depth: int = 30
    forest_bins: int = 32
    boosting_rounds: int = 100
    boosting_depth: int = 6
    max_bins: int = 255
    seed: int = 42
    fit_rows: int | None = None


class Later[T]:
    """A value that is made when it is first asked for, once, whichever thread asks."""

    def __init__(self, make: Callable[[], T]):
        self._make, self._lock, self._made = make, Lock(), False

    def __call__(self) -> T:
        with self._lock:
            if not self._made:
                self._value, self._made = self._make(), True
        return self._value

    @property
    def made(self) -> bool:
        return self._made


@dataclass(frozen=True)
class Bundle:
    """A model with what is needed to apply it; the rule has none. A model given as ``Later`` is fitted when it is first used."""

    model_name: str
    strategy: str
    features: Features
    fitted: PipelineModel | Later | None = None
    threshold: float = fixed.DECISION_THRESHOLD
    kind: str = "model"
    validation_period: int | None = None
    label_name: str | None = None

    @property
    def model_id(self) -> str:
        return f"{self.model_name}{fixed.MODEL_ID_SEPARATOR}{self.strategy}"

    @property
    def model(self) -> PipelineModel | None:
        return self.fitted() if isinstance(self.fitted, Later) else self.fitted


def fit_all(bundles: list[Bundle], parallelism: int) -> None:
    """Fit what is not fitted yet; the fits are independent jobs and share the executors."""
    waiting = [b for b in bundles if isinstance(b.fitted, Later) and not b.fitted.made]
    with ThreadPoolExecutor(max(1, parallelism)) as pool:
        for done in [pool.submit(b.fitted) for b in waiting]:
            done.result()


def baseline_bundle(level: str, validation_period: int | None = None) -> Bundle:
    return Bundle(
        fixed.BASELINE_MODEL, fixed.BASELINE_STRATEGY, Features((level,), ()), kind="baseline",
        validation_period=validation_period,
    )


def with_missing_flag(df: DataFrame, source: str = "ipp", flag: str = "flag_ipp_ausente") -> DataFrame:
    """The missing flag, made the same way for training, scoring and drift."""
    if source not in df.columns:
        return df.withColumn(flag, F.lit(1))
    return df.withColumn(flag, missing_flag(source))


def coerce_features(df: DataFrame, features: Features, keep: list[str] = ()) -> DataFrame:
    """Numbers as doubles, categories as text with a level for missing; absent columns are missing."""
    present = lambda c: F.col(c) if c in df.columns else F.lit(None)
    number = lambda c: F.when(~F.isnan(present(c).cast("double")), present(c).cast("double"))
    return df.select(
        *keep, *[(category(present(c)) if c in features.categorical else number(c)).alias(c) for c in features.columns]
    )


def feature_stages(features: Features) -> list:
    """Index and one-hot encode categories, an unknown level being all zeros, then assemble with the numbers."""
    text, stages = features.text, []
    indexed, encoded = [f"{c}_index" for c in text], [f"{c}_hot" for c in text]
    if text:
        stages.append(StringIndexer(inputCols=text, outputCols=indexed, handleInvalid="keep", stringOrderType="alphabetAsc"))
        # The indexer's extra level is the last one and is dropped: unseen levels become zeros.
        stages.append(OneHotEncoder(inputCols=indexed, outputCols=encoded, dropLast=True, handleInvalid="error"))
    stages.append(VectorAssembler(inputCols=encoded + [f"{c}_filled" for c in features.numbers], outputCol="features"))
    return stages


def fill_numbers(df: DataFrame, features: Features) -> DataFrame:
    """Missing numbers become -1."""
    return df.withColumns({f"{c}_filled": F.coalesce(F.col(c), F.lit(MISSING_NUMBER)) for c in features.numbers})


def prepared(df: DataFrame, features: Features, keep: list[str] = ()) -> DataFrame:
    return fill_numbers(coerce_features(df, features, list(keep)), features)


def class_counts(df: DataFrame, label: str) -> dict[int, int]:
    """Rows per class, at most a handful of numbers."""
    return {int(row[0]): int(row[1]) for row in df.groupBy(label).agg(F.count("*")).collect() if row[0] is not None}


def balanced_weight(label: str, counts: dict[int, int]) -> Column:
    """n / (classes * rows of the class)."""
    total, weight = sum(counts.values()), F.lit(None).cast("double")
    for value, n in counts.items():
        weight = F.when(F.col(label) == value, total / (len(counts) * n)).otherwise(weight)
    return weight


def class_weights(df: DataFrame, label: str, by: list[str] = ()) -> DataFrame:
    """Balanced weight of each class as a table."""
    classes = df.where(F.col(label).isNotNull()).groupBy(*by, label).agg(F.count("*").alias("n"))
    totals = classes.groupBy(*by).agg(F.sum("n").alias("total"), F.count("*").alias("k"))
    joined = classes.join(totals, list(by)) if by else classes.withColumns(
        {"total": totals.select("total").scalar(), "k": totals.select("k").scalar()}
    )
    return joined.select(*by, label, "n", (F.col("total") / (F.col("k") * F.col("n"))).alias("weight"))


def candidates(sizes: TreeSizes, label: str, rows: int) -> dict[str, Estimator]:
    """The three statistical candidates. Balanced weights sum to the row count, hence the ridge strength 1/n."""
    shared = {"labelCol": label, "featuresCol": "features"}
    return {
        "logistic_regression": LogisticRegression(
            **shared, weightCol=WEIGHT, regParam=1.0 / max(rows, 1), elasticNetParam=0.0, standardization=False, maxIter=5000
        ),
        "random_forest": forest(sizes, label),
        "hist_gradient_boosting": GBTClassifier(
            **shared, maxIter=sizes.boosting_rounds, stepSize=0.1, maxDepth=sizes.boosting_depth, minInstancesPerNode=20,
            maxBins=sizes.max_bins, seed=sizes.seed,
        ),
    }


def forest(sizes: TreeSizes, label: str) -> RandomForestClassifier:
    """Node ids stay with the rows, checkpointed every few levels, so that jobs do not carry the trees grown so far."""
    return RandomForestClassifier(
        labelCol=label, featuresCol="features", weightCol=WEIGHT, numTrees=sizes.forest_trees, maxDepth=sizes.forest_depth,
        minInstancesPerNode=2, featureSubsetStrategy="sqrt", maxBins=sizes.forest_bins, seed=sizes.seed, maxMemoryInMB=256,
        cacheNodeIds=True, checkpointInterval=10,
    )


# A task of a forest's fit holds dense statistics of every open node, and all tasks' are shuffled and added up: deep
# trees cost nodes times tasks. So a few trees at a time grow from few, large parts of the rows, many such fits at once.
FOREST_ROWS_IN_PART = 250_000
TREES_AT_ONCE = 12
BAGGED_ROWS_OF_PART = 250_000  # below that a part takes more trees: its jobs would be all overhead
BAGGED_ROWS_AT_ONCE = 1_000_000  # of all trees of one fit: a bound on the nodes that the driver holds for it
WRITTEN_AT_ONCE = 4  # parts whose nodes are being stored
SEED_STEP = 1_000_003  # Spark seeds the bags of its partitions with neighbouring numbers


def trees_of_part(rows: int) -> int:
    return max(1, min(max(TREES_AT_ONCE, BAGGED_ROWS_OF_PART // rows), BAGGED_ROWS_AT_ONCE // rows))


def codes_of(encoded: DataFrame, estimator: Estimator) -> grow.Codes | None:
    """How the rows become codes for trees grown in tasks; None when one task can't hold them."""
    width = encoded.schema["features"].metadata.get("ml_attr", {}).get("num_attrs", 0)
    if not 0 < width <= DENSE_FEATURES or estimator.getMaxBins() > 256:
        return None
    codes = grow.learn_codes(encoded, estimator.getLabelCol(), WEIGHT, width, estimator.getMaxBins())
    return codes if codes is not None and codes.fits_in_task else None


def grown_nodes(encoded: DataFrame, estimator: RandomForestClassifier) -> tuple[DataFrame, int] | None:
    """The nodes of the forest grown in tasks, and the number of columns; None when one task can't hold the rows."""
    codes = codes_of(encoded, estimator)
    if codes is None:
        return None
    tried = int(np.ceil(np.sqrt(codes.width)))  # the strategy "sqrt"
    return grow.grown_forest(
        encoded, estimator.getLabelCol(), codes, estimator.getNumTrees(), estimator.getMaxDepth(), estimator.getMinInstancesPerNode(),
        tried, estimator.getSeed()), codes.width


def grown_forest(encoded: DataFrame, estimator: RandomForestClassifier) -> GrownForest | None:
    """The forest grown in tasks and stored; None when one task can't hold the rows."""
    found = grown_nodes(encoded, estimator)
    if found is None:
        return None
    folder = new_folder(encoded.sparkSession, "forest")
    found[0].write.parquet(f"{folder}/data")
    return GrownForest(folder, estimator.getNumTrees(), found[1])


def forest_parts(encoded: DataFrame, estimator: RandomForestClassifier) -> Iterator[GrownForest | RandomForestClassificationModel]:
    """The forest as smaller ones, all on all rows, in order."""
    whole = grown_forest(encoded, estimator)
    yield from level_parts(encoded, estimator) if whole is None else whole.parts(trees_of_part(max(1, encoded.count())))


def level_parts(encoded: DataFrame, estimator: RandomForestClassifier) -> Iterator[RandomForestClassificationModel]:
    """The same from Spark ML's fits, as they become ready; only some are on the driver at once."""
    rows, trees = encoded.count(), estimator.getNumTrees()
    partitions = max(1, -(-rows // FOREST_ROWS_IN_PART))
    shared, each = encoded.coalesce(partitions), trees_of_part(max(1, rows))
    asked = [
        {estimator.numTrees: min(each, trees - first), estimator.seed: estimator.getSeed() + SEED_STEP * i}
        for i, first in enumerate(range(0, trees, each))
    ]
    at_once = min(len(asked), encoded.sparkSession.sparkContext.defaultParallelism // partitions + 1)
    with ThreadPoolExecutor(at_once) as pool:
        waiting = deque()
        for part in asked:
            waiting.append(pool.submit(estimator.fit, shared, part))
            if len(waiting) > at_once:
                yield waiting.popleft().result()
        while waiting:
            yield waiting.popleft().result()


def fit_forest(encoded: DataFrame, estimator: RandomForestClassifier) -> GrownForest | RandomForestClassificationModel:
    """The forest grown in tasks or, of more rows than a task may hold, put together from Spark ML's parts."""
    whole = grown_forest(encoded, estimator)
    return level_forest(encoded, estimator) if whole is None else whole


def level_forest(encoded: DataFrame, estimator: RandomForestClassifier) -> RandomForestClassificationModel:
    """One model of all parts' trees, whose nodes are stored part by part as they become ready."""
    folder, parts, written = new_folder(encoded.sparkSession, "forest"), [], []
    with ThreadPoolExecutor(WRITTEN_AT_ONCE) as pool:
        for part in level_parts(encoded, estimator):
            written.append(pool.submit(part.write().save, f"{folder}/{len(parts)}"))
            parts.append(part)
        for done in written:
            done.result()
    stored = [f"{folder}/{i}" for i in range(len(parts))]
    if len(parts) == 1:
        return remember(parts[0], stored, trees_of(parts[0]))
    trees = [t for part in parts for t in part._java_obj.trees()]
    context = encoded.sparkSession.sparkContext
    ml = context._jvm.org.apache.spark.ml.classification
    array = context._gateway.new_array(ml.DecisionTreeClassificationModel, len(trees))
    for i, tree in enumerate(trees):
        array[i] = tree
    # Spark ML has no public way to put trees together.
    whole = ml.RandomForestClassificationModel(parts[0].uid, array, parts[0].numFeatures, parts[0].numClasses)
    return remember(estimator._copyValues(RandomForestClassificationModel(whole)), stored, trees_of(parts[0]))


BOOSTED_ROWS = 2_000_000  # of more, one task takes longer than Spark ML's jobs


def fit_boosting(encoded: DataFrame, estimator: GBTClassifier) -> GBTClassificationModel:
    """Trees one after the other: in one task, which saves a job a level, or of very many rows by Spark ML."""
    codes = codes_of(encoded, estimator)
    if codes is None or codes.rows > BOOSTED_ROWS:
        return estimator.fit(encoded)
    spark, folder = encoded.sparkSession, new_folder(encoded.sparkSession, "boosting")
    rounds, step = estimator.getMaxIter(), estimator.getStepSize()
    nodes = grow.boosted(encoded, estimator.getLabelCol(), codes, rounds, step, estimator.getMaxDepth(), estimator.getMinInstancesPerNode())
    nodes.select("treeID", "nodeData").write.parquet(f"{folder}/data")

    def about(kind: str, uid: str, params: dict, **more) -> str:
        return json.dumps({
            "class": f"org.apache.spark.ml.{kind}", "timestamp": int(time.time() * 1000), "sparkVersion": spark.version, "uid": uid,
            "paramMap": params, "defaultParamMap": {}, **more})

    trees = [(i, about("regression.DecisionTreeRegressionModel", f"{estimator.uid}_{i}", {"impurity": "variance"}), step if i else 1.0) for i in range(rounds)]
    spark.createDataFrame(trees, "_1 int, _2 string, _3 double").coalesce(1).write.parquet(f"{folder}/treesMetadata")
    given = {p.name: v for p, v in estimator.extractParamMap().items() if estimator.isSet(p)} | {"impurity": "variance"}
    whole = about("classification.GBTClassificationModel", estimator.uid, given, numFeatures=codes.width, numTrees=rounds)
    spark.createDataFrame([(whole,)], "value string").coalesce(1).write.text(f"{folder}/metadata")
    return remember(GBTClassificationModel.load(folder), [folder], rounds)


def forest_importances(encoded: DataFrame, estimator: RandomForestClassifier) -> list[float]:
    """The forest's importances without keeping the forest: each tree with a split counts alike."""
    found = grown_nodes(encoded, estimator)
    if found is not None:
        return mean_importances(*found)
    total = 0.0
    for part in level_parts(encoded, estimator):
        grown = sum(tree.numNodes() > 1 for tree in part._java_obj.trees())
        total = total + grown * part.featureImportances.toArray()
    return (total / max(float(np.sum(total)), TINY_SUM)).tolist()


ROWS_IN_PART = 10_000  # fewer rows are not worth a task of their own in the thousands of short jobs of a fit


def spread(df: DataFrame, rows: int) -> DataFrame:
    """The rows written once and dealt evenly, over all cores or shuffle partitions when there are enough of them:
    iterative fits read them again and again."""
    spark = df.sparkSession
    shared_folder(spark)
    most = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return materialize(df.repartition(max(1, min(most, -(-rows // ROWS_IN_PART)))))


def bounded(df: DataFrame, rows: int, most: int | None) -> DataFrame:
    """About ``most`` of so many rows: those with the smallest hashes of all their columns, the same share of every class."""
    if most is None or rows <= most:
        return df
    share = int(most / rows * (1 << 32))
    return df.where(F.pmod(F.xxhash64(*df.columns), F.lit(1 << 32)) < share)


def fit_encoder(df: DataFrame, features: Features) -> PipelineModel:
    """Learn the category levels, once for all models with the same features."""
    return Pipeline(stages=feature_stages(features)).fit(prepared(df, features))


def encode(df: DataFrame, features: Features, encoder: PipelineModel, label: str, counts: dict[int, int]) -> DataFrame:
    """Label, weight and feature vector."""
    rows = prepared(df, features, [label]).withColumn(WEIGHT, balanced_weight(label, counts))
    return encoder.transform(rows).select(label, WEIGHT, "features")


def fit_on(encoded: DataFrame, encoder: PipelineModel, estimator: Estimator) -> PipelineModel:
    fits = {RandomForestClassifier: fit_forest, GBTClassifier: fit_boosting}
    fitted: Model = fits.get(type(estimator), lambda rows, e: e.fit(rows))(encoded, estimator)
    return PipelineModel(stages=[*encoder.stages, fitted])


def fit(df: DataFrame, features: Features, estimator: Estimator, label: str, counts: dict[int, int]) -> PipelineModel:
    """Fit the feature stages and the estimator on labelled rows."""
    encoder = fit_encoder(df, features)
    return fit_on(spread(encode(df, features, encoder, label, counts), sum(counts.values())), encoder, estimator)


def dealt(df: DataFrame, models: list[PipelineModel]) -> DataFrame:
    """One task a core before a forest sees the rows: it takes longer than a shuffle, and stored rows of one period may be a
    single file; but every task reads the forest for itself, so more tasks cost more."""
    if not any(isinstance(m.stages[-1], RandomForestClassificationModel | GrownForest) for m in models):
        return df
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism)


def probability_of(model: PipelineModel, df: DataFrame, features: Features, keep: list[str], name: str, deal: bool = True) -> DataFrame:
    """The kept columns and the probability of class 1."""
    # Kept columns travel under other names, so that they may also be features.
    held = {c: f"_keep_{c}" for c in keep}
    rows = prepared(df.withColumns({h: F.col(c) for c, h in held.items()}), features, list(held.values()))
    rows = dealt(rows, [model]) if deal else rows
    last = model.stages[-1]
    if packs(last):
        scored, probability = PipelineModel(stages=model.stages[:-1]).transform(rows), forest_probability(last, "features")
    else:
        scored, probability = model.transform(rows), vector_to_array("probability")[1]
    return scored.select(*[F.col(h).alias(c) for c, h in held.items()], probability.alias(name))


def baseline_probability(df: DataFrame, level: str) -> Column:
    """The rule as a score: 1 when the level is low; an unknown or absent level counts as not low."""
    low = baseline_predict(F.col(level).cast("double")) if level in df.columns else F.lit(0)
    return low.cast("double")


def score_frame(bundle: Bundle, df: DataFrame, keep: list[str], level: str = "defasagem",
                probability: str = fixed.PROBABILITY, prediction: str = fixed.PREDICTION) -> DataFrame:
    """Kept columns, decision, probability, threshold, model and strategy."""
    if bundle.kind == "baseline":
        scored = df.select(*keep, baseline_probability(df, level).alias(probability))
    else:
        scored = probability_of(bundle.model, df, bundle.features, keep, probability)
    return scored.select(
        *keep, decide(probability, bundle.threshold).alias(prediction), probability,
        F.lit(bundle.threshold).alias("threshold"), F.lit(bundle.model_name).alias(fixed.MODEL_USED),
        F.lit(bundle.strategy).alias(fixed.STRATEGY_USED),
    )


def score_all(bundles: list[Bundle], df: DataFrame, keep: list[str], level: str = "defasagem") -> DataFrame:
    """The batch scored by every bundle, one row per batch row and model, in a single pass over the batch."""
    wanted = {*keep, level, *[c for b in bundles for c in b.features.columns]}
    scored = dealt(df.select(*[c for c in df.columns if c in wanted]), [b.model for b in bundles if b.kind != "baseline"])
    for i, b in enumerate(bundles):
        name = f"_probability_{i}"
        if b.kind == "baseline":
            scored = scored.withColumn(name, baseline_probability(scored, level))
        else:
            scored = probability_of(b.model, scored, b.features, scored.columns, name, deal=False)
    per_model = F.array(*[
        F.struct(
            F.col(f"_probability_{i}").alias(fixed.PROBABILITY), F.lit(b.threshold).alias("threshold"),
            F.lit(b.model_name).alias(fixed.MODEL_USED), F.lit(b.strategy).alias(fixed.STRATEGY_USED),
            F.lit(b.model_id).alias("model_id"),
        )
        for i, b in enumerate(bundles)
    ])
    rows = scored.select(*keep, F.inline(per_model))
    return rows.withColumn(fixed.PREDICTION, (F.col(fixed.PROBABILITY) >= F.col("threshold")).cast("int"))


def encoded_names(model: PipelineModel, features: Features, df: DataFrame) -> list[str]:
    """Names of the encoded columns in order, through the assembler's attributes."""
    return names_by(PipelineModel(model.stages[:-1]), features, df)


def names_by(encoder: PipelineModel, features: Features, df: DataFrame) -> list[str]:
    """The same from the feature stages alone."""
    attributes = encoder.transform(prepared(df, features)).schema["features"].metadata
    encoded = {f"{c}_hot_": f"{c}_" for c in sorted(features.text, key=len, reverse=True)}

    def plain(name: str) -> str:
        for prefix, short in encoded.items():
            if name.startswith(prefix):
                return short + name[len(prefix):]
        return name.removesuffix("_filled")

    listed = [a for kind in attributes["ml_attr"]["attrs"].values() for a in kind]
    return [plain(a["name"]) for a in sorted(listed, key=lambda a: a["idx"])]


def studied_importances(df: DataFrame, features: Features, estimator: RandomForestClassifier, label: str, counts: dict[int, int]) -> DataFrame:
    """Importance per encoded column of a forest that is not kept."""
    encoder = fit_encoder(df, features)
    encoded = spread(encode(df, features, encoder, label, counts), sum(counts.values()))
    rows = list(zip(names_by(encoder, features, df), forest_importances(encoded, estimator), strict=True))
    return df.sparkSession.createDataFrame(rows, "name string, importance double")


def encoded_importances(model: PipelineModel, features: Features, df: DataFrame) -> DataFrame:
    """Importance per encoded column of a fitted forest."""
    rows = list(zip(encoded_names(model, features, df), model.stages[-1].featureImportances.toArray().tolist(), strict=True))
    return df.sparkSession.createDataFrame(rows, "name string, importance double")
