"""Fitted forests as stored nodes, and their probabilities a whole batch of rows at a time.

Spark ML's own scoring sends the forest as objects with every task and walks it row by
row. Here the nodes are read back as arrays (21 bytes a node), sent once to each executor, and all rows of an Arrow
batch go down a tree together: cells become the numbers of their places among a column's thresholds first, so that a
step compares small numbers.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml import Model, PipelineModel
from pyspark.ml.classification import RandomForestClassificationModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from panelwise.frames import new_folder

STORED, PACKED = "_stored_nodes", "_packed_nodes"  # what a model's Python object remembers of itself
DENSE_FEATURES = 2_000  # wider vectors stay sparse and are scored by Spark ML


class GrownForest(Model, MLWritable, MLReadable):
    """A forest of two classes that is its stored nodes: nothing of it is in the driver but its place and its sizes.

    ``first`` and ``trees`` take some of the stored trees; a saved one stores only these.
    """

    numClasses = 2

    def __init__(self, folder: str = "", trees: int = 0, width: int = 0, first: int = 0):
        super().__init__()
        self.folder, self.trees, self.numFeatures, self.first = folder, trees, width, first

    @property
    def getNumTrees(self) -> int:
        return self.trees

    @property
    def treeWeights(self) -> list[float]:
        return [1.0] * self.trees

    @property
    def rows(self) -> DataFrame:
        """The stored rows of its trees, numbered from 0."""
        stored = SparkSession.active().read.parquet(f"{self.folder}/data")
        mine = stored.where(F.col("treeID").between(self.first, self.first + self.trees - 1))
        return mine.withColumn("treeID", F.col("treeID") - self.first)

    @property
    def featureImportances(self) -> DenseVector:
        """Each tree's importances sum to 1 and were stored with it; trees with a split count alike."""
        return DenseVector(mean_importances(self.rows, self.numFeatures))

    def parts(self, each: int) -> "Iterator[GrownForest]":
        """The forest as smaller ones, in order."""
        for at in range(0, self.trees, each):
            yield GrownForest(self.folder, min(each, self.trees - at), self.numFeatures, self.first + at)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        scored = dataset.withColumn("_share", forest_probability(self, "features"))
        both = lambda times: array_to_vector(F.array((1 - F.col("_share")) * times, F.col("_share") * times))
        return scored.withColumns({
            "rawPrediction": both(float(self.trees)), "probability": both(1.0), "prediction": (F.col("_share") > 0.5).cast("double"),
        }).drop("_share")

    def write(self) -> MLWriter:
        return GrownForestWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return GrownForestReader()


class GrownForestWriter(MLWriter):
    def __init__(self, forest: GrownForest):
        super().__init__()
        self.forest = forest

    def saveImpl(self, path: str) -> None:
        about = {"numFeatures": self.forest.numFeatures, "numTrees": self.forest.trees}
        self.forest.rows.write.parquet(f"{path}/data")
        DefaultParamsWriter.saveMetadata(self.forest, path, self.sparkSession, extraMetadata=about)


class GrownForestReader(MLReader):
    def load(self, path: str) -> GrownForest:
        about = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        return GrownForest(path, about["numTrees"], about["numFeatures"])._resetUid(about["uid"])


def mean_importances(rows: DataFrame, width: int) -> list[float]:
    """The trees' importances put together: one short list a tree."""
    total = np.zeros(width)
    for row in rows.where(F.col("importances").isNotNull()).select("treeID", "importances").orderBy("treeID").collect():
        total += row.importances
    return (total / max(float(total.sum()), TINY_SUM)).tolist()


TINY_SUM = 1e-300  # no tree has a split: all importances are zero


def trees_of(model: Model) -> int:
    """The trees there are; ``getNumTrees`` of a forest put together is a parameter's default."""
    return len(model.treeWeights)


def remember(model: Model, folders: list[str], trees_each: int) -> Model:
    """Where the model's nodes are stored: part i begins with tree ``i * trees_each``."""
    setattr(model, STORED, (folders, trees_each))
    return model


def remember_loaded(model: PipelineModel, path: str) -> PipelineModel:
    """A loaded forest's nodes are those it was loaded from."""
    last = len(model.stages) - 1
    if isinstance(model.stages[last], RandomForestClassificationModel):
        stage = f"{last:0{len(str(len(model.stages)))}d}_{model.stages[last].uid}"  # Spark ML's names of a pipeline's stages
        remember(model.stages[last], [f"{path}/stages/{stage}"], trees_of(model.stages[last]))
    return model


def stored_nodes(model: Model) -> DataFrame:
    """``tree`` and the stored columns of every node of a tree ensemble; written first where that was not done."""
    spark = SparkSession.active()
    if isinstance(model, GrownForest):
        return model.rows.select(F.col("treeID").alias("tree"), "nodeData.*")
    if not hasattr(model, STORED):
        folder = new_folder(spark, "nodes")
        model.write().save(folder)
        remember(model, [folder], trees_of(model))
    folders, each = getattr(model, STORED)
    schema = spark.read.parquet(f"{folders[0]}/data").schema
    parts = [
        spark.read.schema(schema).parquet(f"{folder}/data").select((F.col("treeID") + i * each).alias("tree"), "nodeData.*")
        for i, folder in enumerate(folders)
    ]
    nodes = parts[0]
    for part in parts[1:]:
        nodes = nodes.union(part)
    return nodes


def packed_nodes(model: Model) -> tuple[np.ndarray, ...]:
    """root of each tree; of each node the place of its column, how many of the column's thresholds are at most its own
    (0 in leaves), the children (right, left) and, in leaves, the share of class 1; the columns that split
    (``width + f`` is column f negated) and their thresholds.

    A leaf is its own right child, so that a row that has ended stays. Categories are the encoder's columns of zeros and
    ones, and one whose ones go left changes its sign.
    """
    split = F.col("split")
    share = F.element_at("impurityStats", 2) / F.aggregate("impurityStats", F.lit(0.0), lambda a, b: a + b)
    inner, binary = F.col("leftChild") >= 0, split["numCategories"] >= 0
    ones_left = binary & (split["leftCategoriesOrThreshold"][0] == 1)
    feature = split["featureIndex"] + F.when(ones_left, model.numFeatures).otherwise(0)
    threshold = F.when(ones_left, -0.5).when(binary, 0.5).otherwise(split["leftCategoriesOrThreshold"][0])
    got = stored_nodes(model).select(
        F.col("tree").cast("int").alias("tree"), F.col("id").cast("int").alias("id"), F.when(inner, feature).otherwise(-1).cast("int").alias("feature"),
        F.when(inner, threshold).otherwise(share).alias("threshold"), F.col("leftChild").cast("int").alias("left"), F.col("rightChild").cast("int").alias("right"),
        F.when(inner, split["numCategories"]).otherwise(-1).alias("categories"),
    ).toArrow()
    tree, number, feature, threshold, left, right, categories = (got.column(c).to_numpy() for c in got.column_names)
    if (categories > 2).any() or (left[feature >= 0] != number[feature >= 0] + 1).any():
        raise ValueError("not a forest over the encoder's columns")
    order = np.lexsort((number, tree))
    root = np.searchsorted(tree[order], np.arange(trees_of(model)))
    feature, threshold, right = feature[order], threshold[order], (right + root[tree])[order]
    places = np.arange(len(feature))
    children = np.stack([np.where(feature < 0, places, right), np.minimum(places + 1, len(places) - 1)], axis=1).astype(np.int32).ravel()
    used, cuts = np.unique(feature[feature >= 0]), []
    column, reached = np.zeros(len(feature), np.int32), np.zeros(len(feature), np.int32)
    for place, f in enumerate(used):
        of = feature == f
        cuts.append(np.unique(threshold[of]))
        column[of], reached[of] = place, np.searchsorted(cuts[-1], threshold[of]) + 1
    kind = np.uint8 if all(len(c) < 1 << 8 for c in cuts) else np.int32
    return root, column, reached.astype(kind), children, threshold, used, cuts


def forest_probability(model: Model, features: str) -> Column:
    """The forest's probability of class 1: the mean of the shares in the leaves that a row ends in."""
    if not hasattr(model, PACKED):
        setattr(model, PACKED, SparkSession.active().sparkContext.broadcast(packed_nodes(model)))
    packed, width = getattr(model, PACKED), model.numFeatures

    def mean_share(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        root, column, reached, children, share, used, cuts = packed.value
        for batch in batches:
            plain = batch.flatten().to_numpy(zero_copy_only=False).reshape(len(batch), width)
            code, total = np.empty((len(batch), max(1, len(used))), reached.dtype), np.zeros(len(batch))
            for i, (f, cut) in enumerate(zip(used, cuts, strict=True)):
                code[:, i] = np.searchsorted(cut, plain[:, f] if f < width else -plain[:, f - width])
            cells, begins = code.ravel(), np.arange(len(batch)) * code.shape[1]
            for first in root.tolist():
                row, start, node, step = np.arange(len(batch)), begins, np.full(len(batch), first, np.int32), 0
                while len(node):
                    most = reached.take(node)
                    if step % 4 == 0:  # rows that have ended stay where they are until then
                        ended = most == 0
                        if ended.any():
                            out, on = np.flatnonzero(ended), np.flatnonzero(~ended)
                            total[row.take(out)] += share.take(node.take(out))
                            row, start, node, most = row.take(on), start.take(on), node.take(on), most.take(on)
                    node = children.take(2 * node + (cells.take(start + column.take(node)) < most))
                    step += 1
            yield pa.array(total / len(root), pa.float64())

    return F.arrow_udf(mean_share, "double")(vector_to_array(features))


def packs(model: Model) -> bool:
    """Whether a model is a forest that is scored by its packed nodes."""
    is_forest = isinstance(model, RandomForestClassificationModel | GrownForest)
    return is_forest and model.numClasses == 2 and model.numFeatures <= DENSE_FEATURES
