"""Category levels as a table instead of a list in the driver, for columns of any number of levels.

The levels of all columns are numbered in one order by distributed positions and looked up by joins;
rows become sparse vectors. Nothing but the number of levels reaches the driver.
"""

from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, functions as F, types as T

from panelwise.frames import materialize, new_folder
from panelwise.operators.models import Features, fill_numbers, prepared
from panelwise.operators.running import Key, positions

SPARSE = 0  # the kind of a vector in its stored form: 0 sparse, 1 dense


def vocabulary(df: DataFrame, features: Features) -> DataFrame:
    """feature, level, index from 0: the columns in their order, the levels of each in alphabetic order.

    The same order as that of one-hot columns made from indexed levels.
    """
    place = {c: i for i, c in enumerate(features.text)}
    cells = F.inline(F.array(*[F.struct(F.lit(i).alias("place"), F.lit(c).alias("feature"), F.col(c).alias("level")) for c, i in place.items()]))
    levels = prepared(df, features).select(cells).distinct()
    numbered = positions(levels, [Key("place"), Key("level")], name="_n")
    return numbered.select("feature", "level", (F.col("_n") - 1).cast("int").alias("index"))


def with_indices(df: DataFrame, features: Features, levels: DataFrame) -> DataFrame:
    """Add ``_i<n>``, the index of each category's level, null for a level that is not in the vocabulary.

    One join a column: the vocabulary goes to all tasks when it turns out small, else both sides meet by level, where a
    very frequent level is a skewed key that is split at run time.
    """
    for n, c in enumerate(features.text):
        mine = levels.where(F.col("feature") == c).select(F.col("level").alias(c), F.col("index").alias(f"_i{n}"))
        df = df.join(mine, c, "left")
    return df


def stored_vector(size: int, indices: Column, values: Column) -> Column:
    """A sparse vector in the form in which vectors are stored."""
    return F.struct(F.lit(SPARSE).cast("tinyint").alias("type"), F.lit(size).alias("size"), indices.alias("indices"), values.alias("values"))


def encode_sparse(df: DataFrame, features: Features, levels: DataFrame, keep: list[str] = (), name: str = "features") -> DataFrame:
    """The kept columns and a sparse vector: a one for each known level, then the numbers, missing ones as -1.

    Unknown levels give no entry. The result is a written table, read again with vectors in place of their stored form.
    """
    width = levels.agg(F.count("*")).first()[0]
    rows = with_indices(fill_numbers(prepared(df, features, list(keep)), features), features, levels)
    known = F.array_sort(F.array_compact(F.array(*[F.col(f"_i{n}") for n in range(len(features.text))]))) if features.text else F.array().cast("array<int>")
    numbers = features.numbers
    indices = F.concat(known, F.array(*[F.lit(width + i) for i in range(len(numbers))])) if numbers else known
    values = F.concat(F.transform(known, lambda _: F.lit(1.0)), F.array(*[F.col(f"{c}_filled") for c in numbers])) if numbers else F.transform(known, lambda _: F.lit(1.0))
    encoded = rows.select(*keep, stored_vector(width + len(numbers), indices, values).alias(name))
    path = new_folder(df.sparkSession, "vectors")
    encoded.write.parquet(path)
    fields = [f for f in encoded.schema if f.name != name]
    return df.sparkSession.read.schema(T.StructType([*fields, T.StructField(name, VectorUDT())])).parquet(path)


def fit_sparse(df: DataFrame, features: Features, estimator, keep: list[str], levels: DataFrame | None = None):
    """A model on sparse vectors, and the vocabulary it goes with."""
    levels = materialize(vocabulary(df, features)) if levels is None else levels
    return estimator.fit(encode_sparse(df, features, levels, keep)), levels
