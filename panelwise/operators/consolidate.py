"""Keys, duplicates, new rows and the state of the consolidated table."""

from pyspark.sql import DataFrame, functions as F

from panelwise import fixed
from panelwise.functions.text import finite_or_null
from panelwise.operators.ranking import first_per_key


def clean_keys(df: DataFrame, entity: str = "ra", period: str = "ano_referencia") -> DataFrame:
    """Entity as text, period as whole number, rows without either dropped."""
    keyed = df.withColumns({entity: F.col(entity).cast("string"), period: F.col(period).try_cast("int")})
    return keyed.where(F.col(entity).isNotNull() & F.col(period).isNotNull())


def new_rows(incoming: DataFrame, existing: DataFrame, keys: list[str] = fixed.KEY) -> DataFrame:
    """Incoming rows whose key is not stored."""
    return incoming.join(existing.select(*keys), list(keys), "left_anti")


def existing_keys(incoming: DataFrame, existing: DataFrame, keys: list[str] = fixed.KEY) -> DataFrame:
    """Incoming rows whose key is stored."""
    return incoming.join(existing.select(*keys), list(keys), "left_semi")


def to_insert(
    incoming: DataFrame, existing: DataFrame, entity: str = "ra", period: str = "ano_referencia",
    order: list[str] = ("source_file", "source_row_number"),
) -> DataFrame:
    """Rows to add: clean keys, the first of each key, not stored yet.

    Duplicates go first: after that every key is unique and the anti join cannot be skewed.
    """
    unique = first_per_key(clean_keys(incoming, entity, period), [entity, period], list(order))
    return new_rows(unique, existing, [entity, period])


def ingest_summary(incoming: DataFrame, inserted: DataFrame, by: list[str] = ()) -> DataFrame:
    """Input, inserted and duplicate rows; rows without a key count as duplicates."""
    tagged = incoming.select(*by, F.lit(1).alias("_in"), F.lit(0).alias("_new")).unionByName(
        inserted.select(*by, F.lit(0).alias("_in"), F.lit(1).alias("_new"))
    )
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return tagged.groupBy(*by).agg(total("_in").alias("input_rows"), total("_new").alias("inserted_rows")).withColumn(
        "duplicate_rows", F.col("input_rows") - F.col("inserted_rows")
    )


def data_version(runs: DataFrame, records: DataFrame, run_id: str = "id") -> DataFrame:
    """``v<last ingestion>-r<rows>``, zero for what does not exist yet."""
    both = runs.select(F.col(run_id).cast("long").alias("last"), F.lit(0).alias("row")).unionByName(
        records.select(F.lit(None).cast("long").alias("last"), F.lit(1).alias("row"))
    )
    part = lambda prefix, value: F.concat(F.lit(prefix), F.coalesce(value, F.lit(0)).cast("string"))
    return both.agg(F.concat(part("v", F.max("last")), F.lit("-"), part("r", F.sum("row"))).alias("data_version"))


def data_status(df: DataFrame, entity: str = "ra", period: str = "ano_referencia") -> DataFrame:
    """Rows, distinct entities and sorted periods.

    Counted per entity and period first, so the exact distinct count is a plain two-step aggregate.
    """
    pairs = df.groupBy(entity, period).agg(F.count("*").alias("_rows"))
    return pairs.agg(
        F.coalesce(F.sum("_rows"), F.lit(0)).alias("rows"),
        F.countDistinct(entity).alias("entities"),
        F.array_sort(F.collect_set(period)).alias("periods"),
    )


def sanitize(df: DataFrame) -> DataFrame:
    """NaN in floating columns becomes null."""
    floats = [name for name, kind in df.dtypes if kind in ("double", "float")]
    return df.withColumns({c: finite_or_null(c) for c in floats})
