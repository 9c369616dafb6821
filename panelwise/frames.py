"""Small DataFrame helpers shared by the operators."""

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors can reach: the one that ``spark.checkpoint.dir`` names.

    Only a local session without the setting, whose executors are the driver, gets one next to its warehouse.
    """
    folder = spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        configured = f"{spark.conf.get('spark.sql.warehouse.dir')}/_shared"
    spark.sparkContext.setCheckpointDir(configured)
    return spark.sparkContext.getCheckpointDir()


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, by: str | None = None) -> DataFrame:
    """Write an intermediate once as a table in the shared folder and cut its lineage there.

    Later readings prune columns, and folders when the table is divided ``by`` a column they filter on;
    a lost executor costs nothing that was computed before.
    """
    path = new_folder(df.sparkSession, "table")
    if by is None:
        df.write.parquet(path)
        return df.sparkSession.read.schema(df.schema).parquet(path)
    df.hint("rebalance", by).write.partitionBy(by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path).select(*df.columns)


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join in which null keys match each other; the right side's keys are dropped."""
    renamed = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    matches = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys])
    joined = left.join(renamed, matches, how)
    return joined if how in ("left_semi", "left_anti") else joined.drop(*[f"_r_{k}" for k in keys])


def heavy_keys(df: DataFrame, key: str, partitions: int) -> DataFrame:
    """``_heavy``: keys, null among them, that hold more than a quarter of an even partition's rows: four a partition at most."""
    counts = df.groupBy(F.col(key).alias("_heavy")).agg(F.count("*").alias("_n"))
    whole = counts.agg(F.coalesce(F.sum("_n"), F.lit(0))).scalar()
    return counts.where(F.col("_n") * (4 * partitions) > whole).select("_heavy")


def heavy_pairs(left: DataFrame, right: DataFrame, key: str, right_key: str, partitions: int) -> DataFrame:
    """``_heavy``: keys, null among them, that make more than a quarter of an even partition's matching pairs."""
    counted = lambda df, k: df.groupBy(F.col(k).alias("_heavy")).agg(F.count("*").cast("double").alias("_n"))
    both = null_safe_join(counted(left, key), counted(right, right_key).withColumnRenamed("_n", "_m"), ["_heavy"])
    pairs = materialize(both.select("_heavy", (F.col("_n") * F.col("_m")).alias("_pairs")))
    whole = pairs.agg(F.coalesce(F.sum("_pairs"), F.lit(0.0))).scalar()
    return pairs.where(F.col("_pairs") * (4 * partitions) > whole).select("_heavy")


def heavy_join(left: DataFrame, right: DataFrame, key: str, right_key: str, partitions: int | None = None) -> DataFrame:
    """Inner join in which null matches null and no key is one task's work, however many rows of ``left`` hold it.

    Keys are counted first. Those that are heavy in ``left``, or in the pairs they make, are dealt over all partitions by a
    hash of the whole row, and their rows of ``right`` go to each of them; all others are joined by hash. The rows of
    ``right`` that are repeated belong to at most eight keys a partition.
    """
    partitions = partitions or int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    heavy = heavy_keys(left, key, partitions).union(heavy_pairs(left, right, key, right_key, partitions)).distinct()
    known = F.broadcast(materialize(heavy.withColumn("_place", F.monotonically_increasing_id())))  # at most eight rows a partition
    split = lambda df, k, how: df.join(known, F.col(k).eqNullSafe(F.col("_heavy")), how)
    matches = F.col(key).eqNullSafe(F.col(right_key))
    rest = split(left, key, "left_anti").join(split(right, right_key, "left_anti"), matches)
    salt = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in left.columns]), F.lit(partitions))
    salted = split(left, key, "inner").select(*[F.col(f"`{c}`") for c in left.columns], (F.col("_place") * partitions + salt).alias("_deal"))
    copies = split(right, right_key, "inner").withColumn("_copy", F.explode(F.sequence(F.lit(0), F.lit(partitions - 1)))).select(
        *[F.col(f"`{c}`") for c in right.columns], (F.col("_place") * partitions + F.col("_copy")).alias("_copy"))
    # A stated number of partitions: few rows that make very many pairs must not be put together again by their bytes.
    salted, copies = salted.repartition(partitions, "_deal"), copies.repartition(partitions, "_copy")
    dealt = salted.join(copies, F.col("_deal") == F.col("_copy")).drop("_deal", "_copy")
    return rest.unionByName(dealt)


def unpivot(df: DataFrame, keep: list[str], columns: list[str], kind: str, name="feature", value="value") -> DataFrame:
    """Wide to long: one row per kept key and column, values cast to one type."""
    cast = df.select(*keep, *[F.col(c).cast(kind).alias(c) for c in columns])
    return cast.unpivot(keep, list(columns), name, value)


def literal_map(pairs: dict) -> Column:
    return F.create_map(*[F.lit(part) for pair in pairs.items() for part in pair])


# Up to this many rows (or array entries) of a few numbers each, a per-group table is sent to every task.
BROADCAST_ROWS = 1_000_000


def per_group(df: DataFrame, groups: int | None, each: int = 1) -> DataFrame:
    """A per-group table, marked for broadcast only when its size is known and small.

    ``groups`` is an upper bound on the groups, ``each`` on the entries per group. Without a known
    bound the join is left to the sizes Spark measures at run time.
    """
    return F.broadcast(df) if groups is not None and groups * each <= BROADCAST_ROWS else df
