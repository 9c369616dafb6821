"""Registered queries: the operators on a panel of customers and years, each with the SQL that must agree.

The panel's entity is the customer, its period the order year and its level the mean
order value above 250,000; low means below it.
"""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from panelwise.operators.panel import labelled_panel

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(function: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = function
        if sql is not None:
            SQL[name] = sql
        return function

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


# --- the panel ---------------------------------------------------------------
PRICES = ("n_orders", "avg_price", "min_price", "max_price")
KINDS = ("segment", "nation", "priority")


def order_panel(spark: SparkSession, folder: str) -> DataFrame:
    """One row per customer and year, from one partial and one final aggregate."""
    orders = table(spark, folder, "orders")
    price = F.col("o_totalprice")
    return orders.groupBy(F.col("o_custkey").alias("entity"), F.year("o_orderdate").alias("period")).agg(
        (F.avg(price) - 250000).alias("level"),
        F.count("*").cast("double").alias("n_orders"),
        F.avg(price).alias("avg_price"),
        F.min(price).alias("min_price"),
        F.max(price).alias("max_price"),
        (F.floor(F.avg(price) / 5000) / 100).alias("rule_score"),
    )


def customer_kinds(spark: SparkSession, folder: str) -> DataFrame:
    nations = table(spark, folder, "nation").select("n_nationkey", F.col("n_name").alias("nation"))
    customers = table(spark, folder, "customer").select(
        F.col("c_custkey").alias("entity"), F.col("c_mktsegment").alias("segment"), "c_nationkey"
    )
    return customers.join(nations, customers.c_nationkey == nations.n_nationkey, "left").select("entity", "segment", "nation")


def full_panel(spark: SparkSession, folder: str) -> DataFrame:
    """The panel with the customer's segment and nation and the year's usual order priority.

    Orders are read once: counted per priority first, then put together per customer and year.
    """
    price, n = F.col("o_totalprice"), F.col("n")
    by_priority = table(spark, folder, "orders").groupBy(
        F.col("o_custkey").alias("entity"), F.year("o_orderdate").alias("period"), F.col("o_orderpriority").alias("priority")
    ).agg(F.count("*").alias("n"), F.sum(price).alias("total"), F.min(price).alias("low"), F.max(price).alias("high"))
    mean = F.sum("total") / F.sum("n")
    panel = by_priority.groupBy("entity", "period").agg(
        (mean - 250000).alias("level"), F.sum("n").cast("double").alias("n_orders"), mean.alias("avg_price"),
        F.min("low").alias("min_price"), F.max("high").alias("max_price"), (F.floor(mean / 5000) / 100).alias("rule_score"),
        F.min(F.struct((-n).alias("n"), F.col("priority").alias("v")))["v"].alias("priority"),
    )
    return panel.join(customer_kinds(spark, folder), "entity", "left")


def labelled(spark: SparkSession, folder: str) -> DataFrame:
    return labelled_panel(order_panel(spark, folder), "entity", "period", "level")


def labelled_full(spark: SparkSession, folder: str) -> DataFrame:
    return labelled_panel(full_panel(spark, folder), "entity", "period", "level")


PANEL = """
orders_by_year AS (
  SELECT o_custkey AS entity, CAST(year(o_orderdate) AS INTEGER) AS period, o_totalprice AS price, o_orderpriority AS priority
  FROM orders),
panel AS (
  SELECT entity, period, avg(price) - 250000 AS level, CAST(count(*) AS DOUBLE) AS n_orders, avg(price) AS avg_price,
         min(price) AS min_price, max(price) AS max_price, floor(avg(price) / 5000) / 100 AS rule_score
  FROM orders_by_year GROUP BY entity, period)
"""
FULL_PANEL = PANEL + """,
usual AS (
  SELECT entity, period, priority FROM (
    SELECT entity, period, priority, row_number() OVER (PARTITION BY entity, period ORDER BY count(*) DESC, priority) AS r
    FROM orders_by_year GROUP BY entity, period, priority) WHERE r = 1),
full_panel AS (
  SELECT p.*, u.priority, c_mktsegment AS segment, n_name AS nation
  FROM panel p JOIN usual u USING (entity, period)
  LEFT JOIN customer ON c_custkey = p.entity LEFT JOIN nation ON n_nationkey = c_nationkey)
"""


def labelled_sql(source: str = "panel") -> str:
    return f"""
labelled AS (
  SELECT p.*, n.level AS next_level, CASE WHEN n.level < 0 THEN 1 ELSE 0 END AS target
  FROM {source} p JOIN {source} n ON n.entity = p.entity AND n.period = p.period + 1)
"""


LABELLED = PANEL + "," + labelled_sql()
LABELLED_FULL = FULL_PANEL + "," + labelled_sql("full_panel")
RULED = LABELLED_FULL + """,
ruled AS (
  SELECT *, CASE WHEN level < 0 THEN 1 ELSE 0 END AS baseline_pred,
    CASE WHEN level >= 0 AND target = 1 THEN 'false_negative' WHEN level < 0 AND target = 0 THEN 'false_positive'
         ELSE 'correct' END AS error_type
  FROM labelled)
"""
