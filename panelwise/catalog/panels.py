"""Next period, joins, metrics, windows and orders on the customer panel."""

from pyspark.sql import functions as F

from panelwise import fixed
from panelwise.catalog.base import (
    FULL_PANEL, LABELLED, LABELLED_FULL, PANEL, full_panel, labelled, labelled_full, order_panel, query, rounded, table,
)
from panelwise.functions import risk, text
from panelwise.operators import consolidate, metrics, ranking
from panelwise.operators.models import class_weights
from panelwise.operators.panel import next_value, temporal_split, with_next_period
from panelwise.operators.running import row_numbers
from panelwise.plans.evaluate import join_actuals, outcome_counts, weighted_metrics
from panelwise.plans.train import baseline_metrics

METRICS = ("f2", "recall", "precision", "pr_auc", "roc_auc", "brier")

# Ranking metrics in SQL over a table of labels and scores per group.
RANKED = """
d AS (SELECT grp, score, sum(target) AS pos, sum(1 - target) AS neg FROM scored GROUP BY grp, score),
c AS (SELECT *, sum(pos) OVER w AS cum_pos, sum(neg) OVER w AS cum_neg FROM d
      WINDOW w AS (PARTITION BY grp ORDER BY score DESC ROWS UNBOUNDED PRECEDING)),
ranking AS (
  SELECT grp, CASE WHEN sum(pos) > 0 AND sum(neg) > 0 THEN sum(pos * cum_pos / (cum_pos + cum_neg)) / sum(pos) END AS pr_auc,
    CASE WHEN sum(pos) > 0 AND sum(neg) > 0 THEN sum(neg * (cum_pos - pos / 2.0)) / (CAST(sum(pos) AS DOUBLE) * sum(neg)) END AS roc_auc
  FROM c GROUP BY grp)
"""
CONFUSION = """
confusion AS (
  SELECT grp, count(*) AS rows, count(*) FILTER (target = 1 AND pred = 1) AS tp, count(*) FILTER (target = 0 AND pred = 1) AS fp,
    count(*) FILTER (target = 1 AND pred = 0) AS fn, count(*) FILTER (target = 0 AND pred = 0) AS tn,
    avg((score - target) * (score - target)) AS brier FROM scored GROUP BY grp),
decided AS (
  SELECT *, CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp / CAST(tp + fp AS DOUBLE) END AS precision,
    CASE WHEN tp + fn = 0 THEN 0.0 ELSE tp / CAST(tp + fn AS DOUBLE) END AS recall,
    CASE WHEN tp = 0 THEN 0.0 ELSE 5.0 * tp / (5 * tp + 4 * fn + fp) END AS f2 FROM confusion)
"""


def with_rule(df):
    ruled = df.withColumn("pred", risk.baseline_predict("level"))
    return ruled.withColumn("score", F.col("pred").cast("double"))


@query("rule_metrics_by_period", f"""
WITH {LABELLED}, scored AS (SELECT period AS grp, target, CASE WHEN level < 0 THEN 1 ELSE 0 END AS pred,
  CASE WHEN level < 0 THEN 1.0 ELSE 0.0 END AS score FROM labelled), {RANKED}, {CONFUSION}
SELECT grp AS period, rows, tp, fp, fn, tn, round(f2, 6) AS f2, round(recall, 6) AS recall, round(precision, 6) AS precision,
  round(pr_auc, 6) AS pr_auc, round(roc_auc, 6) AS roc_auc, round(brier, 6) AS brier FROM decided JOIN ranking USING (grp)
""")
def rule_metrics(spark, folder):
    return rounded(baseline_metrics(labelled(spark, folder), "level", "target", ["period"]), *METRICS)


# --- joins -------------------------------------------------------------------
@query("j1_next_period_label", f"""
WITH {LABELLED} SELECT entity, period, round(level, 6) AS level, round(next_level, 6) AS next_level FROM labelled
""")
def j1(spark, folder):
    panel = order_panel(spark, folder).select("entity", "period", "level")
    return rounded(with_next_period(panel, "entity", "period", "level"), "level", "next_level")


@query("j1_daily_panel", """
WITH daily AS (SELECT user_id AS entity, CAST(datediff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS INTEGER) AS period, avg(value) AS level FROM events GROUP BY 1, 2)
SELECT p.entity, p.period, round(p.level, 6) AS level, round(n.level, 6) AS next_level FROM daily p JOIN daily n ON n.entity = p.entity AND n.period = p.period + 1
""")
def j1_daily(spark, folder):
    day = F.date_diff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date"))
    daily = table(spark, folder, "events").groupBy(F.col("user_id").alias("entity"), day.alias("period")).agg(
        F.avg("value").alias("level")
    )
    return rounded(with_next_period(daily, "entity", "period", "level"), "level", "next_level")


@query("w5_next_value", f"""
WITH {PANEL} SELECT p.entity, p.period, round(p.level, 6) AS level, round(n.level, 6) AS next_level
FROM panel p LEFT JOIN panel n ON n.entity = p.entity AND n.period = p.period + 1
""")
def w5(spark, folder):
    panel = order_panel(spark, folder).select("entity", "period", "level")
    return rounded(next_value(panel, "entity", "period", "level"), "level", "next_level")


def predictions_and_actuals(spark, folder):
    """Every order as a prediction for its customer and year, every order of the next year as an outcome.

    A few orders on both sides have no customer; they match each other within their years.
    """
    orders = table(spark, folder, "orders")
    price = F.col("o_totalprice")
    predictions = orders.select(
        "o_orderkey", F.struct(F.when(price < 495000, F.col("o_custkey")).alias("entity"), F.year("o_orderdate").alias("period")).alias("key"),
        (F.floor(price / 5000) / 100).alias(fixed.PROBABILITY),
    ).withColumn(fixed.PREDICTION, risk.decide(fixed.PROBABILITY))
    actual = orders.select(
        F.struct(F.when(price >= 6000, F.col("o_custkey")).alias("entity"), (F.year("o_orderdate") - 1).alias("period")).alias("key"),
        risk.baseline_predict(price - 250000).alias(fixed.ACTUAL),
    )
    return predictions, actual


PAIRS = """
predictions AS (SELECT o_orderkey, CASE WHEN o_totalprice < 495000 THEN o_custkey END AS entity, year(o_orderdate) AS period, floor(o_totalprice / 5000) / 100 AS score FROM orders),
actual AS (SELECT CASE WHEN o_totalprice >= 6000 THEN o_custkey END AS entity, year(o_orderdate) - 1 AS period, CASE WHEN o_totalprice < 250000 THEN 1 ELSE 0 END AS target FROM orders)
"""


@query("j2_join_actuals", f"""
WITH {PAIRS} SELECT o_orderkey, p.entity, CAST(p.period AS INTEGER) AS period, target AS real_risco_defasagem, (score >= 0.5) = (target = 1) AS acerto
FROM predictions p JOIN actual a ON p.entity IS NOT DISTINCT FROM a.entity AND p.period = a.period
""")
def j2(spark, folder):
    joined = join_actuals(*predictions_and_actuals(spark, folder), "key")
    return joined.select("o_orderkey", "key.entity", "key.period", fixed.ACTUAL, fixed.HIT)


@query("j2_pair_metrics", f"""
WITH {PAIRS}, scored AS (SELECT 1 AS grp, target, CASE WHEN score >= 0.5 THEN 1 ELSE 0 END AS pred, score
  FROM predictions p JOIN actual a ON p.entity IS NOT DISTINCT FROM a.entity AND p.period = a.period), {RANKED}, {CONFUSION}
SELECT rows, tp, fp, fn, tn, round(f2, 6) AS f2, round(recall, 6) AS recall, round(precision, 6) AS precision,
  round(pr_auc, 6) AS pr_auc, round(roc_auc, 6) AS roc_auc, round(brier, 6) AS brier FROM decided JOIN ranking USING (grp)
""")
def j2_metrics(spark, folder):
    predictions, actual = predictions_and_actuals(spark, folder)
    return rounded(weighted_metrics(predictions, outcome_counts(actual, "key"), "key", []), *METRICS)


def panel_keys(spark, folder):
    return table(spark, folder, "orders").select(
        "o_orderkey", F.col("o_custkey").alias("entity"), F.year("o_orderdate").alias("period")
    )


@query("j3_new_rows", """
WITH keys AS (SELECT o_orderkey, o_custkey AS entity, CAST(year(o_orderdate) AS INTEGER) AS period FROM orders),
firsts AS (SELECT entity, period, min(o_orderkey) AS o_orderkey FROM keys GROUP BY entity, period)
SELECT CAST(entity AS VARCHAR) AS entity, period, o_orderkey FROM firsts f
WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = f.entity AND CAST(year(o_orderdate) AS INTEGER) = f.period AND o_orderpriority = '1-URGENT')
""")
def j3(spark, folder):
    urgent = table(spark, folder, "orders").where("o_orderpriority = '1-URGENT'").select(
        F.col("o_custkey").cast("string").alias("entity"), F.year("o_orderdate").alias("period")
    )
    added = consolidate.to_insert(panel_keys(spark, folder), urgent, "entity", "period", ["o_orderkey"])
    return added.select("entity", "period", "o_orderkey")


@query("j4_existing_keys", """
SELECT o_orderkey, o_custkey AS entity, CAST(year(o_orderdate) AS INTEGER) AS period FROM orders o WHERE EXISTS (
  SELECT 1 FROM orders u WHERE u.o_custkey = o.o_custkey AND year(u.o_orderdate) = year(o.o_orderdate) AND u.o_orderpriority = '1-URGENT')
""")
def j4(spark, folder):
    urgent = table(spark, folder, "orders").where("o_orderpriority = '1-URGENT'").select(
        F.col("o_custkey").alias("entity"), F.year("o_orderdate").alias("period")
    )
    return consolidate.existing_keys(panel_keys(spark, folder), urgent, ["entity", "period"]).select("o_orderkey", "entity", "period")


# --- metrics -----------------------------------------------------------------
@query("a8_binary_metrics", """
WITH scored AS (SELECT lang AS grp, toxic AS target, CASE WHEN quality = 0 THEN 1 ELSE 0 END AS pred FROM labels JOIN documents USING (doc_id)),
confusion AS (SELECT grp, count(*) FILTER (target = 1 AND pred = 1) AS tp, count(*) FILTER (target = 0 AND pred = 1) AS fp,
  count(*) FILTER (target = 1 AND pred = 0) AS fn, count(*) FILTER (target = 0 AND pred = 0) AS tn FROM scored GROUP BY grp)
SELECT grp AS lang, tp, fp, fn, tn, round(CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp / CAST(tp + fp AS DOUBLE) END, 6) AS precision,
  round(CASE WHEN tp + fn = 0 THEN 0.0 ELSE tp / CAST(tp + fn AS DOUBLE) END, 6) AS recall,
  round(CASE WHEN tp = 0 THEN 0.0 ELSE 5.0 * tp / (5 * tp + 4 * fn + fp) END, 6) AS f2 FROM confusion
""")
def a8(spark, folder):
    languages = table(spark, folder, "documents").select("doc_id", "lang")
    rows = table(spark, folder, "labels").join(languages, "doc_id").withColumn("pred", (F.col("quality") == 0).cast("int"))
    return rounded(metrics.binary_metrics(rows, "toxic", "pred", ["lang"]), "precision", "recall", "f2")


@query("a9_brier", f"""
WITH {LABELLED} SELECT period, round(avg((rule_score - target) * (rule_score - target)), 6) AS brier FROM labelled GROUP BY period
""")
def a9(spark, folder):
    rows = labelled(spark, folder).withColumn("pred", risk.decide("rule_score"))
    return rounded(metrics.binary_metrics(rows, "target", "pred", ["period"], "rule_score").select("period", "brier"), "brier")


RULE_SCORED = f"{LABELLED}, scored AS (SELECT period AS grp, target, rule_score AS score FROM labelled)"
PRICE_SCORED = "scored AS (SELECT year(o_orderdate) AS grp, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS target, o_totalprice AS score FROM orders)"


def priced_orders(spark, folder):
    return table(spark, folder, "orders").select(
        F.year("o_orderdate").alias("period"), (F.col("o_orderstatus") == "F").cast("int").alias("target"),
        F.col("o_totalprice").alias("score"),
    )


@query("a10_average_precision", f"WITH {RULE_SCORED}, {RANKED} SELECT grp AS period, round(pr_auc, 6) AS pr_auc FROM ranking")
def a10(spark, folder):
    return rounded(metrics.average_precision(labelled(spark, folder), "target", "rule_score", ["period"]), "pr_auc")


@query("a10_average_precision_distinct", f"""
WITH {PRICE_SCORED}, {RANKED} SELECT CAST(grp AS INTEGER) AS period, round(pr_auc, 6) AS pr_auc FROM ranking
""")
def a10_distinct(spark, folder):
    return rounded(metrics.average_precision(priced_orders(spark, folder), "target", "score", ["period"]), "pr_auc")


@query("a11_roc_auc", f"WITH {RULE_SCORED}, {RANKED} SELECT grp AS period, round(roc_auc, 6) AS roc_auc FROM ranking")
def a11(spark, folder):
    return rounded(metrics.roc_auc(labelled(spark, folder), "target", "rule_score", ["period"]), "roc_auc")


@query("a11_roc_auc_overall", """
WITH scored AS (SELECT 1 AS grp, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS target, l_extendedprice AS score FROM lineitem), """ + RANKED + """
SELECT round(roc_auc, 6) AS roc_auc FROM ranking
""")
def a11_overall(spark, folder):
    rows = table(spark, folder, "lineitem").select(
        (F.col("l_returnflag") == "R").cast("int").alias("target"), F.col("l_extendedprice").alias("score")
    )
    return rounded(metrics.roc_auc(rows, "target", "score"), "roc_auc")


@query("w4_cumulative_counts", f"""
WITH {RULE_SCORED}, {RANKED} SELECT grp AS period, score, CAST(cum_pos AS BIGINT) AS cum_pos, CAST(cum_neg AS BIGINT) AS cum_neg FROM c
""")
def w4(spark, folder):
    counts = metrics.score_counts(labelled(spark, folder), ["period"], "target", "rule_score")
    return metrics.cumulative_counts(counts, ["period"]).select("period", "score", "cum_pos", "cum_neg")


@query("a7_class_guard", """
SELECT source, count(DISTINCT toxic) AS classes, count(*) AS rows, count(DISTINCT toxic) >= 2 AS usable
FROM labels JOIN documents USING (doc_id) GROUP BY source
""")
def a7(spark, folder):
    sources = table(spark, folder, "documents").select("doc_id", "source")
    return metrics.n_classes(table(spark, folder, "labels").join(sources, "doc_id"), "toxic", ["source"])


@query("a23_class_weights", f"""
WITH {LABELLED}, n AS (SELECT period, target, count(*) AS n FROM labelled GROUP BY period, target)
SELECT period, CAST(target AS INTEGER) AS target, n, round(CAST(sum(n) OVER (PARTITION BY period) AS DOUBLE) / (count(*) OVER (PARTITION BY period) * n), 6) AS weight FROM n
""")
def a23(spark, folder):
    return rounded(class_weights(labelled(spark, folder), "target", ["period"]), "weight")


# --- status, modes, shares, first rows ---------------------------------------
@query("a1_data_status", """
SELECT count(*) AS rows, count(DISTINCT o_custkey) AS entities, (SELECT string_agg(CAST(y AS VARCHAR), ',' ORDER BY y) FROM (SELECT DISTINCT year(o_orderdate) AS y FROM orders)) AS periods
FROM orders
""")
def a1(spark, folder):
    status = consolidate.data_status(panel_keys(spark, folder), "entity", "period")
    return status.withColumn("periods", F.array_join("periods", ","))


@query("a2_ingest_summary", """
SELECT CAST(year(o_orderdate) AS INTEGER) AS period, count(*) AS input_rows, count(DISTINCT CASE WHEN o_orderstatus <> 'P' THEN o_custkey END) AS inserted_rows,
  count(*) - count(DISTINCT CASE WHEN o_orderstatus <> 'P' THEN o_custkey END) AS duplicate_rows FROM orders GROUP BY 1
""")
def a2(spark, folder):
    incoming = table(spark, folder, "orders").select(
        "o_orderkey", F.when(F.col("o_orderstatus") != "P", F.col("o_custkey")).alias("entity"), F.year("o_orderdate").alias("period")
    )
    nothing = spark.createDataFrame([], "entity string, period int")
    inserted = consolidate.to_insert(incoming, nothing, "entity", "period", ["o_orderkey"])
    return consolidate.ingest_summary(incoming, inserted, ["period"])


@query("a6_mode", f"""
WITH {PANEL} SELECT entity, CAST(n_orders AS INTEGER) AS usual_orders FROM (
  SELECT entity, n_orders, row_number() OVER (PARTITION BY entity ORDER BY count(*) DESC, n_orders) AS r FROM panel GROUP BY entity, n_orders) WHERE r = 1
""")
def a6(spark, folder):
    rows = order_panel(spark, folder).select("entity", F.col("n_orders").cast("int").alias("usual_orders"))
    return ranking.mode_per_group(rows, ["entity"], "usual_orders")


@query("w1_row_numbers", """
SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS period, row_number() OVER (PARTITION BY year(o_orderdate) ORDER BY o_orderkey) AS row_number FROM orders
""")
def w1(spark, folder):
    return row_numbers(panel_keys(spark, folder).select("o_orderkey", "period"), ["period"], "o_orderkey")


@query("w2_first_per_key", """
SELECT o_custkey AS entity, CAST(year(o_orderdate) AS INTEGER) AS period, min(o_orderkey) AS o_orderkey FROM orders GROUP BY 1, 2
""")
def w2(spark, folder):
    return ranking.first_per_key(panel_keys(spark, folder), ["entity", "period"], ["o_orderkey"])


@query("w3_top_n_per_group", """
SELECT c_nationkey, c_custkey, c_acctbal, rank FROM (
  SELECT c_nationkey, c_custkey, c_acctbal, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS INTEGER) AS rank FROM customer)
WHERE rank <= 3
""")
def w3(spark, folder):
    rows = table(spark, folder, "customer").select("c_nationkey", "c_custkey", "c_acctbal")
    return ranking.top_n_per_group(rows, ["c_nationkey"], [F.col("c_acctbal").desc(), F.col("c_custkey")], 3)


@query("w6_share_within", """
SELECT o_orderstatus, o_orderpriority, count(*) AS n, round(count(*) / CAST(sum(count(*)) OVER (PARTITION BY o_orderstatus) AS DOUBLE), 6) AS share
FROM orders GROUP BY 1, 2
""")
def w6(spark, folder):
    counts = table(spark, folder, "orders").groupBy("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))
    return rounded(ranking.share_within(counts, ["o_orderstatus"], "n"), "share")


# --- orders and limits -------------------------------------------------------
@query("o1_order_panel", f"""
WITH {PANEL} SELECT period, entity, round(level, 6) AS level, row_number() OVER (ORDER BY period, entity) AS position FROM panel
""")
def o1(spark, folder):
    rows = ranking.number_panel(order_panel(spark, folder).select("period", "entity", "level"), "period", "entity")
    return rounded(ranking.order_panel(rows, "period", "entity"), "level")


@query("o8_preview", f"WITH {PANEL} SELECT period, entity, round(level, 6) AS level FROM panel ORDER BY period, entity LIMIT 10")
def o8(spark, folder):
    panel = order_panel(spark, folder).select("period", "entity", "level")
    return rounded(ranking.preview(panel, 10, "period", "entity"), "level")


@query("o9_priority_list", f"""
WITH {PANEL}, scored AS (SELECT entity, period, CASE WHEN n_orders > 1 THEN rule_score END AS score FROM panel WHERE level >= 0)
SELECT *, row_number() OVER (ORDER BY score DESC NULLS LAST, entity, period) AS rank FROM scored
""")
def o9(spark, folder):
    rows = order_panel(spark, folder).withColumns({
        "state": risk.state_group("level"), "score": F.when(F.col("n_orders") > 1, F.col("rule_score")),
    })
    ranked = ranking.number_priorities(rows, "state", "score", "entity", "period", groups=3)  # low, not low, unknown
    return ranking.priority_list(ranked, "state", fixed.GROUP_OK, "score", "entity").select("entity", "period", "score", "rank")


@query("o11_sort_mixed", """
WITH cells AS (SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN format('{:,.2f}', c_acctbal)
    WHEN c_mktsegment = 'MACHINERY' THEN ' n/a ' WHEN c_mktsegment = 'HOUSEHOLD' THEN 'Ação ' || CAST(c_custkey AS VARCHAR) ELSE lower(c_name) END AS cell FROM customer),
keyed AS (SELECT c_custkey, CAST(CASE WHEN trim(cell) = 'n/a' THEN 2 WHEN cell LIKE '%#%' OR cell LIKE 'A%' THEN 1 ELSE 0 END AS INTEGER) AS kind,
  try_cast(replace(cell, ',', '') AS DOUBLE) AS number,
  CASE WHEN cell LIKE 'A%' THEN 'acao ' || lpad(CAST(CASE WHEN c_custkey = 0 THEN 0 ELSE length(CAST(c_custkey AS VARCHAR)) END AS VARCHAR), 9, '0') || CASE WHEN c_custkey = 0 THEN '' ELSE CAST(c_custkey AS VARCHAR) END
    WHEN cell LIKE '%#%' THEN 'customer#' || lpad(CAST(CASE WHEN c_custkey = 0 THEN 0 ELSE length(CAST(c_custkey AS VARCHAR)) END AS VARCHAR), 9, '0') || CASE WHEN c_custkey = 0 THEN '' ELSE CAST(c_custkey AS VARCHAR) END END AS sort_text
FROM cells)
SELECT *, row_number() OVER (ORDER BY kind, number, sort_text, c_custkey) AS rank,
  row_number() OVER (ORDER BY kind DESC, number DESC, sort_text DESC, c_custkey) AS reverse_rank FROM keyed
""")
def o11(spark, folder):
    segment = F.col("c_mktsegment")
    cell = (
        F.when(segment == "BUILDING", F.format_number("c_acctbal", 2)).when(segment == "MACHINERY", " n/a ")
        .when(segment == "HOUSEHOLD", F.concat(F.lit("Ação "), F.col("c_custkey").cast("string"))).otherwise(F.lower("c_name"))
    )
    rows = table(spark, folder, "customer").select("c_custkey", cell.alias("cell"))
    ranked = ranking.number_mixed(rows, "cell", "c_custkey")
    ranked = ranking.number_mixed(ranked, "cell", "c_custkey", ascending=False, name="reverse_rank")
    ordered = ranking.sort_mixed(ranked, "cell", "c_custkey")
    kind = text.sort_kind("cell")
    return ordered.select(
        "c_custkey", "rank", "reverse_rank", kind.alias("kind"), text.parse_number("cell", "heuristic").alias("number"),
        F.when(kind == 1, text.natural_key("cell")).alias("sort_text"),
    )


@query("a19_score_bins", f"""
WITH {PANEL}, s AS (SELECT CASE WHEN n_orders > 1 THEN rule_score END AS s FROM panel)
SELECT CAST(CASE WHEN s < 0.2 THEN 0 WHEN s < 0.4 THEN 1 WHEN s < 0.6 THEN 2 WHEN s < 0.8 THEN 3 ELSE 4 END AS INTEGER) AS bin, count(*) AS n
FROM s WHERE s IS NOT NULL GROUP BY 1
""")
def a19(spark, folder):
    rows = order_panel(spark, folder).select(F.when(F.col("n_orders") > 1, F.col("rule_score")).alias("s"))
    return ranking.score_bins(rows, "s")


@query("a20_batch_summary", f"""
WITH {PANEL}, s AS (SELECT CASE WHEN n_orders > 1 THEN rule_score END AS s, level FROM panel)
SELECT count(*) AS rows, round(avg(coalesce(s, 0)), 6) AS mean_probability, count(*) FILTER (s >= 0.8) AS high_priority,
  count(*) FILTER (level < 0) AS rows_ja_defasado, count(*) FILTER (level >= 0) AS rows_nao_defasado FROM s
""")
def a20(spark, folder):
    rows = order_panel(spark, folder).select(
        F.when(F.col("n_orders") > 1, F.col("rule_score")).alias("s"), risk.state_group("level").alias("state")
    )
    groups = [fixed.GROUP_LOW, fixed.GROUP_OK]
    return rounded(ranking.batch_summary(rows, "s", "state", groups, fixed.HIGH_PRIORITY), "mean_probability")


@query("u1_concat_frames", f"""
WITH {LABELLED_FULL} SELECT entity, period, segment FROM labelled WHERE period = (SELECT min(period) FROM labelled)
UNION ALL SELECT entity, period, segment FROM labelled WHERE period = (SELECT max(period) FROM labelled)
""")
def u1(spark, folder):
    first, last = temporal_split(labelled_full(spark, folder).select("entity", "period", "segment"), "period")
    return first.unionByName(last)


@query("m3_category_levels", f"""
WITH {FULL_PANEL} SELECT coalesce(segment, '<NA>') AS segment, count(*) AS n FROM full_panel GROUP BY 1
""")
def m3(spark, folder):
    return full_panel(spark, folder).groupBy(text.category("segment").alias("segment")).agg(F.count("*").alias("n"))
