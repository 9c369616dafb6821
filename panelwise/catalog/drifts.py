"""Drift between the earlier and the later years, and the residual study of the rule."""

from pyspark.sql import functions as F

from panelwise.catalog.base import (
    FULL_PANEL, RULED, customer_kinds, full_panel, labelled_full, order_panel, query, rounded, table,
)
from panelwise.frames import materialize
from panelwise.operators import drift, metrics, ranking, residuals
from panelwise.operators.normalize import union_all

NUMBERS = ["level", "n_orders", "min_price", "max_price"]
TEXTS = ["segment", "nation", "priority"]


def sides(spark, folder, rows):
    """Rows of the earlier and of the later years, cut in the middle of the years there are."""
    year = F.year("o_orderdate")
    middle = table(spark, folder, "orders").agg((F.min(year) + F.max(year)) / 2).scalar()
    return rows.where(F.col("period") <= middle), rows.where(F.col("period") > middle)


def two_sides(spark, folder, build=full_panel):
    return sides(spark, folder, build(spark, folder))


def price_sides(spark, folder):
    """All order prices: every value, not only the panel's means."""
    orders = table(spark, folder, "orders")
    return sides(spark, folder, orders.select(F.year("o_orderdate").alias("period"), F.col("o_totalprice").alias("price")))


# Long form of the panel's numbers, quantile edges of the earlier years, bins and shares, in SQL.
SIDE = """CASE WHEN period > (SELECT (min(year(o_orderdate)) + max(year(o_orderdate))) / 2.0 FROM orders) THEN 'later' ELSE 'earlier' END AS side"""
LONG = FULL_PANEL + f""",
long AS (
  SELECT feature, value, {SIDE} FROM full_panel UNPIVOT (value FOR feature IN (level, n_orders, min_price, max_price)))
"""
EDGES = """
quantiles AS (SELECT feature, unnest(quantile_cont(value, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0])) AS edge FROM long WHERE side = 'earlier' GROUP BY feature),
edges AS (SELECT feature, edge, row_number() OVER w AS i, lead(edge) OVER w AS upper, count(*) OVER (PARTITION BY feature) AS n
  FROM (SELECT DISTINCT feature, edge FROM quantiles) WINDOW w AS (PARTITION BY feature ORDER BY edge))
"""
BINNED = """
binned AS (
  SELECT e.feature, CAST(e.i - 1 AS INTEGER) AS bin, e.n, count(*) FILTER (side = 'earlier') AS r, count(*) FILTER (side = 'later') AS c
  FROM edges e JOIN long l ON l.feature = e.feature AND l.value >= e.edge AND (l.value < e.upper OR (e.i = e.n - 1 AND l.value <= e.upper))
  GROUP BY 1, 2, 3)
"""
PSI = """
shares AS (SELECT feature, greatest(r / CAST(sum(r) OVER w AS DOUBLE), 1e-6) AS rs, greatest(c / CAST(sum(c) OVER w AS DOUBLE), 1e-6) AS cs FROM binned
  WHERE n >= 3 WINDOW w AS (PARTITION BY feature)),
psi AS (SELECT feature, sum((cs - rs) * ln(cs / rs)) AS psi FROM shares GROUP BY feature)
"""
PRICE_LONG = f"""
long AS (SELECT feature, value, {SIDE} FROM (SELECT 'price' AS feature, o_totalprice AS value, year(o_orderdate) AS period FROM orders))
"""


@query("a13_quantile_edges", f"""
WITH {LONG}, {EDGES} SELECT feature, CAST(i - 1 AS INTEGER) AS position, round(edge, 4) AS edge FROM edges
""")
def a13(spark, folder):
    reference, current = two_sides(spark, folder, order_panel)
    counts = drift.value_counts(reference, current, NUMBERS, "double")
    edges = drift.quantile_edges(counts, features=len(NUMBERS)).select("feature", F.posexplode("edges").alias("position", "edge"))
    return rounded(edges, "edge", digits=4)


@query("a14_histogram", f"WITH {LONG}, {EDGES}, {BINNED} SELECT feature, bin, r, c FROM binned")
def a14(spark, folder):
    reference, current = two_sides(spark, folder, order_panel)
    counts = drift.value_counts(reference, current, NUMBERS, "double")
    return drift.histogram(counts, drift.quantile_edges(counts, features=len(NUMBERS))).select("feature", "bin", "r", "c")


@query("a15_psi", f"WITH {PRICE_LONG}, {EDGES}, {BINNED}, {PSI} SELECT feature, round(psi, 6) AS psi FROM psi")
def a15(spark, folder):
    counts = drift.value_counts(*price_sides(spark, folder), ["price"], "double")
    return rounded(drift.psi(counts, drift.quantile_edges(counts, features=len(NUMBERS))), "psi")


FLOAT_GRID = EDGES.replace(
    "[0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]",
    "[0e0, 1e-1, 2e-1, 3.0000000000000004e-1, 4e-1, 5e-1, 6.000000000000001e-1, 7.000000000000001e-1, 8e-1, 9e-1, 1e0]",
)


@query("a15_psi_float_grid", f"WITH {PRICE_LONG}, {FLOAT_GRID}, {BINNED}, {PSI} SELECT feature, round(psi, 6) AS psi FROM psi")
def a15_float(spark, folder):
    counts = drift.value_counts(*price_sides(spark, folder), ["price"], "double")
    return rounded(drift.psi(counts, drift.quantile_edges(counts, float_quantiles=True, features=1)), "psi")


@query("a15_psi_sketch_edges", f"""
WITH {PRICE_LONG} SELECT CAST(i AS INTEGER) AS position, true AS near, true AS psi_near, (SELECT count(*) FROM long WHERE side = 'earlier') AS reference_rows FROM range(0, 11) t(i)
""")
def a15_sketch(spark, folder):
    """Edges from merged sketches of the reference's years: each has a rank within a thousandth of the exact one, and the
    index made from the sketch alone is the exact one to two hundredths."""
    reference, current = price_sides(spark, folder)
    parts = union_all([drift.profile(reference.where(F.col("period") % 2 == side), ["price"], ()) for side in (0, 1)])
    kept = drift.merge_profiles(parts)
    edges = drift.profile_edges(kept).select(F.posexplode("edges").alias("position", "edge"))
    counts = drift.value_counts(reference, current, ["price"], "double")
    n = counts.agg(F.sum("r")).scalar()
    below = F.sum(F.when(F.col("value") < F.col("edge"), F.col("r")).otherwise(0)) / n
    upto = F.sum(F.when(F.col("value") <= F.col("edge"), F.col("r")).otherwise(0)) / n
    ranks = counts.join(F.broadcast(edges)).groupBy("position").agg(below.alias("below"), upto.alias("upto"))  # eleven edges
    wanted = F.col("position") / 10
    exact = drift.psi(counts, drift.quantile_edges(counts, features=1)).select("psi").scalar()
    sketched = drift.drift_from_profile(kept, current, ["price"], ()).select("psi").scalar()
    return ranks.select(
        "position", ((F.col("below") <= wanted + 0.001) & (F.col("upto") >= wanted - 0.001)).alias("near"),
        (F.abs(exact - sketched) <= 0.02).alias("psi_near"), kept.select("n").scalar().alias("reference_rows"))


NUMERIC = """
numeric AS (
  SELECT feature, avg(value) FILTER (side = 'earlier') AS reference_mean, avg(value) FILTER (side = 'later') AS current_mean FROM long GROUP BY feature),
numeric_rows AS (
  SELECT feature, 'numeric' AS type, round(reference_mean, 4) AS reference_mean, round(current_mean, 4) AS current_mean, round(psi, 6) AS psi,
    psi >= 0.2 OR abs(current_mean - reference_mean) >= greatest(abs(reference_mean) * 0.25, 0.5) AS alert
  FROM numeric JOIN psi USING (feature))
"""
CATEGORICAL = f"""
texts AS (SELECT feature, category, {SIDE} FROM full_panel UNPIVOT (category FOR feature IN (segment, nation, priority))),
kinds AS (SELECT feature, category, count(*) FILTER (side = 'earlier') AS r, count(*) FILTER (side = 'later') AS c FROM texts GROUP BY 1, 2),
sided AS (SELECT *, sum(r) OVER (PARTITION BY feature) AS ra, sum(c) OVER (PARTITION BY feature) AS ca,
  row_number() OVER (PARTITION BY feature ORDER BY r DESC, category) AS rr, row_number() OVER (PARTITION BY feature ORDER BY c DESC, category) AS cr FROM kinds),
measured AS (SELECT feature, max(category) FILTER (rr = 1) AS reference_top, max(category) FILTER (cr = 1) AS current_top,
  sum(abs(r / CAST(ra AS DOUBLE) - c / CAST(ca AS DOUBLE))) / 2 AS shift, coalesce(sum(c) FILTER (r = 0), 0) / CAST(any_value(ca) AS DOUBLE) AS unseen FROM sided GROUP BY feature),
categorical_rows AS (
  SELECT feature, 'categorical' AS type, reference_top, current_top, round(shift, 6) AS distribution_shift, round(unseen, 6) AS new_category_rate,
    shift >= 0.2 OR unseen >= 0.1 AS alert FROM measured)
"""


@query("a16_numeric_drift", f"WITH {LONG}, {EDGES}, {BINNED}, {PSI}, {NUMERIC} SELECT * FROM numeric_rows")
def a16(spark, folder):
    rows = drift.numeric_drift(*two_sides(spark, folder, order_panel), NUMBERS).drop("position")
    return rounded(rounded(rows, "psi"), "reference_mean", "current_mean", digits=4)


@query("a17_categorical_drift", f"WITH {FULL_PANEL}, {CATEGORICAL} SELECT * FROM categorical_rows")
def a17(spark, folder):
    rows = drift.categorical_drift(*two_sides(spark, folder), TEXTS).drop("position")
    return rounded(rows, "distribution_shift", "new_category_rate")


@query("j5_distribution_outer_join", """
WITH k AS (SELECT l_shipdate < TIMESTAMP '1996-01-01' AS early, p_brand AS category FROM lineitem JOIN part ON p_partkey = l_partkey),
n AS (SELECT category, count(*) FILTER (early) AS r, count(*) FILTER (NOT early) AS c FROM k GROUP BY category)
SELECT category, round(r / CAST(sum(r) OVER () AS DOUBLE), 6) AS reference_share, round(c / CAST(sum(c) OVER () AS DOUBLE), 6) AS current_share FROM n
""")
def j5(spark, folder):
    reference, current = shipped_brands(spark, folder)
    counts = drift.value_counts(reference, current, ["category"], "string")
    shares = ranking.share_within(counts, ["feature"], ["r", "c"], ["reference_share", "current_share"], groups=1)
    return rounded(shares.select(F.col("value").alias("category"), "reference_share", "current_share"), "reference_share", "current_share")


def shipped_brands(spark, folder):
    """Brands shipped before 1996, and since."""
    parts = table(spark, folder, "part").select("p_partkey", F.col("p_brand").alias("category"))
    lines = table(spark, folder, "lineitem").select("l_partkey", "l_shipdate")
    sold = lines.join(parts, F.col("l_partkey") == F.col("p_partkey"))
    early = F.col("l_shipdate") < F.lit("1996-01-01").cast("timestamp_ntz")
    return sold.where(early).select("category"), sold.where(~early).select("category")


@query("j6_unseen_rate", """
WITH k AS (SELECT l_shipdate < TIMESTAMP '1993-01-01' AS early, CAST(l_suppkey AS VARCHAR) || '/' || p_size AS category FROM lineitem JOIN part ON p_partkey = l_partkey),
known AS (SELECT DISTINCT category FROM k WHERE early)
SELECT 'category' AS feature, round(count(*) FILTER (known.category IS NULL) / CAST(count(*) AS DOUBLE), 6) AS new_category_rate FROM k LEFT JOIN known USING (category) WHERE NOT early
""")
def j6(spark, folder):
    """Lines since 1993 whose supplier and size had not met before, over all lines."""
    parts = table(spark, folder, "part").select("p_partkey", "p_size")
    lines = table(spark, folder, "lineitem").join(parts, F.col("l_partkey") == F.col("p_partkey"))
    sold = lines.select("l_shipdate", F.concat_ws("/", F.col("l_suppkey").cast("string"), F.col("p_size").cast("string")).alias("category"))
    early = F.col("l_shipdate") < F.lit("1993-01-01").cast("timestamp_ntz")
    rows = drift.categorical_drift(sold.where(early).select("category"), sold.where(~early).select("category"), ["category"])
    return rounded(rows.select("feature", "new_category_rate"), "new_category_rate")


@query("u2_all_categories", """
SELECT DISTINCT p_type AS category FROM part WHERE p_size < 10 UNION SELECT p_brand FROM part WHERE p_size >= 10
""")
def u2(spark, folder):
    part = table(spark, folder, "part")
    small = part.where("p_size < 10").select(F.col("p_type").alias("kind"))
    return drift.all_categories(small, part.where("p_size >= 10").select(F.col("p_brand").alias("kind")), "kind")


@query("a18_drift_report", f"""
WITH {LONG}, {EDGES}, {BINNED}, {PSI}, {NUMERIC}, {CATEGORICAL}
SELECT feature, type, reference_mean, current_mean, psi, NULL AS reference_top, NULL AS current_top, NULL AS distribution_shift, NULL AS new_category_rate, alert FROM numeric_rows
UNION ALL SELECT feature, type, NULL, NULL, NULL, reference_top, current_top, distribution_shift, new_category_rate, alert FROM categorical_rows
""")
def a18(spark, folder):
    report = drift.drift_report(*two_sides(spark, folder), ["level", "segment", "n_orders", "nation", "min_price", "max_price", "priority"], TEXTS)
    rows = rounded(rounded(report.drop("position"), "psi", "distribution_shift", "new_category_rate"), "reference_mean", "current_mean", digits=4)
    return rows


@query("a18_drift_from_profile", f"""
WITH {LONG}, {EDGES}, {BINNED}, {PSI}, {NUMERIC}, {CATEGORICAL}
SELECT feature, type, reference_mean, current_mean, NULL AS reference_top, NULL AS current_top, NULL AS distribution_shift, NULL AS new_category_rate, alert FROM numeric_rows
UNION ALL SELECT feature, type, NULL, NULL, reference_top, current_top, distribution_shift, new_category_rate, alert FROM categorical_rows
""")
def a18_profile(spark, folder):
    """The report against a kept profile: everything but the index is exact, and the alerts are the same."""
    reference, current = two_sides(spark, folder)
    features = ["level", "segment", "n_orders", "nation", "min_price", "max_price", "priority"]
    kept = materialize(drift.profile(reference, features, TEXTS))
    rows = drift.drift_from_profile(kept, current, features, TEXTS).drop("position", "psi")
    return rounded(rounded(rows, "distribution_shift", "new_category_rate"), "reference_mean", "current_mean", digits=4)


@query("a18_drift_summary", f"""
WITH {LONG}, {EDGES}, {BINNED}, {PSI}, {NUMERIC}, {CATEGORICAL}
SELECT count(*) AS feature_rows, count(*) FILTER (alert) AS alert_count FROM (SELECT alert FROM numeric_rows UNION ALL SELECT alert FROM categorical_rows)
""")
def a18_summary(spark, folder):
    return drift.drift_summary(drift.drift_report(*two_sides(spark, folder), [*NUMBERS, *TEXTS], TEXTS))


# --- residual study ----------------------------------------------------------
def ruled(spark, folder):
    return residuals.with_residuals(labelled_full(spark, folder), "level", "target")


MEANS = RULED + """,
residual_long AS (SELECT feature, value, error_type FROM ruled UNPIVOT (value FOR feature IN (n_orders, avg_price, min_price, max_price))),
means AS (SELECT feature, avg(value) FILTER (error_type = 'correct') AS correct_mean, avg(value) FILTER (error_type = 'false_negative') AS false_negative_mean,
  avg(value) FILTER (error_type = 'false_positive') AS false_positive_mean FROM residual_long GROUP BY feature)
"""


@query("a3_numeric_summary", f"""
WITH {MEANS} SELECT feature, round(correct_mean, 4) AS correct_mean, round(false_negative_mean, 4) AS false_negative_mean, round(false_positive_mean, 4) AS false_positive_mean,
  round(false_negative_mean - correct_mean, 4) AS false_negative_minus_correct, round(false_positive_mean - correct_mean, 4) AS false_positive_minus_correct FROM means
""")
def a3(spark, folder):
    summary = residuals.numeric_summary(ruled(spark, folder), ["n_orders", "avg_price", "min_price", "max_price"])
    return rounded(summary, *[c for c in summary.columns if c != "feature"], digits=4)


@query("a4_error_counts", f"""
WITH {RULED} SELECT period, count(*) FILTER (error_type = 'correct') AS correct, count(*) FILTER (error_type = 'false_negative') AS false_negative,
  count(*) FILTER (error_type = 'false_positive') AS false_positive FROM ruled GROUP BY period
""")
def a4(spark, folder):
    return residuals.error_counts(ruled(spark, folder), ["period"])


@query("a5_categorical_breakdown", f"""
WITH {RULED}, cats AS (SELECT error_type, feature, category, count(*) AS n FROM ruled UNPIVOT (category FOR feature IN (segment, nation, priority))
  WHERE error_type <> 'correct' GROUP BY 1, 2, 3),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY error_type, feature ORDER BY n DESC, category) AS INTEGER) AS rank,
  n / CAST(sum(n) OVER (PARTITION BY error_type, feature) AS DOUBLE) AS share FROM cats)
SELECT error_type, feature, rank, category, round(share, 6) AS share FROM ranked WHERE rank <= 5
""")
def a5(spark, folder):
    return rounded(residuals.categorical_breakdown(ruled(spark, folder), TEXTS), "share")


@query("o7_top_categories", """
SELECT source, lang, n, rank FROM (SELECT source, lang, count(*) AS n, CAST(row_number() OVER (PARTITION BY source ORDER BY count(*) DESC, lang) AS INTEGER) AS rank
  FROM documents GROUP BY source, lang) WHERE rank <= 2
""")
def o7(spark, folder):
    counts = table(spark, folder, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"))
    return ranking.top_n_per_group(counts, ["source"], [F.col("n").desc(), F.col("lang")], 2)


# Importances that both engines can compute: how strongly a feature goes with the outcome.
FEATURES = ("n_orders", "avg_price", "min_price", "max_price")
ACTIONS = [
    ("n_orders", "Orders", True, "sell more often"), ("avg_price", "Mean price", True, "offer larger baskets"),
    ("max_price", "Top price", False, "watch single large orders"),
]
WEIGHTS = MEANS + """,
importances AS (SELECT 'n_orders' AS feature, abs(corr(n_orders, target)) AS importance FROM ruled UNION ALL SELECT 'avg_price', abs(corr(avg_price, target)) FROM ruled
  UNION ALL SELECT 'min_price', abs(corr(min_price, target)) FROM ruled UNION ALL SELECT 'max_price', abs(corr(max_price, target)) FROM ruled)
"""


def correlations(spark, folder):
    rows = ruled(spark, folder)
    wide = rows.agg(*[F.abs(F.corr(c, F.col("target").cast("double"))).alias(c) for c in FEATURES])
    return rows, wide.unpivot([], list(FEATURES), "feature", "importance")


@query("j7_actionable_signals", f"""
WITH {WEIGHTS}, deltas AS (SELECT feature, false_negative_mean - correct_mean AS fn, false_positive_mean - correct_mean AS fp FROM means),
actions(feature, label, better, action_hint) AS (VALUES ('n_orders', 'Orders', true, 'sell more often'), ('avg_price', 'Mean price', true, 'offer larger baskets'), ('max_price', 'Top price', false, 'watch single large orders')),
sides AS (SELECT a.*, i.importance, d.fn, d.fp, CASE WHEN better THEN fn < 0 ELSE fn <= 0 END AS entry_low, CASE WHEN better THEN fp <= 0 ELSE fp < 0 END AS recovery_low
  FROM importances i JOIN actions a USING (feature) LEFT JOIN deltas d USING (feature))
SELECT 'entry' AS scenario, feature, label, round(importance, 6) AS importance,
  CASE WHEN entry_low THEN 'valores_mais_baixos_associados_a_piora' ELSE 'valores_mais_altos_associados_a_piora' END AS direction,
  CASE WHEN entry_low THEN 'valores mais baixos parecem associados a maior chance de piora' ELSE 'valores mais altos parecem associados a maior chance de piora' END AS interpretation,
  action_hint, round(fn, 4) AS comparison_delta FROM sides
UNION ALL SELECT 'recovery', feature, label, round(importance, 6),
  CASE WHEN recovery_low THEN 'valores_mais_baixos_associados_a_melhora' ELSE 'valores_mais_altos_associados_a_melhora' END,
  CASE WHEN recovery_low THEN 'valores mais baixos parecem associados a maior chance de melhora' ELSE 'valores mais altos parecem associados a maior chance de melhora' END,
  action_hint, round(fp, 4) FROM sides
""")
def j7(spark, folder):
    rows, importances = correlations(spark, folder)
    summary = residuals.numeric_summary(rows, list(FEATURES))
    actions = spark.createDataFrame(ACTIONS, "feature string, label string, higher_is_better boolean, action_hint string")
    signals = union_all([residuals.actionable(importances, summary, scenario, actions) for scenario in ("entry", "recovery")])
    return rounded(rounded(signals, "importance"), "comparison_delta", digits=4)


@query("o10_top_signals", f"""
WITH {WEIGHTS} SELECT feature, round(importance, 6) AS importance FROM importances ORDER BY importance DESC LIMIT 2
""")
def o10(spark, folder):
    _, importances = correlations(spark, folder)
    return rounded(ranking.preview(importances, 2, F.col("importance").desc()), "importance")


@query("a22_summed_importances", """
WITH encoded AS (SELECT 'segment_' || c_mktsegment AS name, sum(c_acctbal) AS importance FROM customer GROUP BY 1
  UNION ALL SELECT 'nation_' || n_name, sum(c_acctbal) FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY 1 UNION ALL SELECT 'balance', 1.0)
SELECT CASE WHEN name LIKE 'segment_%' THEN 'segment' WHEN name LIKE 'nation_%' THEN 'nation' ELSE name END AS feature, round(sum(importance), 2) AS importance FROM encoded GROUP BY 1
""")
def a22(spark, folder):
    balances = table(spark, folder, "customer").select(F.col("c_custkey").alias("entity"), F.col("c_acctbal").alias("b"))
    rows = balances.join(customer_kinds(spark, folder), "entity")
    encoded = union_all([
        rows.groupBy(F.concat(F.lit(f"{kind}_"), kind).alias("name")).agg(F.sum("b").alias("importance")) for kind in ("segment", "nation")
    ] + [rows.select(F.lit("balance").alias("name"), F.lit(1.0).alias("importance")).distinct()])
    return rounded(residuals.grouped_importances(encoded, ["segment", "nation", "balance"]), "importance", digits=2)


@query("m12_residual_metrics", f"""
WITH {RULED}, last AS (SELECT * FROM ruled WHERE period = (SELECT max(period) FROM ruled)),
n AS (SELECT count(*) FILTER (baseline_pred = 1 AND target = 1) AS tp, count(*) FILTER (baseline_pred = 1 AND target = 0) AS fp,
  count(*) FILTER (baseline_pred = 0 AND target = 1) AS fn, count(*) FILTER (baseline_pred = 0 AND target = 0) AS tn FROM last)
SELECT tp, fp, fn, tn, round(5.0 * tp / (5 * tp + 4 * fn + fp), 6) AS f2, round((fp + fn) / CAST(tp + fp + fn + tn AS DOUBLE), 6) AS brier FROM n
""")
def m12(spark, folder):
    rows = ruled(spark, folder)
    last = rows.where(F.col("period") == rows.agg(F.max("period")).scalar()).withColumn("score", F.col("baseline_pred").cast("double"))
    found = metrics.full_metrics(last, "target", "score", "baseline_pred")
    return rounded(found.select("tp", "fp", "fn", "tn", "f2", "brier"), "f2", "brier")
