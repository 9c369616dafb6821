"""Consolidated table, run tables and events, built from the given tables."""

from pyspark.sql import functions as F

from panelwise import fixed
from panelwise.catalog.base import LABELLED, PANEL, labelled, order_panel, query, rounded, table
from panelwise.frames import new_folder
from panelwise.functions import payload, risk, text
from panelwise.operators import metrics, runs
from panelwise.operators.normalize import conform, union_all
from panelwise.plans.ingest import bootstrap, ingest, status
from panelwise.sources.exports import export_csv, export_json
from panelwise.sources.store import Store
from panelwise.streaming.ingest_stream import ingest_stream


def new_store(spark) -> Store:
    return Store(spark, new_folder(spark, "store"))


def canonical_orders(spark, folder):
    """Orders as canonical rows: the customer is the entity, repeated when it ordered more than once in a year."""
    orders = table(spark, folder, "orders")
    rows = orders.select(
        F.col("o_custkey").cast("string").alias("ra"), F.year("o_orderdate").alias("ano_referencia"),
        F.col("o_orderpriority").alias("fase"), (F.col("o_totalprice") - 250000).alias("defasagem"),
        F.lit("orders").alias("source_file"), F.col("o_orderkey").alias("source_row_number"),
    )
    return conform(rows, fixed.CANONICAL)


def canonical_panel(spark, folder):
    rows = order_panel(spark, folder).select(
        F.col("entity").cast("string").alias("ra"), F.col("period").alias("ano_referencia"),
        F.col("level").alias("defasagem"), F.col("n_orders").alias("numero_avaliacoes"), F.lit("panel").alias("fase"),
    )
    return conform(rows, fixed.CANONICAL)


@query("s3_scan_consolidated", f"""
WITH {PANEL} SELECT CAST(entity AS VARCHAR) AS ra, period AS ano_referencia, 'panel' AS fase, round(level, 6) AS defasagem, n_orders AS numero_avaliacoes
FROM panel ORDER BY period, entity
""")
def s3(spark, folder):
    store = new_store(spark)
    store.append_records(canonical_panel(spark, folder), 1)
    return rounded(store.load_consolidated().select("ra", "ano_referencia", "fase", "defasagem", "numero_avaliacoes"), "defasagem")


@query("k1_append_new_records", """
WITH firsts AS (SELECT o_custkey, year(o_orderdate) AS y, min(o_orderkey) AS k FROM orders GROUP BY 1, 2),
urgent AS (SELECT o_custkey, year(o_orderdate) AS y, min(o_orderkey) AS k FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1, 2)
SELECT CAST(f.y AS INTEGER) AS ano_referencia, CAST(CASE WHEN u.k IS NULL THEN 2 ELSE 1 END AS BIGINT) AS ingestion_run_id, count(*) AS n, CAST(sum(coalesce(u.k, f.k)) AS BIGINT) AS row_numbers
FROM firsts f LEFT JOIN urgent u USING (o_custkey, y) GROUP BY 1, 2
""")
def k1(spark, folder):
    store = new_store(spark)
    rows = canonical_orders(spark, folder)
    ingest(store, rows.where("fase = '1-URGENT'"), {"source_file": "urgent"})
    ingest(store, rows, {"source_file": "all"})
    return store.records().groupBy("ano_referencia", "ingestion_run_id").agg(
        F.count("*").alias("n"), F.sum("source_row_number").alias("row_numbers")
    )


@query("k2_append_run_rows", """
WITH u AS (SELECT count(*) AS n, count(DISTINCT (o_custkey, year(o_orderdate))) AS k FROM orders WHERE o_orderpriority = '1-URGENT'),
a AS (SELECT count(*) AS n, count(DISTINCT (o_custkey, year(o_orderdate))) AS k FROM orders)
SELECT CAST(1 AS BIGINT) AS id, u.n AS input_rows, u.k AS inserted_rows, u.n - u.k AS duplicate_rows, 'v1-r' || CAST(u.k AS VARCHAR) AS data_version FROM u
UNION ALL SELECT 2, a.n, a.k - u.k, a.n - (a.k - u.k), 'v2-r' || CAST(a.k AS VARCHAR) FROM a, u
""")
def k2(spark, folder):
    store = new_store(spark)
    rows = canonical_orders(spark, folder)
    ingest(store, rows.where("fase = '1-URGENT'"), {"source_file": "urgent"})
    ingest(store, rows, {"source_file": "all"})
    return store.runs("ingestion_runs").select("id", "input_rows", "inserted_rows", "duplicate_rows", "data_version")


def layout_files(spark, folder):
    """The orders of each year written as raw CSV: text, decimal commas, headers of two layouts."""
    comma = F.translate(F.format_number("o_totalprice", 2), ",.", ".,")
    orders = table(spark, folder, "orders")
    raw = orders.select(
        F.year("o_orderdate").alias("y"), F.col("o_custkey").alias("RA"), F.col("o_orderpriority").alias("Fase"),
        comma.alias("INDE"), F.when(F.col("o_orderstatus") == "F", "Cursando").otherwise("Não").alias("Ativo/ Inativo"),
    )
    paths = []
    years = sorted(r.y for r in raw.select("y").distinct().collect())
    for year in years:
        if year % 2:
            rows = raw.withColumnRenamed("INDE", "INDE 2024").withColumn("Escola", F.lit("Escola Única"))
        else:
            rows = raw.withColumnRenamed("INDE", "INDE 2023").withColumn("Pedra 2023", F.lit("Ágata"))
        path = new_folder(spark, f"raw{year}")
        export_csv(rows.where(F.col("y") == year).drop("y"), path)
        paths.append((year, path))
    return paths


LAYOUT_ROWS = """
SELECT CAST(year(o_orderdate) AS INTEGER) AS ano_referencia, CASE WHEN year(o_orderdate) % 2 = 1 THEN 'pede_2024_like' ELSE 'pede_2023_like' END AS source_schema,
  count(DISTINCT o_custkey) AS n, count(DISTINCT o_custkey) AS entities FROM orders GROUP BY 1, 2
"""


@query("s2_folder_load", LAYOUT_ROWS)
def s2(spark, folder):
    store = new_store(spark)
    for year, path in layout_files(spark, folder):
        bootstrap(store, path, year)
    return store.records().groupBy("ano_referencia", "source_schema").agg(
        F.count("*").alias("n"), F.countDistinct("ra").alias("entities")
    )


@query("s1_read_layout_csv", """
SELECT CAST(year(o_orderdate) AS INTEGER) AS ano_referencia, count(*) AS n, round(sum(o_totalprice), 2) AS total, count(*) FILTER (o_orderstatus = 'F') AS enrolled,
  CAST(count(*) AS BIGINT) AS last_row FROM orders GROUP BY 1
""")
def s1(spark, folder):
    from panelwise.sources.layout_csv import list_csv, read_files, sniff

    found = [read_files(spark, sniff(spark, list_csv(spark, path)), year) for year, path in layout_files(spark, folder)]
    # The part files number their rows each from 1. Each of the two layouts has the price under another label.
    price = F.coalesce("inde_23", "inde_atual")
    per_file = union_all(found).groupBy("ano_referencia", "source_file").agg(
        F.count("*").alias("n"), F.sum(price).alias("total"), F.count_if("status_matricula").alias("enrolled"),
        F.max("source_row_number").alias("last"), F.countDistinct("source_row_number").alias("numbers"),
    )
    return per_file.groupBy("ano_referencia").agg(
        F.sum("n").alias("n"), F.round(F.sum("total"), 2).alias("total"), F.sum("enrolled").alias("enrolled"),
        F.sum(F.least("last", "numbers")).alias("last_row"),
    )


@query("st1_stream_ingest", LAYOUT_ROWS)
def st1(spark, folder):
    store = new_store(spark)
    for year, path in layout_files(spark, folder):
        ingest_stream(store, path, new_folder(spark, "stream"), year).awaitTermination()
    return store.records().groupBy("ano_referencia", "source_schema").agg(
        F.count("*").alias("n"), F.countDistinct("ra").alias("entities")
    )


@query("a1_store_status", """
SELECT count(*) AS rows, count(DISTINCT ra) AS entities, 'v1-r' || CAST(count(*) AS VARCHAR) AS data_version, CAST(1 AS BIGINT) AS run_id, count(*) AS inserted_rows
FROM (SELECT DISTINCT o_custkey AS ra, year(o_orderdate) AS y FROM orders)
""")
def a1_store(spark, folder):
    store = new_store(spark)
    ingest(store, canonical_orders(spark, folder), {"source_file": "all"})
    last = F.col("latest_ingestion")
    return status(store).select(
        "rows", "entities", "data_version", last["id"].alias("run_id"), last["inserted_rows"].alias("inserted_rows")
    )


def evaluation_rows(spark, folder):
    """The rule and a price score as two models, evaluated on the labelled panel."""
    rows = labelled(spark, folder).select("entity", "period", F.col("target").alias(fixed.ACTUAL), "level", "rule_score")
    two = F.array(
        F.struct(F.lit("rule").alias(fixed.MODEL_USED), F.lit("now").alias(fixed.STRATEGY_USED),
                 risk.baseline_predict("level").alias(fixed.PREDICTION)),
        F.struct(F.lit("price").alias(fixed.MODEL_USED), F.lit("now__x").alias(fixed.STRATEGY_USED),
                 risk.decide("rule_score", 0.45).alias(fixed.PREDICTION)),
    )
    models = rows.select("entity", "period", fixed.ACTUAL, F.inline(two))
    return models.withColumn("model_id", text.model_id(fixed.MODEL_USED, fixed.STRATEGY_USED))


@query("s5_scan_evaluation", f"""
WITH {LABELLED} SELECT entity, period, CAST(target AS INTEGER) AS actual, CASE WHEN rule_score >= 0.45 THEN 1 ELSE 0 END AS predicted FROM labelled
""")
def s5(spark, folder):
    store = new_store(spark)
    store.append_children("evaluation_rows", evaluation_rows(spark, folder), 7, ["model_id"])
    # The model's folder is the only one read.
    rows = store.load_evaluation(7, "price__now__x")
    return rows.select("entity", "period", F.col(fixed.ACTUAL).alias("actual"), F.col(fixed.PREDICTION).alias("predicted"))


@query("a12_evaluation_summary", f"""
WITH {LABELLED} SELECT count(*) AS rows, round(avg(CASE WHEN (rule_score >= 0.45) = (target = 1) THEN 1.0 ELSE 0.0 END), 6) AS accuracy,
  count(*) FILTER (rule_score >= 0.45) AS predicted_positive, CAST(sum(target) AS BIGINT) AS actual_positive FROM labelled
""")
def a12(spark, folder):
    return rounded(runs.evaluation_summary(evaluation_rows(spark, folder), "price__now__x"), "accuracy")


# --- run tables derived from the events --------------------------------------
def daily_runs(spark, folder):
    """One run per day of events; the id grows with the day."""
    day = F.col("ts").cast("date")
    return table(spark, folder, "events").groupBy(F.date_diff(day, F.lit("2024-01-01").cast("date")).cast("long").alias("id")).agg(
        F.count("*").alias("input_rows"), F.count_if(F.col("event_type") == "error").alias("errors")
    )


DAILY = """
daily AS (SELECT CAST(datediff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS BIGINT) AS id, count(*) AS input_rows, count(*) FILTER (event_type = 'error') AS errors FROM events GROUP BY 1)
"""


@query("o2_latest_run", f"WITH {DAILY} SELECT * FROM daily ORDER BY id DESC LIMIT 1")
def o2(spark, folder):
    return runs.latest(daily_runs(spark, folder))


@query("o2_latest_per_group", """
SELECT event_type, max(event_id) AS event_id, arg_max(user_id, event_id) AS user_id FROM events GROUP BY event_type
""")
def o2_per(spark, folder):
    return runs.latest_per(table(spark, folder, "events").select("event_type", "event_id", "user_id"), ["event_type"], "event_id")


@query("o3_recent_events", """
SELECT event_id, event_type, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS at FROM (SELECT * FROM events ORDER BY event_id DESC LIMIT 200) ORDER BY event_id
""")
def o3(spark, folder):
    events = table(spark, folder, "events").select("event_id", "event_type", "ts")
    return runs.recent_events(events, 200, "event_id").select("event_id", "event_type", payload.iso_timestamp("ts").alias("at"))


@query("a21_event_counts", "SELECT event_type AS level, count(*) AS n FROM (SELECT * FROM events ORDER BY event_id DESC LIMIT 200) GROUP BY 1")
def a21(spark, folder):
    events = table(spark, folder, "events").select("event_id", F.col("event_type").alias("level"))
    return runs.event_counts(events, 200, "event_id")


@query("j8_rows_of_runs", f"""
WITH {DAILY} SELECT event_id, datediff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS run FROM events
WHERE datediff('day', DATE '2024-01-01', CAST(ts AS DATE)) IN (SELECT id FROM daily WHERE errors > 60)
""")
def j8(spark, folder):
    day = F.date_diff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")).cast("long")
    rows = table(spark, folder, "events").select("event_id", day.alias("run"))
    return runs.rows_of(rows, daily_runs(spark, folder).where("errors > 60"), "run").select("event_id", "run")


# --- candidates: thresholds of the price score per year ----------------------
THRESHOLDS = (0.3, 0.4, 0.5, 0.6)


def candidate_runs(spark, folder):
    """One training run per year: the rule and four thresholds with their F2, as a list of candidates."""
    rows = labelled(spark, folder)
    measures = rows.groupBy(F.col("period").alias("id")).agg(*[
        v.alias(f"{i}_{k}") for i, pred in enumerate(
            [risk.baseline_predict("level")] + [(F.col("rule_score") < t).cast("int") for t in THRESHOLDS]
        ) for k, v in metrics.confusion("target", pred).items()
    ])
    names = [fixed.BASELINE_MODEL] + [f"below_{t}" for t in THRESHOLDS]
    listed = [
        F.struct(
            F.lit(name).alias("model_name"), F.lit("price").alias("strategy"),
            F.round(metrics.decision_metrics(F.col(f"{i}_tp"), F.col(f"{i}_fp"), F.col(f"{i}_fn"))["f2"], 6).alias("f2"),
        )
        for i, name in enumerate(names)
    ]
    return measures.select("id", F.array(*listed).alias("candidates"))


CANDIDATES = LABELLED + """,
decided AS (
  SELECT period AS id, 0 AS position, 'baseline_persistencia' AS model_name, target, level < 0 AS p FROM labelled
  UNION ALL SELECT period, 1, 'below_0.3', target, rule_score < 0.3 FROM labelled UNION ALL SELECT period, 2, 'below_0.4', target, rule_score < 0.4 FROM labelled
  UNION ALL SELECT period, 3, 'below_0.5', target, rule_score < 0.5 FROM labelled UNION ALL SELECT period, 4, 'below_0.6', target, rule_score < 0.6 FROM labelled),
candidates AS (
  SELECT id, CAST(position AS INTEGER) AS position, model_name, 'price' AS strategy, round(CASE WHEN count(*) FILTER (p AND target = 1) = 0 THEN 0.0 ELSE 5.0 * count(*) FILTER (p AND target = 1)
    / (5 * count(*) FILTER (p AND target = 1) + 4 * count(*) FILTER (NOT p AND target = 1) + count(*) FILTER (p AND target = 0)) END, 6) AS f2
  FROM decided GROUP BY id, position, model_name)
"""


@query("f2_explode_candidates", f"WITH {CANDIDATES} SELECT id, CAST(5 AS INTEGER) AS candidate_count, position, model_name, strategy, f2 FROM candidates")
def f2(spark, folder):
    return runs.explode_candidates(candidate_runs(spark, folder))


@query("j9_flag_best", f"""
WITH {CANDIDATES} SELECT id, position, model_name || '__' || strategy AS model_id, f2, row_number() OVER (PARTITION BY id ORDER BY f2 DESC, position) = 1 AS is_best_overall FROM candidates
""")
@query("m19_compare_candidates", f"""
WITH {CANDIDATES} SELECT id, position, model_name || '__' || strategy AS model_id, f2, row_number() OVER (PARTITION BY id ORDER BY f2 DESC, position) = 1 AS is_best_overall FROM candidates
""")
def j9(spark, folder):
    flagged = runs.flag_best(runs.explode_candidates(candidate_runs(spark, folder)), ["id"])
    return flagged.select("id", "position", "model_id", "f2", "is_best_overall")


@query("o4_rank_candidates", f"""
WITH {CANDIDATES} SELECT id, model_name, f2, row_number() OVER (PARTITION BY id ORDER BY coalesce(f2, 0) DESC, position) AS rank
FROM candidates WHERE model_name <> 'baseline_persistencia'
""")
def o4(spark, folder):
    ranked = runs.number_candidates(runs.explode_candidates(candidate_runs(spark, folder)), ["id"], include_baseline=False)
    return runs.rank_candidates(ranked, include_baseline=False).select("id", "model_name", "f2", "rank")


@query("o5_pick_winner", f"""
WITH {CANDIDATES} SELECT id, model_name, f2 FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY f2 DESC, position) AS r FROM candidates WHERE model_name <> 'baseline_persistencia') WHERE r = 1
""")
def o5(spark, folder):
    rows = runs.explode_candidates(candidate_runs(spark, folder))
    return runs.pick_winner(rows, ["id"]).select("id", "model_name", "f2")


@query("k4_persist_predictions", f"""
WITH {PANEL} SELECT entity, period, CASE WHEN level < 0 THEN 1 ELSE 0 END AS decision, CASE WHEN level < 0 THEN 1.0 ELSE 0.0 END AS probability FROM panel
""")
def k4(spark, folder):
    """The rule's predictions for the panel, appended as a run's rows and read back."""
    from panelwise.operators.models import baseline_bundle, score_frame

    store = new_store(spark)
    scored = score_frame(baseline_bundle("level"), order_panel(spark, folder), ["entity", "period"], "level")
    store.append_children("prediction_rows", scored, 1)
    written = store.children("prediction_rows", 1)
    return written.select("entity", "period", F.col(fixed.PREDICTION).alias("decision"), F.col(fixed.PROBABILITY).alias("probability"))


@query("k7_json_exports", f"""
WITH {PANEL} SELECT entity, period, CASE WHEN n_orders > 1 THEN round(level, 4) END AS level FROM panel
""")
def k7(spark, folder):
    """Exported as JSON with nulls written out, and read back by schema."""
    rows = order_panel(spark, folder).select("entity", "period", F.when(F.col("n_orders") > 1, F.round("level", 4)).alias("level"))
    path = export_json(rows, new_folder(spark, "json"))
    return spark.read.schema("entity long, period int, level double").json(path)


@query("k9_event_append", """
SELECT o_orderstatus AS message, count(*) AS n FROM orders GROUP BY 1
""")
def k9(spark, folder):
    """One event for each order status, with its number of orders as context."""
    store = new_store(spark)
    for row in table(spark, folder, "orders").groupBy("o_orderstatus").count().collect():
        store.record_event("INFO", "orders", row["o_orderstatus"], {"n": row["count"]})
    return store.runs("app_events").select("message", F.col("context")["n"].cast("long").alias("n"))
