"""Row-wise operators: parsing, flags, states, keys, payloads."""

from pyspark.sql import functions as F, types as T

from panelwise import fixed
from panelwise.catalog.base import (
    FULL_PANEL, LABELLED, PANEL, customer_kinds, full_panel, labelled, order_panel, query, rounded, table,
)
from panelwise.functions import payload, risk, text
from panelwise.operators import consolidate, normalize, residuals
from panelwise.operators.models import Features, coerce_features, fill_numbers
from panelwise.operators.panel import segments, temporal_split

# Labels of a text: its distinct folded words.
LABELS_SQL = """
labels AS (
  SELECT doc_id, list_distinct(string_split(trim(regexp_replace(lower(regexp_replace(strip_accents(text), '[^\\x00-\\x7F]', '', 'g')),
         '[^a-z0-9]+', '_', 'g'), '_'), '_')) AS words FROM documents)
"""
# Layouts of the texts: words that belong to one language more than to the others.
TEXT_LAYOUTS = (
    ("english_like", 3, ("the", "and", "of", "that", "to")),
    ("french_like", 2, ("le", "la", "les", "que", "un")),
    ("german_like", 1, ("der", "die", "und", "nicht", "ein")),
)


def document_labels(spark, folder):
    words = F.array_distinct(F.split(text.fold_label("text"), "_"))
    return table(spark, folder, "documents").select("doc_id", words.alias("words"))


@query("p1_fold_label", """
SELECT doc_id, md5(trim(regexp_replace(lower(regexp_replace(strip_accents(text), '[^\\x00-\\x7F]', '', 'g')),
  '[^a-z0-9]+', '_', 'g'), '_')) AS folded FROM documents
""")
def p1(spark, folder):
    return table(spark, folder, "documents").select("doc_id", F.md5(text.fold_label("text")).alias("folded"))


@query("p2_alias_rename", """
SELECT c_custkey AS entity, c_mktsegment AS segment, c_acctbal AS balance FROM customer
""")
def p2(spark, folder):
    # Two labels have the same target: the first column stays.
    raw = table(spark, folder, "customer").select(
        F.col("c_custkey").alias("Cust Key"), F.col("c_mktsegment").alias("Mkt-Segment"), F.col("c_acctbal").alias("Acct. Bal."),
        F.col("c_name").alias("Segment"),
    )
    aliases = {"cust_key": "entity", "mkt_segment": "segment", "segment": "segment", "acct_bal": "balance"}
    return normalize.rename_by_alias(raw, aliases)


@query("p3_detect_layout", f"""
WITH {LABELS_SQL}, scored AS (
  SELECT doc_id, CAST(len(list_intersect(words, ['the', 'and', 'of', 'that', 'to'])) AS INTEGER) AS e,
    CAST(len(list_intersect(words, ['le', 'la', 'les', 'que', 'un'])) AS INTEGER) AS f,
    CAST(len(list_intersect(words, ['der', 'die', 'und', 'nicht', 'ein'])) AS INTEGER) AS g FROM labels)
SELECT doc_id, greatest(e, f, g) AS score, CASE WHEN greatest(e, f, g) = 0 THEN NULL WHEN e = greatest(e, f, g) THEN 'english_like'
  WHEN f = greatest(e, f, g) THEN 'french_like' ELSE 'german_like' END AS layout FROM scored
""")
def p3(spark, folder):
    layout, score = normalize.layout_column(F.col("words"), TEXT_LAYOUTS)
    return document_labels(spark, folder).select("doc_id", layout.alias("layout"), score.alias("score"))


@query("p6_infer_period", """
SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN CAST(year(o_orderdate) AS INTEGER)
  WHEN year(o_orderdate) >= 2000 THEN CAST(year(o_orderdate) AS INTEGER) ELSE 1990 END AS period FROM orders
""")
def p6(spark, folder):
    orders = table(spark, folder, "orders")
    year = F.year("o_orderdate")
    # No explicit period, zero, or the year itself.
    argument = F.when(F.col("o_orderstatus") == "F", year).when(F.col("o_orderstatus") == "O", 0)
    name = F.concat(F.lit("batch_"), year.cast("string"), F.lit("_v1.csv"))
    return orders.select("o_orderkey", text.infer_period(argument, name, 1990).alias("period"))


@query("p7_stamp_rows", """
SELECT c_custkey, 1995 AS ano_referencia, 'layout_a' AS source_schema, n_name || '.csv' AS source_file,
  row_number() OVER (PARTITION BY n_name ORDER BY c_custkey) AS source_row_number
FROM customer JOIN nation ON n_nationkey = c_nationkey
""")
def p7(spark, folder):
    from panelwise.operators.running import row_numbers

    rows = customer_kinds(spark, folder).select(F.col("entity").alias("c_custkey"), F.concat("nation", F.lit(".csv")).alias("file"))
    numbered = row_numbers(rows, ["file"], "c_custkey", "row")
    stamped = normalize.stamp(numbered, "layout_a", 1990, 1995, "file", "row")
    return stamped.select("c_custkey", "ano_referencia", "source_schema", "source_file", "source_row_number")


# Numbers written in several ways, from the line's price.
TEXT_NUMBER_SQL = """
texts AS (
  SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_shipdate, format('{:,.2f}', l_extendedprice) AS us, l_linenumber AS n FROM lineitem),
written AS (
  SELECT *, CASE n WHEN 1 THEN translate(us, ',.', '.,') WHEN 2 THEN us WHEN 3 THEN replace(us, ',', '')
    WHEN 4 THEN '  ' || replace(translate(us, ',.', '.,'), '.', '') || ' ' WHEN 5 THEN us || 'd' WHEN 6 THEN 'R$ ' || us ELSE '-' || split_part(us, '.', 1) END AS t
  FROM texts)
"""


def written_numbers(spark, folder):
    us = F.format_number("l_extendedprice", 2)
    br = F.translate(us, ",.", ".,")
    n = F.col("l_linenumber")
    spelled = (
        F.when(n == 1, br).when(n == 2, us).when(n == 3, F.replace(us, F.lit(",")))
        .when(n == 4, F.concat(F.lit("  "), F.replace(br, F.lit(".")), F.lit(" ")))
        .when(n == 5, F.concat(us, F.lit("d"))).when(n == 6, F.concat(F.lit("R$ "), us))
        .otherwise(F.concat(F.lit("-"), F.substring_index(us, ".", 1)))
    )
    return table(spark, folder, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", spelled.alias("t"))


@query("p8_parse_number", f"""
WITH {TEXT_NUMBER_SQL}, plain AS (
  SELECT *, replace(CASE WHEN contains(t, ',') AND contains(t, '.') THEN replace(trim(t), '.', '') ELSE trim(t) END, ',', '.') AS p FROM written)
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber,
  CASE WHEN regexp_full_match(p, '[+-]?[0-9]+(\\.[0-9]*)?') THEN try_cast(p AS DOUBLE) END AS number FROM plain
""")
def p8(spark, folder):
    rows = written_numbers(spark, folder)
    return rows.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", text.parse_number("t").alias("number"))


@query("p30_heuristic_number", f"""
WITH {TEXT_NUMBER_SQL}, bare AS (SELECT *, regexp_replace(t, '[\\sR$%]', '', 'g') AS b FROM written), plain AS (
  SELECT *, CASE
    WHEN contains(b, ',') AND contains(b, '.') THEN
      CASE WHEN strpos(reverse(b), ',') < strpos(reverse(b), '.') THEN replace(replace(b, '.', ''), ',', '.') ELSE replace(b, ',', '') END
    WHEN contains(b, ',') THEN replace(b, ',', '.')
    WHEN regexp_full_match(b, '-?\\d{{1,3}}(\\.\\d{{3}})+') THEN replace(b, '.', '') ELSE b END AS p FROM bare)
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber,
  CASE WHEN regexp_full_match(p, '-?\\d+(\\.\\d+)?') THEN try_cast(p AS DOUBLE) END AS number FROM plain
""")
def p30(spark, folder):
    rows = written_numbers(spark, folder)
    number = text.parse_number("t", "heuristic").alias("number")
    return rows.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", number)


@query("p9_parse_bool", """
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber,
  CASE l_returnflag WHEN 'A' THEN true WHEN 'N' THEN false END AS answer,
  CASE l_linestatus WHEN 'O' THEN true ELSE false END AS enrolled FROM lineitem
""")
def p9(spark, folder):
    rows = table(spark, folder, "lineitem")
    answer = F.when(F.col("l_returnflag") == "A", " SIM ").when(F.col("l_returnflag") == "N", "Não").otherwise("talvez")
    enrolled = F.when(F.col("l_linestatus") == "O", "Cursando").otherwise("inativo")
    return rows.select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
        text.parse_bool(answer).alias("answer"), text.parse_bool(enrolled).alias("enrolled"),
    )


@query("p10_whole_file_fallback", """
SELECT c_custkey, n_name AS file, CASE WHEN n_regionkey = 0 THEN CAST(c_custkey AS DOUBLE)
  WHEN c_mktsegment = 'BUILDING' THEN NULL ELSE c_acctbal END AS current_index
FROM customer JOIN nation ON n_nationkey = c_nationkey
""")
def p10(spark, folder):
    nations = table(spark, folder, "nation")
    rows = table(spark, folder, "customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    # Nations of region 0 have no value at all, the others only sometimes.
    empty = (F.col("n_regionkey") == 0) | (F.col("c_mktsegment") == "BUILDING")
    files = rows.select(
        "c_custkey", F.col("n_name").alias("file"), F.when(~empty, F.col("c_acctbal")).alias("current_index"),
        F.col("c_custkey").cast("double").alias("old_index"),
    )
    return normalize.fallback_if_all_null(files, "current_index", "old_index", ["file"]).drop("old_index")


@query("p11_conform", """
SELECT CAST(c_custkey AS VARCHAR) AS ra, CAST(NULL AS INTEGER) AS ano_referencia, c_mktsegment AS fase, CAST(NULL AS DOUBLE) AS idade,
  c_acctbal AS defasagem FROM customer
""")
def p11(spark, folder):
    rows = table(spark, folder, "customer").select(
        F.col("c_acctbal").alias("defasagem"), F.col("c_mktsegment").alias("fase"), F.col("c_custkey").alias("ra"), "c_name"
    )
    names = ["ra", "ano_referencia", "fase", "idade", "defasagem"]
    return normalize.conform(rows, T.StructType([f for f in fixed.CANONICAL if f.name in names]))


@query("p12_unknown_labels", f"""
WITH {LABELS_SQL}
SELECT doc_id, CAST(len(words) - len(list_intersect(words, ['the', 'and', 'le', 'la', 'der', 'die'])) AS INTEGER) AS unknown FROM labels
""")
def p12(spark, folder):
    known = {word: word for word in ("the", "and", "le", "la", "der", "die")}
    return document_labels(spark, folder).select(
        "doc_id", F.size(normalize.unknown_labels(F.col("words"), known)).alias("unknown")
    )


@query("p5_required_labels", f"""
WITH {LABELS_SQL}
SELECT doc_id, concat_ws(',', CASE WHEN NOT list_contains(words, 'the') THEN 'the' END, CASE WHEN NOT list_contains(words, 'la') THEN 'la' END) AS missing
FROM labels
""")
@query("u4_missing_required", f"""
WITH {LABELS_SQL}
SELECT doc_id, concat_ws(',', CASE WHEN NOT list_contains(words, 'the') THEN 'the' END, CASE WHEN NOT list_contains(words, 'la') THEN 'la' END) AS missing
FROM labels
""")
def u4(spark, folder):
    missing = normalize.missing_required(F.col("words"), ("the", "la"))
    return document_labels(spark, folder).select("doc_id", F.array_join(missing, ",").alias("missing"))


@query("u3_header_overlap", f"""
WITH {LABELS_SQL}
SELECT doc_id, CAST(len(list_intersect(words, ['le', 'la', 'les', 'que', 'un'])) AS INTEGER) AS overlap FROM labels
""")
def u3(spark, folder):
    overlap = normalize.header_overlap(F.col("words"), TEXT_LAYOUTS[1][2])
    return document_labels(spark, folder).select("doc_id", F.size(overlap).alias("overlap"))


@query("p13_clean_keys", """
SELECT o_orderkey, CAST(o_custkey AS VARCHAR) AS entity, CAST(year(o_orderdate) AS INTEGER) AS period FROM orders
WHERE o_orderstatus <> 'P' AND o_orderpriority <> '5-LOW'
""")
def p13(spark, folder):
    rows = table(spark, folder, "orders").select(
        "o_orderkey", F.when(F.col("o_orderstatus") != "P", F.col("o_custkey")).alias("entity"),
        F.when(F.col("o_orderpriority") != "5-LOW", F.year("o_orderdate").cast("string")).otherwise("n/a").alias("period"),
    )
    return consolidate.clean_keys(rows, "entity", "period")


@query("p14_safe_numeric", """
SELECT o_orderkey, try_cast(split_part(o_orderpriority, '-', 1) AS DOUBLE) AS number,
  CASE WHEN o_orderstatus = 'O' THEN o_totalprice END AS price FROM orders
""")
def p14(spark, folder):
    spelled = F.when(F.col("o_orderstatus") == "O", F.col("o_totalprice").cast("string")).otherwise(
        F.concat(F.col("o_totalprice").cast("string"), F.lit("f"))
    )
    first = F.substring_index("o_orderpriority", "-", 1)
    return table(spark, folder, "orders").select("o_orderkey", text.to_number(first).alias("number"), text.to_number(spelled).alias("price"))


@query("p15_missing_flag", f"""
WITH {PANEL} SELECT entity, period, CASE WHEN max_price > 400000 THEN 1 ELSE 0 END AS flag FROM panel
""")
def p15(spark, folder):
    known = F.when(F.col("max_price") <= 400000, F.col("max_price"))
    return order_panel(spark, folder).select("entity", "period", risk.missing_flag(known).alias("flag"))


@query("p16_category", f"""
WITH {FULL_PANEL} SELECT entity, period, CASE WHEN segment = 'BUILDING' THEN '<NA>' ELSE segment END AS segment,
  CAST(CAST(n_orders AS INTEGER) AS VARCHAR) AS n_orders FROM full_panel
""")
def p16(spark, folder):
    rows = full_panel(spark, folder)
    segment = F.when(F.col("segment") != "BUILDING", F.col("segment"))
    return rows.select("entity", "period", text.category(segment).alias("segment"), text.category(F.col("n_orders").cast("int")).alias("n_orders"))


@query("p17_target", f"WITH {LABELLED} SELECT entity, period, CAST(target AS INTEGER) AS target FROM labelled")
def p17(spark, folder):
    return labelled(spark, folder).select("entity", "period", risk.is_low("next_level").alias("target"))


@query("p18_baseline_rule", f"""
WITH {PANEL} SELECT entity, period, CASE WHEN n_orders > 1 AND level < 0 THEN 1 ELSE 0 END AS prediction FROM panel
""")
def p18(spark, folder):
    # Levels of a single order are taken as unknown.
    level = F.when(F.col("n_orders") > 1, F.col("level"))
    return order_panel(spark, folder).select("entity", "period", risk.baseline_predict(level).alias("prediction"))


@query("p19_state_group", f"""
WITH {PANEL} SELECT entity, period, CASE WHEN n_orders > 1 THEN level < 0 END AS low_now,
  CASE WHEN n_orders > 1 AND level < 0 THEN 'ja_defasado' WHEN n_orders > 1 THEN 'nao_defasado' END AS state FROM panel
""")
def p19(spark, folder):
    level = F.when(F.col("n_orders") > 1, F.col("level"))
    return order_panel(spark, folder).select(
        "entity", "period", risk.state_now(level).alias("low_now"), risk.state_group(level).alias("state")
    )


@query("p20_threshold_decision", f"""
WITH {PANEL} SELECT entity, period, CASE WHEN rule_score >= 0.5 THEN 1 ELSE 0 END AS decision FROM panel
""")
def p20(spark, folder):
    return order_panel(spark, folder).select("entity", "period", risk.decide("rule_score", 0.5).alias("decision"))


@query("p21_hit", f"WITH {LABELLED} SELECT entity, period, (target = 1) = (level < 0) AS hit FROM labelled")
def p21(spark, folder):
    rows = labelled(spark, folder).withColumn("prediction", risk.baseline_predict("level"))
    return rows.select("entity", "period", risk.hit("target", "prediction").alias("hit"))


@query("p22_model_id", """
SELECT c_custkey, c_mktsegment || '__' || n_name || '__x' AS model_id, c_mktsegment AS model_name, n_name || '__x' AS strategy
FROM customer JOIN nation ON n_nationkey = c_nationkey
""")
def p22(spark, folder):
    rows = customer_kinds(spark, folder).select(
        F.col("entity").alias("c_custkey"), text.model_id("segment", F.concat("nation", F.lit("__x"))).alias("model_id")
    )
    name, strategy = text.split_model_id("model_id")
    return rows.select("c_custkey", "model_id", name.alias("model_name"), strategy.alias("strategy"))


@query("p23_residual_type", f"""
WITH {LABELLED} SELECT entity, period, CASE WHEN level >= 0 AND target = 1 THEN 'false_negative'
  WHEN level < 0 AND target = 0 THEN 'false_positive' ELSE 'correct' END AS error_type FROM labelled
""")
def p23(spark, folder):
    return residuals.with_residuals(labelled(spark, folder), "level", "target").select("entity", "period", "error_type")


@query("p24_segments", f"""
WITH {LABELLED} SELECT entity, period, CASE WHEN level >= 0 THEN 'entry' ELSE 'recovery' END AS segment,
  CAST(CASE WHEN level >= 0 THEN target ELSE 1 - target END AS INTEGER) AS outcome FROM labelled
""")
def p24(spark, folder):
    entry, recovery = segments(labelled(spark, folder), "level", "target")
    pick = lambda df, name, outcome: df.select("entity", "period", F.lit(name).alias("segment"), F.col(outcome).alias("outcome"))
    return pick(entry, "entry", "entered").unionByName(pick(recovery, "recovery", "recovered"))


@query("p25_transition_columns", f"""
WITH {PANEL}, scored AS (SELECT *, n_orders > 1 AND level >= 0 AS ok, n_orders > 1 AND level < 0 AS low, round(1 - rule_score, 2) AS r FROM panel)
SELECT entity, period, CASE WHEN ok THEN rule_score END AS score_entrada_em_risco, CASE WHEN low THEN r END AS score_recuperacao,
  round(CASE WHEN low THEN 1 - r END, 6) AS score_persistencia_defasagem,
  CASE WHEN ok THEN rule_score WHEN low THEN r END AS score_transicao_relevante,
  CASE WHEN ok THEN 'entrada_em_risco' WHEN low THEN 'recuperacao' END AS tipo_transicao_relevante FROM scored
""")
def p25(spark, folder):
    level = F.when(F.col("n_orders") > 1, F.col("level"))
    rows = order_panel(spark, folder).withColumns({
        "state": risk.state_group(level), "recovery": F.round(1 - F.col("rule_score"), 2),
    })
    columns = risk.transition_columns("state", "rule_score", "recovery")
    return rounded(rows.select("entity", "period", *[v.alias(k) for k, v in columns.items()]), fixed.PERSISTENCE_SCORE)


@query("p26_data_version", """
SELECT 'v' || CAST((SELECT max(n_nationkey) FROM nation) AS VARCHAR) || '-r' || CAST((SELECT count(*) FROM orders) AS VARCHAR) AS data_version
""")
def p26(spark, folder):
    return consolidate.data_version(table(spark, folder, "nation"), table(spark, folder, "orders"), "n_nationkey")


@query("p27_base_feature", """
SELECT c_custkey, 'c_mkt_segment' AS feature_a, CASE WHEN c_mktsegment = 'BUILDING' THEN 'c_mkt' ELSE 'other_' || c_mktsegment END AS feature_b,
  'c_acctbal' AS feature_c FROM customer
""")
def p27(spark, folder):
    features = ["c_mkt", "c_mkt_segment", "c_acctbal"]
    one = F.concat(F.lit("c_mkt_segment_"), "c_mktsegment")
    two = F.concat(F.when(F.col("c_mktsegment") == "BUILDING", "c_mkt_").otherwise("other_"), "c_mktsegment")
    return table(spark, folder, "customer").select(
        "c_custkey", residuals.base_feature(one, features).alias("feature_a"),
        residuals.base_feature(two, features).alias("feature_b"), residuals.base_feature(F.lit("c_acctbal"), features).alias("feature_c"),
    )


@query("p28_temporal_split", f"""
WITH {LABELLED} SELECT entity, CASE WHEN period = (SELECT min(period) FROM labelled) THEN 'train' ELSE 'validation' END AS part, period
FROM labelled WHERE period IN ((SELECT min(period) FROM labelled), (SELECT max(period) FROM labelled))
""")
def p28(spark, folder):
    train, validation = temporal_split(labelled(spark, folder), "period")
    pick = lambda df, part: df.select("entity", F.lit(part).alias("part"), "period")
    return pick(train, "train").unionByName(pick(validation, "validation"))


@query("p29_signal_direction", """
WITH d AS (SELECT c_nationkey, round(avg(CASE WHEN c_mktsegment = 'BUILDING' THEN c_acctbal END) - avg(c_acctbal), 4) AS delta FROM customer GROUP BY 1)
SELECT c_nationkey, delta,
  CASE WHEN delta IS NULL THEN 'associacao_indisponivel' WHEN delta < 0 THEN 'valores_mais_baixos_associados_a_piora' ELSE 'valores_mais_altos_associados_a_piora' END AS entry_direction,
  CASE WHEN delta IS NULL THEN 'associacao_indisponivel' WHEN delta > 0 THEN 'valores_mais_altos_associados_a_melhora' ELSE 'valores_mais_baixos_associados_a_melhora' END AS recovery_direction,
  CASE WHEN delta IS NULL THEN 'associacao_indisponivel' WHEN delta < 0 THEN 'valores_mais_baixos_associados_a_melhora' ELSE 'valores_mais_altos_associados_a_melhora' END AS worse_is_better_direction
FROM d
""")
def p29(spark, folder):
    building = F.when(F.col("c_mktsegment") == "BUILDING", F.col("c_acctbal"))
    deltas = table(spark, folder, "customer").groupBy("c_nationkey").agg(
        F.round(F.avg(building) - F.avg("c_acctbal"), 4).alias("delta")
    )
    return deltas.select(
        "c_nationkey", "delta", risk.signal_direction("delta", True, "entry")[0].alias("entry_direction"),
        risk.signal_direction("delta", True, "recovery")[0].alias("recovery_direction"),
        risk.signal_direction("delta", False, "recovery")[0].alias("worse_is_better_direction"),
    )


@query("k10_sanitize", """
SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END AS price, o_orderpriority FROM orders
""")
def k10(spark, folder):
    price = F.when(F.col("o_orderstatus") == "P", float("nan")).otherwise(F.col("o_totalprice"))
    return consolidate.sanitize(table(spark, folder, "orders").select("o_orderkey", price.alias("price"), "o_orderpriority"))


@query("m2_fill_numbers", f"""
WITH {PANEL} SELECT entity, period, CASE WHEN n_orders > 1 THEN min_price ELSE -1 END AS min_price, max_price FROM panel
""")
def m2(spark, folder):
    features = Features(("min_price", "max_price"), ())
    rows = order_panel(spark, folder).withColumn("min_price", F.when(F.col("n_orders") > 1, F.col("min_price")))
    filled = fill_numbers(coerce_features(rows, features, ["entity", "period"]), features)
    return filled.select("entity", "period", F.col("min_price_filled").alias("min_price"), F.col("max_price_filled").alias("max_price"))


# --- payloads, maps, timestamps ----------------------------------------------
@query("f1_payload", """
SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, round(value * 2, 4) AS doubled, event_type FROM events
""")
def f1(spark, folder):
    events = table(spark, folder, "events").select(
        "event_id", "event_type", (F.col("value") * 2).alias("doubled"), payload.payload_field("props", "k").cast("long").alias("k")
    )
    # There and back: one JSON document per event.
    written = payload.to_payload(events, keep=["event_id"])
    schema = T.StructType([f for f in events.schema if f.name != "event_id"])
    return rounded(payload.from_payload(written, schema), "doubled", digits=4)


@query("f3_lookup", """
SELECT event_id, CASE event_type WHEN 'error' THEN 3 WHEN 'click' THEN 1 ELSE 0 END AS severity FROM events
""")
def f3(spark, folder):
    severity = F.create_map(F.lit("error"), F.lit(3), F.lit("click"), F.lit(1))
    return table(spark, folder, "events").select("event_id", payload.lookup(severity, "event_type", 0).alias("severity"))


@query("f4_iso_timestamp", """
SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS at FROM events
""")
def f4(spark, folder):
    return table(spark, folder, "events").select("event_id", payload.iso_timestamp("ts").alias("at"))


@query("f5_normalized_name", """
SELECT page_id, CASE WHEN regexp_matches(name, '.\\.[^.]+$') THEN regexp_replace(name, '\\.[^.]+$', '') ELSE name END || '__normalized_2024.csv' AS file
FROM (SELECT page_id, regexp_extract(url, '[^/]*$') AS name FROM pages)
""")
def f5(spark, folder):
    name = F.regexp_extract("url", "[^/]*$", 0)
    return table(spark, folder, "pages").select("page_id", text.normalized_name(name, F.lit(2024)).alias("file"))
