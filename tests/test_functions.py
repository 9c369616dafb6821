import unicodedata

import pytest
from pyspark.sql import functions as F

from panelwise.functions import payload, risk, text


def values(spark, rows, expression, kind="string"):
    frame = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, t {kind}")
    return [r.v for r in frame.select("i", expression.alias("v")).orderBy("i").collect()]


def python_fold(label):
    plain = unicodedata.normalize("NFKD", label).encode("ascii", "ignore").decode("ascii").strip().lower()
    return "_".join(w for w in "".join(c if c in "abcdefghijklmnopqrstuvwxyz0123456789" else " " for c in plain).split())


LABELS = ["Instituição de ensino", "Ativo/ Inativo", " INDE 22 ", "Nº Av", "ﬁnal ½ ™", "straße", "ａｂｃ", "é", "", "__a__", "½", "Ⅳ Ⅷ", "𝐀b", "한국 x"]


def test_fold_label_on_headers_and_columns(spark):
    assert [text.ascii_label(x) for x in LABELS] == [python_fold(x) for x in LABELS]
    assert values(spark, LABELS, text.fold_label("t")) == [python_fold(x) for x in LABELS]
    assert text.ascii_label("Instituição de ensino") == "instituicao_de_ensino"


def test_fold_label_equals_the_rule_on_every_character_that_decomposes(spark):
    points = [p for p in range(128, 0x3400) if not 0xD800 <= p <= 0xDFFF]
    labels = [f"a{chr(p)}b" for p in points]
    assert values(spark, labels, text.fold_label("t")) == [python_fold(x) for x in labels]


def test_parse_number(spark):
    rows = ["1.234,56", "1,234.56", "1.234", " 7,5 ", "5", "-0,5", "1d", "1f", "0x1F", "1_000", "", "abc", "1,2,3", "1e3", "inf", "nan", None, "+3", ".5", "5.", " 8,1"]
    expected = [1234.56, 1.23456, 1.234, 7.5, 5.0, -0.5, None, None, None, None, None, None, None, 1000.0, float("inf"), None, None, 3.0, 0.5, 5.0, 8.1]
    assert values(spark, rows, text.parse_number("t")) == expected


def test_heuristic_number(spark):
    rows = ["1.234,56", "1,234.56", "1.234.567", "1.234", "R$ 5,50", "12%", "1,5", "abc", "-3", "1.23", "1,2,3", "1 000", "1e3"]
    expected = [1234.56, 1234.56, 1234567.0, 1234.0, 5.5, 12.0, 1.5, None, -3.0, 1.23, None, 1000.0, None]
    assert values(spark, rows, text.parse_number("t", "heuristic")) == expected
    with pytest.raises(ValueError):
        text.parse_number("t", "other")


def test_parse_bool_and_category(spark):
    rows = ["Sim", "NÃO", " Cursando ", "inativo", "1", "0", "1.0", "talvez", None]
    assert values(spark, rows, text.parse_bool("t")) == [True, False, True, False, True, False, None, None, None]
    assert values(spark, ["a", None], text.category("t")) == ["a", "<NA>"]
    assert values(spark, ["NA", "", "a", None, "null"], text.null_tokens("t")) == [None, None, "a", None, None]


def test_infer_period_and_names(spark):
    names = ["x_2023.csv", "x.csv", "a2099b2001", "1999.csv"]
    assert values(spark, names, text.infer_period(None, "t", 2022)) == [2023, 2022, 2099, 2022]
    assert values(spark, names[:1], text.infer_period(2020, "t", 2022)) == [2020]
    assert values(spark, names[:1], text.infer_period(0, "t", 2022)) == [2023]
    assert values(spark, ["a.b.csv", "plain", ".hidden"], text.normalized_name("t", F.lit(2024))) == [
        "a.b__normalized_2024.csv", "plain__normalized_2024.csv", ".hidden__normalized_2024.csv"]


def test_model_id_round_trip(spark):
    name, strategy = text.split_model_id("t")
    ids = ["random_forest__strategy_b", "a__b__c", "alone"]
    assert values(spark, ids, name) == ["random_forest", "a", "alone"]
    assert values(spark, ids, strategy) == ["strategy_b", "b__c", ""]


def test_states_rules_and_decisions(spark):
    levels = [-1.0, 0.0, 2.0, None]
    assert values(spark, levels, risk.baseline_predict("t"), "double") == [1, 0, 0, 0]
    assert values(spark, levels, risk.state_now("t"), "double") == [True, False, False, None]
    assert values(spark, levels, risk.state_group("t"), "double") == ["ja_defasado", "nao_defasado", "nao_defasado", None]
    assert values(spark, [0.49, 0.5, None], risk.decide("t"), "double") == [0, 1, None]
    assert values(spark, [0.2, 0.19, 1.0, None, float("nan"), 0.6], risk.score_bin("t"), "double") == [1, 0, 4, None, None, 3]


def test_signal_direction_zero_takes_the_other_side(spark):
    deltas = [-1.0, 0.0, 1.0, None]
    low, high = "valores_mais_baixos_associados_a_", "valores_mais_altos_associados_a_"
    expected = {
        (True, "entry"): [low + "piora", high + "piora", high + "piora"],
        (True, "recovery"): [low + "melhora", low + "melhora", high + "melhora"],
        (False, "entry"): [low + "piora", low + "piora", high + "piora"],
        (False, "recovery"): [low + "melhora", high + "melhora", high + "melhora"],
    }
    for (better, scenario), want in expected.items():
        direction, _ = risk.signal_direction("t", better, scenario)
        assert values(spark, deltas, direction, "double") == [*want, "associacao_indisponivel"]


def test_payload_keeps_nulls(spark):
    rows = spark.createDataFrame([(1, None, 2.5), (2, "é", None)], "id int, name string, x double")
    written = payload.to_payload(rows, keep=["id"])
    assert written.orderBy("id").first().payload == '{"name":null,"x":2.5}'
    back = payload.from_payload(written, rows.drop("id").schema)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, rows.collect()))


def test_natural_key_orders_digits_by_value(spark):
    cells = ["b2", "B10", "á", "a1", "b02"]
    keys = dict(zip(cells, values(spark, cells, text.natural_key("t"))))
    assert keys["b2"] < keys["B10"] and keys["á"] < keys["a1"] and keys["b2"] == keys["b02"]
