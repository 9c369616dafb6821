"""Names, words and thresholds that results must agree on.

Everything here is data. Operators take these as default arguments, so other
panels (other column names, other layouts) use the same operators.
"""

from pyspark.sql import types as T

# --- Fixed values: canonical schema, in column order -------------------------
CANONICAL_DDL = """
    ra STRING, ano_referencia INT, fase STRING, turma STRING,
    nome_anonimizado STRING, ano_nascimento DOUBLE, data_nascimento STRING,
    idade DOUBLE, genero STRING, ano_ingresso DOUBLE,
    instituicao_ensino STRING, escola STRING, status_matricula BOOLEAN,
    pedra_20 STRING, pedra_21 STRING, pedra_22 STRING, pedra_23 STRING,
    pedra_atual STRING, inde_22 DOUBLE, inde_23 DOUBLE, inde_atual DOUBLE,
    cg DOUBLE, cf DOUBLE, ct DOUBLE, numero_avaliacoes DOUBLE,
    avaliador_1 STRING, avaliador_2 STRING, avaliador_3 STRING,
    avaliador_4 STRING, avaliador_5 STRING, avaliador_6 STRING,
    rec_av_1 STRING, rec_av_2 STRING, rec_av_3 STRING, rec_av_4 STRING,
    rec_psicologia STRING, iaa DOUBLE, ieg DOUBLE, ips DOUBLE, ipp DOUBLE,
    ida DOUBLE, nota_matematica DOUBLE, nota_portugues DOUBLE,
    nota_ingles DOUBLE, indicado BOOLEAN, atingiu_pv BOOLEAN, ipv DOUBLE,
    ian DOUBLE, fase_ideal STRING, defasagem DOUBLE, destaque_ieg STRING,
    destaque_ida STRING, destaque_ipv STRING, source_schema STRING,
    source_file STRING, source_row_number BIGINT
"""

# --- Fixed values: header labels (already folded) and the canonical column each stands for ---
ALIASES = {
    "ra": "ra", "registro_aluno": "ra",
    "ano_referencia": "ano_referencia", "ano": "ano_referencia", "ano_base": "ano_referencia",
    "fase": "fase",
    "turma": "turma",
    "nome_anonimizado": "nome_anonimizado", "nome": "nome_anonimizado", "nome_aluno": "nome_anonimizado",
    "ano_nascimento": "ano_nascimento", "ano_nasc": "ano_nascimento",
    "data_nascimento": "data_nascimento", "data_de_nasc": "data_nascimento",
    "idade": "idade", "idade_22": "idade", "idade_aluno": "idade",
    "genero": "genero", "sexo": "genero",
    "ano_ingresso": "ano_ingresso",
    "instituicao_ensino": "instituicao_ensino", "instituicao_de_ensino": "instituicao_ensino", "instituicao_de_ensino_aluno": "instituicao_ensino",
    "escola": "escola",
    "status_matricula": "status_matricula", "ativo_inativo": "status_matricula", "ativo_inativo_1": "status_matricula",
    "pedra_20": "pedra_20",
    "pedra_21": "pedra_21",
    "pedra_22": "pedra_22",
    "pedra_23": "pedra_23",
    "pedra_atual": "pedra_atual", "pedra_2023": "pedra_atual", "pedra_2024": "pedra_atual",
    "inde_22": "inde_22",
    "inde_23": "inde_23", "inde_2023": "inde_23",
    "inde_atual": "inde_atual", "inde_2024": "inde_atual",
    "cg": "cg",
    "cf": "cf",
    "ct": "ct",
    "numero_avaliacoes": "numero_avaliacoes", "n_av": "numero_avaliacoes", "n_avs": "numero_avaliacoes", "no_av": "numero_avaliacoes",
    "numero_av": "numero_avaliacoes",
    "avaliador1": "avaliador_1",
    "avaliador2": "avaliador_2",
    "avaliador3": "avaliador_3",
    "avaliador4": "avaliador_4",
    "avaliador5": "avaliador_5",
    "avaliador6": "avaliador_6",
    "rec_av1": "rec_av_1",
    "rec_av2": "rec_av_2",
    "rec_av3": "rec_av_3",
    "rec_av4": "rec_av_4",
    "rec_psicologia": "rec_psicologia",
    "iaa": "iaa",
    "ieg": "ieg",
    "ips": "ips",
    "ipp": "ipp",
    "ida": "ida",
    "nota_matematica": "nota_matematica", "mat": "nota_matematica", "matem": "nota_matematica", "matematica": "nota_matematica",
    "nota_portugues": "nota_portugues", "por": "nota_portugues", "portug": "nota_portugues", "portugues": "nota_portugues",
    "nota_ingles": "nota_ingles", "ing": "nota_ingles", "ingles": "nota_ingles",
    "indicado": "indicado",
    "atingiu_pv": "atingiu_pv",
    "ipv": "ipv",
    "ian": "ian",
    "fase_ideal": "fase_ideal",
    "defasagem": "defasagem", "defas": "defasagem",
    "destaque_ieg": "destaque_ieg",
    "destaque_ida": "destaque_ida",
    "destaque_ipv": "destaque_ipv", "destaque_ipv_1": "destaque_ipv",
    "source_schema": "source_schema",
    "source_file": "source_file",
    "source_row_number": "source_row_number",
}

# --- Fixed values: layouts in registry order: name, fallback period, signature
LAYOUTS = (
    ("pede_2024_like", 2024, ("escola", "ativo_inativo", "inde_2024")),
    ("pede_2023_like", 2023, ("inde_2023", "pedra_2023", "defasagem")),
    ("pede_2022_like", 2022, ("idade_22", "ano_nasc", "matem", "portug", "defas")),
)

# --- Fixed values: words and tokens ------------------------------------------
REQUIRED_COLUMNS = ("ra", "fase")
TRUE_WORDS = ("sim", "true", "1", "yes", "y", "cursando")
FALSE_WORDS = ("nao", "false", "0", "no", "n", "inativo")
MISSING_CATEGORY = "<NA>"
# Text a CSV reader takes as missing (the documented pandas defaults).
NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)
# Period -> (column filled when empty in the whole file, column it is filled from).
WHOLE_FILE_FALLBACK = {2022: ("inde_atual", "inde_22"), 2023: ("inde_atual", "inde_23")}

# --- Fixed values: feature sets ----------------------------------------------
CATEGORICAL_FEATURES = ("fase", "turma", "genero", "instituicao_ensino", "fase_ideal")
STRATEGY_A = (
    "fase", "turma", "idade", "genero", "ano_ingresso", "instituicao_ensino", "numero_avaliacoes",
    "inde_atual", "iaa", "ieg", "ips", "ida", "nota_matematica", "nota_portugues", "nota_ingles", "ipv",
)
STRATEGY_B = STRATEGY_A + ("ian", "fase_ideal", "ipp", "flag_ipp_ausente")
NUMERIC_SUMMARY_COLUMNS = (
    "inde_atual", "ipv", "ian", "ipp", "ida", "nota_matematica", "nota_portugues", "nota_ingles",
    "ieg", "ips", "iaa", "numero_avaliacoes", "idade",
)
CATEGORICAL_SUMMARY_COLUMNS = ("fase", "fase_ideal", "instituicao_ensino", "genero")

# --- Fixed values: names of models, segments, groups -------------------------
BASELINE_MODEL = "baseline_persistencia"
BASELINE_STRATEGY = "baseline_current_defasagem"
SEGMENT_STRATEGY = "strategy_b_segmented"
ENTRY_LABEL = "entrada_em_risco"
RECOVERY_LABEL = "recuperacao"
GROUP_LOW = "ja_defasado"
GROUP_OK = "nao_defasado"
MODEL_ID_SEPARATOR = "__"

# --- Fixed values: thresholds ------------------------------------------------
DECISION_THRESHOLD = 0.5
PSI_ALERT = 0.2
MEAN_SHIFT_SHARE = 0.25
MEAN_SHIFT_FLOOR = 0.5
TOTAL_VARIATION_ALERT = 0.2
NEW_CATEGORY_ALERT = 0.1
SHARE_FLOOR = 1e-6
HIGH_PRIORITY = 0.8
SCORE_BIN_EDGES = (0.2, 0.4, 0.6, 0.8)

# --- Fixed values: actionable features: name, label, hint (higher is better) --
ACTIONABLE = (
    ("ida", "IDA", "reforço acadêmico dirigido e acompanhamento das notas"),
    ("nota_matematica", "Nota de matemática", "reforço em matemática e revisão de lacunas de conteúdo"),
    ("nota_portugues", "Nota de português", "reforço em leitura, escrita e interpretação"),
    ("nota_ingles", "Nota de inglês", "apoio pedagógico complementar em inglês"),
    ("ieg", "IEG", "aumentar engajamento, participação e vínculo com as atividades"),
    ("iaa", "IAA", "trabalhar percepção de pertencimento, autoestima e relação com os estudos"),
    ("ips", "IPS", "fortalecer acompanhamento psicossocial e suporte emocional"),
    ("ipp", "IPP", "intensificar acompanhamento psicopedagógico e estratégias de aprendizagem"),
    ("ipv", "IPV", "estimular continuidade de evolução e acompanhamento longitudinal"),
    ("numero_avaliacoes", "Número de avaliações", "aumentar frequência de acompanhamento e registro do progresso"),
)
DIRECTION_UNAVAILABLE = "associacao_indisponivel"
INTERPRETATION_UNAVAILABLE = "sem evidência numérica adicional suficiente nesta execução"
DIRECTION_LOW_WORSE = "valores_mais_baixos_associados_a_piora"
DIRECTION_HIGH_WORSE = "valores_mais_altos_associados_a_piora"
DIRECTION_LOW_BETTER = "valores_mais_baixos_associados_a_melhora"
DIRECTION_HIGH_BETTER = "valores_mais_altos_associados_a_melhora"
INTERPRETATION_LOW_WORSE = "valores mais baixos parecem associados a maior chance de piora"
INTERPRETATION_HIGH_WORSE = "valores mais altos parecem associados a maior chance de piora"
INTERPRETATION_LOW_BETTER = "valores mais baixos parecem associados a maior chance de melhora"
INTERPRETATION_HIGH_BETTER = "valores mais altos parecem associados a maior chance de melhora"

# --- Fixed values: output columns of a scored batch --------------------------
PREDICTION = "prediction_risco_defasagem_futura"
PROBABILITY = "probabilidade_risco_defasagem_futura"
MODEL_USED = "modelo_utilizado"
STRATEGY_USED = "estrategia_utilizada"
STATE_NOW = "atualmente_defasado"
GROUP_NOW = "grupo_baseline_atual"
ENTRY_SCORE = "score_entrada_em_risco"
RECOVERY_SCORE = "score_recuperacao"
PERSISTENCE_SCORE = "score_persistencia_defasagem"
RELEVANT_SCORE = "score_transicao_relevante"
RELEVANT_TYPE = "tipo_transicao_relevante"
ACTUAL = "real_risco_defasagem"
HIT = "acerto"

# --- Derived -----------------------------------------------------------------
_TYPES = {
    "STRING": T.StringType(), "INT": T.IntegerType(), "DOUBLE": T.DoubleType(), "BOOLEAN": T.BooleanType(),
    "BIGINT": T.LongType(),
}
CANONICAL = T.StructType([
    T.StructField(name, _TYPES[kind]) for name, kind in (field.split() for field in CANONICAL_DDL.split(","))
])
KEY = ("ra", "ano_referencia")

# Notes that go with the actionable signals.
INSIGHT_NOTES = (
    "As variáveis listadas aqui foram filtradas para destacar apenas sinais mais acionáveis pela operação pedagógica e psicossocial.",
    "Foram removidos proxies estruturais como fase, fase ideal, IAN e defasagem, porque eles descrevem muito diretamente o próprio atraso escolar.",
    "Esses sinais ajudam a priorizar intervenção, mas não devem ser tratados como prova causal isolada.",
)
