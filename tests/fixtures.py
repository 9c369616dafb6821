"""Small inputs with results worked out by hand."""

CSV_2022 = (
    "Turma;RA;Fase;Defas;Matem;Portug;INDE 22;Idade 22;Gênero;IDA;Instituição de ensino;Ano ingresso\n"
    'C;E-41;3;-2;"6,25";"5,5";"6,108";13;Menino;"5,9";Rede Privada;2019\n'
)
CSV_2024 = (
    "Fase;RA;Escola;INDE 2024;IPP;Idade;Ativo/ Inativo;Ing;Defasagem;Turma\n"
    'BETA;E-70;Escola Sul;"8,04";"4,75";11;Cursando;;1;BETA 2\n'
)

# Fifteen rows: five entities over three years; the level is below zero for the second and the fourth.
LEVELS = {2021: (0, -1, 2, -3, 1), 2022: (1, -2, 0, -1, 3), 2023: (0, -1, 1, -2, 0)}


def panel_rows():
    rows = []
    for year, levels in LEVELS.items():
        for i, level in enumerate(levels, start=1):
            rows.append({
                "ra": f"E-{i}", "ano_referencia": year, "fase": f"{1 + i % 3}", "turma": "XYZ"[i % 3], "idade": 9.5 + 2 * i,
                "genero": ("Menina", "Menino")[i % 2], "ano_ingresso": 2015.0 + i, "instituicao_ensino": ("Rede Sul", "Rede Norte")[i // 3],
                "numero_avaliacoes": 1.0 + i % 4, "inde_atual": 8.0 - i / 3, "iaa": 5.0 + i / 7, "ieg": 9.0 - i / 5,
                "ips": 4.0 + i / 3, "ipp": None if year == 2021 else 8.5 - i / 4, "ida": 6.5 - i / 6,
                "nota_matematica": 9.0 - i / 2, "nota_portugues": 6.0 + i / 9, "nota_ingles": 7.0 - i / 8, "ipv": 5.0 + i / 6,
                "ian": 10.0 - i, "fase_ideal": f"Fase {2 + i % 3}", "defasagem": float(level),
                "source_schema": "made", "source_file": f"made_{year}.csv", "source_row_number": i,
            })
    return rows


def panel(spark):
    from panelwise import fixed
    from panelwise.operators.normalize import conform
    from pyspark.sql import types as T

    rows = panel_rows()
    schema = T.StructType([f for f in fixed.CANONICAL if f.name in rows[0]])
    return conform(spark.createDataFrame([tuple(r[f.name] for f in schema) for r in rows], schema), fixed.CANONICAL)
