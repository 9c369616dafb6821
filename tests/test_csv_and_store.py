import os
import random

import pytest
from pyspark.sql import functions as F

import fixtures
from panelwise import fixed
from panelwise.operators.normalize import NormalizationError, dedupe_columns, detect_layout, layout_column, resolve_header
from panelwise.plans.ingest import bootstrap, ingest, ingest_file, status
from panelwise.sources.exports import export_csv, export_json, export_per_model
from panelwise.sources.layout_csv import list_csv, read_files, read_layout_csv, read_quoted, read_raw, sniff
from panelwise.streaming.ingest_stream import ingest_stream


def write(folder, name, text, encoding="utf-8"):
    path = os.path.join(str(folder), name)
    with open(path, "wb") as f:
        f.write(text.encode(encoding))
    return path


def test_2022_layout(spark, tmp_path):
    file = read_layout_csv(spark, write(tmp_path, "lote 2022 ação.csv", fixtures.CSV_2022))
    assert (file.layout, file.period, file.unknown) == ("pede_2022_like", 2022, ())
    row = file.rows.first()
    assert [(f.name, f.dataType) for f in file.rows.schema] == [(f.name, f.dataType) for f in fixed.CANONICAL]
    assert (row.ra, row.idade, row.nota_matematica, row.defasagem, row.inde_atual) == ("E-41", 13.0, 6.25, -2.0, 6.108)
    assert (row.fase, row.source_row_number, row.source_file, row.ano_referencia) == ("3", 1, "lote 2022 ação.csv", 2022)


def test_2024_layout(spark, tmp_path):
    file = read_layout_csv(spark, write(tmp_path, "lote_b_2024.csv", fixtures.CSV_2024))
    row = file.rows.first()
    assert (file.layout, row.status_matricula, row.ipp, row.inde_atual, row.nota_ingles) == ("pede_2024_like", True, 4.75, 8.04, None)
    assert file.renamed["Ativo/ Inativo"] == "status_matricula"


@pytest.mark.parametrize("encoding", ["utf-8", "utf-8-sig", "latin1"])
@pytest.mark.parametrize("separator", [",", ";"])
def test_encodings_and_separators(spark, tmp_path, encoding, separator):
    header = ["RA", "Fase", "INDE 2024", "Escola", "Gênero", "Observação"]
    rows = [["1", "A", '"7,5"', '"Colégio ""Sol"", Açaí"', "Não", "x"], ["2", "NA", "8", "Água", "", "y"]]
    text = "\r\n".join(separator.join(line) for line in [header, *rows]) + "\r\n"
    file = read_layout_csv(spark, write(tmp_path, "b.csv", text, encoding))
    found = file.rows.orderBy("source_row_number").collect()
    assert file.unknown == ("Observação",) and file.period == 2024
    assert [(r.ra, r.fase, r.inde_atual, r.escola, r.genero) for r in found] == [
        ("1", "A", 7.5, 'Colégio "Sol", Açaí', "Não"), ("2", None, 8.0, "Água", None)]


def test_quoted_line_breaks(spark, tmp_path):
    text = 'RA,Fase,INDE 2024,Escola\n1,A,7,"two\nlines"\n2,B,8,one\n'
    rows = read_layout_csv(spark, write(tmp_path, "m.csv", text)).rows.orderBy("source_row_number").collect()
    assert [(r.ra, r.escola, r.source_row_number) for r in rows] == [("1", "two\nlines", 1), ("2", "one", 2)]


def random_cells(chance, separator):
    plain = ["", "a", "Ação", "12\" pipe", "x y", "5,5" if separator == ";" else "5;5", " pad "]
    quoted = ["two\nlines", f"a{separator}b", 'say "hi"', "\n\n", f"end{separator}\n", '""', "", "tail\n"]
    cell = lambda: '"' + chance.choice(quoted).replace('"', '""') + '"' if chance.random() < 0.3 else chance.choice(plain)
    return [cell() for _ in range(3)]


@pytest.mark.parametrize("seed", range(4))
def test_quoted_line_breaks_over_many_splits(spark, tmp_path, seed):
    """The rows that a reader of whole files finds, from many splits that begin anywhere; blank lines between them."""
    chance, separator = random.Random(seed), ",;"[seed % 2]
    names = []
    for name in ("a.csv", "b.csv"):
        lines = [separator.join(["RA", "Fase", "INDE 2024", "Escola"])]
        for i in range(400):
            lines.append(separator.join([str(i), *random_cells(chance, separator)]))
            if chance.random() < 0.1:
                lines.append("")
        end = chance.choice(["\n", "", "\n\n"])
        names.append(write(tmp_path, name, "\n".join(lines) + end))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        files = sniff(spark, list_csv(spark, str(tmp_path)))
        assert all(f.multi_line for f in files)
        got = read_quoted(spark, files)
        assert spark.read.text([f.path for f in files]).rdd.getNumPartitions() > 10
        found = sorted((r._file, r._row, r._c0, r._c1, r._c2, r._c3) for r in got.collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old[0])
        spark.conf.set("spark.sql.files.openCostInBytes", old[1])
    want = []
    for file in files:
        whole = spark.read.options(header=True, sep=separator, quote='"', escape='"', multiLine=True).schema("_c0 string, _c1 string, _c2 string, _c3 string").csv(file.path)
        want += [(file.name, i, *r) for i, r in enumerate(whole.collect(), 1)]
    assert found == sorted(want) and len(found) == 800


def test_one_odd_quote_keeps_many_tasks(spark, tmp_path):
    """A quoted line break early in a long file; an unclosed quote later takes the rest of the file into its field."""
    lines = ["RA,Fase,INDE 2024", '0,"a\nb",1', *(f"{i},A,{i}" for i in range(1, 3000)), '3000,"open,1', "3001,A,1"]
    write(tmp_path, "o.csv", "\n".join(lines) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # small as the file is
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        rows = read_quoted(spark, sniff(spark, list_csv(spark, str(tmp_path))))
        tasks = rows.select(F.spark_partition_id()).distinct().count()
        found = {r._row: tuple(r)[:3] for r in rows.collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.files.maxPartitionBytes", old[0])
        spark.conf.set("spark.sql.files.openCostInBytes", old[1])
    assert len(found) == 3001 and found[1] == ("0", "a\nb", "1") and found[2] == ("1", "A", "1") and found[3000] == ("2999", "A", "2999")
    assert found[3001][0] == "3000" and found[3001][1].startswith("open,1\n3001") and tasks > 3


def test_row_numbers_over_many_splits(spark, tmp_path):
    lines = "".join(f"{i},A,{i}\n" for i in range(1, 20001))
    for name in ("a.csv", "b.csv"):
        write(tmp_path, name, "RA,Fase,INDE 2024\n" + lines)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        raw = read_raw(spark, sniff(spark, list_csv(spark, str(tmp_path))))
        assert raw.rdd.getNumPartitions() >= 2
        wrong = raw.where(F.col("_c0").cast("long") != F.col("_row"))
        assert (raw.count(), wrong.count()) == (40000, 0)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_header_rules():
    header = resolve_header(["RA", "Fase", "Ativo/ Inativo", "Ativo/ Inativo", "INDE 2024", "Mystery", "avaliador_1"])
    assert header.names == ("ra", "fase", "status_matricula", "status_matricula", "inde_atual", "mystery", "avaliador_1")
    assert header.unknown == ("Mystery", "avaliador_1")
    with pytest.raises(NormalizationError, match="required"):
        resolve_header(["INDE 2024", "Fase"])
    with pytest.raises(NormalizationError, match="no known layout"):
        resolve_header(["RA", "Fase"])


def test_layout_ties_take_the_earlier_layout(spark):
    labels = ["escola", "inde_2023", "matem"]
    assert detect_layout(labels)[0] == "pede_2024_like" and detect_layout(["x"]) is None
    assert detect_layout(["matem", "portug", "defasagem"])[0] == "pede_2022_like"
    frame = spark.createDataFrame([(labels,), (["x"],), (["matem", "portug", "defasagem"],)], "l array<string>")
    name, score = layout_column(F.col("l"), fixed.LAYOUTS)
    assert [tuple(r) for r in frame.select(name, score).collect()] == [("pede_2024_like", 1), (None, 0), ("pede_2022_like", 2)]


def test_first_of_repeated_columns_stays(spark):
    frame = spark.createDataFrame([(1, 2, 3, "f")], "a int, b int, c int, _file string")
    found = dedupe_columns(frame, ["x", "y", "x"])
    assert found.columns == ["x", "y", "_file"] and tuple(found.first()) == (1, 2, "f")


def test_whole_file_fallback_uses_the_file_not_the_batch(spark, tmp_path):
    write(tmp_path, "a_2023.csv", "RA,Fase,INDE 2023,Pedra 2023,Inde Atual\n1,A,5,q,\n2,A,6,q,\n")
    write(tmp_path, "b_2023.csv", "RA,Fase,INDE 2023,Pedra 2023,Inde Atual\n3,A,5,q,9\n4,A,6,q,\n")
    rows = read_files(spark, sniff(spark, list_csv(spark, str(tmp_path)))).orderBy("ra").collect()
    assert [r.inde_atual for r in rows] == [5.0, 6.0, 9.0, None]


def test_ingest_twice(spark, store):
    rows = spark.createDataFrame(
        [("E-7", 2019, "2", "t", "u.csv", 1), ("E-9", 2019, "4", "t", "u.csv", 2)],
        "ra string, ano_referencia int, fase string, source_schema string, source_file string, source_row_number int",
    )
    assert store.load_consolidated().columns == [f.name for f in fixed.CANONICAL] and store.data_version() == "v0-r0"
    first, second = ingest(store, rows, {}), ingest(store, rows, {})
    assert (first["inserted_rows"], first["duplicate_rows"], first["data_version"]) == (2, 0, "v1-r2")
    assert (second["inserted_rows"], second["duplicate_rows"], second["data_version"]) == (0, 2, "v2-r2")
    assert [r.ra for r in store.load_consolidated().collect()] == ["E-7", "E-9"]
    report = status(store).first()
    assert (report.rows, report.entities, report.periods, report.data_version) == (2, 2, [2019], "v2-r2")
    assert report.latest_ingestion.duplicate_rows == 2
    assert store.recent_events().count() == 2


def folder_of_three(tmp_path):
    folder = tmp_path / "raw"
    folder.mkdir()
    write(folder, "a_2022.csv", fixtures.CSV_2022 + fixtures.CSV_2022.split("\n")[1] + "\n")
    write(folder, "b_2022.csv", fixtures.CSV_2022.replace("E-41;3", "E-41;4") + "D;E-42;5;0;7;8;9;14;Menina;6;Rede;2020\n")
    write(folder, "c_2024.csv", fixtures.CSV_2024)
    return folder


def test_folder_load_equals_one_file_after_the_other(spark, store, tmp_path):
    from panelwise.sources.store import Store

    folder = folder_of_three(tmp_path)
    runs = bootstrap(store, str(folder))
    other = Store(spark, str(tmp_path / "other"))
    singles = [ingest_file(other, path) for path in list_csv(spark, str(folder))]
    keys = ["id", "source_file", "detected_schema", "reference_year", "input_rows", "inserted_rows", "duplicate_rows", "data_version"]
    assert [[r[k] for k in keys] for r in runs] == [[r[k] for k in keys] for r in singles]
    assert [(r["input_rows"], r["inserted_rows"]) for r in runs] == [(2, 1), (2, 1), (1, 1)]
    contents = lambda s: [tuple(r) for r in s.load_consolidated().collect()]
    assert contents(store) == contents(other) and len(contents(store)) == 3
    assert [r["inserted_rows"] for r in bootstrap(store, str(folder))] == [0, 0, 0]


def test_stream_picks_up_new_files_once(spark, store, tmp_path):
    folder = folder_of_three(tmp_path)
    checkpoint = str(tmp_path / "checkpoint")
    ingest_stream(store, str(folder), checkpoint).awaitTermination()
    assert store.records().count() == 3 and store.runs("ingestion_runs").count() == 3
    ingest_stream(store, str(folder), checkpoint).awaitTermination()
    assert store.runs("ingestion_runs").count() == 3
    write(folder, "d_2024.csv", fixtures.CSV_2024.replace("E-70", "E-71"))
    ingest_stream(store, str(folder), checkpoint).awaitTermination()
    assert store.records().count() == 4 and store.runs("ingestion_runs").count() == 4


def test_repeated_batch_adds_no_runs(spark, store, tmp_path):
    folder, checkpoint = folder_of_three(tmp_path), tmp_path / "checkpoint"
    ingest_stream(store, str(folder), str(checkpoint)).awaitTermination()
    before = sorted(map(tuple, store.runs("ingestion_runs").collect()))
    for commit in (checkpoint / "commits").iterdir():  # as if the query had stopped before the batch was marked done
        if commit.name.strip(".").split(".")[0].isdigit():
            commit.unlink()
    ingest_stream(store, str(folder), str(checkpoint)).awaitTermination()
    assert sorted(map(tuple, store.runs("ingestion_runs").collect())) == before and len(before) == 3


@pytest.mark.parametrize("name", ["dados 2022 ação.csv", "a%20b_2022.csv", "x+y 2022.csv", "n#1_2022.csv"])
def test_file_names(spark, store, tmp_path, name):
    write(tmp_path, name, fixtures.CSV_2022)
    assert read_layout_csv(spark, str(tmp_path / name)).rows.first().source_file == name
    assert [(r["source_file"], r["inserted_rows"]) for r in bootstrap(store, str(tmp_path))] == [(name, 1)]


def test_equal_names_in_two_folders(spark, tmp_path):
    paths = []
    for folder, encoding, name in (("one", "utf-8", "Açaí"), ("two", "latin1", "Pé")):
        (tmp_path / folder).mkdir()
        paths.append(write(tmp_path / folder, "same_2024.csv", f"RA,Fase,INDE 2024,Escola\n{folder},A,7,{name}\n", encoding))
    rows = read_files(spark, sniff(spark, paths)).collect()
    assert sorted((r.ra, r.escola, r.source_row_number) for r in rows) == [("one", "Açaí", 1), ("two", "Pé", 1)]


def test_surplus_fields_and_empty_files_fail(spark, tmp_path):
    wide = write(tmp_path, "w_2024.csv", "RA,Fase,INDE 2024\n1,A,7\n2,B,8,9\n")
    with pytest.raises(Exception, match="more fields than the header of w_2024.csv"):
        read_layout_csv(spark, wide).rows.count()
    (tmp_path / "folder").mkdir()
    write(tmp_path / "folder", "a_2024.csv", "RA,Fase,INDE 2024\n1,A,7\n")
    write(tmp_path / "folder", "b_2024.csv", "")
    with pytest.raises(NormalizationError, match="b_2024.csv is empty"):
        sniff(spark, list_csv(spark, str(tmp_path / "folder")))


def test_period_filter_prunes_folders(spark, store):
    store.append_records(fixtures.panel(spark), 1)
    plan = store.records().where("ano_referencia = 2022").select("ra")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(ano_referencia" in plan and "ReadSchema: struct<ra:string>" in plan


def test_normalized_export(spark, tmp_path):
    from panelwise.plans.monitor import export_normalized

    file = read_layout_csv(spark, write(tmp_path, "lote.a_2022.csv", fixtures.CSV_2022))
    path = export_normalized(file, str(tmp_path / "out"))
    assert path.endswith("/lote.a_2022__normalized_2022.csv")
    row = spark.read.csv(path, header=True).first()
    assert len(row) == 56 and (row.ra, row.inde_atual, row.escola) == ("E-41", "6.108", None)


def test_exports(spark, tmp_path):
    frame = spark.createDataFrame([("m__a", 1, None), ("m__b", 2, "é")], "model_id string, n int, t string")
    assert spark.read.csv(export_csv(frame, str(tmp_path / "c")), header=True).count() == 2
    empty = export_csv(frame.limit(0), str(tmp_path / "e"))
    assert spark.read.csv(empty, header=True).columns == ["model_id", "n", "t"]
    stamped = frame.withColumn("at", F.lit("2024-01-02 03:04:05").cast("timestamp"))
    lines = spark.read.text(export_json(stamped, str(tmp_path / "j"))).collect()
    assert any('"t":null' in r.value and '"at":"2024-01-02T03:04:05.000000"' in r.value for r in lines)
    path = export_per_model(frame, str(tmp_path / "p"))
    assert spark.read.csv(f"{path}/_model=m__b", header=True).first().n == "2"
