"""Ingest normalised rows into the store, one file, many files, or a folder."""

from pyspark.sql import DataFrame, functions as F

from panelwise.frames import per_group
from panelwise.operators.consolidate import data_status, ingest_summary, to_insert
from panelwise.operators.normalize import NormalizationError, conform, period_of
from panelwise.operators.runs import latest
from panelwise.sources.layout_csv import LayoutFile, base_name, list_csv, read_files, read_layout_csv, sniff
from panelwise.sources.store import Store


def stored_keys(store: Store, periods: list[int]) -> DataFrame:
    """Stored keys of the periods at hand: only those folders are read."""
    return store.records().where(F.col(store.period).isin(*periods)).select(store.entity, store.period)


def ingest(store: Store, df: DataFrame, about: dict) -> dict:
    """Add the rows whose key is new; returns the recorded run.

    Of the store, only the incoming rows' periods are read. The totals that describe the whole store are those of the
    last run with what this one adds.
    """
    run_id = store.next_id("ingestion_runs")
    rows, before = conform(df, store.schema), store.total_rows()
    arrived = {r.p: r.n for r in rows.groupBy(F.col(store.period).try_cast("int").alias("p")).agg(F.count("*").alias("n")).collect()}
    periods = [p for p in arrived if p is not None]
    store.append_records(to_insert(rows, stored_keys(store, periods), store.entity, store.period), run_id)
    by_period = inserted_by_period(store, periods, run_id)
    total, inserted = sum(arrived.values()), sum(by_period.values())
    run = {
        "id": run_id, "source_file": about.get("source_file"), "detected_schema": about.get("detected_schema"),
        "reference_year": about.get("reference_year"), "input_rows": total, "inserted_rows": inserted,
        "duplicate_rows": total - inserted, "unknown_columns": list(about.get("unknown_columns", ())),
        "data_version": f"v{run_id}-r{before + inserted}", "total_rows": before + inserted, "rows_by_period": by_period,
    }
    store.append_run("ingestion_runs", run)
    store.record_event("INFO", "ingest", "rows ingested", {k: v for k, v in run.items() if k != "unknown_columns"})
    return run


def inserted_by_period(store: Store, periods: list[int], run_id: int) -> dict[int, int]:
    """Rows of one run as they are stored, per period: a few numbers, from the folders of these periods."""
    mine = store.records().where(F.col(store.period).isin(*periods) & (F.col("ingestion_run_id") == run_id))
    return {r.p: r.n for r in mine.groupBy(F.col(store.period).alias("p")).agg(F.count("*").alias("n")).collect()}


def ingest_file(store: Store, path: str, period: int | None = None) -> dict:
    file: LayoutFile = read_layout_csv(store.spark, path, period)
    return ingest(store, file.rows, {
        "source_file": file.name, "detected_schema": file.layout, "reference_year": file.period,
        "unknown_columns": file.unknown,
    })


def bootstrap(store: Store, folder: str, period: int | None = None) -> list[dict]:
    """Load a folder as if its files came one by one in name order, with one scan, one duplicate
    removal and one write for all of them."""
    return ingest_files(store, list_csv(store.spark, folder), period)


def ingest_files(store: Store, paths: list[str], period: int | None = None, stream_batch: str | None = None) -> list[dict]:
    """The files at these paths, whose names differ, in name order; returns the recorded runs."""
    if not paths:
        return []
    spark = store.spark
    files = sniff(spark, sorted(paths, key=base_name))
    if len({f.name for f in files}) < len(files):
        raise NormalizationError("two files of one name cannot be told apart in the store")
    rows = read_files(spark, files, period)
    first_id = store.next_id("ingestion_runs")
    periods = {f.name: period_of(f.name, f.header.fallback_period, period) for f in files}
    known, years = store.total_rows(), sorted(set(periods.values()))
    added = to_insert(rows, stored_keys(store, years), store.entity, store.period)
    ids = spark.createDataFrame(
        [(f.name, first_id + i) for i, f in enumerate(files)], "source_file string, ingestion_run_id long"
    )
    stamped = added.join(per_group(ids, len(files)), "source_file").select(*store.schema.names, "ingestion_run_id")
    store.write_records(stamped)
    mine = store.records().where(F.col(store.period).isin(*years) & (F.col("ingestion_run_id") >= first_id))
    counted = {r.source_file: r for r in ingest_summary(rows, mine, ["source_file"]).collect()}
    runs = []
    for i, file in enumerate(files):
        c = counted.get(file.name)
        inserted = c.inserted_rows if c else 0
        known += inserted
        runs.append({
            "id": first_id + i, "source_file": file.name, "detected_schema": file.header.layout,
            "reference_year": periods[file.name], "input_rows": c.input_rows if c else 0, "inserted_rows": inserted,
            "duplicate_rows": c.duplicate_rows if c else 0, "unknown_columns": list(file.header.unknown),
            "data_version": f"v{first_id + i}-r{known}", "stream_batch": stream_batch,
            "total_rows": known, "rows_by_period": {periods[file.name]: inserted} if inserted else {},
        })
    store.append_runs("ingestion_runs", runs)
    store.record_event("INFO", "ingest", "folder loaded", {"files": len(files)})
    return runs


def status(store: Store) -> DataFrame:
    """State of the consolidated table and the last ingestion, one row.

    Rows and periods are added up from the runs; only the number of distinct entities is counted in the store.
    """
    runs = store.runs("ingestion_runs")
    last = latest(runs)
    fields = ["id", "source_file", "reference_year", "inserted_rows", "duplicate_rows", "created_at"]
    facts = {"data_version": F.lit(store.data_version()), "latest_ingestion": last.select(F.struct(*fields)).scalar()}
    if runs.where(F.col("rows_by_period").isNull()).limit(1).count():  # runs from before these were kept
        return data_status(store.records(), store.entity, store.period).withColumns(facts)
    kept = runs.select(F.explode("rows_by_period").alias("period", "n")).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.array_sort(F.collect_set("period")).alias("periods"))
    entities = store.records().agg(F.countDistinct(store.entity)).scalar()
    return kept.select("rows", entities.alias("entities"), "periods").withColumns(facts)
