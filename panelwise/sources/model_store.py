"""Fitted models on disk, one version per training run.

A version is a folder named after its training run: one folder per kind and model, and a table per kind
that describes its models. It counts as soon as the run's row stands in ``training_runs``, which is
written last. Readers look that row up once and then read that version, so they never see models of two
trainings together, and a training that stopped half-way leaves the version before it in use.
"""

from concurrent.futures import ThreadPoolExecutor

from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from panelwise.operators.forests import remember_loaded
from panelwise.operators.models import Bundle, Features
from panelwise.sources.store import Store

META = (
    "model_id STRING, model_name STRING, strategy STRING, columns ARRAY<STRING>, categorical ARRAY<STRING>, "
    "threshold DOUBLE, kind STRING, validation_period INT, label_name STRING, has_model BOOLEAN"
)
# Kinds: the winner in use, all candidates refitted, the frozen validation candidates, the segment models.
KINDS = ("winner", "candidates", "frozen", "segments")
AT_ONCE = 4  # models written or read at the same time


def _folder(store: Store, version: int, kind: str) -> str:
    if kind not in KINDS:
        raise ValueError(f"unknown kind {kind!r}")
    return store.path(f"models/version={int(version)}/{kind}")


def current_version(store: Store) -> int:
    """The last finished training."""
    version = store.runs("training_runs").agg(F.max("id")).first()[0]
    if version is None:
        raise LookupError("no training is finished; train first")
    return version


def save_models(store: Store, version: int, models: dict[str, list[Bundle]]) -> None:
    """All kinds of a version; what an unfinished training of the same number has left is replaced.

    The caller makes the version count by appending the training's run afterwards.
    """
    if store.runs("training_runs").where(F.col("id") == version).limit(1).count():
        raise ValueError(f"version {version} is finished and does not change any more")
    rows, writes = {kind: [] for kind in models}, []
    for kind, bundles in models.items():
        for b in bundles:
            key = b.label_name or b.model_id
            if b.fitted is not None:
                writes.append((b, f"{_folder(store, version, kind)}/{key}"))
            rows[kind].append((
                key, b.model_name, b.strategy, list(b.features.columns), list(b.features.categorical), b.threshold, b.kind,
                b.validation_period, b.label_name, b.fitted is not None,
            ))
    with ThreadPoolExecutor(AT_ONCE) as pool:
        list(pool.map(lambda w: w[0].model.write().overwrite().save(w[1]), writes))
    for kind, described in rows.items():
        about = store.spark.createDataFrame(described, META).coalesce(1)
        about.write.mode("overwrite").parquet(f"{_folder(store, version, kind)}/_about")


def _loaded(path: str) -> PipelineModel:
    return remember_loaded(PipelineModel.load(path), path)


def load_models(store: Store, kind: str, model_id: str | None = None, version: int | None = None) -> list[Bundle]:
    """All models of a kind, or the one asked for, of the current version unless another is named."""
    folder = _folder(store, current_version(store) if version is None else version, kind)
    try:
        about = store.spark.read.schema(META).parquet(f"{folder}/_about")
    except AnalysisException as error:
        raise LookupError(f"no {kind} models are saved; train first") from error
    rows = (about if model_id is None else about.where(about.model_id == model_id)).collect()
    if model_id is not None and not rows:
        raise LookupError(f"model {model_id!r} is not among the {kind} models")
    with ThreadPoolExecutor(AT_ONCE) as pool:
        found = list(pool.map(lambda r: _loaded(f"{folder}/{r.model_id}") if r.has_model else None, rows))
    return [
        Bundle(
            r.model_name, r.strategy, Features(tuple(r["columns"]), tuple(r.categorical)), model, r.threshold, r.kind,
            r.validation_period, r.label_name,
        )
        for r, model in zip(rows, found, strict=True)
    ]


def load_model(store: Store, kind: str = "winner", model_id: str | None = None, version: int | None = None) -> Bundle:
    return load_models(store, kind, model_id, version)[0]


def resolve_model(store: Store, model_id: str | None = None, version: int | None = None) -> Bundle:
    """The winner, or the candidate asked for."""
    return load_model(store, "candidates", model_id, version) if model_id else load_model(store, version=version)
