"""What the operators of this subpackage share: registry, batches of texts, tables in the shared folder."""

from __future__ import annotations

import ctypes
import functools
import os
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from panelwise import frames

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Let a local session's workers import the package wherever it was started; on a cluster it is installed."""
    context = spark.sparkContext
    if context.applicationId not in _SHIPPED and context.master.startswith("local["):
        context.addFile(os.path.dirname(os.path.abspath(frames.__file__)), recursive=True)
        _SHIPPED.add(context.applicationId)


def query(name: str, sql: str | None = None):
    def register(function: Query) -> Query:
        @functools.wraps(function)
        def shipped(spark: SparkSession, folder: str) -> DataFrame:
            ship(spark)
            return function(spark, folder)

        QUERIES[name] = shipped
        if sql is not None:
            SQL[name] = sql
        return function

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def columns(df: DataFrame, **wanted: str) -> DataFrame:
    """Only the columns an operator reads, under its own names, so that extra columns never clash."""
    return df.select(*[F.col(f"`{c}`").alias(name) for name, c in wanted.items()])


def kind_of(df: DataFrame, name: str) -> str:
    return df.schema[name].dataType.simpleString()


def materialize(df: DataFrame) -> DataFrame:
    """A table written once to the shared folder; its readers do not repeat the work."""
    return frames.materialize(df)


def shared_path(spark: SparkSession, name: str) -> str:
    return frames.new_folder(spark, name)


ROWS_AT_ONCE = 500  # of a batch made into Python strings together
TEXT_AT_ONCE = 400_000  # characters handled together; a longer text is handled by itself


def give_back() -> None:
    """Return freed memory to the system at the end of a task: the worker process lives on and may wait for long."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
    if trim is not None:
        trim(0)


def slices(texts: list[str], most: int) -> Iterator[tuple[int, int]]:
    """Runs of texts of about ``most`` characters; a longer text is a run of its own."""
    begin, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            yield begin, i
            begin, size = i, 0
        size += len(t)
    if begin < len(texts):
        yield begin, len(texts)


def text_batches(batches: Iterable[pa.RecordBatch], most: int = TEXT_AT_ONCE, text: str = "text") -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Arrow batches cut into runs of bounded text, with null texts read as empty."""
    for whole in batches:
        for at in range(0, whole.num_rows, ROWS_AT_ONCE):
            batch = whole.slice(at, ROWS_AT_ONCE)
            texts = [t or "" for t in batch.column(text).to_pylist()]
            for i, j in slices(texts, most):
                yield batch.slice(i, j - i), texts[i:j]
    give_back()


def rows_of(schema: pa.Schema, **values) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(values[f.name], type=f.type) for f in schema], schema=schema)


def arrow_schema(df: DataFrame, spec: str) -> tuple[str, pa.Schema]:
    """A DDL schema and the Arrow schema that rows for it must have."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    return spec, to_arrow_schema(_parse_datatype_string(spec))


def new_name() -> str:
    return uuid.uuid4().hex


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit changes every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


FILTER_WORDS = 1 << 20  # 64-bit words of a key filter: 8 MB, whatever the number of keys


class KeyFilter:
    """A Bloom filter of fixed size over long keys: what it rejects is surely not among them.

    With more keys it lets more strangers through; it only saves work and decides nothing.
    """

    def __init__(self, words: np.ndarray):
        self.words = words

    @staticmethod
    def slots(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = mix(keys.view(np.uint64))
        a, b = h & np.uint64(0x3FFFFFF), h >> np.uint64(38)
        return a, b

    @classmethod
    def of(cls, keys: DataFrame, name: str) -> KeyFilter:
        spec, schema = arrow_schema(keys, "word long, bits long")

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            words = np.zeros(FILTER_WORDS, dtype=np.uint64)
            for batch in batches:
                for s in cls.slots(batch.column(name).to_numpy()):
                    np.bitwise_or.at(words, (s >> np.uint64(6)).astype(np.int64), np.uint64(1) << (s & np.uint64(63)))
            at = np.flatnonzero(words)
            for i in range(0, len(at), 50_000):
                yield rows_of(schema, word=at[i:i + 50_000], bits=words[at[i:i + 50_000]].view(np.int64))

        got = keys.select(name).mapInArrow(run, spec).groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
        words = np.zeros(FILTER_WORDS, dtype=np.uint64)
        words[got.column("word").to_numpy()] = got.column("bits").to_numpy().view(np.uint64)
        return cls(words)

    def may_hold(self, keys: np.ndarray) -> np.ndarray:
        ok = np.ones(len(keys), dtype=bool)
        for s in self.slots(keys):
            ok &= (self.words[(s >> np.uint64(6)).astype(np.int64)] >> (s & np.uint64(63)) & np.uint64(1)).astype(bool)
        return ok


def only_likely(df: DataFrame, keys: KeyFilter, name: str) -> DataFrame:
    """The rows whose key the filter lets through."""
    held = df.sparkSession.sparkContext.broadcast(keys.words)  # of fixed size

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = KeyFilter(held.value)
        for batch in batches:
            yield batch.filter(pa.array(mine.may_hold(batch.column(name).to_numpy())))
        give_back()

    return df.mapInArrow(run, df.schema)


def with_likely(df: DataFrame, keys: KeyFilter, name: str, mark: str) -> DataFrame:
    """The rows with whether the filter lets their key through."""
    held = df.sparkSession.sparkContext.broadcast(keys.words)  # of fixed size
    out = df.select("*", F.lit(True).alias(mark)).schema

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = KeyFilter(held.value)
        for batch in batches:
            likely = pa.array(mine.may_hold(batch.column(name).to_numpy()))
            yield pa.RecordBatch.from_arrays([*batch.columns, likely], names=[*batch.schema.names, mark])
        give_back()

    return df.mapInArrow(run, out)
