"""Token files: document ids one after the other, with Elias-Fano coded boundaries.

A shard file holds a bounded run of documents in ascending order of their id:

    magic "EFT1" | layout of the sections | token ids (2 or 4 bytes each, little endian)
    | boundaries (Elias-Fano) | document ids (Elias-Fano, relative to the first)

An Elias-Fano list of n ascending numbers up to u keeps the low floor(log2(u/n)) bits of each as
they are and the high bits in unary: about 2 + log2(u/n) bits a number. Every 256th set bit's
place is kept (32 bits), so the i-th number is found without reading the list from its start.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from panelwise.llm.base import arrow_schema, give_back, columns, materialize, new_name, rows_of, shared_path, text_batches
from panelwise.llm.tokens import encoder

STEP, MAGIC = 256, b"EFT1"
END_ID, SHARD_IDS = 1, 32_000_000
LIST_HEAD, HEAD = struct.Struct("<QQQB"), struct.Struct("<4sBQQQqIQQQ")


@dataclass
class EliasFano:
    n: int
    top: int  # the largest number
    low_bits: int
    low: np.ndarray  # packed bits
    high: np.ndarray  # packed bits
    places: np.ndarray  # of set bits 0, STEP, 2 STEP, ... in high

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, dtype=np.uint64)
        n = len(values)
        if n == 0:
            empty = np.empty(0, np.uint8)
            return cls(0, 0, 0, empty, empty, np.empty(0, np.uint32))
        if (values[1:] < values[:-1]).any():
            raise ValueError("the numbers must ascend")
        top = int(values[-1])
        bits = max(0, (top // n).bit_length() - 1)
        high = (values >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        if high[-1] >= 1 << 32:
            raise ValueError("too many numbers for one list")
        unary = np.zeros(int(high[-1]) + 1, dtype=np.uint8)
        unary[high] = 1
        shifts = np.arange(bits, dtype=np.uint64)
        low = np.packbits(((values[:, None] >> shifts) & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little")
        return cls(n, top, bits, low, np.packbits(unary, bitorder="little"), high[::STEP].astype(np.uint32))

    def low_part(self, i: np.ndarray) -> np.ndarray:
        out = np.zeros(len(i), dtype=np.uint64)
        for b in range(self.low_bits):
            at = i * self.low_bits + b
            out |= (self.low[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(np.uint64) << np.uint64(b)
        return out

    def all(self) -> np.ndarray:
        places = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[:self.n]
        i = np.arange(self.n)
        return ((places - i).astype(np.uint64) << np.uint64(self.low_bits)) | self.low_part(i)

    def select(self, i: int) -> int:
        """The i-th number, from the nearest kept place on."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        place, wanted = int(self.places[i // STEP]), i % STEP
        byte = place >> 3
        chunk = np.unpackbits(self.high[byte:byte + 1], bitorder="little")
        chunk[:place & 7] = 0
        while True:
            ones = np.flatnonzero(chunk)
            if wanted < len(ones):
                place = (byte << 3) + int(ones[wanted])
                break
            wanted -= len(ones)
            byte += len(chunk) >> 3
            chunk = np.unpackbits(self.high[byte:byte + 64], bitorder="little")
        return int((place - i) << self.low_bits | int(self.low_part(np.array([i]))[0]))

    def to_bytes(self) -> bytes:
        head = LIST_HEAD.pack(self.n, self.top, len(self.high), self.low_bits)
        return head + self.low.tobytes() + self.high.tobytes() + self.places.astype("<u4").tobytes()

    @classmethod
    def from_bytes(cls, data: memoryview) -> EliasFano:
        n, top, n_high, bits = LIST_HEAD.unpack_from(data)
        a = LIST_HEAD.size
        b = a + (n * bits + 7) // 8
        c = b + n_high
        return cls(n, top, bits, np.frombuffer(data[a:b], np.uint8), np.frombuffer(data[b:c], np.uint8), np.frombuffer(data[c:], "<u4"))


def shard_bytes(ids: list[np.ndarray], doc_ids: list[int | None]) -> bytes:
    """A shard of documents given in ascending order of id, those without one first."""
    lengths = np.array([len(x) for x in ids], dtype=np.int64)
    flat = np.concatenate(ids) if ids else np.empty(0, "<u4")
    width = 2 if not len(flat) or flat.max() < 1 << 16 else 4
    body = flat.astype(f"<u{width}").tobytes()
    nulls = sum(d is None for d in doc_ids)
    first = doc_ids[nulls] if nulls < len(doc_ids) else 0
    bounds = EliasFano.of(np.concatenate([[0], np.cumsum(lengths)])).to_bytes()
    keys = EliasFano.of(np.array([d - first for d in doc_ids[nulls:]], dtype=np.uint64)).to_bytes()
    head = HEAD.pack(MAGIC, width, len(ids), len(flat), nulls, first, zlib.crc32(body), len(body), len(bounds), len(keys))
    return head + body + bounds + keys


class Shard:
    """A shard read back: ids of a document by its place, or all of them."""

    def __init__(self, data: bytes):
        view = memoryview(data)
        magic, width, self.n_docs, self.n_ids, self.nulls, self.first, check, *sizes = HEAD.unpack_from(view)
        if magic != MAGIC:
            raise ValueError("not a token file")
        a = HEAD.size
        b, c = a + sizes[0], a + sizes[0] + sizes[1]
        if zlib.crc32(view[a:b]) != check or len(data) != c + sizes[2]:
            raise ValueError("the token file is damaged")
        self.ids = np.frombuffer(view[a:b], f"<u{width}")
        self.bounds, self.keys = EliasFano.from_bytes(view[b:c]), EliasFano.from_bytes(view[c:])

    def document(self, i: int) -> np.ndarray:
        return self.ids[self.bounds.select(i):self.bounds.select(i + 1)]

    def doc_ids(self) -> list[int | None]:
        return [None] * self.nulls + [self.first + k for k in self.keys.all().tolist()]


def place(uri: str) -> tuple[fs.FileSystem, str]:
    if "://" in uri or uri.startswith("file:"):
        uri = "file://" + uri[5:] if uri.startswith("file:/") and not uri.startswith("file://") else uri
        return fs.FileSystem.from_uri(uri)
    return fs.LocalFileSystem(), uri


def read_shard(uri: str) -> Shard:
    files, path = place(uri)
    with files.open_input_file(path) as f:
        return Shard(f.read())


def write_tokens(
    df: DataFrame, folder: str, tokenizer: str, doc_id: str = "doc_id", text: str = "text",
    end_id: int | None = END_ID, shard_ids: int = SHARD_IDS,
) -> DataFrame:
    """Write the token files and return their list: shard, path, start, n_docs, n_ids.

    Documents are range partitioned by id (and text, so that one repeated id does not fill a
    partition), sorted there, and written in shards of at most about ``shard_ids`` ids. File names
    are new for each attempt of a task; the list, written last, names those of finished tasks.
    ``start`` counts the ids in all earlier shards. Null texts count as empty, null ids come first,
    repeated rows are written each, an empty table gives no file.
    """
    docs = columns(df, doc_id=doc_id, text=text)
    order = ["doc_id", F.xxhash64("text")]
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(*order).sortWithinPartitions(*order)
    spec, schema = arrow_schema(docs, "part int, number int, path string, n_docs long, n_ids long")
    end = b"" if end_id is None else np.array([end_id], dtype="<u4").tobytes()
    place(folder)[0].create_dir(place(folder)[1], recursive=True)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, part, number = encoder(tokenizer), TaskContext.get().partitionId(), 0
        ids: list[np.ndarray] = []
        keys: list = []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal ids, keys, size, number
            path = f"{folder}/part-{part:05}-{number:05}-{new_name()}.eft"
            files, at = place(path)
            with files.open_output_stream(at) as f:
                f.write(shard_bytes(ids, keys))
            row = rows_of(schema, part=[part], number=[number], path=[path], n_docs=[len(ids)], n_ids=[size])
            ids, keys, size, number = [], [], 0, number + 1
            return row

        for batch, texts in text_batches(batches):
            got = [np.frombuffer(g + end, "<u4") for g in tokens.encode(texts)]
            for key, g in zip(batch.column("doc_id").to_pylist(), got, strict=True):
                if ids and size + len(g) > shard_ids:
                    yield flush()
                ids.append(g.astype(np.uint16) if not len(g) or g.max() < 1 << 16 else g)
                keys.append(key)
                size += len(g)
        if ids:
            yield flush()
        tokens.forget()
        give_back()

    shards = materialize(docs.mapInArrow(run, spec))
    # one small row per file
    before = Window.orderBy("part", "number").rowsBetween(Window.unboundedPreceding, -1)
    return shards.select(
        F.row_number().over(Window.orderBy("part", "number")).alias("shard"), "path",
        F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("start"), "n_docs", "n_ids",
    )


def read_tokens(shards: DataFrame, with_ids: bool = False) -> DataFrame:
    """The documents of the listed files: doc_id, start, n_tokens, ids_crc32, shard, place, and ``ids`` if wanted."""
    spec = "doc_id long, start long, n_tokens long, ids_crc32 long, shard int, place long"
    spec, schema = arrow_schema(shards, spec + (", ids array<int>" if with_ids else ""))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                shard = read_shard(row["path"])
                bounds, keys = shard.bounds.all().astype(np.int64), shard.doc_ids()
                for i in range(0, shard.n_docs, 20_000):
                    ends = bounds[i:i + 20_001].tolist()
                    docs = [shard.ids[a:b].astype("<u4") for a, b in zip(ends, ends[1:], strict=False)]
                    yield rows_of(
                        schema, doc_id=keys[i:i + 20_000], start=bounds[i:i + len(docs)] + row["start"], n_tokens=np.diff(ends),
                        ids_crc32=[zlib.crc32(d.tobytes()) for d in docs], shard=[row["shard"]] * len(docs),
                        place=np.arange(i, i + len(docs)), **({"ids": [d.astype(np.int32) for d in docs]} if with_ids else {}),
                    )

    return shards.repartition("path").mapInArrow(run, spec)


def round_trip(spark: SparkSession, df: DataFrame, tokenizer: str) -> DataFrame:
    """Write the table's token files to the shared folder and read them back."""
    return read_tokens(write_tokens(df, shared_path(spark, "tokens"), tokenizer))
