"""Packing of token sequences by harmonic classes.

A document's ids are cut at multiples of the capacity C; the rest, of length r, belongs to class
k when C/(k+1) < r <= C/k. A bin of class k takes exactly k rests, whole, and its remaining room
is filled from a stream of ids that may be cut anywhere: the full blocks of long documents, rests
too short for a class, and rests left over when a class has fewer than k. What is left of the
stream becomes full sequences, its last ids sequences whose lengths are powers of two. So no
sequence needs padding, and most documents shorter than C stay in one piece.

Every task fills its own bins from a bounded block of documents at a time, so nothing is shuffled
and memory does not grow with the partition.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from panelwise.llm.base import arrow_schema, give_back, columns, kind_of, rows_of, text_batches
from panelwise.llm.tokens import encoder

CAPACITY, CLASSES, BLOCK_IDS, END_ID = 2048, 16, 4_000_000, 1
PIECES_AT_ONCE = 2_000  # handed on in one Arrow batch: up to 16 MB of ids


def powers_of_two(n: int) -> list[int]:
    return [1 << b for b in range(n.bit_length() - 1, -1, -1) if n >> b & 1]


def pack_lengths(lengths: np.ndarray, capacity: int = CAPACITY, classes: int = CLASSES) -> dict[str, np.ndarray]:
    """Pieces of documents of the given lengths: document, start, length, sequence, offset."""
    lengths = np.asarray(lengths, dtype=np.int64)
    rest = lengths % capacity
    body = lengths - rest
    kind = np.where(rest > 0, capacity // np.maximum(rest, 1), 0)
    out: list[tuple[np.ndarray, ...]] = []
    room: list[np.ndarray] = []  # of each bin
    held: list[np.ndarray] = []  # the k documents of each bin, one array of bins x k per class
    loose = [np.flatnonzero(kind > classes)]
    for k in range(1, classes + 1):
        docs = np.flatnonzero(kind == k)
        docs = docs[np.argsort(-rest[docs], kind="stable")]
        bins = len(docs) // k
        loose.append(docs[bins * k:])
        group = docs[:bins * k].reshape(bins, k)
        held.append(group)
        room.append(capacity - rest[group].sum(axis=1))
    spare = np.concatenate(room) if room else np.empty(0, np.int64)
    short = np.concatenate(loose)
    # bins with the least room are filled first; those the stream cannot fill are given up
    order = np.argsort(spare, kind="stable")
    filled = order[np.cumsum(spare[order]) <= body.sum() + rest[short].sum()]
    number = np.full(len(spare), -1, dtype=np.int64)
    number[filled] = np.arange(len(filled))
    at, given_up = 0, []
    for group in held:
        mine = number[at:at + len(group)]
        at += len(group)
        given_up.append(group[mine < 0].ravel())
        group, mine = group[mine >= 0], mine[mine >= 0]
        if group.size:
            size = rest[group]
            docs = group.ravel()
            out.append((docs, body[docs], size.ravel(), np.repeat(mine, group.shape[1]), (np.cumsum(size, axis=1) - size).ravel()))
    # the stream: whole blocks, then rests
    long_docs = np.flatnonzero(body)
    rests = np.concatenate([short, *given_up])
    docs = np.concatenate([long_docs, rests])
    size = np.concatenate([body[long_docs], rest[rests]])
    first = np.concatenate([np.zeros(len(long_docs), np.int64), body[rests]])
    need = spare[filled]
    left = int(size.sum() - need.sum())
    blocks = [capacity] * (left // capacity) + powers_of_two(left % capacity)
    goal = np.concatenate([need, np.array(blocks, dtype=np.int64)])
    goal_offset = np.concatenate([capacity - need, np.zeros(len(blocks), np.int64)])
    if left or len(need):
        ends, goal_ends = np.cumsum(size), np.cumsum(goal)
        cuts = np.unique(np.concatenate([[0], ends, goal_ends]))
        begin, length = cuts[:-1], np.diff(cuts)
        seg, seq = np.searchsorted(ends, begin, "right"), np.searchsorted(goal_ends, begin, "right")
        out.append((docs[seg], first[seg] + begin - (ends - size)[seg], length, seq, goal_offset[seq] + begin - (goal_ends - goal)[seq]))
    names = ("document", "start", "length", "sequence", "offset")
    if not out:
        return {n: np.empty(0, np.int64) for n in names}
    whole = {n: np.concatenate([o[i] for o in out]) for i, n in enumerate(names)}
    order = np.lexsort((whole["offset"], whole["sequence"]))
    return {n: v[order] for n, v in whole.items()}


def pack(
    df: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY,
    classes: int = CLASSES, end_id: int | None = END_ID, block_ids: int = BLOCK_IDS, with_ids: bool = False,
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and ``ids`` if wanted.

    Null texts count as empty; an empty document is its end id alone, and without an end id has no
    piece. Repeated rows and null ids are packed like others; an empty table gives no rows. A
    sequence's used length is the capacity or a power of two. ``sequence_id`` is unique, not dense.
    """
    docs = columns(df, doc_id=doc_id, text=text)
    spec = f"doc_id {kind_of(docs, 'doc_id')}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    spec, schema = arrow_schema(docs, spec + (", ids array<int>" if with_ids else ""))
    end = b"" if end_id is None else np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, base = encoder(tokenizer), TaskContext.get().partitionId() << 33
        ids: list[bytes] = []
        keys: list = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal ids, keys, size, base
            lengths = np.array([len(x) // 4 for x in ids], dtype=np.int64)
            p = pack_lengths(lengths, capacity, classes)
            if len(p["document"]):
                for i in range(0, len(p["document"]), PIECES_AT_ONCE):
                    part = {n: v[i:i + PIECES_AT_ONCE] for n, v in p.items()}
                    begin, stop = (part["start"] * 4).tolist(), ((part["start"] + part["length"]) * 4).tolist()
                    cut = [ids[d][s:e] for d, s, e in zip(part["document"].tolist(), begin, stop, strict=True)]
                    extra = {"ids": [np.frombuffer(c, "<i4") for c in cut]} if with_ids else {}
                    yield rows_of(
                        schema, doc_id=[keys[d] for d in part["document"].tolist()], start=part["start"], length=part["length"],
                        ids_crc32=[zlib.crc32(c) for c in cut], doc_tokens=lengths[part["document"]],
                        sequence_id=part["sequence"] + base, offset=part["offset"], **extra,
                    )
                base += int(p["sequence"].max()) + 1
            ids, keys, size = [], [], 0

        for batch, texts in text_batches(batches):
            got = tokens.encode(texts)
            ids.extend(g + end for g in got)
            keys.extend(batch.column("doc_id").to_pylist())
            size += sum(map(len, got)) // 4
            if size >= block_ids:
                yield from flush()
        yield from flush()
        tokens.forget()
        give_back()

    return docs.mapInArrow(run, spec)
