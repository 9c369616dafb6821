"""Exact removal of repeated byte strings by bucket-pointer refinement.

Every place of every text belongs to a bucket of places whose next bytes are equal. A bucket of
depth 2d is named by the names of the buckets of depth d at the place and d bytes on, so the names
of one depth are used again to refine the next, and never a sort of whole suffixes.

Strings of N bytes are not compared place by place. Each string is represented by the smallest
32-byte bucket in it, its anchor; equal strings have the same anchor at the same distance. A cell is
a run of places with one anchor.

1. Buckets of anchors that occur once are dropped: nothing there repeats.
2. In the others, cells whose whole contents (names at later offsets) are equal repeat as a whole.
3. Of what is left each different cell is cut into blocks of 16 places. The bytes common to a
   block's strings name a bucket; blocks alone in it are dropped.
4. The remaining places are told apart by the bytes on either side.

Names are 64-bit; two different strings are taken for equal only if several independent names agree.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from panelwise.llm.base import KeyFilter, arrow_schema, columns, kind_of, materialize, mix, only_likely, rows_of, slices, text_batches

LENGTH, ANCHOR, BLOCK = 200, 32, 16
AT_ONCE = 400_000  # characters handled together


def _bytes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    return np.frombuffer(b"".join(raw), dtype=np.uint8), np.cumsum([0] + [len(r) for r in raw])


def names(data: np.ndarray, depth: int) -> dict[int, np.ndarray]:
    """Bucket names at depths 1, 2, 4, ... up to ``depth``; places nearer to the end have none."""
    out = {1: mix(data.astype(np.uint64) + np.uint64(1))}
    d = 1
    while d < depth and len(out[d]) > d:
        at, later = out[d][:-d], out[d][d:]
        x = at * np.uint64(0x9E3779B97F4A7C15) + later
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        out[2 * d] = x ^ (x >> np.uint64(32))
        d *= 2
    return out


def anchors(name: np.ndarray, width: int) -> np.ndarray:
    """For each place the leftmost smallest name among the next ``width``, as a place."""
    bits = np.uint64(max(20, len(name).bit_length()))
    least = (name >> bits << bits) | np.arange(len(name), dtype=np.uint64)
    span = 1
    while 2 * span <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < width:
        least = np.minimum(least[:len(least) - (width - span)], least[width - span:])
    return (least & (np.uint64(1) << bits) - np.uint64(1)).astype(np.int64)


def cells(data: np.ndarray, ends: np.ndarray, n: int, with_content: bool) -> tuple[np.ndarray, ...]:
    """text, first place, last place, anchor, bucket, content name of each cell; places count within the whole data."""
    empty = np.empty(0, np.int64)
    if len(data) < n:
        return (empty,) * 6
    level = names(data, 1 << (n.bit_length() - 1) if with_content else ANCHOR)
    x = anchors(level[ANCHOR], n - ANCHOR + 1)
    place = np.arange(len(x))
    text = np.searchsorted(ends, place, "right") - 1
    ok = np.flatnonzero(place + n <= ends[text + 1])
    if not len(ok):
        return (empty,) * 6
    new = np.ones(len(ok), dtype=bool)
    new[1:] = x[ok[1:]] != x[ok[:-1]]
    at = np.flatnonzero(new)
    first, last = ok[at], ok[np.append(at[1:], len(ok)) - 1]
    bucket = level[ANCHOR][x[first]]
    if not with_content:
        return text[first], first, last, x[first], bucket, empty
    return text[first], first, last, x[first], bucket, content(level, first, last - first + n, n)


def content(level: dict[int, np.ndarray], start: np.ndarray, length: np.ndarray, n: int) -> np.ndarray:
    """Names of the strings of ``length`` bytes from ``start``, n <= length < 3 d for the largest depth d <= n."""
    d = 1 << (n.bit_length() - 1)
    out = mix(level[d][start] ^ length.astype(np.uint64))
    for at in (np.minimum(start + d, start + length - d), start + length - d):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + level[d][at])
    return out


def _runs(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    for batch, texts in text_batches(batches, AT_ONCE):
        yield batch, *_bytes(texts)


def repeated_buckets(docs: DataFrame, n: int) -> DataFrame:
    spec, schema = arrow_schema(docs, "bucket long, n long")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, data, ends in _runs(batches):
            bucket, count = np.unique(cells(data, ends, n, False)[4], return_counts=True)
            yield rows_of(schema, bucket=bucket.view(np.int64), n=count)

    return docs.select("text").mapInArrow(run, spec).groupBy("bucket").agg(F.sum("n").alias("n")).where("n > 1").select("bucket")


def cells_in(docs: DataFrame, keys: KeyFilter, n: int) -> DataFrame:
    """bucket, content, row, first, last, anchor of the cells whose bucket may be repeated; places within the text."""
    spec, schema = arrow_schema(docs, "bucket long, content long, row long, first int, last int, anchor int")
    held = docs.sparkSession.sparkContext.broadcast(keys.words)  # of fixed size

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        likely = KeyFilter(held.value)
        for batch, data, ends in _runs(batches):
            text, first, last, anchor, bucket, name = cells(data, ends, n, True)
            if len(text):
                ok = likely.may_hold(bucket.view(np.int64))
                at = ends[text]
                rows = batch.column("row").to_numpy()[text]
                yield rows_of(
                    schema, bucket=bucket[ok].view(np.int64), content=name[ok].view(np.int64), row=rows[ok],
                    first=(first - at)[ok], last=(last - at)[ok], anchor=(anchor - at)[ok],
                )

    return docs.mapInArrow(run, spec)


def blocks_of(docs: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """core, row, at, low, high, sides, known: the blocks of the wanted cells.

    ``at`` is where the common bytes begin; the block's places are ``at - high .. at - low``;
    ``sides`` holds the bytes on either side of the core; ``known`` cells are only compared with.
    """
    spec, schema = arrow_schema(docs, "core long, row long, at int, low int, high int, sides binary, known boolean")
    lists = wanted.groupBy("row").agg(F.collect_list(F.struct("first", "last", "anchor", "known")).alias("cells"))
    core, side = n - BLOCK + 1, BLOCK - 1
    depth = 1 << (core.bit_length() - 1)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, lists = [t or "" for t in batch.column("text").to_pylist()], batch.column("cells")
            for i, j in slices(texts, AT_ONCE):
                data, ends = _bytes(texts[i:j])
                part = lists.slice(i, j - i)
                flat = part.flatten() if not isinstance(part, pa.ChunkedArray) else pa.concat_arrays([c.flatten() for c in part.chunks])
                text = np.repeat(np.arange(j - i), part.value_lengths().to_numpy())
                first, last, anchor, known = (flat.field(k).to_numpy(zero_copy_only=False) for k in range(4))
                # one row for each block that a cell's places fall in
                near, far = (anchor - last) // BLOCK, (anchor - first) // BLOCK
                count = far - near + 1
                cell = np.repeat(np.arange(len(text)), count)
                number = np.repeat(near, count) + np.arange(len(cell)) - np.repeat(np.cumsum(count) - count, count)
                at = anchor[cell] - BLOCK * number
                low, high = np.maximum(0, at - last[cell]), np.minimum(side, at - first[cell])
                begin = ends[text[cell]] + at
                level = names(data, depth)[depth]
                name = mix(mix(level[begin] ^ np.uint64(core)) * np.uint64(0x9E3779B97F4A7C15) + level[begin + core - depth])
                padded = np.concatenate([np.zeros(side, np.uint8), data, np.zeros(side, np.uint8)])
                around = np.concatenate([padded[begin[:, None] + np.arange(side)], padded[begin[:, None] + side + core + np.arange(side)]], axis=1)
                rows = batch.column("row").to_numpy()[i:j][text[cell]]
                yield rows_of(
                    schema, core=name.view(np.int64), row=rows, at=at, low=low, high=high,
                    sides=[r.tobytes() for r in around], known=known[cell],
                )

    likely = only_likely(docs, KeyFilter.of(wanted, "row"), "row")
    return likely.join(lists, "row").dropDuplicates(["row"]).select("row", "text", "cells").mapInArrow(run, spec)


def repeated_places(blocks: DataFrame) -> DataFrame:
    """row, first, last of the places in blocks, not known before, whose strings occur again."""
    blocks = materialize(blocks)
    cores = blocks.groupBy("core").agg(F.count("*").alias("n")).where("n > 1").select("core")
    left = blocks.join(cores, "core").withColumn("i", F.explode(F.sequence("low", "high")))
    own = F.concat(
        F.expr(f"substring(sides, {BLOCK} - i, i)"), F.expr(f"substring(sides, {BLOCK}, {BLOCK - 1} - i)")
    )
    places = materialize(left.select("core", "i", own.alias("own"), "row", (F.col("at") - F.col("i")).alias("place"), "known"))
    again = places.groupBy("core", "i", "own").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    found = places.where("NOT known").join(again, ["core", "i", "own"], "left_semi")
    return found.select("row", F.col("place").alias("first"), F.col("place").alias("last"))


def repeated(docs: DataFrame, n: int) -> DataFrame:
    """row, spans: for each row with repeated strings the ranges of places where they begin."""
    buckets = materialize(repeated_buckets(docs, n))
    some = cells_in(docs, KeyFilter.of(buckets, "bucket"), n)
    some = materialize(some.join(buckets, "bucket"))
    kinds = materialize(some.groupBy("bucket", "content").agg(F.count("*").alias("n"), F.min(F.struct("row", "first", "last", "anchor")).alias("one")))
    whole = some.join(kinds.where("n > 1").select("bucket", "content"), ["bucket", "content"], "left_semi").select("row", "first", "last")
    mixed = kinds.groupBy("bucket").agg(F.count("*").alias("k")).where("k > 1").select("bucket")
    wanted = materialize(kinds.join(mixed, "bucket").select("one.*", (F.col("n") > 1).alias("known")))
    places = repeated_places(blocks_of(docs, wanted, n))
    return materialize(whole.unionByName(places).groupBy("row").agg(F.collect_set(F.struct("first", "last")).alias("spans")))


def removed_runs(spans: list[dict], n: int) -> list[tuple[int, int]]:
    """Maximal runs of bytes covered by strings of n bytes that begin in the given ranges."""
    out: list[list[int]] = []
    for first, last in sorted((s["first"], s["last"]) for s in spans):
        if out and first <= out[-1][1]:
            out[-1][1] = max(out[-1][1], last + n)
        else:
            out.append([first, last + n])
    return [(a, b) for a, b in out]


def remove_repeated(df: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, with_kept: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, and ``kept`` (binary) if wanted, a row for each row.

    Null texts count as empty; texts shorter than ``length`` lose nothing; repeated rows lose all
    that is long enough; an empty table gives no rows. ``length`` is at least 64.
    """
    if length < 2 * ANCHOR:
        raise ValueError(f"length must be at least {2 * ANCHOR}")
    docs = columns(df, doc_id=doc_id, text=text)
    docs = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("row"))
    spans = repeated(docs.select("row", "text"), length)
    spec, schema = arrow_schema(docs, f"row long, doc_id {kind_of(docs, 'doc_id')}, n_bytes long, sha string" + (", bytes binary" if with_kept else ""))
    extra = ", kept binary" if with_kept else ""

    def whole(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [(t or "").encode("utf-8", "surrogatepass") for t in batch.column("text").to_pylist()]
            yield rows_of(
                schema, row=batch.column("row"), doc_id=batch.column("doc_id").to_pylist(), n_bytes=[len(r) for r in raw],
                sha=[hashlib.sha256(r).hexdigest() for r in raw], **({"bytes": raw} if with_kept else {}),
            )

    all_rows = docs.mapInArrow(whole, spec)
    spec, cut_schema = arrow_schema(docs, "row long, n_removed long, n_spans long, kept_sha256 string" + extra)

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {k: [] for k in cut_schema.names}
            for row, t, s in zip(*(batch.column(c).to_pylist() for c in ("row", "text", "spans")), strict=True):
                raw, runs = t.encode("utf-8", "surrogatepass"), removed_runs(s, length)
                edges = [0, *(e for r in runs for e in r), len(raw)]
                kept = b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                values = dict(row=row, n_removed=len(raw) - len(kept), n_spans=len(runs), kept_sha256=hashlib.sha256(kept).hexdigest(), kept=kept)
                for k, v in out.items():
                    v.append(values[k])
            yield rows_of(cut_schema, **out)

    touched = only_likely(docs.select("row", "text"), KeyFilter.of(spans, "row"), "row").join(spans, "row").select("row", "text", "spans")
    changed = touched.mapInArrow(cut, spec).dropDuplicates(["row"])
    zero = F.lit(0).cast("long")
    return all_rows.join(changed, "row", "left").select(
        "doc_id", "n_bytes", F.coalesce("n_removed", zero).alias("n_removed"), F.coalesce("n_spans", zero).alias("n_spans"),
        F.coalesce("kept_sha256", "sha").alias("kept_sha256"), *([F.coalesce("kept", "bytes").alias("kept")] if with_kept else []),
    )
