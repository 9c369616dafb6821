"""Language identification with a bit-sliced Bloom filter of n-grams.

The filter has one row per hash value and one bit per language in it. An n-gram is looked up in a
few rows, and the bitwise and of these rows is the set of all languages that contain it: one look
serves every language. A document's n-grams are looked up so; for each language its bits are
counted, the hits that the filter's fill makes by chance are taken off, and the language with the
largest corrected count is the answer, its share of the n-grams the score.

An n-gram counts as contained in a language when it is not rare there compared with the language
it is most frequent in, so that a quoted line does not make a language contain another one.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from panelwise.llm.base import arrow_schema, columns, kind_of, materialize, mix, rows_of, text_batches

ORDERS = (2, 3, 4)
FIT_DOCS = 2_000  # labelled documents per language used to fit, at about this number
FIT_GRAMS = 60_000  # most frequent n-grams kept per language
MOST_GRAMS = 4_000_000  # of all languages
LEAST_COUNT, LEAST_SHARE = 3, 0.05
HASHES, ROWS_PER_GRAM = 3, 16
UNKNOWN = "und"

_LETTERS: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Which code points are letters."""
    if not _LETTERS:
        _LETTERS.append(np.array([chr(c).isalpha() for c in range(0x110000)]))
    return _LETTERS[0]


def grams(texts: list[str], orders: tuple[int, ...] = ORDERS) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each order the hashes of all n-grams of the texts and where each text's n-grams begin.

    N-grams lie within a word; the first and the last character may be the word's edge.
    """
    low = [t.lower() for t in texts]
    code = np.frombuffer(("\n" + "\n".join(low) + "\n").encode("utf-32-le", "surrogatepass"), dtype="<u4")
    is_letter = letters()[code]
    code = np.where(is_letter, code, 0).astype(np.uint64)
    starts = np.concatenate([[1], np.cumsum([len(t) + 1 for t in low]) + 1])
    out = []
    for n in orders:
        count = len(code) - n + 1
        if count <= 0:
            out.append((np.empty(0, np.uint64), np.zeros(len(starts), np.int64)))
            continue
        inner = range(1, n - 1) if n > 2 else range(n)
        ok = is_letter[inner[0]:inner[0] + count].copy()
        for j in inner[1:]:
            ok = ok & is_letter[j:j + count] if n > 2 else ok | is_letter[j:j + count]
        at = np.flatnonzero(ok)
        h = np.full(len(at), n, dtype=np.uint64)
        for j in range(n):
            h = h * np.uint64(0x9E3779B97F4A7C15) + code[at + j]
        out.append((mix(h), np.searchsorted(at + (n > 1), starts)))
    return out


@dataclass
class LanguageFilter:
    langs: list[str]
    rows: np.ndarray  # (rows, words) of bits, bit i of word i // 64 for language i
    chance: np.ndarray  # for each language, the share of hits made by chance
    orders: tuple[int, ...] = ORDERS

    @classmethod
    def of(cls, langs: list[str], keys: np.ndarray, owner: np.ndarray, orders: tuple[int, ...] = ORDERS) -> LanguageFilter:
        words = max(1, -(-len(langs) // 64))
        size = 1 << max(10, int(ROWS_PER_GRAM * max(1, len(np.unique(keys))) - 1).bit_length())
        rows = np.zeros((size, words), dtype=np.uint64)
        for j in range(HASHES):
            np.bitwise_or.at(rows, (cls.row(keys, j, size), owner // 64), np.uint64(1) << (owner % 64).astype(np.uint64))
        fill = np.array([np.mean(rows[:, i // 64] >> np.uint64(i % 64) & np.uint64(1)) for i in range(len(langs))])
        if words == 1:
            rows = rows.astype(np.min_scalar_type((1 << len(langs)) - 1))
        return cls(langs, rows, fill**HASHES, orders)

    @staticmethod
    def row(keys: np.ndarray, j: int, size: int) -> np.ndarray:
        step = (keys >> np.uint64(32)) | np.uint64(1)
        return ((keys + np.uint64(j) * step) & np.uint64(size - 1)).astype(np.int64)

    def containing(self, keys: np.ndarray) -> np.ndarray:
        """For each n-gram the bits of all languages containing it."""
        found = self.rows[self.row(keys, 0, len(self.rows))]
        for j in range(1, HASHES):
            found = found & self.rows[self.row(keys, j, len(self.rows))]
        return found

    def hits(self, found: np.ndarray) -> np.ndarray:
        if len(self.langs) <= 8:  # few enough sets of languages to count each
            sets = np.bincount(found[:, 0], minlength=1 << len(self.langs))
            return np.array([sets[np.arange(len(sets)) >> i & 1 == 1].sum() for i in range(len(self.langs))])
        bits = np.unpackbits(np.ascontiguousarray(found).view(np.uint8).reshape(len(found), -1), axis=1, bitorder="little")
        return bits[:, :len(self.langs)].sum(axis=0, dtype=np.int64)

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        hits, total = np.zeros((len(texts), len(self.langs))), np.zeros(len(texts))
        for keys, starts in grams(texts, self.orders):
            found = self.containing(keys)
            total += np.diff(starts)
            for i, (a, b) in enumerate(zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)):
                hits[i] += self.hits(found[a:b])
        share = np.zeros_like(hits)
        if self.langs:
            share = (hits / np.maximum(total, 1)[:, None] - self.chance) / np.maximum(1 - self.chance, 1e-9)
            best = share.argmax(axis=1)
            score = np.clip(share[np.arange(len(texts)), best], 0, 1)
        else:
            best, score = np.zeros(len(texts), int), np.zeros(len(texts))
        known = (total > 0) & bool(self.langs)
        return [self.langs[b] if k else UNKNOWN for b, k in zip(best, known, strict=True)], np.where(known, score, 0.0)


def fit(df: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", fit_docs: int = FIT_DOCS, orders: tuple[int, ...] = ORDERS) -> LanguageFilter:
    """A filter from labelled rows; at most about ``fit_docs`` rows of each language are read, chosen by the hash of ``key``.

    Rows without a label or text do not count. N-grams are counted by Spark; the most frequent
    ``FIT_GRAMS`` of each language come to the driver (at most ``MOST_GRAMS`` in all).
    """
    labelled = columns(df, key=key, text=text, lang=lang).where("lang IS NOT NULL AND text IS NOT NULL")
    per_lang = labelled.groupBy("lang").count().orderBy("lang").limit(MOST_GRAMS + 1).toArrow().to_pydict()
    langs = per_lang["lang"]
    if len(langs) > 4096:
        raise ValueError("more than 4096 languages")
    if not langs:
        return LanguageFilter.of([], np.empty(0, np.uint64), np.empty(0, np.int64), orders)
    share = {name: min(1.0, fit_docs / n) for name, n in zip(langs, per_lang["count"], strict=True)}
    part = df.sparkSession.createDataFrame([(n, i, int(s * (1 << 31))) for i, (n, s) in enumerate(share.items())], "lang string, owner int, most long")
    sample = labelled.join(F.broadcast(part), "lang").where(F.coalesce(F.pmod(F.xxhash64("key"), F.lit(1 << 31)), F.lit(0)) < F.col("most"))
    spec, schema = arrow_schema(df, "owner int, gram long, n long")

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_batches(batches):
            owners = np.array(batch.column("owner").to_pylist())
            for o in np.unique(owners):
                mine = [t for t, x in zip(texts, owners, strict=True) if x == o]
                keys, n = np.unique(np.concatenate([k for k, _ in grams(mine, orders)]), return_counts=True)
                yield rows_of(schema, owner=np.full(len(keys), o), gram=keys.view(np.int64), n=n)

    counted = materialize(sample.select("owner", "text").mapInArrow(count, spec).groupBy("owner", "gram").agg(F.sum("n").alias("n")))
    totals = counted.groupBy("owner").agg(F.sum("n").alias("total"))
    rate = counted.join(F.broadcast(totals), "owner").withColumn("rate", F.col("n") / F.col("total"))
    most = rate.groupBy("gram").agg(F.max("rate").alias("most"))
    kept = rate.where(F.col("n") >= LEAST_COUNT).join(most, "gram").where(F.col("rate") >= LEAST_SHARE * F.col("most"))
    rank = F.row_number().over(Window.partitionBy("owner").orderBy(F.desc("n"), "gram"))
    got = kept.withColumn("r", rank).where(F.col("r") <= min(FIT_GRAMS, MOST_GRAMS // len(langs))).select("owner", "gram").toArrow()
    keys = got.column("gram").to_numpy().view(np.uint64) if got.num_rows else np.empty(0, np.uint64)
    return LanguageFilter.of(langs, keys, got.column("owner").to_numpy().astype(np.int64), orders)


def identify(df: DataFrame, model: LanguageFilter, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The kept columns with ``lang_pred`` and ``score``; every whole text is read.

    Null texts and texts without a letter, and all texts when the filter was fitted on nothing,
    are ``und`` with score 0. Ties go to the first language in order of name. Repeated rows are
    judged each; an empty table gives none.
    """
    keep = df.columns if keep is None else keep
    names = {f"_k{i}": c for i, c in enumerate(keep)}
    rows = df.select(*[F.col(f"`{c}`").alias(n) for n, c in names.items()], F.col(f"`{text}`").alias("_text"))
    spec = ", ".join([f"{n} {kind_of(rows, n)}" for n in names] + ["lang_pred string", "score double"])
    spec, schema = arrow_schema(df, spec)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_batches(batches, text="_text"):
            found, score = model.predict(texts)
            yield pa.RecordBatch.from_arrays([*[batch.column(n).cast(schema.field(n).type) for n in names], pa.array(found, pa.string()), pa.array(score)], schema=schema)

    clash = {"lang_pred", "score"} & set(keep)
    if clash:
        raise ValueError(f"columns named {sorted(clash)} are there already; rename them or leave them out of keep")
    return rows.mapInArrow(run, spec).withColumnsRenamed(names)


def held_out(key: str = "doc_id"):
    """Whether a row belongs to the quarter that is never learnt from; rows without an id do not."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 4 == 2, F.lit(False))


def predict_documents(df: DataFrame) -> DataFrame:
    """Fit on the documents that are not held out and predict all of them."""
    docs = columns(df, doc_id="doc_id", text="text", lang="lang")
    model = fit(docs.where(~held_out()))
    return identify(docs.select("doc_id", held_out().alias("held_out"), "text"), model, keep=["doc_id", "held_out"])


#: A document is rejected when no language holds this share of its n-grams; documents in a learnt language hold over 0.6.
KEPT_SHARE = 0.35


def keep_identified(docs: DataFrame, text: str = "text", least: float = KEPT_SHARE) -> DataFrame:
    """The documents whose language is one of those learnt from them; all columns stay as they are, whatever their names."""
    model = fit(docs.where(~held_out()))
    names = {c: f"_c{i}" for i, c in enumerate(docs.columns)}
    judged = identify(docs.withColumnsRenamed(names), model, text=names[text])
    kept = judged.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least))
    return kept.select(*[F.col(n).alias(c) for c, n in names.items()])
