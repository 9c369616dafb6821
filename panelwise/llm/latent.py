"""Benchmark decontamination by latent semantic retrieval.

Benchmark items and documents are cut into passages of ``PASSAGE`` words. The benchmark's passages
and all of the corpus's make a TF-IDF matrix over the benchmark's terms, whose document frequencies are
counted over all documents. The corpus's rows share a fixed weight, so that a large corpus does not crowd
out the items' own terms. A randomised SVD of it, done in one distributed pass, gives every term a
latent vector. Then every passage of every document is folded in and compared with
every benchmark passage by cosine; near ones are candidates. So are passages that share a run of
``RUN`` words with an item, or hold all words of a shorter one in order: an item that stands word for
word is judged whatever the words around it do to the cosine. A candidate is a leak when the longest
common subsequence of the item's words with the words around holds most of the item, or, for
paraphrases, a good part of it together with the item's answer: its rarest words.

The benchmark is taken in blocks of a bounded number of passages, so that what is sent to the tasks
(terms, their vectors, the passages) has a bound too. Each block is one reading of the corpus, which
numbers its words by the block's terms; the counts, the SVD and the comparison read these numbers.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from panelwise.llm.base import arrow_schema, columns, give_back, kind_of, materialize, rows_of, text_batches
from panelwise.llm.words import Words, run_hashes

STEP, STEPS = 16, 3  # a passage is three steps of 16 words
RANK, OVERSAMPLE, SEED = 128, 16, 11
BLOCK_PASSAGES = 2_000  # of the benchmark at once
CORPUS = 2  # weight of all the corpus's passages in the latent space, in passages for each of the benchmark; more would crowd out the items' own terms
WORDS_AT_ONCE = 65_536  # words handled together; a longer text is handled by itself
PIECE = 16  # vectors added up one after the other
SUMS_AT_ONCE = 512  # sums made together, so that they stay in the cache
COSINES_AT_ONCE = 250_000  # likewise
NEAR = 0.65  # cosine of candidates
VERBATIM, PARAPHRASE, ANSWER, ANSWER_WORDS = 0.7, 0.55, 0.6, 5  # texts without the item stay below 0.45
RUN = 5  # words in a row that make a candidate
SHORT = 8  # items of fewer words must stand as they are
SLICE = 32  # terms summed in one group, which has a row for each task


@dataclass
class Steps:
    """Texts cut into steps, and steps into passages of ``STEPS`` steps."""

    block: np.ndarray  # of each word, the number of its step
    text: np.ndarray  # of each passage
    start: np.ndarray  # of each passage, its first step

    @classmethod
    def of(cls, first: np.ndarray) -> Steps:
        count = np.diff(first)
        blocks = -(-count // STEP)
        before = np.cumsum(blocks) - blocks
        word = np.arange(first[-1] - first[0]) - np.repeat(first[:-1] - first[0], count)
        passages = np.where(count > 0, np.maximum(blocks - STEPS + 1, 1), 0)
        text = np.repeat(np.arange(len(count)), passages)
        inner = np.arange(passages.sum()) - np.repeat(np.cumsum(passages) - passages, passages)
        return cls(np.repeat(before, count) + word // STEP, text, before[text] + inner)

    def sums(self, vectors: np.ndarray, term: np.ndarray, text_end: np.ndarray) -> np.ndarray:
        """For each passage the sum of its terms' vectors."""
        at = np.flatnonzero(term >= 0)
        total = int(self.block[-1]) + 1 if len(self.block) else 0
        per = np.zeros((total + STEPS, vectors.shape[1]), dtype=np.float32)
        if len(at):
            block = self.block[at]
            edge = np.flatnonzero(np.append(True, block[1:] != block[:-1]))
            per[block[edge]] = row_sums(vectors, term[at], edge)
        out = per[self.start]
        for j in range(1, STEPS):
            out += per[self.start + j] * (self.start + j < text_end[self.text])[:, None]
        return out


def row_sums(vectors: np.ndarray, index: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each run ``index[first[i]:first[i + 1]]``, none of them empty, the sum of these vectors.

    Runs side by side are added up place by place, the longest ones first; long runs in pieces.
    """
    count = np.diff(np.append(first, len(index)))
    out = np.empty((len(first), vectors.shape[1]), dtype=vectors.dtype)
    if not len(first):
        return out
    if count.max() > PIECE:
        pieces = -(-count // PIECE)
        before = np.cumsum(pieces) - pieces
        inner = np.arange(pieces.sum()) - np.repeat(before, pieces)
        return row_sums(row_sums(vectors, index, np.repeat(first, pieces) + inner * PIECE), np.arange(pieces.sum()), before)
    for a in range(0, len(first), SUMS_AT_ONCE):
        order = np.argsort(-count[a:a + SUMS_AT_ONCE], kind="stable")
        begin, n = first[a:a + SUMS_AT_ONCE][order], count[a:a + SUMS_AT_ONCE][order]
        total = vectors.take(index[begin], axis=0)
        for j in range(1, int(n[0])):
            m = int(np.searchsorted(-n, -j))  # runs of more than j vectors
            total[:m] += vectors.take(index[begin[:m] + j], axis=0)
        out[a + order] = total
    return out


def cut(words: Words | Numbers) -> tuple[Steps, np.ndarray]:
    count = np.diff(words.first)
    return Steps.of(words.first), np.cumsum(-(-count // STEP))


def term_numbers(terms: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """The place of each word among the ascending terms, -1 for other words."""
    if not len(terms):
        return np.full(len(hashes), -1)
    # Hashes are spread evenly: their upper bits lead to a place from which few steps are left.
    shift = np.uint64(64 - min(20, len(terms).bit_length() + 4))
    first = np.searchsorted(terms >> shift, np.arange((1 << (64 - int(shift))) + 1, dtype=np.uint64))
    bucket = (hashes >> shift).astype(np.int64)
    low, out = first[bucket], np.full(len(hashes), -1)
    for j in range(int(np.diff(first).max())):
        at = np.minimum(low + j, len(terms) - 1)
        out = np.where(terms[at] == hashes, at, out)
    return out


@dataclass
class Numbers:
    """Texts whose words are term numbers, -1 for other words. ``first[i]:first[i + 1]`` are those of text i."""

    term: np.ndarray
    first: np.ndarray

    def known(self) -> np.ndarray:
        return np.flatnonzero(self.term >= 0)

    def text_of(self) -> np.ndarray:
        """For each word the text it stands in."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def passages(self) -> tuple[np.ndarray, np.ndarray]:
        """The terms of all passages side by side, and where each passage begins; those without a term are left out."""
        size, count = STEP * STEPS, np.diff(self.first)
        number = -(-count // size)
        word = np.arange(len(self.term)) - np.repeat(self.first[:-1], count)
        of = np.repeat(np.cumsum(number) - number, count) + word // size
        at = self.known()
        return self.term[at], np.flatnonzero(np.diff(of[at], prepend=-1))


def number_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, Numbers]]:
    """Arrow batches with ``terms`` cut into runs of a bounded number of words."""
    for whole in batches:
        rows = whole.column("terms")
        offsets, values = rows.offsets.to_numpy().astype(np.int64), rows.values.to_numpy()
        i = 0
        while i < whole.num_rows:
            j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + WORDS_AT_ONCE, "right")) - 1)
            yield whole.slice(i, j - i), Numbers(values[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i])
            i = j
    give_back()


@dataclass
class Item:
    key: object
    words: list[int]  # term numbers
    answer: frozenset[int] = frozenset()

    def masks(self) -> dict[int, int]:
        out: dict[int, int] = {}
        for i, w in enumerate(self.words):
            out[w] = out.get(w, 0) | 1 << i
        return out


def common_subsequence(masks: dict[int, int], size: int, words: list[int]) -> int:
    """Length of the longest common subsequence, a whole row of the table in one number."""
    full = (1 << size) - 1
    row = full
    for w in words:
        m = masks.get(w)
        if m:
            u = row & m
            row = (row + u | row - u) & full
    return size - row.bit_count()


def judge(item: Item, masks: dict[int, int], words: list[int]) -> tuple[bool, float, float]:
    """Whether the words hold the item; the share of it in their common subsequence; the share of its answer."""
    size = len(item.words)
    if size < SHORT:
        held = any(words[i:i + size] == item.words for i in range(len(words) - size + 1))
        return held, float(held), float(held)
    there = set(words)
    bound = sum(w in there for w in item.words) / size
    if bound < PARAPHRASE:  # no common subsequence is longer
        return False, bound, 0.0
    share = common_subsequence(masks, size, words) / size
    if share < PARAPHRASE:
        return False, share, 0.0
    answer = len(item.answer & there) / max(1, len(item.answer))
    return share >= VERBATIM or answer >= ANSWER, share, answer


def number_words(docs: DataFrame, terms: np.ndarray) -> DataFrame:
    """The table with ``terms array<int>``, the numbers of all words of the text, in its place; written once."""
    out = docs.drop("text").withColumn("terms", F.lit(None).cast("array<int>")).schema

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_batches(batches):
            words = Words.of(texts)
            number = pa.array(term_numbers(terms, words.hashes).astype(np.int32))
            rows = pa.ListArray.from_arrays(pa.array((words.first - words.first[0]).astype(np.int32)), number)
            kept = batch.drop_columns(["text"])
            yield pa.RecordBatch.from_arrays([*kept.columns, rows], names=[*kept.schema.names, "terms"])

    return materialize(docs.mapInArrow(run, out))


def document_counts(numbers: DataFrame, size: int) -> tuple[np.ndarray, int, int]:
    """In how many documents each of ``size`` terms stands; how many documents there are, and how many passages with a term."""
    spec, schema = arrow_schema(numbers, "term long, n long")

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, n, passages = np.zeros(size, dtype=np.int64), 0, 0
        for batch, words in number_batches(batches):
            at = words.known()
            pair = np.sort(words.text_of()[at] * size + words.term[at])
            once = pair[np.flatnonzero(np.diff(pair, prepend=-1))]
            if len(once):
                seen += np.bincount(once % size, minlength=size)
            n, passages = n + batch.num_rows, passages + len(words.passages()[1])
        at = np.flatnonzero(seen)
        yield rows_of(schema, term=np.append(at, [-1, -2]), n=np.append(seen[at], [n, passages]))

    got = numbers.select("terms").mapInArrow(count, spec).groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    term, n = got.column("term").to_numpy(), got.column("n").to_numpy()
    out = np.zeros(size, dtype=np.int64)
    out[term[term >= 0]] = n[term >= 0]
    return out, int(n[term == -1].sum()), int(n[term == -2].sum())


def passage_terms(docs: DataFrame, terms: np.ndarray) -> DataFrame:
    """The matrix's rows as a table: ``terms array<int>`` of every passage of every document that has a term."""
    spec, schema = arrow_schema(docs, "terms array<int>")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, words in number_batches(batches):
            t, first = words.passages()
            rows = pa.ListArray.from_arrays(pa.array(np.append(first, len(t)).astype(np.int32)), pa.array(t))
            yield pa.RecordBatch.from_arrays([rows.cast(schema.field("terms").type)], schema=schema)

    return number_words(docs.select("text"), terms).mapInArrow(run, spec)


def latent_terms(numbers: DataFrame, own: list[np.ndarray], idf: np.ndarray, rank: int, weight: float = 1.0) -> np.ndarray:
    """Randomised SVD of the TF-IDF passages that the texts in ``numbers`` are cut into: the right singular
    vectors, one row for each term. ``weight`` is that of each corpus passage, the items' own have 1.

    With A the passages and Y = A C their projection on random vectors, one pass gives Y'Y, from which the
    orthonormal basis Y B of the projected passages follows, and A'Y, which times B is the terms in that
    basis; A'Y is summed by slices of terms.
    """
    wide, n = rank + OVERSAMPLE, len(idf)
    chance = np.random.default_rng(SEED).standard_normal((n, wide)).astype(np.float32) * idf[:, None].astype(np.float32)

    def project(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram, out = np.zeros((wide, wide)), np.zeros((n, wide))
        for _, words in number_batches(batches):
            t, first = words.passages()
            if len(t):
                y = row_sums(chance, t, first)
                exact = y.astype(np.float64)
                gram += exact.T @ exact
                order = np.argsort(t, kind="stable")
                row = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(t))))[order]
                edge = np.flatnonzero(np.diff(t[order], prepend=-1))
                out[t[order[edge]]] += row_sums(y, row, edge)
        if gram.any():
            yield rows_of(schema, slice=[-1], part=[gram.tobytes()])
            for i in range(0, n, 16 * SLICE):
                parts = range(i, min(n, i + 16 * SLICE), SLICE)
                yield rows_of(schema, slice=list(parts), part=[out[j:j + SLICE].tobytes() for j in parts])

    def add(groups: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, total = None, 0
        for batch in groups:
            for k, part in zip(batch.column("slice"), batch.column("part"), strict=True):
                key, total = k.as_py(), total + np.frombuffer(part.as_buffer())
        yield rows_of(schema, slice=[key], part=[total.tobytes()])

    spec, schema = arrow_schema(numbers, "slice int, part binary")
    y = np.array([chance[r].sum(axis=0) if len(r) else np.zeros(wide) for r in own], dtype=np.float64).reshape(-1, wide)
    gram, terms = y.T @ y, np.zeros((n, wide))
    for row, r in zip(y, own, strict=True):
        np.add.at(terms, r, row[None, :])
    summed = numbers.select("terms").mapInArrow(project, spec).groupBy("slice").applyInArrow(add, spec).toArrow()
    for k, part in zip(summed.column("slice").to_pylist(), summed.column("part"), strict=True):
        part = np.frombuffer(part.as_buffer()).reshape(-1, wide)
        if k < 0:
            gram += weight * part
        else:
            terms[k:k + len(part)] += weight * part
    values, vectors = np.linalg.eigh(gram)
    good = values > values.max() * 1e-10 if len(values) and values.max() > 0 else np.zeros(len(values), bool)
    if not good.any():
        return np.zeros((n, 1), dtype=np.float32)
    terms = terms * idf[:, None] @ (vectors[:, good] / np.sqrt(values[good]))
    values, vectors = np.linalg.eigh(terms.T @ terms)
    order = np.argsort(-values)[:rank]
    order = order[values[order] > max(values.max(), 0) * 1e-12]
    return (terms @ vectors[:, order] / np.sqrt(values[order])).astype(np.float32)


@dataclass
class Index:
    vectors: np.ndarray  # idf-weighted latent vector of each term
    items: list[Item]
    passage: np.ndarray  # unit latent vectors of the items' passages
    owner: np.ndarray  # the item of each passage
    runs: dict[int, tuple[np.ndarray, np.ndarray]] = field(default_factory=dict)  # by length: ascending hashes, and their items

    def __post_init__(self) -> None:
        made: dict[int, set[tuple[int, int]]] = {}
        for i, item in enumerate(self.items):
            k = RUN if len(item.words) >= SHORT else len(item.words)
            if k:
                made.setdefault(k, set()).update((h, i) for h in run_hashes(np.array(item.words, dtype=np.uint64), k).tolist())
        for k, pairs in made.items():
            h, i = zip(*sorted(pairs), strict=True)
            self.runs[k] = np.array(h, dtype=np.uint64), np.array(i)

    def shared_runs(self, words: Numbers, steps: Steps) -> Iterator[tuple[int, int]]:
        """Passage and item of each run that both have."""
        texts, at = words.text_of(), words.known()
        for k, (known, item) in self.runs.items():
            at_k = at[:max(0, len(at) - k + 1)]  # runs of terms only, within one text
            last = at[k - 1:]
            at_k = at_k[(last - at_k == k - 1) & (texts[last] == texts[at_k])]
            h = run_hashes(words.term, k, at_k)
            low = np.searchsorted(known, h)
            hit = np.flatnonzero(known[np.minimum(low, len(known) - 1)] == h)
            h, at_k, low = h[hit], at_k[hit], low[hit]
            n = np.searchsorted(known, h, "right") - low
            place = np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            text = texts[at_k]
            first, last = np.searchsorted(steps.text, text), np.searchsorted(steps.text, text, "right") - 1
            w = np.minimum(first + (at_k - words.first[text]) // STEP, last)
            yield from map(tuple, np.unique(np.stack([np.repeat(w, n), item[place]], axis=1), axis=0).tolist())

    def unit(self, words: Numbers) -> tuple[Steps, np.ndarray]:
        steps, ends = cut(words)
        v = steps.sums(self.vectors, words.term, ends)
        return steps, v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)

    def leaks(self, words: Numbers, near: float = NEAR) -> list[tuple[int, int, int, int, float, float, float]]:
        """text, item, first and last word looked at, cosine, share of the item, share of the answer."""
        steps, unit = self.unit(words)
        found: dict[tuple[int, int], list[tuple[float, int]]] = {}
        at_once = max(1, COSINES_AT_ONCE // max(1, len(self.passage)))
        for a in range(0, len(unit), at_once):
            cosine = unit[a:a + at_once] @ self.passage.T
            for place in np.flatnonzero(cosine >= near).tolist():
                w, p = divmod(place, len(self.passage))
                found.setdefault((int(steps.text[a + w]), int(self.owner[p])), []).append((-float(cosine[w, p]), a + w))
        for w, i in self.shared_runs(words, steps):
            cosine = float((self.passage[self.owner == i] @ unit[w]).max())
            if cosine < near:
                found.setdefault((int(steps.text[w]), i), []).append((-cosine, w))
        first_step = np.searchsorted(steps.block, np.arange(int(steps.block[-1]) + 2)) if len(steps.block) else None
        out, masks = [], {}
        for (text, i), tries in found.items():
            item = self.items[i]
            if i not in masks:
                masks[i] = item.masks()
            low, high = int(words.first[text]), int(words.first[text + 1])
            done = []  # words looked at already
            for minus, w in sorted(tries):
                start = int(first_step[steps.start[w]])
                a, b = max(low, start - len(item.words)), min(high, start + STEP * STEPS + len(item.words))
                if any(x <= a and b <= y for x, y in done):
                    continue
                done.append((a, b))
                held, share, answer = judge(item, masks[i], words.term[a:b].tolist())
                if held:
                    out.append((text, i, a - low, b - low - 1, -minus, share, answer))
                    break
        return out


def build(docs: DataFrame, items: list[tuple[object, str]], rank: int = RANK, corpus: float = CORPUS) -> tuple[Index, DataFrame]:
    """The index of one block of the benchmark, and the documents with their words as numbers of its terms."""
    words = Words.of([t for _, t in items])
    terms = np.unique(words.hashes)
    numbers = number_words(docs, terms)
    counts, n_docs, passages = document_counts(numbers, len(terms))
    idf = np.log((1 + n_docs) / (1 + counts)) + 0.05
    mine = Numbers(term_numbers(terms, words.hashes), words.first - words.first[0])
    steps, ends = cut(mine)
    bounds = [np.flatnonzero((steps.block >= s) & (steps.block < min(s + STEPS, ends[t]))) for s, t in zip(steps.start, steps.text, strict=True)]
    own = [mine.term[b] for b in bounds]
    weight = min(1.0, corpus * len(own) / max(1, passages))
    vectors = latent_terms(numbers, own, idf, rank, weight) * idf[:, None].astype(np.float32)
    rarity = counts.tolist()
    made = []
    for i, (key, _) in enumerate(items):
        its = mine.term[mine.first[i]:mine.first[i + 1]].tolist()
        made.append(Item(key, its, frozenset(sorted(set(its), key=lambda w: (rarity[w], w))[:ANSWER_WORDS])))
    index = Index(vectors, made, np.empty((0, vectors.shape[1]), np.float32), steps.text)
    index.passage = index.unit(mine)[1]
    return index, numbers


def find_leaks(
    docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text",
    block_passages: int = BLOCK_PASSAGES, **how,
) -> DataFrame:
    """One row for each document and benchmark item that it holds: doc_id, item_id, where, and the three measures.

    Null and empty texts hold nothing and null, empty or wordless items are in nothing. Items of
    fewer than ``SHORT`` words must stand word for word. Repeated rows are reported each; an empty
    table on either side gives no rows.
    """
    rows = columns(docs, doc_id=doc_id, text=text)
    items = columns(benchmark, item_id=item_id, text=item_text).where("length(text) > 0")
    spec = f"doc_id {kind_of(rows, 'doc_id')}, item_id {kind_of(items, 'item_id')}, first_word long, last_word long, cosine double, lcs_share double, answer_share double"
    spec, schema = arrow_schema(rows, spec)
    # a bound on passages: one for each step of 16 words, a word taking two characters at least
    most = items.agg(F.sum(F.ceil(F.length("text") / (2 * STEP)) + 1)).first()[0] or 0
    blocks = -(-int(most) // block_passages)
    out = rows.sparkSession.createDataFrame([], spec)
    for b in range(blocks):
        part = items.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == b).collect()  # one block of the benchmark
        if not part:
            continue
        index, numbers = build(rows, [(r["item_id"], r["text"]) for r in part], **how)

        def run(batches: Iterable[pa.RecordBatch], index: Index = index) -> Iterator[pa.RecordBatch]:
            for batch, words in number_batches(batches):
                hits = index.leaks(words)
                keys = batch.column("doc_id")
                named = zip(*hits, strict=True) if hits else [[]] * 7
                text_at, item, first, last, cosine, share, answer = map(list, named)
                yield rows_of(
                    schema, doc_id=[keys[t].as_py() for t in text_at], item_id=[index.items[i].key for i in item], first_word=first, last_word=last,
                    cosine=cosine, lcs_share=share, answer_share=answer,
                )

        out = out.unionByName(numbers.mapInArrow(run, spec))
    return out


def drop_leaks(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """The table without the rows that hold a benchmark item, all columns as they were."""
    keyed = docs.select(F.struct(F.col(f"`{doc_id}`").alias("d"), F.xxhash64(F.col(f"`{text}`")).alias("h")).alias("doc_id"), F.col(f"`{text}`").alias("text"))
    gone = materialize(find_leaks(keyed, benchmark, **how).select(F.col("doc_id.d").alias("_d"), F.col("doc_id.h").alias("_h")).distinct())
    return docs.join(gone, F.col(f"`{doc_id}`").eqNullSafe(F.col("_d")) & (F.xxhash64(F.col(f"`{text}`")) == F.col("_h")), "left_anti")
