"""Personal data in texts: fixed rules, and a character-level BiLSTM-CRF that adds what they miss.

The tagger is trained from labelled spans: windows of a bounded sample of documents with the spans
the rules find there, and the same windows with made-up data of each kind, in other notations too,
written into them. Every span of these kinds holds a digit or an at sign, so only the characters
near those are tagged; that leaves nothing out. A stretch is covered by overlapping windows. Their
scores are added, weighted by the distance from the window's edge, and one CRF decoding over the
whole stretch reconciles them. A proposed span is kept when it does not touch a base span and can
be what it is called.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from panelwise.llm.base import arrow_schema, columns, kind_of, rows_of, text_batches
from panelwise.llm.char_tagger import CHARS, TAGS, Tagger, char_ids, spans_of, tags_of
from panelwise.llm.pii_rules import KINDS, Span, base_spans, in_order, joined, luhn, plausible

HAS = re.compile("[0-9@]")
FIT_DOCS = 600  # documents with a digit or an at sign to train from, at most
FIT_WINDOWS, PASSES = 1_600, 6
LENGTH, STRIDE, CONTEXT = 96, 64, 24
TRAIN_LENGTH = 72
EXCERPT = 4_000  # characters of a training document


def made_up(rng: np.random.Generator, kind: str) -> str:
    """An invented value of the kind, in one of its notations."""
    def digits(n: int) -> str:
        return "".join(map(str, rng.integers(0, 10, n)))

    def name(n: int) -> str:
        return "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), n))

    if kind == "email":
        local = name(int(rng.integers(2, 9))) + str(rng.choice(["", ".", "_", "+", "-"])) + str(rng.choice([name(4), digits(2)]))
        host = name(int(rng.integers(3, 9))) + str(rng.choice(["", digits(1)]))
        return f"{local}@{host}" + str(rng.choice([".com", ".org", ".co.uk", ".example.net", ""], p=[0.3, 0.2, 0.2, 0.2, 0.1]))
    if kind == "ip":
        return ".".join(map(str, rng.integers(0, 256, 4)))
    if kind == "card":
        body = str(rng.choice(["4", "51", "37", "6011"]))
        body += digits(15 - len(body))
        number = next(body + str(d) for d in range(10) if luhn(body + str(d)))
        mark = str(rng.choice(["", "", " ", "-"]))
        return mark.join(number[i:i + 4] for i in range(0, 16, 4))
    area, a, b = digits(3), digits(3), digits(4)
    return str(rng.choice([f"+1 ({area}) {a}-{b}", f"+{digits(2)} {area} {a}{b}", f"({area}) {a}-{b}", f"{area}-{a}-{b}", f"{area}.{a}.{b}", f"+1-{area}-{a}-{b}"]))


def training_set(texts: list[str], seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Windows of the texts, half as they are with the rules' spans, half with invented data written in."""
    rng = np.random.default_rng(seed)
    fallback = "the order of this letter was sent to our office in the year 2019, see page 12 of version 3.0 - nothing else is known (yet). "
    texts = [t for t in texts if t] or [fallback * 3]
    ids, tags = np.full((FIT_WINDOWS, TRAIN_LENGTH), CHARS - 1), np.zeros((FIT_WINDOWS, TRAIN_LENGTH), dtype=np.int64)
    found = [base_spans(t) for t in texts]
    held = [i for i, f in enumerate(found) if f]
    for n in range(FIT_WINDOWS):
        if n % 2 == 0 and held and n % 4 == 0:  # a window with something found in it
            i = int(rng.choice(held))
            a, _, _ = found[i][int(rng.integers(0, len(found[i])))]
            text, spans, at = texts[i], found[i], max(0, a - int(rng.integers(1, TRAIN_LENGTH - 30)))
        elif n % 2 == 0:  # a window with a digit in it, where there is one
            i = int(rng.integers(0, len(texts)))
            text, spans = texts[i], found[i]
            near = [k for k, c in enumerate(text) if c.isdigit()]
            at = max(0, (int(rng.choice(near)) if near else int(rng.integers(0, len(text)))) - int(rng.integers(1, TRAIN_LENGTH - 10)))
        else:
            base = texts[int(rng.integers(0, len(texts)))]
            k = int(rng.integers(0, max(1, len(base) - TRAIN_LENGTH)))
            base = "".join("x" if c.isdigit() or c == "@" else c for c in base[k:k + TRAIN_LENGTH])
            spans, text, at = [], base[:int(rng.integers(0, 24))].rstrip() + " ", 0
            for kind in rng.choice(KINDS, int(rng.integers(1, 3))):
                value = made_up(rng, str(kind))
                spans.append((len(text), len(text) + len(value), str(kind)))
                text += value + str(rng.choice([" ", ". ", ", ", "\n", " | "]))
            text += base[24:]
        part = char_ids(text[at:at + TRAIN_LENGTH])
        ids[n, :len(part)] = part
        # a span cut off by the window's start is left as outside
        tags[n, :len(part)] = tags_of([(a - at, b - at, k) for a, b, k in spans if a >= at and a - at < len(part)], len(part))
    return ids, tags


def fit(df: DataFrame, text: str = "text", fit_docs: int = FIT_DOCS) -> Tagger:
    """A tagger from at most ``fit_docs`` documents with a digit or an at sign, those with the smallest text hash.

    Of a text longer than ``EXCERPT`` characters, as many are taken from a place chosen by its hash.
    """
    docs = columns(df, text=text).where(F.col("text").rlike("[0-9@]"))
    order = F.xxhash64("text")
    share = docs.agg(F.count("*").alias("n")).first()["n"]
    picked = docs.where(F.pmod(order, F.lit(1 << 31)) < int(min(1.0, 2 * fit_docs / max(1, share)) * (1 << 31)))
    begin = F.pmod(order, F.greatest(F.length("text") - EXCERPT, F.lit(0)).cast("long") + 1).cast("int") + 1
    excerpts = picked.select(order.alias("order"), F.col("text").substr(begin, F.lit(EXCERPT)).alias("part"))
    texts = [r["part"] for r in excerpts.orderBy("order", "part").limit(fit_docs).collect()]
    model = Tagger.new()
    model.train(*training_set(texts), PASSES)
    return Tagger({k: v.astype(np.float32) for k, v in model.p.items()})


def stretches(ids: np.ndarray) -> list[tuple[int, int]]:
    """Where characters near a digit or an at sign stand."""
    hot = np.flatnonzero(((ids >= 48) & (ids <= 57)) | (ids == 64))
    if not len(hot):
        return []
    new = np.append(True, np.diff(hot) > 2 * CONTEXT)
    first, last = hot[new], hot[np.append(new[1:], True)]
    return list(zip(np.maximum(0, first - CONTEXT).tolist(), np.minimum(len(ids), last + 1 + CONTEXT).tolist(), strict=True))


def tag_texts(model: Tagger, texts: list[str]) -> list[list[Span]]:
    """The spans the tagger sees in each text."""
    out: list[list[Span]] = [[] for _ in texts]
    where: list[tuple[int, int, np.ndarray]] = []  # text, start, ids of a stretch
    for i, t in enumerate(texts):
        ids = char_ids(t)
        where += [(i, a, ids[a:b]) for a, b in stretches(ids)]
    where.sort(key=lambda w: len(w[2]))
    edge = np.minimum(np.arange(LENGTH), np.arange(LENGTH)[::-1]) + 1.0
    at = 0
    while at < len(where):  # stretches of about the same length together
        group, size = [], 0
        while at < len(where) and (not group or size + len(where[at][2]) <= 60_000 and len(where[at][2]) <= 2 * len(group[0][2])):
            size += len(where[at][2])
            group.append(where[at])
            at += 1
        longest = max(len(g[2]) for g in group)
        count = max(1, -(-(longest - LENGTH) // STRIDE) + 1)
        padded = np.full((len(group), (count - 1) * STRIDE + LENGTH), CHARS - 1)
        for k, (_, _, ids) in enumerate(group):
            padded[k, :len(ids)] = ids
        score, weight = np.zeros((*padded.shape, TAGS), dtype=np.float32), np.zeros(padded.shape[1], dtype=np.float32)
        for w in range(count):
            s = slice(w * STRIDE, w * STRIDE + LENGTH)
            score[:, s] += model.emissions(padded[:, s]) * edge[None, :, None].astype(np.float32)
            weight[s] += edge
        score /= weight[None, :, None]
        score[padded == CHARS - 1, 1:] = -1e4  # nothing goes on in padding
        for (i, a, ids), tags in zip(group, model.decode(score), strict=True):
            out[i] += [(a + s, a + e, k) for s, e, k in spans_of(tags[:len(ids)])]
    return out


def all_spans(text: str, proposed: list[Span]) -> tuple[list[Span], list[Span]]:
    """Base spans; base spans with the accepted ones."""
    base = base_spans(text)
    taken, added = list(base), []
    for a, b, kind in sorted(proposed):
        while a < b and text[a].isspace():
            a += 1
        while b > a and (text[b - 1].isspace() or text[b - 1] in ".,;:!?"):
            b -= 1
        if b > a and plausible(text, (a, b, kind)) and all(b <= x or y <= a for x, y, _ in taken):
            taken.append((a, b, kind))
            added.append((a, b, kind))
    return base, in_order(base + added)


def find(df: DataFrame, model: Tagger, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans.

    The counts and the hash are of the base spans, ``spans`` lists all. Null texts count as empty
    and have no spans; whole texts of any length are read; repeated rows are read each; an empty
    table gives no rows.
    """
    docs = columns(df, doc_id=doc_id, text=text)
    spec = f"doc_id {kind_of(docs, 'doc_id')}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"
    spec, schema = arrow_schema(docs, spec)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_batches(batches):
            found = found_in(model, texts)
            counts = {f"n_{k}": [sum(s[2] == k for s in base) for base, _ in found] for k in KINDS}
            yield rows_of(
                schema, doc_id=batch.column("doc_id").to_pylist(), base_sha256=[hashlib.sha256(joined(b).encode()).hexdigest() for b, _ in found],
                spans=[joined(s) for _, s in found], **counts,
            )

    return docs.mapInArrow(run, spec)


def found_in(model: Tagger, texts: list[str]) -> list[tuple[list[Span], list[Span]]]:
    marked = np.array([bool(HAS.search(t)) for t in texts], dtype=bool)
    some = [t for t, m in zip(texts, marked, strict=True) if m]
    proposed = iter(zip(some, tag_texts(model, some), strict=True))
    return [all_spans(*next(proposed)) if m else ([], []) for m in marked]


def masked(text: str, spans: list[Span]) -> str:
    out, at = [], 0
    for a, b, kind in spans:
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join(out) + text[at:]


def mask(df: DataFrame, model: Tagger, text: str = "text", n_chars: str | None = None) -> DataFrame:
    """The table with each span replaced by its kind in brackets, other columns as they were.

    ``n_chars`` names a column to hold the new length where a text has changed. Null texts stay null.
    """
    names = [f"_k{i}" for i in range(len(df.columns))]
    rows = df.toDF(*names)
    at = df.columns.index(text)
    length = None if n_chars is None or n_chars not in df.columns else df.columns.index(n_chars)
    spec, schema = arrow_schema(rows, ", ".join(f"{n} {kind_of(rows, n)}" for n in names))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_batches(batches, text=names[at]):
            found = found_in(model, texts)
            new = [masked(t, s) if s else t for t, (_, s) in zip(texts, found, strict=True)]
            null = batch.column(names[at]).is_null().to_pylist()
            out = [batch.column(n) for n in names]
            out[at] = pa.array([None if x else t for t, x in zip(new, null, strict=True)], schema.field(at).type)
            if length is not None:
                old = out[length].to_pylist()
                out[length] = pa.array([len(t) if s else n for t, (_, s), n in zip(new, found, old, strict=True)], schema.field(length).type)
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(out, schema, strict=True)], schema=schema)

    return rows.mapInArrow(run, spec).toDF(*df.columns)
