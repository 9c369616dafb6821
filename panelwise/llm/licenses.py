"""Licence scan by diagonal voting.

The hashes of all runs of words of a document are joined with the runs of the templates. A match
of word p of the document with word t of a template votes for the diagonal p - t. Votes are counted
by diagonal, neighbouring diagonals (words put in or left out) are merged, and a merged diagonal is
accepted when the template words under its matches are a large enough part of the template. Phrases
are templates that match as a whole.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from panelwise.llm.base import arrow_schema, columns, kind_of, materialize, rows_of, text_batches
from panelwise.llm.license_texts import PHRASES, TEMPLATES
from panelwise.llm.words import Words, run_hashes, runs

RUN = 4  # words of a run
NEIGHBOURS = 6  # diagonals this near are merged
SHARE = 0.75  # of a template's words under matches
LONG, LONG_SHARE = 30, 0.5  # templates of so many words need only this share


def template_runs(templates: list[tuple[str, str]], phrases: dict[str, str], k: int) -> list[tuple]:
    """template, label, is a phrase, words of the template, words of the run, place in the template, hash, the run itself."""
    out = []
    for number, (label, text, phrase) in enumerate([*((a, b, False) for a, b in templates), *((b, a, True) for a, b in phrases.items())]):
        words = Words.of([text])
        size = len(words.hashes)
        if not size:
            raise ValueError(f"a template without words: {text!r}")
        n = size if phrase else min(k, size)
        for at, h in enumerate(run_hashes(words.hashes, n).view(np.int64).tolist()):
            out.append((number, label, phrase, size, n, at, h, " ".join(words.word(at + j) for j in range(n))))
    return out


def scan(
    df: DataFrame, doc_id: str = "doc_id", text: str = "text", templates: list[tuple[str, str]] = TEMPLATES,
    phrases: dict[str, str] = PHRASES, k: int = RUN, share: float = SHARE,
) -> DataFrame:
    """One row per row of the table.

    doc_id, n_words; n_base, first_word, last_word, base_labels: places of the phrases; labels:
    those of phrases and accepted templates; score: the largest share of a template's words found
    in place, 1 for a phrase, 0 for none; spans: the accepted label, first and last word and share.

    Null texts count as empty; a text without a match has empty labels, null words and no spans.
    Repeated rows are scanned each; an empty table gives none.
    """
    docs = columns(df, doc_id=doc_id, text=text)
    made = template_runs(templates, phrases, k)
    wanted: dict[int, dict[int, str]] = {}
    for _, _, _, _, n, _, h, run in made:
        wanted.setdefault(n, {})[h] = run
    spec = f"row long, doc_id {kind_of(docs, 'doc_id')}, n_words long, hits array<struct<at:int,hash:long>>"
    spec, schema = arrow_schema(docs, spec)

    def find(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 33
        sought = {n: np.sort(np.array(list(d), dtype=np.int64)) for n, d in wanted.items()}
        for batch, texts in text_batches(batches):
            words = Words.of(texts)
            of_text = words.text_of()
            hits: list[list] = [[] for _ in texts]
            for n, keys in sought.items():
                h, at = runs(words, n)
                h = h.view(np.int64)
                place = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
                for i in np.flatnonzero(keys[place] == h).tolist():
                    if " ".join(words.word(int(at[i]) + j) for j in range(n)) == wanted[n][int(h[i])]:  # the words, not only their hash
                        t = int(of_text[at[i]])
                        hits[t].append({"at": int(at[i] - words.first[t]), "hash": int(h[i])})
            yield rows_of(schema, row=np.arange(row, row + len(texts)), doc_id=batch.column("doc_id").to_pylist(), n_words=np.diff(words.first), hits=hits)
            row += len(texts)

    found = materialize(docs.mapInArrow(find, spec))
    grams = df.sparkSession.createDataFrame([m[:7] for m in made], "template int, label string, phrase boolean, size int, n int, t int, hash long")
    # the templates are a fixed list of a few hundred runs
    votes = found.where(F.size("hits") > 0).select("row", F.explode("hits").alias("hit")).select("row", "hit.at", "hit.hash").join(F.broadcast(grams), "hash")
    places = votes.where("phrase").groupBy("row").agg(
        F.count("*").alias("n_base"), F.min("at").cast("long").alias("first_word"), F.max("at").cast("long").alias("last_word"), F.collect_set("label").alias("base")
    )
    diagonals = votes.where("NOT phrase").groupBy("row", "template", "label", "size", (F.col("at") - F.col("t")).alias("diagonal")).agg(
        F.collect_set(F.struct("t", "n")).alias("matched"), F.min("at").alias("low"), F.max(F.col("at") + F.col("n") - 1).alias("high")
    )
    order = Window.partitionBy("row", "template").orderBy("diagonal")
    step = F.when(F.col("diagonal") - F.lag("diagonal").over(order) <= NEIGHBOURS, 0).otherwise(1)
    merged = diagonals.withColumn("step", step).withColumn("band", F.sum("step").over(order)).groupBy("row", "template", "label", "size", "band").agg(
        F.array_distinct(F.flatten(F.collect_list("matched"))).alias("matched"), F.min("low").alias("low"), F.max("high").alias("high")
    )
    under = F.size(F.array_distinct(F.flatten(F.transform("matched", lambda m: F.sequence(m["t"], m["t"] + m["n"] - 1)))))
    least = F.when(F.col("size") >= LONG, min(LONG_SHARE, share)).otherwise(share)
    accepted = merged.withColumn("share", under / F.col("size")).where(F.col("share") >= least).groupBy("row").agg(
        F.collect_set("label").alias("voted"), F.max("share").alias("best"), F.sort_array(F.collect_list(F.struct("label", "low", "high", "share"))).alias("spans")
    )
    none = F.array().cast("array<string>")
    base, voted = F.coalesce("base", none), F.coalesce("voted", none)
    out = found.drop("hits").join(places, "row", "left").join(accepted, "row", "left")
    return out.select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word",
        F.array_join(F.array_sort(base), ",").alias("base_labels"), F.array_join(F.array_sort(F.array_union(base, voted)), ",").alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"), "spans",
    )
