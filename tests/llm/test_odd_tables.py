"""Columns of clashing names beside an operator's own, and very long texts, change nothing."""

import pytest
from pyspark.sql import functions as F

from panelwise.llm import elias_fano, latent, licenses, minhash, nn_descent, packing, pii, substrings
from panelwise.llm.tokens import public_file

WORDS = "the lines of this text are made of plain words that go on for a while and mit license terms".split()
TEXTS = [
    " ".join(WORDS[(i * j) % len(WORDS)] for j in range(40 + i % 5)) + f" write to me{i % 3}@example.org or call +1 555 010 {1000 + i}" for i in range(12)
] * 2 + [None, "", " ".join(f"w{k % 997}" for k in range(60_000)) + " end"]
CLASHING = [
    "node", "row", "ids", "score", "bucket", "buckets", "component", "group", "family", "block", "registers", "a", "b", "n", "key", "tree", "position",
    "class", "class_id", "kept", "start", "length", "offset", "sequence_id", "spans", "labels", "item_id", "anchor", "cell", "own", "order", "part", "rank",
]


def documents(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").coalesce(1)


RUNS = {
    "packing": lambda spark, df: packing.pack(df, public_file("byte_bpe_50k.json")).select("doc_id", "start", "length", "ids_crc32", "doc_tokens"),
    "elias_fano": lambda spark, df: elias_fano.round_trip(spark, df, public_file("word_bpe_49k.json")),
    "latent": lambda spark, df: latent.find_leaks(df, spark.createDataFrame([(1, TEXTS[3]), (2, "nothing of the kind at all is said here or there")], "item_id long, text string").withColumn("node", F.lit(1))),
    "substrings": lambda spark, df: substrings.remove_repeated(df),
    "licenses": lambda spark, df: licenses.scan(df).drop("spans"),
    "minhash": lambda spark, df: minhash.near_duplicates(df).drop("node"),
}


@pytest.mark.parametrize("name", RUNS)
def test_clashing_columns(spark, name):
    plain = documents(spark)
    extra = plain.withColumns({c: F.lit("x") for c in CLASHING})
    rows = lambda df: sorted(map(repr, (tuple(r) for r in RUNS[name](spark, df).collect())))
    assert rows(extra) == rows(plain)


def test_personal_data_with_clashing_columns_and_a_long_text(spark):
    plain = documents(spark)
    model = pii.fit(plain, fit_docs=50)
    extra = plain.withColumns({c: F.lit("x") for c in CLASHING})
    rows = lambda df: sorted(map(repr, (tuple(r) for r in pii.find(df, model).collect())))
    assert rows(extra) == rows(plain)


def test_vectors_with_clashing_columns(spark):
    df = spark.createDataFrame([(i, [float(i % 3), 1.0, float(i % 2)]) for i in range(40)], "vec_id long, embedding array<float>")
    extra = df.withColumns({c: F.lit("x") for c in CLASHING})
    rows = lambda d: sorted(tuple(r) for r in nn_descent.near_vectors(d).collect())
    assert rows(extra) == rows(df)
