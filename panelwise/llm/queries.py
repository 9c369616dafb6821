"""The queries of the numbered operators, with production parameters over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from panelwise.llm import elias_fano, html_text, langid, latent, licenses, line_dedup, merkle, minhash, nn_descent, packing, pii, prefix_trie, substrings
from panelwise.llm.base import QUERIES, SQL, query, table  # noqa: F401
from panelwise.llm.tokens import public_file


@query("op1_harmonic_packing")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"), public_file("byte_bpe_50k.json"))


@query("op2_elias_fano_tokens")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    return elias_fano.round_trip(spark, table(spark, folder, "documents"), public_file("word_bpe_49k.json"))


@query("op3_language_id")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    return langid.predict_documents(table(spark, folder, "documents"))


@query("op9_line_block_text")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    return html_text.extract(table(spark, folder, "pages"), keep=["page_id", "url"])


@query("op10_prob_minhash")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, folder, "documents")).drop("node")


@query("op4_latent_decontamination")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    return latent.find_leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query("op6_license_diagonals")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.scan(table(spark, folder, "documents")).drop("spans")


@query("op5_bucket_refinement")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    return substrings.remove_repeated(table(spark, folder, "documents"))


@query("op7_nn_descent", """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
reach(vec_id, other) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.vec_id, l.b FROM reach r JOIN links l ON l.a = r.other),
smallest AS (SELECT vec_id, min(other) AS component_id FROM reach GROUP BY vec_id),
counted AS (SELECT a AS vec_id, count(*) AS n_links FROM links GROUP BY a)
SELECT v.vec_id, coalesce(n_links, 0) AS n_links, component_id, v.vec_id = component_id AS kept
FROM v LEFT JOIN counted USING (vec_id) JOIN smallest USING (vec_id)
""")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    return nn_descent.near_vectors(table(spark, folder, "embeddings"))


@query("op8_bilstm_crf_pii")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return pii.find(docs, pii.fit(docs))


@query("op11_line_dedup", line_dedup.SQL)
def op11(spark: SparkSession, folder: str) -> DataFrame:
    return line_dedup.line_report(table(spark, folder, "documents"))


@query("op13_merkle_manifest", merkle.SQL)
def op13(spark: SparkSession, folder: str) -> DataFrame:
    return merkle.verify(table(spark, folder, "documents"), tampered=merkle.fifth())


@query("op12_prefix_trie", prefix_trie.SQL)
def op12(spark: SparkSession, folder: str) -> DataFrame:
    return prefix_trie.trie(table(spark, folder, "conversations"))
