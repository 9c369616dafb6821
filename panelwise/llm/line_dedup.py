"""Lines that many documents share, dropped from all of them. Spark functions only.

Texts are split at line breaks and each line is reduced to a key: stripped of ASCII white space at
both ends, A-Z lower-cased. Each document gives every key it holds once, as two 64-bit hashes; the
documents per key are counted, partly before the shuffle. The lines whose key is too common are found
again by their hashes, and a document is put together from the stretches between its dropped lines,
in order. Only hashes and positions of lines are shuffled; a text is moved once, to meet the positions
of its own dropped lines.

Odd input: a null text is one empty line, like an empty one. Every row is a document of its own, repeated
rows and repeated or null ids included. Lines whose key is shorter than ``min_chars`` stay. A very common
line is a hot key of the second step only, where its rows carry no text and the join is split at run
time. An empty table gives no rows. Columns other than the text are passed on as they are, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

MIN_DOCS, MIN_CHARS = 10, 1
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def stripped(line: Column) -> Column:
    return F.btrim(line, F.lit(BLANKS))


def key_of(line: Column) -> Column:
    """Stripped, A-Z lower-cased, all other characters as they are; plain ASCII lines take the quicker way."""
    plain = F.octet_length(line) == F.char_length(line)
    return F.when(plain, F.lower(stripped(line))).otherwise(F.translate(stripped(line), UPPER, LOWER))


def hashes(key: Column) -> list[Column]:
    """Two hashes of a key: lines are taken for equal when both agree."""
    return [F.xxhash64(F.lit(i), key).alias(f"h{i}") for i in (1, 2)]


def common_lines(texts: DataFrame, text: str = "text", min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS) -> DataFrame:
    """h1, h2, n_docs of the keys found in at least ``min_docs`` documents."""
    long_enough = F.filter(lines_of(F.col(text)), lambda line: F.char_length(stripped(line)) >= min_chars)
    keys = texts.select(F.explode(F.array_distinct(F.transform(long_enough, key_of))).alias("key"))
    counted = keys.select(*hashes(F.col("key"))).groupBy("h1", "h2").agg(F.count("*").alias("n_docs"))
    return counted.where(F.col("n_docs") >= min_docs)


def with_common_lines(
    docs: DataFrame, text: str = "text", min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS
) -> DataFrame:
    """row, a struct of all the columns of ``docs``; lines, its text's lines; ends, the sorted positions of those to drop and one past the last line.

    A row is known by its id columns and its text's hash: rows equal in both are the same text, and share
    their positions. Spreading by id keeps copies of one text in different tasks.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    mine = F.col(f"row.`{text}`")
    others = [F.col(f"row.`{c}`") for c, kind in docs.dtypes if c != text and kind in ("bigint", "int", "string")]
    name = [F.xxhash64(F.lit(i), *others, mine).alias(f"d{i}") for i in (1, 2)]
    rows = rows.select("row", *name)
    common = common_lines(docs.select(F.col(f"`{text}`").alias("text")), "text", min_docs, min_chars).select("h1", "h2")

    placed = rows.select("d1", "d2", F.posexplode(lines_of(mine)).alias("position", "line"))
    placed = placed.where(F.char_length(stripped(F.col("line"))) >= min_chars)
    found = placed.select("d1", "d2", "position", *hashes(key_of(F.col("line")))).join(common, ["h1", "h2"], "left_semi")
    dropped = found.groupBy("d1", "d2").agg(F.array_sort(F.collect_set("position")).alias("dropped"))
    met = rows.join(dropped, ["d1", "d2"], "left")
    split = met.select("row", lines_of(mine).alias("lines"), "dropped")
    return split.select("row", "lines", F.concat(F.coalesce("dropped", F.array().cast("array<int>")), F.array(F.size("lines"))).alias("ends"))


def kept_text() -> Column:
    """The lines at all other positions, joined: the stretches before, between and after the dropped ones."""
    lines, ends = F.col("lines"), F.col("ends")
    begin = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.element_at(ends, F.greatest(i, F.lit(1))) + 1)
    stretches = F.transform(ends, lambda end, i: F.slice(lines, begin(i) + 1, end - begin(i)))
    return F.array_join(F.when(F.size(ends) == 1, lines).otherwise(F.flatten(stretches)), "\n")


def drop_common_lines(
    docs: DataFrame, text: str = "text", min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS
) -> DataFrame:
    """The documents without their common lines; all columns stay. A null text stays null."""
    met = with_common_lines(docs, text, min_docs, min_chars)
    new = F.when(F.col(f"row.`{text}`").isNotNull(), kept_text())
    return met.select(*[(new if c == text else F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def line_report(
    docs: DataFrame, key: str = "doc_id", text: str = "text", min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS
) -> DataFrame:
    """Per document: its id, the number of lines and of dropped lines, and the SHA-256 of what is kept."""
    met = with_common_lines(docs.select(F.col(f"`{key}`").alias("doc_id"), F.col(f"`{text}`").alias("text")), "text", min_docs, min_chars)
    return met.select(
        F.col("row.doc_id").alias("doc_id"), F.size("lines").cast("long").alias("n_lines"),
        (F.size("ends") - 1).cast("long").alias("n_dropped"), F.sha2(kept_text(), 256).alias("kept_sha256"),
    )


#: The same in SQL, for the registered query.
SQL = f"""
WITH lines AS (
  SELECT doc_id, i, string_split(coalesce(text, ''), chr(10))[i] AS line
  FROM (SELECT doc_id, text, unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS i FROM documents)),
keyed AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{UPPER}', '{LOWER}') AS k FROM lines),
common AS (SELECT k FROM keyed WHERE length(k) >= {MIN_CHARS} GROUP BY k HAVING count(DISTINCT doc_id) >= {MIN_DOCS})
SELECT doc_id, count(*) AS n_lines, count(c.k) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (c.k IS NULL), '')) AS kept_sha256
FROM keyed LEFT JOIN common c USING (k) GROUP BY doc_id
"""
