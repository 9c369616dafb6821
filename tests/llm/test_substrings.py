import hashlib
from collections import Counter

import numpy as np
import pytest

from panelwise.llm import substrings


def brute(texts, n):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(r[i:i + n] for r in raw for i in range(len(r) - n + 1))
    out = []
    for r in raw:
        gone = np.zeros(len(r) + 1, dtype=bool)
        for i in range(len(r) - n + 1):
            if seen[r[i:i + n]] > 1:
                gone[i:i + n] = True
        kept = bytes(b for b, g in zip(r, gone, strict=False) if not g)
        starts = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
        out.append((len(r), len(r) - len(kept), starts, hashlib.sha256(kept).hexdigest()))
    return out


def check(spark, rows, n, parts=3):
    df = spark.createDataFrame([(a, b, "x", 1) for a, b in rows], "doc_id long, text string, row string, bucket int").repartition(parts)
    got = substrings.remove_repeated(df, length=n).collect()
    want = sorted(str((k, *b)) for (k, _), b in zip(rows, brute([t for _, t in rows], n), strict=True))
    assert sorted(str((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)) for r in got) == want
    return sum(r.n_removed for r in got)


def prose(rng, n):
    return "".join(rng.choice(list("abcdefghé \n"), n))


@pytest.mark.parametrize("n", [64, 100, 200])
def test_against_brute_force(spark, n):
    rng = np.random.default_rng(n)
    base = prose(rng, 3000)
    rows = [(1, None), (2, ""), (3, "short"), (4, base), (5, base), (6, prose(rng, n)), (7, "ab" * 400), (8, "a" * 700), (9, "a" * n), (9, "a" * n), (None, base[:500]), (None, None)]
    for i in range(40):  # pieces of one text between other text, with and without edits, around the length that counts
        a = int(rng.integers(0, 2500))
        piece = base[a:a + int(rng.integers(n - 6, 2 * n + 60))]
        if i % 3 == 0:
            k = int(rng.integers(0, len(piece)))
            piece = piece[:k] + "X" + piece[k + 1:]
        rows.append((100 + i, prose(rng, int(rng.integers(0, 90))) + piece + prose(rng, int(rng.integers(0, 90)))))
    twice = prose(rng, n + 5)
    rows += [(200, twice + "|" + twice), (201, prose(rng, n + 1)[:-1] + "z"), (202, "period" * 100), (203, "x" + "period" * 60)]
    assert check(spark, rows, n) > 0


def test_nothing_repeated_and_empty(spark):
    rng = np.random.default_rng(1)
    assert check(spark, [(i, prose(rng, 400)) for i in range(5)], 200) == 0
    df = spark.createDataFrame([], "doc_id long, text string")
    assert substrings.remove_repeated(df).count() == 0
    text = "é" + prose(rng, 300)
    assert substrings.remove_repeated(spark.createDataFrame([(1, text)], "doc_id long, text string"), with_kept=True).first().kept == text.encode()


def test_table_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert check(spark, rows, 200) > 0
