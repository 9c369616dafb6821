import numpy as np
import pyarrow as pa
import pytest

from panelwise.llm import nn_descent


def brute(ids, vectors, threshold=0.95):
    ok = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(x != 0 for x in v) for v in vectors]
    x = [np.array(v, dtype=float) / np.linalg.norm(np.array(v, dtype=float)) if g else None for v, g in zip(vectors, ok, strict=True)]
    n, parent = [0] * len(ids), list(range(len(ids)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if ok[i] and ok[j] and len(x[i]) == len(x[j]) and x[i] @ x[j] >= threshold:
                n[i] += 1
                n[j] += 1
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    groups = {}
    for i, key in enumerate(ids):
        if key is not None:
            groups[find(i)] = min(groups.get(find(i), key), key)
    return sorted(str((key, n[i], groups.get(find(i)) if ok[i] else key)) for i, key in enumerate(ids))


def rows_of(got):
    return sorted(str((r.vec_id, r.n_links, r.component_id)) for r in got)


def test_against_brute_force(spark):
    """Background, tight groups, a wide group that is not all linked, a chain, exact copies, and odd rows."""
    rng = np.random.default_rng(12)
    d, vectors = 16, []
    vectors += list(rng.standard_normal((300, d)))
    for size, noise in ((2, 0.02), (5, 0.05), (40, 0.03), (150, 0.075)):
        centre = rng.standard_normal(d)
        centre /= np.linalg.norm(centre)
        vectors += [centre + noise * rng.standard_normal(d) for _ in range(size)]
    a, b = np.linalg.qr(rng.standard_normal((d, 2)))[0].T
    vectors += [np.cos(t) * a + np.sin(t) * b for t in np.arange(0, 1.5, 0.25)]
    vectors += [vectors[3]] * 6 + [2 * vectors[3]]
    vectors = [[float(np.float32(x)) for x in v] for v in vectors]
    vectors += [None, [], [0.0] * d, [float("nan")] + [1.0] * (d - 1), [float("inf")] * d, [None] + [1.0] * (d - 1), [1.0, 2.0], [1.0, 2.01], [1.0]]
    ids = [int(i) * 7 % 10_007 for i in range(len(vectors))]
    ids[5], ids[-1], ids[-4] = None, 3, None
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in zip(ids, vectors, strict=True)], "vec_id long, embedding array<float>, node int, component string").repartition(3)
    log = []
    got = nn_descent.near_vectors(df, log=log).collect()
    assert rows_of(got) == brute(ids, vectors) and all(r >= nn_descent.AUDIT_RECALL for _, _, r in log[-1:])
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)


def test_blocks_of_a_wide_group(spark):
    rng = np.random.default_rng(3)
    centre = np.ones(12) / 12**0.5
    vectors = [(centre + 0.085 * rng.standard_normal(12)).astype(float) for _ in range(120)]
    rows = [(i, 0, i % 3 + 1, [float(x) for x in v]) for i, v in enumerate(vectors)]
    df = spark.createDataFrame(rows, "node long, component long, weight long, vec array<double>")
    old, nn_descent.BLOCK = nn_descent.BLOCK, 25
    try:
        got = {r.node: r.linked for r in nn_descent.linked_weights(df, 0.95).collect()}
    finally:
        nn_descent.BLOCK = old
    x = np.array([v / np.linalg.norm(v) for v in vectors])
    hit = x @ x.T >= 0.95
    np.fill_diagonal(hit, False)
    assert got == {i: int(hit[i] @ np.array([r[2] for r in rows])) for i in range(120)} and hit.mean() < 0.99


def test_empty_and_nothing_valid(spark):
    df = spark.createDataFrame([(1, None), (2, [0.0])], "vec_id long, embedding array<float>")
    assert rows_of(nn_descent.near_vectors(df).collect()) == ["(1, 0, 1)", "(2, 0, 2)"]
    assert nn_descent.near_vectors(df.limit(0)).count() == 0


def test_table_against_brute_force(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = table.collect()
    assert rows_of(nn_descent.near_vectors(table).collect()) == brute([r.vec_id for r in rows], [r.embedding for r in rows])


def test_isolated_pairs_in_a_large_background(spark):
    """Thousands of pairs near the threshold; unrelated vectors are far from all others."""
    rng = np.random.default_rng(21)
    n, pairs, d = 40_000, 3_000, 64
    x = rng.standard_normal((n, d))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    away = rng.standard_normal((pairs, d))
    away -= np.einsum("ij,ij->i", away, x[:pairs])[:, None] * x[:pairs]
    away /= np.linalg.norm(away, axis=1, keepdims=True)
    cosine = rng.uniform(0.952, 0.97, pairs)[:, None]
    x = np.concatenate([x, cosine * x[:pairs] + np.sqrt(1 - cosine**2) * away]).astype(np.float32)
    df = spark.createDataFrame(pa.table({"vec_id": np.arange(len(x)), "embedding": pa.FixedSizeListArray.from_arrays(x.ravel(), d).cast(pa.list_(pa.float32()))}))
    got = {r.vec_id: (r.n_links, r.component_id) for r in nn_descent.near_vectors(df).collect()}
    found = sum(got[i] == (1, i) and got[n + i] == (1, i) for i in range(pairs))
    assert found >= 0.998 * pairs
    assert all(got[i] == (0, i) for i in range(pairs, n))


def test_too_low_a_recall_is_an_error(spark, monkeypatch):
    df = spark.createDataFrame([(i, [1.0, i / 1e3]) for i in range(9)], "vec_id long, embedding array<double>")
    monkeypatch.setattr(nn_descent, "audit", lambda *_: 0.9)
    with pytest.raises(RuntimeError, match="0.9"):
        nn_descent.near_vectors(df)


def test_links_between_two_dense_groups(spark):
    """Groups wider than any list, with links between them at 0.95 to 0.96 only."""
    rng = np.random.default_rng(4)
    d, size, vectors = 16, 80, list(np.random.default_rng(5).standard_normal((100, 16)))
    a, b = np.linalg.qr(rng.standard_normal((d, 2)))[0].T
    turn = np.arccos(0.955)
    for centre in (a, np.cos(turn) * a + np.sin(turn) * b):
        vectors += [centre + 0.002 * rng.standard_normal(d) for _ in range(size)]
    vectors = [[float(x) for x in v] for v in vectors]
    df = spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<double>").repartition(3)
    want = brute(range(len(vectors)), vectors)
    assert sum(f"{size + size - 1}, 100" in w for w in want) > size
    old, nn_descent.BLOCK = nn_descent.BLOCK, 30
    try:
        assert rows_of(nn_descent.near_vectors(df).collect()) == want
    finally:
        nn_descent.BLOCK = old
