import tracemalloc

import numpy as np
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from panelwise.llm import latent
from panelwise.llm.words import Words


def slow_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b):
            before, row[j + 1] = row[j + 1], before + 1 if x == y else max(row[j], row[j + 1])
    return row[-1]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 5), min_size=1, max_size=90), st.lists(st.integers(0, 6), max_size=30))
def test_common_subsequence(a, b):
    item = latent.Item(0, a)
    assert latent.common_subsequence(item.masks(), len(a), b) == slow_lcs(a, b)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 130), max_size=5))
def test_passage_sums(counts):
    words = Words.of([" ".join(f"t{i % 7}" for i in range(n)) for n in counts])
    terms = np.unique(words.hashes)
    vectors = np.random.default_rng(1).standard_normal((len(terms), 3)).astype(np.float32)
    number = latent.term_numbers(terms, words.hashes)
    steps, ends = latent.cut(words)
    got = steps.sums(vectors, number, ends)
    want = []
    for i, n in enumerate(counts):
        blocks = -(-n // latent.STEP)
        mine = number[words.first[i]:words.first[i + 1]]
        for k in range(max(blocks - latent.STEPS + 1, 1) if n else 0):
            want.append(vectors[mine[k * latent.STEP:(k + latent.STEPS) * latent.STEP]].sum(axis=0))
    assert np.allclose(got, np.array(want).reshape(-1, 3), atol=1e-4)


def test_svd(spark):
    """The latent space of a matrix of low rank is that of its right singular vectors."""
    rng = np.random.default_rng(6)
    kinds = [rng.integers(0, 60, 8) for _ in range(5)]
    rows = [kinds[i % 5] for i in range(50)]
    idf = rng.random(60) + 0.5
    passages = spark.createDataFrame([([int(x) for x in r],) for r in rows[:30]], "terms array<int>").repartition(3)
    got = latent.latent_terms(passages, rows[30:], idf, 5).astype(float)
    dense = np.zeros((50, 60))
    for i, r in enumerate(rows):
        np.add.at(dense[i], r, idf[r])
    _, _, vt = np.linalg.svd(dense)
    assert np.allclose(got @ got.T, vt[:5].T @ vt[:5], atol=1e-4)


def corpus(n_items=60):
    rng = np.random.default_rng(8)
    common, rare = [f"c{i}" for i in range(40)], [f"r{i}" for i in range(4000)]

    def prose(n):
        return [str(rng.choice(common)) if rng.random() < 0.5 else str(rng.choice(rare)) for _ in range(n)]

    items = [(i, " ".join(prose(int(rng.integers(14, 70))))) for i in range(n_items)]
    docs, held = [], set()
    for d in range(300):
        text = prose(int(rng.integers(5, 400)))
        if d % 3 == 0:
            i = d // 3 % n_items
            words = items[i][1].split()
            if d % 2:  # a paraphrase: one word in eight another one
                words = [w if k % 8 else "other" for k, w in enumerate(words)]
            at = int(rng.integers(0, len(text)))
            text[at:at] = words
            held.add((d, i))
        docs.append((d, " ".join(text).capitalize() + "."))
    return docs, items, held


def test_leaks_against_brute_force(spark):
    docs, items, held = corpus()
    df = spark.createDataFrame([(a, b, 1.0) for a, b in docs], "doc_id long, text string, cosine double").repartition(4)
    bench = spark.createDataFrame([(a, b, "x") for a, b in items], "item_id long, text string, doc_id string")
    got = {(r.doc_id, r.item_id) for r in latent.find_leaks(df, bench, block_passages=400).collect()}
    words, item_words = Words.of([t for _, t in docs]), Words.of([t for _, t in items])
    brute = set()  # every item against every whole document
    for d in range(len(docs)):
        mine = words.hashes[words.first[d]:words.first[d + 1]].tolist()
        for i in range(len(items)):
            its = item_words.hashes[item_words.first[i]:item_words.first[i + 1]].tolist()
            if slow_lcs(its, mine) >= latent.VERBATIM * len(its):
                brute.add((d, i))
    assert len(held & got) >= 0.9 * len(held)
    assert len(brute & got) >= 0.9 * len(brute)
    assert not {g for g in got if g not in held and g not in brute}
    clean = latent.drop_leaks(df, bench)
    assert clean.columns == df.columns and {r.doc_id for r in clean.collect()} == {d for d, _ in docs} - {d for d, _ in got}


def test_odd_rows(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    rows = [(1, None), (2, ""), (3, "!!"), (4, item.upper()), (4, item.upper()), (None, f"x {item} y"), (5, "alpha beta"), (6, "two words here"), (7, "w " * 60_000 + item)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(9, item), (8, None), (7, ""), (6, "..."), (5, "two words"), (None, "beta two")], "item_id long, text string")
    got = sorted((str(r.doc_id), r.item_id) for r in latent.find_leaks(df, bench).collect())
    assert got == sorted([("4", 9), ("4", 9), ("None", 9), ("7", 9), ("6", 5)])
    assert latent.find_leaks(df.limit(0), bench).count() == 0 == latent.find_leaks(df, bench.limit(0)).count()
    assert {r.doc_id for r in latent.drop_leaks(df, bench).collect()} == {1, 2, 3, 5}


def test_verbatim_items_of_any_length_among_other_items_words(spark):
    """Short items diluted by the words around them, which are the benchmark's too, stay candidates."""
    rng = np.random.default_rng(9)
    vocabulary = [f"v{i}" for i in range(400)]
    items = [(i, " ".join(rng.choice(vocabulary, 3 + i % 57))) for i in range(114)]
    docs = []
    for i, text in items:
        around = rng.choice(vocabulary, 90).tolist()
        at = int(rng.integers(20, 70))
        docs.append((i, " ".join(around[:at] + [text] + around[at:])))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in latent.find_leaks(df, bench).collect()}
    assert {(i, i) for i, _ in items} <= got


def test_latent_space_of_all_passages(spark):
    """Every passage of every document is a row of the matrix, whatever their number; all of them share the corpus's weight."""
    docs, items, _ = corpus(12)
    terms = np.unique(Words.of([t for _, t in items]).hashes)
    df = spark.createDataFrame([(t,) for _, t in docs] + [(None,), ("",), ("?",)], "text string").repartition(4)
    size, want = latent.STEP * latent.STEPS, []
    for _, text in docs:
        number = latent.term_numbers(terms, Words.of([text]).hashes)
        want += [[int(t) for t in number[i:i + size] if t >= 0] for i in range(0, len(number), size)]
    passages = latent.passage_terms(df, terms)
    assert sorted(r.terms for r in passages.collect()) == sorted(w for w in want if w)
    rng, weight = np.random.default_rng(3), 0.2
    idf, own = rng.random(len(terms)) + 0.5, [rng.integers(0, len(terms), 30) for _ in range(20)]
    rank = 20
    chance = np.random.default_rng(latent.SEED).standard_normal((len(terms), rank + latent.OVERSAMPLE)).astype(np.float32) * idf[:, None].astype(np.float32)
    dense = np.zeros((len(own) + len(want), len(terms)))
    for i, r in enumerate([*own, *want]):
        np.add.at(dense[i], r, idf[r] * (1 if i < len(own) else weight ** 0.5))
    q, _ = np.linalg.qr(dense @ (chance / idf[:, None]))
    _, _, vt = np.linalg.svd(q.T @ dense, full_matrices=False)
    got = latent.latent_terms(passages, own, idf, rank, weight).astype(float)
    assert np.allclose(got @ got.T, vt[:rank].T @ vt[:rank], atol=1e-3)


def test_texts_are_read_once(spark):
    """Counts, latent space and comparison share one reading of a block's texts."""
    docs, items, held = corpus(12)
    read = spark.sparkContext.accumulator(0)

    def counted(text):
        read.add(1)
        return text

    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    df = df.withColumn("text", F.udf(counted, "string")("text"))
    got = {(r.doc_id, r.item_id) for r in latent.find_leaks(df, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert len(held & got) >= 0.9 * len(held)
    assert read.value == len(docs)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 700), max_size=6), st.integers(0, 3))
def test_sums_of_runs(counts, seed):
    rng = np.random.default_rng(seed)
    vectors, index = rng.standard_normal((9, 4)), rng.integers(0, 9, sum(counts))
    first = np.cumsum([0, *counts])[:-1]
    want = [vectors[index[a:a + n]].sum(axis=0) for a, n in zip(first, counts, strict=True)]
    assert np.allclose(latent.row_sums(vectors, index, first), np.array(want).reshape(-1, 4))


@settings(max_examples=60, deadline=None)
@given(st.sets(st.integers(0, 2**64 - 1) | st.integers(2**63, 2**63 + 40), max_size=40), st.lists(st.integers(0, 2**64 - 1) | st.integers(2**63, 2**63 + 40), max_size=40))
def test_numbers_of_terms(terms, others):
    terms = sorted(terms)
    place = {t: i for i, t in enumerate(terms)}
    got = latent.term_numbers(np.array(terms, dtype=np.uint64), np.array([*terms, *others], dtype=np.uint64))
    assert got.tolist() == [place.get(w, -1) for w in [*terms, *others]]


def test_memory_of_a_task():
    """A task's arrays stay small beside many passages of items, and so do the parts of a sum that tasks send."""
    rng = np.random.default_rng(4)
    n, size = 5_000, latent.STEP * latent.STEPS
    items = [latent.Item(i, rng.integers(0, n, size).tolist()) for i in range(latent.BLOCK_PASSAGES)]
    index = latent.Index(rng.standard_normal((n, latent.RANK)).astype(np.float32), items, np.empty((0, latent.RANK), np.float32), np.arange(len(items)))
    own = latent.Numbers(np.concatenate([i.words for i in items]), np.arange(len(items) + 1) * size)
    index.passage = index.unit(own)[1]
    words = latent.Numbers(np.where(rng.random(60_000) < 0.5, rng.integers(0, n, 60_000), -1), np.arange(0, 60_001, 400))
    tracemalloc.start()
    index.leaks(words)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 16_000_000
    assert latent.SLICE * (latent.RANK + latent.OVERSAMPLE) * 8 < 100_000
