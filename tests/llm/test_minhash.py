import collections
import re

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from panelwise.llm import graph, minhash
from panelwise.llm.words import Words, runs, shingles


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="aB9é -\n€", max_size=14), max_size=5), st.integers(1, 4))
def test_words_and_runs(texts, k):
    w = Words.of(texts)
    want = [words(t) for t in texts]
    assert np.diff(w.first).tolist() == [len(x) for x in want] if texts else len(w.hashes) == 0
    flat = [x for t in want for x in t]
    assert [w.word(i) for i in range(len(flat))] == flat
    assert len(set(zip(flat, w.hashes.tolist(), strict=True))) == len(set(flat)) == len(set(w.hashes.tolist()))
    grams = [tuple(t[i:i + k]) for t in want for i in range(len(t) - k + 1)]
    h, at = runs(w, k)
    assert len(h) == len(grams) and len(set(zip(grams, h.tolist(), strict=True))) == len(set(grams)) == len(set(h.tolist()))
    assert [tuple(flat[i:i + k]) for i in at.tolist()] == grams
    _, text = shingles(w, k)
    assert np.bincount(text, minlength=len(texts)).tolist() == [max(len(x) - k + 1, int(len(x) > 0)) for x in want]


def slow_similarity(x, y):
    total = 0.0
    for d in x.keys() & y.keys():
        total += 1 / sum(max(x.get(e, 0) / x[d], y.get(e, 0) / y[d]) for e in x.keys() | y.keys())
    return total


@settings(max_examples=150, deadline=None)
@given(*[st.dictionaries(st.integers(0, 9), st.integers(1, 5), min_size=1)] * 2)
def test_exact_similarity(x, y):
    arrays = [np.array(sorted(d), dtype=np.uint64) for d in (x, y)], [np.array([d[k] for k in sorted(d)]) for d in (x, y)]
    got = minhash.probability_jaccard(arrays[0][0], arrays[1][0], arrays[0][1], arrays[1][1])
    assert got == pytest.approx(slow_similarity(x, y))


def test_registers_estimate_the_similarity():
    rng = np.random.default_rng(5)
    texts = []
    for _ in range(60):
        base = [f"w{i}" for i in rng.integers(0, 40, 120)]
        other = list(base)
        for i in rng.integers(0, 120, 3):
            other[i] = "new"
        texts += [" ".join(base + base[:30]), " ".join(other + other[:30])]
    m = 2000
    kept, has = minhash.signature(texts, 2, m)
    assert has.all()
    for i in range(0, len(texts), 2):
        x, y = (collections.Counter(zip(words(t), words(t)[1:], strict=False)) for t in texts[i:i + 2])
        assert abs((kept[i] == kept[i + 1]).mean() - slow_similarity(x, y)) < 5 * (0.25 / m) ** 0.5
    assert not minhash.signature(["", "!", "one"], 5, 8)[1][:2].any()


def test_components(spark):
    rng = np.random.default_rng(2)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 400, (260, 2))] + [(i, i + 1) for i in range(1000, 1200)] + [(2000, i) for i in range(2001, 2100)]
    parent = list(range(3000))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    nodes = {x for a, b in links for x in (a, b) if a != b}
    assert got == {x: find(x) for x in nodes}


def text_of(rng, n=80):
    return [f"w{i}" for i in rng.integers(0, 5000, n)]


def test_groups_against_brute_force(spark):
    """A chain of copies of copies, a large group around one text, exact copies, odd rows."""
    rng = np.random.default_rng(9)
    rows = []
    chain = text_of(rng, 100)
    for i in range(8):  # each near the one before, the ends far apart
        rows.append((100 + i, " ".join(chain)))
        chain = list(chain)
        chain[5 + 12 * i] = f"edit{i}"
        chain[9 + 12 * i] = f"edit{i}"
    base = text_of(rng, 120)
    for i in range(60):
        copy = list(base)
        copy[int(rng.integers(0, 120))] = f"x{i}"
        rows.append((300 - i, " ".join(copy)))
    rows += [(10, "Same words, here!"), (11, "same words here"), (11, "same words here"), (12, None), (13, ""), (14, ""), (None, "same words here"), (15, "!!"), (16, "!!"), (20, "lone " + " ".join(text_of(rng)))]
    rows += [(400 + i, " ".join(text_of(rng, 60))) for i in range(40)]
    df = spark.createDataFrame([(a, b, True, 7) for a, b in rows], "doc_id long, text string, kept boolean, node int").repartition(3)
    got = minhash.near_duplicates(df).collect()
    assert len(got) == len(rows)
    shingled = [collections.Counter(tuple(words(t)[i:i + 5]) for i in range(max(1, len(words(t)) - 4))) if t and words(t) else {} for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            same = rows[i][1] and rows[i][1] == rows[j][1]
            if same or shingled[i] and shingled[j] and len(shingled[i].keys() & shingled[j].keys()) and slow_similarity(shingled[i], shingled[j]) >= 0.8:
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    groups = collections.defaultdict(list)
    for i, (key, _) in enumerate(rows):
        groups[find(i)].append(key)
    want = sorted((str(k), str(min((x for x in g if x is not None), default=None)), len(g)) for g in groups.values() for k in g)
    assert sorted((str(r.doc_id), str(r.class_id), r.n_members) for r in got) == want
    assert sum(r.kept for r in got) == len(groups)
    left = minhash.drop_near_duplicates(df)
    assert left.columns == df.columns and left.count() == len(groups)
    assert {r.doc_id for r in left.collect()} == {r.doc_id for r in got if r.kept}
    assert minhash.near_duplicates(df.limit(0)).count() == 0


def test_blocks_join_every_linked_group(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(20):
        base = text_of(rng, 60)
        for copy in range(3):
            text = " ".join(base[:-1] + [f"end{copy}"])
            marks = minhash.signature([text], 5, 48)[0].astype("<u2")
            rows.append((7, 10 * i + copy, 10 * i + copy, bytearray(marks.tobytes()), text))
    df = spark.createDataFrame(rows, "group long, node long, component long, registers binary, text string")
    for block in (6, 512):
        monkeypatch.setattr(minhash, "BLOCK", block)
        got = {(r.a, r.b) for r in minhash.across(df, 5, 0.8, 0.2).collect()}
        assert all(a // 10 == b // 10 for a, b in got)
        label = graph.components(spark.createDataFrame(sorted(got), "a long, b long")).collect()
        assert {(r.node, r.component) for r in label} == {(10 * i + c, 10 * i) for i in range(20) for c in range(3)}


def test_wide_families_bucket_by_bucket(spark, monkeypatch):
    rng = np.random.default_rng(14)
    base = text_of(rng, 120)
    rows = [(i, " ".join(base[:k] + [f"x{i}"] + base[k + 1:])) for i, k in enumerate(rng.integers(0, 120, 30).tolist())]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted((r.doc_id, r.class_id) for r in minhash.near_duplicates(df).collect())
    monkeypatch.setattr(minhash, "FAMILY", 3)
    assert sorted((r.doc_id, r.class_id) for r in minhash.near_duplicates(df).collect()) == want
