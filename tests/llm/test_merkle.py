import os
import random
import zlib
from hashlib import sha256

import numpy as np
import pytest

import compare
from panelwise.llm import merkle

FOLDER = "/root/testdata/sf0.01"
DDL = "doc_id long, text string, lang string, source string, n_chars long"


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf(doc_id, text, lang, source, n_chars):
    show = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    return h(*[show(v) for v in (doc_id, source, lang, n_chars, text)])


def levels(nodes):
    found = [nodes]
    while len(found[-1]) > 1:
        found.append([h(*found[-1][i:i + 16]) for i in range(0, len(found[-1]), 16)])
    return found


def way(tree, i):
    for level in tree[:-1]:
        j, at = divmod(i, 16)
        yield level[j * 16:j * 16 + at], level[j * 16 + at + 1:j * 16 + 16]
        i = j


def expected(rows):
    first = lambda v: (v is not None, v if v is not None else 0)
    groups = {}
    for r in rows:
        groups.setdefault(r[3], []).append(r)
    trees = {}
    for source, mine in groups.items():
        mine.sort(key=lambda r: (*first(r[0]), leaf(*r)))
        trees[source] = levels([leaf(*r) for r in mine])
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    top = levels([trees[s][-1][0] for s in order])
    out = []
    for place, source in enumerate(order):
        for i, r in enumerate(groups[source]):
            path = [*way(trees[source], i), *way(top, place)]
            node = leaf(*r)
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[1] is not None:
                node = leaf(r[0], "".join(c.lower() if "A" <= c <= "Z" else c for c in r[1]), *r[2:])
            for left, right in path:
                node = h(*left, node, *right)
            proof = h(*[x for left, right in path for x in (*left, *right)])
            out.append((r[0], leaf(*r), trees[source][-1][0], top[-1][0], proof, node, node == top[-1][0]))
    return out


def got(spark, rows, height):
    df = spark.createDataFrame(rows, DDL)
    return sorted(map(tuple, merkle.verify(df, merkle.fifth(), height=height).collect()), key=repr)


def test_layout():
    """Each level's addresses are new, half the levels come first, and children of the last level stand together."""
    for n in range(1, 6):
        places = merkle.layout(n)
        every = np.sort(np.concatenate(places))
        assert (every == np.arange(merkle.size_of(n))).all() and places[0][0] == 0
        upper = n // 2
        if upper:
            assert max(int(p.max()) for p in places[:upper]) < merkle.size_of(upper) <= min(int(p.min()) for p in places[upper:])
        if n > 1:
            assert (np.diff(places[-1].reshape(-1, 16), axis=1) == 1).all()


@pytest.mark.parametrize("height", [1, 2, 4])
def test_small_groups_against_brute_force(spark, height):
    """Groups of 1, 15, 16, 17, 256, 257 and 300 rows, a null group, null fields, odd texts."""
    chance = random.Random(height)
    rows, doc_id = [], 0
    for source, n in (("a", 1), ("b", 15), ("B", 16), ("c", 17), ("é", 256), ("d", 257), (None, 300), ("", 2)):
        for _ in range(n):
            doc_id += chance.randint(1, 9)
            text = chance.choice(["Plain Text", None, "", "ÀÉ lower only", "MiXed É 😀", "x" * 3000])
            rows.append((doc_id, text, chance.choice(["en", None]), source, chance.choice([None, 5])))
    chance.shuffle(rows)
    assert got(spark, rows, height) == sorted(expected(rows), key=repr)


def test_many_groups(spark):
    rows = [(i, f"T{i}", "en", f"s{i % 40:02}", i) for i in range(80)]
    assert got(spark, rows, 1) == sorted(expected(rows), key=repr)


def test_repeated_rows_null_ids_and_one_row(spark):
    rows = [(None, "A", None, "s", None)] * 3 + [(7, "Bb", "en", "s", 2)] * 20 + [(7, "bb", "en", "s", 2), (None, None, None, None, None)]
    assert got(spark, rows, 1) == sorted(expected(rows), key=repr)
    assert got(spark, [(5, "One", "en", "s", 3)], 4) == expected([(5, "One", "en", "s", 3)])


def test_empty_table_and_other_columns(spark):
    assert got(spark, [], 4) == []
    rows = [(i, "Ab", "en", "s", 2) for i in range(40)]
    df = spark.createDataFrame([(*r, "x", 1, "y", 2) for r in rows], DDL + ", tree string, position long, digest string, total int")
    assert sorted(map(tuple, merkle.verify(df, merkle.fifth()).collect()), key=repr) == sorted(expected(rows), key=repr)


def test_very_long_text(spark):
    rows = [(i, "Long É text " * 200_000 if i == 3 else "t", "en", "s", 1) for i in range(20)]
    assert got(spark, rows, 2) == sorted(expected(rows), key=repr)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the tables are not here")
def test_tampered_rows_are_found(spark):
    """On the given table: all tiers but the last agree with SQL, and only rows whose text changes fail."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    run = lambda s, f: merkle.verify(s.read.parquet(f"{f}/documents.parquet"), merkle.fifth(), height=1)
    assert not compare.compare(spark, compare.connect(FOLDER), run, merkle.SQL, FOLDER)[0]
    failed = {r.doc_id for r in merkle.verify(docs, merkle.fifth()).where("not verified").collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert failed == {i for i, t in texts.items() if zlib.crc32(str(i).encode()) % 5 == 0 and t and any("A" <= c <= "Z" for c in t)}
