import re

from panelwise.llm import licenses
from panelwise.llm.license_texts import PHRASES, TEMPLATES


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def base(text):
    w = words(text)
    places = [(i, label) for phrase, label in PHRASES.items() for i in range(len(w)) if w[i:i + len(phrase.split())] == phrase.split()]
    starts = [i for i, _ in places]
    return len(w), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({b for _, b in places}))


def test_scan(spark):
    prose = "some words that stand before the notice and some more of them "
    mit = next(t for label, t in TEMPLATES if label == "mit" and len(t) > 100).split()
    edited = mit[:20] + ["kindly", "and", "freely"] + mit[20:50] + mit[54:]
    rows = [
        (1, None, ""), (2, "", ""), (3, "the MIT-License!", "mit"), (3, "the MIT-License!", "mit"), (4, "éMIT license, mit  LICENSE general public license", "gpl,mit"),
        (5, prose * 50 + " ".join(edited) + prose, "mit"), (6, prose + " ".join(mit[:30]), ""), (7, "under the terms of the contract, free of charge", ""),
        (8, "Licensed under CC BY-NC 4.0.", "cc-by-nc"), (9, "mit license " * 20_000, "mit"), (None, next(t for label, t in TEMPLATES if label == "bsd"), "bsd"),
        (10, "Apache License mit", "apache"), (11, "permission is hereby granted " * 3000, ""),
    ]
    df = spark.createDataFrame([(a, b, "x", 1) for a, b, _ in rows], "doc_id long, text string, labels string, row int").repartition(3)
    got = licenses.scan(df).collect()
    assert len(got) == len(rows)
    want = sorted(str((k, *base(t), label)) for k, t, label in rows)
    assert sorted(str((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels)) for r in got) == want
    by = {r.doc_id: r for r in got}
    assert by[1].score == 0 and by[3].score == 1 and 0.75 <= by[5].score < 1 and by[None].score == 1 and 0 < by[5].spans[0].low < by[5].spans[0].high
    assert licenses.scan(df.limit(0)).count() == 0


def test_tables_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = {r.doc_id: base(r.text) for r in docs.collect()}
    got = licenses.scan(docs).collect()
    assert len(got) == len(want)
    for r in got:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == want[r.doc_id]
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
