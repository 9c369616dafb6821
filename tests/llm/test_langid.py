import numpy as np
from hypothesis import given, settings, strategies as st

from panelwise.llm import langid

TEXT = {"en": "the thing that there and with this other than", "de": "nicht schön über die straße und ich auch zwei", "es": "el niño que está aquí para los años"}


def brute(texts, orders):
    """N-grams within words, edges shown by a blank, counted text by text."""
    out = []
    for t in texts:
        low = "".join(c if c.isalpha() else " " for c in t.lower())
        low, n_all = f" {low} ", 0
        for n in orders:
            for i in range(len(low) - n + 1):
                g = low[i:i + n]
                inner = g[1:-1] if n > 2 else g.strip()
                n_all += bool(inner) and " " not in inner
        out.append(n_all)
    return out


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="aÉß ñ1\n", max_size=9), max_size=5))
def test_grams(texts):
    got = sum(np.diff(starts) for _, starts in langid.grams(texts)) if texts else np.empty(0)
    assert got.tolist() == brute(texts, langid.ORDERS)


def test_filter_returns_all_languages_of_a_gram():
    rng = np.random.default_rng(3)
    keys = rng.integers(0, 1 << 63, 9000).astype(np.uint64)
    for n in (3, 70):
        owner = np.concatenate([np.arange(6000) % n, np.arange(3000) % (n - 1)])
        f = langid.LanguageFilter.of([f"l{i:02}" for i in range(n)], np.concatenate([keys[:6000], keys[:3000]]), owner)
        found = f.containing(keys)
        for k, o in zip(range(6000), owner, strict=False):
            assert int(found[k, o // 64]) >> int(o % 64) & 1
        strangers = f.hits(found[6000:]) / 3000
        assert strangers.max() < 0.02 and np.allclose(f.hits(found), [sum(int(r[i // 64]) >> (i % 64) & 1 for r in found) for i in range(n)])


def test_table(spark):
    rows = [(i, " ".join(np.random.default_rng(i).permutation(TEXT[k].split())), k, 1.0) for i, k in enumerate(["en", "de", "es"] * 30)]
    rows += [(100, None, "en", 0.0), (101, "12 -- !", None, 0.0), (102, "", "de", 0.0), (None, "THE THING!! THE THING!!", None, 0.0), (103, "straße " * 20_000, None, 0.0), (103, "straße " * 20_000, None, 0.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")
    got = langid.predict_documents(df).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    for i, _, lang, _ in rows[:90]:
        assert by[i].lang_pred == lang and by[i].score > 0.9
    assert {by[i].lang_pred for i in (100, 101, 102)} == {"und"} and by[None].lang_pred == "en" and by[103].lang_pred == "de"
    assert not by[None].held_out
    import zlib

    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got if r.doc_id is not None)
    assert langid.predict_documents(df.limit(0)).count() == 0
    assert {r.lang_pred for r in langid.predict_documents(df.withColumn("lang", df.lang.substr(9, 0))).collect()} <= {"", "und"}
