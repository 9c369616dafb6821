import hashlib
import re

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from panelwise.llm import pii
from panelwise.llm.char_tagger import TAGS, Tagger, allowed, char_ids, spans_of, tags_of
from panelwise.llm.pii_rules import KINDS, base_spans, joined, luhn, plausible


def brute_base(text):
    """The rules as they are written down, one after the other."""
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((m.start(), 0, m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c in "0123456789"]
        if 12 <= len(d) <= 19 and (sum(d[-1::-2]) + sum(sum(divmod(2 * x, 10)) for x in d[-2::-2])) % 10 == 0:
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= sum(c in "0123456789" for c in m[0]) <= 15:
            out.append((m.start(), 3, m.end()))
    return [(a, b, KINDS[k]) for a, k, b in sorted(out)]


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="ab@.+-() 0145é\n", max_size=60))
def test_rules(text):
    assert base_spans(text) == brute_base(text)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["4111 1111 1111 1111", "4111111111111111", "1.2.3.255", "a.b@c-d.org", "+1 (555) 123-4567", " ", "x", ",", "0", "."]), max_size=8))
def test_rules_on_made_up_rows(parts):
    assert base_spans("".join(parts)) == brute_base("".join(parts))


def test_gradient():
    """The gradient of the CRF's loss against differences."""
    rng = np.random.default_rng(0)
    model, ids, tags = Tagger.new(3), rng.integers(0, 131, (3, 7)), tags_of([(1, 4, "ip"), (5, 6, "card")], 7)[None, :].repeat(3, 0)
    value, grad = model.loss(ids, tags)
    assert value > 0
    for name, p in model.p.items():
        for _ in range(4):
            at = tuple(int(rng.integers(0, n)) for n in p.shape) if name != "emb" else (int(ids[0, 2]), int(rng.integers(0, p.shape[1])))
            old, step = p[at], 1e-5
            p[at] = old + step
            up, _ = model.loss(ids, tags)
            p[at] = old - step
            down, _ = model.loss(ids, tags)
            p[at] = old
            assert grad[name][at] == pytest.approx((up - down) / (2 * step), rel=1e-3, abs=1e-6), name


def test_decoding_against_all_paths():
    import itertools

    rng = np.random.default_rng(1)
    model = Tagger.new(2)
    model.p["trans"] = rng.standard_normal((TAGS, TAGS))
    e, trans = rng.standard_normal((2, 4, TAGS)) * 2, model.p["trans"] + allowed()
    for row, got in zip(e, model.decode(e), strict=True):
        best = max(itertools.product(range(TAGS), repeat=4), key=lambda p: allowed()[0, p[0]] + sum(row[i, t] for i, t in enumerate(p)) + sum(trans[a, b] for a, b in zip(p, p[1:], strict=False)))
        assert tuple(got) == best


def test_tags_and_spans():
    spans = [(0, 2, "email"), (2, 3, "ip"), (5, 9, "phone")]
    assert spans_of(tags_of(spans, 10)) == spans
    assert luhn("4111111111111111") and not luhn("4111111111111112")
    assert plausible("call 555-123-4567 now", (5, 17, "phone")) and not plausible("1555-123-4567", (1, 13, "phone"))


@pytest.fixture(scope="module")
def docs(spark):
    rng = np.random.default_rng(11)
    words = "the order letter office year nothing else known meeting paper signed again under house".split()
    rows = []
    for i in range(160):
        text = " ".join(rng.choice(words, 40))
        if i % 2:
            at = int(rng.integers(0, 100))
            text = text[:at] + " " + pii.made_up(rng, KINDS[i // 2 % 4]) + " " + text[at:]
        elif i % 4 == 0:
            text += f" version {rng.integers(1, 9)}.{rng.integers(0, 9)} of {rng.integers(1990, 2030)}, page {rng.integers(1, 400)}"
        rows.append((i, text))
    rows += [(900, None), (901, ""), (902, "4465 7583 1111 9999 4111111111111111 4111111111111111"), (902, "x"), (None, "mail é+x@y.org, ok"), (903, "7 " * 40_000 + "+1 (743) 555-3824")]
    return spark.createDataFrame([(a, b, 1, "q") for a, b in rows], "doc_id long, text string, n_email int, spans string").repartition(3), rows


@pytest.fixture(scope="module")
def model(docs):
    return pii.fit(docs[0])


def test_held_out_accuracy(docs, model):
    """Invented values in new windows: most characters of the spans get their tag, and few others one."""
    ids, tags = pii.training_set([t for _, t in docs[1] if t and len(t) < 5000], seed=77)
    got = model.decode(model.emissions(ids))
    assert (got == tags)[tags > 0].mean() > 0.9 and (got == tags)[got > 0].mean() > 0.9


def test_table(spark, docs, model):
    df, rows = docs
    got = pii.find(df, model).collect()
    assert len(got) == len(rows)
    want = sorted((str(k), joined(brute_base(t or ""))) for k, t in rows)
    assert sorted((str(r.doc_id), r.base_sha256) for r in got) == sorted((k, hashlib.sha256(b.encode()).hexdigest()) for k, b in want)
    by = {str(r.doc_id): r for r in got if r.doc_id != 902}
    for k, base in want:
        if k != "902":
            assert set(filter(None, base.split(","))) <= set(by[k].spans.split(","))
            assert (by[k].n_email, by[k].n_ip, by[k].n_card, by[k].n_phone) == tuple(base.count(f"{x}:") for x in KINDS)
    clean = [r for r in got if r.doc_id is not None and r.doc_id < 160 and r.doc_id % 2 == 0]
    assert not any(r.spans for r in clean)
    assert pii.find(df.limit(0), model).count() == 0 and pii.find(df.limit(0), pii.fit(df.limit(0))).count() == 0


def test_windows_are_reconciled(model):
    """A value is found wherever it stands in a long stretch of digits that needs several windows."""
    for at in range(40, 100, 7):
        text = "1 2 " * (at // 4) + "write to jane.doe@mail.example.com or call " + "3 4 " * 30
        raw = pii.tag_texts(model, [text])[0]
        assert any(k == "email" and text[a:b] == "jane.doe@mail.example.com" for a, b, k in raw), (at, raw)


def test_mask(spark, model):
    df = spark.createDataFrame([(1, "mail a.b@c.org now", 18, "u"), (2, None, None, "v"), (3, "clean text", 10, "w")], "doc_id long, text string, n_chars long, _k0 string")
    got = {r.doc_id: r for r in pii.mask(df, model, n_chars="n_chars").collect()}
    assert got[1].text == "mail [EMAIL] now" and got[1].n_chars == 16
    assert got[2].text is None and (got[3].text, got[3].n_chars, got[3]._k0) == ("clean text", 10, "w")
