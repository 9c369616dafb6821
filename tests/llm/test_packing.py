import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from panelwise.llm import packing, tokens
from panelwise.llm.tokens import Encoder, encoder, public_file

PATH = public_file("byte_bpe_50k.json")


def whole(lengths, p, capacity):
    """Every id in one piece, sequences gapless and full or a power of two long."""
    pieces, used = defaultdict(list), defaultdict(list)
    for d, s, n, q, o in zip(*(p[k].tolist() for k in ("document", "start", "length", "sequence", "offset")), strict=True):
        pieces[d].append((s, n))
        used[q].append((o, n))
    for d, n in enumerate(lengths):
        at = 0
        for s, k in sorted(pieces[d]):
            assert s == at and k > 0
            at += k
        assert at == n
    for parts in used.values():
        at = 0
        for o, k in sorted(parts):
            assert o == at
            at += k
        assert at == capacity or (at < capacity and at & (at - 1) == 0)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 200), max_size=60), st.sampled_from([16, 32, 50]), st.integers(1, 6))
def test_pack_lengths(lengths, capacity, classes):
    whole(lengths, packing.pack_lengths(np.array(lengths, dtype=np.int64), capacity, classes), capacity)


def test_bins_hold_the_class_count():
    p = packing.pack_lengths(np.array([700] * 6 + [4096]), 2048)
    whole([700] * 6 + [4096], p, 2048)
    for d in range(6):  # class 2: whole, two to a bin
        assert (p["document"] == d).sum() == 1
    first = p["sequence"][p["document"] == 0][0]
    assert ((p["sequence"] == first) & (p["document"] < 6)).sum() == 2


def test_pack_table(spark):
    rows = [(1, "hello world"), (2, None), (3, ""), (3, ""), (None, "a\n\nb  c"), (4, "word " * 9000), (5, "<|endoftext|> x"), (6, "don't  stop\n")]
    df = spark.createDataFrame([(a, b, 0, "z") for a, b in rows], "doc_id long, text string, length int, sequence_id string")
    got = packing.pack(df, PATH, with_ids=True, block_ids=5000).collect()
    tokens, texts = encoder(PATH).tokenizer, dict((k, t or "") for k, t in rows)
    assert len({(r.sequence_id, r.offset) for r in got}) == len(got)
    for key, text in texts.items():
        ids = tokens.encode(text, add_special_tokens=False).ids + [1]
        pieces = sorted((r for r in got if r.doc_id == key), key=lambda r: r.start)
        if key != 3:
            assert [i for r in pieces for i in r.ids] == ids
        for r in pieces:
            part = np.array(ids[r.start:r.start + r.length], dtype="<u4").tobytes()
            assert r.ids_crc32 == zlib.crc32(part) and r.doc_tokens == len(ids)
    assert packing.pack(df.limit(0), PATH).count() == 0


@pytest.mark.parametrize("text", ["", " a", "a\nb", "it's  x", "\x1c a", "\nfoo", "x  y", "a\x00b c", "　 q", "a \t b", "é̈ Áb"])
@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_remembered_pieces_give_the_library_ids(name, text):
    e = encoder(public_file(name))
    want = np.array(e.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
    assert e.encode([text, text]) == [want, want]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab'sé \n\t.,1 ́²\x1f", max_size=12))
def test_any_text(text):
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        e = encoder(public_file(name))
        assert e.encode([text]) == [e.whole(text)]


def test_blocks_of_many_pieces(spark):
    """Pieces are handed on a bounded number at a time, and all of them arrive."""
    assert packing.PIECES_AT_ONCE * packing.CAPACITY * 4 <= 1 << 24
    n = 2 * packing.PIECES_AT_ONCE + 500
    df = spark.createDataFrame([(i, f"piece {i}") for i in range(n)], "doc_id long, text string").coalesce(1)
    ids, want = defaultdict(bytes), encoder(PATH).encode([f"piece {i}" for i in range(n)])
    for r in sorted(packing.pack(df, PATH, with_ids=True).collect(), key=lambda r: (r.doc_id, r.start)):
        part = np.array(r.ids, dtype="<u4").tobytes()
        assert zlib.crc32(part) == r.ids_crc32 and r.length == len(r.ids)
        ids[r.doc_id] += part
    assert [ids[i] for i in range(n)] == [w + np.array([packing.END_ID], dtype="<u4").tobytes() for w in want]


def learning(name):
    """A new encoder, and the list of all pieces that it asks the library for."""
    e, learnt = Encoder(public_file(name)), []
    ids_of = e.ids_of
    e.ids_of = lambda pieces: learnt.extend(pieces) or ids_of(pieces)
    return e, learnt


def words(first, n):
    return ["".join(chr(97 + i // 26**k % 26) for k in range(5)) for i in range(first, first + n)]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_a_word_is_learnt_once_whatever_mark_follows(name):
    e, learnt = learning(name)
    plain = words(7, 1000)
    for mark in ("", ".", ",", "!?", "'s", "..."):
        text = " ".join(["to", *(w + mark for w in plain)])
        assert e.encode([text]) == [e.whole(text)]
    assert len(learnt) < 1100


def test_more_words_than_before_are_remembered():
    e, learnt = learning("byte_bpe_50k.json")
    for at in range(0, 320_000, 20_000):
        e.encode([" ".join(["to", *words(at, 20_000)])])
    assert len(learnt) > 310_000
    learnt.clear()
    text = " ".join(["to", *words(0, 20_000)])
    assert e.encode([text]) == [e.whole(text)] and len(learnt) < 1000


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_lost_and_forgotten_pieces_are_learnt_again(monkeypatch, name):
    """With a table much too small, two words to a place, and ids forgotten often, the ids stay right."""
    monkeypatch.setattr(tokens, "SLOTS", 4)
    monkeypatch.setattr(tokens, "IDS_REMEMBERED", 500)
    e = Encoder(public_file(name))
    for at in [*range(0, 900, 30), *range(0, 900, 60)]:
        some = words(at, 60)
        texts = [" ".join(some), " ".join(w * 5 + "." for w in some), ", ".join([*some, *some[::-1]])]
        assert e.encode(texts) == [e.whole(t) for t in texts]


@settings(max_examples=500, deadline=None)
@given(st.lists(st.text(alphabet="aZéÀ×÷İşɏʔ–ºΣ\u0301.'-s1 \n", max_size=10), min_size=1, max_size=4))
def test_cuts_before_marks(texts):
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        e = encoder(public_file(name))
        assert e.encode(texts) == [e.whole(t) for t in texts]
