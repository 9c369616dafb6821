import zlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from panelwise.llm import elias_fano as ef
from panelwise.llm.tokens import encoder, public_file

PATH = public_file("word_bpe_49k.json")


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 1 << 34), max_size=700), st.integers(0, 20))
def test_lists(values, shift):
    values = sorted(v >> shift for v in values)
    if values and values[-1] > 1 << 31 and len(values) < 3:
        values = [v >> 20 for v in values]
    e = ef.EliasFano.from_bytes(memoryview(ef.EliasFano.of(np.array(values, dtype=np.uint64)).to_bytes()))
    assert e.all().tolist() == values
    assert [e.select(i) for i in range(len(values))] == values


def test_space():
    ends = np.cumsum(np.random.default_rng(1).integers(1, 2000, 10_000))
    assert len(ef.EliasFano.of(ends).to_bytes()) * 8 < 10_000 * (2 + np.log2(1000) + 1)


def test_damage_is_seen():
    data = bytearray(ef.shard_bytes([np.array([5, 70000, 1], "<u4")], [3]))
    assert ef.Shard(bytes(data)).document(0).tolist() == [5, 70000, 1]
    data[ef.HEAD.size] ^= 1
    with pytest.raises(ValueError):
        ef.Shard(bytes(data))


def test_round_trip(spark):
    rows = [(5, "Hello, World's end"), (-3, None), (None, "no id"), (7, ""), (7, ""), (2, "é" * 3000), (9, "a <|endoftext|> b"), (1 << 40, "far")]
    df = spark.createDataFrame([(a, b, 1, "p") for a, b in rows], "doc_id long, text string, start int, path string")
    shards = ef.write_tokens(df, ef.shared_path(spark, "t"), PATH, shard_ids=500)
    assert shards.count() > 1
    got = sorted(ef.read_tokens(shards, with_ids=True).collect(), key=lambda r: (r.shard, r.place))
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    assert [r.doc_id for r in got] == [k for k, _ in ordered]
    at = 0
    for r, (_, text) in zip(got, ordered, strict=True):
        ids = encoder(PATH).tokenizer.encode(text or "", add_special_tokens=False).ids + [1]
        assert r.ids == ids and r.start == at and r.n_tokens == len(ids)
        assert r.ids_crc32 == zlib.crc32(np.array(ids, dtype="<u4").tobytes())
        at += len(ids)
    assert ef.round_trip(spark, df.limit(0), PATH).count() == 0
