import collections
import re

import numpy as np
import pytest

import corpus_pipeline
from panelwise.llm.pii_rules import base_spans
from panelwise.llm.tokens import encoder, public_file

FOLDER = "/root/testdata/sf0.001"


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Every stage's result on the smallest tables with some planted rows."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    bench = spark.read.parquet(f"{FOLDER}/benchmark.parquet").orderBy("item_id").collect()
    long = max((r.text for r in docs.collect()), key=lambda t: len(t) if len(t) < 4000 else 0)
    near = long.split(" ")
    near[len(near) // 2] = "othere"
    rows = [
        (9001, None, "en", "p", 0), (9002, "", None, "p", 0), (9003, "12 34 !!", "de", "p", 8), (9004, long, "en", None, 1), (9005, " ".join(near), "en", "p", 1),
        (9006, "Then ther of the erthe thing. " + bench[0].text + " And the ing of thate.", "en", "p", 1),
        (9007, "The thing of erth and there write to a.b@mail.example.com or call +1 (310) 555-4510 for the thing.", "en", "p", 5), (None, "The erthing of ander thate wither thand ing the thon therea.", None, None, None),
    ]
    docs = docs.unionByName(spark.createDataFrame(rows, docs.schema))
    out = [docs]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stages") / str(i))
        stage(spark, out[-1], FOLDER).write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


def test_columns_and_order(stages):
    assert all(s.columns == stages[0].columns for s in stages[:-1])
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language identification", "near-duplicate removal", "benchmark decontamination", "personal data", "packing"]


def test_language(stages):
    before, after = stages[0].collect(), stages[1].collect()
    gone = {r.doc_id for r in before} - {r.doc_id for r in after}
    assert gone == {r.doc_id for r in before if not re.search(r"[^\W\d_]", r.text or "")} and set(map(tuple, after)) <= set(map(tuple, before))


def test_near_duplicates_against_brute_force(stages):
    before, after = stages[1].collect(), stages[2].collect()
    sets = [{tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} for w in (words(r.text) for r in before)]
    group = list(range(len(before)))
    for i in range(len(before)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = sorted((group[i], group[j]))
                group = [a if g == b else g for g in group]
    members = collections.defaultdict(list)
    for i, g in enumerate(group):
        members[g].append(i)
    left = collections.Counter(r.doc_id for r in after)
    assert len(after) == len(members) and set(map(tuple, after)) <= set(map(tuple, before))
    for m in members.values():
        assert sum(left[before[i].doc_id] for i in m) == 1
    assert len(members) < len(before)


def test_decontamination_against_brute_force(spark, stages):
    before, after = stages[2].collect(), stages[3].collect()
    items = [" " + " ".join(words(r.text)) + " " for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    held = {r.doc_id for r in before if any(i in " " + " ".join(words(r.text)) + " " for i in items)}
    assert 9006 in held and {r.doc_id for r in before} - {r.doc_id for r in after} == held


def test_personal_data_against_the_rules(stages):
    before, after = {r.doc_id: r for r in stages[3].collect()}, {r.doc_id: r for r in stages[4].collect()}
    assert before.keys() == after.keys()
    for k, old in before.items():
        new, spans = after[k], base_spans(old.text)
        assert (new.lang, new.source) == (old.lang, old.source)
        if not spans and not re.search("[0-9@]", old.text):
            assert new == old
        for a, b, _ in spans:
            assert old.text[a:b] not in new.text
        if new.text != old.text:
            assert new.n_chars == len(new.text) and re.search(r"\[(EMAIL|IP|CARD|PHONE)\]", new.text)
    assert after[9007].text.count("[") == 2


def test_packing_holds_every_id(stages):
    tokens, pieces = encoder(public_file("byte_bpe_50k.json")).tokenizer, collections.defaultdict(list)
    used = collections.Counter()
    for r in stages[5].collect():
        pieces[r.doc_id].append((r.start, r.ids))
        used[r.sequence_id] += r.length
    for r in stages[4].collect():
        assert [i for _, ids in sorted(pieces[r.doc_id]) for i in ids] == tokens.encode(r.text, add_special_tokens=False).ids + [1]
    assert all(n == 2048 or n & (n - 1) == 0 for n in used.values()) and np.mean([n == 2048 for n in used.values()]) > 0.5


def test_empty_table(spark, stages):
    docs = stages[0].limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, FOLDER)
    assert docs.count() == 0
