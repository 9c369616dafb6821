"""The registered queries run on the smallest tables, and agree with their SQL where they have one."""

import re

import pytest

import __spark_entry__ as entry
import compare

FOLDER = "/root/testdata/sf0.001"
COLUMNS = {
    1: ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
    2: ["doc_id", "start", "n_tokens", "ids_crc32"],
    3: ["doc_id", "held_out", "lang_pred", "score"],
    4: ["doc_id", "item_id"],
    5: ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
    6: ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"],
    7: ["vec_id", "n_links", "component_id", "kept"],
    8: ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"],
    9: ["page_id", "url", "text", "n_chars"],
    10: ["doc_id", "class_id", "n_members", "kept"],
    11: ["doc_id", "n_lines", "n_dropped", "kept_sha256"],
    12: ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"],
    13: ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"],
}
NAMES = sorted(n for n in entry.queries() if re.match(r"op\d+_", n))


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in NAMES) == list(range(1, len(COLUMNS) + 1)) and "pipeline" in entry.queries()


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, name):
    difference, _, rows = compare.compare(spark, compare.connect(FOLDER), entry.queries()[name], entry.oracle_sql().get(name), FOLDER)
    assert not difference and rows
    wanted = COLUMNS[int(name[2:].split("_")[0])]
    assert entry.queries()[name](spark, FOLDER).columns[:len(wanted)] == wanted
