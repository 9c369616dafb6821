import random
import zlib
from hashlib import sha256

import pytest
import xxhash

from panelwise.llm import prefix_trie
from panelwise.llm.prefix_trie import SpillingQueue

DDL = "conv_id long, turn long, role string, text string"


def turn_hash(i, role, text):
    """The order of turns with one number: Spark's xxhash64 over an integer and two texts."""
    seed = xxhash.xxh64_intdigest(i.to_bytes(4, "little"), 42)
    for part in (role, text):
        seed = xxhash.xxh64_intdigest(part.encode(), seed)
    return seed - (1 << 64 if seed >> 63 else 0)


def rebuild(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn, role or "", text or ""))
    for c, turns in own.items():
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, turn_hash(1, *t[1:]), turn_hash(2, *t[1:])))
        own[c] = [t[1:] for t in turns]
    out = {}
    for c, turns in own.items():
        lead = zlib.crc32(str(c).encode()) % 6
        base = c - (c % 100 if c >= 0 else -(-c % 100))
        out[c] = [*own.get(base, [])[:lead], *turns[lead:]]
    return out


def expected(rows):
    convs = rebuild(rows)
    nodes = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    out = []
    children, leaves, saved = dict.fromkeys(nodes, 0), dict.fromkeys(nodes, 0), dict.fromkeys(nodes, 0)
    for path in nodes:
        if path:
            children[path[:-1]] += 1
    for path, mine in nodes.items():
        for d in range(len(path) + 1):
            leaves[path[:d]] += children[path] == 0
            saved[path[:d]] += (len(mine) - 1) * len(path[-1][1]) if path else 0
    for path, mine in nodes.items():
        ends = sorted(c for c in mine if len(convs[c]) == len(path))
        out.append((min(mine), len(path), min(nodes[path[:-1]]) if path else None, len(mine), children[path], leaves[path], saved[path],
                    sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return sorted(out, key=repr)


def got(spark, rows, **options):
    return sorted(map(tuple, prefix_trie.trie(spark.createDataFrame(rows, DDL), **options).collect()), key=repr)


def conversations(seed, n, words=("hi", "HI", "é😀", "", None)):
    chance = random.Random(seed)
    rows = []
    for c in chance.sample(range(-250, 600), n):
        for turn in range(chance.choice([1, 2, 3, 7, 9])):
            rows.append((c, turn, chance.choice(["user", "user", "bot", None]), chance.choice(words)))
    chance.shuffle(rows)
    return rows


@pytest.mark.parametrize("shard", [2, 5, 20_000])
def test_against_brute_force(spark, shard):
    """Shards of few members make many levels, a small queue spills."""
    rows = conversations(shard, 120)
    assert got(spark, rows, shard=shard, room=2) == expected(rows)


def test_ties_nulls_and_repeated_rows(spark):
    rows = [(1, None, "a", "x"), (1, None, "a", "y"), (1, 0, "a", "y"), (1, 0, "a", "y"), (1, 0, None, None), (1, 0, "", ""), (None, 1, "a", "x")]
    rows += [(2, t, r, x) for _, t, r, x in rows[:6]] + [(300, 0, "a", "x")] * 9 + [(301, 5, "q", "z" * 5000)]
    assert got(spark, rows) == expected(rows)


def test_turnless_conversation(spark):
    """A conversation that has only turns within its lead, and whose first of the hundred is absent, has none."""
    lone = next(c for c in range(101, 200) if zlib.crc32(str(c).encode()) % 6 >= 2)
    rows = [(lone, 0, "u", "a"), (lone, 1, "u", "b"), (5, 0, "u", "a")]
    want = expected(rows)
    assert got(spark, rows) == want and any(r[1] == 0 and r[7] != sha256(b"").hexdigest() for r in want)


def test_long_conversations_of_equal_turns(spark, monkeypatch):
    """Running totals over many slices; a chain of thousands of nodes shared by three conversations."""
    monkeypatch.setattr(prefix_trie, "SLICE", 64)
    rows = [(c, t, "u", "same" if t < 900 else f"{c} {t % 3}") for c in (600, 700, 800) for t in range(1000 + c % 7)]
    rows += [(600 + i, t, "u", "same") for i in range(1, 4) for t in range(5)]
    assert got(spark, rows) == expected(rows)


def test_group_of_copies_and_common_first_turn(spark, monkeypatch):
    """Many ids end at one node, in several pieces; a first turn that nearly all share."""
    monkeypatch.setattr(prefix_trie, "PIECE", 16)
    rows = [(c * 100, t, "u", f"t{t}") for c in range(150) for t in range(3)]
    rows += [(c * 100, t, "u", "t0" if t == 0 else f"{c}") for c in range(150, 250) for t in range(3)]
    assert got(spark, rows, shard=20) == expected(rows)


def test_other_columns_and_empty_table(spark):
    rows = conversations(9, 30)
    names = DDL + ", depth long, position long, n_convs string, h1 string, level int"
    df = spark.createDataFrame([(*r, 1, 2, "x", "y", 3) for r in rows], names)
    assert sorted(map(tuple, prefix_trie.trie(df).collect()), key=repr) == expected(rows)
    assert prefix_trie.trie(spark.createDataFrame([], DDL)).count() == 0


def test_spilling_queue():
    chance = random.Random(3)
    queue, held = SpillingQueue(8), []
    for step in range(3000):
        if held and chance.random() < 0.45:
            held.sort()
            assert queue.first() == held[0] and queue.pop() == held.pop(0)
        else:
            message = (chance.randint(-50, 50), chance.randint(0, 9), step, -step)
            queue.push(message)
            held.append(message)
    held.sort()
    assert [queue.pop() for _ in held] == held and queue.first() is None
