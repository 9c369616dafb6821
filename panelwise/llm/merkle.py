"""A manifest of a dataset as hash trees with sixteen children a node, kept in van Emde Boas layout.

Every row is a leaf. The leaves of a group (a source) stand in the order of their ids; up to 16
neighbours are put together under one node until one is left, the group's root, and the groups' roots
are put together likewise. A tree is cut into aligned blocks of 16**4 leaves. A block is a subtree that
is stored as one array: the upper half of its levels first, then the subtrees below it one after the
other, each laid out in the same manner (``layout``). So a node's place follows from its level and index
by arithmetic alone, both when a block is built and when the siblings on a leaf's way up are fetched, and
neighbours on that way lie close together whatever the size of a cache line. The roots of a tree's
blocks are the leaves of the next tier, cut into blocks again, until a tier has one block a tree.

Spark numbers the leaves of a group in slices, sends each block's leaves to one task and builds it there;
a group with a third of all rows is many blocks. For proofs, the ways above the block roots go from the
highest tier down, one row for a block, and each block then answers for all its leaves.

Odd input: null fields are hashed as ``-``, a null group comes first. Rows with equal ids are ordered by
their leaf, null ids first; repeated rows are leaves of their own. A text of any length is hashed by Spark
and not shuffled. An empty table has no leaves and no root. Columns other than the fields are not read,
whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from panelwise.llm.base import arrow_schema, materialize, rows_of
from panelwise.llm.line_dedup import LOWER, UPPER
from panelwise.operators.running import running_totals

FAN = 16  # children of a node
HEIGHT = 4  # levels above the leaves in a block
DIGEST, HEX = 32, 64
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
ROWS_OUT = 4_096  # rows given back together


# --- the layout ----------------------------------------------------------------
def size_of(levels: int) -> int:
    """Nodes of a full tree."""
    return (FAN ** levels - 1) // (FAN - 1)


@lru_cache(maxsize=16)
def layout(levels: int) -> tuple[np.ndarray, ...]:
    """For each level from the root down, the addresses of its nodes from left to right.

    The tree is cut at half its height: the top tree comes first, then the bottom trees, all laid
    out by the same rule.
    """
    if levels == 1:
        return (np.zeros(1, dtype=np.int64),)
    upper = levels // 2
    lower = levels - upper
    begin = size_of(upper) + np.arange(FAN ** upper, dtype=np.int64) * size_of(lower)
    return *layout(upper), *((begin[:, None] + at[None, :]).ravel() for at in layout(lower))


def rounds(n: int) -> int:
    """How often n nodes are put together until one is left."""
    times = 0
    while n > 1:
        n, times = -(-n // FAN), times + 1
    return times


def build(leaves: bytes, height: int) -> bytes:
    """The array of a block over its leaves, which may be fewer than the block holds."""
    places = layout(height + 1)
    nodes = np.zeros((size_of(height + 1), DIGEST), dtype=np.uint8)
    level = leaves
    for depth in range(height, -1, -1):
        nodes[places[depth][:len(level) // DIGEST]] = np.frombuffer(level, dtype=np.uint8).reshape(-1, DIGEST)
        if depth:
            text, run = level.hex().encode(), FAN * HEX
            level = b"".join(sha256(text[i:i + run]).digest() for i in range(0, len(text), run))
    return nodes.tobytes()


class Block:
    """A stored block: its nodes by level, fetched by address."""

    def __init__(self, nodes: bytes, height: int, leaves: int):
        data = np.frombuffer(nodes, dtype=np.uint8).reshape(-1, DIGEST)
        self.height, self.leaves = height, leaves
        self.level = []  # hex text of each level's nodes, the root's first
        for depth, places in enumerate(layout(height + 1)):
            n = -(-leaves // FAN ** (height - depth))
            self.level.append(data[places[:n]].tobytes().hex().encode())

    def run(self, depth: int, i: int) -> tuple[int, bytes]:
        """The place of a node in its run, and the run."""
        j, at = divmod(i, FAN)
        return at, self.level[depth][j * FAN * HEX:(j + 1) * FAN * HEX]

    def siblings(self, depth: int, i: int) -> bytes:
        return others(*self.run(depth, i))

    def way(self, i: int, depth: int | None = None) -> list[tuple[int, bytes]]:
        """The runs on the way of node i of a level, the leaves' unless another is named, to the block's root."""
        found = []
        for depth in range(self.height if depth is None else depth, 0, -1):
            found.append(self.run(depth, i))
            i //= FAN
        return found


def others(at: int, run: bytes) -> bytes:
    return run[:at * HEX] + run[(at + 1) * HEX:]


def fold(node: bytes, way: Iterable[tuple[int, bytes]]) -> bytes:
    """The root that follows from a node and the runs on its way up."""
    for at, run in way:
        node = sha256(run[:at * HEX] + node + run[(at + 1) * HEX:]).hexdigest().encode()
    return node


def proofs(block: Block, above: list[tuple[int, bytes]]) -> Iterator[tuple[str, str, str]]:
    """Of each leaf in order: its text, the hash of all siblings up to the root, and the root folded from it."""
    rest = [b"".join(others(*step) for step in above)]  # siblings from a node's own level on, per node
    for depth in range(1, block.height):
        rest = [block.siblings(depth, i) + rest[i // FAN] for i in range(len(block.level[depth]) // HEX)]
    h = block.height
    folded = ""
    for i in range(block.leaves):
        leaf = block.level[h][i * HEX:(i + 1) * HEX]
        if not h:
            yield leaf.decode(), sha256(rest[0]).hexdigest(), fold(leaf, above).decode()
            continue
        if i % FAN == 0:  # the run's leaves have the same parent and the same way from there
            parent = sha256(block.run(h, i)[1]).hexdigest().encode()
            folded = fold(parent, [*block.way(i // FAN, h - 1), *above]).decode()
        yield leaf.decode(), sha256(block.siblings(h, i) + rest[i // FAN]).hexdigest(), folded


# --- the leaves ----------------------------------------------------------------
def field(value: Column) -> Column:
    """Byte count, colon and value; ``-`` for null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(*values: Column) -> Column:
    return F.unhex(F.sha2(F.concat(*[field(v) for v in values]), 256))


def lower_ascii(text: Column) -> Column:
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def leaves_of(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """tree, key, digest, and the digest after the text's A-Z are lower-cased where ``tampered`` holds."""
    values = [F.col(f"`{c}`") for c in FIELDS]
    other = F.lit(None).cast("binary")
    if tampered is not None:
        other = F.when(tampered, leaf_of(*values[:-1], lower_ascii(values[-1])))
    return docs.select(
        F.col("`source`").alias("tree"), F.col("`doc_id`").cast("long").alias("key"), leaf_of(*values).alias("digest"), other.alias("changed"),
    )


def numbered(nodes: DataFrame, by: list[str], *order: str) -> DataFrame:
    """position from 0 in each tree, and total, the tree's number of nodes."""
    ranked = running_totals(
        nodes.withColumns({"_one": F.lit(1).cast("long"), "_order": F.struct(*order)}), by, "_order", ["_one"]
    )
    return ranked.withColumnsRenamed({"_one_before": "position", "_one_all": "total"}).drop("_one", "_order", "_all")


# --- blocks and tiers ----------------------------------------------------------
BLOCKS = "tree string, block long, total long, height int, leaves int, root binary, nodes binary, keys array<bigint>, changed array<binary>"


def blocks_of(nodes: DataFrame, height: int) -> DataFrame:
    """One row per block; ``nodes`` has tree, position, total, key, digest and changed."""
    spec, schema = arrow_schema(nodes, BLOCKS)
    size = FAN ** height

    def block(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(rows)
        total = table.column("total")[0].as_py()
        levels = height if total > size else rounds(total)
        nodes = build(b"".join(table.column("digest").to_pylist()), levels)
        return rows_of(
            schema, tree=[table.column("tree")[0].as_py()], block=[table.column("block")[0].as_py()], total=[total], height=[levels],
            leaves=[table.num_rows], root=[nodes[:DIGEST]], nodes=[nodes],
            keys=[table.column("key").to_pylist()], changed=[table.column("changed").to_pylist()],
        )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        mine = None
        for batch in batches:
            if not batch.num_rows:
                continue
            names, numbers = batch.column("tree").to_pylist(), batch.column("block").to_pylist()
            begin = 0
            for i, this in enumerate(zip(names, numbers, strict=True)):
                if this != mine:
                    if i > begin:
                        waiting.append(batch.slice(begin, i - begin))
                    if waiting:
                        yield block(waiting)
                    waiting, begin, mine = [], i, this
            waiting.append(batch.slice(begin))
        if waiting:
            yield block(waiting)

    placed = nodes.select("tree", F.expr(f"position div {size}").alias("block"), "position", "total", "key", "digest", "changed")
    return placed.repartition("tree", "block").sortWithinPartitions("tree", "block", "position").mapInArrow(run, spec)


def tiers_of(nodes: DataFrame, height: int = HEIGHT) -> list[DataFrame]:
    """The written blocks of the trees over numbered nodes, tier by tier; each tier's block roots are the next one's leaves."""
    tiers = []
    while True:
        tiers.append(materialize(blocks_of(nodes, height)))
        wide = tiers[-1].where(F.col("total") > FAN ** height)
        if not wide.limit(1).count():
            return tiers
        nodes = wide.select(
            "tree", F.col("block").alias("position"), F.ceil(F.col("total") / FAN ** height).alias("total"),
            F.lit(None).cast("long").alias("key"), F.col("root").alias("digest"), F.lit(None).cast("binary").alias("changed"),
        )


def roots_of(tiers: list[DataFrame], height: int = HEIGHT) -> DataFrame:
    """tree, root: of each tree the one block of its last tier."""
    parts = [t.where(F.col("total") <= FAN ** height).select("tree", "root") for t in tiers]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


WAY = "array<struct<at: int, run: binary>>"


def with_way_above(tiers: list[DataFrame], over: DataFrame, i: int, height: int) -> DataFrame:
    """The blocks of tier i with the runs above their roots; ``over`` has tree, above and what else goes with a tree."""
    extra = [c for c in over.columns if c not in ("tree", "above")]
    blocks = tiers[i]
    last = blocks.where(F.col("total") <= FAN ** height).join(
        over.withColumnRenamed("tree", "_tree"), F.col("tree").eqNullSafe(F.col("_tree"))).drop("_tree")
    if i == len(tiers) - 1:
        return last
    higher = ways_of(with_way_above(tiers, over, i + 1, height), extra, height).withColumnsRenamed({"tree": "_tree", "position": "_block"})
    wide = blocks.where(F.col("total") > FAN ** height).join(
        higher, F.col("tree").eqNullSafe(F.col("_tree")) & (F.col("block") == F.col("_block"))).drop("_tree", "_block")
    return last.unionByName(wide)


def steps(way: list[dict]) -> list[tuple[int, bytes]]:
    return [(s["at"], s["run"]) for s in way]


def ways_of(blocks: DataFrame, extra: list[str], height: int) -> DataFrame:
    """tree, position, above: for each leaf of the blocks the runs from its own on."""
    kinds = dict(blocks.dtypes)
    spec, schema = arrow_schema(blocks, ", ".join([f"tree string, position long, above {WAY}", *[f"{c} {kinds[c]}" for c in extra]]))
    size = FAN ** height

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                row = batch.slice(r, 1).to_pylist()[0]
                block, above = Block(row["nodes"], row["height"], row["leaves"]), steps(row["above"])
                for at in range(0, block.leaves, ROWS_OUT):
                    mine = range(at, min(block.leaves, at + ROWS_OUT))
                    yield rows_of(
                        schema, tree=[row["tree"]] * len(mine), position=[row["block"] * size + i for i in mine],
                        above=[[{"at": a, "run": b} for a, b in [*block.way(i), *above]] for i in mine],
                        **{c: [row[c]] * len(mine) for c in extra},
                    )

    return blocks.mapInArrow(run, spec)


# --- the manifest and its proofs -----------------------------------------------
def manifest(docs: DataFrame, tampered: Column | None = None, height: int = HEIGHT) -> tuple[list[DataFrame], list[DataFrame], DataFrame]:
    """The blocks of the groups' trees, those of the tree over the groups, and the groups in order with their roots.

    All are written tables in the shared folder; the root is the group tree's. ``tampered`` adds the
    digests that changed rows would have, next to the stored ones.
    """
    leaves = materialize(leaves_of(docs, tampered))
    trees = tiers_of(numbered(leaves, ["tree"], "key", "digest"), height)
    groups = materialize(numbered(roots_of(trees, height), [], "tree"))
    nodes = groups.select(
        F.lit(None).cast("string").alias("tree"), "position", "total", F.lit(None).cast("long").alias("key"),
        F.col("root").alias("digest"), F.lit(None).cast("binary").alias("changed"),
    )
    return trees, tiers_of(nodes, height), groups


REPORT = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def verify(docs: DataFrame, tampered: Column | None = None, height: int = HEIGHT) -> DataFrame:
    """Per row its leaf, its group's root, the root, the hash of its proof, and the root that follows from the row
    as it is found, changed where ``tampered`` holds, and its proof."""
    trees, upper, groups = manifest(docs, tampered, height)
    top = roots_of(upper, height).select(F.col("root").alias("top"))
    start = top.select(F.lit(None).cast("string").alias("tree"), F.array().cast(WAY).alias("above"), "top")
    ways = ways_of(with_way_above(upper, start, 0, height), ["top"], height)
    over = groups.join(ways.drop("tree"), "position").select("tree", "above", F.col("root").alias("subroot"), "top")
    found = with_way_above(trees, materialize(over), 0, height)
    spec, schema = arrow_schema(docs, REPORT)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                row = batch.slice(r, 1).to_pylist()[0]
                block, above, top = Block(row["nodes"], row["height"], row["leaves"]), steps(row["above"]), row["top"].hex()
                out: dict[str, list] = {name: [] for name in schema.names}
                for i, (leaf, proof, folded) in enumerate(proofs(block, above)):
                    changed = row["changed"][i]
                    if changed is not None and changed.hex() != leaf:
                        folded = fold(changed.hex().encode(), [*block.way(i), *above]).decode()
                    values = (row["keys"][i], leaf, row["subroot"].hex(), top, proof, folded, folded == top)
                    for name, value in zip(schema.names, values, strict=True):
                        out[name].append(value)
                    if len(out["leaf"]) == ROWS_OUT:
                        yield rows_of(schema, **out)
                        out = {name: [] for name in schema.names}
                yield rows_of(schema, **out)

    return found.mapInArrow(run, spec)


def fifth(doc_id: str = "doc_id") -> Column:
    """The rows that are tampered with in the registered query: 5 divides the CRC-32 of the id as text."""
    return F.coalesce(F.crc32(F.col(f"`{doc_id}`").cast("string").cast("binary")) % 5 == 0, F.lit(False))


#: CRC-32 of a number's decimal digits, in SQL.
CRC32 = """
xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(CAST({0} AS VARCHAR), ''), lambda c: CAST(ascii(c) AS UBIGINT))),
  lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), [0, 1, 2, 3, 4, 5, 6, 7]::UBIGINT[]),
    lambda x, i: CASE WHEN x & 1::UBIGINT = 1 THEN xor(x >> 1::UBIGINT, 3988292384::UBIGINT) ELSE x >> 1::UBIGINT END)), 4294967295::UBIGINT)
"""


def _field_sql(value: str) -> str:
    return f"coalesce(strlen(CAST({value} AS VARCHAR)) || ':' || {value}, '-')"


def _leaf_sql(text: str) -> str:
    return "sha256(" + " || ".join(_field_sql(v) for v in (*FIELDS[:-1], text)) + ")"


_UP = "list_transform(range(0, (len(nodes) + 15) // 16), lambda i: sha256(array_to_string(nodes[i * 16 + 1:i * 16 + 16], '')))"

#: The same in SQL, for the registered query.
SQL = f"""
WITH RECURSIVE leaves AS MATERIALIZED (
  SELECT doc_id, source, {_leaf_sql('text')} AS leaf,
    CASE WHEN {CRC32.format('doc_id')} % 5 = 0 THEN {_leaf_sql(f"translate(text, '{UPPER}', '{LOWER}')")} END AS changed
  FROM documents),
placed AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS position FROM leaves),
up AS (
  SELECT source, 0 AS level, list(leaf ORDER BY position) AS nodes FROM placed GROUP BY source
  UNION ALL SELECT source, level + 1, {_UP} FROM up WHERE len(nodes) > 1),
subroots AS MATERIALIZED (SELECT source, nodes[1] AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS place FROM up WHERE len(nodes) = 1),
tops AS (
  SELECT 0 AS level, list(subroot ORDER BY place) AS nodes FROM subroots
  UNION ALL SELECT level + 1, {_UP} FROM tops WHERE len(nodes) > 1),
steps AS (
  SELECT doc_id, p.source, leaf, level, nodes, position // CAST(pow(16, level) AS BIGINT) AS i FROM placed p JOIN up u ON u.source IS NOT DISTINCT FROM p.source AND len(nodes) > 1
  UNION ALL
  SELECT doc_id, p.source, leaf, 1000 + level, nodes, place // CAST(pow(16, level) AS BIGINT) FROM placed p JOIN subroots s ON s.source IS NOT DISTINCT FROM p.source JOIN tops ON len(nodes) > 1),
ways AS MATERIALIZED (
  SELECT doc_id, source, leaf, list(left_part ORDER BY level) AS lefts, list(right_part ORDER BY level) AS rights FROM (
    SELECT *, array_to_string(nodes[(i // 16) * 16 + 1:i], '') AS left_part, array_to_string(nodes[i + 2:(i // 16) * 16 + 16], '') AS right_part FROM steps)
  GROUP BY doc_id, source, leaf),
every AS MATERIALIZED (SELECT p.doc_id, p.source, p.leaf, changed, coalesce(lefts, []) AS lefts, coalesce(rights, []) AS rights FROM placed p LEFT JOIN ways w
  ON w.doc_id IS NOT DISTINCT FROM p.doc_id AND w.source IS NOT DISTINCT FROM p.source AND w.leaf = p.leaf),
folding AS (
  SELECT doc_id, source, leaf, lefts, rights, 0 AS step, coalesce(changed, leaf) AS node FROM every
  UNION ALL SELECT doc_id, source, leaf, lefts, rights, step + 1, sha256(lefts[step + 1] || node || rights[step + 1]) FROM folding WHERE step < len(lefts)),
top AS (SELECT nodes[1] AS root FROM tops WHERE len(nodes) = 1)
SELECT f.doc_id, f.leaf, subroot, root,
  sha256(array_to_string(list_transform(range(1, len(lefts) + 1), lambda k: lefts[k] || rights[k]), '')) AS proof_sha256,
  node AS folded_root, node = root AS verified
FROM folding f JOIN subroots s ON s.source IS NOT DISTINCT FROM f.source CROSS JOIN top WHERE step = len(lefts)
"""
