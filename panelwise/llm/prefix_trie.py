"""The trie of conversations by their first turns, with totals of every subtree by time-forward processing.

A conversation may begin with turns of another one (``rebuilt``). A node is a sequence of first turns;
it is known by two hashes, each the exclusive or of the hashes of its (position, role, text), so that
the nodes on a conversation's path are running totals, taken in slices of ``SLICE`` turns. Nodes,
members, children and parents then are plain aggregates and joins on these hashes.

A node is named after its smallest member and its depth. The nodes of one name and one number of
members are a run without branches: a chain. Totals are passed between chains: a node's own total
follows from its chain's by the running number of characters. Chains are handled by level. A chain is on
level k when its members number at most ``SHARD``**(k + 1) and not fewer; the connected chains of a
level are a shard, which hangs below one node of a higher level and holds at most 2 * ``SHARD`` chains
on level 0. Within a task the chains of its shards come in reverse level order, deepest first, from
Spark's external sort; each takes the totals sent to it from a priority queue and sends its own to its
parent. The queue spills sorted runs, packed as arrays. What shard roots send goes, added up before the
shuffle, to the next level's shards. There are as many levels as the logarithm of the
number of conversations, however deep the trie is. Nodes of one member need no totals.

The ids that end at a node are digested in order: slices of them are put together in parallel, so that
the one task that must see a node's list reads text pieces of ``PIECE`` ids, one at a time.

Odd input: turns of one number are ordered by a hash of role and text, null numbers come first, repeated
rows are turns of their own; rows without conversation are left out. Null and empty texts are the same.
A conversation of any length is numbered in slices. An empty table gives no node. Columns other than the
four are not read, whatever their names.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from panelwise.llm.base import arrow_schema, columns, materialize, rows_of
from panelwise.llm.merkle import CRC32
from panelwise.operators.running import row_numbers

SLICE = 1_024  # turns of a conversation whose running totals are taken together
SHARD = 20_000  # members of the chains of the lowest level
PIECE = 1_000  # ids digested together
QUEUE = 50_000  # messages held as objects; more are packed
FAMILY, LEAD = 100, 6  # conversations share first turns within a hundred ids: fewer than six of them


# --- conversations and their turns ---------------------------------------------
def numbered_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, position from 1, u1 and u2 (hashes of role and text), chars."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turns = conversations.where(F.col("conv_id").isNotNull()).select(
        "conv_id", "turn", *[F.xxhash64(F.lit(i), role, text).alias(f"u{i}") for i in (1, 2)],
        F.char_length(text).cast("long").alias("chars"),
    )
    turns = materialize(turns.withColumn("_order", F.struct("turn", "u1", "u2")))
    return materialize(row_numbers(turns, ["conv_id"], "_order", "position").drop("_order", "turn"))


def lead_of(conv_id: str) -> Column:
    """How many first turns a conversation takes from the first one of its hundred."""
    return F.crc32(F.col(conv_id).cast("string").cast("binary")) % LEAD


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The conversations with their lengths, and their turns: conv_id, depth, u1, u2, chars, length."""
    own = turns.groupBy("conv_id").agg(F.max("position").alias("n_own"))
    own = own.withColumns({"base": F.col("conv_id") - F.col("conv_id") % FAMILY, "lead": lead_of("conv_id")})
    first = own.where("conv_id = base").select(F.col("base").alias("_base"), F.col("n_own").alias("n_base"))
    met = own.join(first, F.col("base") == F.col("_base"), "left").select(
        "conv_id", "base", "lead", F.least("lead", F.coalesce("n_base", F.lit(0))).alias("taken"), "n_own")
    convs = materialize(met.withColumn("length", F.col("taken") + F.greatest(F.col("n_own") - F.col("lead"), F.lit(0))))
    later = turns.join(convs, "conv_id").where("position > lead").withColumn("depth", F.col("taken") + F.col("position") - F.col("lead"))
    # at most five turns of every hundredth conversation, for the at most 199 that share them
    given = turns.where((F.col("conv_id") % FAMILY == 0) & (F.col("position") < LEAD)).withColumnRenamed("conv_id", "base")
    earlier = given.join(convs.where("taken > 0").select("conv_id", "base", "taken", "length"), "base").where("position <= taken")
    wanted = ["conv_id", "depth", "u1", "u2", "chars", "length"]
    return convs, later.select(*wanted).unionByName(earlier.withColumn("depth", F.col("position")).select(*wanted))


def memberships(convs: DataFrame, turns: DataFrame) -> DataFrame:
    """Every node that a conversation is a member of: conv_id, depth, h1 and h2, its parent's p1 and p2, chars
    of the last turn, prefix (chars up to it), last (whether the conversation ends there)."""
    marked = turns.withColumns({
        **{f"t{i}": F.xxhash64(F.lit(i), "depth", "u1", "u2") for i in (1, 2)},
        "slice": F.expr(f"(depth - 1) div {SLICE}"),
    }).select("conv_id", "slice", "depth", "t1", "t2", "chars", (F.col("depth") == F.col("length")).alias("last"), "length")
    totals = lambda over: [
        (F.bit_xor(c) if c != "chars" else F.sum(c)).over(over).alias(f"_{c}") for c in ("t1", "t2", "chars")
    ]
    # Slices after the first begin with what stands before them; few conversations have any.
    long = marked.where(F.col("length") > SLICE).groupBy("conv_id", "slice").agg(
        F.bit_xor("t1").alias("t1"), F.bit_xor("t2").alias("t2"), F.sum("chars").alias("chars"))
    before = W.partitionBy("conv_id").orderBy("slice").rowsBetween(W.unboundedPreceding, -1)
    begins = long.select("conv_id", "slice", *totals(before)).withColumnsRenamed({f"_{c}": f"{c}_begin" for c in ("t1", "t2", "chars")})
    inside = W.partitionBy("conv_id", "slice").orderBy("depth").rowsBetween(W.unboundedPreceding, 0)
    run = marked.select("*", *totals(inside)).join(begins, ["conv_id", "slice"], "left")
    begin = lambda c: F.coalesce(f"{c}_begin", F.lit(0).cast("long"))
    hashed = run.withColumns({f"h{i}": F.col(f"_t{i}").bitwiseXOR(begin(f"t{i}")) for i in (1, 2)})
    zero = F.lit(0).cast("long")
    root = convs.select("conv_id", zero.alias("depth"), zero.alias("h1"), zero.alias("h2"), F.lit(None).cast("long").alias("p1"),
                        F.lit(None).cast("long").alias("p2"), zero.alias("chars"), zero.alias("prefix"), (F.col("length") == 0).alias("last"))
    return hashed.select(
        "conv_id", F.col("depth").cast("long").alias("depth"), "h1", "h2", F.col("h1").bitwiseXOR(F.col("t1")).alias("p1"),
        F.col("h2").bitwiseXOR(F.col("t2")).alias("p2"), "chars", (F.col("_chars") + begin("chars")).alias("prefix"), "last",
    ).unionByName(root)


def nodes_of(members: DataFrame) -> DataFrame:
    """One row per node, with its parent's name and number of members, its children, and those of one member."""
    facts = ["depth", "p1", "p2", "chars", "prefix"]  # the same for all members
    nodes = materialize(members.groupBy("h1", "h2").agg(
        F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), *[F.min(c).alias(c) for c in facts]))
    children = nodes.where("depth > 0").groupBy(F.col("p1").alias("h1"), F.col("p2").alias("h2")).agg(
        F.count("*").alias("n_children"), F.count_if(F.col("n_convs") == 1).alias("n_single"))
    parents = nodes.select(F.col("h1").alias("p1"), F.col("h2").alias("p2"), F.col("conv_id").alias("parent_conv_id"),
                           F.col("n_convs").alias("parent_convs"))
    whole = nodes.join(children, ["h1", "h2"], "left").fillna(0, ["n_children", "n_single"])
    return materialize(whole.join(parents, ["p1", "p2"], "left").drop("p1", "p2"))


# --- totals of subtrees --------------------------------------------------------
class SpillingQueue:
    """A priority queue of messages (key, key, leaves, saved), smallest key first.

    Up to ``room`` messages are a heap of objects. A full heap is sorted and packed into an array, 32 bytes
    a message, from which it is read again in order. A shard's size bounds what is packed.
    """

    def __init__(self, room: int = QUEUE):
        self.room = room
        self.heap: list[tuple] = []
        self.runs: list[tuple[np.ndarray, int]] = []  # packed messages and the next one's place
        self.heads: list[tuple] = []  # heap of (next message, run)

    def push(self, message: tuple) -> None:
        heapq.heappush(self.heap, message)
        if len(self.heap) > self.room:
            run = np.array(sorted(self.heap), dtype=np.int64)
            self.heap = []
            self.runs.append((run, 0))
            self._head(len(self.runs) - 1)

    def _head(self, i: int) -> None:
        run, at = self.runs[i]
        if at < len(run):
            heapq.heappush(self.heads, (tuple(run[at].tolist()), i))
            self.runs[i] = run, at + 1
        else:
            self.runs[i] = run[:0], 0

    def first(self) -> tuple | None:
        if self.heads and (not self.heap or self.heads[0][0] < self.heap[0]):
            return self.heads[0][0]
        return self.heap[0] if self.heap else None

    def pop(self) -> tuple:
        if self.heads and (not self.heap or self.heads[0][0] < self.heap[0]):
            message, i = heapq.heappop(self.heads)
            self._head(i)
            return message
        return heapq.heappop(self.heap)


TOTALS = "conv_id long, n_convs long, bottom long, top long, parent_conv_id long, root boolean, before long, n_leaves long, saved long"


def forward(chains: DataFrame, room: int = QUEUE) -> DataFrame:
    """The totals of each chain of the shards of one level, from what it has itself and what it is sent."""
    spec, schema = arrow_schema(chains, TOTALS)
    facts = ("conv_id", "n_convs", "bottom", "top", "parent_conv_id", "root", "before")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queue, shard = SpillingQueue(room), None
        for batch in batches:
            col = {name: batch.column(name).to_pylist() for name in batch.schema.names}
            leaves, saved = [], []
            for i in range(batch.num_rows):
                if (col["s1"][i], col["s2"][i]) != shard:
                    queue, shard = SpillingQueue(room), (col["s1"][i], col["s2"][i])
                mine = (-col["bottom"][i], col["conv_id"][i])
                n, tokens = col["n_leaves"][i], col["saved"][i]
                while (head := queue.first()) is not None and head[:2] == mine:
                    message = queue.pop()
                    n, tokens = n + message[2], tokens + message[3]
                if not col["root"][i]:
                    queue.push((1 - col["top"][i], col["parent_conv_id"][i], n, tokens))
                leaves.append(n)
                saved.append(tokens)
            yield rows_of(schema, **{f: col[f] for f in facts}, n_leaves=leaves, saved=saved)

    ordered = chains.repartition("s1", "s2").sortWithinPartitions("s1", "s2", F.desc("bottom"), "conv_id")
    return ordered.mapInArrow(run, spec)


def level_of(members: Column, shard: int, levels: int) -> Column:
    """The smallest k with at most shard**(k + 1) members."""
    level = F.lit(levels - 1)
    for k in range(levels - 2, -1, -1):
        level = F.when(members <= shard ** (k + 1), k).otherwise(level)
    return level


def chain_totals(nodes: DataFrame, members: DataFrame, shard: int = SHARD, room: int = QUEUE) -> list[DataFrame]:
    """The totals of all chains of two members and more, one written table per level."""
    shared = nodes.where("n_convs > 1")
    most = shared.agg(F.max("n_convs")).first()[0]
    if most is None:
        return []
    levels = 1
    while shard ** levels < most:
        levels += 1
    level = lambda c: level_of(F.col(c), shard, levels)
    top, bottom = F.min(F.struct("depth", "prefix", "chars", "parent_conv_id", "parent_convs", "h1", "h2")), F.max(F.struct("depth", "prefix", "n_children", "n_single"))
    chains = shared.groupBy("conv_id", "n_convs").agg(top.alias("t"), bottom.alias("b")).select(
        "conv_id", "n_convs", level("n_convs").alias("level"), F.col("t.depth").alias("top"), F.col("b.depth").alias("bottom"),
        "t.parent_conv_id", (F.col("t.depth").eqNullSafe(0) | (level("t.parent_convs") > level("n_convs"))).alias("root"),
        F.col("t.h1").alias("h1"), F.col("t.h2").alias("h2"), (F.col("t.prefix") - F.col("t.chars")).alias("before"),
        F.when(F.col("b.n_children") == 0, 1).otherwise(F.col("b.n_single")).cast("long").alias("n_leaves"),
        ((F.col("n_convs") - 1) * (F.col("b.prefix") - F.col("t.prefix") + F.col("t.chars"))).alias("saved"),
    )
    chains = materialize(chains)
    # A chain's shard root is the one of its level on the path of the conversation it is named after.
    roots = chains.where("root").select("level", "h1", "h2")
    owners = chains.select("conv_id", "level").distinct()
    paths = members.select("conv_id", "h1", "h2").join(owners, "conv_id")
    shards = paths.join(roots, ["h1", "h2", "level"]).select("conv_id", "level", F.col("h1").alias("s1"), F.col("h2").alias("s2"))
    placed = materialize(chains.drop("h1", "h2").join(shards, ["conv_id", "level"]))
    done: list[DataFrame] = []
    for k in range(levels):
        mine = placed.where(F.col("level") == k)
        if done:
            sent = done[0]
            for other in done[1:]:
                sent = sent.unionByName(other)
            sent = sent.where("root AND parent_conv_id IS NOT NULL").groupBy(
                F.col("parent_conv_id").alias("conv_id"), (F.col("top") - 1).alias("bottom")
            ).agg(F.sum("n_leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
            mine = mine.join(sent, ["conv_id", "bottom"], "left").withColumns({
                "n_leaves": F.col("n_leaves") + F.coalesce("more_leaves", F.lit(0)), "saved": F.col("saved") + F.coalesce("more_saved", F.lit(0)),
            }).drop("more_leaves", "more_saved")
        done.append(materialize(forward(mine, room)))
    return done


# --- what ends at a node -------------------------------------------------------
def ends_of(members: DataFrame) -> DataFrame:
    """h1, h2, ends_sha256: the digest of the ids, in order, of the conversations that end at a node."""
    spec, schema = arrow_schema(members, "h1 long, h2 long, first long, ids string")
    result, result_schema = arrow_schema(members, "h1 long, h2 long, ends_sha256 string")

    def pieces(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            h1, h2, ids = (batch.column(c).to_numpy() for c in ("h1", "h2", "conv_id"))
            new = np.flatnonzero((h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])) + 1
            cuts = np.union1d(np.concatenate([[0], new]), np.arange(0, len(ids), PIECE))
            stops = [*cuts[1:].tolist(), len(ids)]
            text = list(map(str, ids.tolist()))
            joined = [",".join(text[a:b]) for a, b in zip(cuts.tolist(), stops, strict=True)]
            yield rows_of(schema, h1=h1[cuts], h2=h2[cuts], first=ids[cuts], ids=joined)

    def digests(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, digest = None, sha256()
        for batch in batches:
            done: list[tuple[int, int, str]] = []
            for h1, h2, ids in zip(*(batch.column(c).to_pylist() for c in ("h1", "h2", "ids")), strict=True):
                if (h1, h2) == node:
                    digest.update(b",")
                else:
                    if node is not None:
                        done.append((*node, digest.hexdigest()))
                    node, digest = (h1, h2), sha256()
                digest.update(ids.encode())
            yield rows_of(result_schema, h1=[d[0] for d in done], h2=[d[1] for d in done], ends_sha256=[d[2] for d in done])
        if node is not None:
            yield rows_of(result_schema, h1=[node[0]], h2=[node[1]], ends_sha256=[digest.hexdigest()])

    ends = members.where("last").select("h1", "h2", "conv_id")
    cut = ends.repartitionByRange("h1", "h2", "conv_id").sortWithinPartitions("h1", "h2", "conv_id").mapInArrow(pieces, spec)
    return cut.repartition("h1", "h2").sortWithinPartitions("h1", "h2", "first").mapInArrow(digests, result)


def trie(conversations: DataFrame, shard: int = SHARD, room: int = QUEUE) -> DataFrame:
    """One row per node: conv_id (its smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens and ends_sha256. ``shard`` bounds what a task holds at a time, ``room`` a queue's objects."""
    convs, turns = rebuilt(numbered_turns(columns(conversations, conv_id="conv_id", turn="turn", role="role", text="text")))
    members = materialize(memberships(convs, turns))
    nodes = nodes_of(members)
    single = nodes.where("n_convs = 1").withColumns({"n_leaves": F.lit(1).cast("long"), "saved_tokens": F.lit(0).cast("long")})
    whole = single
    for totals in chain_totals(nodes, members, shard, room):
        # Below a chain's top, what its nodes above the one in question save is taken off.
        above = (F.col("n_convs") - 1) * (F.col("prefix") - F.col("chars") - F.col("before"))
        met = nodes.where("n_convs > 1").join(totals.select("conv_id", "n_convs", "before", "n_leaves", "saved"), ["conv_id", "n_convs"])
        whole = whole.unionByName(met.withColumn("saved_tokens", F.col("saved") - above).select(*single.columns))
    found = whole.join(ends_of(members), ["h1", "h2"], "left")
    return found.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(sha256().hexdigest())).alias("ends_sha256"),
    )


#: The same in SQL, for the registered query.
SQL = f"""
WITH turns AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS j, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS MATERIALIZED (SELECT conv_id, conv_id - conv_id % {FAMILY} AS base, CAST({CRC32.format('conv_id')} % {LEAD} AS BIGINT) AS h, n_own FROM (
  SELECT conv_id, count(*) AS n_own FROM turns GROUP BY conv_id)),
rebuilt AS (
  SELECT c.conv_id, j AS depth, role, text FROM convs c JOIN turns t ON t.conv_id = c.base AND j <= h
  UNION ALL
  SELECT t.conv_id, least(c.h, coalesce(b.n_own, 0)) + j - c.h, role, text
  FROM turns t JOIN convs c USING (conv_id) LEFT JOIN convs b ON b.conv_id = c.base WHERE j > c.h),
paths AS MATERIALIZED (
  SELECT conv_id, depth, length(text) AS chars,
    string_agg(length(role) || ':' || role || length(text) || ':' || text, '') OVER (PARTITION BY conv_id ORDER BY depth) AS path FROM rebuilt
  UNION ALL SELECT conv_id, 0, 0, '' FROM convs),
named AS MATERIALIZED (SELECT *, min(conv_id) OVER (PARTITION BY depth, path) AS node FROM paths),
nodes AS MATERIALIZED (SELECT node AS conv_id, depth, count(*) AS n_convs, min(chars) AS chars FROM named GROUP BY node, depth),
linked AS MATERIALIZED (SELECT n.*, p.node AS parent_conv_id FROM nodes n LEFT JOIN named p ON p.conv_id = n.conv_id AND p.depth = n.depth - 1),
kids AS (SELECT parent_conv_id AS conv_id, depth - 1 AS depth, count(*) AS n_children FROM linked WHERE depth > 0 GROUP BY ALL),
full_nodes AS MATERIALIZED (SELECT l.*, coalesce(n_children, 0) AS n_children FROM linked l LEFT JOIN kids USING (conv_id, depth)),
sums AS (
  SELECT a.node AS conv_id, a.depth, CAST(count(*) FILTER (b.n_children = 0) AS BIGINT) AS n_leaves, CAST(sum((b.n_convs - 1) * b.chars) AS BIGINT) AS saved_tokens
  FROM full_nodes b JOIN named a ON a.conv_id = b.conv_id AND a.depth <= b.depth GROUP BY ALL),
ends AS (
  SELECT node AS conv_id, depth, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) AS ids FROM (
    SELECT *, max(depth) OVER (PARTITION BY conv_id) AS length FROM named) WHERE depth = length GROUP BY ALL)
SELECT f.conv_id, f.depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM full_nodes f JOIN sums USING (conv_id, depth) LEFT JOIN ends USING (conv_id, depth)
"""
