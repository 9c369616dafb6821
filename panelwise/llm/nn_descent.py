"""Near-duplicate vectors by NN-descent.

Every vector keeps its most similar known others, however far they are. In each round the neighbours
of a vector, and the vectors that have it as a neighbour, are compared with each other, so that
neighbours of neighbours become neighbours; rounds go on until hardly a link is new. The first lists
come from orders of the vectors by random directions, as many as it takes for a pair at the
threshold to meet in one of them almost surely. A list whose entries are all above the threshold is
saturated and becomes longer. Edges above the threshold give the groups.

Lists cannot hold a group of any size, so links are counted, not listed: within a group, a vector
whose angle to the group's mean plus the largest such angle is below the threshold's is linked with
all others; the remaining ones are compared with the whole group in blocks, exactly. A link
between two vectors whose lists are full of links is in neither list. So groups of such vectors are
joined before that: where their means and widest angles allow a link, the vectors at the border are
compared in blocks. Last, a bounded
sample is compared with all vectors; while links are missing there, or vectors lack one of theirs,
the search goes on with new orders and longer lists, and at last fails.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from panelwise.llm.base import arrow_schema, columns, kind_of, materialize, rows_of
from panelwise.llm.graph import components

THRESHOLD = 0.95
NEIGHBOURS, LONGER = 8, 4  # list length, and its factor when saturated
NEXT, FIRST = 32, 2  # vectors met on each side in an order, and those kept of them besides links
MISSED, WAVE = 0.001, 8  # chance that a pair at the threshold meets in no order; orders made at once
ROUNDS, SETTLED = 50, 0.002  # rounds that count as not settling, and the share of new links that ends them
HUB = 96  # neighbours compared in one group
BLOCK = 1024  # vectors of a group compared in one task
AUDIT, AUDIT_RECALL, AUDIT_TRIES = 2_000, 0.99, 3
MARGIN = 1e-9


def unit(vectors: pa.Array) -> np.ndarray:
    """Rows of doubles of length 1, from a list column of one dimension."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = flat.reshape(len(vectors), -1) if len(vectors) else flat.reshape(0, 1)
    x = x / np.maximum(np.abs(x).max(axis=1, keepdims=True), 1e-300)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def orders_for(n: int, threshold: float) -> int:
    """Orders after which a pair at the threshold has met with all but the chance ``MISSED``.

    It meets in an order when its first bits agree down to a run of ``NEXT`` vectors.
    """
    same = 1 - np.arccos(threshold) / np.pi
    chance = same ** max(0.0, np.log2(max(1, n) / NEXT))
    return max(1, int(np.ceil(np.log(MISSED) / np.log1p(-min(chance, 0.999)))))


def first_edges(vectors: DataFrame, dim: int, threshold: float, k: int, bits: int, turns: Iterable[int]) -> DataFrame:
    """Edges v, u, sim between vectors that stand close in some order by random directions."""
    spec, schema = arrow_schema(vectors, "v long, u long, sim double")
    out = None
    for turn in turns:
        axes = np.random.default_rng(turn).standard_normal((dim, bits + 1))
        key_spec, key_schema = arrow_schema(vectors, f"code long, along double, node long, vec {kind_of(vectors, 'vec')}")

        def key(batches: Iterable[pa.RecordBatch], axes: np.ndarray = axes, schema: pa.Schema = key_schema) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                side = unit(batch.column("vec")) @ axes
                code = (side[:, :-1] > 0) @ (1 << np.arange(bits))
                yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(side[:, -1]), batch.column("node"), batch.column("vec").cast(schema.field("vec").type)], schema=schema)

        def meet(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            last: tuple | None = None
            for batch in batches:
                node, x = batch.column("node").to_numpy(), unit(batch.column("vec"))
                if last is not None:
                    node, x = np.concatenate([last[0], node]), np.concatenate([last[1], x])
                last = node[-NEXT:], x[-NEXT:]
                sim, other = np.full((len(node), 2 * NEXT), -2.0), np.zeros((len(node), 2 * NEXT), dtype=np.int64)
                for step in range(1, min(NEXT, len(node) - 1) + 1):
                    got = np.einsum("ij,ij->i", x[:-step], x[step:])
                    sim[:-step, step - 1] = sim[step:, NEXT + step - 1] = got
                    other[:-step, step - 1], other[step:, NEXT + step - 1] = node[step:], node[:-step]
                order = np.argsort(-sim, axis=1)[:, :k]
                sim, other = np.take_along_axis(sim, order, 1), np.take_along_axis(other, order, 1)
                i, j = np.nonzero((sim >= threshold) | (np.arange(sim.shape[1]) < FIRST) & (sim > -2))
                yield rows_of(schema, v=node[i], u=other[i, j], sim=sim[i, j])

        ordered = vectors.mapInArrow(key, key_spec).repartitionByRange("code", "along").sortWithinPartitions("code", "along")
        edges = ordered.mapInArrow(meet, spec)
        out = edges if out is None else out.unionByName(edges)
    return out


def best(edges: DataFrame, longer: DataFrame | None, k: int) -> DataFrame:
    """The k most similar of each vector, more for those in ``longer`` (v, k)."""
    order = Window.partitionBy("v").orderBy(F.desc("sim"), "u")
    edges = edges.where("v != u").groupBy("v", "u").agg(F.max("sim").alias("sim"))
    if longer is None:
        return edges.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k).drop("r")
    ranked = edges.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k * LONGER**AUDIT_TRIES)
    return ranked.join(longer, "v", "left").where(F.col("r") <= F.coalesce("k", F.lit(k))).select("v", "u", "sim")


def descend(graph: DataFrame, vectors: DataFrame, longer: DataFrame | None, k: int, active: DataFrame | None, turn: int) -> DataFrame:
    """Edges v, u, sim between neighbours of one vector that are more similar than the worst in v's list.

    ``active`` holds the vectors (v) whose neighbours are compared; the others' have been.
    """
    near = graph.select("v", "u")
    near = near.unionByName(near.select(F.col("u").alias("v"), F.col("v").alias("u"))).distinct()
    if active is not None:
        near = near.join(active, "v", "left_semi")
    parts = near.groupBy("v").agg(F.count("*").alias("n")).select("v", F.ceil(F.col("n") / HUB).alias("parts"))
    lists = graph.groupBy("v").agg(F.min("sim").alias("worst"), F.count("*").alias("n"))
    size = F.lit(k)
    if longer is not None:
        lists, size = lists.join(longer, "v", "left"), F.coalesce("k", F.lit(k))
    floor = -2.0
    worst = lists.select(F.col("v").alias("u"), F.when(F.col("n") >= size, F.col("worst")).otherwise(F.lit(floor)).alias("worst"))
    known = vectors.withColumnRenamed("node", "u").join(worst, "u", "left").withColumn("worst", F.coalesce("worst", F.lit(floor)))
    dealt = near.join(parts, "v").withColumn("part", F.pmod(F.xxhash64("u", F.lit(turn)), F.col("parts"))).join(known, "u")
    groups = dealt.groupBy("v", "part").agg(F.collect_list(F.struct("u", "vec", "worst")).alias("near"))
    spec, schema = arrow_schema(graph, "v long, u long, sim double")

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[tuple[np.ndarray, ...]] = []
            flat = batch.column("near").flatten()
            node, worst, x = flat.field("u").to_numpy(), flat.field("worst").to_numpy(), unit(flat.field("vec"))
            ends = np.cumsum(batch.column("near").value_lengths().to_numpy())
            for a, b in zip(np.append(0, ends[:-1]).tolist(), ends.tolist(), strict=True):
                sim = x[a:b] @ x[a:b].T
                i, j = np.nonzero(sim > worst[a:b, None])
                ok = i != j
                found.append((node[a:b][i[ok]], node[a:b][j[ok]], sim[i[ok], j[ok]]))
            v, u, sim = (np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.empty(0, np.int64),) * 3
            yield rows_of(schema, v=v, u=u, sim=sim)

    return groups.select("near").mapInArrow(compare, spec)


def search(vectors: DataFrame, dim: int, threshold: float, k: int, turns: range, graph: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The neighbour graph v, u, sim after NN-descent, with longer lists where they were saturated.

    The second table has the vectors (node) whose lists are saturated at the end. ``turns`` numbers the orders, ``graph`` holds what was found before.
    """
    bits = min(62, max(10, int(np.ceil(np.log2(max(1, vectors.count()))))))
    for at in range(0, len(turns), WAVE):
        edges = first_edges(vectors, dim, threshold, k, bits, turns[at:at + WAVE])
        graph = materialize(best(edges if graph is None else graph.unionByName(edges), None, k))
    longer, active = None, None
    for turn in range(ROUNDS):
        back = graph.select(F.col("u").alias("v"), F.col("v").alias("u"), "sim")
        new = materialize(best(graph.unionByName(back).unionByName(descend(graph, vectors, longer, k, active, turns.start + turn)), longer, k))
        changed = materialize(new.join(graph, ["v", "u"], "left_anti"))
        graph = new
        active = changed.select("v").unionByName(changed.select(F.col("u").alias("v"))).distinct()
        link = F.col("sim") >= threshold
        if changed.where(link).count() > SETTLED * graph.where(link).count():
            continue
        most = k if longer is None else k * LONGER
        full = graph.groupBy("v").agg(F.min("sim").alias("worst"), F.count("*").alias("n")).where((F.col("worst") >= threshold) & (F.col("n") >= most))
        if longer is not None or full.limit(1).count() == 0:
            return graph, full.select(F.col("v").alias("node"))
        longer, active = materialize(full.select("v", F.lit(k * LONGER).alias("k"))), None
    raise RuntimeError(f"the neighbour lists have not settled in {ROUNDS} rounds")


def bridges(members: DataFrame, threshold: float) -> DataFrame:
    """Links a, b between vectors of different components, one at least for each two that have any.

    ``members``: node, component, vec. Angles are to the mean of a component; what they exclude is no
    link for certain, all else is compared.
    """
    limit = float(np.arccos(threshold)) + MARGIN
    kind = kind_of(members, "vec")
    sum_spec, sum_schema = arrow_schema(members, "component long, total array<double>")

    def centre(rows: pa.Array) -> np.ndarray:
        x = rows.flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1).copy()
        x[np.abs(x).max(axis=1) < 1e-12, 0] = 1.0  # any direction will do
        return x / np.linalg.norm(x, axis=1, keepdims=True)

    def partial(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds, at = np.unique(batch.column("component").to_numpy(), return_inverse=True)
            x = unit(batch.column("vec"))
            total = np.zeros((len(kinds), x.shape[1]))
            np.add.at(total, at, x)
            yield rows_of(sum_schema, component=kinds, total=list(total))

    def add(groups: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, component = 0.0, None
        for batch in groups:
            x = batch.column("total")
            total = total + x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1).sum(axis=0)
            component = batch.column("component")[0].as_py()
        yield rows_of(sum_schema, component=[component], total=[total])

    means = materialize(members.select("component", "vec").mapInArrow(partial, sum_spec).groupBy("component").applyInArrow(add, sum_spec))
    angle_spec, angle_schema = arrow_schema(members, "component long, angle double")

    def angles(batch: pa.RecordBatch) -> np.ndarray:
        return np.arccos(np.clip(np.einsum("ij,ij->i", unit(batch.column("vec")), centre(batch.column("total"))), -1, 1))

    def to_mean(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield rows_of(angle_schema, component=batch.column("component"), angle=angles(batch))

    widest = members.join(means, "component").mapInArrow(to_mean, angle_spec).groupBy("component").agg(F.max("angle").alias("widest"))
    centres = materialize(means.join(widest, "component"))
    blocks = -(-max(1, centres.count()) // BLOCK)
    block, every = F.pmod(F.xxhash64("component"), F.lit(blocks)).cast("int"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    left = centres.select(block.alias("i"), every.alias("j"), F.lit(True).alias("side"), "component", "total", "widest")
    right = centres.select(every.alias("i"), block.alias("j"), F.lit(False).alias("side"), "component", "total", "widest")
    pair_spec, pair_schema = arrow_schema(members, "component long, other long, total array<double>, widest double")

    def allowed(groups: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = pa.Table.from_batches(groups).combine_chunks()
        side, name, wide = got.column("side").to_numpy(), got.column("component").to_numpy(), got.column("widest").to_numpy()
        x = centre(got.column("total").combine_chunks())
        apart = np.arccos(np.clip(x[side] @ x[~side].T, -1, 1))
        i, j = np.nonzero((apart <= wide[side][:, None] + wide[~side][None, :] + limit) & (name[side][:, None] != name[~side][None, :]))
        yield rows_of(pair_schema, component=name[side][i], other=name[~side][j], total=list(x[~side][j]), widest=wide[~side][j])

    pairs = materialize(left.unionByName(right).groupBy("i", "j").applyInArrow(allowed, pair_spec))
    near_spec, near_schema = arrow_schema(members, f"component long, other long, node long, vec {kind}")

    def at_border(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = batch.filter(pa.array(angles(batch) <= batch.column("widest").to_numpy() + limit))
            yield pa.RecordBatch.from_arrays([kept.column(f.name).cast(f.type) for f in near_schema], schema=near_schema)

    border = materialize(members.select("component", "node", "vec").join(pairs, "component").mapInArrow(at_border, near_spec))
    first, second = F.least("component", "other").alias("first"), F.greatest("component", "other").alias("second")
    border = border.select(first, second, (F.col("component") < F.col("other")).alias("side"), "node", "vec")
    sizes = border.groupBy("first", "second").agg(*[F.ceil(F.count(F.when(F.col("side") == s, 1)) / BLOCK).cast("int").alias(n) for s, n in ((True, "lows"), (False, "highs"))])
    dealt = border.join(sizes.where("lows > 0 AND highs > 0"), ["first", "second"])
    own = F.pmod(F.xxhash64("node"), F.when(F.col("side"), F.col("lows")).otherwise(F.col("highs"))).cast("int")
    low = dealt.where("side").select("first", "second", own.alias("i"), F.explode(F.sequence(F.lit(0), F.col("highs") - 1)).alias("j"), "side", "node", "vec")
    high = dealt.where("NOT side").select("first", "second", F.explode(F.sequence(F.lit(0), F.col("lows") - 1)).alias("i"), own.alias("j"), "side", "node", "vec")
    spec, schema = arrow_schema(members, "a long, b long")

    def compare(groups: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = pa.Table.from_batches(groups).combine_chunks()
        side, node, x = got.column("side").to_numpy(), got.column("node").to_numpy(), unit(got.column("vec").combine_chunks())
        i, j = np.nonzero(x[side] @ x[~side].T >= threshold)
        yield rows_of(schema, a=node[side][i[:1]], b=node[~side][j[:1]])

    return low.unionByName(high).groupBy("first", "second", "i", "j").applyInArrow(compare, spec)


def linked_weights(members: DataFrame, threshold: float) -> DataFrame:
    """node, linked: the weight of all vectors of the same component with that cosine, the own one left out.

    ``members``: node, component, weight, vec.
    """
    limit = float(np.arccos(threshold))
    sum_spec, sum_schema = arrow_schema(members, "component long, total array<double>, n long")

    def add(groups: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = pa.Table.from_batches(groups).combine_chunks()
        x = got.column("total").combine_chunks()
        flat = x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1)
        yield rows_of(sum_schema, component=[got.column("component")[0].as_py()], total=[flat.sum(axis=0)], n=[int(got.column("n").to_numpy().sum())])

    def partial(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:  # sums of each component within a batch, before the shuffle
            component, x = batch.column("component").to_numpy(), unit(batch.column("vec"))
            kinds, at = np.unique(component, return_inverse=True)
            total = np.zeros((len(kinds), x.shape[1]))
            np.add.at(total, at, x)
            yield rows_of(sum_schema, component=kinds, total=list(total), n=np.bincount(at, minlength=len(kinds)))

    means = members.select("component", "vec").mapInArrow(partial, sum_spec).groupBy("component").applyInArrow(add, sum_spec)
    angle_spec, angle_schema = arrow_schema(members, f"node long, component long, weight long, angle double, vec {kind_of(members, 'vec')}")

    def angle(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, mean = unit(batch.column("vec")), batch.column("total")
            zero = np.abs(mean.flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1)).max(axis=1) < 1e-12 if len(x) else np.empty(0, bool)
            cosine = np.einsum("ij,ij->i", x, unit(mean)) if not zero.any() else np.full(len(x), -1.0)
            yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("component"), batch.column("weight"), pa.array(np.arccos(np.clip(cosine, -1, 1))), batch.column("vec").cast(angle_schema.field("vec").type)], schema=angle_schema)

    placed = materialize(members.join(means.select("component", "total"), "component").mapInArrow(angle, angle_spec))
    widest = placed.groupBy("component").agg(F.max("angle").alias("widest"), F.sum("weight").alias("all"), F.count("*").alias("n"))
    known = placed.join(widest, "component").withColumn("sure", F.col("angle") + F.col("widest") <= limit - MARGIN)
    sure = known.where("sure").select("node", (F.col("all") - F.col("weight")).alias("linked"))
    # the others meet their whole component, a block of them against a block of it at a time
    block = F.pmod(F.xxhash64("node"), F.ceil(F.col("n") / BLOCK)).cast("int").alias("block")
    open_nodes = known.where("NOT sure").select("component", "node", "vec", block, F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    some = open_nodes.select("component").distinct()
    rest = known.join(some, "component").select("component", "node", "weight", "vec", block, F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    asking = open_nodes.select("component", F.col("block").alias("i"), every.alias("j"), "node", F.lit(None).cast("long").alias("weight"), "vec")
    asked = rest.select("component", every.alias("i"), F.col("block").alias("j"), "node", "weight", "vec")
    spec, schema = arrow_schema(members, "node long, linked long")

    def compare(groups: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = pa.Table.from_batches(groups).combine_chunks()
        weight = got.column("weight").combine_chunks()
        asks = weight.is_null().to_numpy(zero_copy_only=False)
        node, x, w = got.column("node").to_numpy(), unit(got.column("vec").combine_chunks()), weight.fill_null(0).to_numpy()
        hit = x[asks] @ x[~asks].T >= threshold
        hit &= node[asks][:, None] != node[~asks][None, :]
        yield rows_of(schema, node=node[asks], linked=hit @ w[~asks])

    counted = asking.unionByName(asked).groupBy("component", "i", "j").applyInArrow(compare, spec).groupBy("node").agg(F.sum("linked").alias("linked"))
    return sure.unionByName(counted)


def audit(vectors: DataFrame, linked: DataFrame, threshold: float, dim: int) -> float:
    """Share of the true links of a bounded sample that were counted, or of its vectors with links that have all, whichever is less."""
    sample = vectors.orderBy(F.xxhash64("node", F.lit(7)), "node").limit(AUDIT).select("node", "vec").toArrow()
    if not sample.num_rows:
        return 1.0
    node, x = sample.column("node").to_numpy(), unit(sample.column("vec").combine_chunks())
    spec, schema = arrow_schema(vectors, "node long, true long")

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(node), dtype=np.int64)
        for whole in batches:
            for at in range(0, whole.num_rows, BLOCK):
                batch = whole.slice(at, BLOCK)
                hit = x @ unit(batch.column("vec")).T >= threshold
                hit &= node[:, None] != batch.column("node").to_numpy()[None, :]
                total += hit @ batch.column("weight").to_numpy()
        yield rows_of(schema, node=node, true=total)

    true = vectors.mapInArrow(count, spec).groupBy("node").agg(F.sum("true").alias("true")).where(F.col("true") > 0)
    counted = F.least("true", F.coalesce("linked", F.lit(0)))
    both = true.join(linked, "node", "left").agg(
        F.sum("true").alias("true"), F.sum(counted).alias("found"), F.count("*").alias("n"), F.sum((counted == F.col("true")).cast("long")).alias("whole")
    ).first()
    return min(both["found"] / both["true"], both["whole"] / both["n"]) if both["n"] else 1.0


def near_vectors(
    df: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", threshold: float = THRESHOLD, k: int = NEIGHBOURS, log: list | None = None,
) -> DataFrame:
    """One row per row of the table: vec_id, n_links, component_id, kept.

    Equal vectors are one node with their number as weight. Null, empty and zero vectors and those
    with a null or non-finite number have no links; vectors of different lengths never link.
    Repeated rows are links of each other, rows without an id count like others, and an empty table
    gives no rows. ``log`` gets the audited recall of each try. When the last try's is too low, there
    is an error instead of a result with links missing.
    """
    rows = columns(df, vec_id=vec_id, vec=embedding)
    if kind_of(rows, "vec") != "array<float>":  # floats stay as they are, at half the size
        rows = rows.withColumn("vec", F.col("vec").cast("array<double>"))
    bad = F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    good = F.coalesce((F.size("vec") > 0) & ~bad & F.exists("vec", lambda x: x != 0), F.lit(False))
    rows = materialize(rows.select("vec_id", F.when(good, F.xxhash64("vec")).alias("node"), F.when(good, F.col("vec")).alias("vec")))
    nodes = materialize(rows.where("node IS NOT NULL").groupBy("node").agg(F.first("vec").alias("vec"), F.count("*").alias("weight"), F.min("vec_id").alias("least"), F.size(F.first("vec")).alias("dim")))
    kinds = [r["dim"] for r in nodes.select("dim").distinct().orderBy("dim").limit(1001).collect()]
    if len(kinds) > 1000:
        raise ValueError("more than 1000 lengths of vectors")
    links, groups = None, None
    for dim in kinds:
        mine = nodes.where(F.col("dim") == dim) if len(kinds) > 1 else nodes
        size, graph, begin, orders = k, None, 0, orders_for(mine.count(), threshold)
        for _ in range(AUDIT_TRIES):
            graph, full = search(mine.select("node", "vec"), dim, threshold, size, range(begin, begin + orders), graph)
            edges = graph.where(F.col("sim") >= threshold).select(F.col("v").alias("a"), F.col("u").alias("b"))
            label = components(edges)
            members = materialize(full.join(label, "node").join(mine.select("node", "vec"), "node"))
            if members.select("component").distinct().limit(2).count() > 1:
                across = materialize(bridges(members, threshold))
                if across.limit(1).count():
                    label = components(edges.unionByName(across))
            found = materialize(linked_weights(label.join(mine, "node").select("node", "component", "weight", "vec"), threshold))
            recall = audit(mine, found, threshold, dim)
            if log is not None:
                log.append((dim, size, recall))
            if recall >= AUDIT_RECALL:
                break
            begin, orders, size = begin + orders, 2 * orders, 2 * size
        else:
            raise RuntimeError(f"links of vectors of length {dim} are missing: audited recall {recall:.4f}")
        links = found if links is None else links.unionByName(found)
        groups = label if groups is None else groups.unionByName(label)
    if links is None:
        alone = F.lit(0).cast("long")
        return rows.select("vec_id", alone.alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    named = nodes.select("node", "weight", "least").join(links, "node", "left").join(groups, "node", "left").withColumn("component", F.coalesce("component", "node"))
    smallest = named.groupBy("component").agg(F.min("least").alias("component_id"))
    named = named.join(smallest, "component").select("node", (F.coalesce("linked", F.lit(0)) + F.col("weight") - 1).alias("n_links"), "component_id")
    out = rows.select("vec_id", "node").join(named, "node", "left")
    of = F.when(F.col("node").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), of.alias("component_id"), F.col("vec_id").eqNullSafe(of).alias("kept"))
