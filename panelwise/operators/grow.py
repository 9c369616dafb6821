"""Trees grown by numpy in tasks: the same forest as Spark ML's, a bundle of whole trees a task.

Spark ML grows a level a job, with dense statistics of every open node from every task. Here rows become small codes
first (the bin of each number, the numbers of the columns that are one), about 20 bytes a row, and go to as many tasks
as there are cores; a task then needs nothing from others to grow its trees. What a task holds is bounded by
``TASK_BYTES``: larger fits are Spark ML's.
"""

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers need not have the package

TASK_BYTES = 640_000_000  # of codes and of what growing adds to them
GROWING_BYTES = 48  # a row: its place, count and moves
SUMMARY = 1_024  # points that stand for a partition's values of one column
ROWS_AT_ONCE = 1 << 14
CELLS_AT_ONCE = 1 << 18
LEAST_GAIN = 1e-12  # below that it is rounding

FACTS = "part int, rows array<long>, weights array<double>, binary array<boolean>, ones int, points array<array<double>>"
BLOCKS = "part int, block int, rows int, labels binary, codes binary, ones binary"
NODE = (
    "struct<id:int,prediction:double,impurity:double,impurityStats:array<double>,rawCount:bigint,gain:double,leftChild:int,"
    "rightChild:int,split:struct<featureIndex:int,leftCategoriesOrThreshold:array<double>,numCategories:int>>"
)
GROWN = f"treeID int, nodeData {NODE}, importances array<double>"  # importances stand in a tree's first row


@dataclass(frozen=True)
class Codes:
    """How rows become codes: thresholds of each column of numbers, the columns of zeros and ones, and facts of the rows."""

    numbers: tuple[int, ...]
    cuts: tuple[np.ndarray, ...]
    binary: np.ndarray
    ones: int  # the most ones of a row
    width: int
    rows: int
    class_weights: tuple[float, float]

    @property
    def bytes_of_row(self) -> int:
        return 2 * (len(self.numbers) + self.ones) + 1 + GROWING_BYTES

    @property
    def fits_in_task(self) -> bool:
        return self.rows * self.bytes_of_row <= TASK_BYTES and self.cells < 1 << 15

    @property
    def starts(self) -> np.ndarray:
        """The first cell of every column of numbers; then come those of the binary columns and one for no column."""
        return np.cumsum([0, *[len(c) + 1 for c in self.cuts]])

    @property
    def cells(self) -> int:
        return int(self.starts[-1]) + len(self.binary) + 1


def _matrix(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def learn_codes(encoded: DataFrame, label: str, weight: str, width: int, bins: int) -> Codes | None:
    """Bins of every column from one pass: midpoints of few values, else quantiles within a thousandth of a partition's
    rows. None where labels are not 0 and 1 or a class has several weights."""
    rows = encoded.select(F.spark_partition_id().alias("part"), F.col(label).cast("double").alias("y"), F.col(weight).cast("double").alias("w"), vector_to_array("features").alias("x"))

    def facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [(b.column("part")[0].as_py(), b.column("y").to_numpy(zero_copy_only=False), b.column("w").to_numpy(zero_copy_only=False), _matrix(b.column("x"), width)) for b in batches if len(b)]
        if not got:
            return
        y, w, x = (np.concatenate([g[i] for g in got]) for i in (1, 2, 3))
        counts = [int((y == c).sum()) for c in (0, 1)]
        of = [w[y == c] for c in (0, 1)]
        ends = [v for a in of for v in ((a.min(), a.max()) if len(a) else (np.inf, -np.inf))]
        binary = ((x == 0) | (x == 1)).all(axis=0)
        ones = int((x[:, binary] == 1).sum(axis=1).max()) if binary.any() else 0
        points = []
        for j in range(width):
            values = np.sort(x[:, j]) if not binary[j] else np.empty(0)
            if len(values) > SUMMARY and len(np.unique(values)) > bins:
                values = values[((np.arange(SUMMARY) + 0.5) * len(values) / SUMMARY).astype(int)]
            elif len(values):
                values, n = np.unique(values, return_counts=True)
                points.append([v for pair in zip(values.tolist(), n.tolist()) for v in pair])
                continue
            points.append([v for a in values.tolist() for v in (a, len(x) / SUMMARY)])
        yield pa.RecordBatch.from_pylist([{
            "part": got[0][0], "rows": [*counts, len(y)], "weights": ends, "binary": binary.tolist(), "ones": ones, "points": points,
        }], schema=pa.schema([("part", pa.int32()), ("rows", pa.list_(pa.int64())), ("weights", pa.list_(pa.float64())), ("binary", pa.list_(pa.bool_())), ("ones", pa.int32()), ("points", pa.list_(pa.list_(pa.float64())))]))

    parts = sorted(rows.mapInArrow(facts, FACTS).collect(), key=lambda r: r.part)  # a few thousand numbers a partition
    if not parts:
        return None
    counts = np.sum([r.rows for r in parts], axis=0)
    if counts[0] + counts[1] != counts[2]:
        return None
    weights = []
    for c in (0, 1):
        low, high = min(r.weights[2 * c] for r in parts), max(r.weights[2 * c + 1] for r in parts)
        if low < high or not (np.isfinite(low) or counts[c] == 0) or low <= 0:
            return None
        weights.append(float(low) if counts[c] else 1.0)
    binary = np.logical_and.reduce([r.binary for r in parts])
    ones = max(r.ones for r in parts)
    numbers, cuts = [], []
    for j in np.flatnonzero(~binary).tolist():
        # A partition may hold only zeros and ones of a column; it then says nothing of their shares but that they occur.
        pairs = [p for r in parts for p in zip(r.points[j][::2], r.points[j][1::2], strict=True)]
        pairs += [(v, 1.0) for r in parts if r.binary[j] for v in (0.0, 1.0)]
        value, n = np.array([p[0] for p in pairs]), np.array([p[1] for p in pairs])
        distinct, at = np.unique(value, return_inverse=True)
        if np.isnan(distinct).any():
            return None
        if len(distinct) <= bins:
            cut = (distinct[:-1] + distinct[1:]) / 2
        else:
            reached = np.cumsum(np.bincount(at, weights=n))
            cut = np.unique(distinct[np.searchsorted(reached, np.arange(1, bins) * reached[-1] / bins)])
            cut = cut[cut < distinct[-1]]
        numbers.append(j)
        cuts.append(cut)
    return Codes(tuple(numbers), tuple(cuts), np.flatnonzero(binary), ones, width, int(counts[2]), (weights[0], weights[1]))


def blocks(encoded: DataFrame, label: str, codes: Codes) -> DataFrame:
    """The rows as codes, a few thousand in one row."""
    width, numbers, cuts, binary, most = codes.width, codes.numbers, codes.cuts, codes.binary, codes.ones
    rows = encoded.select(F.spark_partition_id().alias("part"), F.col(label).cast("byte").alias("y"), vector_to_array("features").alias("x"))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for i, b in enumerate(b for b in batches if len(b)):
            x = _matrix(b.column("x"), width)
            of_numbers = np.empty((len(x), len(numbers)), np.uint8)
            for at, (j, cut) in enumerate(zip(numbers, cuts, strict=True)):
                of_numbers[:, at] = np.searchsorted(cut, x[:, j], side="left")
            of_ones = np.full((len(x), most), len(binary), np.int16)
            row, column = np.nonzero(x[:, binary] == 1)
            first = np.searchsorted(row, np.arange(len(x)))
            of_ones[row, np.arange(len(row)) - first[row]] = column
            yield pa.RecordBatch.from_arrays([
                pa.array([b.column("part")[0].as_py()], pa.int32()), pa.array([i], pa.int32()), pa.array([len(x)], pa.int32()),
                pa.array([b.column("y").to_numpy(zero_copy_only=False).astype(np.int8).tobytes()], pa.binary()),
                pa.array([of_numbers.tobytes()], pa.binary()), pa.array([of_ones.tobytes()], pa.binary()),
            ], names=["part", "block", "rows", "labels", "codes", "ones"])

    return rows.mapInArrow(packed, BLOCKS)


def gathered(batches: Iterator[pa.RecordBatch], codes: Codes) -> tuple[int, np.ndarray, np.ndarray]:
    """The task's number, and all rows in one order: their labels and their cells."""
    got = sorted((r for b in batches for r in b.to_pylist()), key=lambda r: (r["part"], r["block"]))
    if not got:
        return -1, np.empty(0, np.int8), np.empty((0, 0), np.int16)
    fields, starts, at = len(codes.numbers), codes.starts, 0
    rows = sum(r["rows"] for r in got)
    label, cell = np.empty(rows, np.int8), np.empty((rows, fields + codes.ones), np.int16)
    for r in got:
        to = slice(at, at + r["rows"])
        label[to] = np.frombuffer(r["labels"], np.int8)
        cell[to, :fields] = np.frombuffer(r["codes"], np.uint8).reshape(r["rows"], fields) + starts[:-1]
        cell[to, fields:] = np.frombuffer(r["ones"], np.int16).reshape(r["rows"], codes.ones) + starts[-1]
        at += r["rows"]
    return got[0]["bundle"], label, cell


class Splits:
    """Every split there is: of a column's numbers by a threshold, of a binary column by its ones."""

    def __init__(self, codes: Codes):
        starts, self.fields = codes.starts, len(codes.numbers)
        sizes = [len(c) for c in codes.cuts]
        self.of_numbers = sum(sizes)
        self.ranges = [(int(starts[i]), int(starts[i]) + n, sum(sizes[:i]), sum(sizes[: i + 1])) for i, n in enumerate(sizes)]
        self.ones = slice(int(starts[-1]), int(starts[-1]) + len(codes.binary))
        self.feature = np.concatenate([*[np.full(n, j) for n, j in zip(sizes, codes.numbers, strict=True)], codes.binary]).astype(np.int32)
        self.threshold = np.concatenate([*codes.cuts, np.full(len(codes.binary), 0.5)])
        self.slot = np.concatenate([*[np.full(n, i) for i, n in enumerate(sizes)], np.zeros(len(codes.binary))]).astype(np.int64)
        self.last = np.concatenate([*[starts[i] + np.arange(n) for i, n in enumerate(sizes)], starts[-1] + np.arange(len(codes.binary))]).astype(np.int16)
        self.cells, self.width = codes.cells, codes.width

    def left(self, cells: np.ndarray, totals: np.ndarray) -> np.ndarray:
        """What lies left of each split, from what lies in each cell: nodes x splits."""
        found = np.empty((len(cells), len(self.feature)))
        for a, b, first, end in self.ranges:
            np.cumsum(cells[:, a:b], axis=1, out=found[:, first:end])
        np.subtract(totals[:, None], cells[:, self.ones], out=found[:, self.of_numbers:])
        return found

    def goes_left(self, cell: np.ndarray, row: np.ndarray, split: np.ndarray) -> np.ndarray:
        """Whether a row goes left in the split of its node."""
        last = self.last.take(split)
        left = cell.ravel().take(row * cell.shape[1] + self.slot.take(split)) <= last
        of_one = np.flatnonzero(split >= self.of_numbers)
        if len(of_one):
            left[of_one] = ~(cell.take(row[of_one], axis=0)[:, self.fields:] == last[of_one, None]).any(axis=1)
        return left


def pieces(begins: np.ndarray, ends: np.ndarray, which: np.ndarray, row: np.ndarray, sizes: np.ndarray, at_once: int):
    """Open nodes some at a time, with their rows and each row's place among these nodes."""
    for first in range(0, len(which), at_once):
        some = which[first: first + at_once]
        a, b = begins[some[0]], ends[some[-1]]
        if len(some) == some[-1] - some[0] + 1:
            yield some, row[a:b], np.repeat(np.arange(len(some)), sizes[some])
        else:
            yield some, np.concatenate([row[begins[i]: ends[i]] for i in some.tolist()]) if len(some) < 64 else row[a:b][
                np.repeat(np.isin(np.arange(some[0], some[-1] + 1), some), sizes[some[0]: some[-1] + 1])
            ], np.repeat(np.arange(len(some)), sizes[some])


def parted(row: np.ndarray, rank: np.ndarray, left: np.ndarray, nodes: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows in the order of their children, and each child's rows."""
    child = 2 * rank + ~left
    order = np.argsort(child.astype(np.uint16) if 2 * nodes < 1 << 16 else child, kind="stable")  # by radix in 16 bits
    return row.take(order), np.bincount(child, minlength=2 * nodes)


def grow_levels(row: np.ndarray, cell: np.ndarray, splits: Splits, depth: int, facts, opens, choose, ended: list | None = None) -> dict[str, np.ndarray]:
    """Nodes of one tree, level by level: split of each (-1 in leaves), gain, facts and left child (the right one follows).

    ``facts`` gives a node's numbers, ``opens`` says which may split, ``choose`` gives splits and gains; ``ended``
    takes the rows of leaves and their leaves.
    """
    sizes, levels, seen = np.array([len(row)]), [], 1
    at_once = max(1, CELLS_AT_ONCE // (2 * splits.cells))
    for level in range(depth + 1):
        ends = np.cumsum(sizes)
        begins, nodes = ends - sizes, len(sizes)
        known = facts(row, sizes)
        split, gain = np.full(nodes, -1), np.full(nodes, -1.0)
        after, counts, done = [], [], 0
        which = np.flatnonzero(opens(known)) if level < depth else np.empty(0, np.int64)
        for some, mine, at in pieces(begins, ends, which, row, sizes, at_once):
            best, found = choose(mine, at, known[some])
            good = found > LEAST_GAIN
            split[some[good]], gain[some[good]] = best[good], found[good]
            if not good.any():
                continue
            if not good.all():
                goes = good.take(at)
                mine, at = mine[goes], (np.cumsum(good) - 1).take(at[goes])
                best = best[good]
            lefts = [splits.goes_left(cell, mine[x: x + ROWS_AT_ONCE], best.take(at[x: x + ROWS_AT_ONCE])) for x in range(0, len(mine), ROWS_AT_ONCE)]
            moved, of_children = parted(mine, at, np.concatenate(lefts), len(best))
            after.append(moved)
            counts.append(of_children)
            done += len(best)
        if ended is not None:
            leaf = np.flatnonzero(split < 0)
            ended.append((row[np.repeat(split < 0, sizes)], np.repeat(seen - nodes + leaf, sizes[leaf])))
        child = np.where(split >= 0, seen + 2 * (np.cumsum(split >= 0) - 1), -1)
        levels.append((split, gain, known, child))
        seen += 2 * done
        if not done:
            break
        row, sizes = np.concatenate(after), np.concatenate(counts)
    first = np.cumsum([0, *[len(x[0]) for x in levels]])
    made = {name: np.concatenate([x[i] for x in levels]) for i, name in enumerate(("split", "gain", "facts", "left"))}
    return made | {"first": first}


def summed(row, at, cell, splits: Splits, nodes: int, of_row, kinds: int, weight) -> np.ndarray:
    """Per kind, node and cell the weights of the rows: ``of_row`` gives a row's kind, ``weight`` its weight (None: 1)."""
    size, each = nodes * splits.cells, cell.shape[1]
    held = np.zeros(kinds * size)
    for x in range(0, len(row), ROWS_AT_ONCE):
        r = row[x: x + ROWS_AT_ONCE]
        base = at[x: x + ROWS_AT_ONCE] * splits.cells
        if of_row is not None:
            base += of_row.take(r) * size
        key = (cell.take(r, axis=0) + base[:, None]).ravel()
        held += np.bincount(key, None if weight is None else np.repeat(weight.take(r), each), kinds * size)
    return held.reshape(kinds, nodes, splits.cells)


def grow_tree(label, cell, splits: Splits, class_weights, rng, depth: int, least: int, tried: int) -> dict[str, np.ndarray]:
    """One tree of a forest, from a bag of the rows; a node's facts are its rows of the two classes."""
    weights, of_class = np.asarray(class_weights), label.astype(np.int64)
    times = rng.poisson(1.0, len(label)).astype(float)
    while not times.any():
        times = rng.poisson(1.0, len(label)).astype(float)

    def facts(row, sizes):
        node = np.repeat(np.arange(len(sizes)) * 2, sizes) + of_class.take(row)
        return np.bincount(node, times.take(row), 2 * len(sizes)).reshape(len(sizes), 2)

    def choose(row, at, known):
        return best_splits(splits, summed(row, at, cell, splits, len(known), of_class, 2, times), known, weights, least, tried, rng)

    opens = lambda known: (known.min(axis=1) > 0) & (known.sum(axis=1) >= 2 * least)
    return grow_levels(np.flatnonzero(times), cell, splits, depth, facts, opens, choose)


def best_splits(splits: Splits, held, totals, weights, least: int, tried: int, rng) -> tuple[np.ndarray, np.ndarray]:
    """The split of least Gini impurity among the columns that a node tries, and its gain."""
    nothing = np.zeros(len(totals), np.int64), np.full(len(totals), -1.0)
    if not len(splits.feature):
        return nothing
    a, b = splits.left(held[0], totals[:, 0]), splits.left(held[1], totals[:, 1])
    rows = a + b
    enough = (rows >= least) & (rows <= totals.sum(axis=1)[:, None] - least)
    if tried < splits.width:
        keys = rng.random((len(totals), splits.width), np.float32)
        enough &= (keys <= np.partition(keys, tried - 1, axis=1)[:, tried - 1: tried]).take(splits.feature, axis=1)
    a *= weights[0]
    b *= weights[1]
    whole = totals * weights
    both = whole.sum(axis=1)
    left = a + b
    with np.errstate(divide="ignore", invalid="ignore"):
        cost = a * b / left
        a -= whole[:, :1]
        b -= whole[:, 1:]
        left -= both[:, None]
        cost -= a * b / left
    cost[~enough] = np.inf
    best = cost.argmin(axis=1)
    return best, 2 * (whole[:, 0] * whole[:, 1] / both - cost[np.arange(len(totals)), best]) / both


def in_preorder(split: np.ndarray, left: np.ndarray, first: np.ndarray, same: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nodes in preorder (their numbers as grown), whether they are inner, and sizes of their subtrees. Sibling leaves
    of the same ``same`` become one, as in Spark ML."""
    inner, size = split >= 0, np.ones(len(split), np.int64)
    for a, b in reversed(list(zip(first[:-1], first[1:], strict=True))):
        of = np.arange(a, b)[inner[a:b]]
        children = left[of]
        if same is not None and len(of):
            one = ~inner[children] & ~inner[children + 1] & (same[children] == same[children + 1])
            inner[of[one]] = False
            of, children = of[~one], children[~one]
        size[of] = 1 + size[children] + size[children + 1]
    place = np.full(len(split), -1, np.int64)
    place[0] = 0
    for a, b in zip(first[:-1], first[1:], strict=True):
        of = np.arange(a, b)[inner[a:b] & (place[a:b] >= 0)]
        place[left[of]] = place[of] + 1
        place[left[of] + 1] = place[of] + 1 + size[left[of]]
    kept = np.flatnonzero(place >= 0)
    return kept[np.argsort(place[kept])], inner, size


def node_batch(tree: int, made: dict[str, np.ndarray], splits: Splits, class_weights) -> pa.RecordBatch:
    """A tree as Spark ML stores it, with its importances in the first row."""
    stats = made["facts"] * np.asarray(class_weights)
    says = (stats[:, 1] > stats[:, 0]).astype(float)
    order, inner, size = in_preorder(made["split"], made["left"], made["first"], says)
    weight = stats[order].sum(axis=1)
    return stored(tree, order, inner[order], size, made, splits, says[order], 2 * stats[order, 0] * stats[order, 1] / np.maximum(weight, 1e-300) ** 2, stats[order], weight, made["facts"][order].sum(axis=1))


def stored(tree, order, inner, size, made, splits: Splits, prediction, impurity, stats, weight, rows) -> pa.RecordBatch:
    n, split = len(order), np.where(inner, made["split"][order], 0)
    gain = np.where(inner, made["gain"][order], -1.0)
    ids = np.arange(n)
    right = np.where(inner, ids + 1 + size[made["left"][order]], -1)
    few = lambda values, each: pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(each)]), pa.int32()), pa.array(values, pa.float64()))
    cut = pa.StructArray.from_arrays([
        pa.array(np.where(inner, splits.feature[split] if len(splits.feature) else -1, -1), pa.int32()),
        few(splits.threshold[split[inner]], inner), pa.array(np.full(n, -1), pa.int32())], names=["featureIndex", "leftCategoriesOrThreshold", "numCategories"])
    data = pa.StructArray.from_arrays([
        pa.array(ids, pa.int32()), pa.array(prediction, pa.float64()), pa.array(impurity, pa.float64()), few(stats.ravel(), np.full(n, stats.shape[1])),
        pa.array(rows.astype(np.int64), pa.int64()), pa.array(gain, pa.float64()), pa.array(np.where(inner, ids + 1, -1), pa.int32()),
        pa.array(right, pa.int32()), cut,
    ], names=["id", "prediction", "impurity", "impurityStats", "rawCount", "gain", "leftChild", "rightChild", "split"])
    shares = np.bincount(splits.feature[split[inner]], weights=(gain * weight)[inner], minlength=splits.width) if inner.any() else np.zeros(splits.width)
    shares = shares / shares.sum() if shares.sum() > 0 else shares
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(n, tree), pa.int32()), data, pa.array([shares.tolist(), *[None] * (n - 1)], pa.list_(pa.float64()))], names=["treeID", "nodeData", "importances"])


def grown_forest(encoded: DataFrame, label: str, codes: Codes, trees: int, depth: int, least: int, tried: int, seed: int) -> DataFrame:
    """The nodes of all trees. A tree depends on the seed, its number and the rows' order in ``encoded`` only."""
    tasks = min(trees, encoded.sparkSession.sparkContext.defaultParallelism)

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bundle, label_of, cell = gathered(batches, codes)
        splits = Splits(codes)
        for tree in range(bundle, trees, tasks) if bundle >= 0 else ():
            made = grow_tree(label_of, cell, splits, codes.class_weights, np.random.default_rng([seed, tree]), depth, least, tried)
            yield node_batch(tree, made, splits, codes.class_weights)

    each = blocks(encoded, label, codes).withColumn("bundle", F.explode(F.sequence(F.lit(0), F.lit(tasks - 1))))
    return each.repartitionById(tasks, F.col("bundle")).mapInArrow(grow, GROWN)


# --- boosting: one tree after the other, so all of a model is one task's work -------------------------------
def boosted_trees(label, cell, splits: Splits, rounds: int, step: float, depth: int, least: int) -> Iterator[dict[str, np.ndarray]]:
    """Trees of a boosting of logistic loss, as Spark ML's: the first fits the labels -1 and 1, the others what the loss
    asks for at the sum so far. A node's facts are its rows, their sum and their sum of squares."""
    sign = label * 2.0 - 1.0
    said, all_rows, asked = np.zeros(len(label)), np.arange(len(label)), sign
    for tree in range(rounds):
        if tree:
            asked = 4 * sign / (1 + np.exp(2 * sign * said))

        def facts(row, sizes, asked=asked):
            values, begins = asked.take(row), np.cumsum(sizes) - sizes
            return np.stack([sizes, np.add.reduceat(values, begins), np.add.reduceat(values * values, begins)], axis=1)

        def choose(row, at, known, asked=asked):
            return least_squares(splits, *counted_and_summed(row, at, cell, splits, len(known), asked), known, least)

        ended = []
        made = grow_levels(all_rows, cell, splits, depth, facts, lambda known: known[:, 0] >= 2 * least, choose, ended)
        mean = made["facts"][:, 1] / made["facts"][:, 0]
        for row, leaf in ended:
            said[row] += (step if tree else 1.0) * mean.take(leaf)
        yield made


def counted_and_summed(row, at, cell, splits: Splits, nodes: int, value) -> tuple[np.ndarray, np.ndarray]:
    """Rows and sums of values per node and cell."""
    size, each = nodes * splits.cells, cell.shape[1]
    rows, sums = np.zeros(size), np.zeros(size)
    for x in range(0, len(row), ROWS_AT_ONCE):
        r = row[x: x + ROWS_AT_ONCE]
        key = (cell.take(r, axis=0) + (at[x: x + ROWS_AT_ONCE] * splits.cells)[:, None]).ravel()
        rows += np.bincount(key, minlength=size)
        sums += np.bincount(key, np.repeat(value.take(r), each), size)
    return rows.reshape(nodes, -1), sums.reshape(nodes, -1)


def least_squares(splits: Splits, rows, sums, known, least: int) -> tuple[np.ndarray, np.ndarray]:
    """The split that leaves the least variance, and its gain."""
    if not len(splits.feature):
        return np.zeros(len(known), np.int64), np.full(len(known), -1.0)
    n, total = known[:, :1], known[:, 1:2]
    left, of_left = splits.left(rows, known[:, 0]), splits.left(sums, known[:, 1])
    with np.errstate(divide="ignore", invalid="ignore"):
        worth = of_left**2 / left + (total - of_left) ** 2 / (n - left)
    worth[(left < least) | (left > n - least)] = -np.inf
    best = worth.argmax(axis=1)
    return best, (worth[np.arange(len(known)), best] - total[:, 0] ** 2 / n[:, 0]) / n[:, 0]


def boosted(encoded: DataFrame, label: str, codes: Codes, rounds: int, step: float, depth: int, least: int) -> DataFrame:
    """The nodes of all trees of a boosting, from one task."""

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bundle, label_of, cell = gathered(batches, codes)
        if bundle < 0:
            return
        splits = Splits(codes)
        for tree, made in enumerate(boosted_trees(label_of, cell, splits, rounds, step, depth, least)):
            known = made["facts"]
            mean = known[:, 1] / known[:, 0]
            order, inner, size = in_preorder(made["split"], made["left"], made["first"], mean)
            variance = np.maximum(known[:, 2] / known[:, 0] - mean**2, 0.0)
            yield stored(tree, order, inner[order], size, made, splits, mean[order], variance[order], known[order], known[order, 0], known[order, 0])

    return blocks(encoded, label, codes).withColumn("bundle", F.lit(0)).repartitionById(1, F.col("bundle")).mapInArrow(grow, GROWN)
