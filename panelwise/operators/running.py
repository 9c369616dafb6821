"""Exact running totals over ordered distinct values, split into slices.

A running total over one group would put the whole group into one task. Here
the group is cut into slices of neighbouring values, the slices' totals are
summed first, and every slice is finished on its own with its starting offset.
The cut points are chosen by the values' hashes: an even sample that is the
same however often and in whatever order the rows are read.
"""

from dataclasses import dataclass
from functools import reduce
from math import isqrt

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from panelwise.frames import materialize, null_safe_join, per_group

MIN_SLICES = 64


def slice_count(df: DataFrame, slices: int | None) -> int:
    """As many slices as the session shuffles into, unless a number is asked for."""
    return slices or max(MIN_SLICES, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def cut_points(counts: DataFrame, by: list[str], order: str, slices: int) -> DataFrame:
    """About ``slices`` sorted cut values per group, and every so many of them as a coarse list.

    In each of ``slices`` hash classes the value with the smallest hash is taken: a plain partial and
    final aggregate.
    """
    hashed = counts.select(*by, order, F.xxhash64(F.col(order)).alias("_hash"))
    picked = hashed.groupBy(*by, F.pmod("_hash", F.lit(slices)).alias("_class")).agg(F.min_by(order, "_hash").alias("_cut"))
    cuts = picked.groupBy(*by).agg(F.array_sort(F.collect_list("_cut")).alias("_cuts"))
    return cuts.withColumn("_coarse", F.expr(f"filter(_cuts, (cut, i) -> (i + 1) % {isqrt(slices)} = 0)"))


def slice_index(order: str, slices: int):
    """Number of cuts below the value, looked up in the coarse list and then in one stretch of the fine one."""
    stride = isqrt(slices)
    coarse = f"size(filter(_coarse, cut -> cut < `{order}`)) * {stride}"
    return F.expr(f"{coarse} + size(filter(slice(_cuts, {coarse} + 1, {stride}), cut -> cut < `{order}`))")


def running_totals(
    counts: DataFrame, by: list[str], order: str, measures: list[str], ascending: bool = True,
    slices: int | None = None, counted: list[str] = (), groups: int | None = None,
) -> DataFrame:
    """Add ``<m>_before``, the measure's sum over the group's earlier rows, and ``<m>_all``, over all its rows.

    ``counts`` holds one row per group and value of ``order``; the measures are counts, never
    negative. It is read for the cut points, the slice totals and the rows themselves: a filter
    on all ``counted`` columns, true for every row, keeps the three readings the same table, so
    that it is computed and shuffled once. ``groups`` is an upper bound on the number of groups,
    if one is known.
    """
    keys = by or ["_all"]
    groups, slices = groups if by else 1, slice_count(counts, slices)
    shared = list(counted) or measures
    counts = counts.where(reduce(lambda a, b: a & b, [F.col(m) >= 0 for m in shared]))
    counts = counts.withColumns({} if by else {"_all": F.lit(1)})
    sliced = null_safe_join(counts, per_group(cut_points(counts, keys, order, slices), groups, slices), keys).withColumn(
        "_slice", slice_index(order, slices)
    )
    sliced = sliced.drop("_cuts", "_coarse")
    turn = (lambda c: F.col(c).asc()) if ascending else (lambda c: F.col(c).desc())
    before = lambda keys, order, m: F.coalesce(
        F.sum(m).over(W.partitionBy(*keys).orderBy(turn(order)).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)
    )
    totals = sliced.groupBy(*keys, "_slice").agg(*[F.sum(m).alias(m) for m in measures])
    offsets = totals.select(
        *keys, "_slice",
        *[before(keys, "_slice", m).alias(f"_{m}_offset") for m in measures],
        *[F.sum(m).over(W.partitionBy(*keys)).alias(f"{m}_all") for m in measures],
    )
    joined = null_safe_join(sliced, per_group(offsets, groups, slices), keys + ["_slice"])
    return joined.select(
        *[c for c in counts.columns if by or c != "_all"],
        *[(F.col(f"_{m}_offset") + before(keys + ["_slice"], order, m)).alias(f"{m}_before") for m in measures],
        *[f"{m}_all" for m in measures],
    )


def row_numbers(
    df: DataFrame, by: list[str], order: str, name: str = "row_number", slices: int | None = None, groups: int | None = None
) -> DataFrame:
    """Row number from 1 within each group by a key that is unique in the group."""
    numbered = running_totals(df.withColumn("_one", F.lit(1).cast("long")), by, order, ["_one"], slices=slices, groups=groups)
    return numbered.withColumn(name, F.col("_one_before") + 1).drop("_one", "_one_before", "_one_all")


@dataclass(frozen=True)
class Key:
    """One part of an order: an expression, which may be collated, its direction, and where missing values go."""

    value: Column | str
    ascending: bool = True
    nulls_last: bool = False

    def columns(self, i: int) -> dict[str, Column]:
        value = F.col(self.value) if isinstance(self.value, str) else self.value
        return {f"_null{i}": value.isNull().cast("int") if self.nulls_last else value.isNotNull().cast("int"), f"_key{i}": value}

    def order(self, i: int) -> list[Column]:
        return [F.col(f"_null{i}").asc(), F.col(f"_key{i}").asc() if self.ascending else F.col(f"_key{i}").desc()]

    def before(self, i: int, a: str, b: str) -> tuple[str, str]:
        """SQL for "a comes before b" and "a equals b" in this part."""
        sign = "<" if self.ascending else ">"
        value = f"coalesce({a}_key{i} {sign} {b}_key{i}, false)"
        return (f"({a}_null{i} < {b}_null{i} OR ({a}_null{i} = {b}_null{i} AND {value}))",
                f"({a}_null{i} = {b}_null{i} AND {a}_key{i} <=> {b}_key{i})")


def comes_before(keys: list[Key], a: str, b: str) -> str:
    """SQL for "a comes before b" in the whole order, a and b being prefixes of the parts' names."""
    text = "false"
    for i, key in reversed(list(enumerate(keys))):
        before, equal = key.before(i, a, b)
        text = f"({before} OR ({equal} AND {text}))"
    return text


def positions(
    df: DataFrame, keys: list[Key], by: list[str] = (), name: str = "position", slices: int | None = None, groups: int | None = None
) -> DataFrame:
    """Number the rows from 1 in an order of several parts with directions and collations, per group or in all.

    As for running totals, the order is cut into slices at values chosen by hash, and every slice is
    numbered on its own with its offset, so that no task sees a whole group. The last part should tell rows apart;
    rows that are equal in all parts are numbered in any order.
    """
    group = list(by) or ["_all"]
    groups, slices = groups if by else 1, slice_count(df, slices)
    parts = {n: c for i, key in enumerate(keys) for n, c in key.columns(i).items()}
    rows = materialize(df.withColumns({**parts, **({} if by else {"_all": F.lit(1)})}))  # read for cuts, counts and numbers
    hashed = rows.select(*group, F.struct(*parts).alias("_cut"), F.xxhash64(*[F.col(f"_key{i}") for i in range(len(keys))]).alias("_hash"))
    picked = hashed.groupBy(*group, F.pmod("_hash", F.lit(slices)).alias("_class")).agg(F.min_by("_cut", "_hash").alias("_cut"))
    listed = picked.groupBy(*group).agg(F.collect_list("_cut").alias("_cuts"))
    ordered = f"array_sort(_cuts, (a, b) -> CASE WHEN {comes_before(keys, 'a.', 'b.')} THEN -1 WHEN {comes_before(keys, 'b.', 'a.')} THEN 1 ELSE 0 END)"
    # As in ``slice_index``: a coarse list first, then one stretch of the fine one, not every cut for every row.
    stride = isqrt(slices)
    cuts = listed.withColumn("_cuts", F.expr(ordered)).withColumn("_coarse", F.expr(f"filter(_cuts, (cut, i) -> (i + 1) % {stride} = 0)"))
    earlier_cut = f"cut -> {comes_before(keys, 'cut.', '')}"
    sliced = null_safe_join(rows, per_group(cuts, groups, slices), group)
    sliced = sliced.withColumn("_slice", F.expr(f"size(filter(_coarse, {earlier_cut})) * {stride}"))
    within_stretch = F.expr(f"size(filter(slice(_cuts, _slice + 1, {stride}), {earlier_cut}))")
    sliced = sliced.withColumn("_slice", F.col("_slice") + within_stretch).drop("_cuts", "_coarse")
    counts = sliced.groupBy(*group, "_slice").agg(F.count("*").alias("_n"))
    earlier = F.sum("_n").over(W.partitionBy(*group).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1))
    offsets = counts.select(*group, "_slice", F.coalesce(earlier, F.lit(0)).alias("_offset"))
    joined = null_safe_join(sliced, per_group(offsets, groups, slices), [*group, "_slice"])
    within = F.row_number().over(W.partitionBy(*group, "_slice").orderBy(*[c for i, key in enumerate(keys) for c in key.order(i)]))
    return joined.select(*df.columns, (F.col("_offset") + within).alias(name))


def exact_quantiles(
    counts: DataFrame, by: list[str], value: str, n: str, bins: int = 10, float_quantiles: bool = False,
    slices: int | None = None, counted: list[str] = (), groups: int | None = None,
) -> DataFrame:
    """Quantiles ``0, 1/bins .. 1`` per group with linear interpolation, as an array ``edges``.

    ``counts`` holds one row per group and distinct value, with its number of rows ``n``. The
    position of a quantile is exact integer arithmetic; ``float_quantiles`` takes the binary
    fractions of an evenly spaced float grid instead.
    """
    keys = by or ["_all"]
    groups = groups if by else 1
    counts = counts.where(F.col(value).isNotNull()).withColumns({} if by else {"_all": F.lit(1)})
    ranked = running_totals(counts, keys, value, [n], slices=slices, counted=counted, groups=groups).select(
        *keys, F.col(value).alias("v"), F.col(f"{n}_before").alias("first"),
        (F.col(f"{n}_before") + F.col(n)).alias("after"), F.col(f"{n}_all").alias("rows"),
    )
    if float_quantiles:
        position = f"(rows - 1) * if(i = {bins}, 1D, i * {1.0 / bins!r}D)"
        low, part = f"cast(floor({position}) as bigint)", f"({position} - floor({position}))"
    else:
        low = f"((rows - 1) * i div {bins})"
        part = f"(((rows - 1) * i) % {bins} / {float(bins)}D)"
    grid = f"sequence(0L, {bins}L)"
    # Only rows at the wanted ranks or right after them: two per quantile at most.
    wanted = ranked.where(F.expr(f"after > first AND exists({grid}, i -> {low} < after AND least({low} + 1, rows - 1) >= first)"))
    points = wanted.groupBy(*keys).agg(
        F.collect_list(F.struct("first", "after", "v")).alias("points"), F.max("rows").alias("rows")
    )
    at = lambda rank: f"filter(points, p -> p.first <= {rank} AND {rank} < p.after)[0].v"
    lo, hi = at(low), at(f"least({low} + 1, rows - 1)")
    edge = f"if({part} < 0.5D, {lo} + ({hi} - {lo}) * {part}, {hi} - ({hi} - {lo}) * (1 - {part}))"
    return points.select(*by, F.expr(f"transform({grid}, i -> {edge})").alias("edges"))
