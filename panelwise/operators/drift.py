"""Drift between a reference and a current frame, all features at once in long form.

Both sides are reduced to one table of distinct values per feature with their
two counts; every measure is computed from that table, so the data is shuffled once. Tables
with one row per feature are broadcast: features are columns of a frame. A reference that many batches
are compared with can be kept as a profile instead: quantile sketches, sums and category counts, which
can be merged and are all that a report needs of it.
"""

from pyspark.sql import Column, DataFrame, functions as F

from panelwise import fixed
from panelwise.frames import materialize, null_safe_join, unpivot
from panelwise.functions.text import category
from panelwise.operators.running import exact_quantiles

BINS = 10


def value_rows(reference: DataFrame, current: DataFrame, columns: list[str], kind: str) -> DataFrame:
    """Feature, value, and ``r`` or ``c`` as 1 for the side of the row. Missing numbers are left out, missing text counts."""

    def long(df: DataFrame, side: str) -> DataFrame:
        present = df.select(*[F.col(c) if c in df.columns else F.lit(None).alias(c) for c in columns])
        rows = unpivot(present, [], columns, kind)
        if kind == "double":
            rows = rows.where(F.col("value").isNotNull() & ~F.isnan("value"))
        else:
            rows = rows.withColumn("value", category("value"))
        return rows.withColumns({s: F.lit(int(s == side)).cast("long") for s in ("r", "c")})

    return long(reference, "r").unionByName(long(current, "c"))


def mixed_counts(reference: DataFrame, current: DataFrame, numbers: list[str], text: list[str]) -> tuple[DataFrame, DataFrame]:
    """The distinct values of numbers and of text with their counts, from one reading of each side and one shuffle."""

    def long(df: DataFrame, side: str) -> DataFrame:
        has = lambda c: F.col(c) if c in df.columns else F.lit(None)
        number = lambda c: F.when(~F.isnan(has(c).cast("double")), has(c).cast("double"))
        cell = lambda c, n, t: F.struct(F.lit(c).alias("feature"), n.cast("double").alias("number"), t.cast("string").alias("text"))
        cells = [cell(c, number(c), F.lit(None)) for c in numbers] + [cell(c, F.lit(None), category(has(c))) for c in text]
        rows = df.select(F.inline(F.array(*cells))).where(F.col("number").isNotNull() | F.col("text").isNotNull())
        return rows.withColumns({s: F.lit(int(s == side)).cast("long") for s in ("r", "c")})

    rows = long(reference, "r").unionByName(long(current, "c"))
    counts = materialize(rows.groupBy("feature", "number", "text").agg(F.sum("r").alias("r"), F.sum("c").alias("c")))
    pick = lambda c: counts.where(F.col(c).isNotNull()).select("feature", F.col(c).alias("value"), "r", "c")
    return pick("number"), pick("text")


def value_counts(reference: DataFrame, current: DataFrame, columns: list[str], kind: str) -> DataFrame:
    """Feature, value, reference rows ``r``, current rows ``c``."""
    return value_rows(reference, current, columns, kind).groupBy("feature", "value").agg(F.sum("r").alias("r"), F.sum("c").alias("c"))


def quantile_edges(
    counts: DataFrame, bins: int = BINS, float_quantiles: bool = False, slices: int | None = None, features: int | None = None
) -> DataFrame:
    """Distinct quantile edges of the reference side per feature."""
    edges = exact_quantiles(counts, ["feature"], "value", "r", bins, float_quantiles, slices, counted=["r", "c"], groups=features)
    return edges.select("feature", F.array_distinct("edges").alias("edges"))


def approximate_edges(reference: DataFrame, columns: list[str], bins: int = BINS, accuracy: int = 10_000) -> DataFrame:
    """Edges from quantile sketches: one pass, no shuffle of values."""
    points = [i / bins for i in range(bins + 1)]
    number = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))
    sketches = reference.agg(*[F.percentile_approx(number(c), points, accuracy).alias(c) for c in columns])
    rows = sketches.unpivot([], columns, "feature", "edges").where(F.col("edges").isNotNull())
    return rows.select("feature", F.array_distinct("edges").alias("edges"))


def bin_index(value: str = "value", edges: str = "edges") -> Column:
    """Half-open bins from 0, the last one closed; null outside the edges."""
    at = f"size(filter({edges}, edge -> edge <= {value})) - 1"
    return F.expr(f"if({value} between {edges}[0] and element_at({edges}, -1), least({at}, size({edges}) - 2), null)")


def with_bins(counts: DataFrame, edges: DataFrame) -> DataFrame:
    return null_safe_join(counts, F.broadcast(edges), ["feature"], "left").withColumn("bin", bin_index())


def histogram(counts: DataFrame, edges: DataFrame) -> DataFrame:
    """Rows per feature and bin on both sides; values outside the edges are dropped."""
    return with_bins(counts, edges).where(F.col("bin").isNotNull()).groupBy("feature", "bin").agg(
        F.sum("r").alias("r"), F.sum("c").alias("c")
    )


def numeric_facts(counts: DataFrame, edges: DataFrame, bins: int = BINS) -> DataFrame:
    """Means, rows and PSI per feature in one aggregate over the distinct values.

    The index is zero with an empty side or fewer than three edges. A mean without values is 0.
    """
    binned = lambda side, i: f"coalesce(sum({side}) filter (where bin = {i}), 0)"
    table = lambda side: F.expr(f"array({', '.join(binned(side, i) for i in range(bins))})").alias(f"{side}_bins")
    mean = lambda side: F.expr(f"coalesce(try_divide(sum(value * {side}), sum({side})), 0D)")
    found = with_bins(counts, edges).groupBy("feature").agg(
        mean("r").alias("reference_mean"), mean("c").alias("current_mean"), F.sum("r").alias("r_rows"),
        F.sum("c").alias("c_rows"), F.expr("coalesce(max(size(edges)), 0)").alias("n_edges"), table("r"), table("c"),
    )
    total = lambda side: f"greatest(aggregate({side}_bins, 0L, (a, b) -> a + b), 1L)"
    share = lambda side: f"transform({side}_bins, n -> greatest(n / {total(side)}, {fixed.SHARE_FLOOR!r}D))"
    # Bins that do not exist are empty on both sides and add nothing.
    index = f"aggregate(zip_with({share('r')}, {share('c')}, (r, c) -> (c - r) * ln(c / r)), 0D, (a, b) -> a + b)"
    return found.withColumn("psi", F.expr(f"if(r_rows > 0 and c_rows > 0 and n_edges >= 3, {index}, 0D)"))


def psi(counts: DataFrame, edges: DataFrame, bins: int = BINS) -> DataFrame:
    """Population stability index per feature."""
    return numeric_facts(counts, edges, bins).select("feature", "psi")


def feature_frame(spark, columns: list[str]) -> DataFrame:
    """One row per feature asked for, in order."""
    names = F.array(*[F.lit(c) for c in columns])
    return spark.range(1).select(F.posexplode(names).alias("position", "feature"))


def numeric_rows(spark, columns: list[str], facts: DataFrame) -> DataFrame:
    """Report rows of numeric features from their means and indices; a feature without values has zeros."""
    rows = null_safe_join(feature_frame(spark, columns), F.broadcast(facts), ["feature"], "left").fillna(
        0.0, ["reference_mean", "current_mean", "psi"]
    )
    shift = F.abs(F.col("current_mean") - F.col("reference_mean"))
    limit = F.greatest(F.abs("reference_mean") * fixed.MEAN_SHIFT_SHARE, F.lit(fixed.MEAN_SHIFT_FLOOR))
    return rows.select(
        "position", "feature", F.lit("numeric").alias("type"), "reference_mean", "current_mean", "psi",
        ((F.col("psi") >= fixed.PSI_ALERT) | (shift >= limit)).alias("alert"),
    )


def numeric_drift(
    reference: DataFrame, current: DataFrame, columns: list[str], bins: int = BINS, approx: bool = False,
    float_quantiles: bool = False, slices: int | None = None, counts: DataFrame | None = None,
) -> DataFrame:
    """Means, PSI and alert per numeric feature. A side without values has mean 0. Counts made before may be given."""
    if approx:  # rows are binned as they come: nothing but a few numbers per feature is shuffled
        counts, edges = value_rows(reference, current, columns, "double"), approximate_edges(reference, columns, bins)
    else:
        counts = value_counts(reference, current, columns, "double") if counts is None else counts
        edges = quantile_edges(counts, bins, float_quantiles, slices, len(columns))
    facts = numeric_facts(counts, edges, bins).select("feature", "reference_mean", "current_mean", "psi")
    return numeric_rows(reference.sparkSession, columns, facts)


def categorical_drift(
    reference: DataFrame, current: DataFrame, columns: list[str], counts: DataFrame | None = None
) -> DataFrame:
    """Most frequent value of each side, total variation, share of unseen categories and alert per feature."""
    counts = value_counts(reference, current, columns, "string") if counts is None else counts
    return categorical_rows(reference.sparkSession, columns, counts)


def categorical_rows(spark, columns: list[str], counts: DataFrame) -> DataFrame:
    """Report rows of categorical features from the counts of their values."""
    totals = counts.groupBy("feature").agg(F.sum("r").alias("r_all"), F.sum("c").alias("c_all"))
    share = lambda n, total: F.coalesce(F.try_divide(F.col(n), F.col(total)), F.lit(0.0))
    joined = null_safe_join(counts, F.broadcast(totals), ["feature"])
    # The smallest value wins among equally frequent ones.
    top = lambda n: F.min(F.when(F.col(n) > 0, F.struct((-F.col(n)).alias("n"), F.col("value"))))["value"]
    measured = joined.groupBy("feature").agg(
        F.coalesce(top("r"), F.lit(fixed.MISSING_CATEGORY)).alias("reference_top"),
        F.coalesce(top("c"), F.lit(fixed.MISSING_CATEGORY)).alias("current_top"),
        (F.sum(F.abs(share("r", "r_all") - share("c", "c_all"))) / 2).alias("distribution_shift"),
        (F.sum(F.when(F.col("r") == 0, F.col("c")).otherwise(0)) / F.greatest(F.first("c_all"), F.lit(1))).alias(
            "new_category_rate"
        ),
    )
    rows = null_safe_join(feature_frame(spark, columns), F.broadcast(measured), ["feature"], "left")
    rows = rows.fillna(0.0, ["distribution_shift", "new_category_rate"]).fillna(
        fixed.MISSING_CATEGORY, ["reference_top", "current_top"]
    )
    moved = F.col("distribution_shift") >= fixed.TOTAL_VARIATION_ALERT
    unseen = F.col("new_category_rate") >= fixed.NEW_CATEGORY_ALERT
    return rows.select(
        "position", "feature", F.lit("categorical").alias("type"), "reference_top", "current_top",
        "distribution_shift", "new_category_rate", (moved | unseen).alias("alert"),
    )


# --- references kept as profiles ---------------------------------------------
SKETCH_SIZE = 4_000  # of a quantile sketch; ranks are then off by about a thousandth of the rows at most
PROFILE_POINTS = 1_000  # quantiles that stand for a reference's rows


def profile(df: DataFrame, features: list[str], categorical=fixed.CATEGORICAL_FEATURES, size: int = SKETCH_SIZE) -> DataFrame:
    """What drift needs of a reference: per number its rows, sum and quantile sketch, per category its rows."""
    has = lambda c: F.col(c) if c in df.columns else F.lit(None)
    number = lambda c: F.when(~F.isnan(has(c).cast("double")), has(c).cast("double"))
    text = [f for f in features if f in set(categorical)]
    numbers = [f for f in features if f not in set(categorical)]
    parts = []
    if numbers:
        facts = [F.struct(
            F.lit(c).alias("feature"), F.count(number(c)).alias("n"), F.sum(number(c)).alias("total"),
            F.kll_sketch_agg_double(number(c), F.lit(size)).alias("sketch"),
        ) for c in numbers]
        rows = df.agg(F.array(*facts).alias("facts")).select(F.inline("facts"))
        parts.append(rows.select("feature", F.lit("numeric").alias("type"), F.lit(None).cast("string").alias("value"), "n", "total", "sketch"))
    if text:
        cells = F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), category(has(c)).alias("value")) for c in text]))
        counts = df.select(cells).groupBy("feature", "value").agg(F.count("*").alias("n"))
        parts.append(counts.select("feature", F.lit("categorical").alias("type"), "value", "n", F.lit(None).cast("double").alias("total"), F.lit(None).cast("binary").alias("sketch")))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def merge_profiles(profiles: DataFrame) -> DataFrame:
    """The profile of all rows from those of their parts."""
    numbers, text = (profiles.where(F.col("type") == kind) for kind in ("numeric", "categorical"))
    merged = numbers.groupBy("feature", "type").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.kll_merge_agg_double("sketch").alias("sketch"))
    counted = text.groupBy("feature", "type", "value").agg(F.sum("n").alias("n"))
    return merged.select("feature", "type", F.lit(None).cast("string").alias("value"), "n", "total", "sketch").unionByName(
        counted.select("*", F.lit(None).cast("double").alias("total"), F.lit(None).cast("binary").alias("sketch")))


def profile_edges(kept: DataFrame, bins: int = BINS) -> DataFrame:
    """feature, edges: distinct quantiles from the sketches, each with a rank near the one asked for."""
    points = F.array(*[F.lit(i / bins) for i in range(bins + 1)])
    known = kept.where((F.col("type") == "numeric") & (F.col("n") > 0))
    return known.select("feature", F.array_distinct(F.kll_sketch_get_quantile_double("sketch", points)).alias("edges"))


def profile_counts(kept: DataFrame, points: int = PROFILE_POINTS) -> DataFrame:
    """feature, value, r, c: evenly spaced quantiles from the sketches, each standing for the same share of the rows."""
    known = kept.where((F.col("type") == "numeric") & (F.col("n") > 0))
    grid = F.array(*[F.lit((i + 0.5) / points) for i in range(points)])
    values = known.select("feature", F.explode(F.kll_sketch_get_quantile_double("sketch", grid)).alias("value"))
    return values.select("feature", "value", F.lit(1).cast("long").alias("r"), F.lit(0).cast("long").alias("c"))


def drift_from_profile(
    kept: DataFrame, current: DataFrame, features: list[str], categorical=fixed.CATEGORICAL_FEATURES, bins: int = BINS
) -> DataFrame:
    """The report of a batch against a kept profile: the reference itself is not read."""
    spark = current.sparkSession
    text = [f for f in features if f in set(categorical)]
    numbers = [f for f in features if f not in set(categorical)]
    none = current.limit(0)
    parts = []
    if numbers:
        edges = profile_edges(kept, bins)
        counts = profile_counts(kept).unionByName(value_rows(none, current, numbers, "double").select("feature", "value", "r", "c"))
        means = kept.where("type = 'numeric'").select("feature", F.coalesce(F.try_divide("total", "n"), F.lit(0.0)).alias("reference_mean"))
        facts = numeric_facts(counts, edges, bins).select("feature", "current_mean", "psi").join(means, "feature", "left")
        parts.append(numeric_rows(spark, numbers, facts))
    if text:
        old = kept.where("type = 'categorical'").select("feature", "value", F.col("n").alias("r"), F.lit(0).cast("long").alias("c"))
        both = old.unionByName(value_rows(none, current, text, "string").select("feature", "value", "r", "c"))
        parts.append(categorical_rows(spark, text, both.groupBy("feature", "value").agg(F.sum("r").alias("r"), F.sum("c").alias("c"))))
    return in_order(parts, features)


def all_categories(reference: DataFrame, current: DataFrame, column: str) -> DataFrame:
    """Distinct categories of both frames."""
    pick = lambda df: df.select(category(column).alias("category"))
    return pick(reference).union(pick(current)).distinct()


def in_order(parts: list[DataFrame], features: list[str]) -> DataFrame:
    report = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1], allowMissingColumns=True)
    position = F.create_map(*[F.lit(part) for place in enumerate(features) for part in reversed(place)])
    return report.withColumn("position", F.element_at(position, F.col("feature"))).orderBy("position")


def drift_report(
    reference: DataFrame, current: DataFrame, features: list[str], categorical=fixed.CATEGORICAL_FEATURES, **options
) -> DataFrame:
    """One row per feature, in the order of ``features``. Numbers and text come from one reading of each side."""
    text = [f for f in features if f in set(categorical)]
    numbers = [f for f in features if f not in set(categorical)]
    number_counts = text_counts = None
    if numbers and text and not options.get("approx"):
        number_counts, text_counts = mixed_counts(reference, current, numbers, text)
    parts = []
    if numbers:
        parts.append(numeric_drift(reference, current, numbers, counts=number_counts, **options))
    if text:
        parts.append(categorical_drift(reference, current, text, text_counts))
    return in_order(parts, features)


def drift_summary(report: DataFrame) -> DataFrame:
    return report.agg(F.count("*").alias("feature_rows"), F.count_if("alert").alias("alert_count"))
