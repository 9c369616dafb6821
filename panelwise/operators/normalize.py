"""From a raw layout table to the canonical panel table."""

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from panelwise import fixed
from panelwise.frames import null_safe_join, per_group
from panelwise.functions.text import ascii_label, infer_period, null_tokens, parse_bool, parse_number


class NormalizationError(ValueError):
    """The file cannot be mapped to the canonical table."""


@dataclass(frozen=True)
class Header:
    """How the columns of a file map, by position."""

    layout: str
    fallback_period: int
    names: tuple[str, ...]
    renamed: dict[str, str] = field(default_factory=dict, hash=False)
    unknown: tuple[str, ...] = ()


def detect_layout(labels, layouts=fixed.LAYOUTS):
    """The layout whose signature overlaps most with the folded labels; the earlier one on ties."""
    present = set(labels)
    scores = [len(present & set(signature)) for _, _, signature in layouts]
    best = max(range(len(layouts)), key=lambda i: (scores[i], -i))
    return layouts[best] if scores[best] else None


def header_overlap(labels: Column, signature) -> Column:
    return F.array_intersect(labels, F.array(*[F.lit(s) for s in signature]))


def missing_required(labels: Column, required=fixed.REQUIRED_COLUMNS) -> Column:
    return F.array_except(F.array(*[F.lit(r) for r in required]), labels)


def unknown_labels(labels: Column, aliases=fixed.ALIASES) -> Column:
    return F.array_except(labels, F.array(*[F.lit(a) for a in aliases]))


def layout_column(labels: Column, layouts) -> tuple[Column, Column]:
    """Layout name and score for a column of label arrays; null where no signature overlaps."""
    scores = [F.size(header_overlap(labels, signature)) for _, _, signature in layouts]
    best = F.greatest(*scores) if len(scores) > 1 else scores[0]
    name = F.lit(None).cast("string")
    for (layout, _, _), score in reversed(list(zip(layouts, scores))):
        name = F.when((score == best) & (score > 0), F.lit(layout)).otherwise(name)
    return name, best


def resolve_header(header, layouts=fixed.LAYOUTS, aliases=fixed.ALIASES, required=fixed.REQUIRED_COLUMNS) -> Header:
    """Map header labels to canonical names by position. Unknown labels keep their folded name."""
    folded = [ascii_label(label) for label in header]
    layout = detect_layout(folded, layouts)
    if layout is None:
        raise NormalizationError(f"no known layout matches the header {list(header)}")
    names = tuple(aliases.get(label, label) for label in folded)
    missing = sorted(set(required) - set(names))
    if missing:
        raise NormalizationError(f"layout {layout[0]} recognised, but required columns are missing: {missing}")
    known = [label in aliases for label in folded]
    return Header(
        layout=layout[0],
        fallback_period=layout[1],
        names=names,
        renamed={raw: name for raw, name, ok in zip(header, names, known) if ok},
        unknown=tuple(raw for raw, ok in zip(header, known) if not ok),
    )


def dedupe_columns(df: DataFrame, names) -> DataFrame:
    """Name columns by position; of repeated names the first column stays."""
    first = {}
    for position, name in enumerate(names):
        first.setdefault(name, position)
    placed = df.toDF(*[f"_p{position}" for position in range(len(df.columns))])
    extra = df.columns[len(names):]
    return placed.select(
        *[F.col(f"_p{position}").alias(name) for name, position in first.items()],
        *[F.col(f"_p{len(names) + i}").alias(name) for i, name in enumerate(extra)],
    )


def rename_by_alias(df: DataFrame, aliases: dict[str, str]) -> DataFrame:
    """Columns under their canonical names; the first of several with the same target stays."""
    folded = [ascii_label(c) for c in df.columns]
    return dedupe_columns(df, [aliases.get(label, label) for label in folded])


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Exactly the columns of the schema, in order; absent ones are null."""
    return df.select(*[
        (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema
    ])


def typed(df: DataFrame, schema: T.StructType = fixed.CANONICAL) -> DataFrame:
    """Text columns parsed to the schema's types: decimal-comma numbers and word booleans."""
    parsers = {T.DoubleType(): parse_number, T.BooleanType(): parse_bool}
    text = {f.name for f in df.schema if isinstance(f.dataType, T.StringType)}
    return df.withColumns({
        f.name: parsers[f.dataType](f.name) for f in schema if f.name in text and f.dataType in parsers
    })


def fallback_if_all_null(
    df: DataFrame, target: str, source: str, by: list[str], when: Column | None = None, groups: int | None = None
) -> DataFrame:
    """Fill ``target`` from ``source`` in every group where ``target`` has no value at all.

    The group fact is aggregated and joined back, so a large file is not pulled into one task;
    ``groups`` is a known bound on the number of groups.
    """
    applies = F.lit(True) if when is None else when
    empty = df.groupBy(*by).agg((F.count(target) == 0).alias("_empty"))
    joined = null_safe_join(df, per_group(empty, groups), by, "left")
    filled = F.when(F.col("_empty") & applies, F.col(source)).otherwise(F.col(target))
    return joined.withColumn(target, filled).drop("_empty")


def stamp(df: DataFrame, layout: str, fallback_period: int, period: int | None, file_name: str, row_number: str) -> DataFrame:
    """Provenance: the period replaces any period column of the file."""
    return df.withColumns({
        "ano_referencia": infer_period(period, file_name, fallback_period),
        "source_schema": F.lit(layout),
        "source_file": F.col(file_name),
        "source_row_number": F.col(row_number).cast("long"),
    })


def normalize(
    raw: DataFrame, header: Header, file_name: str, row_number: str, period: int | None = None,
    fallbacks=fixed.WHOLE_FILE_FALLBACK, schema: T.StructType = fixed.CANONICAL, files: int | None = None,
    years: set[int] | None = None,
) -> DataFrame:
    """Canonical rows of files that share a header. ``raw`` is all text in file order plus the two named columns.

    ``files`` is their number and ``years`` their periods, where known: fallbacks of other years are left out.
    """
    named = dedupe_columns(raw, header.names)
    named = named.withColumns({c: null_tokens(c) for c in set(header.names)})
    rows = typed(stamp(named, header.layout, header.fallback_period, period, file_name, row_number), schema)
    for year, (target, source) in fallbacks.items():
        if source not in rows.columns or (years is not None and year not in years):
            continue
        if target not in rows.columns:
            rows = rows.withColumn(target, F.when(F.col("ano_referencia") == year, F.col(source)))
        else:
            rows = fallback_if_all_null(rows, target, source, ["source_file"], F.col("ano_referencia") == year, files)
    return conform(rows, schema)


def period_of(file_name: str, layout_fallback: int, period: int | None = None) -> int:
    """The period a file gets, known on the driver from its name alone."""
    found = re.search(r"20\d{2}", file_name)
    return period or (int(found.group()) if found else layout_fallback)


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)
