"""CSV files of differing layouts, encodings and separators, read as canonical rows."""

import csv
import os
import re
from collections import Counter
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from panelwise import fixed
from panelwise.functions.text import ascii_label
from panelwise.operators.normalize import Header, NormalizationError, normalize, period_of, resolve_header, union_all

SEPARATORS = (",", ";")
# Up to this many file splits, their starting offsets are sent to every task (some 100 bytes each).
BROADCAST_SPLITS = 50_000


@dataclass(frozen=True)
class FileFormat:
    path: str
    name: str
    encoding: str
    separator: str
    multi_line: bool
    header: Header


def list_csv(spark: SparkSession, folder: str) -> list[str]:
    """Paths of the folder's CSV files, empty ones among them, sorted by name; no file is opened."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    found = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).listStatus(path)
    paths = [f.getPath().toString() for f in found if f.isFile() and f.getPath().getName().endswith(".csv")]
    return sorted(paths, key=base_name)


def base_name(path: str) -> str:
    return path.rsplit("/", 1)[-1]


def plain_path(path: str) -> str:
    """One spelling of a path: local files without a scheme, relative ones from the working folder."""
    if "://" not in path and not path.startswith("file:"):
        return os.path.abspath(path)
    return re.sub(r"^file:/+", "/", path)


def decoded(path: Column) -> Column:
    """A path from file metadata, which is escaped as in a URI; a plus sign stands for itself there."""
    return F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))


def _layout_score(labels: list[str], layouts) -> int:
    present = {ascii_label(label) for label in labels}
    return max(len(present & set(signature)) for _, _, signature in layouts)


def split_header(line: str, layouts=fixed.LAYOUTS) -> tuple[str, list[str]]:
    """Separator and labels of a header line: the separator under which a layout fits best."""
    options = [(sep, next(csv.reader([line], delimiter=sep), [])) for sep in SEPARATORS]
    return max(options, key=lambda option: _layout_score(option[1], layouts))


def sniff(spark: SparkSession, paths: list[str], layouts=fixed.LAYOUTS, aliases=fixed.ALIASES) -> list[FileFormat]:
    """Format of each file. Whether the bytes are UTF-8, whether quoted fields span lines and the header
    line are found in one distributed pass over the whole files; one row per file comes to the driver."""
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"')))
    place = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    facts = (
        spark.read.text(paths)
        .select(decoded(F.col("_metadata.file_path")).alias("path"), "value", F.is_valid_utf8("value").alias("utf8"), (quotes % 2).alias("odd"), place.alias("place"))
        .groupBy("path")
        .agg(F.min("utf8").alias("utf8"), F.max("odd").alias("odd"), F.min_by(F.col("value").cast("binary"), "place").alias("line"))
    )
    known = {plain_path(row.path): row for row in facts.collect()}
    formats = []
    for path in paths:
        fact = known.get(plain_path(path))
        if fact is None:
            raise NormalizationError(f"{path} is empty")
        text = bytes(fact.line).decode("utf-8-sig" if fact.utf8 else "latin1")
        separator, labels = split_header(text, layouts)
        header = resolve_header(labels, layouts, aliases)
        formats.append(FileFormat(path, base_name(path), "UTF-8" if fact.utf8 else "ISO-8859-1", separator, bool(fact.odd), header))
    return formats


def with_file_rows(df: DataFrame, splits: int) -> DataFrame:
    """Row number from 1 within each file, from the splits' row counts; no file passes through one task.

    ``df`` has ``_file``, ``_block`` (start of the split) and ``_at`` (increasing within a split).
    """
    starts = df.groupBy("_file", "_block").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    earlier = W.partitionBy("_file").orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    offsets = starts.select("_file", "_block", "_first", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_offset"))
    if splits <= BROADCAST_SPLITS:
        offsets = F.broadcast(offsets)
    joined = df.join(offsets, ["_file", "_block"])
    kept = [c for c in df.columns if c not in ("_block", "_at")]
    return joined.select(*kept, (F.col("_at") - F.col("_first") + F.col("_offset") + 1).alias("_row"))


def read_raw(spark: SparkSession, files: list[FileFormat]) -> DataFrame:
    """Files that share a format as text columns by position, plus ``_file`` and ``_row``; their names differ.

    A row with more fields than the header fails the reading, as it would put values under wrong labels.
    """
    shape = files[0]
    width = len(shape.header.names)
    fields = ", ".join([*(f"_c{i} STRING" for i in range(width)), "_surplus STRING"])
    raw = (
        spark.read.schema(fields)
        .options(header=True, sep=shape.separator, encoding=shape.encoding, quote='"', escape='"')
        .csv([file.path for file in files])
    )
    name = decoded(F.col("_metadata.file_name"))
    too_long = F.raise_error(F.concat(F.lit("a row has more fields than the header of "), name)).cast("boolean")
    placed = raw.where(F.when(F.col("_surplus").isNotNull(), too_long).otherwise(F.lit(True))).select(
        *[f"_c{i}" for i in range(width)],
        name.alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_at"),
    )
    # An upper bound: every file adds at most one split more than its size asks for.
    splits = placed.rdd.getNumPartitions() + len(files)
    return with_file_rows(placed, splits)


# --- files with line breaks inside quotes ----------------------------------------
def open_quote_patterns(separator: str) -> tuple[str, str, str]:
    """Patterns for a line that ends inside a quoted field: begun outside of one; begun inside and never closed;
    begun inside, closed, and opened again. A quote opens a field only where the field begins."""
    sep = re.escape(separator)
    inner = '[^"]*+(?:""[^"]*+)*+'
    opens = f'(?:(?:"{inner}"[^{sep}]*+|[^"{sep}][^{sep}]*+|){sep})*+"{inner}\\z'
    return f"^{opens}", f"^{inner}\\z", f'^{inner}"[^{sep}]*+{sep}{opens}'


def state_before(df: DataFrame, by: list[str], order: str, entry: Column) -> DataFrame:
    """Add ``_before``: whether the state is inside quotes before each row, 1 or 0, given the state before the first.

    A row either leaves the state, or turns it round (``_swap``), or sets it (``_const``). So the state
    follows from the last row that set it and the number of turns since then.
    """
    upto, earlier = (W.partitionBy(*by).orderBy(order).rowsBetween(W.unboundedPreceding, end) for end in (0, -1))
    turned = df.withColumn("_turns", F.sum("_swap").over(upto))
    last = F.max(F.when(F.col("_const").isNotNull(), F.struct(order, "_const", "_turns"))).over(earlier)
    marked = turned.withColumn("_last", last)
    turns = F.col("_turns") - F.col("_swap")
    since = F.col("_last._const") + turns - F.col("_last._turns")
    return marked.withColumn("_before", F.when(F.col("_last").isNotNull(), since).otherwise(entry + turns) % 2)


def read_quoted(spark: SparkSession, files: list[FileFormat]) -> DataFrame:
    """The rows of files whose quoted fields span lines, read in as many tasks as the files have splits.

    Every line is known to keep, turn or set whether one is inside quotes. A split's lines together do one
    of the same, so the state at the start of each split follows from one row per split, and with it
    the lines at which records begin. Lines that are whole records are parsed where they are; only those of
    records of several lines are put together. Line breaks inside quotes become ``\\n``.
    """
    shape = files[0]
    width = len(shape.header.names)
    raw = spark.read.text([file.path for file in files])
    value = F.col("value")
    if shape.encoding != "UTF-8":
        value = F.decode(value.cast("binary"), shape.encoding)
    lines = raw.select(
        decoded(F.col("_metadata.file_name")).alias("_file"), F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_at"), F.ltrim(value, F.lit("\ufeff")).alias("_line"),
    )
    outside, inside, again = (F.col("_line").rlike(p) for p in open_quote_patterns(shape.separator))
    quoted = F.col("_line").contains('"')
    ends = lines.withColumns({
        "_from_out": F.when(quoted, outside.cast("int")).otherwise(0),
        "_from_in": F.when(quoted, (inside | again).cast("int")).otherwise(1),
    })
    same = F.col("_from_out") == F.col("_from_in")
    kinds = ends.withColumns({
        "_const": F.when(same, F.col("_from_out")), "_swap": F.when(~same, F.col("_from_out")).otherwise(0),
    })
    # The state within a split as if it began outside; it is the other one wherever no line has set it.
    local = state_before(kinds, ["_file", "_block"], "_at", F.lit(0))
    free = F.col("_last").isNull()
    begins = lambda entry: ((F.when(free, F.col("_before") + entry).otherwise(F.col("_before")) % 2 == 0) & (F.col("_line") != "")).cast("long")
    splits = local.groupBy("_file", "_block").agg(
        F.sum("_swap").alias("_all"), F.max(F.when(F.col("_const").isNotNull(), F.struct("_at", "_const", "_turns"))).alias("_set"),
        F.sum(begins(0)).alias("_n0"), F.sum(begins(1)).alias("_n1"),
    )
    after = (F.col("_set._const") + F.col("_all") - F.col("_set._turns")) % 2
    known = state_before(
        splits.select("_file", "_block", "_n0", "_n1", F.when(F.col("_set").isNotNull(), after).alias("_const"),
                      F.when(F.col("_set").isNull(), F.col("_all") % 2).otherwise(0).alias("_swap")),
        ["_file"], "_block", F.lit(0),
    )
    earlier = W.partitionBy("_file").orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    records = F.when(F.col("_before") == 0, F.col("_n0")).otherwise(F.col("_n1"))
    entries = known.select("_file", "_block", F.col("_before").alias("_entry"), F.coalesce(F.sum(records).over(earlier), F.lit(0)).alias("_offset"))
    if raw.rdd.getNumPartitions() + len(files) <= BROADCAST_SPLITS:
        entries = F.broadcast(entries)
    placed = local.join(entries, ["_file", "_block"])
    state = F.when(free, F.col("_before") + F.col("_entry")).otherwise(F.col("_before")) % 2
    placed = placed.withColumns({"_state": state, "_begins": begins(F.col("_entry"))})
    upto = W.partitionBy("_file", "_block").orderBy("_at").rowsBetween(W.unboundedPreceding, 0)
    numbered = placed.select(
        "_file", "_block", "_at", "_line", "_state", (F.col("_offset") + F.sum("_begins").over(upto)).alias("_record"),
        F.when(F.col("_state") == 0, F.col("_from_out")).otherwise(F.col("_from_in")).alias("_after"),
    ).where((F.col("_state") == 1) | (F.col("_line") != ""))
    whole = (F.col("_state") == 0) & (F.col("_after") == 0)
    together = numbered.where(~whole).groupBy("_file", "_record").agg(F.array_sort(F.collect_list(F.struct("_block", "_at", "_line"))).alias("_lines"))
    text = numbered.where(whole).select("_file", "_record", "_line").unionByName(
        together.select("_file", "_record", F.array_join(F.transform("_lines", lambda x: x["_line"]), "\n").alias("_line")))
    fields = ", ".join([*(f"_c{i} STRING" for i in range(width)), "_surplus STRING"])
    options = {"sep": shape.separator, "quote": '"', "escape": '"', "multiLine": "true"}
    rows = text.where("_record > 1").select("_file", (F.col("_record") - 1).alias("_row"), F.from_csv("_line", fields, options).alias("_cells"))
    too_long = F.raise_error(F.concat(F.lit("a row has more fields than the header of "), F.col("_file"))).cast("boolean")
    return rows.where(F.when(F.col("_cells._surplus").isNotNull(), too_long).otherwise(F.lit(True))).select(
        *[F.col(f"_cells._c{i}").alias(f"_c{i}") for i in range(width)], "_file", "_row")


def read_files(spark: SparkSession, files: list[FileFormat], period: int | None = None) -> DataFrame:
    """Canonical rows of all files; files with the same format are one scan, files of one name never share one."""
    groups: dict[tuple, list[FileFormat]] = {}
    seen: Counter = Counter()
    for file in files:
        key = (file.header.layout, file.header.names, file.encoding, file.separator, file.multi_line, seen[file.name])
        seen[file.name] += 1
        groups.setdefault(key, []).append(file)
    return union_all([
        normalize(
            (read_quoted if group[0].multi_line else read_raw)(spark, group), group[0].header, "_file", "_row", period, files=len(group),
            years={period_of(file.name, file.header.fallback_period, period) for file in group},
        )
        for group in groups.values()
    ])


@dataclass(frozen=True)
class LayoutFile:
    """A normalised file: its rows and what was found out about it."""

    rows: DataFrame
    layout: str
    period: int
    renamed: dict[str, str]
    unknown: tuple[str, ...]
    name: str


def read_layout_csv(spark: SparkSession, path: str, period: int | None = None, **registry) -> LayoutFile:
    file = sniff(spark, [path], **registry)[0]
    return LayoutFile(
        rows=read_files(spark, [file], period),
        layout=file.header.layout,
        period=period_of(file.name, file.header.fallback_period, period),
        renamed=file.header.renamed,
        unknown=file.header.unknown,
        name=file.name,
    )
