"""Text, number and boolean parsing as Column expressions."""

import json
import sys
import unicodedata
from functools import lru_cache

from pyspark.sql import Column, functions as F

from panelwise import fixed

# White space that text is trimmed of, beyond the plain blank.
BLANKS = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\u00a0\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(map(chr, range(0x2000, 0x200B)))
NUMBER = r"^[+-]?(([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?|(?i:inf|infinity))$"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ascii_label(label: str) -> str:
    """Fold one header label on the driver; headers are metadata."""
    plain = unicodedata.normalize("NFKD", str(label)).encode("ascii", "ignore").decode("ascii")
    words = "".join(ch if ch.isalnum() else " " for ch in plain.lower()).split()
    return "_".join(words)


@lru_cache(maxsize=1)
def _decompositions() -> tuple[str, str, dict[str, str]]:
    """Compatibility decompositions to ASCII, by rule: one-letter ones for translate(), the rest as a map."""
    single_from, single_to, longer = [], [], {}
    for point in range(128, sys.maxunicode + 1):
        if 0xAC00 <= point <= 0xD7A3 or 0xD800 <= point <= 0xDFFF:
            continue
        char = chr(point)
        plain = unicodedata.normalize("NFKD", char).encode("ascii", "ignore").decode("ascii")
        if len(plain) == 1 and point < 0x10000:
            single_from.append(char)
            single_to.append(plain)
        elif plain:
            longer[char] = plain
    return "".join(single_from), "".join(single_to), longer


def strip_accents(c: Column | str) -> Column:
    """NFKD to ASCII: letters lose their marks, ligatures expand, what has no ASCII form is deleted."""
    text = col(c)
    single_from, single_to, longer = _decompositions()
    plain = F.translate(text, single_from, single_to)
    # Rare: only rows that hold an expandable character pay for the per-character lookup.
    expansions = F.from_json(F.lit(json.dumps(longer)), "map<string,string>")
    # The map is searched from its front, so only characters that are in it are looked up.
    has = lambda c: F.length(F.translate(c, "".join(longer), "")) < F.length(c)
    expanded = F.array_join(
        F.transform(F.split(plain, ""), lambda ch: F.when((ch > "\x7f") & has(ch), F.element_at(expansions, ch)).otherwise(ch)), ""
    )
    expandable = has(plain)
    folded = F.regexp_replace(F.when(expandable, expanded).otherwise(plain), r"[^\x00-\x7F]", "")
    # Plain ASCII, the usual case, stays as it is.
    return F.when(F.octet_length(text) == F.length(text), text).otherwise(folded)


def fold_label(c: Column | str) -> Column:
    """ASCII snake case: no accents, lower case, runs of other characters become one underscore."""
    snake = F.regexp_replace(F.lower(strip_accents(c)), "[^a-z0-9]+", "_")
    return F.trim(snake, F.lit("_"))


def null_tokens(c: Column | str, tokens=fixed.NA_TOKENS) -> Column:
    c = col(c)
    return F.when(~c.isin(*tokens), c)


def to_number(c: Column | str) -> Column:
    """Text to double, null when it is not a plain decimal number; NaN counts as missing."""
    text = F.trim(col(c).cast("string"), F.lit(BLANKS))
    return F.when(text.rlike(NUMBER), text.try_cast("double"))


def finite_or_null(c: Column | str) -> Column:
    """A double column with NaN read as missing."""
    c = col(c)
    return F.when(~F.isnan(c), c)


def parse_number(c: Column | str, mode: str = "decimal_comma") -> Column:
    """Text to double. ``decimal_comma``: a comma is the decimal mark and drops any dots.

    ``heuristic``: the later of comma and dot is the decimal mark, signs of currency and
    percent are skipped, and dots in groups of three digits are grouping.
    """
    if mode == "decimal_comma":
        text = F.trim(col(c).cast("string"), F.lit(BLANKS))
        comma, dot = F.contains(text, F.lit(",")), F.contains(text, F.lit("."))
        text = F.when(comma & dot, F.replace(text, F.lit("."))).otherwise(text)
        return to_number(F.replace(text, F.lit(","), F.lit(".")))
    if mode != "heuristic":
        raise ValueError(f"unknown mode {mode!r}")
    text = F.regexp_replace(col(c), "[\\s\u00a0R$€£%]", "")
    comma, dot = F.instr(F.reverse(text), ","), F.instr(F.reverse(text), ".")
    no_dots, no_commas = F.replace(text, F.lit(".")), F.replace(text, F.lit(","))
    plain = (
        F.when((comma > 0) & (dot > 0) & (comma < dot), F.replace(no_dots, F.lit(","), F.lit(".")))
        .when((comma > 0) & (dot > 0), no_commas)
        .when(comma > 0, F.replace(text, F.lit(","), F.lit(".")))
        .when(text.rlike(r"^-?\d{1,3}(\.\d{3})+$"), no_dots)
        .otherwise(text)
    )
    return F.when(plain.rlike(r"^-?\d+(\.\d+)?$"), plain.try_cast("double"))


def parse_bool(c: Column | str, true_words=fixed.TRUE_WORDS, false_words=fixed.FALSE_WORDS) -> Column:
    """Three-valued: true words, false words, anything else null."""
    word = fold_label(col(c).cast("string"))
    return F.when(word.isin(*true_words), True).when(word.isin(*false_words), False)


def category(c: Column | str, missing: str = fixed.MISSING_CATEGORY) -> Column:
    return F.coalesce(col(c).cast("string"), F.lit(missing))


def infer_period(argument, file_name: Column | str, fallback) -> Column:
    """Explicit period, else the first 20xx in the file name, else the layout's fallback; zero counts as absent."""
    argument = argument if isinstance(argument, Column) else F.lit(argument).cast("int")
    fallback = fallback if isinstance(fallback, Column) else F.lit(fallback).cast("int")
    in_name = F.nullif(F.regexp_extract(col(file_name), r"(20\d{2})", 1), F.lit(""))
    return F.coalesce(F.nullif(argument, F.lit(0)), in_name.cast("int"), fallback)


def file_stem(c: Column | str) -> Column:
    """File name without its last suffix; a leading dot is part of the name."""
    return F.regexp_replace(col(c), r"(?<=.)\.[^.]+$", "")


def normalized_name(file_name: Column | str, period: Column | str) -> Column:
    return F.concat(file_stem(file_name), F.lit("__normalized_"), col(period).cast("string"), F.lit(".csv"))


def normalized_file_name(file_name: str, period: int) -> str:
    """The same name for one file, known on the driver."""
    stem, dot, _ = file_name.rpartition(".")
    return f"{stem if dot and stem else file_name}__normalized_{period}.csv"


def model_id(name: Column | str, strategy: Column | str) -> Column:
    return F.concat(col(name), F.lit(fixed.MODEL_ID_SEPARATOR), col(strategy))


def split_model_id(c: Column | str) -> tuple[Column, Column]:
    """Name and strategy, split at the first separator."""
    c, sep = col(c), fixed.MODEL_ID_SEPARATOR
    at = F.locate(sep, c)
    name = F.when(at > 0, F.substring(c, F.lit(1), at - 1)).otherwise(c)
    strategy = F.when(at > 0, F.substring(c, at + len(sep), F.length(c))).otherwise(F.lit(""))
    return name, strategy


def sort_kind(c: Column | str) -> Column:
    """Class of a table cell: 0 number, 1 text, 2 empty."""
    text = F.trim(F.replace(col(c), F.lit("\u00a0"), F.lit(" ")), F.lit(BLANKS))
    empty = text.isNull() | (text == "") | (text == "-") | text.rlike(r"(?i)^n/?a$")
    return F.when(empty, 2).when(parse_number(text, "heuristic").isNotNull(), 0).otherwise(1)


def natural_key(c: Column | str) -> Column:
    """Text key that sorts accent-blind, case-blind and digit runs by their value."""
    plain = F.lower(strip_accents(c))
    runs = F.regexp_extract_all(plain, F.lit("([0-9]+|[^0-9]+)"), F.lit(1))
    digits = lambda run: F.ltrim(run, F.lit("0"))
    padded = F.transform(
        runs,
        lambda run: F.when(
            run.rlike("^[0-9]"), F.concat(F.lpad(F.length(digits(run)).cast("string"), 9, "0"), digits(run))
        ).otherwise(run),
    )
    return F.array_join(padded, "")
