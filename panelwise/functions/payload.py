"""JSON payloads, maps and timestamps."""

from pyspark.sql import Column, DataFrame, functions as F, types as T

from panelwise.functions.text import col


def to_payload(df: DataFrame, name: str = "payload", keep: list[str] = ()) -> DataFrame:
    """Each row as one JSON document; missing values are written as JSON null."""
    fields = [c for c in df.columns if c not in keep]
    return df.select(*keep, F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias(name))


def from_payload(df: DataFrame, schema: T.StructType, name: str = "payload") -> DataFrame:
    """JSON documents back to columns; fields that are absent become null."""
    parsed = df.withColumn("_parsed", F.from_json(name, schema))
    return parsed.select(*[c for c in df.columns if c != name], "_parsed.*")


def payload_field(c: Column | str, field: str) -> Column:
    return F.get_json_object(col(c), f"$.{field}")


def lookup(mapping: Column | str, key: Column | str, default) -> Column:
    return F.coalesce(F.element_at(col(mapping), col(key)), default if isinstance(default, Column) else F.lit(default))


def iso_timestamp(c: Column | str) -> Column:
    return F.date_format(col(c), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
