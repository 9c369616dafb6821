"""CSV and JSON exports. Each is a folder of part files written by the tasks."""

from pyspark.sql import DataFrame, functions as F

from panelwise.functions.payload import iso_timestamp


def export_csv(df: DataFrame, path: str) -> str:
    """CSV with a header; no rows still give the header."""
    df.write.mode("overwrite").option("header", True).csv(path)
    return path


def export_json(df: DataFrame, path: str) -> str:
    """One JSON document per row; missing fields are written as null, timestamps as ISO text."""
    stamps = [name for name, kind in df.dtypes if kind == "timestamp"]
    df.withColumns({c: iso_timestamp(c) for c in stamps}).write.mode("overwrite").option(
        "ignoreNullFields", False
    ).json(path)
    return path


def export_per_model(df: DataFrame, path: str, model: str = "model_id") -> str:
    """Evaluation rows, one CSV folder per model, in one write."""
    df.withColumn("_model", F.col(model)).write.mode("overwrite").option("header", True).partitionBy("_model").csv(path)
    return path
