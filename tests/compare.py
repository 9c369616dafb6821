"""Run registered queries next to their SQL and compare the rows, in any order."""

import glob
import math
import os
import time

import duckdb


def connect(folder):
    connection = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return connection


def cell(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return ""
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, (int, float)) or type(value).__name__ == "Decimal":
        number = float(value)
        return str(0.0 if number == 0 else number)
    return str(value)


def table(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(tuple(cell(row[i]) for i in order) for row in rows)


def compare(spark, connection, function, sql, folder):
    """Empty text when the rows agree, else what differs; and the seconds Spark took."""
    start = time.time()
    frame = function(spark, folder)
    got = table(frame.columns, [tuple(r) for r in frame.collect()])
    seconds = time.time() - start
    if sql is None:
        return "", seconds, len(got[1])
    cursor = connection.execute(sql)
    want = table([d[0] for d in cursor.description], cursor.fetchall())
    if got[0] != want[0]:
        return f"columns {got[0]} / {want[0]}", seconds, len(got[1])
    if got[1] != want[1]:
        extra = sorted(set(got[1]) - set(want[1]))[:2]
        lacking = sorted(set(want[1]) - set(got[1]))[:2]
        return f"rows {len(got[1])} / {len(want[1])}: only Spark {extra}, only SQL {lacking}", seconds, len(got[1])
    return "", seconds, len(got[1])
