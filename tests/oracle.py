"""Comparing a Spark result with the SQL result on the same files."""

import hashlib
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages"
    " benchmark labels conversations"
).split()


def connect(folder: str):
    connection = duckdb.connect()
    for name in TABLES:
        path = Path(folder) / f"{name}.parquet"
        connection.execute(f"create view {name} as select * from read_parquet('{path}')")
    return connection


def digest(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    texts = sorted(repr(tuple(row[i] for i in order)) for row in rows)
    return sorted(names), len(texts), hashlib.md5("\n".join(texts).encode()).hexdigest(), texts


def spark_digest(frame):
    return digest(frame.columns, [tuple(row) for row in frame.collect()])


def sql_digest(connection, sql):
    result = connection.execute(sql)
    names = [column[0] for column in result.description]
    return digest(names, result.fetchall())
