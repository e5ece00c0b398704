"""Runs SQL in DuckDB over a folder of tables and compares rows with a frame, whatever their order."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(sql: str, sf_dir: str) -> tuple[list[str], list[tuple]]:
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    found = con.sql(sql)
    return found.columns, found.fetchall()


def _plain(value):
    if isinstance(value, float):
        return None if value != value else round(value, 6)
    return round(float(value), 6) if type(value).__name__ == "Decimal" else value


def normal(columns: list[str], data) -> list[str]:
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(repr([_plain(r[k]) for k in order]) for r in data)


def assert_same(frame, sql: str, sf_dir: str) -> None:
    columns, data = rows(sql, sf_dir)
    assert sorted(columns) == sorted(frame.columns)
    assert normal(frame.columns, frame.collect()) == normal(columns, data)
