"""Run a query and its SQL on the same tables and compare the rows."""

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def open_tables(sf_dir):
    db = duckdb.connect()
    for table in TABLES:
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return db


def spark_rows(frame):
    return sorted(frame.columns), _rows(frame.columns, frame.collect())


def sql_rows(db, sql):
    result = db.execute(sql)
    columns = [c[0] for c in result.description]
    return sorted(columns), _rows(columns, result.fetchall())


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr(tuple(_plain(row[i]) for i in order)) for row in rows)


def _plain(value):
    return round(value, 9) if isinstance(value, float) else value
