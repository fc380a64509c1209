"""Run catalogue queries and their SQL side by side: ``python tests/compare.py FOLDER [name ...]``."""

import sys
import time
from collections import Counter
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def oracle_connection(folder):
    import duckdb

    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return connection


def difference(frame, sql, connection):
    """None when both give the same columns and the same bag of rows, else a short description."""
    columns = sorted(frame.columns)
    mine = Counter(tuple(row) for row in frame.select(*columns).collect())
    result = connection.execute(sql)
    names = [d[0] for d in result.description]
    if sorted(names) != columns:
        return f"columns {columns} != {sorted(names)}"
    order = [names.index(c) for c in columns]
    theirs = Counter(tuple(row[i] for i in order) for row in result.fetchall())
    if mine == theirs:
        return None
    return (
        f"{sum(mine.values())} rows != {sum(theirs.values())}; only here {list((mine - theirs))[:2]}; "
        f"only in SQL {list((theirs - mine))[:2]}"
    )


def main():
    from conftest import make_session

    import __spark_entry__ as entry

    folder, wanted = sys.argv[1], sys.argv[2:]
    spark = make_session()
    connection = oracle_connection(folder)
    bad = 0
    for name, function in entry.queries().items():
        if wanted and name not in wanted:
            continue
        start = time.time()
        try:
            sql = entry.oracle_sql().get(name)
            problem = difference(function(spark, folder), sql, connection) if sql else None
        except Exception as error:
            problem = f"{type(error).__name__}: {str(error)[:700]}"
        bad += problem is not None
        print(f"{'ok ' if problem is None else 'BAD'} {name} {time.time() - start:.1f}s {problem or ''}", flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main()
