"""Run a registered query on both engines and compare rows exactly."""

import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(folder: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def _cell(value):
    if isinstance(value, float):
        return "NaN" if math.isnan(value) else repr(value)
    return "NULL" if value is None else str(value)


def _rows(names, records):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted(tuple(_cell(r[k]) for k in order) for r in records)


def difference(spark, con, name, run, sql, folder):
    """None when equal, otherwise a short description of the first differences."""
    frame = run(spark, folder)
    mine_names, mine = frame.columns, [tuple(r) for r in frame.collect()]
    cursor = con.execute(sql)
    their_names, theirs = [d[0] for d in cursor.description], cursor.fetchall()
    if sorted(mine_names) != sorted(their_names):
        return f"{name}: columns {sorted(mine_names)} against {sorted(their_names)}"
    left, right = _rows(mine_names, mine), _rows(their_names, theirs)
    if left == right:
        return None
    extra, missing = sorted(set(left) - set(right)), sorted(set(right) - set(left))
    return (
        f"{name}: {len(left)} rows against {len(right)}; {len(extra)} differ\n  columns {sorted(mine_names)}\n"
        + "\n".join(f"  spark  {r}\n  duckdb {d}" for r, d in zip(extra[:2], missing[:2]))
    )
